"""The small ratings fixture and the stale-average rule, computed by hand."""

import datetime as dt

from pyspark.sql import functions as F

from shoplens.operators import events as E
from shoplens.operators import profiles as P
from shoplens.operators import recommend as RC

RATINGS = [(1, "B001LAPTOP", 5), (1, "B002MOUSE", 4), (1, "B003COFFEE", 3), (2, "B001LAPTOP", 4),
           (2, "B004HEADPHONES", 5), (2, "B005BOOK", 4), (3, "B002MOUSE", 5), (3, "B003COFFEE", 4),
           (3, "B004HEADPHONES", 3), (4, "B001LAPTOP", 3), (4, "B005BOOK", 5), (5, "B004HEADPHONES", 4)]


def reviews(spark):
    base = dt.datetime(2024, 1, 1)
    rows = [(i, str(u), p, str(r), "text", base + dt.timedelta(minutes=i))
            for i, (u, p, r) in enumerate(RATINGS)]
    df = spark.createDataFrame(rows, "row_index long, user_id string, product_id string, rating string, "
                                     "review_text string, timestamp timestamp_ntz")
    return E.review_events(df, "fixture", "row_index")


def empty_actions(spark):
    return spark.createDataFrame([], "user_id string, product_id string, action string, "
                                     "timestamp timestamp_ntz, event_id string")


def test_neighbours_and_recommendations(spark):
    rv = reviews(spark)
    sets = RC.interaction_sets(rv)
    nb = {(r.user_id, r.neighbour_id): r.similarity
          for r in RC.user_neighbours(sets).where(F.col("user_id") == "1").collect()}
    assert nb == {("1", "3"): 0.5, ("1", "4"): 0.25, ("1", "2"): 0.2}   # user 5: 0, dropped
    pp = P.product_profiles(rv, empty_actions(spark))
    recs = RC.recommend_for_users(sets, pp).where(F.col("user_id") == "1").orderBy("rank").collect()
    assert [(r.product_id, r.score, r.confidence, r.predicted_rating) for r in recs] == [
        ("B004HEADPHONES", 0.7, 0.7, 4.0), ("B005BOOK", 0.45, 0.45, 4.5)]
    assert recs[0].reason == "Similar users (similarity: 0.7) liked this product"


def test_stale_average(spark):
    base = dt.datetime(2024, 1, 1)
    rows = [(0, "u", "p1", "4"), (1, "u", "p2", None), (2, "u", "p3", "2"), (3, "u", "p4", None),
            (4, "v", "p1", None)]
    df = spark.createDataFrame([(i, u, p, r, base + dt.timedelta(minutes=i)) for i, u, p, r in rows],
                               "row_index long, user_id string, product_id string, rating string, "
                               "timestamp timestamp_ntz")
    rv = E.review_events(df, "fx", "row_index")
    prof = {r.user_id: r for r in P.user_profiles(rv, empty_actions(spark)).collect()}
    assert prof["u"].avg_rating == 2.0            # (4 + 2) / 3: the 4th review is unrated
    assert prof["u"].reviews == 4 and prof["u"].products_count == 4
    assert prof["v"].avg_rating == 0.0
    plain = {r.user_id: r.avg_rating for r in P.user_profiles(rv, empty_actions(spark), "plain").collect()}
    assert plain["u"] == 3.0


def test_fill_with_popular_exact(spark):
    # user a has seen the 3 most popular products; user b nothing; k = 3
    pop = spark.createDataFrame([(f"p{i}", float(10 - i), i + 1) for i in range(6)],
                                "product_id string, popularity double, pop_rank long")
    seen = spark.createDataFrame([("a", "p0"), ("a", "p1"), ("a", "p2")], "user_id string, product_id string")
    recs = spark.createDataFrame([("a", "p4", 0.9, 1)], "user_id string, product_id string, score double, rank int")
    users = spark.createDataFrame([("a",), ("b",)], "user_id string")
    out = RC.fill_with_popular(users, recs, seen, pop, k=3).orderBy("user_id", "rank").collect()
    assert [(r.user_id, r.rank, r.product_id, r.source) for r in out] == [
        ("a", 1, "p4", "collaborative"), ("a", 2, "p3", "popularity"), ("a", 3, "p5", "popularity"),
        ("b", 1, "p0", "popularity"), ("b", 2, "p1", "popularity"), ("b", 3, "p2", "popularity")]
