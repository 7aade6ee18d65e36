"""Edge cases listed in FIXTURES.md: null/unknown actions, null text, bad
ratings, tied similarities, products without a category."""

import datetime as dt

from pyspark.sql import functions as F

from shoplens.operators import behavior as B
from shoplens.operators import catalog
from shoplens.operators import events as E
from shoplens.operators import profiling as PR
from shoplens.operators import recommend as RC


def test_null_and_unknown_actions(spark):
    t = dt.datetime(2024, 1, 1)
    acts = spark.createDataFrame(
        [("1", "u1", "p1", None, t), ("2", "u1", "p1", "teleport", t), ("3", "u2", "p2", "view", t)],
        "event_id string, user_id string, product_id string, action string, timestamp timestamp_ntz")
    enriched = {r.event_id: r for r in E.enrich_interactions(acts).collect()}
    assert enriched["1"].action_weight == 1.0 and enriched["1"].recommendation_trigger is False
    assert enriched["2"].action_weight == 1.0
    counts = B.action_counts(acts).first()
    assert counts.views == 1 and counts.clicks == 0


def test_null_review_text_and_bad_rating(spark):
    rows = spark.createDataFrame([(0, "u", "p", "4.5.1", None), (1, "u", "p", "5", "great")],
                                 "row_index long, user_id string, product_id string, rating string, "
                                 "review_text string")
    ev = E.enrich_reviews(E.review_events(rows, "x", "row_index")).orderBy("row_index").collect()
    assert ev[0].review_length == 0 and ev[0].recommendation_weight == 1.0
    assert ev[0].sentiment_analysis.score == 0.5
    assert ev[1].recommendation_weight == 1.01       # 5/5 * (1 + 0.2 * 0.05)
    inter = E.interactions_from_reviews(E.review_events(rows, "x", "row_index")).collect()
    assert sorted(r.action for r in inter) == ["cart_add", "click", "like", "purchase", "view", "view"]


def test_tied_similarities_break_on_id(spark):
    # users b, c, d have identical sets: ties broken by ascending neighbour id
    rows = [(u, p) for u in "abcd" for p in ("x", "y")] + [("a", "z")]
    sets = spark.createDataFrame(rows, "user_id string, product_id string")
    nb = RC.user_neighbours(sets, k=2).where(F.col("user_id") == "d").orderBy("rank").collect()
    assert [r.neighbour_id for r in nb] == ["b", "c"]


def test_product_without_category_drops_in_dimension(spark):
    prods = spark.createDataFrame([("A", "t", "1.5", "", "", "10", None, None, "7", None, None),
                                   ("B", "u", "bad", "", "", "10", None, None, "999", None, None)],
                                  "asin string, title string, price string, imgUrl string, productURL string, "
                                  "listPrice string, stars string, reviews string, category_id string, "
                                  "isBestSeller string, boughtInLastMonth string")
    cats = spark.createDataFrame([(7, "Tools")], "id long, category_name string")
    dim = catalog.product_dimension(prods, cats).collect()
    assert [(r.product_id, r.category, r.price) for r in dim] == [("A", "Tools", 1.5)]


def test_column_overlap_names(spark):
    a = spark.createDataFrame([(1, "x", 2)], "id long, category_name string, cat_id long")
    b = spark.createDataFrame([(1, 2.0)], "id long, price double")
    info = PR.column_overlap(a, b)
    assert info["shared"] == ["id"]
    assert info["category_like"] == ["cat_id", "category_name"]
    assert info["dtypes"] == ["bigint", "double", "string"]


def test_events_without_an_id_all_stay(spark, tmp_path):
    from shoplens.streaming import jobs as J
    src = spark.createDataFrame(
        [(None, "u1", "2024-01-01 00:00:00"), (None, "u2", "2024-01-01 00:00:00"), (None, "u1", "2024-01-01 00:00:00"),
         ("e1", "u1", "2024-01-01 00:00:00"), ("e1", "u1", "2024-01-01 00:00:00")],
        "event_id string, user_id string, ts string").selectExpr("event_id", "user_id", "cast(ts as timestamp) as timestamp")
    src.write.parquet(str(tmp_path / "in"))
    stream = J.file_event_stream(spark, str(tmp_path / "in"), "event_id string, user_id string, timestamp timestamp")
    q = (J.dedupe_events(stream).writeStream.format("memory").queryName("no_ids")
         .option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start())
    q.awaitTermination()
    got = sorted((r["event_id"] or "", r["user_id"]) for r in spark.sql("select * from no_ids").collect())
    assert got == [("", "u1"), ("", "u2"), ("e1", "u1")]


def test_processing_ids_do_not_collide(spark):
    from shoplens.operators import events as E
    df = spark.range(20_000).selectExpr("cast(id as string) as event_id", "id % 7 as user_id")
    assert E.hashed_processing_ids(df, "p_").select("processing_id").distinct().count() == 20_000
    none = spark.range(2).selectExpr("cast(null as string) as event_id", "id as user_id")
    assert E.hashed_processing_ids(none, "p_").select("processing_id").distinct().count() == 2


def test_rounding_of_large_numbers(spark):
    from shoplens.functions.scalars import round_half_up
    rows = [(1e13,), (3e18,), (2.5,), (None,), (float("nan"),)]
    got = [r[0] for r in spark.createDataFrame(rows, "x double").select(round_half_up("x", 3)).collect()]
    assert got[:4] == [1e13, 3e18, 2.5, None] and got[4] != got[4]


def test_tokens_are_those_of_split(spark):
    from shoplens.functions.scalars import whitespace_tokens
    texts = ["\ngood phone", "\t a b　c ", "", " \n", "a b\x1cc d", "one"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(whitespace_tokens("t")).collect()
    assert [r[0] for r in got] == [len(t.split()) for t in texts]


def test_missing_connector_is_an_error(spark, tmp_path):
    import pytest

    from shoplens.sinks.writers import write_table
    with pytest.raises(Exception, match="delta"):
        write_table(spark.range(1), str(tmp_path / "t"), "delta")


def test_similar_and_recommendation_bounds(spark):
    import pytest

    from shoplens.operators import recommend as R
    df = spark.createDataFrame([("u", "p")], "user_id string, product_id string")
    for k in (0, 31):
        with pytest.raises(ValueError):
            R.similar_products_by_users(df, k)
    with pytest.raises(ValueError):
        R.event_recommendations(df, df, 51)
