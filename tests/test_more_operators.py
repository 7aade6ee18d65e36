"""Argument bounds, preference maps, dataset append, approximate describe and
the REC7 metrics cross-checked with MLlib's RankingEvaluator."""

import pytest
from pyspark.ml.evaluation import RankingEvaluator
from pyspark.sql import functions as F

from shoplens.operators import events as E
from shoplens.operators import profiles as P
from shoplens.operators import profiling as PR
from shoplens.operators import recommend as RC
from shoplens.operators import trending as TR
from shoplens.sources import tables as T
from tests.conftest import SF_SMALL


def test_argument_bounds():
    assert TR.check_limit("trending", 100) == 100
    for kind, bad in (("trending", 0), ("trending", 101), ("similar", 31), ("category", 51),
                      ("recommendations", 51)):
        with pytest.raises(ValueError):
            TR.check_limit(kind, bad)
    with pytest.raises(ValueError):
        TR.period_days("year")


def test_preference_maps(spark):
    rows = spark.createDataFrame(
        [(0, "u", "p", "4", "t", "en", "src1"), (1, "u", "q", "5", "t", "en", "x" * 60),
         (2, "v", "p", "3", "t", "", "src1")],
        "row_index long, user_id string, product_id string, rating string, review_text string, "
        "lang string, source string")
    rv = E.review_events(rows, "fx", "row_index")
    maps = {r.user_id: r.preferences for r in P.preference_maps(rv).collect()}
    assert maps == {"u": {"en": 2, "src1": 1}, "v": {"src1": 1}}   # 60-char value and "" skipped


def test_append_datasets(spark):
    a = spark.createDataFrame([(1, "x")], "user_id int, asin string")
    b = spark.createDataFrame([(2, 4.0)], "user_id int, rating double")
    out = E.append_datasets(a, b).orderBy("user_id").collect()
    assert [tuple(r) for r in out] == [(1, "x", None), (2, None, 4.0)]


def test_describe_approx_close_to_exact(spark):
    orders = T.read_table(spark, SF_SMALL, "orders", ["o_totalprice"])
    exact = PR.describe(orders).first()
    approx = PR.describe(orders, approx=True).first()
    assert exact["count"] == approx["count"]
    for q in ("p25", "p50", "p75"):
        assert abs(exact[q] - approx[q]) <= 0.02 * abs(exact[q]) + 1e-9


def test_evaluate_matches_ranking_evaluator(spark):
    acts = T.actions(spark, SF_SMALL)
    cut = acts.select(F.timestamp_add("DAY", F.lit(-7), F.max("timestamp"))).scalar()
    tr = RC.interaction_sets(acts.where(F.col("timestamp") <= cut))
    rel = (RC.interaction_sets(acts.where((F.col("timestamp") > cut) & F.col("action").isin("click", "purchase")))
           .join(tr, ["user_id", "product_id"], "left_anti"))
    pop = RC.popularity(acts.where(F.col("timestamp") <= cut))
    empty = tr.select("user_id", "product_id", F.lit(0.0).alias("score"), F.lit(0).alias("rank")).where("false")
    recs = RC.fill_with_popular(tr.select("user_id"), empty, tr, pop)
    ours = RC.evaluate(recs, rel, 5).first()
    pred = recs.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "product_id"))),
                                                   lambda x: x["product_id"].cast("double")).alias("prediction"))
    lab = rel.groupBy("user_id").agg(F.collect_list(F.col("product_id").cast("double")).alias("label"))
    both = lab.join(pred, "user_id", "left").withColumn(
        "prediction", F.coalesce("prediction", F.array().cast("array<double>")))
    p_at_5 = RankingEvaluator(metricName="precisionAtK", k=5).evaluate(both)
    r_at_5 = RankingEvaluator(metricName="recallAtK", k=5).evaluate(both)
    assert abs(ours.precision_at_k - p_at_5) < 1e-4
    assert abs(ours.recall_at_k - r_at_5) < 1e-4
