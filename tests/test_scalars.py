"""Hand-computed cases for the row functions (FIXTURES.md section B)."""

from pyspark.sql import functions as F

from shoplens.functions import scalars as S


def one(spark, col, schema, rows):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(col).collect()]


def test_sentiment(spark):
    rows = [("Great phone, love it",), ("badge",), ("",), (None,), ("plain words only",)]
    out = one(spark, S.sentiment_from_counts(S.sentiment_counts("t")), "t string", rows)
    assert (out[0].score, out[0].confidence, out[0].positive_words, out[0].negative_words) == (1.0, 0.5, 2, 0)
    assert (out[1].score, out[1].confidence) == (0.0, 1.0)        # "bad" inside "badge"
    assert (out[2].score, out[2].confidence, out[2].positive_words) == (0.5, 0.0, None)
    assert (out[3].score, out[3].confidence) == (0.5, 0.0)
    assert (out[4].score, out[4].confidence) == (0.5, 0.0)


def test_recommendation_weight(spark):
    rows = [("4", "x" * 200), ("abc", None), (None, "y" * 50), ("4.5.1", None)]
    out = one(spark, S.recommendation_weight("r", "t"), "r string, t string", rows)
    assert out == [1.12, 1.0, 1.1, 1.0]


def test_quality_score(spark):
    rows = [("4", "z" * 60, {"a": "1", "b": "2", "c": "3"}), (None, None, None), ("", "short", {"a": ""})]
    out = one(spark, S.quality_score("r", "t", "m"), "r string, t string, m map<string,string>", rows)
    assert out == [1.0, 0.5, 0.7]


def test_action_weight_and_triggers(spark):
    rows = [("view",), ("click",), ("cart_add",), ("share",), ("like",), ("purchase",), ("other",), (None,)]
    w = one(spark, S.action_weight("a"), "a string", rows)
    assert w == [1.0, 2.0, 3.0, 3.5, 4.0, 5.0, 1.0, 1.0]
    t = one(spark, S.is_stream_trigger("a"), "a string", rows)
    assert t == [False, False, True, False, True, True, False, False]


def test_rating_actions_and_confidence(spark):
    rows = [(4.5,), (3.0,), (2.0,), (0.0,), (None,), (4.0,)]
    acts = one(spark, S.rating_actions("r"), "r double", rows)
    assert acts == [["view", "click", "cart_add", "purchase", "like"], ["view", "click"], ["view"],
                    ["view"], ["view"], ["view", "click", "cart_add", "purchase"]]
    conf = one(spark, S.interaction_confidence("r"), "r double", rows)
    assert conf == [0.9, 0.7, 0.7, 0.7, 0.7, 0.9]


def test_numeric_text(spark):
    rows = [("4",), ("4.5",), ("4.5.1",), ("abc",), ("",), (None,), (".",)]
    out = one(spark, S.rating_value("r"), "r string", rows)
    assert out == [4.0, 4.5, None, None, None, None, None]


def test_event_priority(spark):
    rows = [(0, "view"), (7, "view"), (7, "purchase"), (None, "like"), (3, "share"), (3, "click"),
            (None, None)]
    df = spark.createDataFrame(rows, "u long, a string").select(
        S.event_priority("u", "a").alias("p"), S.is_api_trigger("a").alias("t"))
    out = [(r.p.action_priority, r.p.triggers, r.p.business_impact, r.t) for r in df.collect()]
    assert out[0] == (None, None, None, True)          # user 0 counts as no user, still triggered
    assert out[1] == ("high", None, None, True)
    assert out[2] == ("critical", ["recommendation_update", "user_model_retrain"], "high", True)
    assert out[3] == ("medium", ["preference_update"], "medium", True)
    assert out[4] == ("medium", ["preference_update"], "medium", False)
    assert out[5] == (None, None, None, False)
    assert out[6] == (None, None, None, False)


def test_round_half_up_and_money(spark):
    df = spark.createDataFrame([(0.0625,), (2.675,), (1.005,)], "x double")
    assert [r[0] for r in df.select(S.round_half_up("x", 3)).collect()] == [0.063, 2.675, 1.005]
    m = spark.createDataFrame([(42.95,), (42.96,)], "v double").select(S.money_mean("v")).first()[0]
    assert m == 42.96


def test_predicted_rating_and_reason(spark):
    df = spark.createDataFrame([(4.456,), (0.0,), (None,)], "a double")
    assert [r[0] for r in df.select(S.predicted_rating("a")).collect()] == [4.46, 4.0, 4.0]
    txt = spark.range(1).select(S.reason_text(F.lit(0.7))).first()[0]
    assert txt == "Similar users (similarity: 0.7) liked this product"
