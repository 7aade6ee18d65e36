"""ALS scores by blocks of factors: against brute force and against MLlib's own product."""

import inspect
import math

import numpy as np
import pytest

from shoplens.operators import als
from shoplens.operators.als import _block_top, recommend, score_blocks, train
from shoplens.plans import q_recommend
from shoplens.session import stored
from tests.conftest import SF_SMALL
from tests.test_plans import plan_text


def best(users, items, n):
    return {u: sorted((-float(np.float32(np.dot(x, y))), i) for i, y in items.items())[:n] for u, x in users.items()}


def whole(rng, size):
    """Small whole numbers: dot products are exact and many are equal."""
    return {int(i): rng.integers(-2, 3, 4).astype(np.float32) for i in rng.permutation(3 * size)[:size]}


def test_score_blocks_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    users, items = whole(rng, 70), whole(rng, 90)
    users[500] = np.zeros(4, np.float32)  # every item scores the same
    frames = [spark.createDataFrame([(i, [float(x) for x in v]) for i, v in side.items()], "id int, features array<float>")
              for side in (users, items)]
    for n, block in ((6, 20), (6, 1000), (200, 20)):
        got = {}
        for r in score_blocks(*frames, n, block).orderBy("user_idx", "rank").collect():
            got.setdefault(r.user_idx, []).append((-r.rating, r.item_idx))
        assert got == best(users, items, n), (n, block)


def test_a_block_is_scored_tile_by_tile(monkeypatch):
    monkeypatch.setattr(als, "TILE_USERS", 8)
    monkeypatch.setattr(als, "TILE_ITEMS", 16)
    rng = np.random.default_rng(6)
    for n in (3, 40):
        users, items = whole(rng, 30), whole(rng, 100)
        got = {}
        for u, i, s in _block_top(np.array(list(users)), np.stack(list(users.values())), np.array(list(items)),
                                  np.stack(list(items.values())), n):
            for x, y, z in zip(u.tolist(), i.tolist(), s.tolist()):
                got.setdefault(x, []).append((-z, y))
        assert got == best(users, items, n)


def test_both_methods_give_the_same_scores(spark):
    rng = np.random.default_rng(7)
    rows = [(f"u{u}", f"i{i}", float(1 + (u * i) % 5)) for u in range(40) for i in rng.permutation(30)[:8].tolist()]
    result = train(spark.createDataFrame(rows, "user_id string, asin string, rating double"), max_iter=2)
    users = spark.createDataFrame([("u1",), ("u2",), ("u2",), ("none",), (None,)], "user_id string")
    lists = []
    for method in ("product", "blocks"):
        flat = recommend(result, users, 5, method=method).orderBy("user_id", "rank").collect()
        lists.append([(r.user_id, int(r["rank"]), r.predicted_rating) for r in flat])
        assert len({(r.user_id, r.product_id) for r in flat}) == 10
    assert [x[:2] for x in lists[0]] == [x[:2] for x in lists[1]]
    assert all(math.isclose(x[2], y[2], abs_tol=0.011) for x, y in zip(*lists))
    with pytest.raises(ValueError):
        recommend(result, users, 5, method="none")


def test_properties_score_by_blocks():
    assert 'method="blocks"' in inspect.getsource(q_recommend.q_als_properties)


def test_many_scores_are_not_left_to_the_product(spark, monkeypatch):
    def query():
        df = q_recommend.q_als_recommendations(spark, SF_SMALL)
        return df, plan_text(df)

    small, plan = query()
    assert "CartesianProduct" in plan
    monkeypatch.setattr(als, "PRODUCT_SCORES", 0)
    large, plan = query()
    assert "CartesianProduct" not in plan and "FlatMapGroupsInArrow" in plan
    # dealt by a fixed number of partitions, without another exchange before the kernel
    assert "REPARTITION_BY_NUM" in plan[plan.index("FlatMapGroupsInArrow"):].split("Exchange")[1]
    lists = [sorted((r.user_id, int(r["rank"]), r.title is not None) for r in df.collect()) for df in (small, large)]
    assert lists[0] == lists[1] and len(lists[0]) == 10 * len({u for u, _, _ in lists[0]})
    rows = [(f"u{u}", f"i{i}", float(1 + (u * i) % 5)) for u in range(9) for i in range(12)]
    result = train(spark.createDataFrame(rows, "user_id string, asin string, rating double"), max_iter=1)
    scores = result.model.userFactors.count() * result.model.itemFactors.count()
    for most, product in ((scores, True), (scores - 1, False)):
        monkeypatch.setattr(als, "PRODUCT_SCORES", most)
        assert ("CartesianProduct" in plan_text(recommend(result, result.user_index.select("user_id"), 3))) is product


def test_fitting_leaves_no_shuffles_and_stores_compressed_tables(spark, monkeypatch):
    """The factors are read back from the written model, the ratings from compressed tables, not from checkpoints."""
    rows = [(f"u{u}", f"i{i}", float(1 + (u * i) % 5)) for u in range(12) for i in range(9)]
    ratings = spark.createDataFrame(rows, "user_id string, asin string, rating double")
    names = []
    monkeypatch.setattr(als, "stored", lambda df, name: (names.append(name), stored(df, name))[1])
    monkeypatch.setattr(als, "FITTED_SCORES", 0)
    result = train(ratings, max_iter=2)
    assert names == ["als-ratings", "als-indexed"]
    for side, size in ((result.model.userFactors, 12), (result.model.itemFactors, 9)):
        assert side.count() <= size and "als-model" in side.inputFiles()[0]
    assert result.predictions.count() > 0 and math.isfinite(als.rmse(result).first().rmse)


def test_items_pass_by_a_block_of_users_once(spark, monkeypatch):
    """Only users times n rows leave the tasks, from spans and chunks of any size, and each block has a partition."""
    monkeypatch.setattr(als, "CHUNK_FACTORS", 7)
    monkeypatch.setattr(als, "SPAN_FACTORS", 20)
    rng = np.random.default_rng(9)
    users, items = whole(rng, 300), whole(rng, 150)
    frames = [spark.createDataFrame([(i, [float(x) for x in v]) for i, v in side.items()], "id int, features array<float>").repartition(5)
              for side in (users, items)]
    top = score_blocks(*frames, 6, 40)
    assert "Window" not in plan_text(top)
    got = {}
    for r in top.orderBy("user_idx", "rank").collect():
        got.setdefault(r.user_idx, []).append((-r.rating, r.item_idx))
    assert got == best(users, items, 6)
    for side in (0, 1):
        none = [f.limit(0) if k == side else f for k, f in enumerate(frames)]
        assert score_blocks(*none, 6).collect() == []
    for blocks in (1, 12, 40):
        keys = als._block_keys(spark, blocks)
        at = spark.createDataFrame([(k,) for k in keys], "k int").selectExpr(f"pmod(hash(k), {blocks}) at").collect()
        assert [r["at"] for r in at] == list(range(blocks))
