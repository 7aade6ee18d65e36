"""Prefix-filtered index against brute force on small random inputs."""

import math
import random

import pytest

from shoplens.operators import prefix_index as PI
from shoplens.operators.prefix_index import prefix_index, top_k_sparse


def brute_topk(sets, k, measure, threshold):
    out = {}
    for u in sets:
        cands = []
        for v in sets:
            if u == v:
                continue
            c = len(sets[u] & sets[v])
            if c == 0:
                continue
            s = c / (len(sets[u]) + len(sets[v]) - c) if measure == "jaccard" else \
                c / math.sqrt(len(sets[u]) * len(sets[v]))
            if s > threshold:
                cands.append((-s, v, s))
        cands.sort()
        out[u] = [(v, s) for _, v, s in cands[:k]]
    return out


def found(df, column="user"):
    res = {}
    for r in df.orderBy(column, "rank").collect():
        res.setdefault(r[column], []).append((r["neighbour_" + column], r.similarity))
    return res


def frame(spark, sets):
    return spark.createDataFrame([(u, i) for u, its in sets.items() for i in its] * 2, "user string, item string")


@pytest.mark.parametrize("threshold", [0.0, 0.1, 0.34, 0.5, 0.75])
def test_top_k_sparse_equals_brute_force(spark, threshold):
    rnd = random.Random(7)
    sets = {f"u{u:02d}": {f"i{int(40 * rnd.random() ** 3)}" for _ in range(rnd.randrange(1, 30))} | {"hot"} for u in range(70)}
    sets |= {"twin1": {"x", "y"}, "twin2": {"x", "y"}, "alone": {"z"}, "third": {"x", "y", "w"}}
    got = found(top_k_sparse(frame(spark, sets), "user", "item", 4, "jaccard", threshold))
    want = brute_topk(sets, 4, "jaccard", threshold)
    for u in sets:
        assert [v for v, _ in got.get(u, [])] == [v for v, _ in want[u]], (threshold, u)
        assert all(abs(a - b) < 1e-12 for (_, a), (_, b) in zip(got.get(u, []), want[u]))


def test_top_k_cosine_and_bad_arguments(spark):
    rnd = random.Random(11)
    sets = {f"u{u:02d}": {f"i{rnd.randrange(250)}" for _ in range(rnd.choice([1, 2, 3, 40, 200]))} | {"hot"} for u in range(50)}
    got = found(top_k_sparse(frame(spark, sets), "user", "item", 3, "cosine", 0.0))
    assert {u: [v for v, _ in r] for u, r in got.items()} == \
        {u: [v for v, _ in r] for u, r in brute_topk(sets, 3, "cosine", 0.0).items() if r}
    for arguments in (("dice", 0.0), ("cosine", 0.2)):
        with pytest.raises(ValueError):
            top_k_sparse(frame(spark, sets), "user", "item", 3, *arguments)
    assert top_k_sparse(frame(spark, sets).limit(0), "user", "item", 3, "jaccard", 0.1).collect() == []


def test_sets_of_very_different_sizes(spark):
    rnd = random.Random(11)
    sets = {f"u{u:02d}": {f"i{rnd.randrange(250)}" for _ in range(rnd.choice([1, 2, 3, 40, 60, 200]))} | {"hot"} for u in range(50)}
    sets["all"] = {f"i{j}" for j in range(250)}
    got = found(top_k_sparse(frame(spark, sets), "user", "item", 3, "jaccard", 0.1))
    assert {u: [v for v, _ in r] for u, r in got.items()} == \
        {u: [v for v, _ in r] for u, r in brute_topk(sets, 3, "jaccard", 0.1).items() if r}


def test_index_leaves_out_each_sets_most_frequent_items(spark):
    sets = {f"u{u}": {"hot", "warm" if u % 2 else "cool", *[f"own{u}-{j}" for j in range(8)]} for u in range(20)}
    index = prefix_index(frame(spark, sets).distinct().toDF("entity", "item"), 0.1)
    kept = {r["item"] for r in index.collect()}
    assert "hot" not in kept and {"warm", "cool"} <= kept and index.count() == 20 * 9
    # nobody shares more than two of ten: no pair of prefixes is even counted above the bound
    assert top_k_sparse(frame(spark, sets), "user", "item", 3, "jaccard", 0.12).collect() == []


def test_pairs_are_counted_where_they_are_made_and_long_lists_are_dealt(spark, monkeypatch, capsys):
    monkeypatch.setattr(PI, "LIST", 4)
    rnd = random.Random(5)
    sets = {f"u{u:02d}": {f"i{rnd.randrange(30)}" for _ in range(rnd.randrange(1, 9))} | {"hot"} for u in range(30)}
    for threshold in (0.03, 0.3):
        got = found(top_k_sparse(frame(spark, sets), "user", "item", 4, "jaccard", threshold))
        assert {u: [v for v, _ in r] for u, r in got.items()} == \
            {u: [v for v, _ in r] for u, r in brute_topk(sets, 4, "jaccard", threshold).items() if r}
    coded = frame(spark, sets).distinct().selectExpr("cast(1 as bigint) * 4294967296 + cast(substr(user, 2) as bigint) entity", "item")
    lists = PI.holder_lists(coded).collect()
    assert max(len(r.holders) for r in lists) == 4 and sum(r["item"] == "hot" for r in lists) == 8
    PI.shared_in_prefixes(coded, 0.0).explain()
    plan = capsys.readouterr().out
    # nothing is shuffled between the making of the pairs and their count
    assert "Exchange" not in plan[:plan.index("Generate explode(after")]
