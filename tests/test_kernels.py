"""Distributed kernels against brute force on small random inputs."""

import math
import random

from shoplens.operators.sequence import with_global_sequence
from shoplens.operators.similarity import top_k_cosine_vectors, top_k_similar


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


def test_top_k_similar_many_blocks_and_hot_items(spark):
    rnd = random.Random(7)
    sets = {}
    for u in range(60):
        items = {f"i{rnd.randrange(40)}" for _ in range(rnd.randrange(1, 12))}
        items.add("hot")                       # one item shared by everybody
        sets[f"u{u:02d}"] = items
    rows = [(u, i) for u, its in sets.items() for i in its]
    df = spark.createDataFrame(rows, "user string, item string")
    for measure, thr, group_rows in (("jaccard", 0.1, 4_000_000), ("cosine", 0.0, 4_000_000),
                                     ("jaccard", 0.1, 60), ("cosine", 0.0, 60)):
        # group_rows=60 forces every block pair to be split by item hash
        got = top_k_similar(df, "user", "item", 4, measure, thr, block_entities=7, group_rows=group_rows)
        res = {}
        for r in got.orderBy("user", "rank").collect():
            res.setdefault(r.user, []).append((r.neighbour_user, r.similarity))
        exp = brute_topk(sets, 4, measure, thr)
        for u in sets:
            assert [v for v, _ in res.get(u, [])] == [v for v, _ in exp[u]], (measure, group_rows, u)
            for (_, a), (_, b) in zip(res.get(u, []), exp[u]):
                assert abs(a - b) < 1e-12


def test_length_filter_blocks_by_size(spark):
    # very different set sizes: small users never meet the big ones, results stay exact
    rnd = random.Random(11)
    sets = {}
    for u in range(50):
        size = rnd.choice([1, 2, 3, 40, 60, 200])
        sets[f"u{u:02d}"] = {f"i{rnd.randrange(250)}" for _ in range(size)} | {"hot"}
    rows = [(u, i) for u, its in sets.items() for i in its]
    df = spark.createDataFrame(rows, "user string, item string")
    got = top_k_similar(df, "user", "item", 3, "jaccard", 0.1, block_entities=6, group_rows=80)
    res = {}
    for r in got.orderBy("user", "rank").collect():
        res.setdefault(r.user, []).append(r.neighbour_user)
    exp = brute_topk(sets, 3, "jaccard", 0.1)
    assert res == {u: [v for v, _ in exp[u]] for u in exp if exp[u]}


def test_hot_entity_is_split(spark):
    # one user holds far more rows than the group budget: its block pairs are split
    rows = [("hot", f"i{j}") for j in range(300)] + [(f"u{u}", f"i{(u * 7 + j) % 300}")
                                                       for u in range(20) for j in range(5)]
    df = spark.createDataFrame(rows, "user string, item string")
    got = top_k_similar(df, "user", "item", 3, "cosine", 0.0, block_entities=5, group_rows=50)
    sets = {}
    for u, i in rows:
        sets.setdefault(u, set()).add(i)
    exp = brute_topk(sets, 3, "cosine", 0.0)
    res = {}
    for r in got.orderBy("user", "rank").collect():
        res.setdefault(r.user, []).append(r.neighbour_user)
    assert res == {u: [v for v, _ in exp[u]] for u in exp if exp[u]}


def test_cosine_vectors_brute_force(spark):
    rnd = random.Random(3)
    vecs = {i: [rnd.uniform(-1, 1) for _ in range(5)] for i in range(40)}
    vecs[40] = [0.0] * 5                       # zero vector: no neighbours
    df = spark.createDataFrame(list(vecs.items()), "id long, v array<double>")
    got = top_k_cosine_vectors(df, "id", "v", 3, digits=9, block_entities=6)
    res = {}
    for r in got.orderBy("id", "rank").collect():
        res.setdefault(r.id, []).append(r.neighbour_id)

    def cos(a, b):
        return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))

    for i in range(40):
        c = sorted(((-math.floor(cos(vecs[i], vecs[j]) * 1e9 + 0.5) / 1e9, j) for j in range(40) if j != i))
        assert res[i] == [j for _, j in c[:3]]
    assert 40 not in res


def test_global_sequence_matches_row_number(spark):
    rnd = random.Random(1)
    rows = [(rnd.randrange(50), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "a long, b long").repartition(13)
    got = with_global_sequence(df, ["a", "b"], "seq").collect()
    exp = {key: n + 1 for n, key in enumerate(sorted(rows))}
    assert len(got) == len(rows)
    assert all(exp[(r.a, r.b)] == r.seq for r in got)


def test_a_block_pairs_memory_does_not_follow_the_pairs():
    import tracemalloc

    import pyarrow as pa

    from shoplens.operators.similarity import _block_pair
    peaks = []
    for n in (1500, 4500):
        rows = [(f"u{u:04d}", f"i{(u * 7 + j * j) % 90}") for u in range(n) for j in range(5)]
        size = {}
        for u, _ in set(rows):
            size[u] = size.get(u, 0) + 1
        rows = sorted(set(rows))
        batch = pa.RecordBatch.from_pydict({
            "lo": [0] * len(rows), "hi": [0] * len(rows), "parts": [1] * len(rows), "blk": [0] * len(rows),
            "entity": [u for u, _ in rows], "item": [i for _, i in rows], "n": [size[u] for u, _ in rows]})
        tracemalloc.start()
        found = sum(b.num_rows for b in _block_pair(iter([batch]), 5, "jaccard", 0.1))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert found == 5 * n
    assert peaks[1] < 4 * peaks[0] and peaks[1] < 100e6  # n x n doubles alone would be nine times as much, 162 MB


def test_float_vectors_travel_as_floats(spark, capsys):
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(9)], "id long, v array<float>")
    top_k_cosine_vectors(v, "id", "v", 3).explain()
    assert "array<double>" not in capsys.readouterr().out
