"""What the block kernel shuffles: an entity's items as lists, not as a row each."""

import contextlib
import io
import random

import numpy as np
import pyarrow as pa

from shoplens.operators.similarity import top_k_similar
from tests.test_kernels import brute_topk


def test_items_are_replicated_as_lists(spark):
    df = spark.createDataFrame([(f"u{u}", f"i{i}") for u in range(30) for i in range(u % 7 + 1)], "user string, item string")
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        top_k_similar(df, "user", "item", 3, "jaccard", 0.1, block_entities=6).explain()
    plan = buf.getvalue()
    assert "collect_list(item" in plan[plan.index("FlatMapGroupsInArrow"):]


def test_lists_and_split_pairs_equal_brute_force(spark):
    # one entity holds most rows, so some block pairs are split into many parts and others into none
    rnd = random.Random(13)
    sets = {f"u{u:02d}": {f"i{rnd.randrange(80)}" for _ in range(rnd.randrange(1, 9))} for u in range(40)}
    sets["hot"] = {f"i{j}" for j in range(400)}
    rows = [(u, i) for u, its in sets.items() for i in its]
    rows += rows[:50] + [("u01", None), (None, "i1")]
    df = spark.createDataFrame(rows, "user string, item string")
    for measure, threshold, group_rows in (("jaccard", 0.1, 30), ("cosine", 0.0, 70), ("cosine", 0.0, 100_000)):
        got = {}
        for r in top_k_similar(df, "user", "item", 4, measure, threshold, block_entities=5, group_rows=group_rows) \
                .orderBy("user", "rank").collect():
            got.setdefault(r.user, []).append(r.neighbour_user)
        expected = brute_topk(sets, 4, measure, threshold)
        assert got == {u: [v for v, _ in e] for u, e in expected.items() if e}, (measure, group_rows)


def test_cells_are_compared_in_single_and_decided_in_double_precision():
    """Similarities that single precision cannot tell apart still come in their exact order."""
    from shoplens.operators import similarity as S

    rng = np.random.default_rng(4)
    for measure in ("jaccard", "cosine"):
        for n_cols, k, threshold in ((300, 5, 0.1), (40, 5, 0.0), (3, 5, 0.2), (700, 3, 0.5)):
            a, b = rng.integers(90_000, 90_009, 20), rng.integers(90_000, 90_009, n_cols)
            common = rng.integers(60_000, 60_006, (20, n_cols)) * (rng.random((20, n_cols)) < 0.9)
            common[0] = 0
            got = {}
            for r, c, s in zip(*(x.tolist() for x in S._set_topk(common.astype(np.float32), a, b, k, measure, threshold))):
                got.setdefault(r, []).append((-s, c))
            want = {}
            for r in range(20):
                sims = [(-float(S._similarity(common[r, c:c + 1].astype(float), a[r:r + 1], b[c:c + 1], measure)[0]), c)
                        for c in range(n_cols) if common[r, c]]
                if best := sorted(x for x in sims if -x[0] > threshold)[:k]:
                    want[r] = best
            assert got == want
    side = S._Side(pa.array(["a", "b"]), np.array([2, 1]), np.array([0, 1, 1]), np.array([2, 1]))
    (_, counts), = S._intersections(side, side, 2)
    assert counts.dtype == np.float32 and counts.tolist() == [[2, 1], [1, 1]]
    assert next(S._intersections(side, side, 2**24))[1].dtype == np.float64
