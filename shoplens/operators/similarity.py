"""Exact all-pairs top-k set similarity (Jaccard or cosine) without pair explosion.

The classic Spark form -- self-join the (entity, item) table on ``item`` and
count per pair -- emits every pair of entities that share an item, so a
popular item shared by n entities alone produces n^2 rows.  Here:

1. Entities are put into ``nb`` blocks (from the entity count, the row count
   and the number of cores, so that block pairs keep every core busy and hold
   few rows each): by hash, or -- for Jaccard with a threshold t -- in set-size
   order, so that the exact length filter (J > t needs the smaller set to
   exceed t times the larger) limits each block to a contiguous range of
   partner blocks.  Each entity's items, gathered into one list (several where
   block pairs are split), are replicated once per partner block with
   ``explode(sequence(...))`` -- no join.  Each list carries its entity's set size.
2. A block pair whose rows fit the row budget is one ``applyInArrow`` group:
   intersection sizes are counted with numpy (dense matrix products for items
   many entities of the pair share, a bounded sparse expansion for the rest)
   and only each entity's local top-k (similarity desc, neighbour asc, above
   the threshold) leaves the task.
3. A heavier block pair -- e.g. one holding a hot entity with a third of all
   rows -- is split further by item hash into ``parts`` groups, so no task
   holds more than about the budget.  Each part emits partial intersection
   counts of its entity pairs; they are summed per pair by an aggregate and
   turned into similarities there.
4. A final ``row_number() <= k`` per entity over the candidates gives the
   exact global top-k (the global top-k under a total order is contained in
   the union of the local top-k under the same order).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoplens.session import ensure_checkpoint_dir

DEFAULT_BLOCK_ENTITIES = 4096      # entities per block
DEFAULT_GROUP_ROWS = 500_000       # rows one kernel task may hold before a block pair is split
HOT_ITEM_PAIRS = 4096              # items with more member pairs than this use the dense path
DENSE_CHUNK = 1024                 # hot items per dense matrix product
FEW_ENTITIES = 1024                # up to so many entities are one block
LEAST_ROWS = 20_000                # rows a part of one block has at least
TILE_ROWS = 256                    # entities whose counts are in memory at once, against a whole block
TILE_PAIRS = 1_000_000             # member pairs expanded at once in the sparse path

OUT_SCHEMA = ("entity string, neighbour string, similarity double, common long, "
              "size_a long, size_b long")
OUT_ARROW = pa.schema([("entity", pa.string()), ("neighbour", pa.string()), ("similarity", pa.float64()),
                       ("common", pa.int64()), ("size_a", pa.int64()), ("size_b", pa.int64())])


def _similarity(common, size_a, size_b, measure: str):
    """Similarity from intersection and set sizes (numpy or Spark columns)."""
    if measure == "jaccard":
        return common / (size_a + size_b - common)
    if isinstance(common, np.ndarray):
        return common / np.sqrt(size_a.astype(np.float64) * size_b)
    return common / F.sqrt(size_a * size_b)


class _Side:
    """The entities of a block in id order, their sizes, and the rows (entity code, item code) by entity;
    ``counts`` items follow one another for each ``entity`` of the input."""

    def __init__(self, entity: pa.Array, counts: np.ndarray, items: np.ndarray, sizes: np.ndarray):
        coded = entity.dictionary_encode()
        order = pc.sort_indices(coded.dictionary).to_numpy()
        self.names = coded.dictionary.take(pa.array(order))
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        codes = place[coded.indices.to_numpy()]
        self.sizes = np.zeros(len(order), dtype=np.int64)
        self.sizes[codes] = sizes
        codes = np.repeat(codes, counts)
        by = np.argsort(codes, kind="stable")
        self.codes, self.items = codes[by], items[by]


def _intersections(a: _Side, b: _Side, n_items: int):
    """Intersection sizes of ``TILE_ROWS`` entities of ``a`` after the other with all of ``b``:
    (first entity, counts as floats that hold them exactly)."""
    exact = np.float32 if n_items < 2 ** 24 else np.float64
    na, nb = len(a.names), len(b.names)
    hot = np.bincount(a.items, minlength=n_items) * np.bincount(b.items, minlength=n_items) > HOT_ITEM_PAIRS
    pos = np.cumsum(hot) - 1
    n_hot = int(hot.sum())
    b_hot = hot[b.items]
    bhc, bhp = b.codes[b_hot], pos[b.items[b_hot]]

    def dense_b(start):
        m = np.zeros((nb, min(DENSE_CHUNK, n_hot - start)), dtype=np.float32)
        sel = (bhp >= start) & (bhp < start + DENSE_CHUNK)
        m[bhc[sel], bhp[sel] - start] = 1.0
        return m

    kept = dense_b(0) if 0 < n_hot <= DENSE_CHUNK else None
    order = np.argsort(b.items[~b_hot], kind="stable")
    bi, be = b.items[~b_hot][order], b.codes[~b_hot][order]
    for first in range(0, na, TILE_ROWS):
        rows = min(TILE_ROWS, na - first)
        lo, hi = np.searchsorted(a.codes, (first, first + rows))
        codes, items = a.codes[lo:hi] - first, a.items[lo:hi]
        common = np.zeros((rows, nb), dtype=exact)
        a_hot = hot[items]
        ahc, ahp = codes[a_hot], pos[items[a_hot]]
        for start in range(0, n_hot, DENSE_CHUNK):  # items that many entities of both sides share
            mb = dense_b(start) if kept is None else kept
            ma = np.zeros((rows, mb.shape[1]), dtype=np.float32)
            sel = (ahp >= start) & (ahp < start + DENSE_CHUNK)
            ma[ahc[sel], ahp[sel] - start] = 1.0
            common += ma @ mb.T
        ai, ae = items[~a_hot], codes[~a_hot]  # any other item has at most HOT_ITEM_PAIRS member pairs
        begin = np.searchsorted(bi, ai, side="left")
        cnt = np.searchsorted(bi, ai, side="right") - begin
        ends = np.cumsum(cnt)
        at = 0
        while at < len(ai):
            done = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + TILE_PAIRS, side="right")))
            c = cnt[at:to]
            total = int(c.sum())
            if total:
                offs = np.arange(total) - np.repeat(np.cumsum(c) - c, c) + np.repeat(begin[at:to], c)
                common += np.bincount(np.repeat(ae[at:to], c) * nb + be[offs], minlength=rows * nb).reshape(rows, nb).astype(exact)
            at = to
        yield first, common


def _block_pair(batches, k: int, measure: str, threshold: float):
    """The rows of two blocks (or of an item part of them) -> each entity's local top k, or
    partial counts.  Counts are made tile by tile, so memory follows the rows and a tile,
    never the number of pairs."""
    t = pa.Table.from_batches(batches).combine_chunks()
    lo, hi, parts = (t.column(c)[0].as_py() for c in ("lo", "hi", "parts"))
    blk, sizes = t.column("blk").to_numpy(), t.column("n").to_numpy()
    entity, item = t.column("entity").combine_chunks(), t.column("item").combine_chunks()
    del t
    # a row holds one item or a list of them
    lists = pa.types.is_list(item.type)
    counts = pc.list_value_length(item).to_numpy().astype(np.int64) if lists else np.ones(len(item), dtype=np.int64)
    coded = (item.flatten() if lists else item).dictionary_encode()
    items, n_items = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
    del coded, item
    sides = []
    for block in (lo,) if lo == hi else (lo, hi):
        m = blk == block
        sides.append(_Side(entity.filter(pa.array(m)), counts[m], items[np.repeat(m, counts)], sizes[m]))
    del entity, items, blk, sizes, counts
    for a, b in ((sides[0], sides[-1]),) if lo == hi else ((sides[0], sides[1]), (sides[1], sides[0])):
        if not len(a.names) or not len(b.names):
            return
        for first, common in _intersections(a, b, n_items):
            if lo == hi:
                common[np.arange(len(common)), first + np.arange(len(common))] = 0
            a_sizes = a.sizes[first:first + len(common)]
            if parts > 1:  # partial counts over one item part: summed per pair downstream
                r, c = np.nonzero(common)
                sim = np.zeros(len(r))
            else:          # codes follow sorted ids, so code order is the id tie-break order
                r, c, sim = _set_topk(common, a_sizes, b.sizes, k, measure, threshold)
            for i in range(0, len(r), 100_000):
                x, y = r[i:i + 100_000], c[i:i + 100_000]
                yield pa.RecordBatch.from_arrays([
                    a.names.take(pa.array(first + x)), b.names.take(pa.array(y)), pa.array(sim[i:i + 100_000]),
                    pa.array(common[x, y].astype(np.int64)), pa.array(a_sizes[x]), pa.array(b.sizes[y])], schema=OUT_ARROW)


def top_k_similar(pairs: DataFrame, entity: str, item: str, k: int, measure: str = "jaccard",
                  threshold: float = 0.0, block_entities: int = DEFAULT_BLOCK_ENTITIES,
                  group_rows: int = DEFAULT_GROUP_ROWS) -> DataFrame:
    """Top-``k`` most similar entities per entity by their item sets.

    Returns (entity, neighbour_<entity>, similarity, common, rank) with rank
    1..k, ordered by similarity desc then neighbour asc; only pairs with
    similarity > ``threshold`` and at least one common item qualify.
    """
    if measure not in ("jaccard", "cosine"):
        raise ValueError("measure must be 'jaccard' or 'cosine'")
    sets = (pairs.select(F.col(entity).cast("string").alias("entity"),
                         F.col(item).cast("string").alias("item"))
            .where(F.col("entity").isNotNull() & F.col("item").isNotNull()).distinct())
    sizes = sets.groupBy("entity").agg(F.count(F.lit(1)).alias("n"))
    spark = pairs.sparkSession
    total = sizes.agg(F.count(F.lit(1)).alias("entities"), F.sum("n").alias("rows")).first()
    n_entities = total["entities"]
    n_rows, cores = total["rows"] or 0, spark.sparkContext.defaultParallelism
    if n_entities <= min(block_entities, FEW_ENTITIES):
        # few entities with many items each: one block, split by items; nothing is replicated
        # and the partial counts are few
        nb, group_rows = 1, min(group_rows, max(LEAST_ROWS, math.ceil(n_rows / (4 * cores))))
    else:
        nb = max(math.ceil(n_entities / block_entities), math.ceil(2 * n_rows / group_rows),
                 min(n_entities, math.ceil(math.sqrt(4 * cores))))
    block_entities = max(1, math.ceil(n_entities / nb))
    if measure == "jaccard" and threshold > 0 and nb > 1:
        # length filter (exact): J(a, b) > t needs min(|a|,|b|) > t * max(|a|,|b|).
        # Blocks follow set size, and each block meets only the contiguous range
        # of blocks whose sizes can qualify.
        from shoplens.operators.sequence import with_global_sequence
        ordered = with_global_sequence(sizes, ["n", "entity"], "pos")
        blocks = ordered.select("entity", "n", F.floor((F.col("pos") - 1) / F.lit(block_entities))
                                .cast("int").alias("blk"))
        # per-block size range: nb rows (bounded by the block count)
        stats = sorted((r["blk"], r["lo_n"], r["hi_n"]) for r in blocks.groupBy("blk").agg(
            F.min("n").alias("lo_n"), F.max("n").alias("hi_n")).collect())
        lo_n = np.array([x[1] for x in stats], dtype=np.float64)
        hi_n = np.array([x[2] for x in stats], dtype=np.float64)
        first = np.searchsorted(hi_n, threshold * lo_n, side="right")   # max_n(j) > t * min_n(i)
        last = np.searchsorted(lo_n, hi_n / threshold, side="left") - 1  # min_n(j) < max_n(i) / t
        ranges = spark.createDataFrame(
            [(int(b), int(min(f, b)), int(max(l_, b))) for (b, _, _), f, l_ in zip(stats, first, last)],
            "blk int, p_first int, p_last int")
        rows = sets.join(blocks, "entity")
    else:
        rows = (sets.join(sizes, "entity")
                .withColumn("blk", F.pmod(F.xxhash64("entity"), F.lit(nb)).cast("int")))
        ranges = spark.createDataFrame([(b, 0, nb - 1) for b in range(nb)], "blk int, p_first int, p_last int")
    # the (entity, item, size, block) table is read by the per-block count and
    # by the replication: materialise it once in the shared checkpoint folder
    ensure_checkpoint_dir(spark)
    staged = rows.join(F.broadcast(ranges), "blk").persist(StorageLevel.MEMORY_AND_DISK)
    rows = staged.checkpoint(eager=True)
    staged.unpersist()
    # rows per block: exactly nb rows, broadcast to size every block pair; a
    # pair is split into as many item parts as its rows need
    per_block = rows.groupBy("blk").agg(F.count(F.lit(1)).alias("blk_rows"))
    most = sum(r["blk_rows"] for r in per_block.orderBy(F.desc("blk_rows")).limit(2).collect())
    # items travel as one list per entity and item class; a part is a set of classes (one class
    # if no pair is split, else four a part), so a list is a quarter of a part at most
    classes = 1 if most <= group_rows else 4 * math.ceil(most / group_rows)
    lists = (rows.groupBy("entity", "blk", "n", "p_first", "p_last", F.pmod(F.xxhash64("item"), F.lit(classes)).alias("class"))
             .agg(F.collect_list("item").alias("item")))
    per_block = F.broadcast(per_block)
    partner_rows = per_block.withColumnsRenamed({"blk": "partner", "blk_rows": "partner_rows"})
    rep = (lists.withColumn("partner", F.explode(F.sequence("p_first", "p_last")))
           .join(per_block, "blk").join(partner_rows, "partner")
           .withColumn("parts", F.greatest(F.lit(1), F.ceil(
               (F.col("blk_rows") + F.when(F.col("partner") != F.col("blk"), F.col("partner_rows"))
                .otherwise(F.lit(0))) / F.lit(float(group_rows)))).cast("int"))
           .withColumn("lo", F.least("blk", "partner")).withColumn("hi", F.greatest("blk", "partner"))
           .withColumn("ip", F.pmod(F.col("class"), F.col("parts")).cast("int"))
           .drop("partner", "blk_rows", "partner_rows", "p_first", "p_last", "class"))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _block_pair(batches, k, measure, threshold)

    # dealt by entity once: the sum per pair and the rank need no other exchange
    local = rep.groupBy("lo", "hi", "ip").applyInArrow(kernel, OUT_SCHEMA).repartition("entity")
    # one pass over the kernel output: a pair from an unsplit block pair arrives
    # once (already above the threshold and among the local top-k); a pair from
    # a split block pair arrives once per item part and is summed here
    pairs_out = (local.groupBy("entity", "neighbour")
                 .agg(F.sum("common").alias("common"), F.first("size_a").alias("size_a"),
                      F.first("size_b").alias("size_b"))
                 .withColumn("similarity", _similarity(F.col("common"), F.col("size_a"),
                                                       F.col("size_b"), measure))
                 .where(F.col("similarity") > threshold)
                 .select("entity", "neighbour", "similarity", "common"))
    w = Window.partitionBy("entity").orderBy(F.desc("similarity"), F.asc("neighbour"))
    return (pairs_out.withColumn("rank", F.row_number().over(w))
            .where(F.col("rank") <= k)
            .withColumnsRenamed({"entity": entity, "neighbour": "neighbour_" + entity}))


def _dense_row_topk(scores: np.ndarray, valid: np.ndarray, col_ids: np.ndarray, k: int):
    """Top-k entries per row of a dense score matrix among ``valid`` cells,
    ordered by score desc then column id asc.  Returns (rows, cols, scores).

    A row is cut into disjoint groups of cells: the k-th largest of the groups'
    maxima is at most the row's k-th best score, and only the cells at or above it
    (few more than k, apart from ties) are sorted.
    """
    n_rows, n_cols = scores.shape
    if n_rows == 0 or n_cols == 0:
        e = np.array([], dtype=np.int64)
        return e, e, np.array([], dtype=np.float64)
    masked = np.where(valid, scores, -np.inf)
    kk = min(k, n_cols)
    groups = n_cols // 32
    tops = masked[:, :32 * groups].reshape(n_rows, 32, groups).max(axis=1) if groups > 4 * kk else masked
    kth = np.partition(tops, tops.shape[1] - kk, axis=1)[:, tops.shape[1] - kk]
    cand = valid & (masked >= kth[:, None])
    r, c = np.nonzero(cand)
    s = scores[r, c]
    order = np.lexsort((col_ids[c], -s, r))
    r, c, s = r[order], c[order], s[order]
    first = np.r_[True, r[1:] != r[:-1]] if len(r) else np.array([], dtype=bool)
    start = np.maximum.accumulate(np.where(first, np.arange(len(r)), 0)) if len(r) else r
    keep = (np.arange(len(r)) - start) < k
    return r[keep], c[keep], s[keep]


NEAR = np.float32(4e-6)  # a similarity in single precision is off by far less


def _set_topk(common: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, k: int, measure: str, threshold: float):
    """Top-k entries per row by similarity, above the threshold (ties: lower column): (rows, cols, similarities).

    All cells are compared in single precision; the few that may be among a row's k best
    are computed again in double precision, which decides.
    """
    n_rows, n_cols = common.shape
    x, y = size_a.astype(np.float32)[:, None], size_b.astype(np.float32)[None, :]
    if measure == "jaccard":
        near = x + y
        near -= common
        np.divide(common, near, out=near)
    else:
        near = np.multiply(common, 1 / np.sqrt(x), dtype=np.float32)
        near *= 1 / np.sqrt(y)
    kk = min(k, n_cols)
    groups = n_cols // 32
    tops = near[:, :32 * groups].reshape(n_rows, 32, groups).max(axis=1) if groups > 4 * kk else near
    kth = np.partition(tops, tops.shape[1] - kk, axis=1)[:, tops.shape[1] - kk]
    least = np.maximum(np.maximum(kth, np.float32(threshold)) - NEAR, np.float32(1e-30))
    r, c = np.divmod(np.flatnonzero(near >= least[:, None]), n_cols)
    n = common[r, c].astype(np.float64)
    s = _similarity(n, size_a[r], size_b[c], measure)
    above = (n > 0) & (s > threshold)
    r, c, s = r[above], c[above], s[above]
    order = np.lexsort((c, -s, r))
    r, c, s = r[order], c[order], s[order]
    keep = np.arange(len(r)) - np.searchsorted(r, r, side="left") < k
    return r[keep], c[keep], s[keep]


VEC_SCHEMA = "entity long, neighbour long, similarity double"


VEC_ARROW = pa.schema([("entity", pa.int64()), ("neighbour", pa.int64()), ("similarity", pa.float64())])


def _unit_vectors(t: pa.Table):
    """Ids ascending, unit vectors (zero if there is no direction) and whether there is one."""
    t = t.sort_by("entity")
    rows = t.column("vec").combine_chunks()
    if len(pc.unique(pc.list_value_length(rows))) > 1:
        raise ValueError("vectors must have the same length")
    m = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1) if len(rows) else np.zeros((0, 1))
    norms = np.sqrt((m * m).sum(axis=1))
    with np.errstate(divide="ignore", invalid="ignore"):
        return t.column("entity").to_numpy(), np.where(norms[:, None] > 0, m / norms[:, None], 0.0), norms > 0


def _local_topk_vectors(batches, k: int, digits: int):
    t = pa.Table.from_batches(batches)
    lo, hi = t.column("lo")[0].as_py(), t.column("hi")[0].as_py()
    sides = [_unit_vectors(t.filter(pc.equal(t.column("blk"), b))) for b in ((lo,) if lo == hi else (lo, hi))]
    del t
    scale = 10.0 ** digits
    for (ida, ua, oka), (idb, ub, okb) in ((sides[0], sides[-1]),) if lo == hi else ((sides[0], sides[1]), (sides[1], sides[0])):
        if len(ida) == 0 or len(idb) == 0:
            return
        for first in range(0, len(ida), TILE_ROWS):
            sim = ua[first:first + TILE_ROWS] @ ub.T
            sim *= scale
            sim += 0.5
            np.floor(sim, out=sim)
            sim /= scale
            valid = oka[first:first + TILE_ROWS, None] & okb[None, :]
            if lo == hi:
                valid[np.arange(len(sim)), first + np.arange(len(sim))] = False
            r, c, sv = _dense_row_topk(sim, valid, idb, k)
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64(), from_pandas=True) for x in (ida[first + r], idb[c])), pa.array(sv)], schema=VEC_ARROW)


def top_k_cosine_vectors(vectors: DataFrame, id_col: str, vec_col: str, k: int, digits: int = 6,
                         block_entities: int = 8192) -> DataFrame:
    """Exact top-k cosine neighbours of dense vectors (ids must be integers).

    Same block-pair scheme as ``top_k_similar``: the vectors of two blocks
    meet in one task, the similarity block is one matrix product, only local
    top-k rows leave the task.  Similarity is rounded to ``digits`` places
    before ranking (ties: neighbour id).  Zero vectors have no neighbours.
    """
    # floats travel as floats and become doubles in the task
    held = "array<float>" if vectors.schema[vec_col].dataType.simpleString() == "array<float>" else "array<double>"
    v = vectors.select(F.col(id_col).cast("long").alias("entity"),
                       F.col(vec_col).cast(held).alias("vec")).where(F.col("vec").isNotNull())
    n = v.count()
    nb = max(1, math.ceil(n / block_entities),
             min(n, math.ceil(math.sqrt(4 * vectors.sparkSession.sparkContext.defaultParallelism))))
    rep = (v.withColumn("blk", F.pmod(F.xxhash64("entity"), F.lit(nb)).cast("int"))
           .withColumn("partner", F.explode(F.sequence(F.lit(0), F.lit(nb - 1))))
           .withColumn("lo", F.least("blk", "partner")).withColumn("hi", F.greatest("blk", "partner"))
           .drop("partner"))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _local_topk_vectors(batches, k, digits)

    local = rep.groupBy("lo", "hi").applyInArrow(kernel, VEC_SCHEMA)
    w = Window.partitionBy("entity").orderBy(F.desc("similarity"), F.asc("neighbour"))
    return (local.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .withColumnsRenamed({"entity": id_col, "neighbour": "neighbour_" + id_col}))
