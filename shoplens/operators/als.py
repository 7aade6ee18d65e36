"""Matrix-factorisation recommender on MLlib ALS (REC1, REC2, JN5, REC4c).

ALS needs integer ids.  Instead of ``StringIndexer`` (whose fitted model holds
every label on the driver) the ids are indexed by a distributed global sort
into index tables, which are checkpointed to the shared checkpoint folder and
kept with the model (the reference kept *unfitted* indexers, so its decode
step could never run).  Decoding item indices back to product ids (JN5) is a
join with the item index table.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.recommendation import ALS, ALSModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplens import constants as C
from shoplens.functions.scalars import als_confidence, round_half_up
from shoplens.operators.sequence import with_global_sequence
from shoplens.operators.similarity import top_k_cosine_vectors
from shoplens.session import release_shuffles, scratch_path, stored


@dataclass
class AlsResult:
    model: ALSModel
    user_index: DataFrame           # (user key, user_idx)
    item_index: DataFrame           # (item key, item_idx)
    predictions: DataFrame          # holdout rows with their prediction
    user_col: str
    item_col: str


def id_index(df: DataFrame, col: str, name: str) -> DataFrame:
    """Dense 0-based int index of the distinct values of ``col`` (any order:
    ALS only needs distinct ints, so no sort; the numbering is fixed by the
    sequence's checkpoint)."""
    d = df.select(F.col(col).cast("string").alias(col)).where(F.col(col).isNotNull()).distinct()
    return with_global_sequence(d, None, "_seq").select(col, (F.col("_seq") - 1).cast("int").alias(name))


def train(ratings: DataFrame, user_col: str = "user_id", item_col: str = "asin",
          rating_col: str = "rating", implicit: bool = False, rank: int = C.ALS_RANK,
          max_iter: int = C.ALS_MAX_ITER, reg_param: float = C.ALS_REG_PARAM,
          seed: int = C.ALS_SEED, train_fraction: float = C.ALS_TRAIN_FRACTION) -> AlsResult:
    """REC1: index ids, split train/holdout (seeded), fit ALS (cold-start rows
    dropped at prediction time)."""
    r = ratings.select(F.col(user_col).cast("string").alias(user_col),
                       F.col(item_col).cast("string").alias(item_col),
                       F.col(rating_col).cast("float").alias("rating"))
    # read by both id indexes and by the join: computed once
    r = stored(r, "als-ratings")
    ui = id_index(r, user_col, "user_idx")
    ii = id_index(r, item_col, "item_idx")
    # the indexed ratings are read by the split, every ALS pass and the holdout
    # scoring: stored once in the shared checkpoint folder
    idx = stored(r.join(ui, user_col).join(ii, item_col).select("user_idx", "item_idx", "rating"), "als-indexed")
    tr, te = idx.randomSplit([train_fraction, 1 - train_fraction], seed=seed)
    als = ALS(rank=rank, maxIter=max_iter, regParam=reg_param, userCol="user_idx", itemCol="item_idx",
              ratingCol="rating", coldStartStrategy="drop", implicitPrefs=implicit, seed=seed,
              checkpointInterval=1)  # the factors that an iteration shuffles are dropped when the next has ended
    model = als.fit(tr)
    if scores(model) > FITTED_SCORES:
        # fitted factors hold on to the shuffles of all ratings: a large model is written and read back
        path = scratch_path(r.sparkSession, f"als-model-{uuid.uuid4().hex}")
        model.write().save(path)
        model = ALSModel.load(path)
    release_shuffles(r.sparkSession)
    return AlsResult(model, ui, ii, model.transform(te), user_col, item_col)


def scores(model: ALSModel) -> int:
    """Users times items of the model."""
    return model.userFactors.count() * model.itemFactors.count()


def rmse(result: AlsResult) -> DataFrame:
    """Holdout RMSE and the RMSE of predicting the holdout mean (a baseline any
    useful model should beat), as a one-row DataFrame."""
    p = stored(result.predictions.select("rating", "prediction"), "als-predicted")  # read twice
    mean = p.select(F.avg("rating")).scalar()
    return p.agg(F.sqrt(F.avg((F.col("rating") - F.col("prediction")) ** 2)).alias("rmse"),
                 F.sqrt(F.avg((F.col("rating") - mean) ** 2)).alias("baseline_rmse"),
                 F.count(F.lit(1)).alias("holdout_rows"))


def rmse_value(result: AlsResult) -> float:
    """The same RMSE through MLlib's evaluator (used by tests as a cross-check)."""
    ev = RegressionEvaluator(metricName="rmse", labelCol="rating", predictionCol="prediction")
    return ev.evaluate(result.predictions)


BLOCK_FACTORS = 524_288   # user factors a task holds at most
CHUNK_FACTORS = 128       # factors of items that travel as one row
SPAN_FACTORS = 262_144    # factors of items a task scores in one go
TILE_USERS, TILE_ITEMS = 32, 8192     # scores in memory at once
PRODUCT_SCORES = 10_000_000   # users times items up to which ``auto`` leaves the scores to MLlib's product
FITTED_SCORES = PRODUCT_SCORES   # a larger model is read back from its files
PACKED = pa.schema([("block", pa.int32()), ("reach", pa.float64()), ("ids", pa.binary()), ("vectors", pa.binary())])
SCORED = pa.schema([("user_idx", pa.int32()), ("rank", pa.int32()), ("item_idx", pa.int32()), ("rating", pa.float32())])


def _lengths(vectors: np.ndarray) -> np.ndarray:
    return np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))


class _Best:
    """The n items of largest dot product per user (ties: smaller id) of all items met so far."""

    def __init__(self, users: np.ndarray, n: int):
        self.users = users
        # a computed product is off by far less than this part of the lengths' product
        self.reach = _lengths(users) * (1 + 1e-5)
        self.best = np.full((len(users), n), -np.inf, np.float32)
        self.ids = np.full((len(users), n), np.iinfo(np.int32).max, np.int32)

    def meet(self, item_ids: np.ndarray, items: np.ndarray) -> None:
        """``TILE_USERS`` users after the other.  Items come by falling length, so a user is done when
        its length times an item's cannot reach the user's n-th best score any more."""
        length = _lengths(items)
        by = np.argsort(-length, kind="stable")
        item_ids, length, across = item_ids[by], length[by], np.ascontiguousarray(items[by].T)
        keep = self.best.shape[1]
        for at in range(0, len(self.users), TILE_USERS):
            mine, far = self.users[at:at + TILE_USERS], self.reach[at:at + TILE_USERS]
            best, ids = self.best[at:at + TILE_USERS], self.ids[at:at + TILE_USERS]
            for start in range(0, len(item_ids), TILE_ITEMS):
                live = np.flatnonzero(far * length[start] >= best[:, -1])
                if not len(live):
                    break
                tile = (mine if len(live) == len(mine) else mine[live]) @ across[:, start:start + TILE_ITEMS]
                least = best[live, -1]
                if start == 0 and keep < tile.shape[1]:  # only what reaches the tile's n-th best is sorted
                    least = np.maximum(least, np.partition(tile, tile.shape[1] - keep, axis=1)[:, tile.shape[1] - keep])
                for r in np.flatnonzero(tile.max(axis=1) >= least):
                    found = np.flatnonzero(tile[r] >= least[r])
                    s = np.concatenate([best[live[r]], tile[r, found]])
                    i = np.concatenate([ids[live[r]], item_ids[start + found]])
                    first = np.lexsort((i, -s))[:keep]
                    best[live[r]], ids[live[r]] = s[first], i[first]


def _block_top(user_ids: np.ndarray, users: np.ndarray, item_ids: np.ndarray, items: np.ndarray, n: int):
    """The n best items of each user: (user ids, item ids, scores) of ``TILE_USERS`` users after the other."""
    top = _Best(users, min(n, len(item_ids)))
    top.meet(item_ids, items)
    for at in range(0, len(users), TILE_USERS):
        ids = top.ids[at:at + TILE_USERS]
        yield np.repeat(user_ids[at:at + TILE_USERS], ids.shape[1]), ids.ravel(), top.best[at:at + TILE_USERS].ravel()


def _vectors(b: pa.RecordBatch) -> np.ndarray:
    rows = b.column("features")
    return rows.flatten().to_numpy().reshape(len(rows), -1)


def _packed(blocks: list, reach: list, ids: list, vectors: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        pa.array(blocks, pa.int32()), pa.array(reach, pa.float64()), pa.array([x.astype(np.int32).tobytes() for x in ids], pa.binary()),
        pa.array([x.astype(np.float32).tobytes() for x in vectors], pa.binary())], schema=PACKED)


def _block_keys(spark, blocks: int) -> list[int]:
    """A number for each block such that ``repartition(blocks, number)`` gives each a partition of its own."""
    place = F.pmod(F.hash(F.col("id").cast("int")), F.lit(blocks))
    rows = spark.range(64 * blocks).groupBy(place.alias("at")).agg(F.min("id").alias("id")).collect()  # a row for each block
    found = {r["at"]: r["id"] for r in rows}
    return [found.get(b, 64 * blocks + b) for b in range(blocks)]


def score_blocks(users: DataFrame, items: DataFrame, n: int, block: int = BLOCK_FACTORS) -> DataFrame:
    """Top-n items per user by factor dot product over every item: (user_idx, rank, item_idx, rating).

    A task holds a block of users and their n best so far; all items, packed in chunks, pass
    by it from the longest vector down, so only users times n rows leave the tasks, and what
    is shuffled is the items times the number of blocks.
    """
    spark, n_users = users.sparkSession, users.count()
    blocks = max(1, math.ceil(n_users / block), min(2 * spark.sparkContext.defaultParallelism, math.ceil(n_users / TILE_USERS)))
    keys = np.array(_block_keys(spark, blocks))

    def user_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, vectors, of = b.column("id").to_numpy(), _vectors(b), b.column("block").to_numpy()
            found = np.unique(of)
            yield _packed(keys[found], [np.inf] * len(found), [ids[of == x] for x in found], [vectors[of == x] for x in found])

    def item_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, vectors = b.column("id").to_numpy(), _vectors(b)
            length = _lengths(vectors)
            by = np.argsort(-length, kind="stable")
            cut = [by[i:i + CHUNK_FACTORS] for i in range(0, len(by), CHUNK_FACTORS)]
            yield _packed([0] * len(cut), [length[x[0]] for x in cut], [ids[x] for x in cut], [vectors[x] for x in cut])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, user_ids, mine, ids, vectors, held = None, [], [], [], [], 0

        def whole(parts: list, rows: int, kind) -> np.ndarray:
            return np.frombuffer(b"".join(parts), kind).reshape(rows, -1)

        for b in batches:
            for reach, i, v in zip(*(b.column(c).to_pylist() for c in ("reach", "ids", "vectors"))):
                if reach == np.inf:  # the users come first
                    user_ids.append(i)
                    mine.append(v)
                    continue
                ids.append(i)
                vectors.append(v)
                held += len(i) // 4
                if held >= SPAN_FACTORS and mine:
                    top = top or _Best(whole(mine, sum(map(len, user_ids)) // 4, np.float32), n)
                    top.meet(whole(ids, held, np.int32)[:, 0], whole(vectors, held, np.float32))
                    ids, vectors, held = [], [], 0
        if not mine or not (held or top):
            return
        every = np.frombuffer(b"".join(user_ids), np.int32)
        top = top or _Best(whole(mine, len(every), np.float32), n)
        if held:
            top.meet(whole(ids, held, np.int32)[:, 0], whole(vectors, held, np.float32))
        for at in range(0, len(every), 10_000):
            best, chosen = top.best[at:at + 10_000], top.ids[at:at + 10_000]
            found = best > -np.inf  # fewer items than n: the rest of a row is empty
            r, c = np.nonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (
                every[at + r], (c + 1).astype(np.int32), chosen[found], best[found])], schema=SCORED)

    shape = "block int, reach double, ids binary, vectors binary"
    a = users.select("id", "features", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block")).mapInArrow(user_chunks, shape)
    b = (items.select("id", "features").mapInArrow(item_chunks, shape)
         .withColumn("block", F.explode(F.array(*[F.lit(int(k)) for k in keys]))).select(*PACKED.names))
    # a block is few bytes and much work: as many partitions as blocks, which adaptive execution, that counts bytes, does
    # not put together
    dealt = a.unionByName(b).repartition(blocks, "block").sortWithinPartitions("block", F.desc("reach"))
    top = dealt.groupBy("block").applyInArrow(kernel, "user_idx int, rank int, item_idx int, rating float")
    return top.select("user_idx", "rank", "item_idx", F.col("rating").cast("double").alias("rating"))


def recommend(result: AlsResult, users: DataFrame, n: int, dimension: DataFrame | None = None,
              product_col: str = "product_id", method: str = "auto") -> DataFrame:
    """REC2 + JN5 (+ JN4): top-n for the given users (any number of them),
    decoded to product ids; rating and confidence (rating / 5) to 2 places.

    Scores are factor dot products over every item: ``product`` by MLlib's own
    ``recommendForUserSubset``, ``blocks`` by ``score_blocks`` (the same scores,
    many users and items), ``auto`` by the first up to ``PRODUCT_SCORES`` scores
    of the model, by the second beyond.
    """
    if method not in ("auto", "product", "blocks"):
        raise ValueError("method must be auto, product or blocks")
    if method == "auto":
        method = "product" if scores(result.model) <= PRODUCT_SCORES else "blocks"
    uc = result.user_col
    u = users.select(F.col(uc).cast("string").alias(uc)).distinct().join(result.user_index, uc)
    if method == "blocks":
        u = u.checkpoint(eager=True)  # read by the count, by the scores and by the decoding
        served = result.model.userFactors.join(u.select(F.col("user_idx").alias("id")), "id", "left_semi")
        flat = score_blocks(served, result.model.itemFactors, n)
    else:
        top = result.model.recommendForUserSubset(u.select("user_idx"), n)
        flat = (top.select("user_idx", F.posexplode("recommendations").alias("pos", "r"))
                .select("user_idx", (F.col("pos") + 1).alias("rank"), F.col("r.item_idx").alias("item_idx"),
                        F.col("r.rating").cast("double").alias("rating")))
    items = result.item_index.withColumnRenamed(result.item_col, product_col)
    about = []
    if dimension is not None:  # joined to the items, of which there are fewer than recommendations
        about = ["title", "category", "price"]
        items = items.join(dimension.select(product_col, *about), product_col, "left")
    out = (flat.join(u, "user_idx").join(items, "item_idx")
           .select(uc, "rank", product_col,
                   round_half_up(F.col("rating"), 2).alias("predicted_rating"),
                   als_confidence(F.col("rating")).alias("confidence"),
                   F.lit("als").alias("source"), *about))
    return out.select(product_col, *[c for c in out.columns if c != product_col]) if about else out


def similar_items(result: AlsResult, k: int = 10, product_col: str = "product_id") -> DataFrame:
    """REC4c: exact cosine top-k over the learned item factors."""
    sims = top_k_cosine_vectors(result.model.itemFactors, "id", "features", k)
    items = result.item_index.withColumnRenamed(result.item_col, product_col)
    a = items.withColumnRenamed("item_idx", "id")
    b = items.withColumnsRenamed({"item_idx": "neighbour_id", product_col: "similar_" + product_col})
    return (sims.join(a, "id").join(b, "neighbour_id")
            .select(product_col, "similar_" + product_col,
                    F.col("similarity").alias("similarity_score"), "rank"))
