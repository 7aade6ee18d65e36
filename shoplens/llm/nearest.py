"""Approximate nearest neighbours with balanced posting lists.

Index: centroids are fitted on a bounded sample by k-means with a size penalty
that keeps the lists balanced; their number follows the table (one per
``list_size`` vectors, at most ``max_centroids``).  The centroids stay in
memory with a graph of near and a few far links, which is searched best-first
from fixed entries.  Every vector of the table goes to the list of its nearest
centroid and, near a boundary, to further lists whose centroid is at most
(1 + ``replicate``) times as far, ``REPLICAS`` in all at most.  (Leaving out
lists that lie behind a chosen one, as is usual for clustered data, left
vectors without structure in one list and lost a quarter of the neighbours.)

Search: a query visits all lists whose centroids lie within (1 + ``prune``)
times the distance of its nearest one, however many these are: a limit on their
number would search a smaller share of the table the larger the table is.  Where
that nearest list is home to ``k`` rows or fewer, the distance is that of the
first list, from near to far, by which all together are home to more than ``k``:
every row has one home, so no query ends with fewer than ``k`` rows.
Blocks of about ``QUERIES`` queries are broadcast; a task goes through its rows
list by list and keeps the nearest of every query that reaches the list, and a
window merges what the tasks found.  Candidates are compared in double
precision on the original vectors.

Lists with many vectors (a vector repeated often) are dealt in chunks of about
``CHUNK`` rows.

Defined results: vectors that are null, zero, of another length than most, or
hold a null or non-finite component take no part, nor do rows without an id;
rows with the same id count once; a query gets ``k`` rows, or all others if the
table has fewer; equal distances go to the smaller id.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoplens.llm.common import batch_of, map_batches, stored

SAMPLE = 50_000
LIST_SIZE = 256
MAX_CENTROIDS = 16_384
ROUNDS = 12
BALANCE = 0.05
LINKS = 24
FAR_LINKS = 8
ENTRIES = 16
EXPAND = 4
REPLICAS = 6
CHUNK = 4096
BATCH = 512
PAIRS = 65_536
QUERIES = 200_000


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all rows of c."""
    d = (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None]
    return np.maximum(d, 0)


def fit_centroids(x: np.ndarray, k: int, seed: int = 7) -> np.ndarray:
    """K-means; a row's cost for a centroid grows with the centroid's share of rows so far."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    load = np.ones(k)
    for _ in range(ROUNDS):
        own = np.empty(len(x), np.int64)
        spread = 0.0
        for a in range(0, len(x), 4096):
            d = squares(x[a:a + 4096], c)
            spread += d.min(1).sum()
            own[a:a + 4096] = (d + BALANCE * d.min(1, keepdims=True) * load).argmin(1)
        count = np.bincount(own, minlength=k)
        load = count / max(1.0, len(x) / k)
        order = np.argsort(own, kind="stable")
        sums = np.add.reduceat(x[order], np.minimum(np.cumsum(count) - count, len(x) - 1), axis=0)
        c = np.where((count > 0)[:, None], sums / np.maximum(count, 1)[:, None], c)
        empty = np.flatnonzero(count == 0)
        if len(empty):  # an empty list restarts at a row of the largest ones
            big = np.argsort(-count, kind="stable")[:len(empty)]
            for e, b in zip(empty, big, strict=False):
                c[e] = x[rng.choice(np.flatnonzero(own == b))] if count[b] else x[rng.integers(len(x))]
    return c


class Index:
    """Centroids and the graph over them."""

    def __init__(self, centroids: np.ndarray, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.c = centroids.astype(np.float64)
        k = len(self.c)
        near = min(LINKS, k - 1)
        links = np.zeros((k, near), np.int64)
        for a in range(0, k, 1024):
            d = squares(self.c[a:a + 1024], self.c)
            d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
            links[a:a + 1024] = np.argsort(d, axis=1, kind="stable")[:, :near]
        far = rng.integers(0, k, (k, FAR_LINKS))
        self.links = np.concatenate([links, far], axis=1)
        self.entries = rng.choice(k, min(ENTRIES, k), replace=False)
        self.norms = (self.c * self.c).sum(1)

    def search(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Centroids near each row, nearest first: numbers (-1: none) and distances."""
        n, k = len(x), len(self.c)
        beam = min(beam, k)
        rows = np.arange(n)[:, None]
        seen = np.zeros((n, k), bool)
        ids = np.full((n, beam), -1)
        dist = np.full((n, beam), np.inf)
        done = np.ones((n, beam), bool)
        own = (x * x).sum(1)[:, None]
        new = np.broadcast_to(self.entries, (n, len(self.entries)))
        while True:
            # a link may name a centroid twice or one seen before: those count as infinitely far
            new = np.sort(new, axis=1)
            fresh = ~seen[rows, new]
            fresh[:, 1:] &= new[:, 1:] != new[:, :-1]
            seen[rows, new] = True
            d = np.where(fresh, own - 2 * np.einsum("nd,nmd->nm", x, self.c[new]) + self.norms[new], np.inf)
            all_d = np.concatenate([dist, d], axis=1)
            all_i = np.concatenate([ids, np.where(fresh, new, -1)], axis=1)
            all_e = np.concatenate([done, ~fresh], axis=1)
            order = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
            dist, ids, done = all_d[rows, order], all_i[rows, order], all_e[rows, order]
            if done.all():
                return ids, np.sqrt(np.maximum(dist, 0))
            next_at = np.argsort(done, axis=1, kind="stable")[:, :EXPAND]
            pick = np.where(done[rows, next_at], -1, ids[rows, next_at])
            done[rows, next_at] = True
            new = self.links[np.maximum(pick, 0)].reshape(n, -1)

    def lists_of(self, x: np.ndarray, replicate: float) -> list[np.ndarray]:
        """The lists each row belongs to."""
        ids, dist = self.search(x, 8 * REPLICAS)
        return [i[:REPLICAS][(d[:REPLICAS] <= (1 + replicate) * d[0]) & (i[:REPLICAS] >= 0)]
                for i, d in zip(ids, dist, strict=True)]

    def reach_of(self, x: np.ndarray, prune: float, homes: np.ndarray, need: int) -> np.ndarray:
        """How far each query's lists may be: (1 + ``prune``) times the distance up to which
        the lists are the nearest ones of ``need`` rows (``homes``: these rows by list) or of all."""
        out = np.zeros(len(x))
        for a in range(0, len(x), BATCH):
            d = squares(x[a:a + BATCH], self.c)
            at = d.argmin(1)
            far = d[np.arange(len(d)), at]
            few = np.flatnonzero(homes[at] < need)
            for b in range(0, len(few), 64):
                part = few[b:b + 64]
                order = np.argsort(d[part], axis=1, kind="stable")
                held = np.cumsum(homes[order], axis=1)
                last = np.minimum((held < need).sum(1), len(self.c) - 1)
                far[part] = d[part, order[np.arange(len(part)), last]]
            out[a:a + BATCH] = (1 + prune) * np.sqrt(far)
        return out


def usable(table: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec) of the rows that take part; vec keeps its type if that is float or double."""
    vec = F.col(vec_col)
    if table.schema[vec_col].dataType.simpleString() not in ("array<float>", "array<double>"):
        vec = vec.cast("array<double>")
    t = table.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec"))
    fine = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    t = t.filter(F.col("id").isNotNull() & F.col("vec").isNotNull() & fine & F.exists("vec", lambda v: v != 0))
    sizes = t.groupBy(F.size("vec").alias("s")).count().orderBy(F.desc("count"), "s").limit(1).collect()
    return t.filter(F.size("vec") == (sizes[0]["s"] if sizes else 0)).dropDuplicates(["id"])


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def listed(table: DataFrame, index, place) -> DataFrame:
    """Rows (list, home, id, vec): each vector once per list that ``place`` names, the first is its home."""
    kind = table.schema["vec"].dataType.simpleString()
    schema = pa.schema([("list", pa.int32()), ("home", pa.bool_()), ("id", pa.int64()),
                        ("vec", pa.list_(pa.float32() if kind == "array<float>" else pa.float64()))])

    def fn(batches):
        for b in batches:
            for a in range(0, b.num_rows, BATCH):
                part = b.slice(a, BATCH)
                at = place(index.value, matrix(part.column(1)))
                sizes = np.array([len(x) for x in at])
                take = pa.array(np.repeat(np.arange(len(at)), sizes))
                home = np.zeros(sizes.sum(), bool)
                home[np.cumsum(sizes) - sizes] = True
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(at), pa.int32()), pa.array(home), part.column(0).take(take),
                     part.column(1).take(take).cast(schema.types[3])], schema=schema)

    return map_batches(table.select("id", "vec"), fn, f"list int, home boolean, id long, vec {kind}")


class Best:
    """The k nearest rows seen so far of every query."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int):
        self.ids, self.q, self.k = ids, q, k
        self.norms = (q * q).sum(1)
        self.score = np.full((len(q), k), np.inf)
        self.found = np.full((len(q), k), -1, np.int64)

    def take(self, ask: np.ndarray, ids: np.ndarray, v: np.ndarray) -> None:
        """Compares the queries ``ask`` with rows in ascending order of their ids."""
        # of equal vectors only the first k + 1 can be among a query's nearest, itself left out
        _, same = np.unique(np.ascontiguousarray(v + 0.0).view(np.dtype((np.void, v.shape[1] * 8))).ravel(),
                            return_inverse=True)
        order = np.argsort(same, kind="stable")
        first = np.searchsorted(same[order], same[order])
        keep = np.sort(order[np.arange(len(order)) - first <= self.k])
        ids, v = ids[keep], v[keep]
        norms = (v * v).sum(1)
        for a in range(0, len(ask), BATCH):
            at = ask[a:a + BATCH]
            rough = self.norms[at][:, None] + norms - 2 * (self.q[at] @ v.T)
            slack = 1e-10 * (self.norms[at] + norms.max())
            border = self.score[at, -1] ** 2 + slack
            if len(v) > self.k + 1:  # the nearest k of these rows besides the query itself bound it too
                border = np.minimum(border, np.partition(rough, self.k, axis=1)[:, self.k] + 2 * slack)
            i, j = np.nonzero(rough <= border[:, None])
            i = at[i]
            other = self.ids[i] != ids[j]
            i, j = i[other], j[other]
            if len(i):
                d = np.concatenate([np.sqrt(((v[j[s:s + PAIRS]] - self.q[i[s:s + PAIRS]]) ** 2).sum(1))
                                    for s in range(0, len(i), PAIRS)])
                self.merge(i, ids[j], d)

    def merge(self, i: np.ndarray, ids: np.ndarray, d: np.ndarray) -> None:
        who = np.unique(i)
        i = np.concatenate([np.repeat(who, self.k), i])
        ids, d = np.concatenate([self.found[who].ravel(), ids]), np.concatenate([self.score[who].ravel(), d])
        order = np.lexsort((ids, d, i))
        order = order[d[order] < np.inf]
        i, ids, d = i[order], ids[order], d[order]
        # a row stands in several lists, always at the same distance
        new = np.append(True, (i[1:] != i[:-1]) | (ids[1:] != ids[:-1]))[:len(i)]
        i, ids, d = i[new], ids[new], d[new]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        top = place < self.k
        self.found[i[top], place[top]], self.score[i[top], place[top]] = ids[top], d[top]


def searcher(index, sent, k: int):
    """Compares rows (list, id, vec), list by list, with the queries that reach the list."""
    schema = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])

    def fn(batches):
        ids, q, reach = sent.value
        best, centroids = Best(ids, q, k), index.value.c
        for b in batches:
            lists, rows = b.column(0).to_numpy(), b.column(1).to_numpy()
            for a in range(0, len(lists), CHUNK):
                v = matrix(b.column(2).slice(a, CHUNK))
                part, row = lists[a:a + CHUNK], rows[a:a + CHUNK]
                for one in np.unique(part):
                    # the slack is more than rounding, so that a query's nearest list is always within its reach
                    c = centroids[one]
                    ask = np.flatnonzero(squares(c[None], q)[0] <= reach ** 2 + 1e-12 * (best.norms + c @ c))
                    at = np.flatnonzero(part == one)
                    at = at[np.argsort(row[at], kind="stable")]
                    if len(ask):
                        best.take(ask, row[at], v[at])
        i, j = np.nonzero(best.score < np.inf)
        for a in range(0, len(i), 65_536):
            x, y = i[a:a + 65_536], j[a:a + 65_536]
            yield batch_of(schema, [ids[x], best.found[x, y], best.score[x, y]])

    return fn


def nearest(table: DataFrame, queries, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding",
            list_size: int = LIST_SIZE, replicate: float = 0.15, prune: float = 0.35) -> DataFrame:
    """query_id, rank, ``id_col``, score: the k nearest found for the rows that ``queries``
    (a condition on the column ``id``) selects, against all rows."""
    spark = table.sparkSession
    rows = stored(usable(table, id_col, vec_col), "vectors")
    n = rows.count()
    take = F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < min(1_000_000, round(1e6 * SAMPLE / max(1, n)))
    sample = rows.filter(take).orderBy("id").select("vec").toPandas()["vec"]  # about SAMPLE vectors at most
    out = "query_id long, rank int, id long, score double"
    if len(sample) == 0:
        return spark.createDataFrame([], out).withColumnRenamed("id", id_col)
    x = np.stack(sample.to_numpy()).astype(np.float64)
    lists = int(min(max(1, n // list_size), MAX_CENTROIDS, max(1, len(np.unique(x, axis=0)) // 4)))
    index = spark.sparkContext.broadcast(Index(fit_centroids(x, lists)))
    postings = stored(listed(rows, index, lambda i, v: i.lists_of(v, replicate)), "postings")
    # one row per list, at most MAX_CENTROIDS
    homes = np.zeros(lists, np.int64)
    for r in postings.groupBy("list").agg(F.sum(F.col("home").cast("long")).alias("n")).collect():
        homes[r["list"]] = r["n"]
    chunks = F.broadcast(postings.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks")))
    laid = postings.join(chunks, "list") \
        .withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks").cast("long")).cast("int")) \
        .repartition("list", "chunk").sortWithinPartitions("list", "chunk", "id").select("list", "id", "vec")
    asked = rows.filter(queries).select("id", "vec")
    blocks = -(-asked.count() // QUERIES)
    if blocks > 1:
        laid, asked = stored(laid, "laid"), stored(asked, "asked")
    found = []
    for block in range(blocks):
        part = asked.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).orderBy("id").toPandas()  # about QUERIES rows
        if len(part):
            q = np.stack(part["vec"].to_numpy()).astype(np.float64)
            sent = spark.sparkContext.broadcast((part["id"].to_numpy(), q, index.value.reach_of(q, prune, homes, k + 1)))
            found.append(laid.mapInArrow(searcher(index, sent, k), "query_id long, id long, score double"))
    if not found:
        return spark.createDataFrame([], out).withColumnRenamed("id", id_col)
    near = reduce(DataFrame.unionAll, found).distinct()
    best = Window.partitionBy("query_id").orderBy("score", "id")
    return near.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k) \
        .select("query_id", "rank", F.col("id").alias(id_col), "score")
