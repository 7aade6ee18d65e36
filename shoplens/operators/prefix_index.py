"""Exact top-k similarity of sparse sets by a prefix-filtered inverted index.

For sets that few others overlap with (shoppers by the products they bought), where
``similarity.top_k_similar`` would still compare every block of entities with
every other.  On dense sets (most pairs overlap) that block kernel is the cheaper
one; the caller chooses (``recommend.user_neighbours(method=...)``).

Jaccard above a threshold t.  The items are put in one order, the rarest
first, and every set is sorted by it.  Two sets above t share more than t times
the larger set's size, so their first n - floor(t n) items (the prefixes) have one
in common: only prefixes are indexed, which leaves out each set's most frequent
items.  The count of the items two prefixes share is the intersection up to the end
of the shorter prefix; what can still follow is at most the larger number of items
left out.  This bounds every pair's similarity from both sides.  A pair is verified
on the whole sets only where its upper bound reaches the k-th largest lower bound of
its entity; the exact top k follows by ``row_number() <= k``.

Below ``PREFIX_FROM`` (and for cosine) a prefix is nearly the whole set: it saves few
counts, and every pair that shares two items would have to be verified.  There the
index holds all items, the counts are the intersections themselves and nothing is
left to verify.

Entities are counted as numbers: the set size above the place in id order, so that a
pair's sizes and the order of ties travel with it.  An item's holders are sorted
and stored as lists of at most ``LIST`` numbers.  A holder takes the holders after
it from the list, one row for all of them; these rows are dealt by entity, and the
pairs are made and counted where they have arrived.  No pair is shuffled before it
is counted.  Two lists of one item meet as rows of their own, so a frequent item is
many tasks' work.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoplens.operators.sequence import with_global_sequence
from shoplens.session import scratch_path

PREFIX_FROM = 0.2       # thresholds from which on prefixes are indexed
LIST = 1024             # holders in one list of an item
TASK_PAIRS = 2_000_000  # pairs one counting task makes, about


def _similarity(common, n_a, n_b, measure: str):
    """Similarity from intersection and set sizes."""
    if measure == "jaccard":
        return common / (n_a + n_b - common)
    return common / F.sqrt(n_a * n_b)


def _left_out(n, threshold: float):
    """Items of a set of ``n`` beyond its prefix: the most it can share without
    passing the threshold, by the same division that gives the similarity."""
    if threshold <= 0:
        return F.lit(0)
    most = F.floor(n * F.lit(threshold)) + 1
    return F.greatest(F.lit(0), F.when(most / n <= threshold, most).when((most - 1) / n <= threshold, most - 1).otherwise(most - 2))


def prefix_index(sets: DataFrame, threshold: float) -> DataFrame:
    """(entity, item, n): the prefix of every set, with the set's size."""
    by = Window.partitionBy("entity")
    frequency = sets.groupBy("item").agg(F.count(F.lit(1)).alias("f"))
    ranked = sets.join(frequency, "item").withColumns({
        "pos": F.row_number().over(by.orderBy("f", "item")), "n": F.count(F.lit(1)).over(by)})
    return ranked.where(F.col("pos") <= F.col("n") - _left_out(F.col("n"), threshold)) \
        .select("entity", "item", "n")


def _size(code):
    """Set size of an entity's number."""
    return F.shiftright(code, 32)


def _stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written below the shared checkpoint folder and read back (compressed, unlike a checkpoint)."""
    path = f"{scratch_path(df.sparkSession, name)}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def holder_lists(index: DataFrame) -> DataFrame:
    """(item, place, places, holders): every item's holders in ascending order, in lists of at most ``LIST``."""
    by = Window.partitionBy("item")
    return (index.withColumn("place", F.floor((F.row_number().over(by.orderBy("entity")) - 1) / F.lit(LIST)).cast("int"))
            .groupBy("item", "place").agg(F.sort_array(F.collect_list("entity")).alias("holders"))
            .withColumn("places", F.count(F.lit(1)).over(by).cast("int")))


def shared_in_prefixes(index: DataFrame, threshold: float) -> DataFrame:
    """(a, b, shared) for every two entities (numbers, a < b) whose indexed items meet and whose sizes can qualify."""
    lists = _stored(holder_lists(index), "holders")
    n = F.size("holders").cast("double")
    pairs = lists.agg(F.sum(n * (n - 1) / 2 + n * LIST * (F.col("places") - F.col("place") - 1))).first()[0] or 0
    spread = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(spread, math.ceil(pairs / TASK_PAIRS))
    own = lists.select("holders", F.posexplode("holders").alias("at", "a")) \
        .select("a", F.slice("holders", F.col("at") + 2, F.size("holders")).alias("after"))
    long = lists.where("places > 1")
    first = long.where("place < places - 1").select("item", F.col("place").alias("lo"), "holders", F.explode(F.sequence(
        F.col("place") + 1, F.col("places") - 1)).alias("hi"))
    second = long.where("place > 0").select("item", F.col("place").alias("hi"), F.col("holders").alias("after"), F.explode(
        F.sequence(F.lit(0), F.col("place") - 1)).alias("lo"))
    across = first.join(second, ["item", "lo", "hi"]).select(F.explode("holders").alias("a"), "after")
    met = own.where(F.size("after") > 0).unionByName(across).repartition(parts, "a")
    return (met.select("a", F.explode("after").alias("b"))
            .where(_size("a") > _size("b") * F.lit(threshold) - F.lit(1e-9))
            .groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared")))


def _mirrored(half: DataFrame) -> DataFrame:
    """Every pair in both directions."""
    ends = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    return half.withColumn("_ends", ends).select("_ends.a", "_ends.b", *[c for c in half.columns if c not in ("a", "b")])


def top_k_sparse(pairs: DataFrame, entity: str, item: str, k: int, measure: str = "jaccard",
                  threshold: float = 0.0) -> DataFrame:
    """Top-``k`` most similar entities per entity by their item sets.

    Returns (entity, neighbour_<entity>, similarity, common, rank) with rank
    1..k, ordered by similarity desc then neighbour asc; only pairs with
    similarity > ``threshold`` and at least one common item qualify.  A threshold
    above zero needs the Jaccard measure.
    """
    if measure not in ("jaccard", "cosine"):
        raise ValueError("measure must be 'jaccard' or 'cosine'")
    if threshold > 0 and measure != "jaccard":
        raise ValueError("a threshold above zero needs the jaccard measure")
    # read by the sizes and by the numbering
    named = _stored(pairs.select(F.col(entity).cast("string").alias("entity"), F.col(item).cast("string").alias("item"))
                    .where(F.col("entity").isNotNull() & F.col("item").isNotNull()).distinct(), "sets")
    sizes = named.groupBy("entity").agg(F.count(F.lit(1)).alias("n"))
    names = _stored(with_global_sequence(sizes, ["entity"], "at").select(
        "entity", (F.shiftleft(F.col("n"), 32) + F.col("at")).alias("code")), "names")
    sets = named.join(names, "entity").select(F.col("code").alias("entity"), "item")
    if threshold >= PREFIX_FROM:
        sets = _stored(sets, "coded")  # read by the frequencies, the index and the verification
        half = _verified(shared_in_prefixes(prefix_index(sets, threshold), threshold), sets, k, threshold)
    else:
        half = shared_in_prefixes(sets, threshold)
    found = half.withColumn("similarity", _similarity(F.col("shared"), _size("a"), _size("b"), measure)) \
        .where(F.col("similarity") > threshold)
    place = F.col("b").bitwiseAND(F.lit(0xFFFFFFFF))  # in id order
    w = Window.partitionBy("a").orderBy(F.desc("similarity"), place)
    top = _mirrored(found).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return (top.join(names.select(F.col("code").alias("a"), F.col("entity").alias(entity)), "a")
            .join(names.select(F.col("code").alias("b"), F.col("entity").alias("neighbour_" + entity)), "b")
            .select(entity, "neighbour_" + entity, "similarity",
                    F.col("shared").cast("int" if threshold > 0 else "long").alias("common"), "rank"))


def _verified(half: DataFrame, sets: DataFrame, k: int, threshold: float) -> DataFrame:
    """The pairs that can be among the top k of one of their entities, with their whole intersections."""
    n_a, n_b = _size("a"), _size("b")
    rest = F.greatest(_left_out(n_a, threshold), _left_out(n_b, threshold))
    most = F.least(F.col("shared") + rest, n_a, n_b)
    bounded = _stored(half.withColumns({"low": _similarity(F.col("shared"), n_a, n_b, "jaccard"),
                                        "high": _similarity(most, n_a, n_b, "jaccard")})
                      .where(F.col("high") > threshold).select("a", "b", "low", "high"), "bounded")
    w = Window.partitionBy("a").orderBy(F.desc("low"))
    bar = _mirrored(bounded).withColumn("place", F.row_number().over(w)).where(F.col("place") <= k) \
        .where(F.col("place") == k).select("a", F.col("low").alias("bar"))
    open_ = bounded.join(bar, "a", "left").join(bar.toDF("b", "bar_b"), "b", "left") \
        .where(F.col("high") >= F.least(F.coalesce("bar", F.lit(0.0)), F.coalesce("bar_b", F.lit(0.0))))
    whole = sets.groupBy("entity").agg(F.collect_list("item").alias("items"))
    return (open_.join(whole.select(F.col("entity").alias("a"), F.col("items").alias("items_a")), "a")
            .join(whole.select(F.col("entity").alias("b"), F.col("items").alias("items_b")), "b")
            .select("a", "b", F.size(F.array_intersect("items_a", "items_b")).cast("long").alias("shared")))
