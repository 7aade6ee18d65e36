"""Near-duplicates by bottom-k sketches from one hash function.

A document's set holds the hashes of its distinct five-word shingles.

1. The ``K`` smallest hash values of a set are its sketch: one hash function,
   no bands.  Equal sets are one class; its smallest document stands for it.
2. Retained values are inverted into lists.  A list is keyed by a run of
   ``RUN`` values that follow each other in the sketch, so that a passage which
   many documents share does not by itself make a long list.  Two sets whose
   similarity is 0.85 share such a run but for a probability below 1e-9, and
   always when both sets are kept whole: at most 15 % of their union is not
   shared, so that some stretch of the sorted union has RUN shared neighbours.
3. Pairs come from the lists in two steps.  First every member is paired with
   the smallest member of its list, which takes one pair per entry however
   large a group of copies is.  Then only lists that still hold members of
   different components are open (of several lists with the same members, the
   first).  A list of at most ``SHORT`` members gives its remaining pairs as
   rows.  A longer one is dealt in blocks of ``BLOCK`` members to pairs of
   blocks; a task holds the members' sets once and compares the members of
   different components in memory, each pair only in the first list that holds
   both, and returns nothing but links that join components.
4. A pair must pass the size bound (the smaller set is at least 85 % of the
   larger), then the estimate from the union sketch (the K smallest values of
   both sketches together, the share of them in both; the margin below the
   threshold is wide enough to lose no pair but for a probability below 1e-6),
   then the exact similarity of the full sets, computed from the texts.  In the
   blocks the sketches hold ``BIG`` values; sets no larger are whole there, and
   their similarity is exact at once.
5. Components grow along the confirmed links, by smallest labels with pointer
   jumping, in tables that stay distributed.

Defined results: a document without words has an empty set and is linked with
nothing; with one to four words the whole sequence is its one shingle; rows
without an id get a set size, no component, and are kept; repeated rows give
repeated results.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoplens.llm.common import batch_of, map_batches, stored

K = 48
RUN = 3
SHINGLE = 5
MARGIN = 0.30
SHORT = 16
BLOCK = 2048
BIG = 512
BIG_MARGIN = 0.08  # five standard deviations of the estimate from BIG values
MEMORY_WORDS = 500_000
LEAST_PERCENT = 85  # RUN and the margins keep a link's chance of being missed negligible from here on
MIX = [0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F]


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= MEMORY_WORDS:
                self.clear()
            self[word] = h
        return h


HASHES = WordHashes()


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` words; the whole sequence if shorter."""
    words = text.encode().lower().split() if text else []  # bytes: only A-Z change, only ASCII blanks split
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(HASHES.__getitem__, words), np.uint64, n)
    k = min(size, n)
    s = np.full(n - k + 1, k, np.uint64)
    for j in range(k):
        s = (s ^ h[j:n - k + 1 + j]) * np.uint64(MIX[j % len(MIX)])
        s ^= s >> np.uint64(31)
    s *= np.uint64(MIX[1])
    s ^= s >> np.uint64(29)
    return np.unique(s >> np.uint64(1))  # 63 bits: the order is the same for signed integers


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, t (hash of the text), n (set size), fp (of the whole set), sketch (K smallest values)."""
    schema = pa.schema([("id", pa.int64()), ("t", pa.int64()), ("n", pa.int64()), ("fp", pa.binary()),
                        ("sketch", pa.list_(pa.int64()))])

    def fn(batches):
        for b in batches:
            sets = [shingle_set(t) for t in b.column(2).to_pylist()]
            fps = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            kept = [s[:K].view(np.int64) for s in sets]
            flat = np.concatenate(kept) if kept else np.zeros(0, np.int64)
            at = np.cumsum([0, *map(len, kept)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(fps, pa.binary()),
                 pa.ListArray.from_arrays(pa.array(at), pa.array(flat))], schema=schema)

    return map_batches(keyed_texts(docs, id_col, text_col), fn,
                       "id long, t long, n long, fp binary, sketch array<long>")


def keyed_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("t"),
                       F.col(text_col).alias("text"))


def runs(sketch: Column) -> Column:
    """Runs of RUN neighbouring values: their key and place in the order of values."""
    return F.transform(F.sequence(F.lit(0), F.size(sketch) - RUN), lambda i: F.struct(
        F.xxhash64(*[F.get(sketch, i + j) for j in range(RUN)]).alias("key"), F.get(sketch, i).alias("v")))


def similar_size(a: Column, b: Column, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def by_estimate(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose union sketch does not rule them out."""
    left = classes.select(F.col("rep").alias("a"), F.col("sketch").alias("sa"), F.col("t").alias("ta"))
    right = classes.select(F.col("rep").alias("b"), F.col("sketch").alias("sb"), F.col("t").alias("tb"))
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, K)
    joint = pairs.hint("merge").join(left, "a").hint("merge").join(right, "b").withColumn("u", union)
    shared = F.size(F.array_intersect(F.array_intersect("sa", "sb"), "u"))
    return joint.filter(shared >= (percent / 100 - MARGIN) * F.size("u")).select("a", "ta", "b", "tb")


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Links (a, b): pairs whose full sets reach the similarity."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def fn(batches):
        last, held = None, None
        for batch in batches:
            out = []
            a, b, ta, tb = (batch.column(k).to_pylist() for k in range(4))
            for i, j, x, y in zip(a, b, ta, tb, strict=True):
                if i != last:
                    last, held = i, shingle_set(x)
                other = shingle_set(y)
                both = len(np.intersect1d(held, other, assume_unique=True))
                if 100 * both >= percent * (len(held) + len(other) - both):
                    out.append((i, j))
            yield batch_of(schema, list(zip(*out)) if out else [[], []])

    left = texts.select(F.col("id").alias("a"), F.col("t").alias("ta"), F.col("text").alias("xa"))
    right = texts.select(F.col("id").alias("b"), F.col("t").alias("tb"), F.col("text").alias("xb"))
    joint = pairs.hint("merge").join(right, ["b", "tb"]).hint("merge").join(left, ["a", "ta"]) \
        .select("a", "b", "xa", "xb")
    return map_batches(joint, fn, "a long, b long")


def in_blocks(entries: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, ta, b, tb, sure) of different components in long lists; sure: compared on whole sets."""
    schema = pa.schema([("id", pa.int64()), ("t", pa.int64()), ("set", pa.binary())])

    big, margin = BIG, BIG_MARGIN

    def sets_of(batches):
        for b in batches:
            yield batch_of(schema, [b.column(0), b.column(1),
                                    [shingle_set(x)[:big].tobytes() for x in b.column(2).to_pylist()]])

    need = entries.select(F.col("rep").alias("id"), "t").distinct()
    held = map_batches(texts.join(need.hint("merge"), ["id", "t"], "left_semi"), sets_of,
                       "id long, t long, set binary").withColumnRenamed("id", "rep")
    # block i meets blocks j >= i; a member of block b goes to (i, b) for i <= b and (b, j) for j > b
    last = F.ceil(F.col("m") / BLOCK).cast("int") - 1
    block = F.pmod(F.xxhash64("rep", "key"), (last + 1).cast("long")).cast("int")
    dealt = entries.withColumn("mine", block).withColumn("other", F.explode(F.sequence(F.lit(0), last))) \
        .withColumn("i", F.least("mine", "other")).withColumn("j", F.greatest("mine", "other")) \
        .select("key", "i", "j", "mine", "v", "rep", "t", "n", "label")

    def compare(pdf):
        return blocks_links(pdf, percent, big, margin)

    return dealt.join(held, ["rep", "t"]).groupBy("key", "i", "j") \
        .applyInPandas(compare, "a long, ta long, b long, tb long, sure boolean")


def bits(values: list[np.ndarray]) -> np.ndarray:
    """One packed bit row per array, over the values that occur in two arrays or more."""
    flat = np.concatenate(values) if values else np.zeros(0, np.uint64)
    row = np.repeat(np.arange(len(values)), [len(x) for x in values])
    _, at, count = np.unique(flat, return_inverse=True, return_counts=True)
    common = np.flatnonzero(count > 1)
    place = np.full(len(count), -1)
    place[common] = np.arange(len(common))
    col = place[at]
    words = max(1, -(-len(common) // 64))
    out = np.zeros((len(values), words), np.uint64)
    use = col >= 0
    np.bitwise_or.at(out, (row[use], col[use] // 64), np.uint64(1) << (col[use] % 64).astype(np.uint64))
    return out


def blocks_links(pdf, percent: int, big: int, margin: float):
    """Compare the members of one list, or of one pair of its blocks."""
    import pandas as pd
    pdf = pdf.sort_values("rep")
    sets = [np.frombuffer(x, np.uint64) for x in pdf["set"]]
    rep, t, n, mine = (pdf[c].to_numpy() for c in ("rep", "t", "n", "mine"))
    single = pdf["i"].iloc[0] == pdf["j"].iloc[0]
    here = np.uint64(int(pdf["v"].iloc[0]) & 0xFFFFFFFFFFFFFFFF)
    # runs before this list's: a pair that shares one was compared there
    before = []
    for s in sets:
        k = s[:K]
        r = k[:-2] * np.uint64(MIX[0]) ^ k[1:-1] * np.uint64(MIX[2]) ^ k[2:] * np.uint64(MIX[3])
        before.append(r[k[:-2] < here])
    runs_bits, set_bits = bits(before), bits(sets)
    parent = {x: x for x in pdf["label"]}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    labels = pdf["label"].to_numpy().copy()
    out = []
    for p in range(len(rep) - 1):
        q = np.arange(p + 1, len(rep))
        ok = (labels[q] != labels[p]) & (100 * np.minimum(n[q], n[p]) >= percent * np.maximum(n[q], n[p]))
        if not single:
            ok &= mine[q] != mine[p]
        q = q[ok]
        if not len(q):
            continue
        q = q[~(runs_bits[q] & runs_bits[p]).any(axis=1)]
        if not len(q):
            continue
        both = np.bitwise_count(set_bits[q] & set_bits[p]).sum(axis=1).astype(np.int64)
        whole = (n[q] <= big) & (n[p] <= big)
        sure = whole & (100 * both >= percent * (n[q] + n[p] - both))
        for k in q[sure]:
            a, b = root(labels[p]), root(labels[k])
            if a != b:  # links inside a component change nothing
                parent[max(a, b)] = min(a, b)
                out.append((rep[p], t[p], rep[k], t[k], True))
        for k in q[~whole]:
            union = np.union1d(sets[p], sets[k])[:big]
            shared = np.isin(union, sets[p], assume_unique=True) & np.isin(union, sets[k], assume_unique=True)
            if shared.sum() >= (percent / 100 - margin) * len(union):
                out.append((rep[p], t[p], rep[k], t[k], False))
    return pd.DataFrame(out, columns=["a", "ta", "b", "tb", "sure"])


def components(links: DataFrame) -> DataFrame:
    """(node, label): every node of a link with the smallest node reachable from it."""
    both = stored(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(),
                  "links")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")),
                    "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b") \
            .groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("new"))
        jump = step.select(F.col("node").alias("new"), F.col("new").alias("far"))
        new = stored(step.join(jump, "new").select("node", F.col("far").alias("label"),
                                                   (F.col("far") != F.col("label")).alias("moved")), "labels")
        labels = new.select("node", "label")
        if new.filter("moved").limit(1).count() == 0:
            return labels


def near_duplicates(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_shingles, component_id, kept (links at similarity >= percent / 100)."""
    return placed(docs, percent, id_col, text_col).select(F.col("id").alias(id_col), "n_shingles", "component_id", "kept")


def one_of_each(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, less the near-duplicates of a kept document.
    A row repeated with the same id and text stays once."""
    found = stored(placed(docs, percent, id_col, text_col).select("id", "t", "kept"), "placed")
    gone = stored(found.filter(~F.col("kept")).select("id", "t").distinct(), "gone")
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).cast("long").alias("id"),
                        F.xxhash64(text_col).alias("t"))
    left = keyed.join(gone.hint("merge"), ["id", "t"], "left_anti")
    named = found.filter(F.col("kept") & F.col("id").isNotNull())
    if named.groupBy("id", "t").count().filter("count > 1").limit(1).count():
        left = left.filter(F.col("id").isNotNull()).dropDuplicates(["id", "t"]).unionByName(left.filter("id is null"))
    return left.select("row.*")


def placed(docs: DataFrame, percent: int, id_col: str, text_col: str) -> DataFrame:
    """Per document: id, t (hash of the text), n_shingles, component_id, kept."""
    if not LEAST_PERCENT <= percent <= 100:
        raise ValueError(f"percent must be between {LEAST_PERCENT} and 100: the sketches and runs are sized for that")
    sets = stored(sketches(docs, id_col, text_col), "sketches")
    classes = stored(sets.filter(F.col("id").isNotNull() & (F.col("n") > 0)).groupBy("fp")
                     .agg(F.min(F.struct("id", "t")).alias("first"), F.first("n").alias("n"),
                          F.first("sketch").alias("sketch"))
                     .select("fp", F.col("first.id").alias("rep"), F.col("first.t").alias("t"), "n", "sketch"), "classes")
    entries = classes.filter(F.col("n") >= RUN).select("rep", "t", "n", F.explode(runs(F.col("sketch"))).alias("x")) \
        .select("rep", "t", "n", "x.key", "x.v")
    lists = entries.groupBy("key").agg(F.min(F.struct("rep", "n")).alias("hub"), F.count(F.lit(1)).alias("m")) \
        .filter("m > 1").select("key", F.col("hub.rep").alias("hub"), F.col("hub.n").alias("hub_n"))
    members = stored(entries.join(lists, "key"), "members")
    # the texts of all that a list names, once: every later step works on these
    texts = stored(keyed_texts(docs, id_col, text_col)
                   .join(members.select(F.col("rep").alias("id"), "t").distinct().hint("merge"), ["id", "t"], "left_semi")
                   .dropDuplicates(["id", "t"]), "texts")
    first = members.filter((F.col("rep") != F.col("hub")) & similar_size(F.col("n"), F.col("hub_n"), percent)) \
        .select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    links = stored(confirmed(stored(by_estimate(first, classes, percent), "pairs"), texts, percent), "confirmed")
    labels = components(links)
    known = members.select("key", "v", "rep", "t", "n").join(labels.withColumnRenamed("node", "rep"), "rep", "left") \
        .withColumn("label", F.coalesce("label", "rep"))
    # lists with several components; of those with the same members, the first in the order of values
    mixed = known.groupBy("key").agg(
        F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("m"), F.min("v").alias("v"),
        F.bit_xor(F.xxhash64("rep")).alias("h1"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("h2")) \
        .filter("low < high").groupBy("m", "h1", "h2").agg(F.min(F.struct("v", "key")).alias("x")).select("m", "x.key")
    open_lists = stored(known.join(mixed, "key"), "open")
    short = open_lists.filter(F.col("m") <= SHORT)
    x = short.select("key", F.col("rep").alias("a"), F.col("n").alias("na"), F.col("label").alias("la"))
    y = short.select("key", F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("label").alias("lb"))
    second = x.join(y, "key").filter((F.col("a") < F.col("b")) & (F.col("la") != F.col("lb"))
                                     & similar_size(F.col("na"), F.col("nb"), percent)) \
        .select("a", "b").distinct().join(first, ["a", "b"], "left_anti")
    found = stored(in_blocks(open_lists.filter(F.col("m") > SHORT), texts, percent), "blocks")
    unsure = found.filter(~F.col("sure")).select("a", "ta", "b", "tb").distinct()
    more = confirmed(stored(by_estimate(second, classes, percent).union(unsure), "pairs"), texts, percent) \
        .union(found.filter("sure").select("a", "b"))
    links = stored(links.union(more), "confirmed")
    labels = components(links).withColumnsRenamed({"node": "rep", "label": "component_id"})
    of_class = classes.select("fp", "rep").join(labels, "rep", "left") \
        .select("fp", F.coalesce("component_id", "rep").alias("component_id"))
    named = sets.select("id", "t", "n", "fp").join(of_class, "fp", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return named.select("id", "t", F.col("n").alias("n_shingles"), component.alias("component_id"),
                        F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))
