"""Spelling variants grouped: words at edit distance one, found by PartEnum signatures.

A word's letters are a multiset, that is a binary vector whose dimensions are
(letter, occurrence).  One replaced letter moves two of its dimensions, one
inserted or deleted letter one, so words at edit distance one are vectors at
Hamming distance two (equal lengths) or one (lengths that differ by one).

PartEnum.  The dimensions are dealt to parts; vectors at distance k agree on all
but k parts at least, so every choice of (parts - k) parts gives a signature (a
hash of the vector's projection on them), and two near vectors share one at
least.  Words of equal length meet on signatures for k = 2 (5 parts, 10
signatures a word), words whose lengths differ by one on signatures for k = 1 (4
parts, 4 signatures each way).  An equi-join on the signature gives candidates,
which the edit distance confirms.  How the dimensions are dealt (so that every
part holds as much information, from the letter counts) decides the cost, never
the result.

Hot signatures.  The pairs within a signature grow with the square of its words.
A signature with more than ``group_rows`` of them is split: its words meet on
the signature and on the word with one letter left out, at its place.  All
words that share such a key are links (or equal words), so nothing is compared in
vain and no link is lost.

Joins.  Every table here grows with the vocabulary.  Spark sizes a join's side by its
compressed files and counts neither the rows that the signatures make of a word nor
an explode, so it would send such a side through the driver long after it has outgrown
it.  All joins are therefore merge joins.

A word's form is its near word with the largest count (ties: smallest in
code-point order) if that is at least ``ratio`` times its own, else null; its
root is reached by following forms.  Counts rise tenfold along the way, so the
way is short (the rounds follow from the largest count).

Edge cases.  Null and empty texts have no words.  Without words the result is
empty.  A null ``doc_id`` garbles nothing.  Repeated rows count as often as they
stand.  Words of any length take part; only the named columns are read.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoplens.llm.common import batch_of, stored

LETTERS = r"[A-Za-zÀ-ÿ]"
GROUP_ROWS = 256
SAME, SHORT, LONG = 0, 1, 2  # a row's part in a pair: equal lengths, or the shorter or longer of two
REPLACED_PARTS, INSERTED_PARTS = 5, 4
DEALT_DIMENSIONS = 4_096  # dimensions dealt by their counts; rarer ones by hash


# --- words ------------------------------------------------------------------


def word_counts(docs: DataFrame, min_length: int = 7, min_count: int = 2, garble: int | None = None,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): runs of letters, A-Z lower-cased, with ``min_length`` code points and ``min_count`` occurrences.

    With ``garble`` a run loses one code point where ``garble`` divides h, the
    crc32 of ``<id>:<run>``: the one at h modulo its length.
    """
    runs = docs.select(F.col(id_col).cast("string").alias("id"), F.explode(F.regexp_extract_all(
        F.col(text_col), F.lit(f"({LETTERS}{{{min_length},}})"), F.lit(1))).alias("run"))
    # A-Z only: lower() would change other letters, too
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    runs = runs.withColumn("word", F.when(F.col("run").rlike("[A-Z]"), F.translate("run", upper, lower)).otherwise(F.col("run")))
    if garble:
        runs = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "word")))
        runs = runs.withColumn("word", F.when(F.col("h") % garble == 0, without(
            F.col("word"), (F.col("h") % F.length("word")).cast("int") + 1)).otherwise(F.col("word")))
        runs = runs.filter(F.length("word") >= min_length)
    return runs.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count)


def without(word: Column, at: Column) -> Column:
    """The word without its code point at ``at`` (from 1)."""
    return F.concat(F.substring(word, F.lit(1), at - 1), F.substring(word, at + 1, F.length(word)))


# --- signatures -------------------------------------------------------------


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def vectors(words: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """By length: (places in ``words``, (words, length) dimensions as letter << 32 | occurrence)."""
    texts = words.to_pylist()
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    for length in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == length)
        letters = np.frombuffer("".join([texts[i] for i in at.tolist()]).encode("utf-32-le"), np.uint32)
        letters = np.sort(letters.reshape(len(at), length), axis=1).astype(np.uint64)
        place = np.broadcast_to(np.arange(length), letters.shape)
        fresh = np.ones(letters.shape, bool)
        fresh[:, 1:] = letters[:, 1:] != letters[:, :-1]
        nth = place - np.maximum.accumulate(np.where(fresh, place, 0), axis=1)
        yield at, letters << np.uint64(32) | nth.astype(np.uint64)


COUNTS = pa.schema([("dim", pa.int64()), ("n", pa.int64())])


def dimension_counts(words: DataFrame) -> DataFrame:
    """(dim, n): words with each dimension."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, dims in vectors(b.column(0)):
                values, n = np.unique(dims, return_counts=True)
                yield batch_of(COUNTS, [values.astype(np.int64), n])

    return words.select("word").mapInArrow(count, "dim long, n long").groupBy("dim").agg(F.sum("n").alias("n"))


def deal(counts: list[tuple[int, int]], n_words: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Dimensions (sorted) and their parts: the most informative first, each to the part with least so far."""

    def information(n: int) -> float:
        p = min(max(n / n_words, 1e-9), 1 - 1e-9)
        return -p * math.log2(p) - (1 - p) * math.log2(1 - p)

    load, part = [0.0] * parts, {}
    for bits, dim in sorted(((information(n), dim) for dim, n in counts), reverse=True):
        least = min(range(parts), key=load.__getitem__)
        part[dim] = least
        load[least] += bits
    dims = np.array(sorted(part), np.uint64)
    return dims, np.array([part[int(d)] for d in dims], np.int64)


def projections(dims: np.ndarray, dealt: tuple[np.ndarray, np.ndarray], parts: int) -> np.ndarray:
    """(words, parts) hashes of each vector's projection on each part."""
    known, part_of = dealt
    code = _mix(dims + np.uint64(0x9E3779B97F4A7C15))
    part = (code >> np.uint64(40)).astype(np.int64) % parts
    if len(known):
        at = np.minimum(np.searchsorted(known, dims), len(known) - 1)
        part = np.where(known[at] == dims, part_of[at], part)
    return np.stack([_mix((code * (part == p)).sum(axis=1, dtype=np.uint64) + np.uint64(p + 1)) for p in range(parts)], axis=1)


ROWS = pa.schema([("sig", pa.int64()), ("role", pa.int8()), ("word", pa.string()), ("n", pa.int64())])


def signatures(words: DataFrame, replaced: tuple, inserted: tuple) -> DataFrame:
    """(sig, role, word, n): all signatures of every word."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for b in batches:
                sigs, roles, places = [], [], []
                for at, dims in vectors(b.column("word")):
                    length = dims.shape[1]
                    jobs = [(SAME, 2, replaced, REPLACED_PARTS, length), (SHORT, 1, inserted, INSERTED_PARTS, length),
                            (LONG, 1, inserted, INSERTED_PARTS, length - 1)]
                    for role, k, dealt, parts, shorter in jobs:
                        own = projections(dims, dealt, parts) if role != LONG else own  # as SHORT's
                        for number, chosen in enumerate(itertools.combinations(range(parts), parts - k)):
                            salt = np.uint64((shorter * 64 + number) * 4 + k)
                            sigs.append(_mix(own[:, chosen].sum(axis=1, dtype=np.uint64) ^ _mix(np.array([salt]))))
                            roles.append(np.full(len(at), role, np.int8))
                            places.append(at)
                if sigs:
                    place = pa.array(np.concatenate(places))
                    yield batch_of(ROWS, [np.concatenate(sigs).view(np.int64), np.concatenate(roles),
                                          b.column("word").take(place), b.column("n").take(place)])

    return words.select("word", "n").mapInArrow(rows, "sig long, role byte, word string, n long")


# --- links ------------------------------------------------------------------


def meet(rows: DataFrame, key: str) -> DataFrame:
    """Words (a, b) of equal ``key`` at edit distance one, a the smaller or the shorter, with their counts."""
    a = rows.filter(F.col("role") != LONG).select(F.col(key).alias("key"), F.col("role").alias("role"),
                                                  F.col("word").alias("a"), F.col("n").alias("n_a"))
    b = rows.filter(F.col("role") != SHORT).select(F.col(key).alias("key_b"), F.col("word").alias("b"), F.col("n").alias("n_b"))
    near = F.levenshtein("a", "b", 1) == 1
    return a.hint("merge").join(b, (F.col("key") == F.col("key_b")) & ((F.col("role") == SHORT) | (F.col("a") < F.col("b"))) & near) \
        .select("a", "b", "n_a", "n_b")


def split_keys(rows: DataFrame) -> DataFrame:
    """Rows of hot signatures keyed by the signature and the word with one letter left out."""
    places = F.sequence(F.lit(1), F.length("word"))
    same = F.transform(places, lambda i: F.xxhash64(F.col("sig"), i, without(F.col("word"), i)))
    longer = F.array_distinct(F.transform(places, lambda i: F.xxhash64(F.col("sig"), without(F.col("word"), i))))
    keys = F.when(F.col("role") == SAME, same).when(F.col("role") == LONG, longer) \
        .otherwise(F.array(F.xxhash64(F.col("sig"), F.col("word"))))
    return rows.select(F.explode(keys).alias("key"), "role", "word", "n")


def near_words(words: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Distinct links (a, b, n_a, n_b) of the stored table ``words`` (word, n)."""
    counts = dimension_counts(words).orderBy(F.desc("n"), "dim").limit(DEALT_DIMENSIONS).collect()
    n_words = words.count()
    dealt = [deal([(r["dim"], r["n"]) for r in counts], max(n_words, 1), parts) for parts in (REPLACED_PARTS, INSERTED_PARTS)]
    sigs = signatures(words, *dealt)
    sizes = sigs.groupBy("sig").agg(*[F.count_if(F.col("role") == r).alias(f"r{r}") for r in (SAME, SHORT, LONG)]) \
        .filter((F.col("r0") > 1) | (F.col("r1") > 0) & (F.col("r2") > 0)) \
        .select(F.col("sig").alias("sized"), (F.col("r0") + F.col("r1") + F.col("r2") > group_rows).alias("hot"))
    paired = stored(sigs.hint("merge").join(sizes, F.col("sig") == F.col("sized")).drop("sized"), "spelling-signatures")
    links = meet(paired.filter(~F.col("hot")), "sig").unionByName(meet(split_keys(paired.filter("hot")), "key"))
    return links.distinct()


def variants(words: DataFrame, ratio: int = 10, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of (word, n)."""
    if ratio < 2:
        raise ValueError("ratio must be 2 or more: forms have to rise in count")
    words = stored(words.select("word", "n"), "spelling-words")
    links = stored(near_words(words, group_rows), "spelling-links")
    both = links.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("n_other")).unionByName(
        links.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("n_other")))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"),
                                    F.min(F.struct((-F.col("n_other")).alias("minus"), "other")).alias("best"))
    large = -F.col("best.minus") >= ratio * F.col("n")
    formed = stored(words.hint("merge").join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(large, F.col("best.other")).alias("form"), F.when(large, -F.col("best.minus")).alias("form_n")), "spelling-forms")
    most = words.agg(F.max("n")).first()[0] or 1
    longest = max(1, math.ceil(math.log(most, ratio)))  # forms in a row, at most
    roots = formed.filter("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(longest)) if longest > 1 else 0):
        onward = roots.select(F.col("word").alias("at"), F.col("root").alias("next"))
        roots = stored(roots.hint("merge").join(onward, F.col("root") == F.col("at"), "left")
                       .select("word", F.coalesce("next", "root").alias("root")), "spelling-roots")
    return formed.hint("merge").join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"),
                                                     "n", "n_near", "form_n")


# DuckDB: words that share the rest after one letter is left out are near; crc32 by its table
SQL = r"""
WITH RECURSIVE crc AS MATERIALIZED (SELECT list(v ORDER BY b) AS t FROM (SELECT b, list_reduce(range(8),
  lambda c, i: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END), b) AS v FROM range(256) r(b))),
found AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]{7,}')),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
runs AS (SELECT doc_id, run, count(*) AS n FROM found GROUP BY ALL),
coded AS (SELECT run, n, flatten(list_transform(string_split(doc_id || ':' || run, ''),
  lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)] ELSE [195, unicode(x) - 64] END)) AS bytes FROM runs),
hashed AS (SELECT run, n, CASE WHEN bytes IS NULL THEN 1 ELSE xor(list_reduce(bytes,
  lambda c, i: xor(c >> 8, t[xor(c & 255, i) + 1]), 4294967295), 4294967295) END AS h FROM coded, crc),
garbled AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2)
  ELSE run END AS word, n FROM hashed),
words AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM garbled WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cut AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1))::INT AS i FROM words)),
links AS (SELECT a.word, b.word AS other, b.n AS n_other FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT c.word, w.word, w.n FROM cut c JOIN words w ON c.rest = w.word
  UNION SELECT w.word, c.word, c.n FROM cut c JOIN words w ON c.rest = w.word),
best AS (SELECT word, count(*) AS n_near, min({'m': -n_other, 'o': encode(other)}) AS best FROM links GROUP BY word),
formed AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.m >= 10 * n THEN decode(best.o) END AS form,
  CASE WHEN -best.m >= 10 * n THEN -best.m END AS form_n FROM words LEFT JOIN best USING (word)),
steps AS (SELECT word, word AS pos, 0 AS k FROM formed
  UNION ALL SELECT s.word, f.form, k + 1 FROM steps s JOIN formed f ON s.pos = f.word WHERE f.form IS NOT NULL),
roots AS (SELECT word, arg_max(pos, k) AS root FROM steps GROUP BY word)
SELECT word, form, root, n, n_near::BIGINT AS n_near, form_n::BIGINT AS form_n FROM formed JOIN roots USING (word)
"""
