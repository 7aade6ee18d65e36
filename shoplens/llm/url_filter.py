"""URL rules decided by a cascade of Bloom filters.

A rule is a host and a path prefix with the verdict ``allow`` or ``block``; it
fits an url whose host is the rule's or a subdomain of it and whose path starts
with the rule's.  The longest rule that fits wins (most code points of host and
path together, then the longer host; of an allow and a block rule of the same
host and path, block).  An url without a fitting rule gets ``default``.

Every url has few keys that could be rules: each suffix of whole labels of its
host joined with each prefix of its path whose length some rule has.  The keys
of the whole corpus are the universe.  Per list (allow, block) a cascade is
built: its first level is a Bloom filter of the listed keys, the second of the
universe's false positives at the first, the third of the listed keys that pass
the second, and so on until a level has no false positive.  A key's membership
is the level that first rejects it: exact for every key of the universe, since
each level was built against all of them.  Urls are then judged in one map over
the table: no join, no shuffle.

Size.  The driver and each Python worker hold the filters of one shard of the
list at a time, at most ``shard_keys`` listed keys.  Longer lists are dealt to
shards by hash and judged shard by shard.  The levels' sets stay in tables.

Edge cases.  A null url and one without ``://`` has an empty host and path.
Rules with a null or empty host, a host holding one of ``/?#`` or a path that
does not start with ``/`` fit no url (the empty path fits every path, null is
taken as empty).  Rules may repeat.  An empty rule table leaves every url with
``default``; an empty page table gives an empty result; repeated rows stay.
Only the id and url columns are read, extra columns may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoplens.llm.common import batch_of, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ALLOW, BLOCK = "allow", "block"
SHARD_KEYS = 8_000_000  # listed keys a shard: some 40 MB of filters
SMALL_LEVEL = 4_096     # sets up to this size get filters that end the cascade soon
MAX_LEVELS = 200


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


# --- keys -------------------------------------------------------------------


def rule_keys(rules: DataFrame) -> DataFrame:
    """Distinct (key, path_len, host_len, verdict) of the rules that can fit an url."""
    r = rules.select(F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"),
                     "verdict")
    r = r.filter((F.col("host") != "") & ~F.col("host").rlike("[/?#]") & F.col("path").rlike(r"^(/|$)")
                 & ~F.col("path").rlike("[?#]"))
    return r.select(F.concat("host", "path").alias("key"), F.length("path").alias("path_len"),
                    F.length("host").alias("host_len"), "verdict").distinct()


def candidate_keys(host: Column, path: Column, longest_host: int, path_lengths: list[int]) -> Column:
    """The url's keys that could be rules, the longest first: array of (len, host_len, key)."""
    # a host longer than any rule's is cut to the suffix that can hold one, the label it cuts into is left out
    tail = F.when(F.length(host) > longest_host, F.right(host, F.lit(longest_host + 1))).otherwise(F.concat(F.lit("."), host))
    labels = F.split(tail, r"\.", -1)
    suffixes = F.when(F.size(labels) > 1, F.transform(
        F.sequence(F.lit(2), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    ).otherwise(F.array().cast("array<string>"))
    suffixes = F.filter(suffixes, lambda s: s != "")
    lengths = F.filter(F.array(*[F.lit(n) for n in path_lengths]), lambda n: n <= F.length(path))
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(lengths, lambda n: F.struct(
        (F.length(s) + n).alias("len"), F.length(s).alias("host_len"),
        F.concat(s, F.substring(path, F.lit(1), n)).alias("key")))))
    return F.sort_array(keys, asc=False)


def hashes(key: Column) -> list[Column]:
    """Two independent 64-bit hashes; the positions of all levels derive from them."""
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("second"), key).alias("h2")]


# --- cascade ----------------------------------------------------------------


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Level:
    number: int
    n_bits: int
    n_hashes: int
    words: np.ndarray  # uint64

    def positions(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """(n_hashes, n) bit positions of keys with these hashes."""
        with np.errstate(over="ignore"):
            salt = _mix(np.array([self.number], np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            a, b = _mix(h1 ^ salt), _mix(h2 + salt) | np.uint64(1)
            steps = np.arange(self.n_hashes, dtype=np.uint64)[:, None]
            return _mix(a[None, :] + steps * b[None, :]) % np.uint64(self.n_bits)

    def holds(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        p = self.positions(h1, h2)
        return ((self.words[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1)).all(axis=0)


@dataclass
class Cascade:
    levels: list[Level]

    def member(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Keys rejected at an even level (or by none of an odd number) are listed."""
        result = np.zeros(len(h1), bool)
        open_ = np.arange(len(h1))
        for i, level in enumerate(self.levels):
            passed = level.holds(h1[open_], h2[open_])
            result[open_[~passed]] = i % 2 == 1
            open_ = open_[passed]
        result[open_] = len(self.levels) % 2 == 1
        return result


def _u64(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64, copy=False).view(np.uint64)


BITS = pa.schema([("word", pa.int64()), ("bits", pa.int64())])


def filter_of(keys: DataFrame, number: int, n: int, rate: float) -> Level:
    """Bloom filter of the ``n`` keys: tasks set the bits of their batches, an
    aggregate joins equal words, the driver receives the filter's words only."""
    n_hashes = max(1, round(-math.log2(rate)))
    n_bits = max(64, math.ceil(n * n_hashes / math.log(2)))
    level = Level(number, n_bits, n_hashes, np.zeros(0, np.uint64))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = np.unique(level.positions(_u64(b.column(0)), _u64(b.column(1))))
            if len(p):
                word, first = np.unique(p >> np.uint64(6), return_index=True)
                bits = np.bitwise_or.reduceat(np.uint64(1) << (p & np.uint64(63)), first)
                yield batch_of(BITS, [word.astype(np.int64), bits.view(np.int64)])

    rows = keys.select("h1", "h2").mapInArrow(words, "word long, bits long") \
        .groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    level.words = np.zeros(n_bits // 64 + 1, np.uint64)
    level.words[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().astype(np.int64).view(np.uint64)
    return level


def passing(keys: DataFrame, level: Level) -> DataFrame:
    """The rows of (key, h1, h2) that a level lets pass."""
    shared = keys.sparkSession.sparkContext.broadcast(level)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(shared.value.holds(_u64(b.column("h1")), _u64(b.column("h2")))))

    return keys.select("key", "h1", "h2").mapInArrow(pick, "key string, h1 long, h2 long")


def build_cascade(listed: DataFrame, universe: DataFrame) -> Cascade:
    """Levels for the stored tables (key, h1, h2) of listed keys and of the universe.

    Level 1 gets the false-positive rate that makes its survivors about as many
    as the listed keys, the others one half (cheapest in total), or one in a
    thousand where the set is small anyway.
    """
    inside, n = listed, listed.count()
    outside, levels = None, []
    if not n:
        return Cascade([])
    rate = min(0.5, math.sqrt(0.5) * n / max(universe.count(), 1))
    while n:
        if len(levels) == MAX_LEVELS:
            raise RuntimeError("two keys agree in both hashes: the cascade does not end")
        level = filter_of(inside, len(levels) + 1, n, rate)
        levels.append(level)
        if outside is None:  # the universe without the listed keys, of which only the survivors are ever needed
            wrong = passing(universe, level).join(listed.select("key"), "key", "left_anti")
        else:
            wrong = passing(outside, level)
        inside, outside = stored(wrong.select("key", "h1", "h2"), "url-level"), inside
        n = inside.count()
        rate = 0.5 if n > SMALL_LEVEL else 1 / 1024
    return Cascade(levels)


# --- judging ----------------------------------------------------------------

FOUND = pa.schema([("at", pa.int32()), ("found", pa.string())])


def _search(urls: DataFrame, cascades: list[tuple[str, Cascade]], shard: int, shards: int) -> DataFrame:
    """Lower ``at`` to the first candidate key that a cascade of this shard holds, with its verdict in ``found``."""
    shared = urls.sparkSession.sparkContext.broadcast(cascades)
    schema = urls.schema

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h1s, h2s = b.column("h1s"), b.column("h2s")
            h1, h2 = _u64(h1s.flatten()), _u64(h2s.flatten())
            row = np.repeat(np.arange(b.num_rows), np.diff(h1s.offsets.to_numpy()))
            place = np.arange(len(row)) - (h1s.offsets.to_numpy()[:-1] - h1s.offsets.to_numpy()[0])[row]
            mine = np.flatnonzero(h2 % np.uint64(shards) == shard)
            at, found = b.column("at").to_numpy().copy(), b.column("found").to_pylist()
            for verdict, cascade in shared.value:  # block comes last and wins a tie
                hit = mine[cascade.member(h1[mine], h2[mine])]
                for r, k in zip(row[hit].tolist(), place[hit].tolist()):
                    if k < at[r] or k == at[r] and verdict == BLOCK:
                        at[r], found[r] = k, verdict
            columns = {"at": pa.array(at, pa.int32()), "found": pa.array(found, pa.string())}
            yield pa.RecordBatch.from_arrays([columns.get(f, b.column(f)) for f in b.schema.names], names=b.schema.names)

    return urls.mapInArrow(search, schema)


NO_KEY = 2**31 - 1


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
               default: str = ALLOW, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """Per page ``id_col``, host, path, rule (host and path of the rule that
    decided, else null) and verdict (the rule's, else ``default``).

    ``rules`` has the columns host, path and verdict (``allow`` or ``block``).
    """
    listed = rule_keys(rules)
    bound = listed.agg(F.count("*").alias("n"), F.max("host_len").alias("longest"),
                       F.sort_array(F.collect_set("path_len")).alias("lengths"),
                       F.count_if(~F.coalesce(F.col("verdict").isin(ALLOW, BLOCK), F.lit(False))).alias("odd")).first()
    if bound["odd"]:
        raise ValueError("a rule's verdict must be allow or block")
    urls = pages.select(F.col(id_col).alias(id_col), host_of(F.col(url_col)).alias("host"),
                        path_of(F.col(url_col)).alias("path"))
    urls = urls.withColumns({"host": F.coalesce("host", F.lit("")), "path": F.coalesce("path", F.lit(""))})
    if not bound["n"]:
        return urls.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})

    def with_keys(df: DataFrame) -> DataFrame:
        return df.withColumn("keys", candidate_keys(F.col("host"), F.col("path"), bound["longest"], bound["lengths"]))

    # host and path only up to what a rule can reach, so that few rows remain before the suffixes are made
    reach = urls.select(F.when(F.length("host") > bound["longest"], F.right("host", F.lit(bound["longest"] + 1)))
                        .otherwise(F.concat(F.lit("."), "host")).alias("host"),
                        F.substring("path", 1, max(bound["lengths"])).alias("path")).distinct()
    universe = stored(with_keys(reach.withColumn("host", F.regexp_replace("host", r"^[^.]*\.", "")))
                      .select(F.explode("keys.key").alias("key")).distinct().select("key", *hashes(F.col("key"))), "url-keys")
    shards = math.ceil(bound["n"] / shard_keys)
    lists = stored(listed.select("key", "verdict").distinct().select("key", "verdict", *hashes(F.col("key"))), "url-rules")

    found = with_keys(urls).select(
        id_col, "host", "path", F.col("keys.key").alias("keys"),
        F.transform("keys.key", lambda k: F.xxhash64(k)).alias("h1s"),
        F.transform("keys.key", lambda k: F.xxhash64(F.lit("second"), k)).alias("h2s"),
        F.lit(NO_KEY).alias("at"), F.lit(None).cast("string").alias("found"))
    for shard in range(shards):
        mine = shard_of(shards) == shard
        cascades = [(verdict, build_cascade(lists.filter(mine & (F.col("verdict") == verdict)).drop("verdict"),
                                            universe.filter(mine))) for verdict in (ALLOW, BLOCK)]
        found = _search(found, cascades, shard, shards)
        if shards > 1:
            found = stored(found, "url-shard")
    hit = F.col("at") < NO_KEY
    return found.select(id_col, "host", "path", F.when(hit, F.try_element_at("keys", F.col("at") + 1)).alias("rule"),
                        F.coalesce("found", F.lit(default)).alias("verdict"))


def shard_of(shards: int) -> Column:
    """``h2`` as an unsigned number modulo ``shards``, as the tasks compute it."""
    high, low = F.shiftrightunsigned("h2", 32), F.col("h2").bitwiseAND(F.lit(0xFFFFFFFF))
    return (high * F.lit(2**32 % shards) + low) % F.lit(shards)


SQL = r"""
WITH rules(host, path, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
  ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
urls AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, row_number() OVER () AS k FROM rest),
fits AS (SELECT k, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(verdict, length(r.host || r.path)) AS verdict
  FROM urls u JOIN rules r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path) GROUP BY k)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM urls LEFT JOIN fits USING (k)
"""
