"""Quality rules from the text itself and from lines that recur across documents.

All of it is DataFrame work.  One pass over the texts gives the base figures
and, for every distinct normalised line (A-Z and other letters lower-cased,
digits to 0, white space to one space, trimmed), its hash and words; that
narrow table is stored.  For each host the distinct texts holding a line are
counted - exact copies of a text count once, so copying a document does not by
itself turn its lines into boilerplate.  A line is removed when it stands in
more than max(``min_docs``, ``share`` of the host's distinct texts) of them,
and a document is rejected as depleted when more than ``max_removed`` of its
words go with such lines.

Counting is a hash aggregate with partial sums before the shuffle, and the
lines above the limit meet the documents in an equi-join whose hot keys
adaptive execution splits.

Defined results: null text counts as empty (n_words 0, base_failed true);
a null host is a host of its own; one output row per input row, repeated rows
included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoplens.llm.common import stored

BLANK_CHARS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_DOCS = 10
SHARE = 0.10
MAX_REMOVED = 0.70


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """Words between blanks; splitting at a single plain character is far cheaper than at a class."""
    for c in BLANK_CHARS[1:]:
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.filter(F.split(text, " "), lambda w: w != "")


def window_hashes(words: Column) -> Column:
    """Hash of every run of eight words, in order: pairs of words, pairs of pairs
    two apart, pairs of those four apart."""
    def paired(x: Column, gap: int) -> Column:
        return F.zip_with(F.slice(x, F.lit(1), F.size(x) - gap), F.slice(x, F.lit(1 + gap), F.size(x) - gap),
                          lambda a, b: F.xxhash64(a, b))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return bind(hashed, lambda h: bind(paired(h, 1), lambda h2: bind(paired(h2, 2), lambda h4: paired(h4, 4))))


def words_in_repeats(hashes: Column, size: int = WINDOW) -> Column:
    """Words covered by windows that occur twice or more.  Equal windows are
    neighbours after sorting; each of their starts, in text order, covers
    ``size`` words or as many as reach to the next start."""
    def starts(s: Column) -> Column:
        hit = F.filter(s, lambda x, k: F.when(k > 0, F.get(s, k - 1)["h"] == x["h"]).otherwise(False)
                       | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))
        return F.sort_array(F.transform(hit, lambda x: x["p"]))

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda x, k: F.least(F.lit(size), F.coalesce(F.get(p, k + 1) - x, F.lit(size))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)) \
        .otherwise(bind(ordered, lambda s: bind(starts(s), covered)))


def lines_with_words(text: Column) -> Column:
    """Normalised lines holding a word, as structs (lh: hash, nw: words), in order."""
    plain = F.when(text.rlike("[1-9\\x09\\x0B-\\x0D]|  "), F.regexp_replace(
        F.translate(F.lower(text), "123456789\t\x0b\f\r", "000000000    "), " +", " ")).otherwise(F.lower(text))
    lines = F.filter(F.transform(F.split(plain, "\n"), lambda x: F.btrim(x)), lambda x: x != "")
    return F.transform(lines, lambda x: F.struct(
        F.xxhash64(x).alias("lh"), (count_of(x, " ") + 1).alias("nw")))


def count_of(text: Column, chars: str) -> Column:
    """How many of the (one-byte) characters ``chars`` the text holds."""
    left = text
    for c in chars:
        left = F.replace(left, F.lit(c), F.lit(""))
    return F.octet_length(text) - F.octet_length(left)


def base_figures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 host_col: str = "source") -> DataFrame:
    """Per document: row (all its columns), id, host, fp (hash of the text), the base figures, and its lines."""
    t = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"),
                    F.col(host_col).cast("string").alias("host"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    t = t.select("row", "id", "host", "t", words_of(F.col("t")).alias("w"),
                 F.filter(F.split("t", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("ls"))
    n = F.size("w")
    t = t.select(
        "row", "id", "host", F.xxhash64("t").alias("fp"), n.cast("long").alias("n_words"),
        (F.length("t") - count_of(F.col("t"), BLANK_CHARS)).cast("long").alias("word_chars"),
        count_of(F.col("t"), SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("ls") - F.size(F.array_distinct("ls"))).cast("long").alias("n_dup_lines"),
        F.when(n >= WINDOW, window_hashes(F.col("w"))).otherwise(F.array().cast("array<bigint>")).alias("h"),
        lines_with_words(F.col("t")).alias("lines"))
    return t.select("row", "id", "host", "fp", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                    words_in_repeats(F.col("h")).cast("long").alias("n_repeat_words"), "lines")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def frequent_lines(texts: DataFrame, min_docs: int, share: float) -> DataFrame:
    """(host, lh) of lines above the limit; ``texts`` has one row per distinct (host, fp)."""
    hosts = texts.groupBy("host").agg(F.count(F.lit(1)).alias("n_texts"))
    lines = texts.select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: x["lh"]))).alias("lh")) \
        .groupBy("host", "lh").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > min_docs)
    return lines.join(hosts, lines["host"].eqNullSafe(hosts["host"])) \
        .filter(F.col("n") > share * F.col("n_texts")).select(lines["host"], "lh")


def removed_words(base: DataFrame, min_docs: int, share: float) -> DataFrame:
    """(r_host, r_fp, n_removed, r_words) of the distinct texts that hold a line above the limit."""
    texts = base.select("host", "fp", "n_words", "lines").dropDuplicates(["host", "fp"])
    frequent = frequent_lines(texts, min_docs, share).withColumnsRenamed({"host": "f_host", "lh": "f_lh"})
    uses = texts.select("host", "fp", "n_words", F.explode("lines").alias("x")) \
        .select("host", "fp", "n_words", "x.lh", "x.nw")
    return uses.join(frequent, uses["host"].eqNullSafe(frequent["f_host"]) & (F.col("lh") == F.col("f_lh"))) \
        .groupBy("host", "fp").agg(F.sum("nw").cast("long").alias("n_removed"), F.first("n_words").alias("r_words")) \
        .withColumnsRenamed({"host": "r_host", "fp": "r_fp"})


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
          min_docs: int = MIN_DOCS, share: float = SHARE, max_removed: float = MAX_REMOVED) -> DataFrame:
    """Per document: id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, n_removed_words."""
    base = stored(base_figures(docs, id_col, text_col, host_col).drop("row"), "quality")
    removed = removed_words(base, min_docs, share)
    gone = F.coalesce(F.col("n_removed"), F.lit(0).cast("long"))
    return base.drop("lines") \
        .join(removed, base["host"].eqNullSafe(removed["r_host"]) & (F.col("fp") == F.col("r_fp")), "left") \
        .select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                base_failed().alias("base_failed"),
                (~base_failed() & (gone <= max_removed * F.col("n_words"))).alias("kept"),
                gone.alias("n_removed_words"))


def good_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
                   min_docs: int = MIN_DOCS, share: float = SHARE, max_removed: float = MAX_REMOVED) -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``judge`` keeps.  The base
    rules filter where the row is read; only the depleted texts are looked up,
    in a stored table whose measured size decides how it is joined."""
    base = stored(base_figures(docs, id_col, text_col, host_col).drop("row"), "quality")
    depleted = stored(removed_words(base, min_docs, share).filter(F.col("n_removed") > max_removed * F.col("r_words"))
                      .select("r_host", "r_fp"), "depleted")
    rows = base_figures(docs, id_col, text_col, host_col).filter(~base_failed()).select("row", "host", "fp")
    return rows.join(depleted, rows["host"].eqNullSafe(depleted["r_host"]) & (F.col("fp") == F.col("r_fp")),
                     "left_anti").select("row.*")


SQL = f"""
WITH d AS (
  SELECT doc_id, source AS host, coalesce(text, '') AS t FROM documents
), b AS (
  SELECT *, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls,
         list_filter(list_transform(string_split(
             regexp_replace(translate(lower(t), '123456789' || chr(9) || chr(11) || chr(12) || chr(13),
                                      '000000000    '), ' +', ' ', 'g'), chr(10)), lambda x: trim(x)),
           lambda x: x <> '') AS lines
  FROM d
), win AS (
  SELECT doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM b WHERE len(w) >= {WINDOW})
), hit AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM win) WHERE c > 1
), rep AS (
  SELECT doc_id, sum(least({WINDOW}, coalesce(nxt - i, {WINDOW})))::BIGINT AS n_repeat_words
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM hit) GROUP BY doc_id
), texts AS (
  SELECT DISTINCT host, t, lines FROM b
), hosts AS (
  SELECT host, count(*) AS n_texts FROM texts GROUP BY host
), freq AS (
  SELECT l.host, l.line FROM (
    SELECT host, line, count(*) AS n FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM texts)
    GROUP BY host, line) l
  JOIN hosts h ON l.host IS NOT DISTINCT FROM h.host
  WHERE l.n > {MIN_DOCS} AND l.n > {SHARE} * h.n_texts
), gone AS (
  SELECT u.doc_id, sum(len(u.line) - len(replace(u.line, ' ', '')) + 1)::BIGINT AS n_removed
  FROM (SELECT doc_id, host, unnest(lines) AS line FROM b) u
  JOIN freq f ON u.host IS NOT DISTINCT FROM f.host AND u.line = f.line GROUP BY u.doc_id
), figures AS (
  SELECT b.doc_id, len(w)::BIGINT AS n_words, len(translate(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12)
           || chr(13), ''))::BIGINT AS word_chars,
         (len(t) - len(translate(t, '{SYMBOLS}', '')))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_removed, 0)::BIGINT AS n_removed_words
  FROM b LEFT JOIN rep ON b.doc_id = rep.doc_id LEFT JOIN gone ON b.doc_id = gone.doc_id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND n_removed_words <= {MAX_REMOVED} * n_words AS kept,
       n_removed_words
FROM figures
"""
