"""Language identification by words first, shorter and shorter n-grams after.

Learning (Spark): the words of a bounded sample of labelled documents (about
``max_docs`` of them, chosen by a hash of the id; the bound is a parameter) are
counted per language, and so are the character n-grams of the padded words.
The model keeps about ``max_words`` (language, word) pairs and as many n-grams of
each length, so its size has a bound too.  Both bounds are dealt out evenly: every
language gets its share of the documents and of the entries, so that one with few
documents keeps its words beside one with many.

Scoring: every word of a text adds one number per language.  A known word adds
its log relative frequencies.  An unknown word backs off: the longest n-grams
with a known one among them speak, each by its log relative frequency,
averaged and discounted per step.  The scores are summed over the whole text
and turned into shares of 1; the largest is the prediction (equal shares: the
first language in alphabetical order).

Defined results: null text or one without a letter is ``und`` with score 0, as
is every text when nothing could be learned; a text whose words are all
unknown down to single letters gets equal shares.  Rows without an id are never
learned from.  One output row per input row.
"""

from __future__ import annotations

import re
import uuid
from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoplens.llm.common import batch_of, map_batches

UNKNOWN = "und"
MAX_DOCS = 20_000
MAX_WORDS = 60_000
ORDERS = (5, 4, 3, 2, 1)
SMOOTHING = 0.5
DISCOUNT = 0.4
MEMORY_WORDS = 200_000
WORD = re.compile(r"[^\W\d_]+")
NOT_LETTERS = r"[^\p{L}]+"


class Model:
    """Languages, and per known word or n-gram a row of log frequencies, one per language."""

    def __init__(self, languages: list[str], words: dict[str, int], word_rows: np.ndarray, grams: dict[str, int],
                 gram_rows: np.ndarray):
        self.id = uuid.uuid4().hex
        self.languages = languages
        self.words, self.word_rows, self.grams, self.gram_rows = words, word_rows, grams, gram_rows

    def vector(self, word: str) -> np.ndarray:
        known = self.words.get(word)
        if known is not None:
            return self.word_rows[known]
        padded = f"_{word}_"
        weight = 1.0
        for n in ORDERS:
            found = [g for g in (self.grams.get(padded[i:i + n]) for i in range(len(padded) - n + 1)) if g is not None]
            if found:
                return weight * self.gram_rows[found].mean(axis=0)
            weight *= DISCOUNT
        return np.zeros(len(self.languages))


class Scorer(dict):
    """Word -> row of a growing matrix of score vectors; emptied when full."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model
        self.rows = np.zeros((1024, max(1, len(model.languages))))

    def __missing__(self, word: str) -> int:
        k = len(self)
        if k >= len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[k] = self.model.vector(word)
        self[word] = k
        return k

    def reset(self) -> None:
        self.clear()
        self.rows = np.zeros((1024, self.rows.shape[1]))

    def score(self, text: str | None) -> tuple[str, float]:
        words = WORD.findall(text.lower()) if text else []
        if not words or not self.model.languages or not any(c.isalpha() for w in words for c in w):
            return UNKNOWN, 0.0
        if len(self) >= MEMORY_WORDS:
            self.reset()
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        total = self.rows[at].sum(axis=0)
        share = np.exp(total - total.max())
        best = int(total.argmax())
        return self.model.languages[best], float(share[best] / share.sum())


SCORERS: OrderedDict[str, Scorer] = OrderedDict()


def scorer(model: Model) -> Scorer:
    """The worker's scorer of a model, kept between tasks (the last two models)."""
    if model.id not in SCORERS:
        SCORERS[model.id] = Scorer(model)
        while len(SCORERS) > 2:
            SCORERS.popitem(last=False)
    return SCORERS[model.id]


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          max_docs: int = MAX_DOCS, max_words: int = MAX_WORDS) -> Model:
    """Fit on about ``max_docs`` of the rows with an id, a text and a language."""
    rows = docs.filter(F.col(id_col).isNotNull() & F.col(lang_col).isNotNull())
    have = {r["lang"]: r["n"] for r in rows.groupBy(F.col(lang_col).alias("lang")).agg(F.count(F.lit(1)).alias("n")).collect()}
    quota = shares(have, max_docs)
    share = F.lit(0)
    for lang in sorted(have):
        share = F.when(F.col(lang_col) == lang, round(min(1.0, quota[lang] / have[lang]) * 1_000_000)).otherwise(share)
    sample = rows.filter(F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1_000_000)) < share)
    words = sample.select(F.col(lang_col).alias("lang"),
                          F.explode(F.split(F.lower(text_col), NOT_LETTERS)).alias("word")) \
        .filter("word <> ''").groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    words = words.persist()
    try:
        padded = F.concat(F.lit("_"), "word", F.lit("_"))
        sizes = {}
        tables = [words.select("lang", F.col("word").alias("gram"), "n", F.lit(0).alias("size"))]
        for size in ORDERS:
            tables.append(words.filter(F.length("word") + 2 >= size)
                          .select("lang", F.explode(grams(padded, size)).alias("gram"), "n")
                          .groupBy("lang", "gram").agg(F.sum("n").alias("n")).withColumn("size", F.lit(size)))
        found = {}
        for table, size in zip(tables, (0, *ORDERS), strict=True):
            sizes[size] = {r["lang"]: (r["total"], r["kinds"]) for r in table.groupBy("lang").agg(
                F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds")).collect()}
            entries = shares({lang: kinds for lang, (_, kinds) in sizes[size].items()}, max_words)
            place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
            most = F.element_at(F.create_map(*[F.lit(x) for pair in entries.items() for x in pair]), F.col("lang")) \
                if entries else F.lit(0)
            found[size] = table.withColumn("place", place).filter(F.col("place") <= max([0, *entries.values()])) \
                .filter(F.col("place") <= most).select("lang", "gram", "n").collect()
    finally:
        words.unpersist()
    languages = sorted(sizes[0])
    of_words = logs(found[0], sizes[0], languages)
    of_grams = [logs(found[size], sizes[size], languages) for size in ORDERS]
    grams_at: dict[str, int] = {}
    for names, _ in of_grams:
        for g in names:
            grams_at[g] = len(grams_at)
    return Model(languages, {w: i for i, w in enumerate(of_words[0])}, of_words[1], grams_at,
                 np.concatenate([x for _, x in of_grams]))


def shares(have: dict[str, int], bound: int) -> dict[str, int]:
    """``bound`` dealt out evenly: who has less than an even share keeps all, the rest goes to the others."""
    out, left = {}, bound
    for i, (lang, n) in enumerate(sorted(have.items(), key=lambda x: (x[1], x[0]))):
        out[lang] = min(n, left // (len(have) - i))
        left -= out[lang]
    return out


def grams(text: Column, size: int) -> Column:
    """All runs of ``size`` characters of a text that has as many."""
    return F.transform(F.sequence(F.lit(1), F.length(text) + 1 - size), lambda i: F.substr(text, i, F.lit(size)))


def logs(rows, sizes: dict, languages: list[str]) -> tuple[list[str], np.ndarray]:
    """The kept words or n-grams and their smoothed log relative frequencies by language."""
    at = {x: i for i, x in enumerate(languages)}
    total = np.array([sizes.get(x, (0, 0))[0] for x in languages], float)
    kinds = max([1, *(k for _, k in sizes.values())])
    names: dict[str, int] = {}
    for r in rows:
        names.setdefault(r["gram"], len(names))
    counts = np.zeros((len(names), len(languages)))
    for r in rows:
        counts[names[r["gram"]], at[r["lang"]]] = r["n"]
    out = np.log((counts + SMOOTHING) / (total + SMOOTHING * kinds))
    # relative to the mean over languages: an item equally common everywhere adds nothing
    return list(names), (out - out.mean(axis=1, keepdims=True) if languages else out)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, lang_pred, score per row of ``docs``; the model is broadcast (its size is bounded)."""
    schema = pa.schema([("id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def fn(batches):
        s = scorer(sent.value)
        for b in batches:
            got = [s.score(t) for t in b.column(1).to_pylist()]
            yield batch_of(schema, [b.column(0), [x[0] for x in got], [x[1] for x in got]])

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return map_batches(src, fn, "id long, lang_pred string, score double").withColumnRenamed("id", id_col)
