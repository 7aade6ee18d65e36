"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  A sentence's score is a logistic function of
its features (words, and word beginnings of three to five letters, each counted
once); the document's score is the noisy-or of its sentences' scores and a
constant floor.  In scoring, a sentence counts by what its features add to a
sentence without any, and not at all if they add nothing: a text is not toxic by
its length.  (The fit counts sentences without features; they settle the bias.
Left out, the bias rose from -8.7 to -0.8 and false alarms from 1 to 6 of 825.)  Only document labels are needed: the likelihood of the labels is
maximised through the noisy-or (Adam on all sampled documents), so the model
learns by itself which sentences make a document toxic, and scoring can name
them.

Learning uses a bounded sample of labelled documents (about ``max_docs``,
chosen by a hash of the id).  Document frequencies of the features by label are
counted in Spark; the ``max_features`` with the largest chi-square statistic
are kept, and only sentences that hold one reach the optimiser - all others
are counted.

Defined results: null or empty text has no sentences and score 0; documents
without labels of either class give a model that scores every text 0.  One
output row per input row.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter, OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplens.llm.common import batch_of, map_batches, stored

MAX_DOCS = 16_000
MAX_FEATURES = 4_096
MIN_DOCS = 5
MIN_CHI = 25.0  # beyond chance for a million features
CHUNK = 256
STEPS = 400
DECAY = 2e-5
PREFIXES = (3, 4, 5)
MEMORY_WORDS = 400_000
SENTENCE = re.compile(r"[.!?\n]+")
WORD = re.compile(r"[^\W\d_]+")


def features_of(word: str) -> list[str]:
    """The word itself, and its beginnings, marked by a trailing '^'."""
    return [word, *(word[:k] + "^" for k in PREFIXES if len(word) >= k)]


def sentences(text: str | None) -> list[str]:
    return [s for s in SENTENCE.split(text) if s.strip()] if text else []


class Model:
    def __init__(self, weights: dict[str, float], bias: float, floor: float):
        self.id = uuid.uuid4().hex
        self.weights, self.bias, self.floor = weights, bias, floor


class Scorer(dict):
    """Word -> tuple of the numbers of its known features; emptied when full."""

    def __init__(self, model: Model):
        super().__init__()
        self.names = {f: i for i, f in enumerate(sorted(model.weights))}
        self.values = [model.weights[f] for f in sorted(model.weights)]
        self.bias = model.bias
        self.rest, self.floor = softplus(model.bias), model.floor

    def __missing__(self, word: str) -> tuple:
        if len(self) >= MEMORY_WORDS:
            self.clear()
        known = self[word] = tuple(self.names[f] for f in features_of(word) if f in self.names)
        return known

    def score(self, text: str | None) -> tuple[float, int, float, int]:
        """Document score, number of sentences, largest sentence score, its sentence (-1: none)."""
        parts = sentences(text.lower()) if text else []
        total, top, where = self.floor if parts else 0.0, -math.inf, -1
        for k, s in enumerate(parts):
            held = set()
            for f in map(self.__getitem__, WORD.findall(s)):
                if f:
                    held.update(f)
            z = self.bias + sum(self.values[f] for f in sorted(held))
            total += max(0.0, softplus(z) - self.rest)
            if z > top:
                top, where = z, k
        return -math.expm1(-total), len(parts), 1 / (1 + math.exp(-top)) if where >= 0 and top > -700 else 0.0, where


def softplus(z: float) -> float:
    return math.log1p(math.exp(z)) if z < 30 else z


SCORERS: OrderedDict[str, Scorer] = OrderedDict()


def scorer(model: Model) -> Scorer:
    if model.id not in SCORERS:
        SCORERS[model.id] = Scorer(model)
        while len(SCORERS) > 2:
            SCORERS.popitem(last=False)
    return SCORERS[model.id]


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", max_docs: int = MAX_DOCS, max_features: int = MAX_FEATURES) -> Model:
    """Fit on about ``max_docs`` of the documents with a label (several labels: the highest)."""
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()) \
        .groupBy(F.col(id_col).alias("l_id")).agg(F.max(label_col).cast("int").alias("y"))
    share = min(1.0, max_docs / max(1, known.count()))
    known = known.filter(F.pmod(F.xxhash64(F.col("l_id").cast("string")), F.lit(1_000_000)) < round(share * 1_000_000))
    # about max_docs narrow rows, so they may be broadcast
    sample = stored(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
                    .join(F.broadcast(known), F.col("id") == F.col("l_id")).select("id", "text", "y"), "toxicity-sample")
    totals = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    if not n1 or not n0:
        return Model({}, -50.0, 0.0)

    count_schema = pa.schema([("f", pa.string()), ("c1", pa.int64()), ("c", pa.int64())])

    def count(batches):
        for b in batches:
            for at in range(0, b.num_rows, CHUNK):  # counts of a few hundred documents at a time
                part = b.slice(at, CHUNK)
                every, toxic = Counter(), Counter()
                for t, y in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    held = {f for w in set(WORD.findall((t or "").lower())) for f in features_of(w)}
                    every.update(held)
                    if y:
                        toxic.update(held)
                yield batch_of(count_schema, [list(every), [toxic[f] for f in every], list(every.values())])

    c1, c = F.sum("c1").cast("double"), F.sum("c").cast("double")
    # chi-square of the two-by-two table of feature and label
    expected = F.col("c") * n1 / (n0 + n1)
    kept = map_batches(sample.select("text", "y"), count, "f string, c1 long, c long").groupBy("f") \
        .agg(c1.alias("c1"), c.alias("c")).filter(F.col("c") >= MIN_DOCS) \
        .withColumn("x", (F.col("c1") - expected) ** 2 / (expected * (1 - F.col("c") / (n0 + n1 + 1.0)))) \
        .filter(F.col("x") >= MIN_CHI).orderBy(F.desc("x"), "f").limit(max_features).select("f").collect()
    names = sorted(r["f"] for r in kept)
    at = {f: i for i, f in enumerate(names)}

    bag_schema = pa.schema([("id", pa.int64()), ("y", pa.int32()), ("rest", pa.int32()), ("sizes", pa.binary()),
                            ("held", pa.binary())])

    def bags(batches):
        for b in batches:
            out = []
            for i, t, y in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                parts = sentences((t or "").lower())
                held = [sorted({at[f] for w in WORD.findall(s) for f in features_of(w) if f in at}) for s in parts]
                held = [h for h in held if h]
                out.append((i, y, len(parts) - len(held), np.array([len(h) for h in held], "<i4").tobytes(),
                            np.array([f for h in held for f in h], "<i4").tobytes()))
            yield batch_of(bag_schema, list(zip(*out)) if out else [[]] * 5)

    rows = map_batches(sample.select("id", "text", "y"), bags, "id long, y int, rest int, sizes binary, held binary") \
        .orderBy("id").collect()  # a bounded sample, as numbers of a bounded list of features
    return Model(*fit(names, rows))


def fit(names: list[str], rows) -> tuple[dict[str, float], float, float]:
    """Maximum likelihood of the labels under the noisy-or: weights, bias of a sentence, floor of
    a document (what the sentences of a mean document add without any feature)."""
    y = np.array([r["y"] for r in rows], float)
    rest = np.array([r["rest"] for r in rows], float)
    size = np.frombuffer(b"".join(r["sizes"] for r in rows), "<i4")
    col = np.frombuffer(b"".join(r["held"] for r in rows), "<i4")
    doc = np.repeat(np.arange(len(rows)), [len(r["sizes"]) // 4 for r in rows])
    n_held = len(size)
    row = np.repeat(np.arange(n_held), size)
    per_doc = max(1.0, (rest.sum() + n_held) / len(rows))
    w, bias = np.zeros(len(names)), math.log(y.mean() / per_doc)
    m, v = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    n = len(rows)
    for step in range(1, STEPS + 1):
        z = bias + np.bincount(row, w[col], n_held)
        p, p0 = 1 / (1 + np.exp(-z)), 1 / (1 + math.exp(-bias))
        s = np.bincount(doc, np.logaddexp(0, z), n) + rest * np.logaddexp(0, bias)
        # likelihood: -s for label 0, log(1 - exp(-s)) for label 1
        outer = np.where(y > 0, -1 / np.maximum(np.expm1(np.minimum(s, 50)), 1e-9), 1.0)
        dz = outer[doc] * p
        grad = np.append(np.bincount(col, dz[row], len(names)) / n + DECAY * w,
                         (dz.sum() + (outer * rest).sum() * p0) / n)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad ** 2
        step_by = 0.1 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
        w, bias = w - step_by[:-1], bias - step_by[-1]
    return {f: float(x) for f, x in zip(names, w, strict=True)}, float(bias), float(per_doc * softplus(bias))


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, score, n_sentences, worst_score, worst_sentence (number of the sentence that
    weighs most, from 0; -1 without any) per row of ``docs``."""
    schema = pa.schema([("id", pa.int64()), ("score", pa.float64()), ("n_sentences", pa.int32()),
                        ("worst_score", pa.float64()), ("worst_sentence", pa.int32())])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def fn(batches):
        s = scorer(sent.value)
        for b in batches:
            got = [s.score(t) for t in b.column(1).to_pylist()]
            yield batch_of(schema, [b.column(0), *([x[k] for x in got] for k in range(4))])

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return map_batches(src, fn, "id long, score double, n_sentences int, worst_score double, worst_sentence int") \
        .withColumnRenamed("id", id_col)


def clean_documents(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score stays below ``threshold``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def fn(batches):
        s = scorer(sent.value)
        for b in batches:
            yield b.filter(pa.array([s.score(t)[0] < threshold for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(fn, docs.schema)


def locate(text: str, model: Model, threshold: float = 0.5) -> list[tuple[str, float]]:
    """The sentences whose own score reaches ``threshold``, with their scores, in text order."""
    s, out = scorer(model), []
    for part in sentences(text):
        score, _, _, _ = s.score(part)
        if score >= threshold:
            out.append((part.strip(), score))
    return out
