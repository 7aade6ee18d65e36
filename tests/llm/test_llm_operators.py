"""The operators on Spark: brute force, held-out accuracy, and the edge cases
(nulls in any column, empty and very long texts, ties and repeated rows, empty
tables, extra columns with clashing names)."""

import collections
import hashlib
import itertools
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
import tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from shoplens.llm import (byte_bpe, html_text, language, near_dup, nearest, packed_ids, packing, quality, token_counts,
                          toxicity)
from shoplens.llm import queries as Q
from tests.conftest import SF_SMALL

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
LONG = " ".join(f"word{i % 977} und{i % 13}." for i in range(60_000))
EDGE = [
    (1, None, None, None), (2, "", "en", "a"), (3, " \n\t ", "en", None), (4, "one", None, "a"),
    (5, LONG, "en", "a"), (6, LONG, "en", "b"), (7, "Same text here, twice.\nSame text here, twice.", "en", "a"),
    (7, "Same text here, twice.\nSame text here, twice.", "en", "a"), (None, "a row without an id but with text", "en", "a"),
    (None, None, None, None), (9, "a b c d e f g h " * 6, "de", "a"), (10, "漢字 ﬁ ✓ 😀 𝔘nicode ́ x", "zh", "a"),
]
CLASH = ["id", "t", "n", "w", "h", "row", "host", "fp", "words", "lines", "list", "vec", "rep", "key", "score", "length"]


@pytest.fixture(scope="module")
def edge(spark):
    df = spark.createDataFrame(EDGE, "doc_id long, text string, lang string, source string") \
        .withColumn("n_chars", F.length("text").cast("long")).repartition(3)
    return df.withColumns({c: F.lit(f"clash-{c}") for c in CLASH})


@pytest.fixture(scope="module")
def texts():
    t = pq.read_table(f"{SF_SMALL}/documents.parquet").to_pydict()
    return dict(zip(t["doc_id"], t["text"], strict=True))


def documents(spark):
    return spark.read.parquet(f"{SF_SMALL}/documents.parquet")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


EDGE_IDS = collections.Counter(r[0] for r in EDGE)


def ids_of(df, col="doc_id"):
    return collections.Counter(r[0] for r in df.select(col).collect())


def test_op1_edges(spark, edge):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = rows_of(token_counts.count_tokens(edge, PIECES, 4096))
    want = [(i, len((t or "").encode()), len(sp.encode(t or "")), len(sp.encode(t or "")) > 4096) for i, t, *_ in EDGE]
    assert got == sorted(want, key=repr)
    assert token_counts.count_tokens(edge.limit(0), PIECES, 5).count() == 0


def word_ids(text, end):
    tk = tokenizers.Tokenizer.from_file(WORDS)
    return np.array([*tk.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_op4_edges(spark, edge):
    got = [tuple(r) for r in packed_ids.write_and_read(spark, edge, WORDS, 2, 49_408).orderBy("start").collect()]
    assert [g[0] for g in got] == sorted((r[0] for r in EDGE), key=lambda x: (x is not None, x or 0))
    start = 0
    by_id = collections.defaultdict(list)
    for i, t, *_ in EDGE:
        by_id[i].append(t)
    for i, s, n, crc in got:
        assert s == start
        start += n
        assert (n, crc) in [(len(x), zlib.crc32(x.tobytes())) for x in (word_ids(t, 2) for t in by_id[i])]
    assert packed_ids.write_and_read(spark, edge.limit(0), WORDS, 2, 49_408).count() == 0


def test_op4_files_hold_minimum_bits(spark):
    manifest = packed_ids.write_packed(documents(spark), WORDS, 2, 49_408)
    m = manifest.collect()
    assert sum(r["n_docs"] for r in m) == documents(spark).count()
    for r in m:
        files, at = packed_ids.open_folder(r["path"])
        reader = packed_ids.Reader(files.open_input_file(at))
        assert reader.bits == 16 and reader.n_ids == r["n_ids"]
        assert reader.offsets[-1] - reader.offsets[0] == 2 * r["n_ids"]


def test_op7_edges_and_blocks(spark, edge):
    enc = byte_bpe.encoding(RANKS, public_tokenizers.PATTERN)
    want = sorted(((i, t, np.array(enc.encode_ordinary(t or ""), "<u4").tobytes()) for i, t, *_ in EDGE), key=repr)
    for block in (50, 8_000_000):
        got = byte_bpe.encode_documents(edge, RANKS, public_tokenizers.PATTERN, block_chars=block).collect()
        assert sorted(((r[0], bytes(r[1])) for r in got), key=repr) == sorted(((i, x) for i, _, x in want), key=repr)
        assert sorted(hashlib.sha256(bytes(r[2])).hexdigest() for r in got) == \
            sorted(hashlib.sha256((t or "").encode()).hexdigest() for _, t, _ in want)
    assert byte_bpe.encode_digests(edge.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def check_packed(rows, capacity):
    held = collections.defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for v in held.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= capacity
    return len(held), sum(r["length"] for r in rows)


def test_op8_edges(spark, edge):
    rows = packing.pack_documents(edge, WORDS, 0, 2048).collect()
    pieces = collections.defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    for i, t, *_ in EDGE:
        if EDGE_IDS[i] == 1:
            ids = word_ids(t, 0)
            assert sorted(pieces[i]) == [(k // 2048, k, len(ids[k:k + 2048]), zlib.crc32(ids[k:k + 2048].tobytes()))
                                         for k in range(0, len(ids), 2048)]
    n, total = check_packed(rows, 2048)
    assert n <= -(-total // 2048) + 1
    assert packing.pack_documents(edge.limit(0), WORDS, 0, 2048).count() == 0


def test_op8_groups(spark):
    rows = packing.pack_documents(documents(spark), WORDS, 0, 2048, group_rows=50).collect()
    n, total = check_packed(rows, 2048)
    assert len({r["sequence_id"] >> 40 for r in rows}) > 2
    assert n <= -(-total // 2048) + 8


def test_op2_edges_and_accuracy(spark, edge):
    model = language.learn(documents(spark).filter(Q.fold(4) != 2))
    got = {r[0]: r for r in language.identify(documents(spark), model).collect()}
    truth = {r["doc_id"]: (r["lang"], r["h"]) for r in documents(spark).withColumn("h", Q.fold(4) == 2).collect()}
    held = [i for i, (_, h) in truth.items() if h]
    assert sum(got[i]["lang_pred"] == truth[i][0] for i in held) >= 0.97 * len(held)
    out = language.identify(edge, model).collect()
    assert ids_of(language.identify(edge, model)) == EDGE_IDS
    assert all(0 <= r["score"] <= 1 for r in out)
    assert all((r["lang_pred"], r["score"]) == ("und", 0.0) for r in out if r["doc_id"] in (1, 2, 3))
    nothing = language.learn(edge.filter("false"))
    assert {r["lang_pred"] for r in language.identify(edge, nothing).collect()} == {"und"}


def test_op2_backs_off_to_shorter_grams():
    rows = np.array([[1.0, -1.0], [-1.0, 1.0]])
    m = language.Model(["a", "b"], {"known": 0}, rows, {"_xyz": 1, "q": 0}, rows)
    assert m.vector("known").tolist() == [1.0, -1.0]
    assert m.vector("xyzk").tolist() == pytest.approx([-language.DISCOUNT, language.DISCOUNT])  # length 4, one step
    assert m.vector("qqq").tolist() == pytest.approx([language.DISCOUNT ** 4, -language.DISCOUNT ** 4])
    assert m.vector("ü").tolist() == [0, 0]


def test_op3_learns_from_document_labels(spark, edge):
    rng = np.random.default_rng(1)
    filler = [f"w{i}" for i in range(60)]

    def sentence(bad):
        s = rng.choice(filler, 8).tolist()
        return " ".join([*s[:4], *(["vilest"] if bad else []), *s[4:]])

    docs = [(i, ". ".join(sentence(i % 4 == 0 and k == i % 5) for k in range(5)), int(i % 4 == 0)) for i in range(400)]
    d = spark.createDataFrame([x[:2] for x in docs], "doc_id long, text string")
    labels = spark.createDataFrame([(x[0], x[2]) for x in docs if x[0] % 5] + [(1, None), (None, 1), (4, 0)],
                                   "doc_id long, toxic int")
    model = toxicity.learn(d, labels)
    got = {r["doc_id"]: r for r in toxicity.score_documents(d, model).collect()}
    assert all((got[i]["score"] >= 0.5) == bool(y) for i, _, y in docs)
    assert all(got[i]["worst_sentence"] == i % 5 for i, _, y in docs if y)  # the sentence is located
    assert [s for s, _ in toxicity.locate(docs[4][1], model)] == [docs[4][1].split(". ")[4].lower()] or \
        len(toxicity.locate(docs[4][1], model)) == 1
    out = toxicity.score_documents(edge, model)
    assert ids_of(out) == EDGE_IDS
    assert all(0 <= r["score"] <= 1 for r in out.collect())
    assert {r["score"] for r in out.collect() if r["doc_id"] in (1, 2, 3)} == {0.0}
    none = toxicity.learn(d, labels.limit(0))
    assert all(r["score"] < 1e-9 for r in toxicity.score_documents(edge, none).collect())
    kept = toxicity.clean_documents(edge, model)
    assert kept.columns == edge.columns
    assert kept.count() == sum(r["score"] < 0.5 for r in out.collect())


def test_op3_length_alone_is_not_toxic(spark):
    docs = [(i, "one two three. " * 4 + ("a vilest word." if i % 4 == 0 else "a lovely word.")) for i in range(400)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    model = toxicity.learn(d, spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in docs], "doc_id long, toxic int"))
    long = [(1, "one two three. " * 300_000), (2, "a lovely word. " * 300_000), (3, "one two three. " * 300_000 + "vilest."),
            (4, "one two three.")]
    long = spark.createDataFrame(long, "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in toxicity.score_documents(long, model).collect()}
    assert got[1] == got[4] < 0.5 and got[2] < 0.5 <= got[3]
    assert {r["doc_id"] for r in toxicity.clean_documents(long, model).select("doc_id").collect()} == {1, 2, 4}


def test_op5_edges(spark, edge):
    got = collections.defaultdict(list)
    for r in quality.judge(edge).collect():
        got[r["doc_id"]].append(r)
    assert {k: len(v) for k, v in got.items()} == dict(EDGE_IDS)
    assert all(got[i][0]["n_words"] == 0 and not got[i][0]["kept"] for i in (1, 2, 3))
    assert got[7][0]["n_dup_lines"] == 1 and got[7][0] == got[7][1]
    r = got[9][0]
    assert (r["n_words"], r["n_repeat_words"], r["base_failed"]) == (48, 48, True)
    assert quality.judge(edge.limit(0)).count() == 0
    assert quality.good_documents(edge.limit(0)).columns == edge.columns


def test_op5_depleted_documents(spark):
    line = "this line stands in very many documents of the host and says nothing of its own at all, really"
    docs = [(i, f"{line}\nown words {' '.join(f'x{i}y{k}' for k in range(3))}", "h") for i in range(30)]
    docs += [(100 + i, f"{' '.join(f'z{i}q{k}' for k in range(40))}", "h") for i in range(10)]
    docs += [(200 + i, "\n".join([line, *(f"{j} copies " + " ".join(f"{j}c{k}" for k in range(25)) for j in "ab")]), "h")
             for i in range(30)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in quality.judge(d).collect()}
    assert [got[i] for i in range(30) if got[i]["kept"] or got[i]["base_failed"]] == []
    assert all(got[i]["kept"] for i in range(100, 110))
    assert all(got[i]["kept"] and got[i]["n_removed_words"] == 19 for i in range(200, 230))  # copies are one text
    assert {r["doc_id"] for r in quality.good_documents(d).collect()} == {i for i in got if got[i]["kept"]}


def test_op6_edges(spark):
    pages = spark.createDataFrame(
        [(1, "u", None, "x"), (2, None, "", "x"), (None, "v", "<article><p>A &lt; b</p></article>", "x"),
         (4, "w", "<p>" + LONG + "</p>", "x"), (4, "w", "<p>" + LONG + "</p>", "x")],
        "page_id long, url string, html string, text string").withColumn("n_chars", F.lit(-1))
    got = rows_of(html_text.extract_text(pages))
    assert got == sorted([(1, "u", "", 0), (2, None, "", 0), (None, "v", "A < b", 5), (4, "w", LONG, len(LONG)),
                          (4, "w", LONG, len(LONG))], key=repr)
    assert html_text.extract_text(pages.limit(0)).count() == 0


def exact_nearest(ids, x, q, k):
    d = np.sqrt(((x - x[ids.index(q)]) ** 2).sum(1))
    order = sorted((d[j], i) for j, i in enumerate(ids) if i != q)
    return [i for _, i in order[:k]], [s for s, _ in order[:k]]


def test_op9_recall_and_scores(spark):
    t = pq.read_table(f"{SF_SMALL}/embeddings.parquet").to_pydict()
    ids, x = t["vec_id"], np.array(t["embedding"], float)
    got = collections.defaultdict(dict)
    for r in Q.QUERIES["op9_nearest"](spark, SF_SMALL).collect():
        got[r["query_id"]][r["rank"]] = (r["vec_id"], r["score"])
    hit = 0
    for q in (i for i in ids if i % 100 == 0):
        want, scores = exact_nearest(ids, x, q, 10)
        assert sorted(got[q]) == list(range(1, 11))
        hit += len({v for v, _ in got[q].values()} & set(want))
        full = {i: s for s, i in sorted((float(np.sqrt(((x[j] - x[ids.index(q)]) ** 2).sum())), i)
                                        for j, i in enumerate(ids))}
        assert all(s == full[v] for v, s in got[q].values())
    assert hit >= 0.9 * 10 * len(got)


def test_op9_many_lists_and_a_common_vector(spark, monkeypatch):
    monkeypatch.setattr(nearest, "CHUNK", 64)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 8))
    x[1000:1600] = x[0]  # one vector 601 times
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in nearest.nearest(df, F.col("id") % 100 == 0, list_size=100).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    assert got[0] == list(range(1000, 1010))  # ties go to smaller ids
    assert got[1100] == [0, *range(1000, 1009)]
    hit = sum(len(set(v) & set(exact_nearest(list(range(3000)), x, q, 10)[0])) for q, v in got.items())
    assert hit >= 0.9 * 10 * 30


def test_op9_recall_with_a_thousand_lists(spark):
    x = np.random.default_rng(5).normal(size=(20000, 64))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in nearest.nearest(df, F.col("id") % 400 == 0, list_size=16).collect():
        got[r["query_id"]].append(r["vec_id"])
    hit = sum(len(set(v) & set(exact_nearest(list(range(20000)), x, q, 10)[0])) for q, v in got.items())
    assert hit >= 0.9 * 10 * 50


def test_op9_query_blocks(spark, monkeypatch):
    x = np.random.default_rng(6).normal(size=(2000, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    want = rows_of(nearest.nearest(df, F.col("id") % 10 == 0, list_size=100))
    monkeypatch.setattr(nearest, "QUERIES", 60)
    assert rows_of(nearest.nearest(df, F.col("id") % 10 == 0, list_size=100)) == want
    assert len(want) == 2000


def test_op9_outlier_and_a_small_group_of_copies(spark):
    x = np.random.default_rng(7).normal(size=(3000, 8))
    x[0] = 500.0  # alone
    x[[100, 101, 102, 103, 104]] = -300.0  # five copies
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in nearest.nearest(df, F.col("id") % 100 == 0, list_size=30).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    assert sorted(got) == list(range(0, 3000, 100)) and {len(v) for v in got.values()} == {10}
    for q in (0, 100):
        assert got[q] == exact_nearest(list(range(3000)), x, q, 10)[0]
    small = df.filter("vec_id < 8")
    assert nearest.nearest(small, F.col("id") == 0, list_size=1).count() == 7


def test_op9_edges(spark):
    rows = [(0, [1.0, 0.0], "x"), (1, [1.0, 0.0], "x"), (2, None, "x"), (3, [0.0, 0.0], "x"), (4, [float("nan"), 1.0], "x"),
            (5, [None, 1.0], "x"), (6, [1.0, 2.0, 3.0], "x"), (7, [0.0, 1.0], "x"), (7, [0.0, 1.0], "x"),
            (None, [1.0, 1.0], "x"), (8, [float("inf"), 0.0], "x"), (100, [1.0, 0.0], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, id string")
    got = rows_of(nearest.nearest(df, F.col("id") % 100 == 0))
    assert got == [(0, 1, 1, 0.0), (0, 2, 100, 0.0), (0, 3, 7, 2 ** 0.5), (100, 1, 0, 0.0), (100, 2, 1, 0.0),
                   (100, 3, 7, 2 ** 0.5)]
    assert nearest.nearest(df.limit(0), F.col("id") % 100 == 0).count() == 0


def brute_components(docs, percent=85):
    sets, parent = {}, {}
    for i, t in docs.items():
        w = (t or "").encode().lower().split()
        sets[i] = set(zip(*[w[k:] for k in range(5)])) if len(w) >= 5 else ({tuple(w)} if w else set())
        parent[i] = i

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in itertools.combinations(sorted(i for i in docs if sets[i]), 2):
        n, m = len(sets[a]), len(sets[b])
        if 100 * min(n, m) >= percent * max(n, m):
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (n + m - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in docs}


def copies():
    """Groups of copies: exact, near the threshold, chains, a passage shared by many short texts."""
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(3000)]
    docs = {}
    for g in range(6):
        base = rng.choice(words, 150 + 500 * (g == 5)).tolist()
        for c in range(40):
            t = list(base)
            for _ in range(rng.integers(0, 9)):
                t[rng.integers(0, len(t))] = str(rng.choice(words))
            docs[len(docs) * 3] = " ".join(t)
    shared = rng.choice(words, 60).tolist()
    for _ in range(80):
        docs[len(docs) * 3] = " ".join([*shared, *rng.choice(words, 25).tolist()])
    for n in range(1, 12):
        docs[len(docs) * 3] = " ".join(words[:n])
        docs[len(docs) * 3] = " ".join([*words[:n], "end"])
    return docs


@pytest.mark.parametrize("short,block,big", [(16, 2048, 512), (2, 7, 512), (2, 20, 60)])
def test_op10_against_brute_force(spark, monkeypatch, short, block, big):
    """Every path: rows for short lists, blocks, and sets larger than the sketches in the blocks."""
    monkeypatch.setattr(near_dup, "SHORT", short)
    monkeypatch.setattr(near_dup, "BLOCK", block)
    monkeypatch.setattr(near_dup, "BIG", big)
    monkeypatch.setattr(near_dup, "BIG_MARGIN", 0.08 if big > 100 else 0.25)
    docs = copies()
    df = spark.createDataFrame(sorted(docs.items()), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dup.near_duplicates(df).collect()}
    assert got == {i: (n, c, c == i) for i, (n, c) in brute_components(docs).items()}


def test_op10_on_documents(spark, texts):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"])
           for r in Q.QUERIES["op10_near_dup"](spark, SF_SMALL).collect()}
    assert got == brute_components(texts)


def test_op10_edges(spark, edge):
    got = sorted((tuple(r) for r in near_dup.near_duplicates(edge).collect()), key=repr)
    by = collections.defaultdict(list)
    for r in got:
        by[r[0]].append(r[1:])
    assert {k: len(v) for k, v in by.items()} == dict(EDGE_IDS)
    assert by[5][0][1] == by[6][0][1] == 5 and by[6][0][2] is False
    assert all(by[i] == [(0, i, True)] for i in (1, 2, 3)) and by[4] == [(1, 4, True)]
    assert by[7] == [by[7][0]] * 2 and all(r[1] is None and r[2] is True for r in by[None])
    assert near_dup.near_duplicates(edge.limit(0)).count() == 0
    left = near_dup.one_of_each(edge)
    assert left.columns == edge.columns
    assert ids_of(left) == collections.Counter({i: 1 for i in EDGE_IDS if i not in (6, None)}) + \
        collections.Counter({None: EDGE_IDS[None]})


def test_pipeline_against_brute_force(spark, texts):
    docs = documents(spark)
    kept = {r["doc_id"] for r in quality.judge(docs).filter("kept").collect()}
    one = corpus_pipeline.quality_rules(spark, docs, SF_SMALL)
    assert one.columns == docs.columns and {r["doc_id"] for r in one.collect()} == kept
    two = corpus_pipeline.toxic_documents(spark, one, SF_SMALL)
    assert two.columns == docs.columns
    clean = {r["doc_id"] for r in two.collect()}
    assert clean <= kept and len(clean) >= 0.8 * len(kept)
    three = corpus_pipeline.near_duplicates(spark, two, SF_SMALL)
    assert three.columns == docs.columns
    alone = {i for i, (_, c) in brute_components({i: texts[i] for i in clean}).items() if c == i}
    assert {r["doc_id"] for r in three.collect()} == alone
    rows = corpus_pipeline.pack(spark, three, SF_SMALL).collect()
    assert {r["doc_id"] for r in rows} == alone
    assert sum(r["length"] for r in rows) == sum(len(word_ids(texts[i], 0)) for i in alone)


def test_pipeline_runs(spark):
    out = corpus_pipeline.run(spark, SF_SMALL)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert out.count() > 0


def test_stages_take_clashing_columns(spark, edge):
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, edge, SF_SMALL)
        assert out.columns == edge.columns, name
        assert out.count() <= len(EDGE)
        assert stage(spark, edge.limit(0), SF_SMALL).count() == 0
