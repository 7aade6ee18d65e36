"""Inputs of unrepeatable order, quotas, long documents, paths, argument bounds."""

import random
import struct
import time

import public_tokenizers
import pytest
import regex
import tiktoken  # noqa: F401  the library op7 is held against
from pyspark.sql import functions as F

from shoplens.llm import byte_bpe, html_text, language, near_dup, packed_ids, packing
from tests.conftest import SF_SMALL

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def test_byte_bpe_takes_rows_in_an_order_that_does_not_repeat(spark):
    def shuffled(batches):
        for b in batches:
            yield b.sample(frac=1.0)  # another order at every reading

    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    moving = docs.repartition(3).mapInPandas(shuffled, "doc_id long, text string")
    enc = byte_bpe.encoding(RANKS, public_tokenizers.PATTERN)
    got = {r["doc_id"]: r["ids"] for r in byte_bpe.encode_documents(moving, RANKS, public_tokenizers.PATTERN, block_chars=20_000).collect()}
    for r in docs.collect():
        ids = enc.encode_ordinary(r["text"] or "")
        assert bytes(got[r["doc_id"]]) == struct.pack(f"<{len(ids)}I", *ids)


def test_cut_follows_the_pattern_it_is_given():
    for pattern in (r"\w+|\W+", r"[a-z]+ ?|.", r"\d|\D+"):
        for text in ("it's 10 o'clock, d'accord?", "a1b22 c333"):
            assert byte_bpe.cut(text, pattern) == regex.findall(pattern, text)


def test_full_pieces_are_sequences_without_a_group(spark):
    schema = "id long, piece int, start long, length long, ids_crc32 long"
    full = [(i, 0, 0, 64, i) for i in range(1_000)]
    part = [(5_000 + i, 0, 0, 1 + i % 63, i) for i in range(200)]
    same = [(9_000, 0, 0, 40, 7)] * 200
    pieces = packing.stored(spark.createDataFrame(full + part + same, schema).repartition(4), "test-pieces")
    rows = packing.pack_pieces(pieces, 64, group_rows=10).collect()
    assert len(rows) == 1_400
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sum(len(v) == 1 and v[0] == (0, 64) for v in by.values()) >= 1_000
    for v in by.values():
        end = 0
        for offset, length in sorted(v):
            assert offset == end
            end += length
        assert end <= 64
    assert len({r["sequence_id"] for r in rows if r["length"] == 64}) == 1_000
    groups = {r["sequence_id"] >> 40 for r in rows if r["length"] < 64}
    assert len(groups) > 20 and len({r["sequence_id"] >> 40 for r in rows if r["id"] == 9_000}) > 10


def test_paths_without_a_scheme_lie_in_the_default_file_system(spark):
    conf = spark.sparkContext._jvm.org.apache.hadoop.conf.Configuration(False)
    conf.set("fs.defaultFS", "viewfs://store/")
    conf.set("fs.viewfs.mounttable.store.link./in", "file:///tmp")
    assert packed_ids.qualified(spark, "/in/x", conf) == "viewfs://store/in/x"
    assert packed_ids.qualified(spark, "/in/x") == "file:///in/x"
    assert packed_ids.qualified(spark, "file:/in/x", conf) == "file:///in/x"


def invented(letters, n, rng):
    return [" ".join("".join(rng.choice(letters) for _ in range(rng.randint(4, 9))) for _ in range(12)) for _ in range(n)]


def test_a_small_language_keeps_its_words(spark):
    rng = random.Random(5)
    small = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(40)]  # both use the same letters
    rows = [(i, t, "big") for i, t in enumerate(invented("abcdefgh", 1_500, rng))]
    rows += [(10_000 + i, " ".join(rng.choice(small) for _ in range(12)), "small") for i in range(15)]
    model = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), max_words=400)
    assert sum(w in model.words for w in small) >= 35 and len(model.words) <= 400
    tests = [(i, " ".join(rng.choice(small) for _ in range(12))) for i in range(60)]
    got = language.identify(spark.createDataFrame(tests, "doc_id long, text string"), model).collect()
    assert sum(r["lang_pred"] == "small" for r in got) >= 58
    assert language.shares({"a": 5, "b": 100, "c": 100}, 45) == {"a": 5, "b": 20, "c": 20}
    assert language.shares({"a": 5}, 45) == {"a": 5} and language.shares({}, 45) == {}


def test_learning_counts_equal_plain_counts(spark):
    rows = [(1, "Aa bb aa", "x"), (2, "bb cc", "y"), (3, None, "x"), (4, "zz", None), (None, "qq", "x")]
    model = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ["x", "y"] and set(model.words) == {"aa", "bb", "cc"}
    assert "_a" in model.grams and "qq" not in model.grams


def test_similarity_below_the_sketches_bound_is_refused(spark):
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    for percent in (50, 84, 101):
        with pytest.raises(ValueError):
            near_dup.near_duplicates(docs, percent=percent)
    assert near_dup.near_duplicates(docs, percent=100).count() == 1
    assert docs.filter(F.lit(False)).count() == 0


LEAD = "<article><p>" + "lead " * 60 + "</p>"


@pytest.mark.parametrize(("inner", "line"), [
    ("<p>Hello <button>x</button>world</p>", "Hello world"),
    ("<p>Hello<script>x()</script> world</p>", "Hello world"),
    ("<p>Hello <span class='share'>Share this</span> world</p>", "Hello world"),
    ("<p>Hel<style>p{}</style>lo</p>", "Hello"),
    ("<p>one</p><button>x</button><p>two</p>", "one\ntwo"),
    ("<section id='side-effects'><p>" + "effect " * 70 + "</p></section>", ("effect " * 70).strip()),
])
def test_inline_elements_that_are_skipped_do_not_cut_a_block(inner, line):
    assert html_text.main_text(LEAD + inner + "</article>") == ("lead " * 60).strip() + "\n" + line


def test_a_header_inside_main_belongs_to_the_article():
    page = "<header><h1>Site</h1></header><main><header><h1>Title</h1></header><p>" + "word " * 80 + "</p></main>"
    assert html_text.main_text(page) == "Title\n" + ("word " * 80).strip()


def test_deep_nesting_takes_linear_time():
    for tag in ("<div>", "<div class='share'>"):
        began = time.process_time()
        n = 200_000 if tag == "<div>" else 4_000
        assert html_text.main_text(tag * n + "some text" + "</div>" * n + "</p>" * n) == "some text"
        assert time.process_time() - began < 20
