"""Local functions of the operators against the libraries and brute force; no Spark."""

import random
import re

import numpy as np
import public_tokenizers
import pytest
import regex
import sentencepiece
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from shoplens.llm import byte_bpe, html_text, near_dup, packed_ids, packing, token_counts, word_bpe

ALPHABET = [*"abcdeé \n\n\t▁'.,1230ß漢字 ​😀\x1c\x1f\x85́ΣςİĳA<|>s\r\x00—", "  ", "the ", " \n", "<s>", "</s>", "<unk>",
            "<0x0A>", "<|endoftext|>", "'s", "'ll", "don", "12", "  ▁", "   "]
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def some_texts(n, seed, longest=14):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, longest))) for _ in range(n)]


def test_token_counts_equal_the_library():
    c = token_counts.counter(public_tokenizers.path("piece_bpe_32k.model"))
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = [*some_texts(5000, 1), "", " ", "\n", "word " * 3000, "x" * 5000, None]
    assert [c.count(t) for t in texts] == [len(sp.encode(t or "")) for t in texts]


def test_whole_tokens_are_proved():
    c = token_counts.counter(public_tokenizers.path("piece_bpe_32k.model"))
    assert len(c.proved) > 10_000
    assert all(len(c.sp.encode(w)) == 1 for w in random.Random(2).sample(sorted(c.proved), 500))


def test_token_counts_survive_a_full_memory(monkeypatch):
    monkeypatch.setattr(token_counts, "MEMORY_ENTRIES", 10)
    c = token_counts.Counter(public_tokenizers.path("piece_bpe_32k.model"))
    for t in some_texts(200, 3):
        assert c.count(t) == len(c.sp.encode(t))


def test_word_ids_equal_the_library():
    w = word_bpe.chunk_ids(WORD_BPE)
    for t in [*some_texts(5000, 4), "", "Grüße Straße ÀÉ", "don't we'll", "a<|endoftext|>b"]:
        assert w.encode(t) == w.whole(t)


@pytest.mark.parametrize("bits", [1, 3, 8, 13, 16, 17, 31, 32])
def test_packing_round_trip(bits):
    rng = np.random.default_rng(bits)
    for n in (0, 1, 7, 8, 9, 1000):
        ids = rng.integers(0, 2 ** bits, n, dtype=np.uint64).astype("<u4")
        data = packed_ids.pack(ids, bits)
        assert len(data) == -(-n * bits // 8)
        assert (packed_ids.unpack(data, bits, n) == ids).all()


def test_ids_beyond_the_width_are_refused():
    with pytest.raises(ValueError):
        packed_ids.pack(np.array([8], "<u4"), 3)
    assert packed_ids.bits_for(49_408) == 16 and packed_ids.bits_for(1) == 1 and packed_ids.bits_for(32_000) == 15


def test_packed_file_random_access(tmp_path, monkeypatch):
    from pyarrow import fs
    monkeypatch.setattr(packed_ids, "BLOCK_IDS", 16)
    rng = np.random.default_rng(5)
    docs = [rng.integers(0, 5000, n).astype("<u4") for n in (0, 3, 50, 1, 200, 16)]
    files = fs.LocalFileSystem()
    w = packed_ids.Writer(files.open_output_stream(str(tmp_path / "a.ids")), 13)
    for i, d in enumerate(docs):
        w.add(None if i == 1 else i, d.tobytes())
    w.close()
    r = packed_ids.Reader(files.open_input_file(str(tmp_path / "a.ids")))
    flat = np.concatenate(docs)
    assert r.n_ids == len(flat) and r.named.tolist() == [True, False, True, True, True, True]
    for a, z in ((0, 0), (0, 270), (5, 6), (15, 17), (60, 200), (269, 270)):
        assert (r.ids(a, z) == flat[a:z]).all()
    assert (np.concatenate([x for _, _, x in r.runs()]) == flat).all()


@given(st.lists(st.integers(1, 64), max_size=200))
@settings(max_examples=60, deadline=None)
def test_sum_of_squares_packs_without_gaps(lengths):
    lengths = np.array(sorted(lengths, reverse=True), np.int64)
    bins, offsets = packing.sum_of_squares(lengths, 64)
    held = {}
    for b, o, n in sorted(zip(bins.tolist(), offsets.tolist(), lengths.tolist(), strict=True)):
        assert held.get(b, 0) == o
        held[b] = o + n
        assert held[b] <= 64
    # never a new bin while two halves fit together
    assert sum(v <= 32 for v in held.values()) <= 1


def test_sum_of_squares_follows_its_rule():
    # gaps after 6, 6, 5 of 10: 4, 4, 5.  A piece of 4: filling a gap of 4 takes 2*2-1 from the sum, using the
    # gap of 5 adds one bin of gap 1 and takes one of 5: no change.  So a gap of 4 is filled.
    bins, offsets = packing.sum_of_squares(np.array([6, 6, 5, 4]), 10)
    assert offsets.tolist() == [0, 0, 0, 6] and bins.tolist()[3] in (0, 1)


def test_pretokens_equal_the_pattern():
    pat = regex.compile(public_tokenizers.PATTERN)
    for t in [*some_texts(3000, 6), "ȀɏƻǀÿÀ×÷ªº", "a\xa0b c"]:
        clean = t.replace("\x1c", " ").replace("\x1f", " ")  # the regex module calls these white space
        assert byte_bpe.cut(clean, public_tokenizers.PATTERN) == pat.findall(clean)


def test_words_encode_as_in_the_whole_text():
    enc = byte_bpe.encoding(RANKS, public_tokenizers.PATTERN)
    table = byte_bpe.token_bytes(RANKS, public_tokenizers.PATTERN)
    for t in some_texts(3000, 7):
        ids = [i for w in byte_bpe.cut(t, public_tokenizers.PATTERN) for i in enc.encode_ordinary(w)]
        assert ids == enc.encode_ordinary(t)
        assert b"".join(table[i] for i in ids) == t.encode()
    assert isinstance(enc, tiktoken.Encoding)


def test_squeezed_numbers():
    for n in (0, 1, 1000):
        a = np.random.default_rng(n).integers(0, 2 ** 32, n).astype("<u4")
        assert (byte_bpe.expand(byte_bpe.squeeze(a)) == a).all()


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>x</p>";</script></head><body>
<header><h1>Site name</h1></header><nav><ul><li><a href="/a">Menu one</a></li><li><a href="/b">Menu two</a></li></ul></nav>
<div class="cookie-notice">We use cookies on this site to make it better for you, please accept them all.</div>
<div id="content"><article><header><h1>The &amp; title</h1></header>
<p>First  long paragraph of the article\nwith several words and a <a href="x">link inside</a> it.
<p>Short.<p>Another rather long paragraph with enough words in it to look like running text, really.</p>
<div class="ad-box">Buy our things now, they are cheap and good and everybody has them already.</div>
<form><label>Mail</label><input><button>Go</button></form>
<ul><li>Point one</li><li>Point&nbsp;two</li></ul></article>
<section class="comments"><p>A reader says something long about the article here, with many words.</p></section></div>
<aside><p>Read more of our other long articles in the side bar, there are many of them.</p></aside>
<footer>&copy; all rights</footer></body></html>"""


def test_main_text_of_a_page():
    assert html_text.main_text(PAGE).split("\n") == [
        "The & title", "First long paragraph of the article with several words and a link inside it.", "Short.",
        "Another rather long paragraph with enough words in it to look like running text, really.",
        "Point one", "Point two"]


@pytest.mark.parametrize("html", [None, "", "   ", "<html></html>", "<nav>only a menu</nav>", "<!-- x", "<script>a"])
def test_pages_without_text(html):
    assert html_text.main_text(html) == ""


def sentence(n, word):
    return (" ".join([word] * n) + ".")[-n:]


A, B, C = sentence(300, "lead"), sentence(400, "body"), sentence(200, "rest")


@pytest.mark.parametrize("html", [
    f"<article><h1>T</h1><p>{A}</p><section><p>{B}</p></section></article>",
    f"<article><h1>T</h1><p>{A}</p><section><p>{B}{B}{B}</p></section><section><p>{C}</p></section><p>end</p></article>",
    f"<main><h1>T</h1><p>{A}</p><div><p>{B}{B}</p></div><table><tr><td>{C}</td></tr></table></main>",
    f"<main><h1>T</h1><p>{A}</p><article><p>{B}{B}</p></article></main>",
    f"<div><div><h1>T</h1><p>{A}</p></div><div><p>{B}{B}</p></div><div><p>{C}</p></div></div>",
    f"<div><article><h1>T</h1><p>{A}</p></article><article><p>{B}{B}</p></article></div>",
])
def test_an_article_in_parts_is_kept_whole(html):
    nav, foot = '<nav><a href="x">menu</a></nav>', "<footer>all rights of the site are reserved</footer>"
    got = html_text.main_text(f"<html><body>{nav}{html}{foot}</body></html>")
    for part in ("T", A, B, C, "end"):
        if f">{part}" in html:
            assert part in got
    assert "menu" not in got and "rights" not in got


def test_text_outside_the_article_is_left_out():
    teaser = f"<div><p>{C}</p></div>"
    assert html_text.main_text(f"<body>{teaser}<article><p>{A}</p><p>{B}</p></article>{teaser}</body>") == f"{A}\n{B}"


@pytest.mark.parametrize("html", [
    "<html><head><title>x</title><body>{}</body></html>", "<html><head><title>x</title>{}</html>",
    "<body class='no-sidebar'>{}</body>", "<div class='content with-sidebar'>{}</div>",
    "<main id='main-navigation-content'>{}</main>", "<article class='related-post'>{}</article>",
    "<div class='search-result-article'><article>{}</article></div>", "<body><form action='a.aspx'>{}</form></body>",
    "<form><div class='page-with-sidebar'>{}</div></form>",
])
def test_a_flag_does_not_empty_the_page(html):
    inner = f"<div class='ad'>Buy now</div><div><p>{A}</p><p>{B}</p></div><form><label>Mail</label></form>"
    assert html_text.main_text(html.format(inner)) == f"{A}\n{B}"


def test_long_comments_beside_an_article_stay_out():
    html = f"<body><article><p>{A}</p></article><div class='comments'><article><p>{B}{B}{C}</p></article></div></body>"
    assert html_text.main_text(html) == A


def test_odd_pages():
    assert html_text.main_text("plain text only") == "plain text only"
    assert html_text.main_text("</p></div>a &lt; b<br>c") == "a < b\nc"
    long = "<article>" + "<p>word word</p>" * 20_000 + "</article>"
    assert html_text.main_text(long).count("\n") == 19_999


def test_shingle_sets():
    assert len(near_dup.shingle_set(None)) == len(near_dup.shingle_set(" \n\t")) == 0
    assert len(near_dup.shingle_set("a b")) == 1
    assert (near_dup.shingle_set("A b C d E") == near_dup.shingle_set("a\tB\nc  d e")).all()
    assert len(near_dup.shingle_set("a b c d e f")) == 2
    assert len(near_dup.shingle_set("É b c d e") ) == 1 and \
        (near_dup.shingle_set("É b c d e") != near_dup.shingle_set("é b c d e")).all()  # only A-Z fold
    words = re.findall(r"\S+", "x y z " * 500)
    assert len(near_dup.shingle_set(" ".join(words))) == 3
