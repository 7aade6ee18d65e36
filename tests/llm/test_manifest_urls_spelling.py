"""Merkle manifest, url rules and spelling variants against plain Python."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoplens.llm import merkle, spelling, url_filter
from shoplens.llm.common import stored
from tests.conftest import SF_SMALL

DOCS = "doc_id long, source string, lang string, n_chars long, text string"
CLASH = ["g", "o", "node", "keep", "seq", "tree", "idx", "host", "path", "keys", "at", "word", "n", "run", "h", "id", "sig",
         "role", "leaf", "seen", "found", "rule", "verdict", "key"]


def clashing(df):
    """The frame with further columns that have the operators' own names."""
    return df.withColumns({c: F.lit(f"clash-{c}") for c in CLASH if c not in df.columns})


def tuples(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# --- merkle -----------------------------------------------------------------


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def written(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels_of(nodes, arity):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i:i + arity]) for i in range(0, len(levels[-1]), arity)])
    return levels


def siblings(levels, i, arity):
    out = []
    for level in levels[:-1]:
        a = i // arity * arity
        out.append(("".join(level[a:i]), "".join(level[i + 1:a + arity])))
        i //= arity
    return out


def plain_manifest(rows, arity=3):
    by = collections.defaultdict(list)
    for r in rows:
        by[r[1]].append(r)
    trees = {}
    for s, rs in by.items():
        leaves = sorted(((r[0] is not None, r[0] or 0, h(*map(written, r)), r) for r in rs), key=lambda x: x[:3])
        trees[s] = leaves, levels_of([x[2] for x in leaves], arity)
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    top = levels_of([trees[s][1][-1][0] for s in order], arity)
    out = []
    for k, s in enumerate(order):
        leaves, levels = trees[s]
        for i, (_, _, leaf, r) in enumerate(leaves):
            proof = siblings(levels, i, arity) + siblings(top, k, arity)
            node = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                node = h(*map(written, (*r[:4], None if r[4] is None else r[4].replace("\n", ""))))
            for left, right in proof:
                node = h(left, node, right)
            out.append((r[0], leaf, levels[-1][0], top[-1][0], h(*[a + b for a, b in proof]), node, node == top[-1][0]))
    return sorted(out, key=str)


def odd_rows():
    rng = random.Random(1)
    rows = [(rng.choice([None, rng.randint(-5, 300)]), rng.choice([None, "a", "b", "", "é", *["hot"] * 5, f"s{rng.randint(0, 60)}"]),
             rng.choice([None, "x"]), rng.choice([None, 3]), rng.choice([None, "", "a\nb", "\n", "é\n\n"])) for _ in range(500)]
    return rows + [(10**6 + i, "big", "en", 1, "t\n") for i in range(250)] + [(7, "twice", "en", 1, "x" * 100_000 + "\n")] * 2


@pytest.mark.parametrize(("arity", "every"), [(3, 3), (2, 1), (5, 2)])
def test_manifest_equals_plain_trees(spark, arity, every):
    rows = odd_rows()
    docs = clashing(spark.createDataFrame(rows, DOCS).repartition(5))
    assert tuples(merkle.verified_manifest(docs, arity, every)) == plain_manifest(rows, arity)


def test_manifest_of_given_documents_finds_every_changed_text(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = tuples(merkle.verified_manifest(docs))
    assert got == plain_manifest(rows)
    changed = {r[0] for r in rows if zlib.crc32(str(r[0]).encode()) % 2 == 0 and "\n" in (r[4] or "")}
    assert {r[0] for r in got if not r[6]} == changed and changed


def test_manifest_of_few_rows(spark):
    rows = odd_rows()
    assert merkle.verified_manifest(spark.createDataFrame([], DOCS)).collect() == []
    for part in (rows[:1], rows[:2], [rows[0]] * 4):
        assert tuples(merkle.verified_manifest(spark.createDataFrame(part, DOCS))) == plain_manifest(part)
    with pytest.raises(ValueError):
        merkle.verified_manifest(spark.createDataFrame([], DOCS), arity=1)


def test_manifest_stores_only_every_third_level(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(merkle, "stored", lambda df, name, f=merkle.stored: kept.append((name, f(df, name))) or kept[-1][1])
    docs = spark.range(900).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("en").alias("lang"),
                                   F.lit(1).cast("long").alias("n_chars"), F.lit("t").alias("text"))
    merkle.verified_manifest(docs).collect()
    sizes = {name: df.count() for name, df in kept if name.startswith("merkle-level") and df.count()}
    assert sizes["merkle-level-3"] >= 1 and [df.count() for n, df in kept if n == "merkle-level-3"][0] == 34
    assert set(sizes) <= {"merkle-level-3", "merkle-level-6", "merkle-level-9"}


# --- urls -------------------------------------------------------------------

RULES = "host string, path string, verdict string"
LABELS = ["a", "b", "c", "co", "aa", ""]
PATHS = ["", "/", "/a", "/a/", "/ab/c", "/x/"]


def random_host(rng):
    return ".".join(rng.choice(LABELS) for _ in range(rng.randint(1, 5)))


def plain_verdict(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1])
        host, path = m[1].translate({c: c + 32 for c in range(65, 91)}), m[2]
    best = None
    for a, b, verdict in rules:
        b = b or ""
        if not a or set(a) & set("/?#") or not (b == "" or b.startswith("/")):
            continue
        if (host == a or host.endswith("." + a)) and path.startswith(b):
            key = len(a) + len(b), len(a), verdict == "block"
            if best is None or key > best[0]:
                best = key, a + b, verdict
    return (host, path, best[1], best[2]) if best else (host, path, None, "allow")


@pytest.mark.parametrize("shard_keys", [10**6, 60])
def test_url_verdicts_equal_plain_rules(spark, shard_keys):
    rng = random.Random(3)
    rules = [(random_host(rng), rng.choice([*PATHS, "a", None]), rng.choice(["allow", "block"])) for _ in range(200)]
    rules += [(None, "/", "block"), ("a/b", "/", "block"), *rules[:5]]
    urls = [(i, rng.choice(["http://", "", "://"]) + random_host(rng).upper() + rng.choice(PATHS)
             + rng.choice(["", "?q=/", "#f", "bc/d", "a/"])) for i in range(1500)]
    urls += [(5, None), (None, "http://a"), (7, ""), (8, "x://" + "a." * 30_000 + "a/a/"), (8, "É://É.A/a/"), (9, "a://b://c")]
    pages = clashing(spark.createDataFrame(urls, "page_id long, url string"))
    got = tuples(url_filter.judge_urls(pages, spark.createDataFrame(rules, RULES), shard_keys=shard_keys))
    assert got == sorted([(i, *plain_verdict(u, rules)) for i, u in urls], key=str)


def test_url_rules_of_no_rows_and_bad_verdicts(spark):
    pages = spark.createDataFrame([(1, "http://a/b")], "page_id long, url string")
    none, some = spark.createDataFrame([], RULES), spark.createDataFrame([("a", "/", "block")], RULES)
    assert tuples(url_filter.judge_urls(pages, none)) == [(1, "a", "/b", None, "allow")]
    assert tuples(url_filter.judge_urls(pages, none, default="block")) == [(1, "a", "/b", None, "block")]
    assert url_filter.judge_urls(pages.limit(0), some).collect() == []
    assert tuples(url_filter.judge_urls(pages, some)) == [(1, "a", "/b", "a/", "block")]
    with pytest.raises(ValueError):
        url_filter.judge_urls(pages, spark.createDataFrame([("a", "/", "maybe")], RULES))


def test_cascade_is_exact_over_its_universe(spark):
    listed = spark.range(3_000).select(F.concat(F.lit("l"), "id").alias("key"))
    universe = spark.range(30_000).select(F.concat(F.lit("u"), "id").alias("key")).unionByName(listed.limit(1_000))
    hashed = [url_filter.stored(d.select("key", *url_filter.hashes(F.col("key"))), "test") for d in (listed, universe)]
    cascade = url_filter.build_cascade(*hashed)
    rows = hashed[1].toPandas()
    member = cascade.member(*[rows[c].to_numpy().astype(np.int64).view(np.uint64) for c in ("h1", "h2")])
    assert (member == rows["key"].str.startswith("l").to_numpy()).all() and member.any()
    assert len(cascade.levels) >= 2 and sum(len(x.words) * 64 for x in cascade.levels) < 3_000 * 30


# --- spelling ---------------------------------------------------------------


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_variants(counts, ratio=10):
    words = sorted(counts)
    links = {w: [o for o in words if abs(len(o) - len(w)) < 2 and near(w, o)] for w in words}
    form = {}
    for w, others in links.items():
        if others:
            best = min(others, key=lambda o: (-counts[o], o))
            if counts[best] >= ratio * counts[w]:
                form[w] = best
    out = []
    for w in words:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, counts[w], len(links[w]), counts[form[w]] if w in form else None))
    return out


def plain_counts(rows, garble=31):
    counts = collections.Counter()
    for doc_id, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate({c: c + 32 for c in range(65, 91)})
            x = zlib.crc32(f"{doc_id}:{w}".encode()) if doc_id is not None else 1
            if x % garble == 0:
                w = w[:x % len(w)] + w[x % len(w) + 1:]
            if len(w) >= 7:
                counts[w] += 1
    return {w: n for w, n in counts.items() if n >= 2}


@pytest.fixture(scope="module")
def odd_words():
    rng = random.Random(2)
    words = {"".join(rng.choice("abÀÿ") for _ in range(rng.randint(1, 8))): rng.choice([2, 3, 25, 400, 9000]) for _ in range(700)}
    for i in range(6):  # a chain of forms
        words["chain" + "x" * i] = 2 * 10**i
    return words | {"x" * 2000: 5, "x" * 1999: 70, "x" * 1000 + "y" + "x" * 999: 2}


@pytest.mark.parametrize("group_rows", [128, 3])
def test_variants_equal_all_pairs(spark, odd_words, group_rows):
    df = clashing(spark.createDataFrame(list(odd_words.items()), "word string, n long").repartition(7))
    got = sorted(map(tuple, spelling.variants(df, group_rows=group_rows).collect()))
    assert got == sorted(plain_variants(odd_words))
    assert {r[2] for r in got if r[0].startswith("chain")} == {"chainxxxxx"}


def test_word_counts_equal_plain_counts(spark):
    rows = [(1, "Straße straße STRASSE strasse été Étéétéé étéétéé\u00d7\u00f7 \u0100bcdefgh"), (2, None), (2, ""), (None, "Lettersss lettersss"),
            (3, "abcdefg" * 40_000 + " " + "wordword " * 5_000), (3, "abcdefg" * 40_000), (4, "under_scores under_scores")]
    docs = clashing(spark.createDataFrame(rows * 2, "doc_id long, text string"))
    for garble in (31, 2):
        assert dict(map(tuple, spelling.word_counts(docs, garble=garble).collect())) == plain_counts(rows * 2, garble)


def test_variants_of_given_documents(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    counts = plain_counts([tuple(r) for r in docs.select("doc_id", "text").collect()])
    got = sorted(map(tuple, spelling.variants(spelling.word_counts(docs, garble=31)).collect()))
    assert got == sorted(plain_variants(counts)) and any(r[1] for r in got)


def test_variants_of_no_words(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variants(spelling.word_counts(empty)).collect() == []
    with pytest.raises(ValueError):
        spelling.variants(spelling.word_counts(empty), ratio=1)


def test_spelling_sends_no_side_through_the_driver(spark, monkeypatch):
    """Signatures and split keys are many rows a word; Spark sizes them by the words' files."""
    plans, tables = [], []

    def planned(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        tables.append(name)
        return stored(df, name)

    monkeypatch.setattr(spelling, "stored", planned)
    words = spark.createDataFrame([("abcdefgh", 200), ("abcdefg", 20), ("abcdefgx", 2), ("zzzzzzz", 5)], "word string, n long")
    out = spelling.variants(words, group_rows=2)
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert {"spelling-signatures", "spelling-links", "spelling-forms", "spelling-roots"} <= set(tables)
    assert sum(p.count("SortMergeJoin") for p in plans) >= 6
    assert not any("Broadcast" in p for p in plans)
    assert {r.word: r.root for r in out.collect()}["abcdefgx"] == "abcdefgh"
