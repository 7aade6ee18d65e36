"""Registered queries of the subpackage, one per operator, and their DuckDB SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from shoplens.llm import (byte_bpe, html_text, language, merkle, near_dup, nearest, packed_ids, packing, quality, spelling,
                          token_counts, toxicity, url_filter)
from shoplens.llm.common import read_table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


@register("op1_token_counts")
def q_token_counts(spark, sf_dir):
    """Bytes and sentencepiece tokens of every whole document; over_limit above 4096 tokens."""
    return token_counts.count_tokens(read_table(spark, sf_dir, "documents"),
                                     public_tokenizers.path("piece_bpe_32k.model"), limit=4096)


@register("op4_packed_ids")
def q_packed_ids(spark, sf_dir):
    """Every document's ids (end id 2) written bit-packed in doc_id order and read back."""
    return packed_ids.write_and_read(spark, read_table(spark, sf_dir, "documents"),
                                     public_tokenizers.path("word_bpe_49k.json"), end_id=2, vocabulary=49_408)


@register("op7_byte_bpe")
def q_byte_bpe(spark, sf_dir):
    """Byte-level BPE ids of every whole document and the bytes they decode to, as checksums."""
    return byte_bpe.encode_digests(read_table(spark, sf_dir, "documents"),
                                   public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN,
                                   repeatable=True)


@register("op8_packing")
def q_packing(spark, sf_dir):
    """All documents (end id 0) cut and packed into sequences of at most 2048 tokens."""
    return packing.pack_documents(read_table(spark, sf_dir, "documents"),
                                  public_tokenizers.path("word_bpe_49k.json"), end_id=0, capacity=2048) \
        .withColumn("piece", F.col("piece").cast("int"))


@register("op5_quality", quality.SQL)
def q_quality(spark, sf_dir):
    """Base figures and cross-document line frequency; kept is the verdict."""
    return quality.judge(read_table(spark, sf_dir, "documents"))


@register("op6_html_text")
def q_html_text(spark, sf_dir):
    """Main text of every whole page."""
    return html_text.extract_text(read_table(spark, sf_dir, "pages"))


def fold(parts: int):
    """crc32 of the id as text, modulo ``parts``."""
    return F.crc32(F.col("doc_id").cast("string")) % parts


@register("op2_language")
def q_language(spark, sf_dir):
    """Language of every whole document, learned on the documents whose fold of 4 is not 2."""
    docs = read_table(spark, sf_dir, "documents")
    model = language.learn(docs.filter(fold(4) != 2))
    return language.identify(docs, model).select("doc_id", F.coalesce(fold(4) == 2, F.lit(True)).alias("held_out"),
                                                 "lang_pred", "score")


@register("op3_toxicity")
def q_toxicity(spark, sf_dir):
    """Toxicity of every whole document, learned on the labels whose fold of 5 is not 0."""
    docs = read_table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, read_table(spark, sf_dir, "labels").filter(fold(5) != 0))
    return toxicity.score_documents(docs, model).select(
        "doc_id", F.coalesce(fold(5) == 0, F.lit(True)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_sentences", "worst_score", "worst_sentence")


@register("op10_near_dup")
def q_near_dup(spark, sf_dir):
    """Components of documents whose sets of five-word shingles have a similarity of 0.85 or more."""
    return near_dup.near_duplicates(read_table(spark, sf_dir, "documents"), percent=85)


@register("op9_nearest")
def q_nearest(spark, sf_dir):
    """The 10 nearest vectors found for every vector whose id is divisible by 100."""
    return nearest.nearest(read_table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, k=10)


@register("op11_merkle", merkle.SQL)
def q_merkle(spark, sf_dir):
    """Merkle manifest of the documents, a tree per source, with the check of a copy without line feeds."""
    return merkle.verified_manifest(read_table(spark, sf_dir, "documents"))


URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
             ("net", "/es/", "block"), ("net", "/fr/", "block")]


@register("op12_url_filter", url_filter.SQL)
def q_url_filter(spark, sf_dir):
    """Verdict on every page's url by the rules above."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge_urls(read_table(spark, sf_dir, "pages"), rules)


@register("op13_spelling", spelling.SQL)
def q_spelling(spark, sf_dir):
    """Words of the documents with their near words, more frequent form and root."""
    return spelling.variants(spelling.word_counts(read_table(spark, sf_dir, "documents"), garble=31))
