"""Byte-level BPE over a global distinct-word shuffle, and its decoding.

1. Every text is cut by the tokenizer's pattern.  A block is a run of
   documents of one input partition with about ``block_chars`` characters; its
   distinct words, sorted within hash buckets, are its dictionary.  A document
   becomes the list of its words' dictionary numbers: the exploded pre-tokens
   with their positions, held in word order.
2. The blocks' words are dealt by bucket: equal words of all blocks meet in one
   task, which encodes each distinct word once and returns to every block the
   ids of its words.  A frequent word is one entry per block, not one per use.
3. A block's ids and its documents meet again by block; each document's ids are
   put together in position order.
4. Decoding looks up every id in the token-byte table (50 thousand entries, one
   copy per worker) and joins the bytes.

The dictionary passes read the input twice.  Both must cut the same blocks, so
the input has to give the same rows in the same order when it is read again: a
table's files do (``repeatable=True``), a shuffle or a recomputed task need not.
Any other input is stored first and read from there.  A block's key holds a
checksum of its document ids and dictionary; a block that finds no partner is an
error, never a silent loss.

Defined results: null and empty texts have no ids and the checksums of no
bytes; one output row per input row, repeated rows included.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplens.llm.common import batch_of, map_batches, stored

BLOCK_CHARS = 8_000_000
# The pattern's classes below U+0250, spelled out for the standard library's faster matcher.
LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
SPACES = "\t-\r \x85\xa0"
FAST = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{SPACES}{LETTERS}{NUMBERS}]+"
                  rf"|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")
BEYOND = re.compile("[ɐ-\U0010ffff]")


@lru_cache(maxsize=2)
def general_pattern(pattern: str):
    import regex
    return regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s+(?!\S)", r"\p{White_Space}+(?!\P{White_Space})")
                         .replace(r"|\s+", r"|\p{White_Space}+"))


def cut(text: str, pattern: str) -> list[str]:
    """All matches of the tokenizer's pattern, in order; ``FAST`` spells out one pattern and serves no other."""
    if pattern != public_tokenizers.PATTERN or BEYOND.search(text):
        return general_pattern(pattern).findall(text)
    return FAST.findall(text)


@lru_cache(maxsize=2)
def encoding(path: str, pattern: str):
    import tiktoken
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def token_bytes(path: str, pattern: str) -> list[bytes]:
    """The token-byte table: entry i holds the bytes of id i."""
    enc = encoding(path, pattern)
    out = [b""] * enc.n_vocab
    for i in range(enc.n_vocab):
        try:
            out[i] = enc.decode_single_token_bytes(i)
        except KeyError:
            continue
    return out


class Numbers(dict):
    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


def blocks(batches, pattern: str, buckets: int, block_chars: int) -> Iterator[tuple]:
    """(key, words sorted by bucket and word, bucket of each, document ids, arrays of
    dictionary numbers) per block of one partition."""
    ids: list = []
    uses: list[np.ndarray] = []
    numbers, chars = Numbers(), 0

    def block():
        words = list(numbers)
        raw = [w.encode() for w in words]
        bucket = np.fromiter((zlib.crc32(w) % buckets for w in raw), np.int64, len(raw))
        order = sorted(range(len(raw)), key=raw.__getitem__)
        order = np.array(order, np.int64)[np.argsort(bucket[order], kind="stable")] if raw else np.zeros(0, np.int64)
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        h = hashlib.blake2b(repr(ids).encode(), digest_size=8)
        h.update(b"\0".join(raw[i] for i in order))
        for u in uses:
            h.update(u.tobytes())
        key = int.from_bytes(h.digest(), "little", signed=True)
        return key, [words[i] for i in order], bucket[order], ids, [rank[u] for u in uses]

    for b in batches:
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            found = cut(text, pattern) if text else []
            ids.append(doc_id)
            uses.append(np.fromiter(map(numbers.__getitem__, found), np.uint32, len(found)))
            chars += len(text or "")
            if chars >= block_chars:
                yield block()
                ids, uses, numbers, chars = [], [], Numbers(), 0
    if ids:
        yield block()


def squeeze(a: np.ndarray) -> bytes:
    """Unsigned 32-bit integers by byte plane, compressed."""
    planes = np.ascontiguousarray(a.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def expand(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel()


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
                     block_chars: int = BLOCK_CHARS, decode: bool = True, repeatable: bool = False) -> DataFrame:
    """``id_col``, ids (binary, little-endian unsigned 32-bit) and decoded (binary) per document."""
    return reassemble(docs, path, pattern, id_col, text_col, block_chars, _ids_and_text(path, pattern, decode),
                      "id long, ids binary, decoded binary", repeatable)


def encode_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
                   block_chars: int = BLOCK_CHARS, repeatable: bool = False) -> DataFrame:
    """``id_col``, n_tokens, ids_sha256, decoded_sha256 per document."""
    return reassemble(docs, path, pattern, id_col, text_col, block_chars, _digests(path, pattern),
                      "id long, n_tokens long, ids_sha256 string, decoded_sha256 string", repeatable)


def _ids_and_text(path, pattern, decode):
    def rows(doc_ids, parts):
        table = token_bytes(path, pattern)
        for i, ids in zip(doc_ids, parts, strict=True):
            yield i, ids.astype("<u4").tobytes(), b"".join(map(table.__getitem__, ids.tolist())) if decode else None
    return rows


def _digests(path, pattern):
    def rows(doc_ids, parts):
        table = token_bytes(path, pattern)
        for i, ids in zip(doc_ids, parts, strict=True):
            text = b"".join(map(table.__getitem__, ids.tolist()))
            yield (i, len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(),
                   hashlib.sha256(text).hexdigest())
    return rows


def reassemble(docs: DataFrame, path: str, pattern: str, id_col: str, text_col: str, block_chars: int, rows,
               schema: str, repeatable: bool) -> DataFrame:
    spark = docs.sparkSession
    # a bucket's words are one task's group: their number follows the session's partition count
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    if not repeatable:
        src = stored(src, "texts")
    word_schema = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("words", pa.list_(pa.string()))])
    doc_schema = pa.schema([("block", pa.int64()), ("doc_ids", pa.binary()), ("named", pa.binary()), ("lengths", pa.binary()),
                            ("uses", pa.binary())])

    def words_of(batches):
        for key, words, bucket, _, _ in blocks(batches, pattern, buckets, block_chars):
            at = np.flatnonzero(np.diff(bucket, prepend=-1))
            cuts = [*at.tolist(), len(words)]
            yield batch_of(word_schema, [bucket[at], [key] * len(at),
                                         [words[a:z] for a, z in zip(cuts[:-1], cuts[1:], strict=True)]])

    def docs_of(batches):
        for key, _, _, ids, uses in blocks(batches, pattern, buckets, block_chars):
            lengths = np.array([len(u) for u in uses], np.uint32)
            numbers = np.array([i or 0 for i in ids], "<i8").tobytes()
            named = np.array([i is not None for i in ids], bool).tobytes()
            yield batch_of(doc_schema, [[key], [numbers], [named], [squeeze(lengths)],
                                        [squeeze(np.concatenate(uses) if uses else lengths)]])

    def encode_bucket(pdf: pd.DataFrame) -> pd.DataFrame:
        """All blocks' words of one bucket: each distinct word is encoded once."""
        one = encoding(path, pattern).encode_ordinary
        known = {w: np.array(one(w), "<u4") for w in set().union(*pdf["words"])}
        out = []
        for words in pdf["words"]:
            ids = [known[w] for w in words]
            out.append((squeeze(np.array([len(i) for i in ids], "<u4")), squeeze(np.concatenate(ids))))
        return pd.DataFrame({"block": pdf["block"], "bucket": pdf["bucket"], "counts": [x[0] for x in out],
                             "ids": [x[1] for x in out]})

    def put_together(ids_df: pd.DataFrame, docs_df: pd.DataFrame) -> pd.DataFrame:
        if len(docs_df) == 0 or (len(ids_df) == 0 and any(len(expand(u)) for u in docs_df["uses"])):
            raise RuntimeError("the two passes over the documents cut different blocks")
        ids_df = ids_df.drop_duplicates("bucket").sort_values("bucket")  # equal blocks send equal rows
        counts = np.concatenate([expand(c) for c in ids_df["counts"]] or [np.zeros(0, "<u4")]).astype(np.int64)
        flat = np.concatenate([expand(c) for c in ids_df["ids"]] or [np.zeros(0, "<u4")])
        first = np.cumsum(counts) - counts
        out: list[tuple] = []
        # rows of one key are equal blocks (repeated input): each is put together by itself
        for doc_ids, named, lengths, uses in zip(docs_df["doc_ids"], docs_df["named"], docs_df["lengths"],
                                                 docs_df["uses"], strict=True):
            doc_ids = [i if ok else None for i, ok in zip(np.frombuffer(doc_ids, "<i8").tolist(),
                                                          np.frombuffer(named, bool).tolist(), strict=True)]
            use, n = expand(uses), expand(lengths).astype(np.int64)
            ends = np.cumsum(n)
            parts = []
            for a, z in zip((ends - n).tolist(), ends.tolist(), strict=True):
                w = use[a:z]
                c = counts[w]
                total = int(c.sum())
                # flat positions: each word's first id, then a run of c ids
                at = np.repeat(first[w] - (np.cumsum(c) - c), c) + np.arange(total)
                parts.append(flat[at])
            out.extend(rows(doc_ids, parts))
        names = [x.split()[0] for x in schema.split(", ")]
        pdf = pd.DataFrame(out, columns=names)
        pdf["id"] = pd.array([r[0] for r in out], dtype="Int64")
        return pdf

    words = map_batches(src, words_of, "bucket int, block long, words array<string>")
    ids = words.groupBy("bucket").applyInPandas(encode_bucket, "block long, bucket int, counts binary, ids binary")
    placed = map_batches(src, docs_of, "block long, doc_ids binary, named binary, lengths binary, uses binary")
    return ids.groupBy("block").cogroup(placed.groupBy("block")).applyInPandas(put_together, schema) \
        .withColumnRenamed("id", id_col)
