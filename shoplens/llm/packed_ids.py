"""Token ids in fixed-width bit-packed files, written and read back.

File format (little-endian), one file per sorted range of documents:

    head      8s magic b"SLPKIDS1", zeros up to the size of the counts below
    blocks    each block's ids packed with the lowest bit first, ``bits`` bits an id,
              padded to whole bytes
    index     i64 doc ids, u8 "doc id is present" flags, u64 ids before each document
              (n_docs + 1 entries), u64 byte offset of each block (n_blocks + 1 entries)
    trailer   u64 byte offset of the index
    counts    8s magic, u32 bits per id, u32 ids per block, u64 n_docs, u64 n_ids,
              u64 n_blocks (last, because a stream to a store cannot go back)

The width is the minimum that holds every id of the vocabulary.  A block is
unpacked with whole-array numpy operations, and any range of ids is read by
touching only its blocks.

A write task names its file by a fresh unique name and reports it in the rows
it returns; the manifest table keeps the reports of the attempts that
succeeded, so a task that is repeated after a lost executor leaves at most an
unlisted file.  The files' folder is reached by its URI (``pyarrow.fs``), so
it may be any shared store.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shoplens.llm.common import batch_of, map_batches, shared_path, stored
from shoplens.llm.word_bpe import chunk_ids

MAGIC = b"SLPKIDS1"
HEAD = struct.Struct("<8sIIQQQ")
BLOCK_IDS = 65_536  # a multiple of 8: every block starts on a whole byte
READ_IDS = 1_048_576


def bits_for(vocabulary: int) -> int:
    """Least width that holds the ids 0 .. vocabulary - 1."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids (unsigned 32-bit) as a bit stream, lowest bit first."""
    ids = np.ascontiguousarray(ids, dtype="<u4")
    if ids.size and int(ids.max()) >> bits:
        raise ValueError(f"an id does not fit in {bits} bits")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    flat = np.unpackbits(ids.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(flat.ravel(), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    """The first ``n`` ids of a packed stream."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype("<u4")
    raw = np.zeros(len(data) + 8, np.uint8)
    raw[:len(data)] = np.frombuffer(data, np.uint8)
    at = np.arange(n, dtype=np.int64) * bits
    byte, shift = at >> 3, (at & 7).astype(np.uint64)
    word = np.zeros(n, np.uint64)
    for k in range(5):  # up to 32 bits from any bit position lie within five bytes
        word |= raw[byte + k].astype(np.uint64) << np.uint64(8 * k)
    return ((word >> shift) & np.uint64((1 << bits) - 1)).astype("<u4")


class Writer:
    """Streams documents into one packed file; holds one block and the index."""

    def __init__(self, out, bits: int):
        self.out, self.bits = out, bits
        self.docs: list[int] = []
        self.named: list[int] = []
        self.starts = [0]
        self.offsets = [HEAD.size]
        self.parts: list[bytes] = []
        self.held = 0
        self.out.write(MAGIC.ljust(HEAD.size, b"\0"))

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append(doc_id or 0)
        self.named.append(doc_id is not None)
        self.starts.append(self.starts[-1] + len(ids) // 4)
        self.parts.append(ids)
        self.held += len(ids) // 4
        if self.held >= BLOCK_IDS:
            held = np.frombuffer(b"".join(self.parts), "<u4")
            whole = len(held) // BLOCK_IDS * BLOCK_IDS
            for i in range(0, whole, BLOCK_IDS):
                self.block(held[i:i + BLOCK_IDS])
            self.parts, self.held = [held[whole:].tobytes()], len(held) - whole

    def block(self, ids: np.ndarray) -> None:
        data = pack(ids, self.bits)
        self.out.write(data)
        self.offsets.append(self.offsets[-1] + len(data))

    def close(self) -> None:
        if self.held:
            self.block(np.frombuffer(b"".join(self.parts), "<u4"))
        self.out.write(np.array(self.docs, "<i8").tobytes() + np.array(self.named, np.uint8).tobytes()
                       + np.array(self.starts, "<u8").tobytes() + np.array(self.offsets, "<u8").tobytes())
        self.out.write(struct.pack("<Q", self.offsets[-1]))
        self.out.write(HEAD.pack(MAGIC, self.bits, BLOCK_IDS, len(self.docs), self.starts[-1],
                                 len(self.offsets) - 1))
        self.out.close()


class Reader:
    """Random access to a packed file through its index."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        file.seek(size - HEAD.size - 8)
        tail = file.read(HEAD.size + 8)
        (at,) = struct.unpack("<Q", tail[:8])
        magic, self.bits, self.block_ids, n_docs, self.n_ids, n_blocks = HEAD.unpack(tail[8:])
        if magic != MAGIC:
            raise ValueError("not a packed id file")
        file.seek(at)
        raw = file.read(n_docs * 9 + (n_docs + 1) * 8 + (n_blocks + 1) * 8)
        self.docs = np.frombuffer(raw, "<i8", n_docs)
        self.named = np.frombuffer(raw, np.uint8, n_docs, n_docs * 8).astype(bool)
        self.starts = np.frombuffer(raw, "<u8", n_docs + 1, n_docs * 9).astype(np.int64)
        self.offsets = np.frombuffer(raw, "<u8", n_blocks + 1, n_docs * 9 + (n_docs + 1) * 8).astype(np.int64)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` (exclusive), reading only their blocks."""
        if stop <= start:
            return np.zeros(0, "<u4")
        a, b = start // self.block_ids, (stop - 1) // self.block_ids
        self.file.seek(int(self.offsets[a]))
        data = self.file.read(int(self.offsets[b + 1] - self.offsets[a]))
        n = min((b + 1) * self.block_ids, self.n_ids) - a * self.block_ids
        return unpack(data, self.bits, n)[start - a * self.block_ids:stop - a * self.block_ids]

    def runs(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """(first document, last document exclusive, their ids) in runs of about READ_IDS ids."""
        i, n = 0, len(self.docs)
        while i < n:
            j = int(np.searchsorted(self.starts, self.starts[i] + READ_IDS, "left"))
            j = min(max(j, i + 1), n)
            yield i, j, self.ids(int(self.starts[i]), int(self.starts[j]))
            i = j


def qualified(spark: SparkSession, path: str, conf=None) -> str:
    """The folder's whole URI as Spark resolves it: a path without a scheme lies
    in the cluster's default file system, not on the local disk."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs_of = folder.getFileSystem(conf if conf is not None else spark.sparkContext._jsc.hadoopConfiguration())
    uri = fs_of.makeQualified(folder).toString()
    return re.sub("^file:/+", "file:///", uri)


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def write_packed(docs: DataFrame, path: str, end_id: int, vocabulary: int, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """Encode every text, append ``end_id`` to each document and write the ids in
    ascending ``id_col`` order (nulls first, equal ids by the hash of their text).
    Null text is the empty text.  Returns the manifest, one row per file: part,
    path, n_docs, n_ids, start (ids in all files before it)."""
    spark = docs.sparkSession
    folder = qualified(spark, shared_path(spark, "packed"))
    where, top = open_folder(folder)
    where.create_dir(top)
    bits = bits_for(vocabulary)
    schema = pa.schema([("part", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
    end = np.array([end_id], "<u4").tobytes()

    def write(batches):
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        ids_of, writer, name = chunk_ids(path).encode, None, f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.ids"
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if writer is None:
                    files, at = open_folder(name)
                    writer = Writer(files.open_output_stream(at), bits)
                writer.add(doc_id, ids_of(text) + end)
        if writer is not None:
            writer.close()
            yield batch_of(schema, [[part], [name], [len(writer.docs)], [writer.starts[-1]]])

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ranged = src.repartitionByRange(n, F.col("id").asc_nulls_first()) \
        .sortWithinPartitions(F.col("id").asc_nulls_first(), F.xxhash64("text"), "text")
    manifest = stored(map_batches(ranged, write, "part int, path string, n_docs long, n_ids long"), "manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_packed(manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Every document of the manifest's files: ``id_col``, start, n_tokens, ids_crc32."""
    schema = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()),
                        ("ids_crc32", pa.int64())])

    def read(batches):
        for b in batches:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                files, at = open_folder(path)
                with files.open_input_file(at) as f:
                    r = Reader(f)
                    for i, j, ids in r.runs():
                        cut = (r.starts[i:j + 1] - r.starts[i]) * 4
                        data = memoryview(ids.tobytes())
                        crc = [zlib.crc32(data[a:z]) for a, z in zip(cut[:-1], cut[1:], strict=True)]
                        yield batch_of(schema, [pa.array(r.docs[i:j], mask=~r.named[i:j]), r.starts[i:j] + start,
                                                np.diff(r.starts[i:j + 1]), crc])

    n = max(manifest.count(), 1)
    return map_batches(manifest.select("path", "start").repartition(n), read,
                       "id long, start long, n_tokens long, ids_crc32 long").withColumnRenamed("id", id_col)


def write_and_read(spark: SparkSession, docs: DataFrame, path: str, end_id: int, vocabulary: int,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return read_packed(write_packed(docs, path, end_id, vocabulary, id_col, text_col), id_col)
