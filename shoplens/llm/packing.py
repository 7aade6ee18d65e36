"""Sum-of-squares packing of token pieces into sequences.

A document's ids (with an end id) are cut into pieces of at most ``capacity``
ids.  Full pieces are sequences of their own, numbered where they are read
(below zero) and dealt to no group.  The others are dealt by a hash of their
place in the stored table, so that repeated rows spread too, into groups of about
``group_rows`` pieces - as many groups as the input needs, so no task grows - and
each group is packed by itself: every piece goes where
the sum over gaps of (open bins with that gap) squared becomes smallest, equal
sums taking the smallest gap; a new bin is opened when no open one has room.
Pieces come in decreasing length (ties by id, piece, checksum), which makes the
result the same on every run.  (Letting a new bin compete with the open ones
left about 0.5 % more sequences on lengths like these.)

Defined results: null text is the empty text (the end id alone); repeated rows
are separate pieces; no rows give no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplens.llm.common import batch_of, map_batches, stored
from shoplens.llm.word_bpe import chunk_ids

GROUP_ROWS = 40_000


def cut_pieces(docs: DataFrame, path: str, end_id: int, capacity: int, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32."""
    schema = pa.schema([("id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                        ("ids_crc32", pa.int64())])
    end = np.array([end_id], "<u4").tobytes()

    def fn(batches):
        encode = chunk_ids(path).encode
        for b in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                data = memoryview(encode(text) + end)
                for k in range(0, len(data), 4 * capacity):
                    part = data[k:k + 4 * capacity]
                    rows.append((doc_id, k // (4 * capacity), k // 4, len(part) // 4, zlib.crc32(part)))
            yield batch_of(schema, list(zip(*rows)) if rows else [[]] * 5)

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return map_batches(src, fn, "id long, piece int, start long, length long, ids_crc32 long")


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every item, placed in the given order."""
    count = np.zeros(capacity + 1, np.int64)  # open bins by residual gap
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    n_bins = 0
    for i, s in enumerate(lengths.tolist()):
        # change of the sum when a bin of gap g (g = s .. capacity - 1) becomes one of gap g - s
        before, after = count[s:capacity], count[:capacity - s]
        change = 2 * (after - before) + 2
        if s < capacity:
            change[0] = 1 - 2 * before[0]  # the bin is full and counts no longer
            change[before == 0] = np.iinfo(np.int64).max
            g = s + int(change.argmin())
            use = count[g] > 0
        else:
            use = False
        if use:
            k = stacks[g].pop()
            count[g] -= 1
        else:
            k, g, n_bins = n_bins, capacity, n_bins + 1
        bins[i], offsets[i] = k, capacity - g
        if g > s:
            stacks[g - s].append(k)
            count[g - s] += 1
    return bins, offsets


def pack_pieces(pieces: DataFrame, capacity: int, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Adds sequence_id and offset to ``pieces`` (a stored table: it is read
    several times and a row's place in it does not change)."""
    own = F.monotonically_increasing_id()
    full = pieces.filter(F.col("length") == capacity).withColumns({"sequence_id": -1 - own, "offset": F.lit(0).cast("long")})
    part = pieces.filter(F.col("length") < capacity)
    groups = max(1, -(-part.count() // group_rows))
    keyed = part.withColumn("grp", F.pmod(F.xxhash64(own), F.lit(groups)))

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "id", "piece", "ids_crc32"], ascending=[False, True, True, True],
                              kind="stable")
        bins, offsets = sum_of_squares(pdf["length"].to_numpy(), capacity)
        return pdf.assign(sequence_id=pdf["grp"].to_numpy() * (1 << 40) + bins, offset=offsets).drop(columns="grp")

    return keyed.groupBy("grp").applyInPandas(
        fn, "id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long").unionByName(full)


def pack_documents(docs: DataFrame, path: str, end_id: int, capacity: int, id_col: str = "doc_id",
                   text_col: str = "text", group_rows: int = GROUP_ROWS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece."""
    pieces = stored(cut_pieces(docs, path, end_id, capacity, id_col, text_col), "pieces")
    return pack_pieces(pieces, capacity, group_rows).withColumnRenamed("id", id_col)
