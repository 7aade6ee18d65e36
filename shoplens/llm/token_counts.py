"""Token counts by a whole-token shortcut.

For a SentencePiece BPE model whose pieces hold the space mark only in front
(or nothing else), no merge crosses the border between a character and a
following space, so a text may be cut before every run of spaces.  A character
that occurs in no piece of two or more characters never merges at all, so the
text may also be cut around it; the line feed is cut out this way when the
vocabulary allows it.

Once per worker the vocabulary strings that encode alone as exactly one token
are found with the library itself ("proved").  A pre-token that is such a
string counts as one without any merging; each of the others is merged by the
library once and its count remembered (the memory is bounded: it is emptied
when full, which changes the time and never a count).

Defined results: null or empty text 0 tokens and 0 bytes; one output row per
input row, repeated rows included; the input's other columns are not read.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplens.llm.common import batch_of, map_batches

MARK = "▁"
MEMORY_ENTRIES = 600_000
MEMORY_CHARS = 64
UNITS = re.compile(" *[^ ]+| +")


class Counter(dict):
    """Pre-token (without its leading space) -> number of tokens."""

    def __init__(self, model_path: str):
        import sentencepiece
        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())
                  if not (self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_byte(i))]
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece holds a space mark inside: cuts before spaces would not be safe")
        words = [p[1:] for p in pieces if p.startswith(MARK) and p.strip(MARK)]
        self.cut_lines = not any("\n" in p and len(p) > 1 for p in pieces)
        self.proved = {w: 1 for w, ids in zip(words, self.sp.encode(words, num_threads=1), strict=True)
                       if len(ids) == 1 and not w.startswith(("\n", MARK))}
        super().__init__(self.proved)
        self[""] = 1  # a space mark alone

    def merge(self, unit: str) -> int:
        n = len(self.sp.encode(unit))
        # a unit that begins at a line feed had no space there, but the library puts one in front
        return n - 1 if self.cut_lines and unit.startswith("\n") else n

    def __missing__(self, unit: str) -> int:
        n = self.merge(unit)
        if len(unit) <= MEMORY_CHARS:
            if len(self) >= MEMORY_ENTRIES:
                self.clear()
                self.update(self.proved)
                self[""] = 1
            self[unit] = n
        return n

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if "  " in text or text[0] == " " or MARK in text:
            # runs of spaces: each unit keeps its run, the library's own leading space stands for the first
            units = UNITS.findall(" " + text.replace(MARK, " "))
            return sum(len(self.sp.encode(u[1:])) if u[1:2] in (" ", "") else self.of_unit(u[1:]) for u in units) \
                + sum(u == " " for u in units)
        if self.cut_lines:
            text = text.replace("\n", " \n")
        return sum(map(self.__getitem__, text.split(" ")))

    def of_unit(self, unit: str) -> int:
        return sum(map(self.__getitem__, unit.replace("\n", " \n").split(" "))) if self.cut_lines else self[unit]


@lru_cache(maxsize=2)
def counter(model_path: str) -> Counter:
    """One per worker process, kept between tasks."""
    return Counter(model_path)


def count_tokens(docs: DataFrame, model_path: str, limit: int, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """``id_col``, n_bytes, n_tokens, over_limit (n_tokens > limit) per row of ``docs``."""
    schema = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()),
                        ("over_limit", pa.bool_())])

    def fn(batches):
        c = counter(model_path)
        for b in batches:
            n = [c.count(t) for t in b.column(2).to_pylist()]
            yield batch_of(schema, [b.column(0), b.column(1), n, [x > limit for x in n]])

    src = docs.select(F.col(id_col).cast("long").alias("id"),
                      F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"),
                      F.col(text_col).alias("text"))
    return map_batches(src, fn, "id long, n_bytes long, n_tokens long, over_limit boolean") \
        .withColumnRenamed("id", id_col)
