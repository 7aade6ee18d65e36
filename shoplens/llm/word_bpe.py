"""Ids of the lower-casing word BPE tokenizer, chunk by chunk.

The tokenizer collapses white space, lower-cases and never merges across white
space, so a text's ids are the ids of its white-space-separated chunks one
after another.  Chunks repeat: each is encoded once per worker and its ids kept
(bounded memory, emptied when full), and so are the words of a chunk of several.  A chunk of printable Latin-1 characters
is cut by the tokenizer's own pattern and handed to the library's merge model
word by word; every other chunk (and any that may hold a special token) goes
through the whole library.
"""

from __future__ import annotations

import os
import re
import struct
from functools import lru_cache

import numpy as np

MEMORY_CHUNKS = 1_050_000
MEMORY_CHARS = 64
# White space of the tokenizer's pattern; str.split() also cuts at \x1c-\x1f.
SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
SPLIT_DIFFERS = re.compile("[\x1c-\x1f]")
LATIN = re.compile("[!-~\xa1-\xac\xae-\xff]+")
WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]"
                   "|[^a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff0-9\xb2\xb3\xb9\xbc-\xbe]+")


def byte_letters() -> dict[int, str]:
    """Byte -> the character that stands for it in a byte-level vocabulary:
    printable bytes stand for themselves, the others for U+0100 and up."""
    out, n = {}, 0
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out[b] = chr(b)
        else:
            out[b], n = chr(256 + n), n + 1
    return out


class ChunkIds(dict):
    """Chunk -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        super().__init__()
        self.tk = Tokenizer.from_file(path)
        self.model = self.tk.model
        self.letters = [x for _, x in sorted(byte_letters().items())]
        specials = [t.content for t in self.tk.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, specials)) or "(?!)")
        # a chunk of ASCII letters only is one word, unless a special token could lie in it
        self.letters_are_words = not any(s.isascii() and s.isalpha() for s in specials)

    def whole(self, text: str) -> bytes:
        return np.array(self.tk.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def keep(self, chunk: str, ids: bytes) -> bytes:
        if len(chunk) <= MEMORY_CHARS:
            if len(self) >= MEMORY_CHUNKS:
                self.clear()
            self[chunk] = ids
        return ids

    def word(self, w: str) -> bytes:
        s = w if w.isascii() else "".join(map(self.letters.__getitem__, w.encode()))
        found = [t.id for t in self.model.tokenize(s)]
        return struct.pack(f"<{len(found)}I", *found)

    def part(self, w: str) -> bytes:
        """The ids of a chunk's word, which is kept as a chunk of its own."""
        if self.special.search(w):  # such a chunk would be encoded otherwise
            return self.word(w)
        ids = self.get(w)
        return self.keep(w, self.word(w)) if ids is None else ids

    def __missing__(self, chunk: str) -> bytes:
        if self.letters_are_words and chunk.isascii() and chunk.isalpha():
            ids = self.word(chunk.lower())
        elif LATIN.fullmatch(chunk) and not self.special.search(chunk):
            words = WORDS.findall(chunk.lower())
            ids = self.word(words[0]) if len(words) == 1 else b"".join(map(self.part, words))
        else:
            ids = self.whole(chunk)
        return self.keep(chunk, ids)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if SPLIT_DIFFERS.search(text):
            return b"".join(self[c] for c in SPACE.split(text) if c)
        return b"".join(map(self.__getitem__, text.split()))


@lru_cache(maxsize=2)
def chunk_ids(path: str) -> ChunkIds:
    """One per worker process, kept between tasks."""
    return ChunkIds(path)
