"""The chunk encoder keeps a word once, whether it is a chunk or part of one."""

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from shoplens.llm import word_bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_words_and_chunks_share_one_store():
    e = word_bpe.ChunkIds(PATH)
    e.encode("lampe lampe, Lampe. it's")
    assert set(e) == {"lampe", "lampe,", ",", "Lampe.", ".", "it's", "it", "'s"}
    assert not [v for k, v in vars(e).items() if isinstance(v, dict) and "lampe" in v]


@pytest.mark.parametrize("keep", [2, 5, 1_050_000])
def test_ids_equal_the_library_whatever_is_kept(monkeypatch, keep):
    monkeypatch.setattr(word_bpe, "MEMORY_CHUNKS", keep)
    e, tk = word_bpe.ChunkIds(PATH), Tokenizer.from_file(PATH)
    special = [t.content for t in tk.get_added_tokens_decoder().values()]
    texts = ["Lampe, lampe. LAMPE's don't ''s 12a3 è É'S x", "aK İx ſt \xaa\xb2 x\xady a\x1cb",
             *special, *(s.upper() for s in special), *(f"x{s}y, {s.upper()}z {s}" for s in special), "", " \n", "w" * 200 + " w" * 3]
    for text in texts * 2:
        assert e.encode(text) == np.array(tk.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text
