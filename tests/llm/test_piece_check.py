import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from memloom.llm import piece_bpe

PATH = public_tokenizers.path("piece_bpe_32k.model")
MARK = piece_bpe.MARK


def test_every_stretch_is_checked():
    codec, _ = piece_bpe._codec(PATH)
    true = codec.stretch_ids
    codec.memo.clear()
    codec.stretch_ids = lambda s: true(s) + [true(s)[-1]] if s == f"{MARK}bad" else true(s)
    try:
        codec.digest("a good one")
        codec.check()
        for take in (codec.digest, codec.numbers):
            take("a bad one")
            with pytest.raises(ValueError):
                codec.check()
            codec.fresh.clear()
    finally:
        del codec.stretch_ids
        codec.memo.clear()
        codec.packed.clear()


def test_checked_stretches_equal_the_library():
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    codec = piece_bpe.PieceCodec(PATH, library)
    for text in ("", " ", "  ", "a ", "a  ", " a", f"{MARK}", f"a{MARK} ", "<s> </s>", "\n\n x\t", "日本語 é́", "½ \x00 a", "x" * 300):
        piece_bpe._checked(library, text, *codec.digest(text)[1:])
        ids, shown = codec.numbers(text)
        assert (np.frombuffer(ids, np.int32).tolist(), shown) == (library.encode(text), library.decode(library.encode(text)))
        codec.check()
