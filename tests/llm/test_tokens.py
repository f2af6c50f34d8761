import pytest
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from memloom.llm import piece_bpe, token_counts

TEXTS = ["", "  a   b\n\n x", "it's we're 'reX !'re", "<|endoftext|>ab <|endoftext|>", "x\x1c\x1dy \x85z　q", "日本語 テスト é́", "½ ² 12345", "   ", "we've I'll 'd'", "▁▁a ▁", "\x00 a", "</s> <s> <unk>", "😀 word " * 3, "a" * 300, "Thtionnd the onening. " * 40]


def test_prefix_counts_equal_the_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    ours, library = token_counts.PrefixCounter(path), Tokenizer.from_file(path)
    assert ours.regular
    count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    for text in TEXTS:
        assert ours.total(text) == count(text)
        assert ours.table(text).tolist() == [count(text[:k]) for k in range(len(text) + 1)]
    assert count(TEXTS[-1][: ours.fit(TEXTS[-1], 10)]) <= 10


def test_pair_rule_equals_encoding():
    ours = token_counts.PrefixCounter(public_tokenizers.path("byte_bpe_50k.json"))
    some = sorted(ours.bytes_of)[:: 997]
    for a in some:
        for b in some:
            assert ours._fit((a, b)) == (ours.encode_word(ours.bytes_of[a] + ours.bytes_of[b]) == [a, b])


def test_pieces_equal_the_library():
    path = public_tokenizers.path("piece_bpe_32k.model")
    ours, library = piece_bpe.PieceCodec(path), sentencepiece.SentencePieceProcessor(model_file=path)
    for text in TEXTS:
        ids = library.encode(text)
        assert ours.encode(text) == ids
        assert ours.decode(ids) == library.decode(ids)
        assert ours.digest(text) == (len(ids), ",".join(map(str, ids)), library.decode(ids))


def test_long_stretch_uses_the_heap():
    path = public_tokenizers.path("piece_bpe_32k.model")
    ours, library = piece_bpe.PieceCodec(path), sentencepiece.SentencePieceProcessor(model_file=path)
    text = "abcdefghij" * 40
    assert ours.encode(text) == library.encode(text)


def test_tables(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (2, "", "x"), (None, "a b", "y")], "doc_id long, text string, n_tokens string")
    rows = token_counts.token_counts(df, public_tokenizers.path("byte_bpe_50k.json")).collect()
    assert sorted((r.doc_id or -1, r.n_tokens) for r in rows) == [(-1, 2), (1, 0), (2, 0), (2, 0)]
    full = piece_bpe.encode_documents(df, public_tokenizers.path("piece_bpe_32k.model"), check_every=1).collect()
    assert [r.decoded for r in full if r.doc_id is None] == ["a b"]
    assert piece_bpe.encode_digests(df.limit(0), public_tokenizers.path("piece_bpe_32k.model")).count() == 0


def test_mismatch_raises():
    with pytest.raises(ValueError):
        piece_bpe._checked(sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model")), "ab", "1,2", "ab")
