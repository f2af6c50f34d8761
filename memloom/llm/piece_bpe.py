"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Symbols start as characters.  An agenda holds the adjacent pairs whose joined
text is a piece, best score first and leftmost first among equals; the best
pair is merged and the pairs with its new neighbours enter the agenda.  An
entry is stale if either of its symbols has changed since.  Symbols that are
no piece in the end become byte pieces.

In the vocabularies meant here the blank mark stands only at the front of a
piece, so no merge crosses from text into a following blank mark.  That is
checked when the vocabulary is loaded; it lets the encoder work on one
stretch at a time and remember the frequent ones.  A vocabulary of another
kind is refused.

Defined results: a null or empty text has no ids and decodes to an empty text;
rows are independent of each other; other columns are ignored, whatever they
are called; an empty table gives an empty table.  All stretches that an Arrow
batch brings up are encoded and decoded by the sentencepiece library too, in a row,
and so are, as whole texts, each ``check_every``-th document of every batch; a
difference raises an error.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from array import array
from collections.abc import Iterator
from operator import add

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from memloom.llm._common import Memo, once_per_process

MARK = "▁"
_PLACE = 40
_SHORT, _NONE = 48, 1 << 62
#: Characters of stretches that wait for a check by the library, at most about.
_CHECK_CHARS = 1 << 20
#: Documents that are encoded between two batches of results.
_ROWS = 640
#: Stretches that are remembered, in each of two generations, as text for digests or packed, and odd ones among them.
_KEPT, _KEPT_PACKED, _ODD = 450_000, 250_000, 50_000
_STRETCH = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6  # fixed values of the model format


def _fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """Numbers and values of the fields of a protocol-buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(raw):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
        elif kind == 2:
            size = number()
            yield key >> 3, raw[at : at + size]
            at += size
        else:
            size = 4 if kind == 5 else 8
            yield key >> 3, struct.unpack("<f" if kind == 5 else "<d", raw[at : at + size])[0]
            at += size


class PieceCodec:
    """Encoder and decoder for one model file; with the library, check() compares
    what digest() and numbers() computed since the last check with it."""

    def __init__(self, path: str, library: sentencepiece.SentencePieceProcessor | None = None):
        self.library = library
        with open(path, "rb") as f:
            raw = f.read()
        self.pieces: list[tuple[str, float, int]] = []
        norm: dict[int, object] = {}
        for field, value in _fields(raw):
            if field == 1:
                p = dict(_fields(value))
                self.pieces.append((p[1].decode("utf-8"), p.get(2, 0.0), p.get(3, _NORMAL)))
            elif field == 3:
                norm = dict(_fields(value))
        if norm.get(2) or not norm.get(3, 1) or norm.get(4, 1):
            raise ValueError("only vocabularies with the identity normalizer, a dummy prefix and kept white space are supported")
        if any(kind in (_USER, _UNUSED) for _, _, kind in self.pieces):
            raise ValueError("vocabularies with user-defined or unused pieces aren't supported")
        if any(MARK in piece.lstrip(MARK) for piece, _, kind in self.pieces if kind == _NORMAL):
            raise ValueError("a piece has a blank mark after other characters")
        self.ids = {p: i for i, (p, _, kind) in enumerate(self.pieces) if kind == _NORMAL}
        order = {s: k for k, s in enumerate(sorted({s for _, s, kind in self.pieces if kind == _NORMAL}, reverse=True))}
        #: An agenda entry is one number: the place of the score, then that of the left symbol.
        self.entry = {p: order[s] << _PLACE for p, s, kind in self.pieces if kind == _NORMAL and len(p) > 1}
        self.byte_id = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(self.pieces) if kind == _BYTE}
        if len(self.byte_id) != 256:
            raise ValueError("the vocabulary lacks byte pieces")
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        self.shown = {i: p.replace(MARK, " ") for i, (p, _, kind) in enumerate(self.pieces) if kind == _NORMAL}
        self.memo: Memo = Memo(self._known, _KEPT)
        self.packed: Memo = Memo(self._packed, _KEPT_PACKED)
        self.odd: dict[str, str] = {}  # stretches that don't decode to themselves
        self.fresh: list[tuple[str, list[int], str]] = []  # stretches computed since the last check
        self.n_fresh = 0

    def stretch_ids(self, text: str) -> list[int]:
        """The ids of one stretch, by the agenda."""
        entry = self.entry
        symbols: list[str] = list(text)
        n = len(symbols)
        if n <= _SHORT:
            return self._ids_of(self._merge_short(symbols))
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [entry[joined] + k for k, joined in enumerate(map(add, symbols, symbols[1:])) if joined in entry]
        heapq.heapify(agenda)
        while agenda:
            best = heapq.heappop(agenda)
            left = best & (1 << _PLACE) - 1
            right = after[left]
            if right >= n:
                continue
            joined = symbols[left] + symbols[right]
            if not symbols[left] or entry.get(joined, -1) + left != best:
                continue  # stale
            symbols[left], symbols[right] = joined, ""
            follow = after[left] = after[right]
            if follow < n:
                before[follow] = left
                grown = joined + symbols[follow]
                if grown in entry:
                    heapq.heappush(agenda, entry[grown] + left)
            prior = before[left]
            if prior >= 0:
                grown = symbols[prior] + joined
                if grown in entry:
                    heapq.heappush(agenda, entry[grown] + prior)
        return self._ids_of(symbols)

    def _merge_short(self, symbols: list[str]) -> list[str]:
        """The same for a short stretch, where an agenda in text order is searched
        for its best entry instead of being kept as a heap."""
        entry = self.entry
        agenda = [entry.get(joined, _NONE) for joined in map(add, symbols, symbols[1:])]
        while agenda and (best := min(agenda)) < _NONE:
            k = agenda.index(best)
            symbols[k] += symbols.pop(k + 1)
            del agenda[k]
            if k < len(agenda):
                agenda[k] = entry.get(symbols[k] + symbols[k + 1], _NONE)
            if k:
                agenda[k - 1] = entry.get(symbols[k - 1] + symbols[k], _NONE)
        return symbols

    def _ids_of(self, symbols: list[str]) -> list[int]:
        ids = []
        for s in symbols:
            if s:
                known = self.ids.get(s)
                if known is not None:
                    ids.append(known)
                else:
                    ids += [self.byte_id[b] for b in s.encode("utf-8", "surrogatepass")]
        return ids

    def _computed(self, stretch: str) -> list[int]:
        ids = self.stretch_ids(stretch)
        spelt = self._spell(ids)
        if spelt != stretch.replace(MARK, " "):
            if len(self.odd) >= _ODD:  # the memos mustn't know what odd no longer tells
                self.memo.forget()
                self.packed.forget()
                self.odd.clear()
            self.odd[stretch] = spelt
        if self.library is not None:
            self.fresh.append((stretch, ids, spelt))
            self.n_fresh += len(stretch)
            if self.n_fresh > _CHECK_CHARS:
                self.check()
        return ids

    def _known(self, stretch: str) -> str:
        return ",".join(map(str, self._computed(stretch)))

    def _packed(self, stretch: str) -> bytes:
        return array("i", self._computed(stretch)).tobytes()

    def _shown(self, text: str, stretches: list[str]) -> str:
        """The decoded text: what its stretches decode to, most of them to themselves."""
        if self.odd.keys().isdisjoint(stretches):
            return text.replace(MARK, " ")
        return "".join(self._spell(self.stretch_ids(s)) if s in self.odd else s.replace(MARK, " ") for s in stretches).removeprefix(" ")

    def check(self) -> None:
        """Compare the stretches computed since the last check with the library, all in
        one text: no merge crosses into a stretch, so its ids are theirs in a row."""
        # one of marks alone would run into the next one, so it ends a text of its own
        ends = [x for x in self.fresh if not x[0].strip(MARK)]
        for part in ([x for x in self.fresh if x[0].strip(MARK)], *([("▁a", self.stretch_ids("▁a"), " a"), x] for x in ends)):
            if part:
                known = self.library.encode("".join(x[0] for x in part)[1:], num_threads=1)
                if known != [i for x in part for i in x[1]] or self.library.decode(known) != "".join(x[2] for x in part).removeprefix(" "):
                    raise ValueError("the encoder and the sentencepiece library differ")
        self.fresh.clear()
        self.n_fresh = 0

    def _spell(self, ids: list[int]) -> str:
        out, held = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                held.append(self.byte_of[i])
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held.clear()
            out.append(self.shown.get(i, ""))
        if held:
            out.append(held.decode("utf-8", "replace"))
        return "".join(out)

    def stretches(self, text: str) -> list[str]:
        return _STRETCH.findall(MARK + text.replace(" ", MARK)) if text else []

    def encode(self, text: str) -> list[int]:
        return [i for s in self.stretches(text) for i in self.stretch_ids(s)]

    def decode(self, ids: list[int]) -> str:
        return self._spell(ids).removeprefix(" ")

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, the ids joined by commas, and the decoded text."""
        if not text:
            return 0, "", ""
        stretches = self.stretches(text)
        ids = ",".join(map(self.memo.__getitem__, stretches))
        return ids.count(",") + 1, ids, self._shown(text, stretches)

    def numbers(self, text: str) -> tuple[bytes, str]:
        """The ids as 32-bit numbers in a row, and the decoded text."""
        if not text:
            return b"", ""
        stretches = self.stretches(text)
        return b"".join(map(self.packed.__getitem__, stretches)), self._shown(text, stretches)


OUT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
FULL = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])


def _codec(model: str) -> tuple[PieceCodec, sentencepiece.SentencePieceProcessor]:
    def make():
        library = sentencepiece.SentencePieceProcessor(model_file=model)
        return PieceCodec(model, library), library

    return once_per_process(("piece-codec", model), make)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.selectExpr(f"CAST(`{id_col}` AS BIGINT) AS doc_id", f"`{text_col}` AS text")


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def _checked(library, text: str, ids: str, shown: str) -> None:
    known = library.encode(text, num_threads=1) if text else []
    if ",".join(map(str, known)) != ids or library.decode(known) != shown:
        raise ValueError("the encoder and the sentencepiece library differ")


def encode_documents(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", check_every: int = 64, digest: bool = False) -> DataFrame:
    """Per row of docs: id, ids and the text decoded from them; with digest, the text's
    SHA-256 in its place (decoded_sha256)."""
    out = FULL if not digest else T.StructType([*FULL.fields[:2], T.StructField("decoded_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, library = _codec(model)
        # in short batches, as each holds all of its ids and texts
        for batch in (b.slice(at, _ROWS) for b in batches for at in range(0, b.num_rows, _ROWS)):
            packed, texts = [], []
            for k, x in enumerate(batch.column(1)):
                text = x.as_py() or ""
                ids, shown = codec.numbers(text)
                if k % check_every == 0:
                    _checked(library, text, ",".join(map(str, np.frombuffer(ids, np.int32).tolist())), shown)
                packed.append(ids)
                texts.append(_sha(shown) if digest else shown)
            codec.check()
            ends = np.cumsum([0, *(len(x) // 4 for x in packed)])
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(packed), np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array(texts, pa.string())], names=out.names)

    return _texts(docs, id_col, text_col).mapInArrow(run, out)


def encode_digests(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", check_every: int = 64) -> DataFrame:
    """Per row of docs: id, number of ids, digests of the ids and of the decoded text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, library = _codec(model)
        for batch in (b.slice(at, _ROWS) for b in batches for at in range(0, b.num_rows, _ROWS)):
            counts, ids_sha, text_sha = [], [], []
            for k, x in enumerate(batch.column(1)):
                text = x.as_py() or ""
                n, ids, shown = codec.digest(text)
                if k % check_every == 0:
                    _checked(library, text, ids, shown)
                counts.append(n)
                ids_sha.append(_sha(ids))
                text_sha.append(_sha(shown))
            codec.check()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=OUT.names)

    return _texts(docs, id_col, text_col).mapInArrow(run, OUT)
