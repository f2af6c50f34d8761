"""Text functions whose rules need Python's regular expressions or a running state."""

from __future__ import annotations

import hashlib
import itertools
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n\n+")
#: Alternatives must not overlap, so one expression finds all kinds.
_IDENTIFIER = re.compile(r"(0x[0-9a-f]+)|(?:subsystem|system|unit|module|sector|node)\s*#?(\d+)|(?:error|err|fault|code)\s*[#:-]?\s*([0-9a-fx]+)|(v\d+(?:\.\d+)+)|\b(\d{3,})\b")


def sentence_ranges(sizes: list[int], target: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Ranges of sentences of these sizes: each has what fits into target characters,
    blanks between included, but always a sentence that no earlier one has; it begins
    with those at the end of the range before that fit into overlap."""
    upto = list(itertools.accumulate((n + 1 for n in sizes), initial=0))
    begin = end = 0
    while end < len(sizes):
        end = max(end + 1, bisect_right(upto, upto[begin] + target + 1) - 1)
        yield begin, end
        begin = max(begin, bisect_left(upto, upto[end] - overlap))


def chunk_text(text: str | None, target: int = 800, overlap: int = 100, least: int = 50) -> list[str]:
    """Chunks of whole sentences of about target characters; each begins with the
    last sentences of the one before, up to overlap characters; a short end joins
    the chunk before it."""
    if text is None:
        return []
    sentences = [s for s in _SENTENCE.split(text) if s.strip()] if len(text) > target else []
    parts = [" ".join(sentences[a:b]) for a, b in sentence_ranges([len(s) for s in sentences], target, overlap)] or [text]
    if len(parts) > 1 and len(parts[-1]) < least:
        parts[-2:] = [" ".join(parts[-2:])]
    return parts


def identifiers_in(text: str | None) -> list[str]:
    return sorted({next(g for g in m.groups() if g) for m in _IDENTIFIER.finditer((text or "").lower()) if any(m.groups())})


def chunks(text: Column, target: int = 800, overlap: int = 100, least: int = 50) -> Column:
    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: chunk_text(t, target, overlap, least))

    return run(text)


def identifiers(text: Column) -> Column:
    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(identifiers_in)

    return run(text)


def vec_to_blob(vector: Column) -> Column:
    """A vector as little-endian 32-bit floats in a row."""

    @F.pandas_udf("binary")
    def run(vectors: pd.Series) -> pd.Series:
        return vectors.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())

    return run(vector)


def blob_to_vec(blob: Column) -> Column:
    @F.pandas_udf("array<float>")
    def run(blobs: pd.Series) -> pd.Series:
        return blobs.map(lambda b: None if b is None else np.frombuffer(b, "<f4").tolist())

    return run(blob)


def first_characters(pattern: str) -> frozenset[str] | None:
    """The lower-case characters one of which begins every match of the expression; None
    if they can't be told, or a match may be empty.  A text without them needs no search."""

    def begins(items) -> tuple[set[str] | None, bool]:
        """The characters, and whether all of items may match nothing."""
        out: set[str] = set()
        for op, value in items:
            name = str(op)
            if name == "AT":
                continue
            if name == "LITERAL":
                own, empty = {chr(value).lower()}, False
            elif name == "SUBPATTERN":
                own, empty = begins(value[3])
            elif name == "BRANCH":
                parts = [begins(x) for x in value[1]]
                own, empty = (None if any(x is None for x, _ in parts) else set().union(*(x for x, _ in parts))), any(e for _, e in parts)
            elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
                own, empty = begins(value[2])
                empty = empty or value[0] == 0
            elif name == "IN" and all(str(o) in ("LITERAL", "RANGE") for o, _ in value):
                own, empty = {chr(c).lower() for o, x in value for c in (range(x[0], x[1] + 1) if str(o) == "RANGE" else [x])}, False
            elif name == "IN" and [(str(o), str(x)) for o, x in value] == [("CATEGORY", "CATEGORY_DIGIT")]:
                return None, False  # digits of all scripts
            else:
                return None, False
            if own is None:
                return None, False
            out |= own
            if not empty:
                return out, False
        return out, True

    found, empty = begins(re._parser.parse(pattern))
    return None if found is None or empty or not all(c.isascii() for c in found) else frozenset(found)


def locate_chunk(text: str, chunk: str) -> tuple[int, int] | None:
    """The lines, counted from 1, of a text that hold a chunk, blanks aside; the first such."""
    wanted = " ".join(chunk.split())
    words, line_of = [], []
    for n, line in enumerate(text.split("\n"), 1):
        for w in line.split():
            words.append(w)
            line_of.append(n)
    whole = " ".join(words)
    at = f" {whole} ".find(f" {wanted} ") if wanted else -1
    if at < 0:
        return None
    first = len(whole[:at].split())
    return line_of[first], line_of[first + len(wanted.split()) - 1]


def located(text: Column, chunk: Column) -> Column:
    """struct<first, last>: the lines of text that hold chunk; null if none do."""

    @F.pandas_udf("struct<first:int,last:int>")
    def run(texts: pd.Series, parts: pd.Series) -> pd.DataFrame:
        found = [locate_chunk(t, c) if t is not None and c is not None else None for t, c in zip(texts, parts, strict=True)]
        return pd.DataFrame({"first": [f and f[0] for f in found], "last": [f and f[1] for f in found]})

    at = run(text, chunk)
    return F.when(at["first"].isNotNull(), at)


def span_digest(text: Column) -> Column:
    """The first 8 bytes of BLAKE2b as hexadecimal digits."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest())

    return run(text)
