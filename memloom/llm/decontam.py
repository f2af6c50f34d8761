"""Documents that hold passages of a benchmark, found by spaced seeds.

A seed is a fixed mask over a few neighbouring words; its hash takes the words
at the mask's ones and ignores those at its zeros, so a substituted word under
a zero doesn't matter.  Hashes of all positions of the benchmark's items form a
bit table of bounded size, which every task gets; positions of the documents
that it lets through are joined with the benchmark's hashes themselves.  Each
hit fixes an alignment of a document and an item, and around it the words are
compared: a document and an item overlap if in some stretch of the alignment, of
``min_words`` words or the whole item if that is shorter, at least ``similarity``
of the words agree; words of the item beyond the document's ends agree with none.
Returned is the longest such stretch that begins and ends with agreeing words.

Words are what stands between ASCII white space, in lower case, without
punctuation at the ends.

Defined results: null or empty texts and items overlap with nothing; items
shorter than the shortest mask are compared by their words in a row; items of
equal words are one item, named by the smallest id; repeated rows of a document
count once; an empty table on either side gives an empty table.  Other columns
are ignored, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memloom.llm._common import durable

MASKS = ("11111", "1101101", "110010101", "1010011001")
#: Items of at most SHORT words have these masks as well: with both, whatever fifth of an item's words is substituted, some mask at some place misses all of them.
SHORT_MASKS = ("1111", "10111", "11011", "11101", "110011")
SHORT = 10
_LONGEST = max(map(len, MASKS))
_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
#: Words kept on either side of a run of hits; hits closer than that are one run.
AROUND = 64
_ROWS = 2000
_MULTIPLIERS = np.array([xxhash.xxh64_intdigest(b"seed", k) | 1 for k in range(_LONGEST)], np.uint64)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of the texts in a row, and where each text begins."""
    words = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
    if isinstance(words, pa.ChunkedArray):
        words = words.combine_chunks()
    offsets = np.asarray(words.offsets).astype(np.int64)
    coded = words.flatten()
    keep = np.asarray(pc.binary_length(coded)) > 0
    before = np.concatenate([[0], np.cumsum(keep)])
    offsets = before[offsets - offsets[0]]
    coded = coded.filter(pa.array(keep)).dictionary_encode()
    plain = pc.utf8_trim(pc.utf8_lower(coded.dictionary), characters=_EDGE)
    plain = pc.if_else(pc.equal(pc.binary_length(plain), 0), coded.dictionary, plain)
    digest = xxhash.xxh64_intdigest
    of = np.array([digest(w) for w in plain.cast(pa.large_binary()).to_pylist()], np.uint64)
    return (of[np.asarray(coded.indices)] if len(of) else np.empty(0, np.uint64)), offsets


def _seeds(words: np.ndarray, offsets: np.ndarray, masks: tuple[str, ...] = MASKS, first: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each mask, numbered from first, the positions where it fits within a text, and the hashes there."""
    n = len(words)
    room = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(n)  # words from here to the text's end
    for m, mask in enumerate(masks, first):
        if n < len(mask):
            continue
        last = n - len(mask) + 1
        h = np.full(last, np.uint64(m))
        for k, c in enumerate(mask):
            if c == "1":
                h += words[k : k + last] * _MULTIPLIERS[k]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        fits = np.flatnonzero(room[:last] >= len(mask))
        yield fits, h[fits]


def _short_seeds(words: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    return _seeds(words, offsets, SHORT_MASKS, len(MASKS) + 1)


def _short_items(words: np.ndarray) -> int:
    """The hash of an item that no mask fits, over all of its words."""
    return xxhash.xxh64_intdigest(words.tobytes(), 1 << 20 | len(words))


_ITEMS = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("words", T.ArrayType(T.LongType())), T.StructField("seeds", T.ArrayType(T.StructType([T.StructField("h", T.LongType()), T.StructField("pos", T.IntegerType())])))])


def _item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words, offsets = word_hashes(batch.column(1))
        found: list[list] = [[] for _ in range(batch.num_rows)]
        owner = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
        for places, hashes in _seeds(words, offsets):
            for p, h in zip(places.tolist(), hashes.view(np.int64).tolist(), strict=True):
                found[owner[p]].append({"h": h, "pos": p - int(offsets[owner[p]])})
        for places, hashes in _short_seeds(words, offsets):
            size = np.diff(offsets)[owner[places]]
            few = (size >= min(map(len, MASKS))) & (size <= SHORT)
            for p, h in zip(places[few].tolist(), hashes[few].view(np.int64).tolist(), strict=True):
                found[owner[p]].append({"h": h, "pos": p - int(offsets[owner[p]])})
        own = [words[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        for k, w in enumerate(own):
            if 0 < len(w) < min(map(len, MASKS)):
                found[k].append({"h": int(np.uint64(_short_items(w)).view(np.int64)), "pos": 0})
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([w.view(np.int64).tolist() for w in own], pa.list_(pa.int64())), pa.array(found, pa.list_(pa.struct([("h", pa.int64()), ("pos", pa.int32())])))], names=_ITEMS.names)


class BitTable:
    """A Bloom filter of three probes over at most 2**27 bits (16 MB)."""

    def __init__(self, log2: int, bits: np.ndarray):
        self.log2, self.bits = log2, bits

    @staticmethod
    def probes(h, log2: int):
        return [(h >> s) & ((1 << log2) - 1) for s in (0, 18, 36)]

    @classmethod
    def of(cls, hashes: DataFrame) -> BitTable:
        """Built by a bitwise-or aggregate; what comes to the driver is bounded by the table's size."""
        n = hashes.count()
        log2 = int(min(27, max(14, np.ceil(np.log2(48 * n + 1)))))
        probe = F.explode(F.array(*[F.expr(f"shiftrightunsigned(h, {s}) & {(1 << log2) - 1}L") for s in (0, 18, 36)]))
        words = hashes.select(probe.alias("b")).groupBy(F.expr("b >> 6").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(b & 63 AS INT))")).alias("m")).toPandas()
        table = np.zeros(1 << (log2 - 6), np.uint64)
        table[words["w"].to_numpy(np.int64)] = words["m"].to_numpy(np.int64).view(np.uint64)
        return cls(log2, table.view(np.uint8))

    def hits(self, h: np.ndarray) -> np.ndarray:
        """The places in h whose hash may be in the table."""
        left = np.arange(len(h))
        for shift in (0, 18, 36):
            b = (h[left] >> np.uint64(shift)) & np.uint64((1 << self.log2) - 1)
            left = left[(self.bits[b >> np.uint64(3)] >> (b & np.uint64(7)).astype(np.uint8)) & 1 == 1]
        return left


_RUNS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("run", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("words", T.ArrayType(T.LongType())), T.StructField("hits", T.ArrayType(T.StructType([T.StructField("h", T.LongType()), T.StructField("pos", T.IntegerType())])))])


def _runs(docs: DataFrame, table: BitTable, short: list[int], short_masks: bool) -> DataFrame:
    """Stretches of documents around positions that the bit table lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                words, offsets = word_hashes(part.column(1))
                seeds = [_seeds(words, offsets), *([_short_seeds(words, offsets)] if short_masks else [])]
                every = [(p[hit], h[hit]) for own in seeds for p, h in own for hit in [table.hits(h)]]
                for n in short:
                    p = np.array([k for a, b in zip(offsets[:-1], offsets[1:], strict=True) for k in range(a, b - n + 1)], np.int64)
                    h = np.array([_short_items(words[k : k + n]) for k in p], np.uint64)
                    hit = table.hits(h)
                    every.append((p[hit], h[hit]))
                rows = []
                if every and sum(len(p) for p, _ in every):
                    place, h = np.concatenate([p for p, _ in every]), np.concatenate([h for _, h in every])
                    order = np.lexsort((h, place))
                    place, h = place[order], h[order]
                    doc = np.searchsorted(offsets, place, "right") - 1
                    cut = np.flatnonzero((np.diff(doc) > 0) | (np.diff(place) > AROUND)) + 1
                    for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(place)], strict=True):
                        k = int(doc[a])
                        lo, hi = max(int(offsets[k]), int(place[a]) - AROUND), min(int(offsets[k + 1]), int(place[b - 1]) + _LONGEST + AROUND)
                        own = words[lo:hi]
                        rows.append((part.column(0)[k].as_py(), f"{lo - int(offsets[k])}-{xxhash.xxh64_hexdigest(own.tobytes())}", lo - int(offsets[k]), own.view(np.int64).tolist(), [{"h": x, "pos": p} for x, p in zip(h[a:b].view(np.int64).tolist(), (place[a:b] - offsets[k]).tolist(), strict=True)]))
                if rows:
                    kinds = (pa.int64(), pa.string(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.struct([("h", pa.int64()), ("pos", pa.int32())])))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=_RUNS.names)

    return docs.mapInArrow(run, _RUNS)


def _longest(total: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[int, int]:
    """The first longest (a, b) with total[b] >= total[a], of the given starts and ends."""
    n = len(total) - 1
    least, most = np.iinfo(np.int64).min, np.iinfo(np.int64).max
    low = np.minimum.accumulate(np.where(starts, total, most))
    high = np.maximum.accumulate(np.where(ends, total, least)[::-1])[::-1]
    best, i, j = (0, 0), 0, 0
    while i <= n and j <= n:
        if high[j] >= low[i]:
            if j - i > best[1] - best[0]:
                best = (i, j)
            j += 1
        else:
            i += 1
    return best


def _balance(same: np.ndarray, similarity: float) -> np.ndarray:
    """At each place the agreeing words before it, weighed so that a stretch has enough of them if this doesn't fall over it."""
    top = round(similarity * 100)
    return np.concatenate([[0], np.cumsum(np.where(same, 100 - top, -top))])


def longest_stretch(same: np.ndarray, similarity: float = 0.8) -> tuple[int, int, int]:
    """(start, words, agreeing words) of the longest stretch in which at least
    similarity of the words agree, beginning and ending with such a word; the
    first of equals."""
    if not same.any():
        return 0, 0, 0
    a, b = _longest(_balance(same, similarity), np.append(same, False), np.append(False, same))
    return a, b - a, int(same[a:b].sum())


def longest_words(same: np.ndarray, similarity: float = 0.8) -> int:
    """Words of the longest stretch in which at least similarity of the words agree, whatever it begins and ends with."""
    every = np.ones(len(same) + 1, bool)
    a, b = _longest(_balance(same, similarity), every, every)
    return b - a


_FOUND = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("item_id", T.LongType()), T.StructField("doc_start", T.IntegerType()), T.StructField("item_start", T.IntegerType()), T.StructField("n_words", T.IntegerType()), T.StructField("n_same", T.IntegerType())])


def overlaps(docs: DataFrame, benchmark: DataFrame, min_words: int = 13, similarity: float = 0.8) -> DataFrame:
    """One row for each document and benchmark item that overlap: doc_id, item_id,
    where the longest overlap starts in each (words), its words and how many agree."""
    texts = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").groupBy("text").agg(F.min("item_id").alias("item_id"))
    items = durable(texts.select("item_id", "text").filter("item_id IS NOT NULL AND text IS NOT NULL").mapInArrow(_item_rows, _ITEMS))
    seeds = durable(items.groupBy("words").agg(F.min(F.struct("item_id", "seeds")).alias("i")).select("i.item_id", F.explode("i.seeds").alias("s")).select("item_id", "s.h", F.col("s.pos").alias("off")))
    table = BitTable.of(seeds.select("h"))
    short = [r[0] for r in items.select(F.size("words").alias("n")).filter(f"n > 0 AND n < {min(map(len, MASKS))}").distinct().collect()]  # a few small numbers
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id IS NOT NULL AND text IS NOT NULL")
    short_masks = not items.filter(f"size(words) BETWEEN {min(map(len, MASKS))} AND {SHORT}").isEmpty()
    runs = durable(_runs(rows, table, short, short_masks))
    hits = runs.select("doc_id", "run", F.explode("hits").alias("x")).select("doc_id", "run", "x.h", "x.pos").join(seeds, "h")
    aligned = durable(hits.select("doc_id", "run", "item_id", (F.col("pos") - F.col("off")).alias("diag")).distinct())
    both = aligned.join(runs.select("doc_id", "run", "start", "words").dropDuplicates(["doc_id", "run"]), ["doc_id", "run"]).join(items.select("item_id", F.col("words").alias("item")), "item_id")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, item_id, diag, start, words, item in zip(*(batch.column(c).to_numpy(zero_copy_only=False) for c in range(6)), strict=True):
                # item[k] stands against words[k + shift]
                shift = int(diag) - int(start)
                a, b = max(0, -shift), min(len(item), len(words) - shift)
                if b <= a:
                    continue
                agree = np.zeros(len(item), bool)
                agree[a:b] = np.asarray(item[a:b]) == np.asarray(words[a + shift : b + shift])
                if longest_words(agree, similarity) >= min(min_words, len(item)):
                    at, n, same = longest_stretch(agree, similarity)
                    out.append((doc, item_id, at + int(diag), at, n, same))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), *[pa.int32()] * 4), strict=True)], names=_FOUND.names)

    found = both.select("doc_id", "item_id", "diag", "start", "words", "item").mapInArrow(verify, _FOUND)
    best = F.max(F.struct("n_words", "n_same", (-F.col("doc_start")).alias("d"), (-F.col("item_start")).alias("i"))).alias("b")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", (-F.col("b.d")).alias("doc_start"), (-F.col("b.i")).alias("item_start"), "b.n_words", "b.n_same")
