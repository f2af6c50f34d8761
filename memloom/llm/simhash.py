"""Near-duplicate documents by SimHash and tiled exact comparison.

A document's fingerprint has a bit set where over half of its shingle hashes
have it set.  Documents with fingerprints that differ in at most ``radius``
bits are linked, and the links' connected components are the groups.

Equal fingerprints are compared once.  The distinct ones go into cells by the
population counts of their upper and lower halves, and cells into tiles of at
most about ``TILE`` fingerprints.  A pair of tiles is compared exactly, with
numpy's exclusive-or and bit counts, unless the population counts of the halves
differ by more than the radius in sum: then no pair of theirs can be near.  A
comparison returns at most one row for each of its fingerprints, a link to the
smallest one of its group within the pair of tiles, and never a group's pairs.

near_duplicates() does this with 64 bits for each row.  similar_documents() does it with
``BITS`` bits of the set of shingles of each document, which tell its Jaccard similarity
to another: at 0.8 two fingerprints differ in 155 of 1024 bits on average with a deviation
of 11.5, at 0.85 in 132, at 0.75 in 177, at 0.7 in 196 and those of unrelated texts in 512.
``REACH`` is one deviation beyond 155.  So a pair is linked with a probability of 0.84
right at 0.8, of 0.998 at 0.85, and of 0.002 at 0.7.  Sets whose sizes differ by more than
``RATIO`` can't be that similar (the smaller size over the larger one bounds the similarity),
so they are no pair; cells and blocks by size are compared only where a pair can be.

Defined results: a null text is an empty one; a text without words has the
fingerprint zero and is linked like any other; a text of fewer words than a
shingle is a single shingle.  Repeated rows give repeated rows; a null id is a
row of its own and never the name of a group unless all its members' are null.
Other columns are ignored, whatever they are called; an empty table gives an
empty table.

For similar_documents(), words and shingles are those of a text in lower case (A-Z);
rows of equal id and text are one document; of a group the row of the smallest id
stands for it, then that of the smallest hash of its text, and a null id only where
there is no other; texts without words are one group.

Cost: the comparisons grow with the square of the number of distinct
fingerprints, less what the population counts and sizes rule out; that is the method's.
Over the check tables' lengths, sizes leave an eighth of the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memloom.llm._common import durable
from memloom.llm.components import smallest_reachable

TILE = 16384
_BLOCK = 256
#: Fingerprints that a cell should hold at least on average, over some 26 x 26 likely pairs of counts.
_CELL = 4096
#: Fingerprints of sets of shingles: bits, radius, and fingerprints of a tile.
BITS, REACH = 1024, 166
WIDE_TILE = 32768
#: The least size of a set over that of another one that is 0.8 similar; a wide block's fingerprints.
RATIO, _WIDE_BLOCK = (4, 5), 64
#: Words of a fingerprint that are compared for all pairs; the others only where these are within the radius.
_FIRST = 7
#: Texts that are split at a time, so that a batch's words don't fill a worker's memory.
_TEXTS = 200

def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    """The 64-bit fingerprint of the whole text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= width:
        hashes = np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = np.concatenate([[0], ends[: n - width]]).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)], np.uint64)
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536]
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * total > len(hashes), bitorder="little")
    return int(bits.view(np.uint64)[0])


_PRINTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("fp", T.LongType())])


def fingerprints(docs: DataFrame, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) for every row; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x.as_py(), width) for x in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=_PRINTS.names)

    return docs.selectExpr(f"CAST(`{id_col}` AS BIGINT) AS doc_id", f"`{text_col}` AS text").mapInArrow(run, _PRINTS)


def _roots(n: int, chunks: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest index of each of n nodes' group, from chunks of links."""
    root = np.arange(n)
    for a, b in chunks:
        while True:
            x, y = root[a], root[b]
            apart = x != y
            if not apart.any():
                break
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root = up
    return root


def near_groups(left: np.ndarray, right: np.ndarray | None, radius: int, sizes: list[np.ndarray] | None = None, ratio: tuple[int, int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, root) between places in left and then right, that connect what is
    near within one tile or across two; at most one for each fingerprint.  A fingerprint
    is a row of 64-bit numbers.  With a ratio, sizes of left (and right) that differ by more
    are not near."""
    n = len(left) + (0 if right is None else len(right))
    other = left if right is None else right
    shift = 0 if right is None else len(left)
    width = left.shape[1]
    first = min(width, _FIRST)
    size, step = (_BLOCK if width == 1 else _WIDE_BLOCK), 16
    mass, mass_of_other = (np.zeros(len(x), np.int64) if ratio is None else np.asarray(sizes[k], np.int64) for x, k in ((left, 0), (other, -1)))
    by_word, others_by_word = np.ascontiguousarray(left.T), np.ascontiguousarray(other.T)

    # within a pair of tiles, blocks by the population counts of the quarters are skipped in the same way
    def quarters(x: np.ndarray) -> np.ndarray:
        parts = [np.bitwise_count((x >> np.uint64(16 * k)) & np.uint64(0xFFFF)).astype(np.int64) for k in range(4)] if width == 1 else [np.bitwise_count(x[:, k::4]).astype(np.int64) for k in range(4)]
        return np.stack([part.sum(1) for part in parts], 1)

    def blocks(x: np.ndarray, m: np.ndarray):
        q = np.concatenate([quarters(x), m[:, None]], 1)
        order = np.lexsort((x[:, 0], q[:, 3], q[:, 2], q[:, 1], q[:, 0], m))
        return [(order[at : at + size], q[order[at : at + size]].min(0), q[order[at : at + size]].max(0)) for at in range(0, len(x), size)]

    space: dict = {}

    def apart(rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        """How many bits of the first words differ, in arrays that the next call uses again."""
        shape = len(rows), len(cols)
        if shape not in space:
            space.clear()
            space[shape] = [np.empty(shape, kind) for kind in (np.uint64, np.uint8, np.uint8, np.uint16)]
        bits, count, three, total = space[shape]
        for k in range(first):
            np.bitwise_xor(by_word[k, rows][:, None], others_by_word[k, cols][None, :], out=bits)
            if k % 3:
                three += np.bitwise_count(bits, out=count)
            else:  # a byte holds the counts of three words
                if k == 3:
                    total[...] = three
                elif k:
                    total += three
                np.bitwise_count(bits, out=three)
        if first <= 3:
            return three
        total += three
        return total

    def chunks() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        mine, theirs = blocks(left, mass), blocks(other, mass_of_other)
        low, high = np.array([b[1] for b in theirs]), np.array([b[2] for b in theirs])
        for k, (rows, lo, hi) in enumerate(mine):
            gap = np.maximum(0, np.maximum(lo - high, low - hi))[:, :4].sum(1)
            able = gap <= radius
            if ratio is not None:
                able &= may_pair(lo[4], hi[4], low[:, 4], high[:, 4], ratio)
            near = np.flatnonzero(able)
            if right is None:
                near = near[near >= k]
            for at in range(0, len(near), step):
                cols = np.concatenate([theirs[j][0] for j in near[at : at + step]])
                some = apart(rows, cols)
                i, j = np.nonzero(some <= radius)
                if ratio is not None and len(i):
                    a, b = mass[rows[i]], mass_of_other[cols[j]]
                    fit = may_pair(a, a, b, b, ratio)
                    i, j = i[fit], j[fit]
                if width > first and len(i):
                    rest = np.bitwise_count(left[rows[i], first:] ^ other[cols[j], first:]).sum(1, dtype=np.int64)
                    close = some[i, j] + rest <= radius
                    i, j = i[close], j[close]
                if len(i):
                    yield rows[i], cols[j] + shift

    if not len(left) or not len(other):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    root = _roots(n, chunks())
    members = np.flatnonzero(root != np.arange(n))
    return members, root[members]


def may_pair(low, high, other_low, other_high, ratio: tuple[int, int]):
    """Whether of two ranges of sizes one size can be at least the ratio of the other."""
    num, den = ratio
    return (den * high >= num * other_low) & (den * other_high >= num * low)


def near_links(distinct: DataFrame, radius: int = 4, tile: int = TILE, bits: int = 64, ratio: tuple[int, int] | None = None) -> DataFrame:
    """Links (a, b) between the nodes of distinct fingerprints (node, words); their
    components are those of all pairs within the radius.  words is an array of bits / 64
    longs.  With a ratio, distinct has a size as well, and pairs are those whose smaller
    size is at least this ratio (numerator, denominator) of the larger one."""
    spark = distinct.sparkSession
    node = distinct.schema["node"].dataType
    out = T.StructType([T.StructField("a", node), T.StructField("b", node)])
    width, half = bits // 64, bits // 2
    # cells are as wide as leaves each some thousand fingerprints, if there are as many
    grain, n = bits, distinct.count()
    # where the radius is as wide as the counts spread (some eight deviations of each half), cells rule nothing out
    while 2 * radius < bits // 4 and grain > 1 and n * (grain // 2) ** 2 >= _CELL * 676 * width:
        grain //= 2
    counts = "aggregate(slice(words, {0}, {1}), 0, (s, x) -> s + bit_count(x))"
    if width == 1:
        high, low = "bit_count(shiftrightunsigned(get(words, 0), 32))", "bit_count(get(words, 0) & 4294967295L)"
    else:
        high, low = counts.format(1, width // 2), counts.format(1 + width // 2, width - width // 2)
    size, band = F.lit(0).cast("long"), F.lit(0)
    if ratio is not None:
        # bands of sizes, finer where there is more to compare: of a finer one's neighbours more is out of reach
        size, fine = F.col("size").cast("long"), 1
        while fine < 16 and n >= 2 * fine * 40 * _CELL:
            fine *= 2
        band = F.when(size == 0, -1).otherwise(F.floor(F.log(size.cast("double")) * (fine / math.log(ratio[1] / ratio[0]))).cast("int"))
    placed = distinct.select("node", "words", size.alias("size"), F.expr(f"CAST({high} DIV {grain} AS INT)").alias("h"), F.expr(f"CAST({low} DIV {grain} AS INT)").alias("l"), band.alias("band"))
    found = placed.groupBy("h", "l", "band").agg(F.count("*").alias("count"), F.min("size").alias("least"), F.max("size").alias("most")).collect()  # at most (half + 1) ** 2 rows without bands, some thousand bands without counts
    cells = {(r["h"], r["l"], r["band"]): -(-r["count"] // tile) for r in found}
    span = {(r["h"], r["l"], r["band"]): (r["least"], r["most"]) for r in found}
    if not cells:
        return spark.createDataFrame([], out)
    assert len(cells) <= (half + 1) ** 2
    ids, n = {}, 0
    for cell in sorted(cells):
        ids[cell] = n
        n += cells[cell]

    def apart(x: tuple[int, int, int], y: tuple[int, int, int]) -> int:
        """The least difference of the halves' population counts between two cells."""
        return sum(max(0, (abs(i - j) - 1) * grain + 1) if i != j else 0 for i, j in zip(x[:2], y[:2], strict=True))

    # a tile's id is its cell's first id plus a part; partners come as ranges of ids
    rows = []
    for cell, first in ids.items():
        near = [other for other in ids if apart(cell, other) <= radius and (ratio is None or may_pair(*span[cell], *span[other], ratio))]
        forward, back = ([(ids[x], cells[x]) for x in near if (x >= cell) == ahead] for ahead in (True, False))
        rows.append((*cell, first, cells[cell], forward, back))
    plan = spark.createDataFrame(rows, "h int, l int, band int, first int, parts int, forward array<struct<first:int,parts:int>>, back array<struct<first:int,parts:int>>")
    tiles = (
        placed.join(F.broadcast(plan), ["h", "l", "band"])
        .withColumn("tile", F.expr("first + CAST(pmod(xxhash64(node), parts) AS INT)"))
        .groupBy("tile")
        .agg(F.collect_list(F.struct("node", "words", "size")).alias("own"), F.first("forward").alias("forward"), F.first("back").alias("back"))
    )
    spread = "flatten(transform({0}, r -> sequence(r.first, r.first + r.parts - 1)))"
    partners = tiles.select(
        "tile",
        F.expr("transform(own, x -> x.node)").alias("nodes"),
        F.expr("flatten(transform(own, x -> x.words))").alias("words"),
        F.expr("transform(own, x -> x.size)").alias("sizes") if ratio is not None else F.lit(None).cast("array<bigint>").alias("sizes"),
        F.explode(F.expr(f"concat(transform(filter({spread.format('forward')}, t -> t >= tile), t -> struct(tile AS x, t AS y)), transform(filter(concat({spread.format('back')}, {spread.format('forward')}), t -> t < tile), t -> struct(t AS x, tile AS y)))")).alias("pair"),
    ).select("pair.x", "pair.y", (F.col("tile") == F.col("pair.x")).alias("is_x"), "nodes", "words", "sizes")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        order = pdf["is_x"].to_numpy().argsort()[::-1]
        tiles = [np.asarray(pdf["words"].iloc[k], np.int64).view(np.uint64).reshape(-1, width) for k in order]
        nodes = np.concatenate([np.asarray(pdf["nodes"].iloc[k]) for k in order])
        sizes = None if ratio is None else [np.asarray(pdf["sizes"].iloc[k], np.int64) for k in order]
        a, b = near_groups(tiles[0], tiles[1] if len(tiles) > 1 else None, radius, sizes, ratio)
        return pd.DataFrame({"a": nodes[a], "b": nodes[b]})

    return partners.groupBy("x", "y").applyInPandas(compare, out)


def near_duplicates(docs: DataFrame, width: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, fingerprint (hex) and component_id."""
    prints = durable(fingerprints(docs, width, id_col, text_col))
    distinct = durable(prints.groupBy("fp").agg(F.min("doc_id").alias("first_doc")))
    links = near_links(distinct.select(F.col("fp").alias("node"), F.array("fp").alias("words")), radius)
    roots = smallest_reachable(links)
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_doc", F.coalesce("root", "fp").alias("root"))
    named = durable(named)
    least = durable(named.groupBy("root").agg(F.min("first_doc").alias("component_id")))
    of_print = durable(named.join(least, "root").select("fp", "component_id"))
    return prints.join(of_print, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# ---- documents by the similarity of their sets of shingles ------------------------

_digest = xxhash.xxh64_intdigest
_MULTIPLY = np.array([_digest(b"multiply", k) | 1 for k in range(BITS // 64)], np.uint64)
_PLACE = [_digest(b"place", k) | 1 for k in range(256)]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted hashes of the distinct shingles of each text."""
    split = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
    if isinstance(split, pa.ChunkedArray):
        split = split.combine_chunks()
    offsets = np.asarray(split.offsets).astype(np.int64)
    coded = split.flatten()
    keep = np.asarray(pc.binary_length(coded)) > 0
    before = np.concatenate([[0], np.cumsum(keep)])
    offsets = before[offsets - offsets[0]]
    coded = coded.filter(pa.array(keep)).dictionary_encode()
    of = np.array([_digest(w.lower()) for w in coded.dictionary.cast(pa.large_binary()).to_pylist()], np.uint64)
    words = of[np.asarray(coded.indices)] if len(of) else np.empty(0, np.uint64)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        k = min(width, b - a)
        if not k:
            yield np.empty(0, np.uint64)
            continue
        h = np.full(b - a - k + 1, np.uint64(k))
        for at in range(k):
            h += words[a + at : b - k + 1 + at] * np.uint64(_PLACE[at])
        yield np.unique(_mix(h))


def set_fingerprint(own: np.ndarray) -> np.ndarray:
    """The fingerprint of a set of shingle hashes, as 64-bit numbers."""
    total = np.zeros(BITS, np.int64)
    for at in range(0, len(own), 255):  # a byte holds the counts of so many
        part = _mix(own[at : at + 255, None] * _MULTIPLY)
        total += np.unpackbits(part.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.uint8)
    return np.packbits(2 * total > len(own), bitorder="little").view(np.uint64)


_SET_PRINTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("t", T.LongType()), T.StructField("key", T.StringType()), T.StructField("size", T.LongType()), T.StructField("words", T.ArrayType(T.LongType()))])


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, _TEXTS):
            yield batch.slice(at, _TEXTS)


def _set_prints(rows: DataFrame, width: int) -> DataFrame:
    """(doc_id, t, key, size, words) of (doc_id, t, text): size and fingerprint of the set of shingles, and a key for both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            sizes, prints = [], []
            for own in shingle_sets(batch.column(2), width):
                sizes.append(len(own))
                prints.append(set_fingerprint(own))
            keys = [xxhash.xxh3_128_hexdigest(x.tobytes() + n.to_bytes(8, "little")) for x, n in zip(prints, sizes, strict=True)]
            flat = pa.array(np.concatenate(prints).view(np.int64))
            words = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * (BITS // 64), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.string()), pa.array(sizes, pa.int64()), words], names=_SET_PRINTS.names)

    return rows.mapInArrow(run, _SET_PRINTS)


def similar_documents(docs: DataFrame, width: int = 5, radius: int = REACH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per distinct document of docs, by id and text: doc_id, t (the hash xxhash64 of its
    text), component_id (the smallest id of its group) and stays, true for one document
    of each group."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("t"), F.col(text_col).alias("text"))
    prints = durable(_set_prints(rows, width))
    head = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "t")).alias("head")
    distinct = durable(prints.groupBy("key").agg(head, F.first("size").alias("size"), F.first("words").alias("words")))
    roots = smallest_reachable(near_links(distinct.select(F.col("key").alias("node"), "words", "size"), radius, WIDE_TILE, BITS, RATIO))
    named = durable(distinct.select("key", "head").join(roots.withColumnRenamed("node", "key").hint("merge"), "key", "left").select("key", "head", F.coalesce("root", "key").alias("root")))
    least = durable(named.groupBy("root").agg(F.min("head").alias("first")))
    of_set = durable(named.join(least.hint("merge"), "root").select("key", "first"))
    out = prints.select("doc_id", "t", "key").distinct().join(of_set.hint("merge"), "key")
    return out.select("doc_id", "t", F.col("first.doc_id").alias("component_id"), F.expr("doc_id <=> first.doc_id AND t = first.t").alias("stays"))
