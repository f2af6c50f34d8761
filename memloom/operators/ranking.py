"""Lexical and dense retrieval, fusion and priors, for batches of queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type
from pyspark.sql.window import Window

from memloom.functions import text as tx
from memloom.operators.graph import top_by
from memloom.sources.tables import durable

#: Constants of the two fusions.
RRF_K = 60


#: What of a query batch may go to all tasks: (query, term) rows, and components of vectors.
MAX_ASKED, MAX_COMPONENTS = 200_000, 1 << 22
_DOCS, _CELLS = 512, 1 << 22
#: From so many queries on, vectors are dealt out by the scores that a task computes.
_LARGE_BATCH, _SCORES = 4096, 1 << 25


@dataclass(frozen=True)
class Bm25:
    """A term's part of a score, over tf, dl, df, n and avgdl, as a column and in numpy."""

    k1: float
    b: float
    delta: float
    idf: Callable

    def column(self) -> Column:
        tf, norm = F.col("tf"), self.k1 * (1 - self.b + self.b * F.col("dl") / F.col("avgdl"))
        return self.idf(F, F.col("n"), F.col("df")) * (self.delta + tf * (self.k1 + 1) / (tf + norm))

    def values(self, tf, dl, df, n, avgdl):
        norm = self.k1 * (1 - self.b + self.b * dl / avgdl)
        return self.idf(_Numpy, n, df) * (self.delta + tf * (self.k1 + 1) / (tf + norm))


class _Numpy:
    log, greatest, lit = staticmethod(np.log), staticmethod(np.maximum), staticmethod(float)


class Postings:
    """Term postings of (doc_id, tokens) with the statistics that BM25 needs.

    Scores are rounded to nine decimals, so that the order of summation never
    decides between equal documents."""

    def __init__(self, docs: DataFrame, tokens):
        self.every = docs.select("doc_id", tokens.alias("tokens"))
        self.lengths = self.every.select("doc_id", F.size("tokens").alias("dl"))
        self.postings = self.every.select("doc_id", F.size("tokens").alias("dl"), F.explode("tokens").alias("term")).groupBy("term", "doc_id", "dl").agg(F.count("*").alias("tf"))
        self.df = self.postings.groupBy("term").agg(F.count("*").alias("df"))

    def totals(self) -> DataFrame:
        """One row: number of documents and mean length."""
        return self.lengths.agg(F.count("*").cast("double").alias("n"), F.avg("dl").alias("avgdl"))

    def score(self, terms: DataFrame, part: Bm25, keep=None, top: int | None = None) -> DataFrame:
        """(query_id, doc_id, score): part summed over matching terms.

        terms is (query_id, term) with repeats; keep is a frame of documents, applied
        before any top-k; with top, each query has at least its best so many rows.
        A batch of at most MAX_ASKED distinct terms of queries goes to all tasks, which
        multiply matrices; a larger one is joined with the postings.
        """
        asked = terms.groupBy("query_id", "term").agg(F.count("*").alias("times"))
        rows = asked.limit(MAX_ASKED + 1).collect()
        if len(rows) <= MAX_ASKED:
            return self._multiplied(rows, terms.schema["query_id"].dataType, part, keep, top)
        wanted = asked.join(self.df, "term")
        hits = self.postings.join(wanted, "term").withColumn("one", F.lit(1)).join(F.broadcast(self.totals().withColumn("one", F.lit(1))), "one")
        if keep is not None:
            hits = hits.join(keep, "doc_id", "left_semi")
        return hits.groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("times") * part.column()), 9).alias("score"))

    def counted(self, vocabulary: list[str]) -> DataFrame:
        """(doc_id, dl, terms, tfs): how often each document has which of the vocabulary's
        terms, by their places in it."""
        doc = self.every.schema["doc_id"]
        out = T.StructType([doc, T.StructField("dl", T.IntegerType()), T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("tfs", T.ArrayType(T.IntegerType()))])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = pa.array(vocabulary, pa.string())
            for batch in (b.slice(at, 2000) for b in batches for at in range(0, b.num_rows, 2000)):
                tokens = batch.column(1)
                sizes = np.asarray(pc.fill_null(pc.list_value_length(tokens), 0)).astype(np.int64)
                place = np.asarray(pc.fill_null(pc.index_in(tokens.flatten(), known), -1)).astype(np.int64)
                owner = np.repeat(np.arange(len(sizes)), sizes)
                cell, tf = np.unique((owner * len(vocabulary) + place)[place >= 0], return_counts=True)
                ends = np.searchsorted(cell, np.arange(len(sizes) + 1) * len(vocabulary)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (cell % max(1, len(vocabulary)), tf)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes.astype(np.int32)), *lists], names=out.names)

        return self.every.mapInArrow(run, out)

    def _multiplied(self, rows: list, query_type: T.DataType, part: Bm25, keep, top: int | None) -> DataFrame:
        doc = self.every.schema["doc_id"]
        out = T.StructType([T.StructField("query_id", query_type), doc, T.StructField("score", T.DoubleType())])
        if not rows:
            return self.every.sparkSession.createDataFrame([], out)
        vocabulary = sorted({r["term"] for r in rows})
        ids = sorted({r["query_id"] for r in rows})
        at, query_at = {t: k for k, t in enumerate(vocabulary)}, {q: k for k, q in enumerate(ids)}
        cells = np.array([(at[r["term"]], query_at[r["query_id"]], r["times"]) for r in rows], np.int64)
        counted = durable(self.counted(vocabulary))
        df = np.zeros(len(vocabulary))
        for r in counted.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # a row per term asked for
            df[r["t"]] = r["count"]
        n, avgdl = counted.agg(F.count("*").cast("double"), F.avg("dl")).first()
        query_arrow = to_arrow_type(query_type)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = max(1, _CELLS // len(vocabulary))
            docs_at_once = min(_DOCS, block)
            own = pa.array(ids, query_arrow)
            for batch in (b.slice(k, docs_at_once) for b in batches for k in range(0, b.num_rows, docs_at_once)):
                dl = np.asarray(batch.column(1)).astype(float)
                sizes = np.asarray(pc.list_value_length(batch.column(2)))
                term, tf = (np.asarray(batch.column(c).flatten()).astype(np.int64) for c in (2, 3))
                row = np.repeat(np.arange(len(dl)), sizes)
                parts = np.zeros((len(dl), len(vocabulary)))
                parts[row, term] = part.values(tf, dl[row], df[term], n, avgdl)
                docs = np.asarray(batch.column(0))
                order = np.argsort(docs, kind="stable")
                for first in range(0, len(ids), block):
                    mine = cells[(cells[:, 1] >= first) & (cells[:, 1] < first + block)]
                    times = np.zeros((len(vocabulary), min(block, len(ids) - first)))
                    times[mine[:, 0], mine[:, 1] - first] = mine[:, 2]
                    scores = np.round(parts @ times, 9)
                    hit = scores > 0
                    if top is not None and top < len(dl):  # by score, then by id
                        best = order[np.argsort(-scores[order], axis=0, kind="stable")[:top]]
                        among = np.zeros_like(hit)
                        np.put_along_axis(among, best, True, 0)
                        hit &= among
                    d, q = np.nonzero(hit)
                    yield pa.RecordBatch.from_arrays([own.take(pa.array(q + first)), batch.column(0).take(pa.array(d)), pa.array(scores[d, q])], names=out.names)

        return (counted if keep is None else counted.join(keep, "doc_id", "left_semi")).mapInArrow(run, out)


def bm25_plus(k1: float = 1.5, b: float = 0.75, delta: float = 1.0) -> Bm25:
    return Bm25(k1, b, delta, lambda f, n, df: f.log((n + 1) / df))


def bm25_fts(k1: float = 1.2, b: float = 0.75) -> Bm25:
    return Bm25(k1, b, 0.0, lambda f, n, df: f.greatest(f.log((n - df + 0.5) / (df + 0.5)), f.lit(1e-6)))


def bm25_okapi(postings: Postings, terms: DataFrame, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    """Okapi scores; terms in over half the documents get a share of the mean idf."""
    n = postings.totals().withColumn("one", F.lit(1))
    raw = postings.df.withColumn("one", F.lit(1)).join(F.broadcast(n), "one").withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw").alias("mean")).withColumn("one", F.lit(1))
    idf = raw.join(F.broadcast(mean), "one").select("term", "n", "avgdl", F.when(F.col("raw") < 0, epsilon * F.col("mean")).otherwise(F.col("raw")).alias("idf"))
    asked = terms.groupBy("query_id", "term").agg(F.count("*").alias("times"))
    tf = F.col("tf")
    part = F.col("times") * F.col("idf") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return asked.join(idf, "term").join(postings.postings, "term").groupBy("query_id", "doc_id").agg(F.round(F.sum(part), 9).alias("score"))


def pruned_terms(terms: DataFrame, df: DataFrame, live_rows: DataFrame, share: float = 0.01, least: int = 10_000) -> DataFrame:
    """Query terms (query_id, pos, term) without those in more than a share of the live
    rows (column live, one row), once there are at least ``least``; the rarest stays."""
    every = terms.join(df, "term", "left").withColumn("df", F.coalesce("df", F.lit(0))).withColumn("one", F.lit(1)).join(F.broadcast(live_rows.withColumn("one", F.lit(1))), "one")
    rare = Window.partitionBy("query_id").orderBy("df", "pos")
    keep = (F.col("live") < least) | (F.col("df") <= share * F.col("live")) | (F.row_number().over(rare) == 1)
    return every.withColumn("keep", keep).filter("keep").select("query_id", "pos", "term")


def dot(a, b):
    """Inner product of two vector columns, in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a, b):
    """Cosine; zero where a vector is zero."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, 0.0).otherwise(dot(a, b) / norms)


def dense_top(queries: DataFrame, vectors: DataFrame, k: int, skip_own: bool = False, max_components: int = MAX_COMPONENTS, by=("query_id",)) -> DataFrame:
    """The k nearest of vectors (doc_id, embedding) for each of queries (query_id, q),
    or for each query and class of vectors named in by.

    A batch of queries with at most ``max_components`` numbers goes to all tasks, which
    multiply matrices and keep k rows for each query; a larger one goes in salted blocks,
    and so do the vectors, where each pair of blocks multiplies matrices in the same way and
    nothing that grows is sent around.  Scores are rounded to twelve decimals, so that the
    order of summation decides nothing.
    """
    size = queries.agg(F.coalesce(F.sum(F.size("q")), F.lit(0))).first()[0]
    more = [c for c in by if c != "query_id"]
    if size <= max_components:
        return top_by(_multiplied_vectors(queries.select("query_id", "q").collect(), queries.schema["query_id"].dataType, vectors, k, skip_own, more), k, by=by)
    stored = vectors.filter("embedding IS NOT NULL")
    blocks = 1 + size // max_components
    parts = 1 + stored.agg(F.coalesce(F.sum(F.size("embedding")), F.lit(0))).first()[0] // max(1, max_components // 8)
    salt = lambda name, n: F.pmod(F.xxhash64(name), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.filter("q IS NOT NULL").select("query_id", F.col("q").cast("array<double>").alias("q"), salt("query_id", blocks).alias("block"), every(parts).alias("part"))
    spread = stored.select("doc_id", "embedding", *more, salt("doc_id", parts).alias("part"), every(blocks).alias("block"))
    query_type = queries.schema["query_id"].dataType
    out = _nearest_schema(query_type, vectors, more)

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = [{"query_id": i, "q": q} for i, q in zip(left.column("query_id").to_pylist(), left.column("q").to_pylist(), strict=True)]
        batches = right.select(["doc_id", "embedding", *more]).combine_chunks().to_batches()
        found = list(_nearest(rows, query_type, k, skip_own, more, out.names)(iter(batches))) if rows else []
        return pa.Table.from_batches(found, to_arrow_schema(out)) if not found else pa.Table.from_batches(found).cast(to_arrow_schema(out))

    return top_by(asked.groupBy("block", "part").cogroup(spread.groupBy("block", "part")).applyInArrow(compare, out), k, by=by)


def _multiplied_vectors(queries: list, query_type: T.DataType, vectors: DataFrame, k: int, skip_own: bool, more: list[str]) -> DataFrame:
    """(query_id, doc_id, more, score): of each batch of vectors the k best for each query and class."""
    out = _nearest_schema(query_type, vectors, more)
    if not queries:
        return vectors.sparkSession.createDataFrame([], out)
    stored = vectors.select("doc_id", "embedding", *more).filter("embedding IS NOT NULL")
    if len(queries) > _LARGE_BATCH:  # small files of vectors would be multiplied in few tasks
        stored = stored.repartition(1 + stored.count() * len(queries) // _SCORES)
    return stored.mapInArrow(_nearest(queries, query_type, k, skip_own, more, out.names), out)


def _nearest_schema(query_type: T.DataType, vectors: DataFrame, more: list[str]) -> T.StructType:
    return T.StructType([T.StructField("query_id", query_type), vectors.schema["doc_id"], *[vectors.schema[c] for c in more], T.StructField("score", T.DoubleType())])


def _nearest(queries: list, query_type: T.DataType, k: int, skip_own: bool, more: list[str], names: list[str]) -> Callable:
    """A function of batches of vectors (doc_id, embedding, more) that multiplies matrices."""
    ids, query_arrow = [r["query_id"] for r in queries], to_arrow_type(query_type)
    sizes = {len(r["q"]) for r in queries}
    asked = {n: (np.array([j for j, r in enumerate(queries) if len(r["q"]) == n]), np.array([r["q"] for r in queries if len(r["q"]) == n], float)) for n in sizes}

    def best_rows(scores: np.ndarray) -> np.ndarray:
        """The rows of the k highest scores of each column, in order, ties to the first rows."""
        if len(scores) <= k or np.isnan(scores).any():
            return np.argsort(-scores, axis=0, kind="stable")[:k]
        turned = np.ascontiguousarray(scores.T)
        least = np.partition(turned, len(scores) - k, axis=1)[:, len(scores) - k]
        column, row = np.nonzero(turned >= least[:, None])
        order = np.lexsort((row, -turned[column, row], column))
        column, row = column[order], row[order]
        return row[np.arange(len(column)) - np.searchsorted(column, column) < k].reshape(-1, k).T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pa.array(ids, query_arrow)
        for batch in (b.slice(at, 4096) for b in batches for at in range(0, b.num_rows, 4096)):
            length = np.asarray(pc.fill_null(pc.list_value_length(batch.column(1)), -1))
            docs = batch.column(0).to_numpy(zero_copy_only=False)
            group = [str(tuple(x)) for x in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True)] if more else [""] * len(docs)
            group = np.array(group)
            for n, (places, q) in asked.items():
                for g in np.unique(group[length == n]):
                    rows = np.flatnonzero((length == n) & (group == g))
                    rows = rows[np.argsort(docs[rows], kind="stable")]
                    v = np.asarray(batch.column(1).take(pa.array(rows)).flatten()).astype(float).reshape(len(rows), n)
                    for first in range(0, len(places), 1024):
                        part = places[first : first + 1024]
                        scores = np.round(v @ q[first : first + 1024].T, 12)
                        if skip_own:
                            scores[docs[rows][:, None] == np.array([ids[j] for j in part])[None, :]] = -np.inf
                        best = best_rows(scores)
                        column = np.broadcast_to(np.arange(len(part)), best.shape)
                        sound = np.isfinite(scores[best, column]) if skip_own else np.ones(best.shape, bool)
                        at, j = rows[best[sound]], column[sound]
                        yield pa.RecordBatch.from_arrays([own.take(pa.array(part[j])), batch.column(0).take(pa.array(at)), *[batch.column(2 + c).take(pa.array(at)) for c in range(len(more))], pa.array(scores[best[sound], j])], names=names)

    return run


def similar_pairs(vectors: DataFrame, least: float, max_components: int = MAX_COMPONENTS) -> DataFrame:
    """(a, b, similarity) of all pairs a < b of vectors (doc_id, embedding) whose cosine is
    at least ``least``, by blocks: each pair of blocks is one matrix product, of which only
    similar pairs are returned.  Zero vectors have cosine 0."""
    size = vectors.agg(F.coalesce(F.sum(F.size("embedding")), F.lit(0))).first()[0]
    blocks = 1 + size // max_components
    own = F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int")
    spread = vectors.select("doc_id", "embedding", own.alias("own"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other"))
    placed = spread.select("doc_id", "embedding", "own", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))
    kind = vectors.schema["doc_id"].dataType
    out = T.StructType([T.StructField("a", kind), T.StructField("b", kind), T.StructField("similarity", T.DoubleType())])

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = []
        sides = [pdf[pdf["own"] == k] for k in (pdf["x"].iloc[0], pdf["y"].iloc[0])]
        units = []
        for side in sides:
            m = np.array(side["embedding"].tolist(), float).reshape(len(side), -1)
            norm = np.sqrt((m * m).sum(1, keepdims=True))
            units.append((side["doc_id"].to_numpy(), np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)))
        (ids, m), (others, n) = units
        for at in range(0, len(ids) if len(others) else 0, 1024):
            scores = m[at : at + 1024] @ n.T
            i, j = np.nonzero(scores >= least - 1e-9)
            a, b = ids[at + i], others[j]
            keep = a < b if pdf["x"].iloc[0] == pdf["y"].iloc[0] else a != b
            parts.append(pd.DataFrame({"a": np.minimum(a, b)[keep], "b": np.maximum(a, b)[keep], "similarity": scores[i, j][keep]}))
        return pd.concat(parts) if parts else pd.DataFrame({"a": [], "b": [], "similarity": []})

    return placed.groupBy("x", "y").applyInPandas(compare, out).withColumn("similarity", F.round("similarity", 9)).filter(F.col("similarity") >= least)


def ranked(scores: DataFrame, by=("query_id",)) -> DataFrame:
    """The 1-based position of each row in its list."""
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "doc_id")))


def rrf(lists: list[tuple[DataFrame, float]], k: int = RRF_K, normalized: bool = False) -> DataFrame:
    """Reciprocal rank fusion of (query_id, doc_id, rank) lists with weights."""
    total = sum(w for _, w in lists) if normalized else 1.0
    every = None
    for place, (one, w) in enumerate(lists):
        part = one.select("query_id", "doc_id", (F.lit(w / total) / (k + F.col("rank"))).alias("part"), F.lit(place).alias("place"), "rank")
        every = part if every is None else every.union(part)
    return every.groupBy("query_id", "doc_id").agg(tx.rounded(F.sum("part"), 12).alias("score"), F.min(F.struct("place", "rank")).alias("first"))


def agreement_merge(graph_hits: DataFrame, dense_hits: DataFrame, both: float = 100, dense_only: float = 50, graph_only: float = 30) -> DataFrame:
    """Full outer merge of two rank lists (1-based): what both hold is above all else,
    then dense hits, then hits of the graph alone."""
    if not both > dense_only > graph_only:
        raise ValueError("weights must fall from agreement over dense hits to graph hits")
    a = graph_hits.select("query_id", "doc_id", (F.col("rank") - 1).alias("ra"))
    b = dense_hits.select("query_id", "doc_id", (F.col("rank") - 1).alias("rb"))
    score = F.when(F.col("ra").isNotNull() & F.col("rb").isNotNull(), both / (F.least("ra", "rb") + 1) + dense_only).when(F.col("ra").isNotNull(), graph_only / (F.col("ra") + 1)).otherwise(dense_only / (F.col("rb") + 1))
    source = F.when(F.col("ra").isNotNull() & F.col("rb").isNotNull(), "both").when(F.col("ra").isNotNull(), "graph").otherwise("dense")
    return a.join(b, ["query_id", "doc_id"], "full_outer").select("query_id", "doc_id", score.alias("score"), source.alias("source"))


def facet_boost(fused: DataFrame, facets: DataFrame, labels: DataFrame, factor: float = 1.15) -> DataFrame:
    """fused with scores raised where a candidate has a facet value among the query's labels."""
    hit = fused.select("query_id", "doc_id").join(facets.select(F.col("atom_id").alias("doc_id"), F.col("value").alias("label")), "doc_id").join(labels, ["query_id", "label"], "left_semi").select("query_id", "doc_id").distinct().withColumn("facet", F.lit(True))
    return fused.join(hit, ["query_id", "doc_id"], "left").withColumn("facet", F.coalesce("facet", F.lit(False))).withColumn("score", F.when(F.col("facet"), F.col("score") * factor).otherwise(F.col("score")))


def priors(fused: DataFrame, atoms: DataFrame, now: int, window: tuple[int, int] | None = None) -> DataFrame:
    """Scores times importance and freshness; a time window restricts instead of decaying."""
    both = fused.join(atoms.select(F.col("id").alias("doc_id"), tx.effective_time().alias("t"), "importance"), "doc_id")
    if window:
        return both.filter(F.col("t").between(*window)).withColumn("score", F.col("score") * tx.importance_factor("importance")).drop("t", "importance")
    return both.withColumn("score", tx.rounded(F.col("score") * tx.importance_factor("importance") * tx.time_factor(F.lit(now) - F.col("t")), 12)).drop("t", "importance")


def interleave(hits: DataFrame, cap: int = 64) -> DataFrame:
    """Round robin over classes: of hits (query_id, class_pos, doc_id, score) the first
    cap, each class in its own order, then (position beyond cap) the rest by score."""
    own = Window.partitionBy("query_id", "class_pos").orderBy(F.desc("score"), "doc_id")
    turn = hits.withColumn("turn", F.row_number().over(own))
    place = Window.partitionBy("query_id").orderBy("turn", "class_pos")
    headed = turn.withColumn("place", F.row_number().over(place))
    tail = Window.partitionBy("query_id").orderBy(F.when(F.col("place") <= cap, F.col("place")).otherwise(cap + 1), F.desc("score"), "doc_id")
    return headed.withColumn("position", F.row_number().over(tail)).drop("turn", "place")


def identifier_boost(results: DataFrame, query_ids, content_ids, factor: float = 1.5) -> DataFrame:
    """Scores times factor for each identifier that query and content share, ranked anew."""
    both = F.size(F.array_intersect(query_ids, content_ids))
    return ranked(results.withColumn("score", F.col("score") * F.pow(F.lit(factor), both)).drop("rank"))
