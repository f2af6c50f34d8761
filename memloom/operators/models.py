"""Operators around models that the caller supplies: scorers and embedders.

A scorer takes two lists of texts and returns a score for each pair; an embedder
takes a list of texts and returns a vector for each.  Both are called with Arrow
batches in the workers, so they must be picklable.
"""

from __future__ import annotations

import logging
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memloom.operators import store
from memloom.operators.graph import top_by

log = logging.getLogger(__name__)

Scorer = Callable[[list[str], list[str]], list[float]]
Embedder = Callable[[list[str]], np.ndarray]


def word_share(queries: list[str], texts: list[str]) -> list[float]:
    """A scorer without a model: the share of a query's words that the text holds."""
    out = []
    for q, t in zip(queries, texts, strict=True):
        own = set(re.findall("[a-z0-9]+", q.lower()))
        out.append(len(own & set(re.findall("[a-z0-9]+", t.lower()))) / len(own) if own else 0.0)
    return out


def hashed_words(texts: list[str], dim: int = 64) -> np.ndarray:
    """An embedder without a model: signed word counts by hash, of length one or zero."""
    out = np.zeros((len(texts), dim))
    for k, t in enumerate(texts):
        for w in re.findall(r"\w+", t.lower()):
            h = xxhash.xxh64_intdigest(w)
            out[k, h % dim] += 1 if h >> 63 else -1
    norm = np.sqrt((out**2).sum(1, keepdims=True))
    return np.divide(out, norm, out=out, where=norm > 0)


def embedded_queries(queries: DataFrame, embedder: Embedder) -> DataFrame:
    """(query_id, q) of queries (query_id, query_text).  A batch that the embedder fails on
    has no rows: its vectors are evidence that a recall can do without."""
    out = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("q", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            try:
                x = np.asarray(embedder(b.column(1).to_pylist()), float)
                if x.ndim != 2 or len(x) != b.num_rows:
                    raise ValueError(f"vectors of shape {x.shape} for {b.num_rows} texts")
            except Exception as e:  # whatever a remote model may raise
                log.warning("auxiliary embedder failed: %s", e)
                continue
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(x), pa.list_(pa.float64()))], names=out.names)

    return queries.select("query_id", F.coalesce("query_text", F.lit("")).alias("query_text")).mapInArrow(run, out)


def _scored(hits: DataFrame, queries: DataFrame, texts: DataFrame, scorer: Scorer, chars: int | None) -> DataFrame:
    """hits with a column ce; a hit whose document is missing fails the job."""
    body = F.substring("text", 1, chars) if chars else F.col("text")
    both = hits.select("query_id", "doc_id", "score", "rank").join(queries.select("query_id", "query_text"), "query_id").join(texts.select("doc_id", F.coalesce(body, F.lit("")).alias("text"), F.lit(True).alias("there")), "doc_id", "left")
    sound = both.withColumn("text", F.when(F.col("there"), F.col("text")).otherwise(F.raise_error(F.concat(F.lit("no text for candidate "), F.col("doc_id").cast("string"))).cast("string")))
    rows = sound.select("query_id", "doc_id", "score", "rank", F.coalesce("query_text", F.lit("")).alias("query_text"), "text")
    out = T.StructType([*[rows.schema[c] for c in ("query_id", "doc_id", "score", "rank")], T.StructField("ce", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ce = scorer(b.column(4).to_pylist(), b.column(5).to_pylist()) if b.num_rows else []
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array([float(x) for x in ce], pa.float64())], names=out.names)

    return rows.mapInArrow(run, out)


def rerank_blend(hits: DataFrame, queries: DataFrame, texts: DataFrame, scorer: Scorer = word_share, k: int = 5) -> DataFrame:
    """Of the first 2 * k hits (query_id, doc_id, score, rank) the k best by
    0.4 of their score and 6 times the scorer's, over the first 512 characters."""
    found = _scored(hits.filter(F.col("rank") <= 2 * k), queries, texts, scorer, 512)
    return top_by(found.select("query_id", "doc_id", (0.4 * F.col("score") + 0.6 * (F.col("ce") * 10)).alias("score")), k)


def rerank_replace(hits: DataFrame, queries: DataFrame, texts: DataFrame, scorer: Scorer = word_share, cap: int = 50) -> DataFrame:
    """The first ``cap`` hits by the scorer's score over whole texts alone; ties keep their order."""
    found = _scored(hits.filter(F.col("rank") <= cap), queries, texts, scorer, None)
    return top_by(found.select("query_id", "doc_id", F.col("ce").alias("score"), F.col("rank").alias("old")), cap, item="old").drop("old")


def embed_missing(atoms: DataFrame, embeddings: DataFrame, model: str, embedder: Embedder = hashed_words) -> DataFrame:
    """New rows (atom_id, model_id, embedding) for live atoms that the model lacks;
    once they are added, another call finds none.  Null texts are embedded as empty."""
    lacking = store.missing_embeddings(atoms, embeddings, model).select("id").join(atoms.select("id", F.coalesce("text", F.lit("")).alias("text")), "id")
    out = T.StructType([T.StructField("atom_id", atoms.schema["id"].dataType), T.StructField("model_id", T.StringType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = np.asarray(embedder(b.column(1).to_pylist()))
            if len(x) != b.num_rows:
                raise ValueError(f"{len(x)} vectors for {b.num_rows} texts")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([model] * b.num_rows), pa.array(list(x.astype(np.float32)), pa.list_(pa.float32()))], names=out.names)

    return lacking.mapInArrow(run, out)
