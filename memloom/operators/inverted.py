"""An approximate vector index: inverted lists around learnt centres.

Centres come from a sample of bounded size; every vector is then put into the list
of its best centre, and the lists are partitions of a table, so that a search
reads only those that its queries ask for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memloom.operators import ranking
from memloom.operators.graph import top_by


def list_count(n: int, most: int = 256) -> int:
    """The square root of the number of vectors, at most ``most``."""
    return max(1, min(int(n**0.5), most))


def learn_centres(vectors: DataFrame, most_lists: int = 256, sample: int = 10_000, rounds: int = 10) -> np.ndarray:
    """Centres by k-means over the ``sample`` vectors with the smallest hashes of their ids."""
    whole = vectors.filter("embedding IS NOT NULL")
    rows = whole.select("doc_id", "embedding").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()
    if not rows:
        return np.zeros((0, 0))
    x = np.array([r["embedding"] for r in rows], np.float64)
    n = list_count(whole.count(), min(most_lists, len(x)))
    centres = x[np.linspace(0, len(x) - 1, n).astype(int)].copy()
    for _ in range(rounds):
        own = _nearest(x, centres, 1)[:, 0]
        for k in range(n):
            if (own == k).any():
                centres[k] = x[own == k].mean(0)
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray, k: int) -> np.ndarray:
    """The k nearest centres of each row, nearest first."""
    far = (centres**2).sum(1)[None, :] - 2 * x @ centres.T
    return np.argsort(far, axis=1, kind="stable")[:, :k]


def assign(vectors: DataFrame, centres: np.ndarray, column: str = "embedding", id_col: str = "doc_id", n: int = 1) -> DataFrame:
    """(id, column, list): a row for each of the n nearest centres; null vectors have none."""
    id_type, vec_type = vectors.schema[id_col].dataType, vectors.schema[column].dataType
    n = min(n, len(centres))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not n:
                continue
            lists = _nearest(np.array(batch.column(1).to_pylist(), np.float64), centres, n)
            again = pa.array(np.repeat(np.arange(batch.num_rows), n))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(again), batch.column(1).take(again), pa.array(lists.ravel().astype(np.int32))], names=[id_col, column, "list"])

    out = T.StructType([T.StructField(id_col, id_type), T.StructField(column, vec_type), T.StructField("list", T.IntegerType())])
    return vectors.select(id_col, column).filter(F.col(column).isNotNull()).mapInArrow(run, out)


def write_index(vectors: DataFrame, centres: np.ndarray, path: str) -> DataFrame:
    """Every vector in its list, written with a folder for each list, and read back."""
    assign(vectors, centres).write.partitionBy("list").parquet(path)
    return vectors.sparkSession.read.parquet(path)


def search(index: DataFrame, centres: np.ndarray, queries: DataFrame, k: int = 10, probes: int = 10) -> DataFrame:
    """The k best inner products of queries (query_id, q) within their ``probes`` nearest
    lists: query_id, doc_id, score, rank.  With as many probes as lists it is exact."""
    asked = assign(queries, centres, "q", "query_id", probes)
    pairs = index.join(asked, "list")
    return top_by(pairs.select("query_id", "doc_id", ranking.dot(F.col("q"), F.col("embedding")).alias("score")), k)
