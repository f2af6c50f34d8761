"""Graph and dense retrieval together: two stages, learning from gaps, context."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from memloom.functions import text as tx
from memloom.operators import ranking
from memloom.operators.graph import top_by
from memloom.sources.tables import durable


def lexical_and_dense(dense: DataFrame, sparse: DataFrame, k: int = 10, dense_weight: float = 0.7, sparse_weight: float = 0.3) -> DataFrame:
    """Normalised fusion of a dense list with the first 2 * k of a sparse one, the k best."""
    fused = ranking.rrf([(dense, dense_weight), (sparse.filter(F.col("rank") <= 2 * k), sparse_weight)], normalized=True)
    return top_by(fused.select("query_id", "doc_id", "score"), k)


def two_stage(graph_hits: DataFrame, queries: DataFrame, vectors: DataFrame, unsure: DataFrame | None = None, k: int = 5, dense_k: int = 20, fall_back: bool = True) -> DataFrame:
    """Dense ranking of the graph's candidates, merged with the graph's own ranks.

    graph_hits is (query_id, doc_id, rank), queries (query_id, q) and vectors
    (doc_id, embedding).  Queries of which no candidate has a vector, and those of
    unsure (query_id), are searched densely among all vectors instead, unless
    fall_back is off.  Returns query_id, doc_id, score, source, rank.
    """
    hits = durable(graph_hits.select("query_id", "doc_id", "rank"))
    near = hits.select("query_id", "doc_id").join(vectors, "doc_id").join(queries, "query_id")
    dense = durable(top_by(near.select("query_id", "doc_id", ranking.dot(F.col("q"), F.col("embedding")).alias("score")), dense_k))
    if fall_back:
        if unsure is not None:
            dense = dense.join(unsure.select("query_id").distinct(), "query_id", "left_anti")
        open_ = durable(queries.join(dense.select("query_id").distinct(), "query_id", "left_anti"))
        dense = dense.unionByName(ranking.dense_top(open_, vectors, dense_k))
    return top_by(ranking.agreement_merge(hits, dense), k).select("query_id", "doc_id", "score", "source", "rank")


def learn_gaps(queries: DataFrame, graph_hits: DataFrame, dense_hits: DataFrame, docs: DataFrame, least: int = 1, most: int = 10_000, on_learn: Callable[[dict], None] | None = None) -> DataFrame:
    """Terms (term, frequency, first_query) of queries that the graph knows nothing about
    while dense search does.

    A term counts once for every such query, and once more for each of the query's
    three best dense hits one of whose own terms holds it.  Unlike a sequential learner the frequency is over
    the whole batch.  At most ``most`` are learnt, those of the first queries.
    on_learn is called for each of them, in this order, once they are written.
    """
    gap = queries.join(graph_hits.select("query_id").distinct(), "query_id", "left_anti").join(dense_hits.select("query_id").distinct(), "query_id", "left_semi")
    asked = gap.select("query_id", F.explode(F.array_distinct(tx.learner_candidates("query_text"))).alias("term"))
    best = dense_hits.filter("rank <= 3").select("query_id", "doc_id").join(docs.select("doc_id", "text"), "doc_id")
    seen = best.select("query_id", tx.learner_candidates("text").alias("own"))
    held = asked.join(seen, "query_id").filter(F.exists("own", lambda w: w.contains(F.col("term")))).select("query_id", "term")
    counted = asked.unionByName(held).groupBy("term").agg(F.count("*").alias("frequency"), F.min("query_id").alias("first_query"))
    learned = counted.filter(F.col("frequency") >= least).orderBy("first_query", "term").limit(most)
    if on_learn is None:
        return learned
    learned = durable(learned)
    for row in learned.orderBy("first_query", "term").toLocalIterator():  # no more than most
        on_learn(row.asDict())
    return learned


def inject_learned(results: DataFrame, queries: DataFrame, learned: DataFrame, docs: DataFrame, k: int = 50, boost: float = 0.5, most: int = 10_000) -> DataFrame:
    """results (query_id, doc_id, score) with documents that hold a learnt term.

    A term is meant by a query that shares one of its words; a document that the
    graph didn't find gets ``boost``.  There are at most ``most`` terms, which one
    automaton finds in a single pass over each text, as substrings.
    """
    terms = [r["term"] for r in learned.select("term").distinct().orderBy("term").limit(most + 1).collect()]
    if len(terms) > most:
        raise ValueError(f"more than {most} learnt terms")
    if not terms:
        return top_by(results.select("query_id", "doc_id", "score"), k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for t in terms:
            machine.add_word(t, t)
        machine.make_automaton()
        for batch in batches:
            found = [sorted({t for _, t in machine.iter(x.lower())}) if x else [] for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.string()))], names=["doc_id", "terms"])

    out = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("terms", T.ArrayType(T.StringType()))])
    held = docs.select("doc_id", "text").mapInArrow(run, out).select("doc_id", F.explode("terms").alias("term"))
    words = queries.select("query_id", F.explode(tx.query_words("query_text")).alias("word"))
    parts = learned.select("term", F.explode(F.split("term", " ")).alias("word"))
    wanted = words.join(parts, "word").select("query_id", "term").distinct()
    added = wanted.join(held, "term").select("query_id", "doc_id").distinct().join(results.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    return top_by(results.select("query_id", "doc_id", "score").unionByName(added.withColumn("score", F.lit(boost))), k)


def context_for(queries: DataFrame, recent: DataFrame, related: DataFrame, active: DataFrame, cap: int = 20) -> DataFrame:
    """Labels that set the context of each query: query_id, pos, label.

    Those of recent answers (query_id, pos, label) come first, then neighbours in the
    graph (query_id, pos, label), then the first ``cap`` active ones (pos, label),
    which every query shares.  Labels are lower-cased and kept once, at their first
    place; what the query says itself is left out.
    """
    own = lambda df, place: df.select("query_id", F.lit(place).alias("place"), "pos", F.lower("label").alias("label"))
    shared = F.broadcast(active.orderBy("pos", "label").limit(cap).agg(F.sort_array(F.collect_list(F.struct("pos", "label"))).alias("active")).withColumn("one", F.lit(1)))
    each = queries.select("query_id").withColumn("one", F.lit(1)).join(shared, "one").select("query_id", F.explode("active").alias("a")).select("query_id", "a.pos", "a.label")
    first = own(recent, 0).unionByName(own(related, 1)).unionByName(own(each, 2)).groupBy("query_id", "label").agg(F.min(F.struct("place", "pos")).alias("at"))
    new = first.join(queries.select("query_id", F.lower("query_text").alias("said")), "query_id").filter(~F.col("said").contains(F.col("label")))
    w = Window.partitionBy("query_id").orderBy("at", "label")
    return new.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= cap).select("query_id", "pos", "label")
