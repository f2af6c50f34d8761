"""Boundary cases: mining those that context resolves, and a benchmark over named ones."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from memloom.functions import entities
from memloom.functions import text as tx
from memloom.operators.graph import EntityGraph, boundary
from memloom.sources.tables import durable

CONFIDENCE = {"none": 0, "low": 1, "medium": 2, "high": 3}

# The built-in corpus (id, content, value, question) ...
BUILT_IN_DOCS = [
    ("n1", "System latency on 2025-07-16 was 199ms at the 99th percentile.", "199ms", "What was the P99 latency on 2025-07-16?"),
    ("n2", "System latency on 2025-07-16 was 257ms at the 99th percentile.", "257ms", "What was the P99 latency on 2025-07-16?"),
    ("n3", "Meeting room A-512 has capacity of 11 people.", "11 people", "Capacity of meeting room A-512?"),
    ("n4", "Dr. Taylor Smith leads the Horizon initiative.", "Dr. Taylor Smith", "Who leads Horizon?"),
] + [
    (f"atlas-{n}", f"Project Atlas latency on 2025-08-0{n} was {ms}ms in production. Atlas telemetry was reviewed by the performance team.", f"{ms}ms", f"What was the Project Atlas latency on 2025-08-0{n}?")
    for n, ms in enumerate((121, 130, 147, 160, 171, 180, 194, 153), start=1)
]
# ... and its cases (id, query, expected value, whether it should be trusted, context).
BUILT_IN_CASES = [
    ("ambiguous-no-context", "What was the P99 latency on 2025-07-16?", None, False, []),
    ("ambiguous-with-context", "What was the P99 latency on 2025-07-16?", "199ms", True, ["199ms"]),
    ("clear-room-capacity", "Capacity of meeting room A-512?", "11 people", True, []),
    ("clear-entity-query", "Who leads Horizon?", "Dr. Taylor Smith", True, []),
    ("atlas-latency-query", "What was the Project Atlas latency on 2025-08-08?", "153ms", True, []),
    ("nonsense-query", "xyzzy nonexistent gibberish", None, False, []),
]


def trusted():
    """Whether a diagnosis (confidence, context_needed) looks safe."""
    return F.col("confidence").isin("medium", "high") & ~F.col("context_needed")


def _rank(confidence):
    rank = F.lit(-1)
    for name, place in CONFIDENCE.items():
        rank = F.when(confidence == name, place).otherwise(rank)
    return rank


def diagnose(graph: EntityGraph, queries: DataFrame, context: DataFrame | None = None, k: int = 5) -> DataFrame:
    """Best document and diagnosis of every query (query_id, query_text) with a result."""
    hits = durable(graph.query(queries, k, context).select("query_id", "doc_id", "score", "rank"))
    words = queries.select("query_id", F.explode(tx.query_words("query_text")).alias("word"))
    top = hits.filter("rank = 1").select("query_id", F.col("doc_id").alias("top"))
    return boundary(hits, graph, words).join(top, "query_id")


def frequent_labels(graph: EntityGraph, least: int = 2, most: int = 50) -> DataFrame:
    """The ``most`` most frequent labels as queries: query_id, query_text, freq."""
    return graph.frequency.filter(F.col("freq") >= least).orderBy(F.desc("freq"), "label").limit(most).select(F.col("label").alias("query_id"), F.col("label").alias("query_text"), "freq")


def mine(graph: EntityGraph, queries: DataFrame, k: int = 5, terms: int = 4, pairs: bool = True, most: int = 10) -> DataFrame:
    """Queries (query_id, query_text, freq) that ask for context and become trustworthy
    with some of what they suggest: the first of single terms, then pairs, that
    makes the diagnosis better, or equal with another best document.

    All trials of all queries are one batch.
    """
    before = durable(diagnose(graph, queries, k=k).filter((F.col("recommended_action") == "request_context") & (F.size("suggested_context") > 0)))
    choices = [[n] for n in range(terms)] + ([list(c) for c in combinations(range(terms), 2)] if pairs else [])
    of = F.array(*[F.struct(F.lit(place).alias("trial"), F.array(*[F.lit(n) for n in choice]).alias("chosen")) for place, choice in enumerate(choices)])
    asked = before.join(queries, "query_id").select("query_id", "query_text", "freq", F.col("suggested_context").alias("s"), F.explode(of).alias("c"))
    asked = asked.filter(F.array_max("c.chosen") < F.size("s")).select(F.struct("query_id", F.col("c.trial").alias("trial")).alias("id"), "query_text", "freq", F.transform("c.chosen", lambda n: F.element_at("s", n + 1)).alias("context"))
    trials = durable(asked.withColumnRenamed("id", "query_id"))
    after = diagnose(graph, trials, trials.select("query_id", F.explode("context").alias("word")), k).filter(trusted())
    old = before.select(F.col("query_id").alias("query"), F.col("top").alias("baseline_top"), F.col("confidence").alias("baseline_confidence"), F.size("suggested_context").alias("n_suggested"))
    both = after.select("query_id", F.col("query_id.query_id").alias("query"), "top", "confidence").join(trials.select("query_id", "freq", "context"), "query_id").join(old, "query")
    gain = _rank(F.col("confidence")) - _rank(F.col("baseline_confidence"))
    good = both.filter((gain > 0) | ((gain == 0) & (F.col("top") != F.col("baseline_top"))))
    first = good.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy("query_id.trial"))).filter("place = 1")
    return first.select("query", "freq", "baseline_top", "baseline_confidence", "n_suggested", F.col("context").alias("recovery_context"), F.col("top").alias("recovery_top"), F.col("confidence").alias("recovery_confidence")).orderBy(F.desc("freq"), "query").limit(most)


def mined_cases(mined: DataFrame) -> DataFrame:
    """Two cases for each mined query: alone, not to be trusted, and with its context."""
    slug = lambda c: F.when(tx.slug(c) == "", "query").otherwise(tx.slug(c))
    none = F.array().cast("array<string>")
    alone = mined.select(F.concat(F.lit("mined-"), slug("query"), F.lit("-ambiguous")).alias("case_id"), F.col("query").alias("query_text"), F.lit(None).cast("string").alias("expected"), F.lit(False).alias("reliable"), none.alias("context"))
    told = mined.select(F.concat(F.lit("mined-"), slug("query"), F.lit("-"), slug(F.array_join("recovery_context", " "))).alias("case_id"), F.col("query").alias("query_text"), F.col("recovery_top").cast("string").alias("expected"), F.lit(True).alias("reliable"), F.col("recovery_context").alias("context"))
    return alone.unionByName(told)


def built_in(spark) -> tuple[EntityGraph, DataFrame, DataFrame]:
    """The built-in graph, its values (doc_id, value) and its cases."""
    docs = spark.createDataFrame(BUILT_IN_DOCS, "doc_id string, content string, value string, question string")
    every = F.array_distinct(F.concat(entities.extract_entities(F.col("content")), entities.extract_entities(F.col("question"))))
    mentions = docs.select("doc_id", F.explode(every).alias("m")).select("doc_id", "m.label", "m.etype").distinct()
    cases = spark.createDataFrame(BUILT_IN_CASES, "case_id string, query_text string, expected string, reliable boolean, context array<string>")
    return EntityGraph(mentions), docs.select("doc_id", "value"), cases


def benchmark(graph: EntityGraph, values: DataFrame, cases: DataFrame, k: int = 3) -> DataFrame:
    """A row for each case: what came first, whether it is right, and the diagnosis."""
    asked = cases.select(F.col("case_id").alias("query_id"), "query_text")
    context = cases.select(F.col("case_id").alias("query_id"), F.explode("context").alias("word"))
    found = diagnose(graph, asked, context, k).join(values.select(F.col("doc_id").alias("top"), F.col("value").alias("top_value")), "top", "left")
    all_ = cases.withColumnRenamed("case_id", "query_id").join(found, "query_id", "left").withColumns({"confidence": F.coalesce("confidence", F.lit("none")), "context_needed": F.coalesce("context_needed", F.lit(False)), "band_crossing": F.coalesce("band_crossing", F.lit(False)), "recommended_action": F.coalesce("recommended_action", F.lit("no_result"))})
    right = F.when(F.col("expected").isNotNull(), F.coalesce(F.col("expected") == F.col("top_value"), F.lit(False)))
    return all_.select(F.col("query_id").alias("case_id"), "expected", "reliable", "context", "top_value", right.alias("correct"), "confidence", "boundary_distance", "disambiguation_gap", "band_crossing", "context_needed", trusted().alias("should_trust"), "recommended_action")


def summary(reports: DataFrame) -> DataFrame:
    """One row: accuracies and how well distrust finds what shouldn't be trusted."""
    share = lambda of, among: F.avg(F.when(among, of.cast("double")))
    answerable, wary, named = F.col("correct").isNotNull(), ~F.col("should_trust"), F.size("context") > 0
    return reports.agg(
        F.count("*").alias("total_cases"), F.count("correct").alias("answerable_cases"), share(F.col("correct"), answerable).alias("top1_accuracy"),
        share(wary, ~F.col("reliable")).alias("unreliable_recall"), share(~F.col("reliable"), wary).alias("unreliable_precision"), share(wary, F.col("reliable")).alias("reliable_false_positive_rate"),
        share(F.col("correct"), answerable & named).alias("context_case_accuracy"), F.sum(F.col("band_crossing").cast("long")).alias("band_crossing_cases"),
        F.avg(F.when(F.col("correct"), F.col("boundary_distance"))).alias("mean_boundary_distance_correct"), F.avg(F.when(~F.col("correct"), F.col("boundary_distance"))).alias("mean_boundary_distance_incorrect"),
    )
