"""Retrieval quality and latency summaries."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def quality(queries: DataFrame, ranks: DataFrame, relevant: DataFrame, own: DataFrame | None = None) -> DataFrame:
    """Recall at 1, 5, 10 and 20 and mean reciprocal rank at 10, from the first relevant
    rank; own documents of a query don't count."""
    hits = ranks.join(relevant, ["query_id", "doc_id"], "left_semi")
    if own is not None:
        hits = hits.join(own, ["query_id", "doc_id"], "left_anti")
    first = queries.join(hits.groupBy("query_id").agg(F.min("rank").alias("first")), "query_id", "left")
    at = lambda k: F.round(F.avg(F.when(F.col("first") <= k, 1.0).otherwise(0.0)), 6)
    return first.agg(F.count("*").alias("queries"), at(1).alias("r1"), at(5).alias("r5"), at(10).alias("r10"), at(20).alias("r20"), F.round(F.avg(F.when(F.col("first") <= 10, 1.0 / F.col("first")).otherwise(0.0)), 6).alias("mrr10"))


def nearest_rank(values: DataFrame, column: str, by: list[str]) -> DataFrame:
    """Mean and nearest-rank p50 and p95 of each group; the place is q * (n - 1), halves to even.

    Values and their counts are aggregated first, so a group is as long as its
    number of distinct values."""
    counted = values.groupBy(*by, F.col(column).alias("v")).agg(F.count("*").alias("c"))
    g = counted.groupBy(*by).agg(F.sum("c").alias("n"), (F.sum(F.col("v") * F.col("c")) / F.sum("c")).alias("mean"), F.sort_array(F.collect_list(F.struct("v", "c"))).alias("s"))

    def pick(q: float):
        place = F.expr(f"bround({q} * (n - 1))")
        run = F.aggregate("s", F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("double").alias("out")), lambda a, x: F.struct((a["seen"] + x["c"]).alias("seen"), F.coalesce(a["out"], F.when(a["seen"] + x["c"] > place, x["v"].cast("double"))).alias("out")))
        return run["out"]

    return g.select(*by, "n", F.round("mean", 6).alias("mean"), pick(0.5).alias("p50"), pick(0.95).alias("p95"))


def binomial_upper(violations: int, n: int, confidence: float = 0.95) -> float:
    """The upper bound of a violation rate: the rate at which seeing so few has
    probability 1 - confidence."""
    if violations >= n:
        return 1.0
    low, high = 0.0, 1.0
    for _ in range(100):
        p = (low + high) / 2
        seen = sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(violations + 1))
        low, high = (p, high) if seen > 1 - confidence else (low, p)
    return high


def outcome_scores(answers: DataFrame) -> DataFrame:
    """Sums over (expected, answer, supported): right ones, wrong ones that didn't abstain, supported ones."""
    norm = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    right, none = norm("expected") == norm("answer"), norm("answer").isin("", "unknown")
    return answers.agg(F.count("*").alias("n"), F.sum(right.cast("int")).alias("correct"), F.sum((~right & ~none).cast("int")).alias("incorrect"), F.sum(none.cast("int")).alias("abstained"), F.sum((right & F.col("supported")).cast("int")).alias("supported"))
