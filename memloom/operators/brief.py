"""The session brief: pins, active threads, task heads and loose ends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from memloom.functions import text as tx
from memloom.operators import store
from memloom.plans.views import MEMORY_KINDS

ACTIVE_LIMIT, HEADS = 500, 8


def pins(atoms: DataFrame, facets: DataFrame) -> DataFrame:
    """Live pinned atoms: by the largest pin, then newest, then id."""
    p = facets.filter("key = 'pin'").groupBy(F.col("atom_id").alias("id")).agg(F.max(F.expr("try_cast(value AS bigint)")).alias("pin"))
    x = p.join(atoms.filter("status = 'live'").select("id", tx.effective_time().alias("t")), "id")
    return x.withColumn("n", F.row_number().over(Window.orderBy(F.desc("pin"), F.desc("t"), "id"))).select("id", "pin", "n")


def active(atoms: DataFrame, facets: DataFrame, now: int, limit: int = ACTIVE_LIMIT) -> DataFrame:
    """The most recent memory atoms, without pins, by importance and freshness;
    thread is the first place of an atom's project.  The limit is the feature, and
    it bounds the rows that the global order sees."""
    recent = atoms.filter((F.col("status") == "live") & F.col("kind").isin(*MEMORY_KINDS)).withColumn("t", tx.effective_time()).orderBy(F.desc("t"), "id").limit(limit)
    free = recent.join(facets.filter("key = 'pin'").select(F.col("atom_id").alias("id")).distinct(), "id", "left_anti")
    scored = free.withColumn("score", tx.importance_factor("importance") * tx.time_factor(F.lit(now) - F.col("t")))
    ranked = scored.withColumn("n", F.row_number().over(Window.orderBy(F.desc("score"), "id")))
    return ranked.withColumn("thread", F.min("n").over(Window.partitionBy("project")))


def loose_ends(atoms: DataFrame, facets: DataFrame, agent: str) -> DataFrame:
    """Live atoms addressed to an agent."""
    return facets.filter((F.col("key") == "tag") & (F.col("value") == f"for:{agent}")).select(F.col("atom_id").alias("id")).join(store.scoped(atoms), "id")


def brief(atoms: DataFrame, facets: DataFrame, checkpoints: DataFrame, now: int, budget: int = 1500, agent: str | None = None) -> DataFrame:
    """Sections in order within a token budget, pins never left out: section, n, line."""
    gist = atoms.select("id", tx.gist("text").alias("g"))
    line = lambda df, name: df.join(gist, "id").select(F.lit(name).alias("section"), "n", F.concat(F.lit("p3://"), F.col("id").cast("string"), F.lit(" | "), F.col("g")).alias("line"))
    heads = store.task_heads(checkpoints).orderBy(F.desc("recorded_at"), "task_id", "agent").limit(HEADS)
    heads = heads.withColumn("n", F.row_number().over(Window.orderBy(F.desc("recorded_at"), "task_id", "agent")))
    tasks = heads.select(F.lit("2 tasks").alias("section"), "n", F.concat_ws(" ", F.col("task_id"), F.concat(F.lit("r"), F.col("revision").cast("string"))).alias("line"))
    every = line(pins(atoms, facets), "1 pinned").union(tasks).union(line(active(atoms, facets, now), "3 active"))
    if agent is not None:
        ends = loose_ends(atoms, facets, agent)
        every = every.union(line(ends.withColumn("n", F.row_number().over(Window.orderBy("id"))), "4 loose ends"))
    w = Window.orderBy("section", "n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return every.withColumn("used", F.ceil(F.sum(F.length("line") + 1).over(w) / 3)).filter((F.col("section") == "1 pinned") | (F.col("used") <= budget)).select("section", "n", "line")
