"""The logical tables of the memory store, derived from the input tables.

Each is defined twice, as DataFrames and as SQL text, so that queries and their
SQL start from the same rows.  Nothing is cached and every table reads only the
columns that it needs.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.functions import entities

#: The moment against which ages are measured.
NOW = 1_740_000_000
MEMORY_KINDS = ("atom", "narrative", "snapshot")
CODE_KINDS = ("document_chunk",)


class Views:
    """Logical tables over the Parquet files in a directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def atoms(self) -> DataFrame:
        d = self.raw("documents").join(self.raw("labels").select("doc_id", "quality"), "doc_id", "left")
        created = F.lit(1700000000).cast("long") + 3600 * F.col("doc_id")
        kind = F.when(F.col("doc_id") % 10 == 0, "narrative").when(F.col("doc_id") % 10 == 1, "snapshot").when((F.col("doc_id") % 10).between(2, 5), "document_chunk").otherwise("atom")
        status = F.when(F.col("doc_id") % 17 == 0, "superseded").when(F.col("doc_id") % 53 == 0, "tombstone").otherwise("live")
        return d.select(
            F.col("doc_id").alias("id"), "text", kind.alias("kind"), F.col("source").alias("project"), created.alias("created_at"),
            F.when(F.col("doc_id") % 7 != 0, created - 86400 * (F.col("n_chars") % 90)).alias("occurred_at"),
            (0.5 * F.coalesce("quality", F.lit(0))).alias("importance"), status.alias("status"), F.col("lang").alias("agent"),
        )

    @cached_property
    def provenance(self) -> DataFrame:
        d = self.raw("documents").select("doc_id", "lang", "source")
        source = F.when((F.col("doc_id") % 10).between(2, 5), "bulk-import").when(F.col("doc_id") % 5 == 0, "session-log").otherwise("explicit-emit")
        return d.select(F.col("doc_id").alias("atom_id"), source.alias("source"), F.col("lang").alias("agent"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("source_ref"), (F.lit(1700000000).cast("long") + 3600 * F.col("doc_id")).alias("recorded_at"))

    @cached_property
    def mentions(self) -> DataFrame:
        return entities.native_mentions(self.raw("documents"))

    @cached_property
    def entity_facets(self) -> DataFrame:
        return self.mentions.select(F.col("doc_id").alias("atom_id"), F.lit("entity").alias("key"), F.col("label").alias("value")).distinct()

    @cached_property
    def facets(self) -> DataFrame:
        d = self.raw("documents").select("doc_id", "lang", "source")
        tag = lambda name, col: d.select(F.col("doc_id").alias("atom_id"), F.lit("tag").alias("key"), F.concat(F.lit(f"{name}:"), F.col(col)).alias("value"))
        pin = d.filter("doc_id % 101 = 0").select(F.col("doc_id").alias("atom_id"), F.lit("pin").alias("key"), (F.col("doc_id") % 3).cast("string").alias("value"))
        return self.entity_facets.union(tag("src", "source")).union(tag("lang", "lang")).union(pin)

    @cached_property
    def supersedes(self) -> DataFrame:
        """(src, dst): src supersedes dst, for atoms that say so and have a successor."""
        ids = self.raw("documents").select("doc_id")
        return ids.filter("doc_id % 17 = 0").select((F.col("doc_id") + 1).alias("src_atom"), F.col("doc_id").alias("dst_atom")).join(ids.withColumnRenamed("doc_id", "src_atom"), "src_atom", "left_semi")

    @cached_property
    def relates(self) -> DataFrame:
        """Stored edges (src_atom, dst_atom, type, weight), two of every seventh atom."""
        d = self.raw("documents").filter("doc_id % 7 = 0")
        edges = d.select(F.col("doc_id").alias("src_atom"), (F.col("doc_id") + 5).alias("dst_atom"), ((F.col("doc_id") % 10) / 10.0).alias("weight")).union(d.select("doc_id", F.col("doc_id") + 6, F.lit(0.55)))
        return edges.withColumn("type", F.lit("relates"))

    @cached_property
    def embeddings(self) -> DataFrame:
        return self.raw("embeddings").select(F.col("vec_id").alias("atom_id"), F.lit("m0").alias("model_id"), "embedding")

    @cached_property
    def queries(self) -> DataFrame:
        return self.raw("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))

    @cached_property
    def feedback(self) -> DataFrame:
        e = self.raw("events")
        kind = F.element_at(F.array(*map(F.lit, ("shown", "used", "helpful", "irrelevant", "outdated"))), (F.col("event_id") % 5 + 1).cast("int"))
        return e.select("event_id", (F.col("event_id") % 997).alias("atom_id"), F.col("user_id").cast("string").alias("agent"), F.col("event_type").alias("task_id"), kind.alias("feedback_type"), F.unix_timestamp("ts").alias("recorded_at"), "value")

    @cached_property
    def checkpoints(self) -> DataFrame:
        from pyspark.sql.window import Window

        e = self.raw("events")
        order = Window.partitionBy("event_type", "user_id").orderBy("ts", "event_id")
        return e.select(F.col("event_type").alias("task_id"), F.col("user_id").alias("agent"), F.row_number().over(order).alias("revision"), F.col("event_id").alias("request_id"), F.unix_timestamp("ts").alias("recorded_at"), "value")


_SQL = {
    "atoms": """
SELECT d.doc_id AS id, d.text, CASE WHEN d.doc_id % 10 = 0 THEN 'narrative' WHEN d.doc_id % 10 = 1 THEN 'snapshot'
    WHEN d.doc_id % 10 BETWEEN 2 AND 5 THEN 'document_chunk' ELSE 'atom' END AS kind,
  d.source AS project, 1700000000 + 3600 * d.doc_id AS created_at,
  CASE WHEN d.doc_id % 7 <> 0 THEN 1700000000 + 3600 * d.doc_id - 86400 * (d.n_chars % 90) END AS occurred_at,
  0.5 * coalesce(l.quality, 0)::DOUBLE AS importance,
  CASE WHEN d.doc_id % 17 = 0 THEN 'superseded' WHEN d.doc_id % 53 = 0 THEN 'tombstone' ELSE 'live' END AS status, d.lang AS agent
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    "provenance": """
SELECT doc_id AS atom_id, CASE WHEN doc_id % 10 BETWEEN 2 AND 5 THEN 'bulk-import' WHEN doc_id % 5 = 0 THEN 'session-log' ELSE 'explicit-emit' END AS source,
  lang AS agent, source || '/' || doc_id AS source_ref, 1700000000 + 3600 * doc_id AS recorded_at FROM documents""",
    "mentions": entities.MENTIONS_SQL,
    "entity_facets": "SELECT DISTINCT doc_id AS atom_id, 'entity' AS key, label AS value FROM mentions",
    "facets": """
SELECT atom_id, key, value FROM entity_facets
UNION ALL SELECT doc_id, 'tag', 'src:' || source FROM documents
UNION ALL SELECT doc_id, 'tag', 'lang:' || lang FROM documents
UNION ALL SELECT doc_id, 'pin', CAST(doc_id % 3 AS VARCHAR) FROM documents WHERE doc_id % 101 = 0""",
    "supersedes": "SELECT doc_id + 1 AS src_atom, doc_id AS dst_atom FROM documents WHERE doc_id % 17 = 0 AND doc_id + 1 IN (SELECT doc_id FROM documents)",
    "vectors": "SELECT vec_id AS atom_id, 'm0' AS model_id, embedding FROM embeddings",
    "queries": "SELECT item_id AS query_id, text AS query_text FROM benchmark",
    "feedback": """
SELECT event_id, event_id % 997 AS atom_id, CAST(user_id AS VARCHAR) AS agent, event_type AS task_id,
  list_extract(['shown', 'used', 'helpful', 'irrelevant', 'outdated'], CAST(event_id % 5 + 1 AS INTEGER)) AS feedback_type,
  CAST(floor(epoch(ts)) AS BIGINT) AS recorded_at, value FROM events""",
    "checkpoints": """
SELECT event_type AS task_id, user_id AS agent, CAST(row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS INTEGER) AS revision,
  event_id AS request_id, CAST(floor(epoch(ts)) AS BIGINT) AS recorded_at, value FROM events""",
}
_NEEDS = {"entity_facets": ("mentions",), "facets": ("mentions", "entity_facets")}


def with_views(*names: str) -> str:
    """The WITH clause that defines the named views; further ones may follow after a comma."""
    order: list[str] = []
    for name in names:
        for n in (*_NEEDS.get(name, ()), name):
            if n not in order:
                order.append(n)
    return "WITH " + ", ".join(f"{n} AS ({_SQL[n].strip()})" for n in order)
