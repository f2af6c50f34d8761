"""Lines that tell where a chunk stands and what it relates to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.functions import python_text
from memloom.functions import text as tx
from memloom.operators.graph import top_by
from memloom.plans.views import MEMORY_KINDS
from memloom.sources.tables import durable

#: Files of more bytes aren't searched.
MAX_FILE_BYTES = 5 * 1024 * 1024
#: Entity values of more live atoms relate nothing.
HUB = 100


def related(sources: DataFrame, facets: DataFrame, memory: DataFrame, hub: int, k: int) -> DataFrame:
    """(query_id, doc_id, score, rank): of memory (doc_id) what shares facet values with
    sources (query_id), each value worth one over its frequency (atom_id, value, n); values
    of more than hub atoms are left out before they are joined."""
    rare = facets.filter(F.col("n") <= hub)
    own = sources.join(rare.withColumnRenamed("atom_id", "query_id"), "query_id")
    other = rare.select(F.col("atom_id").alias("doc_id"), "value").join(memory, "doc_id", "left_semi")
    score = own.join(other, "value").filter("query_id <> doc_id").groupBy("query_id", "doc_id").agg(F.round(F.sum(1 / F.col("n")), 9).alias("score"))
    return top_by(score, k)


def relations(chunks: DataFrame, edges: DataFrame, fallback: DataFrame, atoms: DataFrame, k: int = 2) -> DataFrame:
    """(query_id, doc_id, weight, rank, stored) of chunks (query_id): the live targets of
    the strongest stored edges (src_atom, dst_atom, weight); where a chunk has none,
    those of the fallback (query_id, doc_id, score)."""
    live = atoms.filter("status = 'live'").select(F.col("id").alias("doc_id"))
    own = edges.select(F.col("src_atom").alias("query_id"), F.col("dst_atom").alias("doc_id"), F.col("weight").alias("score")).join(chunks, "query_id", "left_semi").join(live, "doc_id", "left_semi")
    stored = top_by(own.groupBy("query_id", "doc_id").agg(F.max("score").alias("score")), k)
    rest = top_by(fallback.join(stored.select("query_id").distinct(), "query_id", "left_anti").join(chunks, "query_id", "left_semi").select("query_id", "doc_id", "score"), k)
    return stored.withColumn("stored", F.lit(True)).unionByName(rest.withColumn("stored", F.lit(False))).withColumnRenamed("score", "weight")


def lines(relations_: DataFrame, atoms: DataFrame) -> DataFrame:
    """(query_id, relates): an array of a line for each atom that a chunk relates to, in order."""
    line = F.concat(F.lit("relates -> p3://"), F.col("doc_id").cast("string"), F.lit(" "), tx.gist("text"))
    x = relations_.join(atoms.select(F.col("id").alias("doc_id"), "text"), "doc_id").select("query_id", "rank", line.alias("line"))
    return x.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "line"))), lambda s: s["line"]).alias("relates"))


def locations(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """(query_id, at): file and lines of chunks (query_id, source_ref, text) in files
    (source_ref, text), whatever follows a # in the chunk's reference; chunks that aren't
    found, and those of files of over 5 MiB, have no row."""
    own = chunks.select("query_id", F.substring_index("source_ref", "#", 1).alias("source_ref"), "text")
    small = files.filter(F.octet_length("text") <= MAX_FILE_BYTES).select("source_ref", F.col("text").alias("whole"))
    x = own.join(small, "source_ref").withColumn("at", python_text.located(F.col("whole"), F.col("text")))
    return x.filter("at IS NOT NULL").select("query_id", F.concat(F.lit("at "), "source_ref", F.lit("#L"), F.col("at.first").cast("string"), F.lit("-"), F.col("at.last").cast("string")).alias("at"))


def attachments(results: DataFrame, atoms: DataFrame, provenance: DataFrame, facets: DataFrame, edges: DataFrame | None = None, files: DataFrame | None = None, k: int = 3) -> DataFrame:
    """(doc_id, extra): the lines of the document chunks among results (doc_id), where a
    chunk stands first, then up to k atoms that it relates to.  Only entity values of
    these chunks are counted, and those of more than 100 live atoms left out."""
    surfaced = results.select("doc_id").distinct()
    chunks = durable(atoms.filter("kind = 'document_chunk'").select(F.col("id").alias("query_id"), "text").join(surfaced.withColumnRenamed("doc_id", "query_id"), "query_id", "left_semi"))
    ids = chunks.select("query_id")
    live = atoms.filter("status = 'live'").select(F.col("id").alias("atom_id"), "kind")
    entity = facets.filter("key = 'entity'").select("atom_id", "value").distinct()
    own = entity.join(ids.withColumnRenamed("query_id", "atom_id"), "atom_id", "left_semi")
    near = durable(entity.join(own.select("value").distinct(), "value", "left_semi"))
    n = near.join(live.select("atom_id"), "atom_id", "left_semi").groupBy("value").agg(F.count("*").alias("n"))
    memory = live.filter(F.col("kind").isin(*MEMORY_KINDS)).select(F.col("atom_id").alias("doc_id"))
    fallback = related(ids, near.join(n, "value"), memory, HUB, k)
    if edges is None:
        edges = fallback.select(F.col("query_id").alias("src_atom"), F.col("doc_id").alias("dst_atom"), F.col("score").alias("weight")).limit(0)
    else:
        edges = edges.filter("type = 'relates'")
    found = lines(relations(ids, edges, fallback, atoms, k), atoms)
    if files is None:
        return found.select(F.col("query_id").alias("doc_id"), F.col("relates").alias("extra"))
    first = provenance.filter("source_ref IS NOT NULL").groupBy(F.col("atom_id").alias("query_id")).agg(F.min_by("source_ref", F.struct("recorded_at", "source_ref")).alias("source_ref"))
    at = locations(chunks.join(first, "query_id"), files)
    both = at.join(found, "query_id", "full_outer")
    none = F.array().cast("array<string>")
    return both.select(F.col("query_id").alias("doc_id"), F.concat(F.when(F.col("at").isNotNull(), F.array("at")).otherwise(none), F.coalesce("relates", none)).alias("extra"))
