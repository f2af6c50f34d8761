"""The atom store as immutable tables: writes give new tables, reads are scoped.

A write is a function from tables to tables; committing means writing the result
as a new snapshot (``save_snapshot``).  Idempotence comes from anti-joins on keys.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from memloom.functions import text as tx
from memloom.plans.views import CODE_KINDS, MEMORY_KINDS

KIND_CLASSES = (("memory", MEMORY_KINDS), ("code", CODE_KINDS))
TIERS = {"L2": (MEMORY_KINDS, False, True), "L3": (None, False, True)}


def tier_defaults(tier: str):
    """(kinds, rerank, enrich) of a tier."""
    if tier not in TIERS:
        raise ValueError(f"unknown tier {tier!r}")
    return TIERS[tier]


def kind_class(kind="kind"):
    """0 for memory, 1 for code, null for other kinds."""
    c = F.col(kind) if isinstance(kind, str) else kind
    return F.when(c.isin(*MEMORY_KINDS), 0).when(c.isin(*CODE_KINDS), 1)


def scoped(atoms: DataFrame, provenance: DataFrame | None = None, kinds=None, project=None, time_scope=None, agent=None) -> DataFrame:
    """Live atoms within all scopes, before any top-k; an unknown kind gives none."""
    out = atoms.filter("status = 'live'")
    if kinds is not None:
        out = out.filter(F.col("kind").isin(*kinds)) if kinds else out.limit(0)
    if project is not None:
        out = out.filter(F.col("project") == project)
    if time_scope is not None:
        out = out.filter(tx.effective_time().between(*time_scope))
    if agent is not None:
        out = out.join(provenance.filter(F.col("agent") == agent).select(F.col("atom_id").alias("id")).distinct(), "id", "left_semi")
    return out


def backfill(records: DataFrame, provenance: DataFrame) -> DataFrame:
    """New records: those whose source reference is neither in the store nor earlier in
    the run; records without one always count."""
    known = provenance.select(F.col("source_ref")).filter("source_ref IS NOT NULL").distinct()
    first = Window.partitionBy("source_ref").orderBy("record_id")
    fresh = records.filter("source_ref IS NOT NULL").withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n").join(known, "source_ref", "left_anti")
    return fresh.unionByName(records.filter("source_ref IS NULL"))


def put_atoms(atoms: DataFrame, provenance: DataFrame, new_atoms: DataFrame, new_provenance: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables with the new rows; an atom without provenance isn't put."""
    sound = new_atoms.join(new_provenance.select(F.col("atom_id").alias("id")), "id", "left_semi").join(atoms.select("id"), "id", "left_anti")
    return atoms.unionByName(sound), provenance.unionByName(new_provenance.join(sound.select(F.col("id").alias("atom_id")), "atom_id", "left_semi"))


def correct_atoms(atoms: DataFrame, facets: DataFrame, edges: DataFrame, corrections: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Applies corrections (old_id, new_id, text): only to atoms that are live, one each;
    the successor takes over kind, project and the pin and tag facets."""
    one = corrections.groupBy("old_id").agg(F.min(F.struct("new_id", "text")).alias("c")).select("old_id", "c.new_id", "c.text")
    sound = one.join(atoms.filter("status = 'live'").select(F.col("id").alias("old_id")), "old_id", "left_semi")
    marked = atoms.join(sound.select(F.col("old_id").alias("id"), F.lit(True).alias("_old")), "id", "left").withColumn("status", F.when(F.col("_old"), "superseded").otherwise(F.col("status"))).drop("_old")
    heirs = atoms.join(sound.select(F.col("old_id").alias("id"), "new_id", F.col("text").alias("_text")), "id").withColumn("id", F.col("new_id")).withColumn("text", F.col("_text")).select(*atoms.columns)
    kept = facets.filter(F.col("key").isin("pin", "tag")).join(sound.select(F.col("old_id").alias("atom_id"), "new_id"), "atom_id").select(F.col("new_id").alias("atom_id"), "key", "value")
    return marked.unionByName(heirs), facets.unionByName(kept).distinct(), edges.unionByName(sound.select(F.col("new_id").alias("src_atom"), F.col("old_id").alias("dst_atom")))


def add_facets(facets: DataFrame, new: DataFrame) -> DataFrame:
    """Facets are a set: rows that are there already are ignored."""
    return facets.unionByName(new.distinct().join(facets, ["atom_id", "key", "value"], "left_anti"))


def remove_facets(facets: DataFrame, gone: DataFrame) -> DataFrame:
    return facets.join(gone, ["atom_id", "key", "value"], "left_anti")


def upsert_edges(edges: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Relating edges by (src_atom, dst_atom): kept verdicts insert or set the weight, others do nothing."""
    best = verdicts.filter("keep").groupBy("src_atom", "dst_atom").agg(F.max("weight").alias("_w"))
    both = edges.join(best, ["src_atom", "dst_atom"], "full_outer")
    return both.select("src_atom", "dst_atom", F.coalesce("_w", "weight").alias("weight"))


def _judged(edges: DataFrame, verdicts: DataFrame, atoms: DataFrame) -> DataFrame:
    """verdicts with their outcome: malformed, rejected, missing, updated or written."""
    ids = atoms.select("id").distinct()
    there = lambda df, col: df.join(ids.select(F.col("id").alias(col), F.lit(True).alias(f"_{col}")), col, "left")
    had = edges.select(F.col("src_atom").alias("chunk_id"), F.col("dst_atom").alias("mem_id"), F.lit(True).alias("_had")).distinct()
    both = there(there(verdicts, "mem_id"), "chunk_id").join(had, ["chunk_id", "mem_id"], "left").withColumn("confidence", F.coalesce("confidence", F.lit(1.0)))
    sound = F.col("mem_id").isNotNull() & F.col("chunk_id").isNotNull() & F.col("keep").isNotNull()
    kept = F.when(~sound, "malformed").when(~F.col("keep"), "rejected").when(F.col("_mem_id").isNull() | F.col("_chunk_id").isNull(), "missing")
    alone = F.when(F.col("_kept").isNotNull(), F.col("pos"))  # what changes nothing needs no order, and mustn't meet in one task
    first = F.row_number().over(Window.partitionBy("chunk_id", "mem_id", alone).orderBy("pos"))
    outcome = F.coalesce("_kept", F.when(F.col("_had").isNotNull() | (first > 1), "updated").otherwise("written"))
    return both.withColumn("_kept", kept).withColumn("outcome", outcome).select("pos", "chunk_id", "mem_id", "confidence", "outcome")


def apply_verdicts(edges: DataFrame, verdicts: DataFrame, atoms: DataFrame, campaign: str) -> DataFrame:
    """Relating edges (src_atom, dst_atom, weight, campaign) after verdicts (pos, mem_id,
    chunk_id, keep, confidence), applied in the order of pos.

    A kept verdict on atoms that exist sets the weight of its edge, which a new edge
    owes to the campaign; others change nothing.  A missing confidence is 1.
    """
    last = _judged(edges, verdicts, atoms).filter("outcome IN ('written', 'updated')").groupBy("chunk_id", "mem_id").agg(F.max_by("confidence", "pos").alias("_w"))
    both = edges.withColumn("_old", F.lit(True)).join(last.select(F.col("chunk_id").alias("src_atom"), F.col("mem_id").alias("dst_atom"), "_w"), ["src_atom", "dst_atom"], "full_outer")
    return both.select("src_atom", "dst_atom", F.coalesce("_w", "weight").alias("weight"), F.when(F.col("_old"), F.col("campaign")).otherwise(F.lit(campaign)).alias("campaign"))


def verdict_report(edges: DataFrame, verdicts: DataFrame, atoms: DataFrame) -> DataFrame:
    """How many verdicts had each outcome: outcome, n."""
    return _judged(edges, verdicts, atoms).groupBy("outcome").agg(F.count("*").alias("n"))


def rollback_campaign(edges: DataFrame, campaign: str) -> DataFrame:
    """Edges without those that the campaign wrote; weights that it set elsewhere stay."""
    return edges.filter(~F.col("campaign").eqNullSafe(campaign))


def bump_importance(atoms: DataFrame, bumps: DataFrame, step: float = 0.05) -> DataFrame:
    """Importance plus a step for each of bumps (id), at most 1 and never lowered."""
    n = bumps.groupBy("id").agg(F.count("*").alias("_n"))
    new = F.greatest("importance", F.least(F.lit(1.0), F.col("importance") + step * F.coalesce("_n", F.lit(0))))
    return atoms.join(n, "id", "left").withColumn("importance", new).drop("_n")


def missing_embeddings(atoms: DataFrame, embeddings: DataFrame, model: str) -> DataFrame:
    return atoms.filter("status = 'live'").join(embeddings.filter(F.col("model_id") == model).select(F.col("atom_id").alias("id")), "id", "left_anti")


def drop_model(embeddings: DataFrame, atoms: DataFrame, old: str, new: str) -> DataFrame:
    """Embeddings without the old model; refused for the active one, and unless that covers all live atoms."""
    if old == new:
        raise ValueError("the active model isn't dropped")
    if not missing_embeddings(atoms, embeddings, new).isEmpty():
        raise ValueError("the new model doesn't cover all live atoms")
    return embeddings.filter(F.col("model_id") != old)


def credits(feedback: DataFrame) -> DataFrame:
    """First helpful feedback of each (atom, agent, task)."""
    first = Window.partitionBy("atom_id", "agent", "task_id").orderBy("recorded_at", "event_id")
    return feedback.filter("feedback_type = 'helpful'").withColumn("_n", F.row_number().over(first)).filter("_n = 1").select("atom_id", "agent", "task_id", F.col("event_id").alias("feedback_id"), F.col("recorded_at").alias("awarded_at"))


def credited(atoms: DataFrame, feedback: DataFrame, step: float = 0.01) -> DataFrame:
    """(id, importance) after usefulness credit."""
    n = credits(feedback).groupBy(F.col("atom_id").alias("id")).agg(F.count("*").alias("n"))
    return atoms.join(n, "id").select("id", "n", F.when(F.col("importance") >= 1, F.col("importance")).otherwise(F.least(F.lit(1.0), F.col("importance") + step * F.col("n"))).alias("importance"))


def task_heads(checkpoints: DataFrame, revision: int | None = None, as_of: int | None = None) -> DataFrame:
    """The latest checkpoint of each stream, now or as of a revision or time."""
    out = checkpoints
    if revision is not None:
        out = out.filter(F.col("revision") <= revision)
    if as_of is not None:
        out = out.filter(F.col("recorded_at") <= as_of)
    rest = [c for c in checkpoints.columns if c not in ("task_id", "agent")]
    return out.groupBy("task_id", "agent").agg(F.max_by(F.struct(*rest), "revision").alias("h")).select("task_id", "agent", "h.*")


def task_history(checkpoints: DataFrame, after: int, limit: int) -> DataFrame:
    """A page of each stream: revisions after a cursor, and whether there are more."""
    w = Window.partitionBy("task_id", "agent").orderBy("revision")
    page = checkpoints.filter(F.col("revision") > after).withColumn("n", F.row_number().over(w)).filter(F.col("n") <= limit + 1)
    return page.withColumn("truncated", F.max(F.col("n") > limit).over(Window.partitionBy("task_id", "agent"))).filter(F.col("n") <= limit).drop("n")


def apply_checkpoints(requests: DataFrame) -> DataFrame:
    """Compare-and-set in order of arrival: requests (stream, seq, request_id, expected, body)
    with their outcome: applied, replayed or conflict, and the revision they ended at.

    A stream is folded in one task, row by row with constant state but for the ids
    of its requests; streams are independent."""
    import pandas as pd

    schema = "stream string, seq long, request_id string, outcome string, revision int"

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        seen: dict[str, int] = {}
        now, out = 0, []
        for r in pdf.sort_values(["seq", "request_id"]).itertuples(index=False):
            if r.request_id in seen:
                out.append((r.stream, r.seq, r.request_id, "replayed", seen[r.request_id]))
            elif r.expected != now:
                out.append((r.stream, r.seq, r.request_id, "conflict", now))
            else:
                now += 1
                seen[r.request_id] = now
                out.append((r.stream, r.seq, r.request_id, "applied", now))
        return pd.DataFrame(out, columns=["stream", "seq", "request_id", "outcome", "revision"])

    return requests.groupBy("stream").applyInPandas(fold, schema)


def lookup(facets: DataFrame, atoms: DataFrame, key: str, value: str, limit: int = 20) -> DataFrame:
    """Live atoms with a facet, by id, one page, and whether there are more."""
    found = facets.filter((F.col("key") == key) & (F.col("value") == value)).select(F.col("atom_id").alias("id")).join(atoms.filter("status = 'live'").select("id", "kind"), "id").orderBy("id").limit(limit + 1)
    n = Window.orderBy("id")
    page = found.withColumn("n", F.row_number().over(n))
    return page.withColumn("truncated", F.max(F.col("n") > limit).over(Window.partitionBy(F.lit(1)))).filter(F.col("n") <= limit).drop("n")


def integrity(atoms: DataFrame, provenance: DataFrame, facets: DataFrame, edges: DataFrame, embeddings: DataFrame) -> DataFrame:
    """(check, n): rows that point nowhere, forks and coverage."""
    ids = atoms.select("id")
    lost = lambda df, c: df.select(F.col(c).alias("id")).join(ids, "id", "left_anti").agg(F.count("*").alias("n"))
    rows = {
        "edges_without_source": lost(edges, "src_atom"),
        "edges_without_target": lost(edges, "dst_atom"),
        "facets_without_atom": lost(facets, "atom_id"),
        "provenance_without_atom": lost(provenance, "atom_id"),
        "forked_predecessors": edges.groupBy("dst_atom").agg(F.countDistinct("src_atom").alias("s")).filter("s > 1").agg(F.count("*").alias("n")),
        "live_without_embedding": missing_embeddings(atoms, embeddings, "m0").agg(F.count("*").alias("n")),
        "live": atoms.filter("status = 'live'").agg(F.count("*").alias("n")),
    }
    out = None
    for name, df in rows.items():
        one = df.select(F.lit(name).alias("check"), "n")
        out = one if out is None else out.union(one)
    return out


def store_digest(atoms: DataFrame):
    """Order-free digest of all (id, text): the exact sum of row hashes and the count."""
    return atoms.agg(F.count("*").alias("n"), F.sum(F.conv(F.substring(F.sha2(F.concat_ws("\0", F.col("id").cast("string"), "text"), 256), 1, 12), 16, 10).cast("decimal(38,0)")).cast("string").alias("digest"))


def save_snapshot(tables: dict[str, DataFrame], path: str) -> None:
    """Tables as Parquet, with a manifest of row counts and schemas written last: a
    folder without one is no snapshot."""
    spark = next(iter(tables.values())).sparkSession
    manifest = []
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}")
        manifest.append((name, spark.read.parquet(f"{path}/{name}").count(), df.schema.json()))
    spark.createDataFrame(manifest, "name string, n long, fields string").coalesce(1).write.json(f"{path}/_manifest")


def load_snapshot(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a snapshot, checked against its manifest."""
    from pyspark.sql.types import StructType

    out = {}
    for r in spark.read.schema("name string, n long, fields string").json(f"{path}/_manifest").collect():  # a row per table
        df = spark.read.schema(StructType.fromJson(json.loads(r["fields"]))).parquet(f"{path}/{r['name']}")
        if df.count() != r["n"]:
            raise ValueError(f"{r['name']} has another number of rows than its manifest says")
        out[r["name"]] = df
    return out


def export_jsonl(df: DataFrame, key: str, path: str) -> str:
    """Rows as JSON lines in order of the key, columns in declared order; the digest of
    the whole is returned.  Files are ranges of the key, so their order is the rows'."""
    lines = df.repartitionByRange(key).sortWithinPartitions(key).select(F.col(key).alias("_k"), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))
    lines.select("value").write.text(path)
    return df.select(F.sum(F.xxhash64(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})).cast("decimal(38,0)")).cast("string")).first()[0]


def import_jsonl(spark: SparkSession, schema, path: str, digest: str) -> DataFrame:
    """Rows of an export; refused if their digest differs."""
    df = spark.read.schema(schema).json(path)
    own = df.select(F.sum(F.xxhash64(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})).cast("decimal(38,0)")).cast("string")).first()[0]
    if own != digest:
        raise ValueError("the export's digest doesn't match")
    return df
