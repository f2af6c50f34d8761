"""Receipts of what a recall showed, feedback on it, emits, guards and repairs.

As in the store, a write is a function from tables to tables, and idempotence comes
from anti-joins on keys.  What a write refuses comes back as rows with an outcome.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from memloom.functions import text as tx
from memloom.operators import store

# Limits of a receipt, a point read, an emit, an agent's name and a batch of feedback.
MAX_RECORDS, MAX_PROVENANCE, MAX_BODY, MAX_AGENT, PENDING = 32, 64, 32_000, 64, 1000
FEEDBACK_TYPES = ("shown", "used", "helpful", "irrelevant", "outdated")
EMITS = {"atom": "atom", "discovery": "atom", "failure": "atom", "narrative": "narrative", "snapshot": "snapshot"}


# ---- receipts and feedback ---------------------------------------------------


def receipts(results: DataFrame, max_records: int = MAX_RECORDS) -> DataFrame:
    """Exposures (receipt_id, atom_id, rank, score, delivery) of results (query_id, doc_id,
    position, score, delivery): the first records of each, every atom once."""
    once = results.groupBy("query_id", "doc_id").agg(F.min(F.struct("position", "score", "delivery")).alias("r"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("r.position", "doc_id"))
    return once.withColumn("rank", rank).filter(F.col("rank") <= max_records).select(F.col("query_id").alias("receipt_id"), F.col("doc_id").alias("atom_id"), "rank", "r.score", "r.delivery")


def judged_feedback(reports: DataFrame, feedback: DataFrame, heads: DataFrame, exposures: DataFrame) -> DataFrame:
    """reports (event_id, receipt_id, atom_id, feedback_type, agent, task_id, note) with
    their outcome: recorded, replayed, differs, malformed, foreign or unexposed.

    An event counts once: a later report under its id, or one that feedback holds, is a
    replay if it says the same, else it differs.  heads is (receipt_id, agent, task_id)
    of receipts, exposures (receipt_id, atom_id).
    """
    said = ["receipt_id", "atom_id", "feedback_type", "agent", "task_id", "note"]
    body = F.struct(*said)
    old = feedback.select("event_id", body.alias("old"))
    heads = heads.select("receipt_id", F.col("agent").alias("_agent"), F.col("task_id").alias("_task"))
    shown = exposures.select("receipt_id", "atom_id", F.lit(True).alias("_shown")).distinct()
    x = reports.join(old, "event_id", "left").join(heads, "receipt_id", "left").join(shown, ["receipt_id", "atom_id"], "left")
    sound = F.col("feedback_type").isin(*FEEDBACK_TYPES) & (F.length("agent") <= MAX_AGENT) & ((F.col("feedback_type") == "shown") | (F.length(F.trim("note")) > 0))
    fault = F.when(~F.coalesce(sound, F.lit(False)), "malformed").when(~(F.col("agent").eqNullSafe(F.col("_agent")) & F.col("task_id").eqNullSafe(F.col("_task"))), "foreign").when(F.col("_shown").isNull(), "unexposed")
    x = x.withColumn("_fault", fault).withColumn("_said", body)
    first = Window.partitionBy("event_id").orderBy(F.col("_fault").isNotNull(), "_said")
    x = x.withColumn("_n", F.row_number().over(first)).withColumn("_first", F.first("_said").over(first)).withColumn("_ok", F.first("_fault").over(first).isNull())
    known = F.coalesce("old", F.when((F.col("_n") > 1) & F.col("_ok"), F.col("_first")))
    outcome = F.when(known.isNotNull(), F.when(known == F.col("_said"), "replayed").otherwise("differs")).otherwise(F.coalesce("_fault", F.lit("recorded")))
    return x.select("event_id", *said, outcome.alias("outcome"))


def add_feedback(feedback: DataFrame, judged: DataFrame, recorded_at) -> DataFrame:
    """feedback with the recorded reports, which wait to be processed."""
    new = judged.filter("outcome = 'recorded'").drop("outcome").withColumns({"recorded_at": recorded_at, "processed_at": F.lit(None).cast("long")})
    return feedback.unionByName(new.select(*feedback.columns))


def process_pending(feedback: DataFrame, atoms: DataFrame, now: int, limit: int = PENDING, step: float = 0.01) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Credits the next batch of pending feedback: feedback with the batch marked, atoms
    with their importance, and one row (processed, updated, missing)."""
    if not 1 <= limit <= 10_000:
        raise ValueError("a batch has 1 to 10000 rows")
    batch = feedback.filter("processed_at IS NULL").orderBy("recorded_at", "event_id").limit(limit)
    batch = batch.join(atoms.select(F.col("id").alias("atom_id"), F.lit(True).alias("_there")), "atom_id", "left")
    done = feedback.filter("processed_at IS NOT NULL AND feedback_type = 'helpful'").select("atom_id", "agent", "task_id").distinct()
    new = batch.filter("feedback_type = 'helpful' AND _there").select("atom_id", "agent", "task_id").distinct().join(done, ["atom_id", "agent", "task_id"], "left_anti")
    gain = new.groupBy(F.col("atom_id").alias("id")).agg(F.count("*").alias("_n"))
    raised = atoms.join(gain, "id", "left").withColumn("importance", F.when(F.col("_n").isNull() | (F.col("importance") >= 1), F.col("importance")).otherwise(F.least(F.lit(1.0), F.col("importance") + step * F.col("_n")))).select(*atoms.columns)
    marked = feedback.join(batch.select("event_id", F.lit(True).alias("_now")), "event_id", "left").withColumn("processed_at", F.when(F.col("_now"), F.lit(now).cast("long")).otherwise(F.col("processed_at"))).select(*feedback.columns)
    none = F.lit(0).cast("long")
    told = batch.agg(F.count("*").alias("processed"), none.alias("updated"), F.count(F.when(F.col("_there").isNull(), 1)).alias("missing")).union(gain.agg(none, F.coalesce(F.sum("_n"), none), none)).agg(*[F.sum(c).alias(c) for c in ("processed", "updated", "missing")])
    return marked, raised, told.select("processed", "updated", "missing")


# ---- point reads, guards and emits -------------------------------------------


def point_reads(ids: DataFrame, atoms: DataFrame, provenance: DataFrame | None = None, most: int = MAX_PROVENANCE) -> DataFrame:
    """For each of ids (id) the atom, whatever its status, or found = false; with
    provenance its first rows too, and whether there are more."""
    out = ids.distinct().join(atoms.select("id", "text", "kind", "project", "created_at", "occurred_at", "status", F.lit(True).alias("found")), "id", "left").withColumn("found", F.coalesce("found", F.lit(False)))
    if provenance is None:
        return out
    own = provenance.join(ids.select(F.col("id").alias("atom_id")).distinct(), "atom_id", "left_semi")
    n = F.row_number().over(Window.partitionBy("atom_id").orderBy("recorded_at", "source", "source_ref"))
    page = own.withColumn("_n", n).filter(F.col("_n") <= most + 1).groupBy(F.col("atom_id").alias("id")).agg(F.max(F.col("_n") > most).alias("truncated"), F.transform(F.sort_array(F.collect_list(F.when(F.col("_n") <= most, F.struct("_n", "source", "agent", "source_ref", "recorded_at")))), lambda p: F.struct(p["source"], p["agent"], p["source_ref"], p["recorded_at"])).alias("provenance"))
    return out.join(page, "id", "left").withColumn("truncated", F.coalesce("truncated", F.lit(False)))


def refusal(source, source_ref, agent, text, reserved: tuple[str, ...] = ("bulk-import", "system"), prefixes: tuple[str, ...] = ("ambient", "campaign:")) -> Column:
    """Why a write is refused, null if it isn't: a source kept for the system, a reference
    that leaves its root, an agent's or a body's length."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    kept = c(source).isin(*reserved)
    for p in prefixes:
        kept = kept | c(source).startswith(p)
    ref = c(source_ref)
    leaves = ref.startswith("/") | F.contains(ref, F.lit("//")) | F.contains(ref, F.lit(".."))
    return F.when(kept, "reserved source").when(leaves, "escaping reference").when(F.length(F.trim(c(agent))) > MAX_AGENT, "agent too long").when(F.length(c(text)) > MAX_BODY, "body too long").when(F.coalesce(F.trim(c(text)), F.lit("")) == "", "empty body")


def emits(requests: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New atoms and their provenance of emit requests (request_id, emit, agent, project,
    source, source_ref, recorded_at, text, outcome, principle, shape), and the refused
    requests with the reason.  The body is composed of the parts that aren't blank."""
    kind = F.create_map(*[F.lit(x) for pair in EMITS.items() for x in pair])[F.col("emit")]
    body = tx.composed_body(text=F.col("text"), outcome=F.col("outcome"), principle=F.col("principle"), shape=F.col("shape"))
    x = requests.withColumns({"kind": kind, "body": F.regexp_replace(body, "^text: ", "")})
    x = x.withColumn("reason", F.coalesce(F.when(F.col("kind").isNull(), "unknown emit"), refusal("source", "source_ref", "agent", "body")))
    good = x.filter("reason IS NULL").withColumn("id", tx.ulid_of(F.col("recorded_at") * 1000, "request_id"))
    atoms = good.select("id", F.col("body").alias("text"), "kind", "project", F.col("recorded_at").alias("created_at"), F.lit("live").alias("status"))
    return atoms, good.select(F.col("id").alias("atom_id"), "source", "agent", "source_ref", "recorded_at"), x.filter("reason IS NOT NULL").select("request_id", "reason")


def pin(facets: DataFrame, atoms: DataFrame, pins: DataFrame) -> DataFrame:
    """facets with a pin (atom_id, value) on atoms that are live."""
    live = atoms.filter("status = 'live'").select(F.col("id").alias("atom_id"))
    return store.add_facets(facets, pins.join(live, "atom_id", "left_semi").select("atom_id", F.lit("pin").alias("key"), "value"))


def unpin(facets: DataFrame, pins: DataFrame) -> DataFrame:
    return store.remove_facets(facets, pins.select("atom_id", F.lit("pin").alias("key"), "value"))


def filtered_kinds(fused: DataFrame, atoms: DataFrame, provenance: DataFrame, kinds=None, agent: str | None = None) -> DataFrame:
    """fused without other kinds, and without atoms that the agent has no provenance of."""
    out = fused
    if kinds is not None:
        out = out.join(atoms.filter(F.col("kind").isin(*kinds)).select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
    if agent is not None:
        out = out.join(provenance.filter(F.col("agent") == agent).select(F.col("atom_id").alias("doc_id")).distinct(), "doc_id", "left_semi")
    return out


# ---- checks and repairs ------------------------------------------------------


def scope_faults(feedback: DataFrame, heads: DataFrame, exposures: DataFrame, credits: DataFrame) -> DataFrame:
    """(check, key) of rows that contradict each other: feedback of another agent or task
    than its receipt's, of an atom that wasn't shown, and credits without such feedback."""
    f = feedback.join(heads.select("receipt_id", F.col("agent").alias("_a"), F.col("task_id").alias("_t")), "receipt_id", "left")
    foreign = f.filter(~(F.col("agent").eqNullSafe(F.col("_a")) & F.col("task_id").eqNullSafe(F.col("_t")))).select(F.lit("feedback_scope").alias("check"), F.col("event_id").cast("string").alias("key"))
    unseen = feedback.join(exposures.select("receipt_id", "atom_id").distinct(), ["receipt_id", "atom_id"], "left_anti").select(F.lit("feedback_exposure").alias("check"), F.col("event_id").cast("string").alias("key"))
    owed = credits.join(feedback.filter("feedback_type = 'helpful'").select(F.col("event_id").alias("feedback_id"), "atom_id", "agent", "task_id"), ["feedback_id", "atom_id", "agent", "task_id"], "left_anti")
    return foreign.union(unseen).union(owed.select(F.lit("credit_feedback").alias("check"), F.col("feedback_id").cast("string").alias("key")))


def key_faults(tables: dict[str, DataFrame], keys: dict[str, list[str]], references: list[tuple[str, str, str, str]]) -> DataFrame:
    """(check, n): how many keys of each table occur twice or are null, and how many
    values of (table, column) aren't in (other, column)."""
    out = None
    for name, key in keys.items():
        null = F.lit(False)
        for c in key:
            null = null | F.col(c).isNull()
        rows = [tables[name].groupBy(*key).count().filter("count > 1").agg(F.lit(f"{name}: repeated keys").alias("check"), F.count("*").alias("n")), tables[name].filter(null).agg(F.lit(f"{name}: null keys").alias("check"), F.count("*").alias("n"))]
        for r in rows:
            out = r if out is None else out.union(r)
    for name, column, other, to in references:
        lost = tables[name].filter(F.col(column).isNotNull()).join(tables[other].select(F.col(to).alias(column)), column, "left_anti").agg(F.lit(f"{name}.{column}: not in {other}").alias("check"), F.count("*").alias("n"))
        out = lost if out is None else out.union(lost)
    return out


def rewritten_refs(provenance: DataFrame, old_rows: DataFrame, prefix: str = "row:") -> DataFrame:
    """provenance with references of the form prefix + row number replaced by what the
    old table (row_id, ref) says; unknown ones stay."""
    number = F.when(F.col("source_ref").rlike(f"^{prefix}[0-9]+$"), F.substring("source_ref", len(prefix) + 1, 20).cast("long"))
    x = provenance.withColumn("_row", number).join(old_rows.select(F.col("row_id").alias("_row"), F.col("ref").alias("_ref")), "_row", "left")
    return x.withColumn("source_ref", F.coalesce("_ref", "source_ref")).select(*provenance.columns)


def backfilled_projects(atoms: DataFrame, provenance: DataFrame) -> DataFrame:
    """atoms with the project that their earliest reference begins with, where they have none."""
    first = provenance.filter("source_ref LIKE '%/%'").groupBy(F.col("atom_id").alias("id")).agg(F.min_by(F.split_part("source_ref", F.lit("/"), F.lit(1)), F.struct("recorded_at", "source_ref")).alias("_p"))
    return atoms.join(first, "id", "left").withColumn("project", F.coalesce("project", "_p")).select(*atoms.columns)


def campaign_sample(edges: DataFrame, campaign: str, n: int, seed: int = 0) -> DataFrame:
    """n edges of a campaign, at random but the same for a seed: those with the least digests."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("src_atom").cast("string"), F.col("dst_atom").cast("string")))
    return edges.filter(F.col("campaign") == campaign).withColumn("digest", digest).orderBy("digest").limit(n)


def shadow_lines(served: DataFrame, shadow: DataFrame, k: int = 10) -> DataFrame:
    """One row per query that compares two ranked lists (query_id, doc_id, rank): how many
    of the first k they share, and whether the first is the same."""
    a = served.filter(F.col("rank") <= k).select("query_id", "doc_id", F.col("rank").alias("ra"))
    b = shadow.filter(F.col("rank") <= k).select("query_id", "doc_id", F.col("rank").alias("rb"))
    both = a.join(b, ["query_id", "doc_id"], "full_outer")
    return both.groupBy("query_id").agg(F.count("ra").alias("served"), F.count("rb").alias("shadow"), F.count(F.when(F.col("ra").isNotNull() & F.col("rb").isNotNull(), 1)).alias("shared"), F.coalesce(F.max(F.when(F.col("ra") == 1, F.col("rb") == 1)), F.lit(False)).alias("same_first"))


def event_feed(events: DataFrame, slots: int = 256) -> DataFrame:
    """The last events (seq, payload) as lines of a feed of server-sent events; seq orders them."""
    last = events.orderBy(F.desc("seq")).limit(slots)
    return last.select("seq", F.concat(F.lit("id: "), F.col("seq").cast("string"), F.lit("\ndata: "), "payload", F.lit("\n\n")).alias("line"))


def gate(metrics: DataFrame, baseline: DataFrame, slack: float = 0.02) -> DataFrame:
    """(name, value, base, ok) of metrics (name, value): none may fall below its baseline
    by more than the slack, and a name that one side lacks isn't ok."""
    both = metrics.join(baseline.withColumnRenamed("value", "base"), "name", "full_outer")
    return both.select("name", "value", "base", F.coalesce(F.col("value") >= F.col("base") - slack, F.lit(False)).alias("ok"))


def association_gate(before: DataFrame, after: DataFrame, seeds: DataFrame) -> DataFrame:
    """One row per query on lists (query_id, doc_id, rank) without and with association:
    whether queries without seeds are untouched (inert), and whether what was found
    before still is (parity)."""
    a, b = before.select("query_id", "doc_id", F.col("rank").alias("ra")), after.select("query_id", "doc_id", F.col("rank").alias("rb"))
    per = a.join(b, ["query_id", "doc_id"], "full_outer").groupBy("query_id").agg(F.bool_and(F.col("ra").eqNullSafe(F.col("rb"))).alias("same"), F.bool_and(F.col("ra").isNull() | F.col("rb").isNotNull()).alias("parity"))
    return per.join(seeds.select("query_id").distinct().withColumn("seeded", F.lit(True)), "query_id", "left").select("query_id", F.coalesce("seeded", F.lit(False)).alias("seeded"), "parity", (F.coalesce("seeded", F.lit(False)) | F.col("same")).alias("inert"))
