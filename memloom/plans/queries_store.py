"""Queries over the store: scopes, history, tasks, feedback, brief and integrity."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from memloom.functions import text as tx
from memloom.operators import brief, evaluation, store, trust
from memloom.plans.registry import query
from memloom.plans.views import NOW, with_views
from memloom.sources.tables import shared_folder

_A = with_views("atoms")


@query("p01_live", _A + " SELECT id, kind, project FROM atoms WHERE status = 'live'")
def p01(v):
    return store.scoped(v.atoms).select("id", "kind", "project")


@query("p02_kinds", _A + " SELECT id, kind, CASE WHEN kind = 'document_chunk' THEN 1 ELSE 0 END AS class_pos FROM atoms WHERE status = 'live' AND kind IN ('atom', 'narrative')")
def p02(v):
    return store.scoped(v.atoms, kinds=("atom", "narrative")).select("id", "kind", store.kind_class().alias("class_pos"))


@query("p03_time_and_project", _A + " SELECT id, coalesce(occurred_at, created_at) AS t FROM atoms WHERE status = 'live' AND project = 'src3' AND coalesce(occurred_at, created_at) BETWEEN 1690000000 AND 1702000000")
def p03(v):
    return store.scoped(v.atoms, project="src3", time_scope=(1690000000, 1702000000)).select("id", tx.effective_time().alias("t"))


@query("p04_agent_scope", with_views("atoms", "provenance") + " SELECT id FROM atoms WHERE status = 'live' AND id IN (SELECT atom_id FROM provenance WHERE agent = 'de')")
def p04(v):
    return store.scoped(v.atoms, v.provenance, agent="de").select("id")


@query("p05_composite_scope", with_views("atoms", "provenance") + " SELECT id FROM atoms WHERE status = 'live' AND kind IN ('atom', 'snapshot') AND project IN ('src1') AND id IN (SELECT atom_id FROM provenance WHERE agent = 'en')")
def p05(v):
    return store.scoped(v.atoms, v.provenance, kinds=("atom", "snapshot"), project="src1", agent="en").select("id")


@query("p13_uncorroborated", with_views("atoms", "provenance") + " SELECT a.id, bool_and(p.source = 'bulk-import') AND a.kind = 'document_chunk' AS imported FROM atoms a JOIN provenance p ON p.atom_id = a.id GROUP BY a.id, a.kind")
def p13(v):
    s = v.provenance.groupBy(F.col("atom_id").alias("id")).agg(F.min((F.col("source") == "bulk-import").cast("int")).alias("i"))
    return v.atoms.select("id", "kind").join(s, "id").select("id", ((F.col("i") == 1) & (F.col("kind") == "document_chunk")).alias("imported"))


@query("s12_backfill", "SELECT doc_id AS record_id, source AS source_ref FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) WHERE n = 1 AND source NOT IN ('src1', 'src2')")
def s12(v):
    known = v.spark.createDataFrame([("src1",), ("src2",)], "source_ref string")
    return store.backfill(v.raw("documents").select(F.col("doc_id").alias("record_id"), F.col("source").alias("source_ref")), known)


@query("s18_lookup", with_views("atoms", "facets") + " SELECT id, kind, row_number() OVER (ORDER BY id) <= 20 AND (SELECT count(*) FROM facets JOIN atoms ON id = atom_id WHERE key = 'tag' AND value = 'lang:de' AND status = 'live') > 20 AS truncated FROM facets JOIN atoms ON id = atom_id WHERE key = 'tag' AND value = 'lang:de' AND status = 'live' ORDER BY id LIMIT 20")
def s18(v):
    return store.lookup(v.facets, v.atoms, "tag", "lang:de", 20)


@query("s19_atoms_with_provenance", with_views("atoms", "provenance") + " SELECT id, status, string_agg(source || ':' || source_ref, ',' ORDER BY recorded_at, source_ref) AS history, count(*) AS n FROM atoms JOIN provenance ON atom_id = id GROUP BY id, status")
def s19(v):
    h = v.provenance.groupBy(F.col("atom_id").alias("id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("recorded_at", "source_ref", "source"))), lambda s: F.concat(s["source"], F.lit(":"), s["source_ref"])).alias("h"))
    return v.atoms.select("id", "status").join(h, "id").select("id", "status", F.array_join("h", ",").alias("history"), F.size("h").cast("long").alias("n"))


@query("s20_edges", with_views("supersedes") + " SELECT src_atom, dst_atom, row_number() OVER (ORDER BY src_atom, dst_atom) AS n FROM supersedes")
def s20(v):
    return v.supersedes.select("src_atom", "dst_atom", F.row_number().over(Window.orderBy("src_atom", "dst_atom")).alias("n"))


@query("j10_missing_embeddings", with_views("atoms", "vectors") + " SELECT id FROM atoms WHERE status = 'live' AND id NOT IN (SELECT atom_id FROM vectors)")
def j10(v):
    return store.missing_embeddings(v.atoms, v.embeddings, "m0").select("id")


@query("j06_embedded_live", with_views("atoms", "vectors") + " SELECT id, kind FROM atoms JOIN vectors ON atom_id = id WHERE status = 'live' AND kind <> 'document_chunk'")
def j06(v):
    return v.atoms.filter("status = 'live' AND kind <> 'document_chunk'").join(v.embeddings.select(F.col("atom_id").alias("id")), "id").select("id", "kind")


@query("j12_chain_ends", with_views("supersedes") + """
, RECURSIVE_STEP AS (SELECT dst_atom AS id, min(src_atom) AS nxt FROM supersedes GROUP BY dst_atom)
SELECT id, coalesce(b.nxt, a.nxt) AS end FROM (SELECT a.id, a.nxt FROM RECURSIVE_STEP a) a LEFT JOIN (SELECT id AS mid, nxt FROM RECURSIVE_STEP) b ON b.mid = a.nxt""".replace("AS end", 'AS "end"'))
def j12(v):
    return trust.chain_ends(v.supersedes).select("id", "end")


@query("j20_next_turns", "SELECT u.conv_id, u.turn, a.turn AS answer_turn, length(a.text) AS answer_chars FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'")
def j20(v):
    c = v.raw("conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    x = c.select("conv_id", "turn", "role", F.lead("role").over(w).alias("r2"), F.lead("turn").over(w).alias("answer_turn"), F.lead(F.length("text")).over(w).cast("long").alias("answer_chars"))
    return x.filter("role = 'user' AND r2 = 'assistant' AND answer_turn = turn + 1").select("conv_id", "turn", "answer_turn", "answer_chars")


@query("j21_siblings", _A + " SELECT a.id, count(*) AS siblings FROM atoms a JOIN atoms b ON a.project = b.project AND a.id <> b.id WHERE a.status = 'live' AND b.status = 'live' GROUP BY a.id")
def j21(v):
    live = store.scoped(v.atoms).select("id", "project")
    n = live.groupBy("project").agg((F.count("*") - 1).alias("siblings"))
    return live.join(n, "project").filter("siblings > 0").select("id", "siblings")


@query("j22_exact_twins", "SELECT a.doc_id, count(b.doc_id) AS twins FROM documents a LEFT JOIN documents b ON b.text = a.text AND b.doc_id <> a.doc_id GROUP BY a.doc_id")
def j22(v):
    d = v.raw("documents").select("doc_id", F.sha2("text", 256).alias("t"))
    return d.join(d.groupBy("t").agg((F.count("*") - 1).alias("twins")), "t").select("doc_id", "twins")


@query("j25_hits_to_sources", with_views("provenance") + " SELECT e.event_id, p.source_ref FROM events e JOIN provenance p ON p.atom_id = e.event_id % 997 WHERE p.agent <> CASE WHEN e.user_id % 2 = 0 THEN 'en' ELSE 'de' END")
def j25(v):
    """Sources of hits, without those of the one who asked."""
    e = v.raw("events").select("event_id", (F.col("event_id") % 997).alias("atom_id"), F.when(F.col("user_id") % 2 == 0, "en").otherwise("de").alias("asker"))
    return e.join(v.provenance.select("atom_id", "source_ref", "agent"), "atom_id").filter("agent <> asker").select("event_id", "source_ref")


@query("a10_analytics", _A + " SELECT kind, status, count(*) AS n, count(*) FILTER (WHERE id IN (SELECT vec_id FROM embeddings)) AS embedded FROM atoms GROUP BY kind, status")
def a10(v):
    e = v.embeddings.select(F.col("atom_id").alias("id"), F.lit(1).alias("e"))
    return v.atoms.join(e, "id", "left").groupBy("kind", "status").agg(F.count("*").alias("n"), F.count("e").alias("embedded"))


@query("a11_embedding_coverage", with_views("atoms", "vectors") + " SELECT 'm0' AS model_id, count(v.atom_id) AS covered, count(*) AS live FROM atoms a LEFT JOIN vectors v ON v.atom_id = a.id WHERE status = 'live'")
def a11(v):
    return store.scoped(v.atoms).join(v.embeddings.select(F.col("atom_id").alias("id"), "model_id"), "id", "left").agg(F.lit("m0").alias("model_id"), F.count("model_id").alias("covered"), F.count("*").alias("live"))


@query("a14_latency_percentiles", """
WITH g AS (SELECT event_type, list(value ORDER BY value) AS s, count(*) AS n, avg(value) AS mean FROM events GROUP BY event_type)
SELECT event_type, n, round(mean, 6) AS mean, s[CAST(round_even(0.5 * (n - 1), 0) AS BIGINT) + 1] AS p50, s[CAST(round_even(0.95 * (n - 1), 0) AS BIGINT) + 1] AS p95 FROM g""")
def a14(v):
    return evaluation.nearest_rank(v.raw("events"), "value", ["event_type"])


@query("a17_task_heads", with_views("checkpoints") + " SELECT task_id, agent, max(revision) AS revision, arg_max(request_id, revision) AS request_id FROM checkpoints GROUP BY task_id, agent")
def a17(v):
    return store.task_heads(v.checkpoints).select("task_id", "agent", "revision", "request_id")


@query("j18_as_of_revision", with_views("checkpoints") + " SELECT task_id, agent, max(revision) AS revision, arg_max(request_id, revision) AS request_id FROM checkpoints WHERE revision <= 5 GROUP BY task_id, agent")
def j18(v):
    return store.task_heads(v.checkpoints, revision=5).select("task_id", "agent", "revision", "request_id")


@query("j18_as_of_time", with_views("checkpoints") + " SELECT task_id, agent, max(revision) AS revision, arg_max(request_id, revision) AS request_id FROM checkpoints WHERE recorded_at <= (SELECT CAST(floor(epoch(min(ts))) AS BIGINT) + 864000 FROM events) GROUP BY task_id, agent")
def j18b(v):
    t = v.raw("events").agg(F.unix_timestamp(F.min("ts")) + 864000).first()[0]
    return store.task_heads(v.checkpoints, as_of=t).select("task_id", "agent", "revision", "request_id")


@query("w10_history_page", with_views("checkpoints") + """
, p AS (SELECT *, row_number() OVER (PARTITION BY task_id, agent ORDER BY revision) AS n, count(*) OVER (PARTITION BY task_id, agent) AS total FROM checkpoints WHERE revision > 3)
SELECT task_id, agent, revision, request_id, total > 4 AS truncated FROM p WHERE n <= 4""")
def w10(v):
    return store.task_history(v.checkpoints, 3, 4).select("task_id", "agent", "revision", "request_id", "truncated")


@query("w13_last_events", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 5")
def w13(v):
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return v.raw("events").withColumn("n", F.row_number().over(w)).filter("n <= 5").select("user_id", "event_id")


@query("a18_credits", with_views("atoms", "feedback") + """
, c AS (SELECT DISTINCT atom_id, agent, task_id FROM feedback WHERE feedback_type = 'helpful')
SELECT id, count(*) AS n, round(CASE WHEN importance >= 1 THEN importance ELSE least(1.0, importance + 0.01 * count(*)) END, 6) AS importance FROM atoms JOIN c ON c.atom_id = id GROUP BY id, importance""")
def a18(v):
    return store.credited(v.atoms, v.feedback).select("id", "n", F.round("importance", 6).alias("importance"))


@query("m05_first_credits", with_views("feedback") + " SELECT atom_id, agent, task_id, arg_min(event_id, recorded_at * 10000000 + event_id) AS feedback_id, min(recorded_at) AS awarded_at FROM feedback WHERE feedback_type = 'helpful' GROUP BY atom_id, agent, task_id")
def m05(v):
    return store.credits(v.feedback)


@query("a25_over_cap", with_views("feedback") + " SELECT agent, count(*) AS n FROM feedback GROUP BY agent HAVING count(*) > 32")
def a25(v):
    return v.feedback.groupBy("agent").agg(F.count("*").alias("n")).filter("n > 32")


@query("a23_outcomes", "SELECT count(*) AS n, CAST(sum(CASE WHEN lower(trim(event_type)) = lower(trim(e2)) THEN 1 ELSE 0 END) AS BIGINT) AS correct, CAST(sum(CASE WHEN lower(trim(event_type)) <> lower(trim(e2)) THEN 1 ELSE 0 END) AS BIGINT) AS incorrect, CAST(0 AS BIGINT) AS abstained, CAST(sum(CASE WHEN lower(trim(event_type)) = lower(trim(e2)) AND value > 10 THEN 1 ELSE 0 END) AS BIGINT) AS supported FROM (SELECT *, 'click' AS e2 FROM events)")
def a23(v):
    return evaluation.outcome_scores(v.raw("events").select(F.col("event_type").alias("expected"), F.lit("click").alias("answer"), (F.col("value") > 10).alias("supported")))


@query("r30_integrity", with_views("atoms", "provenance", "facets", "supersedes", "vectors") + """
 SELECT 'edges_without_source' AS "check", count(*) AS n FROM supersedes WHERE src_atom NOT IN (SELECT id FROM atoms)
UNION ALL SELECT 'edges_without_target', count(*) FROM supersedes WHERE dst_atom NOT IN (SELECT id FROM atoms)
UNION ALL SELECT 'facets_without_atom', count(*) FROM facets WHERE atom_id NOT IN (SELECT id FROM atoms)
UNION ALL SELECT 'provenance_without_atom', count(*) FROM provenance WHERE atom_id NOT IN (SELECT id FROM atoms)
UNION ALL SELECT 'forked_predecessors', count(*) FROM (SELECT dst_atom FROM supersedes GROUP BY dst_atom HAVING count(DISTINCT src_atom) > 1)
UNION ALL SELECT 'live_without_embedding', count(*) FROM atoms WHERE status = 'live' AND id NOT IN (SELECT atom_id FROM vectors)
UNION ALL SELECT 'live', count(*) FROM atoms WHERE status = 'live'""")
def r30(v):
    return store.integrity(v.atoms, v.provenance, v.facets, v.supersedes, v.embeddings)


@query("a20_store_digest", _A + " SELECT count(*) AS n, CAST(sum(CAST('0x' || substr(sha256(id || chr(0) || text), 1, 12) AS BIGINT)) AS VARCHAR) AS digest FROM atoms")
def a20(v):
    return store.store_digest(v.atoms)


@query("m02_corrections", with_views("atoms") + " SELECT status, count(*) AS n, sum(length(text))::BIGINT AS chars FROM (SELECT CASE WHEN status = 'live' AND id % 40 = 6 THEN 'superseded' ELSE status END AS status, text FROM atoms UNION ALL SELECT status, 'corrected ' || id FROM atoms WHERE status = 'live' AND id % 40 = 6) GROUP BY status")
def m02(v):
    wanted = v.raw("documents").filter("doc_id % 40 = 6").select(F.col("doc_id").alias("old_id"), (F.col("doc_id") + 10_000_000_000).alias("new_id"), F.concat(F.lit("corrected "), F.col("doc_id").cast("string")).alias("text"))
    atoms, _, _ = store.correct_atoms(v.atoms, v.facets, v.supersedes, wanted)
    return atoms.groupBy("status").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("m03_facet_set", with_views("facets") + ", n AS (SELECT doc_id AS atom_id, 'tag' AS key, 'src:src1' AS value FROM documents WHERE doc_id % 4 = 0), u AS (SELECT * FROM facets UNION SELECT * FROM n) SELECT key, count(*) AS n FROM u GROUP BY key")
def m03(v):
    new = v.raw("documents").filter("doc_id % 4 = 0").select(F.col("doc_id").alias("atom_id"), F.lit("tag").alias("key"), F.lit("src:src1").alias("value"))
    return store.add_facets(v.facets, new).groupBy("key").agg(F.count("*").alias("n"))


@query("m13_importance_bumps", _A + " SELECT id, round(greatest(importance, least(1.0, importance + 0.05 * (SELECT count(*) FROM events e WHERE e.event_id % 997 = id))), 6) AS importance FROM atoms")
def m13(v):
    return store.bump_importance(v.atoms, v.raw("events").select((F.col("event_id") % 997).alias("id"))).select("id", F.round("importance", 6).alias("importance"))


@query("m06_checkpoints")
def m06(v):
    e = v.raw("events")
    req = e.select(F.concat_ws("/", "event_type", F.col("user_id").cast("string")).alias("stream"), F.col("event_id").alias("seq"), (F.col("event_id") % 5003).cast("string").alias("request_id"), (F.col("event_id") % 3).cast("int").alias("expected"))
    return store.apply_checkpoints(req)


@query("w11_pins", with_views("atoms", "facets") + " SELECT id, CAST(max(CAST(value AS BIGINT)) AS BIGINT) AS pin, row_number() OVER (ORDER BY max(CAST(value AS BIGINT)) DESC, coalesce(occurred_at, created_at) DESC, id) AS n FROM facets JOIN atoms ON id = atom_id WHERE key = 'pin' AND status = 'live' GROUP BY id, occurred_at, created_at")
def w11(v):
    return brief.pins(v.atoms, v.facets)


@query("w12_active", with_views("atoms", "facets") + """
, recent AS (SELECT * FROM atoms WHERE status = 'live' AND kind <> 'document_chunk' ORDER BY coalesce(occurred_at, created_at) DESC, id LIMIT 500),
s AS (SELECT id, project, (1 + least(importance, 1.0)) * (0.5 + 0.5 * exp(-greatest(0.0, (1740000000 - coalesce(occurred_at, created_at))::DOUBLE) / 7776000.0)) AS score FROM recent WHERE id NOT IN (SELECT atom_id FROM facets WHERE key = 'pin')),
r AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS n FROM s)
SELECT id, project, round(score, 6) AS score, n, min(n) OVER (PARTITION BY project) AS thread FROM r""")
def w12(v):
    return brief.active(v.atoms, v.facets, NOW).select("id", "project", F.round("score", 6).alias("score"), "n", "thread")


@query("r28_brief")
def r28(v):
    return brief.brief(v.atoms, v.facets, v.checkpoints, NOW)


@query("k02_export_rows", _A + " SELECT id, kind, project, created_at, status FROM atoms")
def k02(v):
    """The rows of an export, read back from its files."""
    path = shared_folder(v.spark)
    rows = v.atoms.select("id", "kind", "project", "created_at", "status")
    return store.import_jsonl(v.spark, rows.schema, path, store.export_jsonl(rows, "id", path))


@query("t05_seeded_sample", "SELECT event_id FROM (SELECT event_id, md5(CAST(event_id AS VARCHAR)) AS h FROM events) ORDER BY h, event_id LIMIT 50")
def t05(v):
    return v.raw("events").select("event_id", F.md5(F.col("event_id").cast("string")).alias("h")).orderBy("h", "event_id").limit(50).select("event_id")


@query("st2_near_copy_gate", with_views("vectors") + """
, last AS (SELECT atom_id, embedding::DOUBLE[] AS e FROM vectors WHERE atom_id % 10 <> 0 ORDER BY atom_id DESC LIMIT 200),
x AS (SELECT c.atom_id AS id, l.atom_id, list_cosine_similarity(c.embedding::DOUBLE[], e) AS similarity FROM vectors c CROSS JOIN last l WHERE c.atom_id % 10 = 0)
SELECT id, atom_id, round(similarity, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, atom_id) AS n FROM x WHERE similarity >= 0.3) WHERE n = 1""")
def st2(v):
    from memloom.streaming import ambient

    e = v.embeddings
    return ambient.near_copies(e.filter("atom_id % 10 = 0").select(F.col("atom_id").alias("id"), "embedding"), e.filter("atom_id % 10 <> 0").select("atom_id", "embedding", F.col("atom_id").alias("t")), floor=0.3).select("id", "atom_id", F.round("similarity", 6).alias("similarity"))


@query("st3_drift_notices", """
WITH RECURSIVE h AS (SELECT CAST(user_id AS VARCHAR) AS session_id, CAST(floor(epoch(ts)) AS BIGINT) AS t, event_id FROM events WHERE event_id % 3 = 0 AND event_id % 7 <> 0),
walk AS (SELECT session_id, min({'t': t, 'e': event_id}) AS m FROM h GROUP BY session_id
  UNION ALL SELECT w.session_id, min({'t': h.t, 'e': h.event_id}) FROM walk w JOIN h ON h.session_id = w.session_id AND h.t >= w.m.t + 900 GROUP BY w.session_id)
SELECT session_id, m.t AS "at", m.e AS atom_id, CAST(0.98 AS DOUBLE) AS score FROM walk""")
def st3(v):
    from memloom.streaming import ambient

    e = v.raw("events")
    return ambient.drift(e.select(F.col("user_id").cast("string").alias("session_id"), F.unix_timestamp("ts").alias("at"), F.col("event_id").alias("atom_id"), F.when(F.col("event_id") % 3 == 0, 0.98).otherwise(0.5).alias("score"), (F.col("event_id") % 7 == 0).alias("in_context")))


@query("s11_spans")
def s11(v):
    from memloom.sources.exports import spans

    return spans(v.raw("conversations").select(F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("offset"), "role", "text"))


#: Verdicts on pairs of atoms, some of them malformed or about atoms that don't exist.
_VERDICTS = ("doc_id AS pos", "CASE WHEN doc_id % 41 <> 0 THEN doc_id % 97 + CASE WHEN doc_id % 37 = 0 THEN 1000000000 ELSE 0 END END AS mem_id", "doc_id % 97 + doc_id % 4 AS chunk_id", "doc_id % 3 <> 0 AS keep", "doc_id % 10 / CAST(10 AS DOUBLE) AS confidence")
_VERDICT_SQL = with_views("atoms", "supersedes") + f"""
, verdicts AS (SELECT {", ".join(_VERDICTS)} FROM documents),
judged AS (SELECT v.*, CASE WHEN mem_id IS NULL THEN 'malformed' WHEN NOT keep THEN 'rejected' WHEN mem_id NOT IN (SELECT id FROM atoms) OR chunk_id NOT IN (SELECT id FROM atoms) THEN 'missing' END AS kept FROM verdicts v),
done AS (SELECT *, row_number() OVER (PARTITION BY chunk_id, mem_id, kept IS NULL ORDER BY pos) AS k, (chunk_id, mem_id) IN (SELECT (src_atom, dst_atom) FROM supersedes) AS had FROM judged),
outcomes AS (SELECT *, coalesce(kept, CASE WHEN had OR k > 1 THEN 'updated' ELSE 'written' END) AS outcome FROM done)"""


def _verdicts(v):
    edges = v.supersedes.select("src_atom", "dst_atom", F.lit(1.0).alias("weight"), F.lit(None).cast("string").alias("campaign"))
    return edges, v.raw("documents").selectExpr(*_VERDICTS), v.atoms


@query("m08_verdicts", _VERDICT_SQL + """
, last AS (SELECT chunk_id, mem_id, arg_max(confidence, pos) AS w FROM outcomes WHERE kept IS NULL GROUP BY ALL)
SELECT coalesce(src_atom, chunk_id) AS src_atom, coalesce(dst_atom, mem_id) AS dst_atom, coalesce(w, 1.0) AS weight, CASE WHEN src_atom IS NULL THEN 'c1' END AS campaign
FROM supersedes FULL JOIN last ON src_atom = chunk_id AND dst_atom = mem_id""")
def m08(v):
    return store.apply_verdicts(*_verdicts(v), "c1")


@query("m08_verdict_report", _VERDICT_SQL + " SELECT outcome, count(*) AS n FROM outcomes GROUP BY outcome")
def m08b(v):
    return store.verdict_report(*_verdicts(v))
