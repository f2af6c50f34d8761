"""Queries over receipts, feedback, guards, repairs, saved graphs and enrichment."""

from __future__ import annotations

from pyspark.sql import functions as F

from memloom.functions import python_text
from memloom.functions import text as tx
from memloom.operators import enrich, evaluation, graph, ledger, persist, ranking, store, trust
from memloom.plans.queries_graph import FACET_SQL, GRAPH_SQL, _degree, _graph
from memloom.plans.queries_recall import _TWO_LISTS, LEXICAL_SQL, TERMS_SQL, _asked, _lexical, _postings, _terms, _two, _vectors
from memloom.plans.registry import ORACLES, query
from memloom.plans.views import Views, with_views
from memloom.sources.tables import durable, shared_folder

# ---- receipts and feedback: who was shown what, and what was said of it ------------

_SAID_SQL = with_views("atoms") + """
, heads AS (SELECT item_id AS receipt_id, 'a' || item_id % 3 AS agent, 't' || item_id % 5 AS task_id FROM benchmark),
exposures AS (SELECT item_id AS receipt_id, (item_id * 7 + k * 13) % 997 AS atom_id FROM benchmark, unnest(range(0, 10)) AS t(k)),
events_in AS (SELECT *, event_id % 40 AS r FROM events),
said AS (SELECT CASE WHEN event_id % 6 = 5 THEN event_id - 5 ELSE event_id END AS event_id, r AS receipt_id, (r * 7 + (event_id % 11) * 13) % 997 AS atom_id,
  list_extract(['shown', 'used', 'helpful', 'irrelevant', 'outdated'], CAST(event_id % 5 + 1 AS INTEGER)) AS feedback_type,
  CASE WHEN event_id % 13 = 0 THEN 'zz' ELSE 'a' || r % 3 END AS agent, 't' || r % 5 AS task_id, CASE WHEN event_id % 17 <> 0 THEN 'n' || event_id END AS note, event_id AS raw_id FROM events_in),
reports AS (SELECT * EXCLUDE (raw_id) FROM said UNION ALL SELECT * EXCLUDE (raw_id) FROM said WHERE raw_id % 20 = 3),
faulty AS (SELECT p.*, CASE WHEN NOT (p.feedback_type = 'shown' OR length(trim(coalesce(p.note, ''))) > 0) THEN 'malformed' WHEN h.agent IS DISTINCT FROM p.agent OR h.task_id IS DISTINCT FROM p.task_id THEN 'foreign' WHEN e.atom_id IS NULL THEN 'unexposed' END AS fault
  FROM reports p LEFT JOIN heads h ON h.receipt_id = p.receipt_id LEFT JOIN exposures e ON e.receipt_id = p.receipt_id AND e.atom_id = p.atom_id),
numbered AS (SELECT *, row_number() OVER w AS n, first(fault IS NULL) OVER w AS ok, first(receipt_id || '|' || atom_id || '|' || feedback_type || '|' || agent || '|' || task_id || '|' || coalesce(note, '-')) OVER w AS head,
  receipt_id || '|' || atom_id || '|' || feedback_type || '|' || agent || '|' || task_id || '|' || coalesce(note, '-') AS own
  FROM faulty WINDOW w AS (PARTITION BY event_id ORDER BY (fault IS NOT NULL), receipt_id, atom_id, feedback_type, agent, task_id, note NULLS FIRST)),
judged AS (SELECT event_id, receipt_id, atom_id, feedback_type, agent, task_id, note, CASE WHEN n > 1 AND ok THEN CASE WHEN head = own THEN 'replayed' ELSE 'differs' END ELSE coalesce(fault, 'recorded') END AS outcome FROM numbered)"""


def _heads(v: Views):
    i = F.col("item_id")
    return v.raw("benchmark").select(i.alias("receipt_id"), F.concat(F.lit("a"), (i % 3).cast("string")).alias("agent"), F.concat(F.lit("t"), (i % 5).cast("string")).alias("task_id"))


def _exposures(v: Views):
    return v.raw("benchmark").select(F.col("item_id").alias("receipt_id"), F.explode(F.sequence(F.lit(0), F.lit(9))).alias("k")).select("receipt_id", ((F.col("receipt_id") * 7 + F.col("k") * 13) % 997).alias("atom_id"))


def _reports(v: Views):
    e, r = F.col("event_id"), F.col("event_id") % 40
    kind = F.element_at(F.array(*map(F.lit, ledger.FEEDBACK_TYPES)), (e % 5 + 1).cast("int"))
    said = v.raw("events").select(
        F.when(e % 6 == 5, e - 5).otherwise(e).alias("event_id"), r.alias("receipt_id"), ((r * 7 + (e % 11) * 13) % 997).alias("atom_id"), kind.alias("feedback_type"),
        F.when(e % 13 == 0, "zz").otherwise(F.concat(F.lit("a"), (r % 3).cast("string"))).alias("agent"), F.concat(F.lit("t"), (r % 5).cast("string")).alias("task_id"),
        F.when(e % 17 != 0, F.concat(F.lit("n"), e.cast("string"))).alias("note"), e.alias("raw_id"),
    )
    return said.union(said.filter("raw_id % 20 = 3")).drop("raw_id")


def _judged(v: Views):
    reports = _reports(v)
    return ledger.judged_feedback(reports, reports.limit(0), _heads(v), _exposures(v))


def _recorded(v: Views):
    empty = v.spark.createDataFrame([], "event_id long, receipt_id long, atom_id long, feedback_type string, agent string, task_id string, note string, recorded_at long, processed_at long")
    return ledger.add_feedback(empty, _judged(v), F.col("event_id") % 1000)


@query("m04_receipts", TERMS_SQL + """
, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM fts)
SELECT query_id AS receipt_id, doc_id AS atom_id, CAST(rank AS INTEGER) AS rank, round(score, 5) AS score, CASE WHEN rank <= 3 THEN 'body' ELSE 'handle' END AS delivery FROM r WHERE rank <= 32""")
def m04(v):
    hits = graph.top_by(_postings(v).score(_terms(v), ranking.bm25_fts(), top=40), 40)
    shown = hits.select("query_id", "doc_id", F.col("rank").alias("position"), "score", F.when(F.col("rank") <= 3, "body").otherwise("handle").alias("delivery"))
    return ledger.receipts(shown).withColumn("score", F.round("score", 5))


@query("m05_feedback", _SAID_SQL + " SELECT event_id, receipt_id, atom_id, feedback_type, agent, task_id, note, outcome FROM judged")
def m05(v):
    return _judged(v)


@query("st7_pending_feedback", _SAID_SQL + """
, batch AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY event_id % 1000, event_id) AS k FROM judged WHERE outcome = 'recorded') WHERE k <= 1000)
SELECT count(*) AS processed, (SELECT count(*) FROM (SELECT DISTINCT atom_id, agent, task_id FROM batch WHERE feedback_type = 'helpful' AND atom_id IN (SELECT id FROM atoms))) AS updated,
  count(*) FILTER (WHERE atom_id NOT IN (SELECT id FROM atoms)) AS missing FROM batch""")
def st7(v):
    return ledger.process_pending(durable(_recorded(v)), v.atoms, 5)[2]


@query("j24_scope_faults", _SAID_SQL + """
, c AS (SELECT min(event_id) AS feedback_id, atom_id, agent, task_id FROM reports WHERE feedback_type = 'helpful' GROUP BY ALL),
credits AS (SELECT CASE WHEN feedback_id % 10 = 2 THEN feedback_id + 1 ELSE feedback_id END AS feedback_id, atom_id, agent, task_id FROM c)
SELECT 'feedback_scope' AS "check", CAST(p.event_id AS VARCHAR) AS key FROM reports p LEFT JOIN heads h ON h.receipt_id = p.receipt_id WHERE h.agent IS DISTINCT FROM p.agent OR h.task_id IS DISTINCT FROM p.task_id
UNION ALL SELECT 'feedback_exposure', CAST(event_id AS VARCHAR) FROM reports p WHERE NOT EXISTS (SELECT 1 FROM exposures e WHERE e.receipt_id = p.receipt_id AND e.atom_id = p.atom_id)
UNION ALL SELECT 'credit_feedback', CAST(feedback_id AS VARCHAR) FROM credits c WHERE NOT EXISTS (SELECT 1 FROM reports p WHERE p.feedback_type = 'helpful' AND p.event_id = c.feedback_id AND p.atom_id = c.atom_id AND p.agent = c.agent AND p.task_id = c.task_id)""")
def j24(v):
    said = _reports(v)
    c = said.filter("feedback_type = 'helpful'").groupBy("atom_id", "agent", "task_id").agg(F.min("event_id").alias("feedback_id"))
    return ledger.scope_faults(said, _heads(v), _exposures(v), c.withColumn("feedback_id", F.when(F.col("feedback_id") % 10 == 2, F.col("feedback_id") + 1).otherwise(F.col("feedback_id"))))


@query("s15_key_faults", with_views("atoms", "provenance", "supersedes") + """
SELECT 'atoms: repeated keys' AS "check", count(*) AS n FROM (SELECT id FROM atoms GROUP BY id HAVING count(*) > 1)
UNION ALL SELECT 'atoms: null keys', count(*) FROM atoms WHERE id IS NULL
UNION ALL SELECT 'provenance.atom_id: not in atoms', count(*) FROM provenance WHERE atom_id NOT IN (SELECT id FROM atoms)
UNION ALL SELECT 'supersedes.src_atom: not in vectors', count(*) FROM supersedes WHERE src_atom NOT IN (SELECT vec_id FROM embeddings)""")
def s15_keys(v):
    tables = {"atoms": v.atoms, "provenance": v.provenance, "supersedes": v.supersedes, "vectors": v.embeddings}
    return ledger.key_faults(tables, {"atoms": ["id"]}, [("provenance", "atom_id", "atoms", "id"), ("supersedes", "src_atom", "vectors", "atom_id")])


# ---- reads, guards, emits, repairs --------------------------------------------------


@query("s17_point_reads", with_views("atoms", "provenance") + """
, ids AS (SELECT DISTINCT item_id * 31 AS id FROM benchmark)
SELECT i.id, a.id IS NOT NULL AS found, a.status, a.kind, (SELECT count(*) FROM provenance p WHERE p.atom_id = i.id AND i.id IN (SELECT id FROM atoms)) AS shown, false AS truncated FROM ids i LEFT JOIN atoms a ON a.id = i.id""")
def s17(v):
    ids = v.raw("benchmark").select((F.col("item_id") * 31).alias("id"))
    x = ledger.point_reads(ids, v.atoms, v.provenance)
    return x.select("id", "found", "status", "kind", F.coalesce(F.size("provenance"), F.lit(0)).cast("long").alias("shown"), "truncated")


_REF = "CASE WHEN doc_id % 11 = 0 THEN '/etc/x' WHEN doc_id % 13 = 0 THEN 'a//b' WHEN doc_id % 19 = 0 THEN 'a/../b' ELSE source || '/' || doc_id END"


@query("f31_refusals", f"""
SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'reserved source' WHEN {_REF} LIKE '/%' OR contains({_REF}, '//') OR contains({_REF}, '..') THEN 'escaping reference'
  WHEN length(text) > 32000 THEN 'body too long' WHEN trim(coalesce(text, '')) = '' THEN 'empty body' END AS reason FROM documents""")
def f31(v):
    d = v.raw("documents").select("doc_id", "text", "lang", F.when(F.col("doc_id") % 7 == 0, F.when(F.col("doc_id") % 2 == 0, "system").otherwise("campaign:x")).otherwise("explicit-emit").alias("src"), F.expr(_REF).alias("ref"))
    return d.select("doc_id", ledger.refusal("src", "ref", "lang", "text").alias("reason"))


@query("m12_emits", """
SELECT trim(text) || CASE WHEN trim(lang) <> '' THEN chr(10) || 'outcome: ' || trim(lang) ELSE '' END AS text, list_extract(['atom', 'atom', 'atom', 'narrative', 'snapshot'], CAST(doc_id % 6 + 1 AS INTEGER)) AS kind, source AS project, 1700000000 + doc_id AS created_at
FROM documents WHERE doc_id % 6 < 5 AND trim(text) <> '' AND length(text) < 30000""")
def m12(v):
    names = F.array(*map(F.lit, ("atom", "discovery", "failure", "narrative", "snapshot", "other")))
    r = v.raw("documents").filter("trim(text) <> '' AND length(text) < 30000").select(F.col("doc_id").alias("request_id"), F.element_at(names, (F.col("doc_id") % 6 + 1).cast("int")).alias("emit"), F.lit("me").alias("agent"), F.col("source").alias("project"), F.lit("explicit-emit").alias("source"), F.lit("r").alias("source_ref"), (F.lit(1700000000).cast("long") + F.col("doc_id")).alias("recorded_at"), "text", F.col("lang").alias("outcome"), F.lit("").alias("principle"), F.lit(None).cast("string").alias("shape"))
    return ledger.emits(r)[0].select("text", "kind", "project", "created_at")


@query("m12_pins", with_views("atoms", "facets") + """
, old AS (SELECT atom_id, value FROM facets WHERE key = 'pin'),
new AS (SELECT item_id * 3 AS atom_id, 'me' AS value FROM benchmark WHERE item_id * 3 IN (SELECT id FROM atoms WHERE status = 'live'))
SELECT atom_id, value FROM (SELECT * FROM old UNION SELECT * FROM new) WHERE NOT (value = 'me' AND atom_id % 2 = 0)""")
def m12_pins(v):
    pins = v.raw("benchmark").select((F.col("item_id") * 3).alias("atom_id"), F.lit("me").alias("value"))
    now = ledger.unpin(ledger.pin(v.facets.filter("key = 'pin'"), v.atoms, pins), pins.filter("atom_id % 2 = 0"))
    return now.select("atom_id", "value")


@query("p06_filtered_kinds", _TWO_LISTS + """
, f AS (SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM (SELECT * FROM l30 UNION ALL SELECT * FROM d30) GROUP BY query_id, doc_id)
SELECT query_id, doc_id, score FROM f JOIN atoms ON id = doc_id AND kind IN ('atom', 'narrative') JOIN documents d ON d.doc_id = f.doc_id AND d.lang = 'en'""".replace("SELECT query_id, doc_id, score FROM f", "SELECT f.query_id, f.doc_id, f.score FROM f").replace("id = doc_id", "id = f.doc_id"))
def p06(v):
    a, b = _two(v)
    fused = ranking.rrf([(a, 1.0), (b, 1.0)]).select("query_id", "doc_id", F.round("score", 9).alias("score"))
    return ledger.filtered_kinds(fused, v.atoms, v.provenance, ("atom", "narrative"), "en").select("query_id", "doc_id", "score")


@query("j23_rewritten_refs", """
SELECT doc_id AS atom_id, CASE WHEN doc_id % 4 = 0 THEN CASE WHEN doc_id % 3 = 0 THEN 'file/' || doc_id ELSE 'row:' || doc_id END ELSE source || '/' || doc_id END AS source_ref FROM documents""")
def j23(v):
    p = v.provenance.withColumn("source_ref", F.when(F.col("atom_id") % 4 == 0, F.concat(F.lit("row:"), F.col("atom_id").cast("string"))).otherwise(F.col("source_ref")))
    old = v.raw("documents").filter("doc_id % 3 = 0").select(F.col("doc_id").alias("row_id"), F.concat(F.lit("file/"), F.col("doc_id").cast("string")).alias("ref"))
    return ledger.rewritten_refs(p, old).select("atom_id", "source_ref")


@query("m09_backfilled_projects", "SELECT doc_id AS id, source AS project FROM documents")
def m09(v):
    bare = v.atoms.withColumn("project", F.when(F.col("id") % 3 != 0, F.col("project")))
    return ledger.backfilled_projects(bare, v.provenance).select("id", "project")


@query("t06_campaign_sample", with_views("supersedes") + """
SELECT src_atom, dst_atom, md5('7|' || src_atom || '|' || dst_atom) AS digest FROM supersedes WHERE src_atom % 2 = 0 ORDER BY digest LIMIT 20""")
def t06(v):
    e = v.supersedes.withColumn("campaign", F.when(F.col("src_atom") % 2 == 0, "even").otherwise("odd"))
    return ledger.campaign_sample(e, "even", 20, 7).select("src_atom", "dst_atom", "digest")


@query("k04_shadow_lines", _TWO_LISTS + """
, a AS (SELECT query_id, doc_id, rank AS ra FROM l30 WHERE rank <= 10), b AS (SELECT query_id, doc_id, rank AS rb FROM d30 WHERE rank <= 10)
SELECT query_id, count(ra) AS served, count(rb) AS shadow, count(*) FILTER (WHERE ra IS NOT NULL AND rb IS NOT NULL) AS shared, coalesce(max(CASE WHEN ra = 1 THEN rb = 1 END), false) AS same_first
FROM a FULL JOIN b USING (query_id, doc_id) GROUP BY query_id""")
def k04(v):
    a, b = _two(v)
    return ledger.shadow_lines(a, b)


@query("k07_event_feed", "SELECT event_id AS seq, 'id: ' || event_id || chr(10) || 'data: ' || event_type || chr(10) || chr(10) AS line FROM events ORDER BY event_id DESC LIMIT 256")
def k07(v):
    return ledger.event_feed(v.raw("events").select(F.col("event_id").alias("seq"), F.col("event_type").alias("payload")))


# ---- saved and grown graphs, corrections, enrichment -------------------------------


@query("k01_saved_graph", ORACLES["a04_graph_stats"])
def k01(v):
    path = f"{shared_folder(v.spark)}"
    persist.save_graph(_graph(v), path)
    return persist.load_graph(v.spark, path).stats()


@query("m10_reloaded_graph", ORACLES["r01_graph_query"])
def m10(v):
    path = f"{shared_folder(v.spark)}"
    persist.save_graph(_graph(v), path)
    return persist.load_graph(v.spark, path).query(v.queries, 10).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query("s03_grown_graph", ORACLES["a02_edge_weights"])
def s03(v):
    mentions = durable(v.mentions)
    g = persist.grown(mentions.filter("doc_id % 3 <> 0").union(mentions.filter("doc_id % 3 = 0").withColumn("label", F.lit("stale"))), mentions.filter("doc_id % 3 = 0"))
    return g.edges.select("doc_id", "etype", "label", F.round("spec", 6).alias("spec"), F.round("weight", 6).alias("weight"))


#: Corrections with long chains, forks and merges, in blocks of sixteen atoms.
_REVISIONS_SQL = """WITH RECURSIVE ids AS (SELECT doc_id AS id, doc_id % 16 AS k FROM documents),
e AS (SELECT new, old FROM (SELECT id AS new, id - 1 AS old FROM ids WHERE k BETWEEN 1 AND 7 UNION ALL SELECT id, id - 8 FROM ids WHERE k BETWEEN 8 AND 11 UNION ALL SELECT id, id - 1 FROM ids WHERE k = 12 UNION ALL SELECT id, id - 2 FROM ids WHERE k = 12) WHERE old IN (SELECT id FROM ids)),
"""


def _revisions(v: Views):
    d = v.raw("documents").select("doc_id", (F.col("doc_id") % 16).alias("k"))
    step = lambda test, n: d.filter(test).select(F.col("doc_id").alias("src_atom"), (F.col("doc_id") - n).alias("dst_atom"))
    every = step("k BETWEEN 1 AND 7", 1).union(step("k BETWEEN 8 AND 11", 8)).union(step("k = 12", 1)).union(step("k = 12", 2))
    return every.join(d.select(F.col("doc_id").alias("dst_atom")), "dst_atom", "left_semi").select("src_atom", "dst_atom")


@query("j13_history", _REVISIONS_SQL + """both_ways AS (SELECT new AS a, old AS b FROM e UNION SELECT old, new FROM e),
reach AS (SELECT a AS id, a AS x FROM both_ways UNION SELECT r.id, w.b FROM reach r JOIN both_ways w ON w.a = r.x),
roots AS (SELECT id, min(x) AS root FROM reach GROUP BY id),
walk AS (SELECT old AS id, 0 AS level FROM e WHERE old NOT IN (SELECT new FROM e) UNION SELECT e.new, level + 1 FROM walk JOIN e ON e.old = walk.id),
levels AS (SELECT id, max(level) AS level FROM walk GROUP BY id)
SELECT r.id, root, CAST(row_number() OVER (PARTITION BY root ORDER BY level NULLS LAST, r.id) - 1 AS INTEGER) AS depth FROM roots r LEFT JOIN levels l ON l.id = r.id""")
def j13(v):
    return trust.components_in_order(_revisions(v))


@query("j12_long_chains", _REVISIONS_SQL + """step AS (SELECT old AS id, min(new) AS nxt, count(DISTINCT new) > 1 AS fork FROM e GROUP BY old),
walk AS (SELECT id, nxt AS x, fork FROM step UNION ALL SELECT w.id, s.nxt, w.fork OR s.fork FROM walk w JOIN step s ON s.id = w.x)
SELECT id, x AS "end", fork AS forked FROM walk WHERE x NOT IN (SELECT id FROM step)""")
def j12(v):
    return trust.chain_ends(_revisions(v)).select("id", "end", "forked")


@query("r23_relations", FACET_SQL + """
, chunks AS (SELECT id FROM atoms WHERE status = 'live' AND kind = 'document_chunk'),
stored AS (SELECT d.doc_id AS q, d.doc_id + 5 AS r, (d.doc_id % 10) / 10.0 AS w FROM documents d WHERE d.doc_id % 7 = 0 UNION ALL SELECT doc_id, doc_id + 6, 0.55 FROM documents WHERE doc_id % 7 = 0),
kept AS (SELECT s.* FROM stored s JOIN chunks c ON c.id = s.q JOIN atoms a ON a.id = s.r AND a.status = 'live'),
back AS (SELECT f.atom_id AS q, g.atom_id AS r, round(sum(1.0 / n), 9) AS w FROM entity_facets f JOIN chunks c ON c.id = f.atom_id JOIN deg ON deg.value = f.value AND n <= 30 JOIN entity_facets g ON g.value = f.value AND g.atom_id <> f.atom_id
  JOIN atoms a ON a.id = g.atom_id AND a.status = 'live' AND a.kind IN ('atom', 'narrative', 'snapshot') WHERE f.atom_id NOT IN (SELECT q FROM kept) GROUP BY ALL),
every AS (SELECT *, true AS stored FROM kept UNION ALL SELECT *, false FROM back)
SELECT q AS query_id, r AS doc_id, round(w, 6) AS weight, CAST(rank AS INTEGER) AS rank, stored FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY w DESC, r) AS rank FROM every) WHERE rank <= 2""")
def r23(v):
    chunks = v.atoms.filter("status = 'live' AND kind = 'document_chunk'").select(F.col("id").alias("query_id"))
    memory = v.atoms.filter("status = 'live' AND kind IN ('atom', 'narrative', 'snapshot')").select(F.col("id").alias("doc_id"))
    facets = v.entity_facets.select("atom_id", "value").join(_degree(v, 30), "value")
    found = enrich.relations(chunks, v.relates, enrich.related(chunks, facets, memory, 30, 2), v.atoms)
    return found.select("query_id", "doc_id", F.round("weight", 6).alias("weight"), "rank", "stored")


@query("r23_lines")
def r23_lines(v):
    return enrich.lines(r23(v), v.atoms)


@query("f21_located_chunks")
def f21(v):
    d = v.raw("documents").select("doc_id", "text", F.posexplode(python_text.chunks(F.col("text"))).alias("chunk", "part"))
    return d.select("doc_id", "chunk", python_text.located(F.col("text"), F.col("part")).alias("at")).select("doc_id", "chunk", "at.first", "at.last")


# ---- more signals and counters ------------------------------------------------------


@query("r18_auxiliary_list", _TWO_LISTS + """
, aux AS (SELECT query_id, atom_id AS doc_id, round(list_inner_product(q[1:16], (embedding::DOUBLE[])[1:16]), 12) AS score FROM qv CROSS JOIN vectors),
x30 AS (SELECT query_id, doc_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM aux) WHERE rank <= 30)
SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM (SELECT query_id, doc_id, rank FROM l30 UNION ALL SELECT query_id, doc_id, rank FROM d30 UNION ALL SELECT * FROM x30) GROUP BY query_id, doc_id""")
def r18(v):
    a, b = _two(v)
    head = lambda c: F.slice(c, 1, 16)
    aux = ranking.dense_top(_asked(v).filter("q IS NOT NULL").select("query_id", head("q").alias("q")), _vectors(v).select("doc_id", head("embedding").alias("embedding")), 30)
    return ranking.rrf([(a, 1.0), (b, 1.0), (aux, 1.0)]).select("query_id", "doc_id", F.round("score", 9).alias("score"))


@query("r17_index_choice", with_views("atoms", "vectors") + """
SELECT CASE WHEN kind = 'document_chunk' THEN 1 ELSE 0 END AS class_pos, count(*) AS n, CASE WHEN count(*) < 300 OR (kind <> 'document_chunk' AND count(*) <= 400) THEN 'flat' ELSE 'lists' END AS choice
FROM (SELECT CASE WHEN kind = 'document_chunk' THEN kind ELSE 'memory' END AS kind FROM atoms JOIN vectors ON atom_id = id WHERE status = 'live') GROUP BY kind""")
def r17(v):
    n = store.scoped(v.atoms).join(v.embeddings.select(F.col("atom_id").alias("id")), "id").groupBy(store.kind_class().alias("class_pos")).agg(F.count("*").alias("n"))
    rows = [(r["class_pos"], r["n"], persist.select_index(r["n"], r["class_pos"] == 0, 400, 300)) for r in n.collect()]  # a row per class
    return v.spark.createDataFrame(rows, "class_pos int, n long, choice string")


@query("a22_entity_maximum", GRAPH_SQL + " SELECT query_id, doc_id, round(max(seed * 0.6 * weight), 6) AS score, count(DISTINCT seeds.label) AS entities FROM seeds JOIN edges ON seeds.etype = edges.etype AND seeds.label = edges.label WHERE doc_id <> query_id GROUP BY query_id, doc_id")
def a22(v):
    g = _graph(v)
    seeds = g.seeds(v.queries.select("query_id", F.explode(tx.query_words("query_text")).alias("word"))).filter("seed >= 0.15")
    hits = seeds.join(g.edges, ["etype", "label"]).filter("doc_id <> query_id")
    return hits.groupBy("query_id", "doc_id").agg(F.round(F.max(F.col("seed") * 0.6 * F.col("weight")), 6).alias("score"), F.countDistinct("label").alias("entities"))


@query("a24_counters", with_views("atoms", "provenance") + " SELECT kind, source, count(*) AS n, count(*) FILTER (WHERE status = 'live') AS live FROM atoms JOIN provenance ON atom_id = id GROUP BY kind, source")
def a24(v):
    return v.atoms.join(v.provenance.select(F.col("atom_id").alias("id"), "source"), "id").groupBy("kind", "source").agg(F.count("*").alias("n"), F.count(F.when(F.col("status") == "live", 1)).alias("live"))


@query("f25_vector_blobs", "SELECT vec_id, CAST(4 * len(embedding) AS INTEGER) AS n_bytes, round(list_sum(embedding::DOUBLE[]), 5) AS total FROM embeddings")
def f25(v):
    blob = v.raw("embeddings").select("vec_id", python_text.vec_to_blob(F.col("embedding")).alias("b"))
    back = blob.select("vec_id", F.length("b").alias("n_bytes"), python_text.blob_to_vec(F.col("b")).alias("e"))
    return back.select("vec_id", "n_bytes", F.round(F.aggregate("e", F.lit(0.0), lambda s, x: s + x.cast("double")), 5).alias("total"))


_RIGHT = "SELECT b.item_id AS query_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)"


@query("r31_gate", LEXICAL_SQL + f"""
, plus AS (SELECT query_id, doc_id, round(sum(times * ln((n + 1) / df) * (1 + tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)))), 9) AS score FROM matched GROUP BY ALL),
pr AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM plus),
dr AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM dense),
rel AS ({_RIGHT}),
m AS (SELECT 'r10' AS name, round(avg(CASE WHEN EXISTS (SELECT 1 FROM dr JOIN rel ON rel.query_id = dr.query_id AND rel.doc_id = dr.doc_id WHERE dr.query_id = item_id AND rank <= 10) THEN 1.0 ELSE 0 END), 6) AS value,
  round(avg(CASE WHEN EXISTS (SELECT 1 FROM pr JOIN rel ON rel.query_id = pr.query_id AND rel.doc_id = pr.doc_id WHERE pr.query_id = item_id AND rank <= 10) THEN 1.0 ELSE 0 END), 6) AS base FROM benchmark)
SELECT name, value, base, value >= base - 0.02 AS ok FROM m""")
def r31(v):
    postings, terms = _lexical(v)
    plus = graph.top_by(postings.score(terms, ranking.bm25_plus(), top=20), 20)
    dense = ranking.dense_top(_asked(v).filter("q IS NOT NULL").select("query_id", "q"), _vectors(v), 20)
    docs = v.raw("documents").select("doc_id", "text")

    def measured(hits):
        right = hits.join(docs, "doc_id").join(v.queries, "query_id").filter(F.expr("contains(text, query_text)")).select("query_id", "doc_id")
        q = evaluation.quality(v.queries.select("query_id"), hits.select("query_id", "doc_id", "rank"), right)
        return q.select(F.lit("r10").alias("name"), F.col("r10").alias("value"))

    return ledger.gate(measured(dense), measured(plus))
