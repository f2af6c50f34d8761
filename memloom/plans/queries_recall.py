"""Queries over retrieval signals, fusion, trust and the whole recall."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.functions import entities
from memloom.functions import text as tx
from memloom.operators import graph, models, ranking, recall, store, trust
from memloom.plans.queries_text import _GIST_SQL
from memloom.plans.registry import query
from memloom.plans.views import NOW, Views, with_views
from memloom.sources.tables import durable

#: Postings and query terms as SQL; lower-case words, statistics over all documents.
TERMS_SQL = with_views("atoms", "vectors") + r"""
, toks AS (SELECT doc_id, lower(unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+'))) AS term FROM documents),
lens AS (SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS dl FROM documents),
post AS (SELECT term, doc_id, count(*) AS tf FROM toks GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
tot AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl FROM lens),
qt AS (SELECT query_id, term, count(*) AS times FROM (SELECT item_id AS query_id, lower(unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+')[1:64])) AS term FROM benchmark) GROUP BY ALL),
matched AS (SELECT q.query_id, p.doc_id, q.term, times, tf, df, n, dl, avgdl FROM qt q JOIN post p ON p.term = q.term JOIN df ON df.term = q.term JOIN lens l ON l.doc_id = p.doc_id CROSS JOIN tot),
fts AS (SELECT query_id, doc_id, round(sum(times * greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 9) AS score FROM matched GROUP BY ALL),
live AS (SELECT id, CASE WHEN kind = 'document_chunk' THEN 1 ELSE 0 END AS class_pos FROM atoms WHERE status = 'live'),
qv AS (SELECT item_id AS query_id, embedding::DOUBLE[] AS q FROM benchmark JOIN embeddings ON vec_id = item_id),
dense AS (SELECT query_id, atom_id AS doc_id, list_inner_product(q, embedding::DOUBLE[]) AS score FROM qv CROSS JOIN vectors)"""


#: The same over identifiers kept whole, with all terms of the queries.
_LEXICAL = r"regexp_extract_all(lower(text), '0x[0-9a-f]+|[\p{L}\p{N}_]+(?:[-.][\p{L}\p{N}_]+)*')"
LEXICAL_SQL = TERMS_SQL.replace(r"lower(unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+')))", f"unnest({_LEXICAL})").replace(r"len(regexp_extract_all(text, '[\p{L}\p{N}_]+'))", f"len({_LEXICAL})").replace(r"lower(unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+')[1:64]))", f"unnest({_LEXICAL})")


def _lexical(v: Views) -> tuple[ranking.Postings, DataFrame]:
    return ranking.Postings(v.raw("documents").select("doc_id", "text"), tx.lexical_tokens("text")), v.queries.select("query_id", F.explode(tx.lexical_tokens("query_text")).alias("term"))


def _postings(v: Views) -> ranking.Postings:
    return ranking.Postings(v.raw("documents").select("doc_id", "text"), F.transform(tx.words_of("text"), lambda t: F.lower(t)))


def _terms(v: Views):
    return v.queries.select("query_id", F.posexplode(F.transform(tx.fts_terms("query_text"), lambda t: F.lower(t))).alias("pos", "term"))


def _vectors(v: Views):
    return v.embeddings.select(F.col("atom_id").alias("doc_id"), "embedding")


def _asked(v: Views):
    return v.queries.join(v.embeddings.select(F.col("atom_id").alias("query_id"), F.col("embedding").alias("q")), "query_id", "left")


def _memory(v: Views) -> recall.Memory:
    return recall.Memory(v.atoms, v.provenance, v.facets, v.supersedes, _vectors(v))


def _labels(v: Views):
    return entities.native_mentions(v.raw("benchmark"), "item_id").select(F.col("doc_id").alias("query_id"), "label").distinct()


@query("a09_document_frequency", TERMS_SQL + " SELECT term, df FROM df")
def a09(v):
    return _postings(v).df


@query("r07_bm25_plus", LEXICAL_SQL + """
, s AS (SELECT query_id, doc_id, round(sum(times * ln((n + 1) / df) * (1 + tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)))), 9) AS score FROM matched GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT query_id, doc_id, round(score, 5) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10""")
def r07(v):
    postings, terms = _lexical(v)
    s = postings.score(terms, ranking.bm25_plus(), top=10).filter("score > 0")
    return graph.top_by(s, 10).select("query_id", "doc_id", F.round("score", 5).alias("score"), "rank")


@query("r07_bm25_okapi", LEXICAL_SQL + """
, raw AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM df CROSS JOIN tot),
idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
s AS (SELECT query_id, doc_id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) AS score FROM matched m JOIN idf ON idf.term = m.term GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s)
SELECT query_id, doc_id, round(score, 5) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10""")
def r07b(v):
    return graph.top_by(ranking.bm25_okapi(*_lexical(v)), 10).select("query_id", "doc_id", F.round("score", 5).alias("score"), "rank")


@query("r14_fts_signal", TERMS_SQL + """
, r AS (SELECT query_id, doc_id, class_pos, score, row_number() OVER (PARTITION BY query_id, class_pos ORDER BY score DESC, doc_id) AS rank FROM fts JOIN live ON id = doc_id)
SELECT query_id, doc_id, class_pos, round(score, 5) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 20""")
def r14(v):
    live = v.atoms.filter("status = 'live'").select(F.col("id").alias("doc_id"), store.kind_class().alias("class_pos"))
    s = _postings(v).score(_terms(v), ranking.bm25_fts(), live.select("doc_id")).join(live, "doc_id")
    return graph.top_by(s, 20, by=("query_id", "class_pos")).select("query_id", "doc_id", "class_pos", F.round("score", 5).alias("score"), "rank")


@query("p12_pruned_terms", TERMS_SQL + r"""
, t AS (SELECT query_id, k - 1 AS pos, lower(ws[k]) AS term FROM (SELECT query_id, ws, unnest(range(1, len(ws) + 1)) AS k FROM (SELECT item_id AS query_id, regexp_extract_all(text, '[\p{L}\p{N}_]+')[1:64] AS ws FROM benchmark))),
m AS (SELECT t.*, coalesce(df, 0) AS df, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(df, 0), pos) AS rare FROM t LEFT JOIN df ON df.term = t.term)
SELECT query_id, CAST(pos AS INTEGER) AS pos, term FROM m WHERE df <= 0.01 * (SELECT count(*) FROM live) OR rare = 1""")
def p12(v):
    live = v.atoms.filter("status = 'live'").agg(F.count("*").alias("live"))
    return ranking.pruned_terms(_terms(v), _postings(v).df, live, least=0)


@query("r09_dense_top", TERMS_SQL + """
, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM dense)
SELECT query_id, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10""")
def r09(v):
    q = _asked(v).filter("q IS NOT NULL").select("query_id", "q")
    return ranking.dense_top(q, _vectors(v), 10).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query("r15_dense_live", TERMS_SQL + """
, r AS (SELECT d.*, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM dense d JOIN live ON id = doc_id)
SELECT query_id, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10""")
def r15(v):
    live = v.atoms.filter("status = 'live'").select(F.col("id").alias("doc_id"))
    q = _asked(v).filter("q IS NOT NULL").select("query_id", "q")
    return ranking.dense_top(q, _vectors(v).join(live, "doc_id", "left_semi"), 10).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query("j03_candidate_dense", TERMS_SQL + """
, cand AS (SELECT query_id, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM fts) WHERE rank <= 50),
r AS (SELECT d.query_id, d.doc_id, d.score, row_number() OVER (PARTITION BY d.query_id ORDER BY d.score DESC, d.doc_id) AS rank FROM dense d JOIN cand c ON c.query_id = d.query_id AND c.doc_id = d.doc_id)
SELECT query_id, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5""")
def j03(v):
    cand = graph.top_by(_postings(v).score(_terms(v), ranking.bm25_fts(), top=50), 50).select("query_id", "doc_id")
    x = cand.join(_vectors(v), "doc_id").join(_asked(v).filter("q IS NOT NULL").select("query_id", "q"), "query_id")
    return graph.top_by(x.select("query_id", "doc_id", ranking.dot(F.col("q"), F.col("embedding")).alias("score")), 5).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


_TWO_LISTS = TERMS_SQL + """
, lr AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM fts),
dr AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM dense),
l30 AS (SELECT * FROM lr WHERE rank <= 30), d30 AS (SELECT * FROM dr WHERE rank <= 30)"""


def _two(v: Views, n: int = 30):
    lexical = graph.top_by(_postings(v).score(_terms(v), ranking.bm25_fts(), top=n), n)
    dense = ranking.dense_top(_asked(v).filter("q IS NOT NULL").select("query_id", "q"), _vectors(v), n)
    return lexical, dense


@query("a06_rrf", _TWO_LISTS + " SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM (SELECT * FROM l30 UNION ALL SELECT * FROM d30) GROUP BY query_id, doc_id")
def a06(v):
    a, b = _two(v)
    return ranking.rrf([(a, 1.0), (b, 1.0)]).select("query_id", "doc_id", F.round("score", 9).alias("score"))


@query("a05_rrf_normalized", _TWO_LISTS + " SELECT query_id, doc_id, round(sum(w / (60 + rank)), 9) AS score FROM (SELECT *, 0.7 AS w FROM d30 UNION ALL SELECT *, 0.3 AS w FROM l30) GROUP BY query_id, doc_id")
def a05(v):
    a, b = _two(v)
    return ranking.rrf([(b, 1.4), (a, 0.6)], normalized=True).select("query_id", "doc_id", F.round("score", 9).alias("score"))


@query("j04_agreement_merge", _TWO_LISTS + """
 SELECT query_id, doc_id, round(CASE WHEN a.rank IS NOT NULL AND b.rank IS NOT NULL THEN 100.0 / (least(a.rank, b.rank) - 1 + 1) + 50 WHEN a.rank IS NOT NULL THEN 30.0 / a.rank ELSE 50.0 / b.rank END, 6) AS score,
  CASE WHEN a.rank IS NOT NULL AND b.rank IS NOT NULL THEN 'both' WHEN a.rank IS NOT NULL THEN 'graph' ELSE 'dense' END AS source
FROM l30 a FULL JOIN d30 b USING (query_id, doc_id)""")
def j04(v):
    a, b = _two(v)
    return ranking.agreement_merge(a, b).select("query_id", "doc_id", F.round("score", 6).alias("score"), "source")


@query("u01_union_of_hits", _TWO_LISTS + " SELECT query_id, doc_id FROM l30 UNION SELECT query_id, doc_id FROM d30")
def u01(v):
    a, b = _two(v)
    return a.select("query_id", "doc_id").union(b.select("query_id", "doc_id")).distinct()


@query("u02_intersection_of_hits", _TWO_LISTS + " SELECT query_id, doc_id FROM l30 INTERSECT SELECT query_id, doc_id FROM d30")
def u02(v):
    a, b = _two(v)
    return a.select("query_id", "doc_id").intersect(b.select("query_id", "doc_id"))


@query("u04_symmetric_difference", _TWO_LISTS + " (SELECT query_id, doc_id FROM l30 EXCEPT SELECT query_id, doc_id FROM d30) UNION ALL (SELECT query_id, doc_id FROM d30 EXCEPT SELECT query_id, doc_id FROM l30)")
def u04(v):
    a, b = (x.select("query_id", "doc_id") for x in _two(v))
    return a.subtract(b).union(b.subtract(a))


@query("w05_top_gap", TERMS_SQL + """
, r AS (SELECT query_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, lead(score) OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS nxt FROM dense)
SELECT query_id, round(score - nxt, 6) AS gap FROM r WHERE rank = 1""")
def w05(v):
    two = ranking.dense_top(_asked(v).filter("q IS NOT NULL").select("query_id", "q"), _vectors(v), 2)
    return two.groupBy("query_id").agg(F.round(F.max("score") - F.min("score"), 6).alias("gap"))


#: The ranked list of a recall before trust, as SQL.
RECALL_SQL = TERMS_SQL + """
, cand AS (
  SELECT *, row_number() OVER (PARTITION BY query_id, signal ORDER BY class_pos, score DESC, doc_id) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id, signal, class_pos ORDER BY score DESC, doc_id) AS own FROM (
      SELECT query_id, doc_id, score, 'bm25' AS signal, class_pos FROM fts JOIN live ON id = doc_id
      UNION ALL SELECT query_id, doc_id, score, 'dense', class_pos FROM dense JOIN live ON id = doc_id)) WHERE own <= 200),
fused AS (SELECT query_id, doc_id, min(class_pos) AS class_pos, round(sum(1.0 / (60 + rank)), 12) AS score, string_agg(DISTINCT signal, ',' ORDER BY signal) AS tags FROM cand GROUP BY query_id, doc_id),
scored AS (SELECT f.query_id, f.doc_id, f.class_pos, f.tags, round(f.score * (1 + least(importance, 1.0)) * (0.5 + 0.5 * exp(-greatest(0.0, (1740000000 - coalesce(occurred_at, created_at))::DOUBLE) / 7776000.0)), 12) AS score FROM fused f JOIN atoms a ON a.id = f.doc_id),
turns AS (SELECT *, row_number() OVER (PARTITION BY query_id, class_pos ORDER BY score DESC, doc_id) AS turn FROM scored),
places AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY turn, class_pos) AS place FROM turns),
ordered AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN place <= 64 THEN place ELSE 65 END, score DESC, doc_id) AS position FROM places)"""


def _candidates(v: Views):
    req = recall.Request(tier="L3", first_terms=64)
    hits = durable(recall.signals(_memory(v), _asked(v), req))
    tags = hits.groupBy("query_id", "doc_id").agg(F.sort_array(F.collect_set("signal")).alias("tags"), F.min("class_pos").alias("class_pos"))
    fused = ranking.rrf([(hits.filter("signal = 'bm25'"), 1.0), (hits.filter("signal = 'dense'"), 1.0)]).drop("first")
    return ranking.priors(fused, v.atoms, NOW).join(tags, ["query_id", "doc_id"])


@query("w02_class_ranks", RECALL_SQL + " SELECT query_id, doc_id, signal, class_pos, CAST(rank AS INTEGER) AS rank FROM cand WHERE rank <= 40")
def w02(v):
    return recall.signals(_memory(v), _asked(v), recall.Request(tier="L3", first_terms=64)).filter("rank <= 40").select("query_id", "doc_id", "signal", "class_pos", "rank")


@query("r20_priors", RECALL_SQL + " SELECT query_id, doc_id, round(score, 9) AS score, tags FROM scored")
def r20(v):
    return _candidates(v).select("query_id", "doc_id", tx.rounded("score", 9).alias("score"), F.array_join("tags", ",").alias("tags"))


@query("w03_interleave", RECALL_SQL + " SELECT query_id, doc_id, class_pos, CAST(position AS INTEGER) AS position FROM ordered WHERE position <= 30")
def w03(v):
    return ranking.interleave(_candidates(v)).filter("position <= 30").select("query_id", "doc_id", "class_pos", "position")


@query("r21_trust", RECALL_SQL + """
, gaps AS (SELECT query_id, max(score) FILTER (WHERE position = 1) - max(score) FILTER (WHERE position = 2) AS gap FROM ordered GROUP BY query_id),
parts AS (SELECT o.*, kind, CASE WHEN contains(tags, 'bm25') AND contains(tags, 'dense') THEN 0.9 ELSE 0.5 END AS agree,
  CASE WHEN position > 1 THEN 0.5 WHEN gap IS NULL THEN 1.0 ELSE greatest(0.5, 1 - exp(-greatest(0.0, gap) / 1.5)) END AS lead,
  0.5 + 0.5 * exp(-greatest(0.0, (1740000000 - coalesce(occurred_at, created_at))::DOUBLE) / (180 * 86400.0)) AS fresh
  FROM ordered o JOIN atoms a ON a.id = o.doc_id JOIN gaps g ON g.query_id = o.query_id),
judged AS (SELECT query_id, doc_id, position, kind, tags, least(1.0, 0.5 * agree + 0.3 * lead + 0.2 * fresh) AS c FROM parts)
SELECT query_id, doc_id, CAST(position AS INTEGER) AS position, round(CASE WHEN kind = 'document_chunk' AND tags IN ('bm25', 'dense') THEN least(c, 0.4) ELSE c END, 6) AS confidence,
  CASE WHEN kind = 'document_chunk' AND tags IN ('bm25', 'dense') THEN least(c, 0.4) ELSE c END >= 0.6 AS should_trust
FROM judged WHERE position <= 30""")
def r21(v):
    ordered = durable(ranking.interleave(_candidates(v)).withColumn("signals", F.col("tags")))
    judged = trust.assess(ordered.select("query_id", "doc_id", "score", "position", "signals"), v.atoms, v.provenance, trust.chain_ends(v.supersedes), NOW)
    return judged.filter("position <= 30").select("query_id", "doc_id", "position", F.round("confidence", 6).alias("confidence"), "should_trust")


def _recalled(v: Views, **more):
    return recall.recall(_memory(v), _asked(v), _labels(v), NOW, recall.Request(**more))


#: The whole recall of memory kinds, as SQL: signals, fusion, facets, priors, trust.
_WHOLE_SQL = TERMS_SQL.replace(with_views("atoms", "vectors"), with_views("atoms", "vectors", "entity_facets")) + ", labels AS (SELECT DISTINCT item_id AS query_id, label FROM (" + entities.MENTIONS_SQL.replace("documents", "benchmark").replace("doc_id", "item_id") + """)),
hits AS (SELECT query_id, doc_id, signal, row_number() OVER (PARTITION BY query_id, signal ORDER BY score DESC, doc_id) AS rank FROM (
  SELECT query_id, doc_id, score, 'bm25' AS signal FROM fts JOIN live ON id = doc_id WHERE class_pos = 0 UNION ALL SELECT query_id, doc_id, score, 'dense' FROM dense JOIN live ON id = doc_id WHERE class_pos = 0)),
fused AS (SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)), 12) AS score, bool_or(signal = 'bm25') AS kw, bool_or(signal = 'dense') AS sem FROM hits WHERE rank <= 200 GROUP BY query_id, doc_id),
met AS (SELECT f.*, EXISTS (SELECT 1 FROM entity_facets e JOIN labels l ON l.label = e.value WHERE e.atom_id = f.doc_id AND l.query_id = f.query_id) AS facet FROM fused f),
scored AS (SELECT m.*, round((CASE WHEN facet THEN m.score * 1.15 ELSE m.score END) * (1 + least(importance, 1.0)) * (0.5 + 0.5 * exp(-greatest(0.0, (1740000000 - coalesce(occurred_at, created_at))::DOUBLE) / 7776000.0)), 12) AS final,
  0.5 + 0.5 * exp(-greatest(0.0, (1740000000 - coalesce(occurred_at, created_at))::DOUBLE) / (180 * 86400.0)) AS fresh, a.project, a.text FROM met m JOIN atoms a ON a.id = m.doc_id),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final DESC, doc_id) AS position FROM scored),
gaps AS (SELECT query_id, max(final) FILTER (WHERE position = 1) - max(final) FILTER (WHERE position = 2) AS gap FROM placed GROUP BY query_id),
led AS (SELECT p.*, least(1.0, 0.5 + CASE WHEN kw AND sem THEN 0.4 ELSE 0 END + CASE WHEN facet THEN 0.1 ELSE 0 END) AS agree,
  CASE WHEN position > 1 THEN 0.5 WHEN gap IS NULL THEN 1.0 ELSE greatest(0.5, 1 - exp(-greatest(0.0, gap) / 1.5)) END AS lead FROM placed p JOIN gaps g ON g.query_id = p.query_id),
judged AS (SELECT *, greatest(0.0, least(1.0, 0.5 * agree + 0.3 * lead + 0.2 * fresh)) AS confidence,
  concat_ws(', ', CASE WHEN kw AND sem THEN 'both signals agree' WHEN kw THEN 'keyword signal only' ELSE 'semantic signal only' END, CASE WHEN facet THEN 'facet match' END,
    CASE WHEN position = 1 AND lead >= 0.75 THEN 'decisive gap' WHEN position = 1 AND lead <= 0.5 THEN 'tight gap' END, CASE WHEN fresh >= 0.9 THEN 'recent' WHEN fresh <= 0.6 THEN 'aged' END) AS why FROM led WHERE position <= 10)"""


#: The same with all terms of the queries.
_ALL_TERMS_SQL = _WHOLE_SQL.replace("[1:64]", "")


@query("r24_recall", _ALL_TERMS_SQL + " SELECT query_id, doc_id, CAST(position AS INTEGER) AS position, round(confidence, 6) AS confidence, why, confidence >= 0.6 AS should_trust FROM judged")
def r24(v):
    return _recalled(v).select("query_id", "doc_id", "position", F.round("confidence", 6).alias("confidence"), "why", "should_trust")


@query("r24_recall_scoped")
def r24b(v):
    return _recalled(v, tier="L3", kinds=("atom", "narrative"), agent="en", time_scope=(1_600_000_000, NOW)).select("query_id", "doc_id", "position", F.round("confidence", 6).alias("confidence"), "why", "should_trust")


def _auxiliary(v: Views) -> recall.Auxiliary:
    """Another model: its vectors are counts of words, and so are the queries'."""
    atoms = v.atoms.select(F.col("id").alias("query_id"), F.col("text").alias("query_text"))
    return recall.Auxiliary(models.hashed_words, durable(models.embedded_queries(atoms, models.hashed_words)).select(F.col("query_id").alias("doc_id"), F.col("q").alias("embedding")))


@query("r24_recall_auxiliary")
def r24c(v):
    found = recall.recall(_memory(v), _asked(v), _labels(v), NOW, aux=_auxiliary(v))
    return found.select("query_id", "doc_id", "position", F.round("confidence", 6).alias("confidence"), "why", "should_trust")


@query("r24_recall_reranked", _ALL_TERMS_SQL.replace("placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final DESC, doc_id) AS position FROM scored)", """asked AS (SELECT item_id AS query_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS ws FROM benchmark),
first AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final DESC, doc_id) AS old FROM scored),
shares AS (SELECT f.* EXCLUDE (final), CASE WHEN old > 50 THEN final WHEN len(ws) = 0 THEN 0 ELSE len(list_intersect(ws, regexp_extract_all(lower(text), '[a-z0-9]+')))::DOUBLE / len(ws) END AS final FROM first f JOIN asked a ON a.query_id = f.query_id),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN old <= 50 THEN 0 ELSE 1 END, CASE WHEN old <= 50 THEN final END DESC, old) AS position FROM shares)""") + " SELECT query_id, doc_id, CAST(position AS INTEGER) AS position, round(confidence, 6) AS confidence, why, confidence >= 0.6 AS should_trust FROM judged")
def r24d(v):
    return _recalled(v, rerank=True).select("query_id", "doc_id", "position", F.round("confidence", 6).alias("confidence"), "why", "should_trust")


@query("r22_payload")
def r22(v):
    return recall.payload(_memory(v), _recalled(v))


@query("r22_payload_enriched")
def r22b(v):
    memory = replace(_memory(v), edges=v.relates, files=v.raw("documents").select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("source_ref"), "text"))
    return recall.answer(memory, _asked(v), _labels(v), NOW, recall.Request(tier="L3"))[1]


@query("r25_records", _WHOLE_SQL + ", " + _GIST_SQL + """
, fitted AS (SELECT *, sum(ceil(length(text) / 3.0)) OVER (PARTITION BY query_id ORDER BY position) <= 1500 AS fits FROM judged)
SELECT f.query_id, CAST(f.position AS INTEGER) AS position, f.doc_id, a.kind, f.project, round(f.confidence, 6) AS confidence, CASE WHEN fits THEN 'body' ELSE 'handle' END AS delivery, CASE WHEN fits THEN f.text ELSE g.gist END AS body
FROM fitted f JOIN atoms a ON a.id = f.doc_id JOIN gists g ON g.id = f.doc_id""")
def r25(v):
    return recall.records(_memory(v), _recalled(v, first_terms=64))


@query("r26_listing", _WHOLE_SQL + " SELECT query_id, CAST(position AS INTEGER) AS position, '- [' || CAST(round(confidence * 100) AS INTEGER) || '%] (' || coalesce(project, '-') || ') ' || substr(trim(regexp_replace(text, '\\s+', ' ', 'g'), ' '), 1, 300) AS line FROM judged")
def r26(v):
    return recall.listing(_memory(v), _recalled(v, first_terms=64))


@query("a13_retrieval_quality", TERMS_SQL + """
, r AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM fts),
g AS (SELECT b.item_id AS query_id, min(rank) AS first FROM benchmark b LEFT JOIN (SELECT r.* FROM r JOIN documents d ON d.doc_id = r.doc_id JOIN benchmark b ON b.item_id = r.query_id AND contains(d.text, b.text)) x ON x.query_id = b.item_id GROUP BY b.item_id)
SELECT count(*) AS queries, round(avg(CASE WHEN first <= 1 THEN 1.0 ELSE 0 END), 6) AS r1, round(avg(CASE WHEN first <= 5 THEN 1.0 ELSE 0 END), 6) AS r5, round(avg(CASE WHEN first <= 10 THEN 1.0 ELSE 0 END), 6) AS r10, round(avg(CASE WHEN first <= 20 THEN 1.0 ELSE 0 END), 6) AS r20, round(avg(CASE WHEN first <= 10 THEN 1.0 / first ELSE 0 END), 6) AS mrr10 FROM g""")
def a13(v):
    from memloom.operators.evaluation import quality

    ranks = ranking.ranked(_postings(v).score(_terms(v), ranking.bm25_fts())).select("query_id", "doc_id", "rank")
    relevant = ranks.join(v.raw("documents").select("doc_id", "text"), "doc_id").join(v.queries, "query_id").filter(F.expr("contains(text, query_text)")).select("query_id", "doc_id")
    return quality(v.queries.select("query_id"), ranks, relevant)
