"""Queries over hybrids of graph, lexical and dense retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from memloom.functions import text as tx
from memloom.operators import cases, graph, hybrid, inverted, models, ranking
from memloom.plans.queries_graph import GRAPH_SQL, _graph
from memloom.plans.queries_recall import _TWO_LISTS, LEXICAL_SQL, _asked, _lexical, _two, _vectors
from memloom.plans.registry import query
from memloom.sources.tables import durable

_DENSE_SQL = """
, qv AS (SELECT item_id AS query_id, embedding::DOUBLE[] AS q FROM benchmark JOIN embeddings ON vec_id = item_id),
dense AS (SELECT query_id, vec_id AS doc_id, list_inner_product(q, embedding::DOUBLE[]) AS score FROM qv CROSS JOIN embeddings)"""


@query("r08_lexical_and_dense", LEXICAL_SQL + """
, plus AS (SELECT query_id, doc_id, round(sum(times * ln((n + 1) / df) * (1 + tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)))), 9) AS score FROM matched GROUP BY ALL),
lr AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM plus WHERE score > 0),
dr AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM dense),
fused AS (SELECT query_id, doc_id, round(sum(w / (60 + rank)), 12) AS score FROM (SELECT *, 0.7 AS w FROM dr WHERE rank <= 10 UNION ALL SELECT *, 0.3 AS w FROM lr WHERE rank <= 20) GROUP BY query_id, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM fused)
SELECT query_id, doc_id, round(score, 9) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10""")
def r08(v):
    postings, terms = _lexical(v)
    lexical = graph.top_by(postings.score(terms, ranking.bm25_plus(), top=20).filter("score > 0"), 20)
    dense = ranking.dense_top(_asked(v).filter("q IS NOT NULL").select("query_id", "q"), _vectors(v), 10)
    return hybrid.lexical_and_dense(dense.filter("rank <= 10"), lexical, 10).select("query_id", "doc_id", F.round("score", 9).alias("score"), "rank")


@query("r10_two_stage", GRAPH_SQL + _DENSE_SQL + """
, g AS (SELECT query_id, doc_id, rank FROM ranked WHERE rank <= 30),
near AS (SELECT d.* FROM dense d JOIN g USING (query_id, doc_id)),
pool AS (SELECT * FROM near UNION ALL SELECT * FROM dense WHERE query_id NOT IN (SELECT query_id FROM near)),
d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM pool) WHERE rank <= 20),
m AS (SELECT query_id, doc_id, CASE WHEN g.rank IS NOT NULL AND d.rank IS NOT NULL THEN 100.0 / least(g.rank, d.rank) + 50 WHEN d.rank IS NOT NULL THEN 50.0 / d.rank ELSE 30.0 / g.rank END AS score,
  CASE WHEN g.rank IS NOT NULL AND d.rank IS NOT NULL THEN 'both' WHEN d.rank IS NOT NULL THEN 'dense' ELSE 'graph' END AS source FROM g FULL JOIN d USING (query_id, doc_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM m)
SELECT query_id, doc_id, round(score, 6) AS score, source, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5""")
def r10(v):
    hits = _graph(v).query(v.queries, 30)
    asked = _asked(v).filter("q IS NOT NULL").select("query_id", "q")
    return hybrid.two_stage(hits, asked, _vectors(v)).select("query_id", "doc_id", F.round("score", 6).alias("score"), "source", "rank")


@query("r10_two_stage_wary")
def r10b(v):
    """Queries whose graph hits are ambiguous or weak are searched among all vectors."""
    g = _graph(v)
    hits = durable(g.query(v.queries, 30).select("query_id", "doc_id", "score", "rank"))
    words = v.queries.select("query_id", F.explode(tx.query_words("query_text")).alias("word"))
    unsure = graph.boundary(hits, g, words).filter("context_needed OR confidence = 'low'").select("query_id")
    asked = _asked(v).filter("q IS NOT NULL").select("query_id", "q")
    return hybrid.two_stage(hits, asked, _vectors(v), unsure)


def _in(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _candidates_sql(name: str, key: str, table: str) -> str:
    """A view (key, term) of a text table's words and neighbouring pairs that may be learnt."""
    stop = _in(tx.LEARNER_STOPWORDS)
    return f"""
, {name}_w AS (SELECT {key}, lower(ws[k]) AS w, CASE WHEN k < len(ws) THEN lower(ws[k + 1]) END AS nxt FROM (SELECT {key}, ws, unnest(range(1, len(ws) + 1)) AS k FROM (SELECT {key}, regexp_extract_all(text, '[a-zA-Z]+') AS ws FROM {table}))),
{name} AS (SELECT {key}, w AS term FROM {name}_w WHERE length(w) >= 3 AND w NOT IN {stop}
  UNION SELECT {key}, w || ' ' || nxt FROM {name}_w WHERE length(w) >= 3 AND w NOT IN {stop} AND length(nxt) >= 3 AND nxt NOT IN {stop})"""


#: The graph without proper nouns leaves gaps to learn from.
_GAP_SQL = (
    GRAPH_SQL.replace("FROM documents)\nWHERE", "FROM documents)\nWHERE NOT regexp_full_match(w, '[A-Z][a-z]{3,}') AND", 1)
    + _DENSE_SQL
    + """
, d3 AS (SELECT query_id, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM dense) WHERE rank <= 3),
gap AS (SELECT DISTINCT query_id FROM d3 WHERE query_id NOT IN (SELECT query_id FROM hits))"""
    + _candidates_sql("asked", "item_id", "benchmark")
    + _candidates_sql("said", "doc_id", "(SELECT doc_id, text FROM documents WHERE doc_id IN (SELECT doc_id FROM d3))")
    + """
, own AS (SELECT query_id, term FROM asked JOIN gap ON query_id = item_id),
held AS (SELECT o.query_id, o.term FROM own o JOIN d3 ON d3.query_id = o.query_id WHERE EXISTS (SELECT 1 FROM said s WHERE s.doc_id = d3.doc_id AND contains(s.term, o.term))),
learned AS (SELECT term, count(*) AS frequency, min(query_id) AS first_query FROM (SELECT * FROM own UNION ALL SELECT * FROM held) GROUP BY term)"""
)


def _learning(v):
    g = graph.EntityGraph(v.mentions.filter("etype <> 'proper'"))
    hits = durable(g.query(v.queries, 50).select("query_id", "doc_id", "score"))
    dense = durable(ranking.dense_top(_asked(v).filter("q IS NOT NULL").select("query_id", "q"), _vectors(v), 20))
    return hits, durable(hybrid.learn_gaps(v.queries, hits, dense, v.raw("documents")))


@query("r12_learned_terms", _GAP_SQL + " SELECT term, frequency, first_query FROM learned")
def r12(v):
    return _learning(v)[1]


@query("r12_learned_injected", _GAP_SQL + """
, words_of AS (SELECT DISTINCT item_id AS query_id, regexp_replace(lower(p), '^[?.,]+|[?.,]+$', '', 'g') AS w
  FROM (SELECT item_id, unnest(string_split(trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g')), ' ')) AS p FROM benchmark) WHERE length(p) >= 2),
wanted AS (SELECT DISTINCT query_id, term FROM words_of JOIN (SELECT term, unnest(string_split(term, ' ')) AS part FROM learned) ON part = w),
more AS (SELECT DISTINCT query_id, doc_id, 0.5 AS score FROM wanted JOIN documents ON contains(lower(text), term)),
top50 AS (SELECT query_id, doc_id, score FROM ranked WHERE rank <= 50),
every AS (SELECT * FROM top50 UNION ALL SELECT * FROM more WHERE (query_id, doc_id) NOT IN (SELECT (query_id, doc_id) FROM top50)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM every)
SELECT query_id, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 50""")
def r12b(v):
    hits, learned = _learning(v)
    return hybrid.inject_learned(hits, v.queries, learned, v.raw("documents"), 50).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query("r13_context", GRAPH_SQL + """
, nb AS (SELECT item_id AS query_id, lower(text) AS said FROM benchmark),
bl AS (SELECT DISTINCT query_id, label FROM seeds),
recent AS (SELECT n.query_id, 0 AS place, n.query_id - b.query_id AS pos, b.label FROM nb n JOIN bl b ON b.query_id BETWEEN n.query_id - 5 AND n.query_id - 1),
near AS (SELECT r.query_id, 1 AS place, r.rank AS pos, l.label FROM ranked r JOIN links l ON l.doc_id = r.doc_id WHERE r.rank <= 5),
active AS (SELECT label, row_number() OVER (ORDER BY freq DESC, label) AS pos FROM freq),
shared AS (SELECT n.query_id, 2 AS place, a.pos, a.label FROM nb n CROSS JOIN active a WHERE a.pos <= 20),
f AS (SELECT query_id, label, min(place * 1000000 + pos) AS first_at FROM (SELECT * FROM recent UNION ALL SELECT * FROM near UNION ALL SELECT * FROM shared) GROUP BY query_id, label),
r AS (SELECT f.query_id, label, row_number() OVER (PARTITION BY f.query_id ORDER BY first_at, label) AS pos FROM f JOIN nb ON nb.query_id = f.query_id WHERE NOT contains(said, label))
SELECT query_id, CAST(pos AS INTEGER) AS pos, label FROM r WHERE pos <= 20""")
def r13(v):
    g = _graph(v)
    words = v.queries.select("query_id", F.explode(tx.query_words("query_text")).alias("word"))
    own = g.seeds(words).filter("seed >= 0.15").select("query_id", "label").distinct()
    later = own.select(F.explode(F.sequence(F.lit(1), F.lit(5))).alias("pos"), F.col("query_id").alias("said"), "label")
    recent = later.select((F.col("said") + F.col("pos")).alias("query_id"), "pos", "label")
    near = g.query(v.queries, 5).join(g.edges.select("doc_id", "label").distinct(), "doc_id").select("query_id", F.col("rank").alias("pos"), "label")
    active = g.frequency.orderBy(F.desc("freq"), "label").limit(20).select((-F.col("freq")).alias("pos"), "label")
    return hybrid.context_for(v.queries, recent, near, active)


@query("r06_mined_cases")
def r06(v):
    g = _graph(v)
    return cases.mine(g, cases.frequent_labels(g))


@query("r32_boundary_benchmark")
def r32(v):
    g, values, asked = cases.built_in(v.spark)
    return cases.benchmark(g, values, asked)


@query("r32_benchmark_summary")
def r32b(v):
    g, values, asked = cases.built_in(v.spark)
    return cases.summary(cases.benchmark(g, values, asked))


@query("r16_inverted_lists")
def r16(v):
    vectors = _vectors(v)
    centres = inverted.learn_centres(vectors)
    return inverted.search(durable(inverted.assign(vectors, centres)), centres, _asked(v).filter("q IS NOT NULL").select("query_id", "q"), 10)


_SHARE_SQL = _TWO_LISTS + """
, first AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM fts),
asked AS (SELECT item_id AS query_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS ws FROM benchmark)"""


@query("r11_rerank_blend", _SHARE_SQL + """
, x AS (SELECT f.query_id, f.doc_id, 0.4 * f.score + 0.6 * (10 * len(list_intersect(a.ws, regexp_extract_all(lower(substring(d.text, 1, 512)), '[a-z0-9]+')))::DOUBLE / len(a.ws)) AS score
  FROM first f JOIN asked a ON a.query_id = f.query_id JOIN documents d ON d.doc_id = f.doc_id WHERE rank <= 10),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM x)
SELECT query_id, doc_id, round(score, 5) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5""")
def r11(v):
    lexical, _ = _two(v, 10)
    return models.rerank_blend(lexical, v.queries, v.raw("documents")).select("query_id", "doc_id", F.round("score", 5).alias("score"), "rank")


@query("r11_rerank_replace", _SHARE_SQL + """
, x AS (SELECT f.query_id, f.doc_id, f.rank AS old, len(list_intersect(a.ws, regexp_extract_all(lower(d.text), '[a-z0-9]+')))::DOUBLE / len(a.ws) AS score
  FROM first f JOIN asked a ON a.query_id = f.query_id JOIN documents d ON d.doc_id = f.doc_id WHERE rank <= 50)
SELECT query_id, doc_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, old) AS INTEGER) AS rank FROM x""")
def r11b(v):
    lexical, _ = _two(v, 50)
    return models.rerank_replace(lexical, v.queries, v.raw("documents")).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query("m07_embed_missing")
def m07(v):
    return models.embed_missing(v.atoms, v.embeddings, "m0")
