"""Queries over text functions (F01-F36), spans (S11) and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from memloom.functions import entities
from memloom.functions import text as tx
from memloom.plans.registry import query
from memloom.plans.views import with_views

_ALL_WS = r"[ \t\n\r\f\v]+"


def _in(words) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


def _cue_sql() -> str:
    return " ".join("WHEN " + " OR ".join(f"contains(lower(p), '{c.replace(chr(39), chr(39) * 2)}')" for c in cues) + f" THEN '{kind}'" for kind, cues in tx.CUES.items())


@query("f01_extract_entities")
def f01(v):
    return v.raw("documents").select("doc_id", F.explode(entities.extract_entities(F.col("text"))).alias("m")).select("doc_id", "m.label", "m.etype").groupBy("doc_id", "label", "etype").agg(F.count("*").alias("n"))


@query("f03_extract_spans")
def f03(v):
    return v.raw("pages").select("page_id", F.explode(entities.extract_entities(F.col("html"), entities.ALL, in_order=True)).alias("m")).select("page_id", "m.*")


@query("f04_native_mentions", with_views("mentions") + " SELECT doc_id, label, etype, count(*) AS n FROM mentions GROUP BY ALL")
def f04(v):
    return v.mentions.groupBy("doc_id", "label", "etype").agg(F.count("*").alias("n"))


@query("f08_query_words", """
SELECT item_id, string_agg(w, ' ' ORDER BY k) AS words, count(*) AS n FROM (
  SELECT item_id, k, regexp_replace(lower(parts[k]), '^[?.,]+|[?.,]+$', '', 'g') AS w FROM (
    SELECT item_id, parts, unnest(range(1, len(parts) + 1)) AS k FROM (SELECT item_id, string_split(trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g')), ' ') AS parts FROM benchmark))
  WHERE length(parts[k]) >= 2) GROUP BY item_id""")
def f08(v):
    return v.raw("benchmark").select("item_id", tx.query_words("text").alias("w")).select("item_id", F.array_join("w", " ").alias("words"), F.size("w").cast("long").alias("n"))


@query("f09_lexical_tokens", r"SELECT doc_id, len(t) AS n, len(list_distinct(t)) AS distinct_n, coalesce(array_to_string(t[1:5], ' '), '') AS head FROM (SELECT doc_id, regexp_extract_all(lower(text), '0x[0-9a-f]+|[\p{L}\p{N}_]+(?:[-.][\p{L}\p{N}_]+)*') AS t FROM documents)")
def f09(v):
    return v.raw("documents").select("doc_id", tx.lexical_tokens("text").alias("t")).select("doc_id", F.size("t").cast("long").alias("n"), F.size(F.array_distinct("t")).cast("long").alias("distinct_n"), F.array_join(F.slice("t", 1, 5), " ").alias("head"))


@query("f10_fts_query", r"""SELECT item_id, array_to_string(list_transform(t[1:64], lambda x: '"' || x || '"'), ' OR ') AS q FROM (SELECT item_id, regexp_extract_all(text, '[\p{L}\p{N}_]+') AS t FROM benchmark) WHERE len(t) > 0""")
def f10(v):
    return v.raw("benchmark").select("item_id", tx.fts_query("text").alias("q")).filter("q IS NOT NULL")


@query("f11_identifiers")
def f11(v):
    from memloom.functions.python_text import identifiers

    return v.raw("pages").select("page_id", identifiers(F.col("html")).alias("ids")).select("page_id", F.size("ids").alias("n"), F.array_join("ids", ",").alias("ids"))


@query("f13_chunks")
def f13(v):
    from memloom.functions.python_text import chunks

    return v.raw("documents").select("doc_id", F.posexplode(chunks(F.col("text"))).alias("chunk", "text"))


@query("f14_key_terms", f"""
WITH w AS (SELECT item_id, words[k] AS w, k FROM (SELECT item_id, words, unnest(range(1, len(words) + 1)) AS k FROM (SELECT item_id, regexp_extract_all(text, '[A-Za-z0-9]+') AS words FROM benchmark))),
u AS (SELECT item_id, arg_min(w, k) AS w, min(k) AS k FROM w WHERE length(w) >= 4 AND lower(w) NOT IN {_in(tx.TERM_STOPWORDS)} GROUP BY item_id, lower(w)),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY length(w) + CASE WHEN regexp_matches(w, '^[A-Z]') THEN 3 ELSE 0 END + CASE WHEN regexp_matches(w, '[0-9]') THEN 2 ELSE 0 END DESC, k) AS n FROM u)
SELECT b.item_id, coalesce((SELECT string_agg(w, ' ' ORDER BY n) FROM r WHERE r.item_id = b.item_id AND n <= 3), '') AS terms FROM benchmark b""")
def f14(v):
    return v.raw("benchmark").select("item_id", F.array_join(tx.key_terms("text"), " ").alias("terms"))


@query("f15_calendar_question", "SELECT item_id, 'What was scheduled for ' || '2024-01-02' || '? ' || text AS question FROM benchmark")
def f15(v):
    return v.raw("benchmark").select("item_id", tx.calendar_question("text", F.lit("2024-01-02")).alias("question"))


@query("f15_all_questions")
def f15b(v):
    t = v.raw("conversations")
    return t.select("conv_id", "turn", tx.chat_question(F.lit("notes"), "role", "text").alias("chat"), tx.sender_question(F.lit("sam"), "text").alias("sender"), tx.session_question(F.lit("p1"), "text").alias("session"), tx.email_question(F.lit(""), F.lit(""), "text").alias("email"))


@query("f17_ics_date", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M') AS at, strftime(ts, '%Y-%m-%d') AS day FROM events")
def f17(v):
    e = v.raw("events")
    return e.select("event_id", tx.ics_date(F.date_format("ts", "yyyyMMdd'T'HHmmss'Z'")).alias("at"), tx.ics_date(F.date_format("ts", "yyyyMMdd")).alias("day"))


_GIST_SQL = r"""
lines AS (SELECT id, k, trim(regexp_replace(ls[k], '[ \t\n\r\f\v]+', ' ', 'g')) AS s FROM (SELECT id, ls, unnest(range(1, len(ls) + 1)) AS k FROM (SELECT doc_id AS id, string_split(text, chr(10)) AS ls FROM documents))),
full_lines AS (SELECT * FROM lines WHERE s <> ''),
claims AS (SELECT id, arg_min(trim(substr(s, 11)), k) AS c FROM full_lines WHERE starts_with(lower(s), 'principle:') AND trim(substr(s, 11)) <> '' GROUP BY id),
good AS (SELECT id, min(k) AS k FROM full_lines WHERE NOT (regexp_matches(lower(s), '^(approach:|outcome:|domain:|dead ends:|next steps:)') OR lower(s) IN ('discovery', 'failed approach') OR ends_with(s, '?') OR regexp_full_match(s, '[ \t\-*+#>|`_=~.:]+')) GROUP BY id),
gists AS (SELECT d.doc_id AS id, substr(coalesce((SELECT c FROM claims WHERE claims.id = d.doc_id), (SELECT string_agg(l.s, ' ' ORDER BY l.k) FROM full_lines l WHERE l.id = d.doc_id AND l.k >= coalesce((SELECT k FROM good WHERE good.id = d.doc_id), 1)), ''), 1, 80) AS gist FROM documents d)"""


@query("f18_gist", f"WITH {_GIST_SQL} SELECT id, gist FROM gists")
def f18(v):
    return v.raw("documents").select(F.col("doc_id").alias("id"), tx.gist("text").alias("gist"))


@query("f19_token_estimate", "SELECT doc_id, CAST(ceil(length(text) / 3.0) AS BIGINT) AS tokens FROM documents")
def f19(v):
    return v.raw("documents").select("doc_id", tx.token_estimate("text").alias("tokens"))


@query("f20_dates_and_bodies", with_views("atoms") + " SELECT id, strftime(to_timestamp(coalesce(occurred_at, created_at)) AT TIME ZONE 'UTC', '%Y-%m-%d') AS day, '  ' || replace(regexp_replace(text, chr(10) || '$', ''), chr(10), chr(10) || '  ') AS body FROM atoms")
def f20(v):
    return v.atoms.select("id", tx.utc_date(tx.effective_time()).alias("day"), tx.indented("text").alias("body"))


@query("f22_ulid")
def f22(v):
    made = v.raw("events").select("event_id", tx.ulid_of(F.unix_millis(F.col("ts").cast("timestamp")), "event_id").alias("ulid"))
    return made.withColumns({"valid": tx.is_atom_id("ulid"), "same": tx.normalized_atom_id(F.concat(F.lit("p3://"), F.col("ulid"))) == F.col("ulid")})


@query("f22_atom_id", "SELECT c_custkey, c_name, regexp_full_match(regexp_replace(c_name, '^p3://', ''), '[0-9A-HJKMNP-TV-Z]{26}') AS valid FROM customer")
def f22b(v):
    return v.raw("customer").select("c_custkey", "c_name", tx.normalized_atom_id("c_name").isNotNull().alias("valid"))


@query("f23_safe_refs", with_views("provenance") + " SELECT atom_id, source_ref, NOT (starts_with(source_ref, '/') OR starts_with(source_ref, '~') OR list_contains(string_split(source_ref, '/'), '..')) AS safe, string_split(source_ref, '/')[1] AS project FROM provenance")
def f23(v):
    return v.provenance.select("atom_id", "source_ref", tx.safe_ref("source_ref").alias("safe"), F.split_part("source_ref", F.lit("/"), F.lit(1)).alias("project"))


@query("f24_factors", with_views("atoms") + " SELECT id, round(0.5 + 0.5 * exp(-greatest(0.0, (1740000000 - coalesce(occurred_at, created_at))::DOUBLE) / (90 * 86400.0)), 6) AS time_factor, 1 + least(importance, 1.0) AS importance_factor FROM atoms")
def f24(v):
    return v.atoms.select("id", F.round(tx.time_factor(1740000000 - tx.effective_time()), 6).alias("time_factor"), tx.importance_factor("importance").alias("importance_factor"))


@query("f27_span_refs")
def f27(v):
    return v.raw("conversations").select("conv_id", "turn", tx.span_ref(F.col("conv_id").cast("string"), "turn", "text").alias("ref"))


@query("f28_compose", "SELECT p_partkey, concat_ws(chr(10), nullif(trim(p_name), ''), 'approach: ' || nullif(trim(p_type), ''), 'outcome: ' || nullif(trim(p_brand), '')) AS body FROM part")
def f28(v):
    return v.raw("part").select("p_partkey", tx.composed_body(shape="p_name", approach="p_type", outcome="p_brand").alias("body"))


@query("f29_learner_candidates", f"""
WITH w AS (SELECT item_id, k, lower(ws[k]) AS w, CASE WHEN k < len(ws) THEN lower(ws[k + 1]) END AS nxt FROM (SELECT item_id, ws, unnest(range(1, len(ws) + 1)) AS k FROM (SELECT item_id, regexp_extract_all(text, '[a-zA-Z]+') AS ws FROM benchmark)))
SELECT item_id, w AS term FROM w WHERE length(w) >= 3 AND w NOT IN {_in(tx.LEARNER_STOPWORDS)}
UNION SELECT item_id, w || ' ' || nxt FROM w WHERE length(w) >= 3 AND w NOT IN {_in(tx.LEARNER_STOPWORDS)} AND length(nxt) >= 3 AND nxt NOT IN {_in(tx.LEARNER_STOPWORDS)}""")
def f29(v):
    return v.raw("benchmark").select("item_id", F.explode(tx.learner_candidates("text")).alias("term"))


@query("f30_classify_spans", f"""
SELECT conv_id, turn, kind, count(*) AS n FROM (SELECT conv_id, turn, CASE {_cue_sql()} END AS kind FROM (SELECT conv_id, turn, unnest(string_split(text, chr(10) || chr(10))) AS p FROM conversations) WHERE trim(p) <> '') GROUP BY ALL""")
def f30(v):
    return v.raw("conversations").select("conv_id", "turn", F.explode(tx.paragraphs("text")).alias("p")).select("conv_id", "turn", tx.classify("p").alias("kind")).groupBy("conv_id", "turn", "kind").agg(F.count("*").alias("n"))


@query("f30_classify_comments", f"SELECT doc_id, CASE {_cue_sql()} END AS kind FROM (SELECT doc_id, text AS p FROM documents)")
def f30b(v):
    return v.raw("documents").select("doc_id", tx.classify("text").alias("kind"))


@query("f32_first_words", r"SELECT doc_id, array_to_string(list_filter(string_split(trim(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g')), ' '), lambda w: w <> '')[1:500], ' ') AS head FROM documents")
def f32(v):
    return v.raw("documents").select("doc_id", tx.first_words("text").alias("head"))


@query("f33_event_props", "SELECT event_id, props FROM events WHERE props IS NOT NULL")
def f33(v):
    return v.raw("events").filter("props IS NOT NULL").select("event_id", "props")


@query("f35_slugs", "SELECT item_id, regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM benchmark")
def f35(v):
    return v.raw("benchmark").select("item_id", tx.slug("text").alias("slug"))


@query("f36_normalized_answers", r"SELECT item_id, lower(trim(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g'))) AS answer FROM benchmark")
def f36(v):
    return v.raw("benchmark").select("item_id", tx.normalized_answer("text").alias("answer"))


@query("p11_stopwords", f"SELECT w, count(*) AS n FROM (SELECT lower(unnest(regexp_extract_all(text, '[a-zA-Z]+'))) AS w FROM documents) WHERE w NOT IN {_in(tx.LEARNER_STOPWORDS)} GROUP BY w")
def p11(v):
    w = v.raw("documents").select(F.explode(F.regexp_extract_all("text", F.lit("[a-zA-Z]+"), 0)).alias("w")).select(F.lower("w").alias("w"))
    stop = v.spark.createDataFrame([(x,) for x in tx.LEARNER_STOPWORDS], "w string")
    return w.join(F.broadcast(stop), "w", "left_anti").groupBy("w").agg(F.count("*").alias("n"))
