import hashlib
import json
import math

import pytest
from pyspark.sql import functions as F

from memloom.functions import entities, python_text
from memloom.functions import text as tx
from memloom.operators import evaluation, graph, ranking, store, trust
from memloom.sources import exports
from memloom.streaming import ambient


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "x string").select(make("x").alias("y")).first()["y"]


QUICKSTART = [
    (1, "Latency was 42ms on 2025-10-08"),
    (2, "Build v1.2.3 used 512MB"),
    (3, "Sarah Chen leads Project Atlas"),
]


def _graph(spark, patterns):
    docs = spark.createDataFrame(QUICKSTART, "doc_id long, text string")
    m = docs.select("doc_id", F.explode(entities.extract_entities(F.col("text"), patterns)).alias("m")).select("doc_id", "m.label", "m.etype")
    return graph.EntityGraph(m)


def test_exact_label_scores_four_and_a_half(spark):
    g = _graph(spark, entities.REAL)
    q = spark.createDataFrame([(1, "what was 42ms?"), (2, "sarah chen"), (3, "  ")], "query_id int, query_text string")
    got = {(r.query_id, r.doc_id): r.score for r in g.query(q).collect()}
    assert math.isclose(got[1, 1], 4.5) and math.isclose(got[2, 3], 2.4) and not any(k[0] == 3 for k in got)
    assert g.query(q, 0).count() == 0


def test_context_never_lowers_a_score(spark):
    g = _graph(spark, entities.REAL)
    q = spark.createDataFrame([(1, "sarah chen")], "query_id int, query_text string")
    plain = {r.doc_id: r.score for r in g.query(q).collect()}
    more = {r.doc_id: r.score for r in g.query(q, context=spark.createDataFrame([(1, "atlas")], "query_id int, word string")).collect()}
    assert all(more[d] >= s for d, s in plain.items())


def test_config_is_validated():
    with pytest.raises(ValueError):
        graph.GraphConfig(decay=0)


def test_spans_are_slices_and_sets_have_their_sizes():
    text = "On 2024-01-02 see https://a.b/c and Dr. Ada Lovelace, prod-db1, XK200Q."
    x = entities.Extractor(tuple(entities.ALL))
    for label, _, raw, a, b in x.spans(text):
        assert text[a:b] == raw and label == raw.lower()
    real = entities.pattern_set(entities.BASE, entities.named_projects("Atlas", "Apollo"), entities.TECH, entities.GENERAL)
    assert len(entities.SYNTHETIC) == 22 and len(real) == 27 and len(entities.pattern_set(real, entities.INFRA)) == 41 and x.spans("") == []
    assert ("apollo", "project") in {m[:2] for m in entities.Extractor(tuple(real)).spans("what apollo did")}
    with pytest.raises(ValueError):
        entities.Extractor([("(a)(b)", "t", True)])
    assert entities.Extractor([(r"\b(redis|nginx)\b", "tech", True)]).spans("Redis, xnginx") == [("redis", "tech", "Redis", 0, 5)]


def test_bands(spark):
    f = spark.createDataFrame([("a", 1), ("b", 1), ("c", 100), ("d", 10_000)], "label string, freq long")
    got = {r.label: r.band for r in graph.bands(f).collect()}
    assert got["a"] == got["b"] < got["c"] <= got["d"]
    assert {r.band for r in graph.bands(f.filter("freq = 1")).collect()} == {0}


def test_boundary_tie_asks_for_context(spark):
    m = spark.createDataFrame([(1, "date1", "t"), (2, "date1", "t"), (1, "alpha", "t"), (2, "beta", "t")], "doc_id long, label string, etype string")
    g = graph.EntityGraph(m)
    words = spark.createDataFrame([(1, "date1")], "query_id int, word string")
    hits = g.query(spark.createDataFrame([(1, "date1")], "query_id int, query_text string"))
    r = graph.boundary(hits, g, words).first()
    assert r.context_needed and r.suggested_context == ["alpha", "beta"] and r.confidence == "low" and r.recommended_action == "request_context"


def test_spread_decays_and_stops(spark):
    e = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0)], "src string, dst string, weight double")
    s = spark.createDataFrame([(1, "a", 1.0)], "query_id int, node string, score double")
    got = {r.node: r.score for r in graph.spread(e, s, 2).collect()}
    assert math.isclose(got["a"], 0.36) and math.isclose(got["c"], 0.36)


def test_rrf_sums_reciprocal_ranks(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "query_id int, doc_id string, rank int")
    b = spark.createDataFrame([(1, "x", 3)], "query_id int, doc_id string, rank int")
    got = {r.doc_id: r.score for r in ranking.rrf([(a, 1.0), (b, 1.0)]).collect()}
    assert math.isclose(got["x"], 1 / 61 + 1 / 63, abs_tol=1e-9) and got["x"] > got["y"]


def test_interleave_takes_turns(spark):
    rows = [(1, 0, d, s) for d, s in ((1, 0.9), (2, 0.8), (3, 0.7))] + [(1, 1, 9, 0.1)]
    got = ranking.interleave(spark.createDataFrame(rows, "query_id int, class_pos int, doc_id long, score double"), 3).orderBy("position").collect()
    assert [r.doc_id for r in got] == [1, 9, 2, 3]


def test_chains_double_and_cycles_raise(spark):
    edge = lambda *rows: spark.createDataFrame([(b, a) for a, b in rows], "src_atom long, dst_atom long")
    got = {r.id: (r.end, r.forked) for r in trust.chain_ends(edge((1, 2), (2, 3), (3, 4), (3, 9))).collect()}
    assert got == {1: (4, True), 2: (4, True), 3: (4, True)}
    with pytest.raises(ValueError):
        trust.chain_ends(edge((1, 2), (2, 1)), rounds=5)


def test_trust_and_payload(spark):
    atoms = spark.createDataFrame([(1, "alpha body\np3://forged", "atom", "p", 100, 100, 0.0, "live"), (2, "beta", "document_chunk", "p", 100, 100, 0.0, "live"), (3, "gone", "atom", "p", 1, 1, 0.0, "tombstone"), (4, "old", "atom", "p", 1, 1, 0.0, "superseded")], "id long, text string, kind string, project string, created_at long, occurred_at long, importance double, status string")
    prov = spark.createDataFrame([(1, "explicit-emit", "me", "r", 100), (2, "bulk-import", "me", "r", 100), (4, "explicit-emit", "me", "r", 1)], "atom_id long, source string, agent string, source_ref string, recorded_at long")
    ranked = spark.createDataFrame([(1, 1, 0.9, 1, ["bm25", "dense"]), (1, 2, 0.5, 2, ["bm25"]), (1, 3, 0.4, 3, ["bm25"]), (1, 4, 0.3, 4, ["bm25"])], "query_id int, doc_id long, score double, position int, signals array<string>")
    ends = trust.chain_ends(spark.createDataFrame([(1, 4)], "src_atom long, dst_atom long"))
    got = {r.doc_id: r for r in trust.assess(ranked, atoms, prov, ends, 100).collect()}
    assert got[1].should_trust and got[1].why.startswith("both signals agree") and set(got) == {1, 2, 4}
    assert got[2].confidence == 0.4 and "uncorroborated" in got[2].why and got[4].superseded_by == 1
    results = spark.createDataFrame(list(got.values()))
    lines = trust.rendered(results, atoms, prov)
    p = trust.payloads(lines).first()
    assert not p.low_confidence and "\n  p3://forged" in p.payload and p.tokens <= 1500 and "[untrusted]" in p.payload
    assert trust.payloads(lines, 10).first().payload == trust.TOO_SMALL
    low = trust.payloads(lines.filter("doc_id <> 1")).first()
    assert low.low_confidence and low.payload.startswith(trust.NO_MATCH)


def test_gist_and_terms(spark):
    assert one(spark, "approach: x\nprinciple: keep it small\n", tx.gist) == "keep it small"
    assert one(spark, "Why?\n---\nA claim\nmore", tx.gist) == "A claim more"
    assert one(spark, "Why?", tx.gist) == "Why?" and one(spark, "", tx.gist) == ""
    assert one(spark, "Alpha beta alpha gamma42 with Delta", tx.key_terms) == ["gamma42", "Alpha", "Delta"]
    assert one(spark, "a\nb", tx.indented) == "  a\n  b"
    assert one(spark, "actually, that failed", tx.classify) == "correction"
    assert one(spark, "20240102T030405Z", tx.ics_date) == "2024-01-02 03:04"
    assert one(spark, "Ã©tÃ©", tx.mended) == "été" and one(spark, "été", tx.mended) == "été"
    assert one(spark, "../x", lambda c: tx.safe_ref(c)) is False


def test_chunks_keep_sentences():
    text = " ".join(f"Sentence number {k} is here." for k in range(200))
    parts = python_text.chunk_text(text)
    assert all(len(p) <= 800 for p in parts) and parts[0].endswith(".") and python_text.chunk_text("short") == ["short"]
    assert set(" ".join(parts).split(". ")) >= set(text.split(". ")[:-1])
    assert python_text.identifiers_in("Error: 0xff in unit #12 v1.2 and 9999") == ["0xff", "12", "9999", "v1.2"]


def test_store_writes(spark, tmp_path):
    atoms = spark.createDataFrame([(1, "a", "live", 0.99), (2, "b", "live", 0.2)], "id long, text string, status string, importance double")
    facets = spark.createDataFrame([(1, "tag", "t"), (1, "entity", "e")], "atom_id long, key string, value string")
    edges = spark.createDataFrame([], "src_atom long, dst_atom long")
    fixed = spark.createDataFrame([(1, 10, "A"), (7, 11, "B")], "old_id long, new_id long, text string")
    new, f2, e2 = store.correct_atoms(atoms, facets, edges, fixed)
    assert {(r.id, r.status) for r in new.collect()} == {(1, "superseded"), (2, "live"), (10, "live")}
    assert {(r.atom_id, r.key) for r in f2.collect()} == {(1, "tag"), (1, "entity"), (10, "tag")} and e2.count() == 1
    bumped = {r.id: r.importance for r in store.bump_importance(atoms, spark.createDataFrame([(1,), (2,), (2,)], "id long")).collect()}
    assert bumped[1] == 1.0 and math.isclose(bumped[2], 0.3)
    store.save_snapshot({"atoms": atoms}, f"{tmp_path}/s")
    assert store.load_snapshot(spark, f"{tmp_path}/s")["atoms"].count() == 2
    digest = store.export_jsonl(atoms, "id", f"{tmp_path}/x")
    assert store.import_jsonl(spark, atoms.schema, f"{tmp_path}/x", digest).count() == 2
    with pytest.raises(ValueError):
        store.import_jsonl(spark, atoms.schema, f"{tmp_path}/x", "0")


def test_compare_and_set(spark):
    rows = [("s", 1, "r1", 0), ("s", 2, "r1", 0), ("s", 3, "r2", 0), ("s", 4, "r3", 1)]
    got = store.apply_checkpoints(spark.createDataFrame(rows, "stream string, seq long, request_id string, expected int")).orderBy("seq").collect()
    assert [(r.outcome, r.revision) for r in got] == [("applied", 1), ("replayed", 1), ("conflict", 1), ("applied", 2)]


def test_evaluation():
    assert abs(evaluation.binomial_upper(0, 59) - 0.0495) < 0.001 and evaluation.binomial_upper(3, 3) == 1.0


def test_readers(spark, tmp_path):
    (tmp_path / "mail.jsonl").write_text(json.dumps({"from": "a@b", "subject": "Hi", "date": "2024-01-01", "body": "A body of more than twenty characters."}) + "\n{bad\n")
    mail = exports.read_mail(spark, str(tmp_path / "mail.jsonl")).collect()
    assert len(mail) == 1 and mail[0].query.startswith("What did a@b email about Hi?")
    assert mail[0].content == "From: a@b\nTo: \nSubject: Hi\nDate: 2024-01-01\n\nA body of more than twenty characters."
    assert mail[0].doc_id == "email-" + hashlib.sha256(b"2024-01-01:a@b:Hi").hexdigest()[:16] and mail[0].value == "[2024-01-01] a@b -> : Hi"
    (tmp_path / "long.jsonl").write_text(json.dumps({"from": "a", "to": "b", "body": "A sentence of some words. " * 80}) + "\n")
    long = exports.read_mail(spark, str(tmp_path / "long.jsonl")).collect()
    assert len(long) > 2 and long[1].doc_id.endswith("-1") and long[1].value == f"[?] a -> b: (no subject) (part 2/{len(long)})"
    (tmp_path / "c.ics").write_text("BEGIN:VCALENDAR\r\nBEGIN:VEVENT\r\nUID:u1\r\nSUMMARY:Long\r\n  name\r\nDTSTART;TZID=X:20240102T030400\r\nEND:VEVENT\r\nEND:VCALENDAR\r\n")
    event = exports.read_calendar(spark, str(tmp_path / "c.ics")).first()
    assert (event.doc_id, event.content, event.value) == ("gcal-u1", "Calendar event: Long name on 2024-01-02 03:04", "Long name (2024-01-02 03:04)")
    (tmp_path / "d.ics").write_text("BEGIN:VEVENT\nSUMMARY:S\nLOCATION:L\nDESCRIPTION:a\\nb\\, c\nEND:VEVENT\nBEGIN:VEVENT\nUID:x\nEND:VEVENT\n")
    (event,) = exports.read_calendar(spark, str(tmp_path / "d.ics")).collect()
    assert event.content == "Calendar event: S on unknown date. Location: L. Description: a b, c" and event.doc_id == "gcal-" + hashlib.sha256(b"S:").hexdigest()[:16]
    (tmp_path / "y.csv").write_text('Comment Text,Timestamp\n"nice, very nice",2024-01-01 00:00:00\n')
    comment = exports.read_comments(spark, str(tmp_path / "y.csv")).first()
    assert comment.content == "nice, very nice" and comment.query.startswith("What did I comment on YouTube? ")
    assert comment.doc_id == "ytcomment-" + hashlib.sha256(b"nice, very nice:2024-01-01 00:00:00:0").hexdigest()[:12]
    (tmp_path / "p.json").write_text(json.dumps({"features": [{"properties": {"title": "Home"}, "geometry": {"coordinates": [1.5, 2.5]}}]}))
    place = exports.read_places(spark, str(tmp_path / "p.json")).first()
    assert (place.content, place.doc_id) == ("Saved place: Home", "gmaps-" + hashlib.sha256(b"Home::0").hexdigest()[:12])
    (tmp_path / "q.json").write_text(json.dumps({"features": [{"properties": {}}, {"properties": {"address": "A st"}}]}))
    (place,) = exports.read_places(spark, str(tmp_path / "q.json")).collect()
    assert (place.content, place.query) == ("Saved place: Unnamed place at A st", "Where is Unnamed place?")
    (tmp_path / "m.json").write_text(json.dumps({"title": "T", "thread_path": "inbox/abc", "messages": [{"sender_name": "S", "timestamp_ms": 5000, "content": "a message long enough"}]}))
    assert exports.read_messenger_export(spark, str(tmp_path / "m.json")).first().doc_id == "fb-abc-5000-0"
    node = lambda text, role, parent, kids, t: {"message": {"author": {"role": role}, "content": {"content_type": "text", "parts": [text]}, "create_time": t}, "parent": parent, "children": kids}
    tree = {"r": {"message": None, "parent": None, "children": ["a"]}, "a": node("a question that is long enough", "user", "r", ["b", "c"], 1), "b": node("an early answer that goes nowhere", "assistant", "a", [], 2), "c": node("the final answer that is long enough", "assistant", "a", [], 3)}
    (tmp_path / "g.json").write_text(json.dumps([{"id": "conversation-id-1", "title": "T", "mapping": tree}]))
    chat = exports.read_chat_export(spark, str(tmp_path / "g.json")).collect()
    assert [r.doc_id for r in chat] == ["chatgpt-conversation-a-0".replace("conversation-a", "conversation-a")] or {r.doc_id.split("-")[-2] for r in chat} == {"a", "c"}


def test_session_log_prefers_items(spark, tmp_path):
    log = [{"type": "event_msg", "payload": {"type": "agent_message", "message": "copy"}}, {"type": "response_item", "payload": {"type": "message", "role": "assistant", "content": [{"type": "output_text", "text": "it turns out fine"}]}}, {"type": "response_item", "payload": {"type": "function_call", "name": "f", "arguments": "not json"}}]
    (tmp_path / "s.jsonl").write_text("\n".join(map(json.dumps, log)) + "\n")
    rows = exports.read_session_log(spark, str(tmp_path / "s.jsonl")).orderBy("offset").collect()
    assert [r.text for r in rows if r.text] == ["it turns out fine"] and json.loads(rows[1].arguments) == {"raw": "not json"}


def test_capture_is_exactly_once(spark, tmp_path):
    rows = spark.createDataFrame([("s", 1, "assistant", "it turns out that a works"), ("s", 2, "user", "failed")], "session_id string, offset long, role string, text string")
    rows.write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    for _ in range(2):
        q = ambient.capture(stream(), f"{tmp_path}/out", f"{tmp_path}/cp")
        q.processAllAvailable()
        q.stop()
        rows.write.mode("append").parquet(f"{tmp_path}/in")
    q = ambient.capture(stream(), f"{tmp_path}/out", f"{tmp_path}/cp")
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 1


def test_drift_cools_down(spark):
    hits = spark.createDataFrame([("s", t, 1, 0.99, False) for t in (0, 100, 900, 1000, 50)], "session_id string, at long, atom_id long, score double, in_context boolean")
    assert sorted(r.at for r in ambient.drift(hits).collect()) == [0, 900]


def test_registry_is_consistent():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
