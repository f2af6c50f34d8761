import itertools
import json
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from memloom import cli
from memloom.functions import entities, python_text
from memloom.operators import associate, enrich, ledger, persist, ranking, trust
from memloom.operators.graph import EntityGraph

RNG = random.Random(5)


def by_hand_order(edges):
    """Components and their order: level by level, then by id, cycles last."""
    ids = {i for e in edges for i in e}
    root = {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        x, y = top(a), top(b)
        root[max(x, y)] = min(x, y)
    level, left, n = {}, set(edges), 0
    while ready := {i for i in ids if i not in level and not any(new == i for new, _ in left)}:
        level |= dict.fromkeys(ready, n)
        left = {(new, old) for new, old in left if old not in ready}
        n += 1
    out = {}
    for r in set(map(top, ids)):
        for k, i in enumerate(sorted((i for i in ids if top(i) == r), key=lambda i: (level.get(i, 10**9), i))):
            out[i] = (r, k)
    return out


def test_correction_graphs_in_order(spark):
    for edges in ({(3, 1), (3, 2), (2, 5), (10, 3)}, {(k + 1, k) for k in range(12)}, {(1, 2), (2, 3), (3, 1), (4, 3), (9, 8)}, {(RNG.randint(1, 30), RNG.randint(0, 9)) for _ in range(25)} - {(k, k) for k in range(31)}):
        got = {r.id: (r.root, r.depth) for r in trust.components_in_order(spark.createDataFrame(sorted(edges), "src_atom long, dst_atom long")).collect()}
        assert got == by_hand_order(edges), edges


def test_chunks_by_force():
    def plain(sizes, target, overlap):
        """A sentence at a time."""
        ranges, begin, end = [], 0, 0
        width = lambda a, b: sum(sizes[a:b]) + max(0, b - a - 1)
        while end < len(sizes):
            end += 1
            while end < len(sizes) and width(begin, end + 1) <= target:
                end += 1
            ranges.append((begin, end))
            while begin < end and sum(sizes[begin:end]) + end - begin > overlap:
                begin += 1
        return ranges

    for _ in range(300):
        sizes = [RNG.randint(1, 60) for _ in range(RNG.randint(1, 25))]
        target, overlap = RNG.randint(20, 150), RNG.randint(0, 60)
        assert list(python_text.sentence_ranges(sizes, target, overlap)) == plain(sizes, target, overlap)
    text = " ".join(f"Sentence number {k} is here." for k in range(60))
    parts = python_text.chunk_text(text)
    assert len(parts) > 1 and parts[0].startswith("Sentence number 0") and parts[-1].endswith("59 is here.") and python_text.chunk_text(None) == []


def test_first_characters_are_sound():
    for expr in ("abc|Bd", "[xyz]+q", "(foo|b(a|o))r", "a?b", r"\d+x", "(a|)b", "é|f", "x*", "(?:ab){2,}"):
        found = python_text.first_characters(expr)
        words = ["".join(w) for n in range(4) for w in itertools.product("abfxq", repeat=n)] + ["foor", "12x", "éa"]
        if found is not None:
            assert all(m.group()[:1].lower() in found for w in words for m in re.finditer(expr, w))
    assert python_text.first_characters("abc|Bd") == {"a", "b"} and python_text.first_characters("a?b") == {"a", "b"} and python_text.first_characters("x*") is None


def test_chunks_are_located(spark):
    text = "first line\n\n second   line here\nthird one\nlast"
    assert python_text.locate_chunk(text, "line here third") == (3, 4) and python_text.locate_chunk(text, "first") == (1, 1)
    assert python_text.locate_chunk(text, "irst line") is None and python_text.locate_chunk(text, " ") is None and python_text.locate_chunk("", "a") is None
    chunks = spark.createDataFrame([(1, "f#s2", "third one last"), (2, "f", "no such"), (3, "g", "x")], "query_id long, source_ref string, text string")
    assert [tuple(r) for r in enrich.locations(chunks, spark.createDataFrame([("f", text)], "source_ref string, text string")).collect()] == [(1, "at f#L4-5")]


def test_relations_prefer_stored_edges(spark):
    atoms = spark.createDataFrame([(k, f"text {k}", "live" if k != 3 else "tombstone") for k in range(6)], "id long, text string, status string")
    chunks = spark.createDataFrame([(0,), (1,)], "query_id long")
    edges = spark.createDataFrame([(0, 3, 0.9), (0, 4, 0.5), (0, 5, 0.7), (1, 3, 0.9)], "src_atom long, dst_atom long, weight double")
    back = spark.createDataFrame([(0, 2, 9.0), (1, 2, 0.1), (1, 4, 0.3)], "query_id long, doc_id long, score double")
    got = enrich.relations(chunks, edges, back, atoms)
    assert sorted((r.query_id, r["rank"], r.doc_id, r.stored) for r in got.collect()) == [(0, 1, 5, True), (0, 2, 4, True), (1, 1, 4, False), (1, 2, 2, False)]
    assert {r.query_id: r.relates for r in enrich.lines(got, atoms).collect()}[1] == ["relates -> p3://4 text 4", "relates -> p3://2 text 2"]


FEEDBACK = "event_id long, receipt_id long, atom_id long, feedback_type string, agent string, task_id string, note string"


def test_feedback_is_idempotent_and_scoped(spark):
    heads = spark.createDataFrame([(1, "me", "t")], "receipt_id long, agent string, task_id string")
    shown = spark.createDataFrame([(1, 7), (1, 8)], "receipt_id long, atom_id long")
    good = (1, 1, 7, "helpful", "me", "t", "n")
    rows = [good, good, (2, 1, 7, "helpful", "you", "t", "n"), (3, 1, 9, "used", "me", "t", "n"), (4, 1, 8, "shown", "me", "t", None), (5, 1, 8, "used", "me", "t", " "), (6, 1, 8, "liked", "me", "t", "n"), (7, 2, 8, "used", "me", "t", "n"), (8, 1, 7, "helpful", "me", "t", "again"), (8, 1, 8, "helpful", "me", "t", "again")]
    none = spark.createDataFrame([], FEEDBACK + ", recorded_at long, processed_at long")
    judged = ledger.judged_feedback(spark.createDataFrame(rows, FEEDBACK), none, heads, shown)
    assert sorted((r.event_id, r.outcome) for r in judged.collect()) == [(1, "recorded"), (1, "replayed"), (2, "foreign"), (3, "unexposed"), (4, "recorded"), (5, "malformed"), (6, "malformed"), (7, "foreign"), (8, "differs"), (8, "recorded")]
    table = ledger.add_feedback(none, judged, F.lit(5).cast("long"))
    later = ledger.judged_feedback(spark.createDataFrame([good, (1, 1, 7, "used", "me", "t", "n")], FEEDBACK), table, heads, shown)
    assert sorted(r.outcome for r in later.collect()) == ["differs", "replayed"]
    atoms = spark.createDataFrame([(7, 0.5), (9, 0.2)], "id long, importance double")
    marked, raised, told = ledger.process_pending(table, atoms, 9, limit=2)
    assert tuple(told.first()) == (2, 1, 1) and {r.id: round(r.importance, 3) for r in raised.collect()} == {7: 0.51, 9: 0.2}
    assert sorted((r.event_id, r.processed_at) for r in marked.collect()) == [(1, 9), (4, 9), (8, None)]
    assert tuple(ledger.process_pending(marked, raised, 10)[2].first()) == (1, 0, 0)  # one credit for an atom, agent and task
    with pytest.raises(ValueError):
        ledger.process_pending(table, atoms, 9, limit=0)


def test_receipts_reads_and_guards(spark):
    results = spark.createDataFrame([(1, d, p, 0.5, "body") for p, d in enumerate([5, 6, 5, *range(10, 50)], 1)], "query_id long, doc_id long, position int, score double, delivery string")
    rows = ledger.receipts(results).orderBy("rank").collect()
    assert [r.atom_id for r in rows] == [5, 6, *range(10, 40)] and [r["rank"] for r in rows] == list(range(1, 33))
    atoms = spark.createDataFrame([(1, "t", "atom", "p", 1, 1, "superseded")], "id long, text string, kind string, project string, created_at long, occurred_at long, status string")
    provenance = spark.createDataFrame([(1, "s", "a", f"r{k}", k) for k in range(70)], "atom_id long, source string, agent string, source_ref string, recorded_at long")
    got = {r.id: r for r in ledger.point_reads(spark.createDataFrame([(1,), (2,)], "id long"), atoms, provenance).collect()}
    assert got[1].found and got[1].status == "superseded" and len(got[1].provenance) == 64 and got[1].truncated and got[1].provenance[3].source_ref == "r3"
    assert not got[2].found and got[2].provenance is None and not got[2].truncated
    why = lambda *row: spark.createDataFrame([row], "s string, r string, a string, t string").select(ledger.refusal("s", "r", "a", "t").alias("x")).first().x
    assert why("me", "a/b", "x", "t") is None and why("system", "a", "x", "t") == "reserved source" and why("me", "a/../b", "x", "t") == "escaping reference"
    assert why("me", "a", "x" * 65, "t") == "agent too long" and why("me", "a", "x", "t" * 32_001) == "body too long" and why("me", "a", "x", " ") == "empty body"


def test_faults_and_repairs(spark):
    a = spark.createDataFrame([(1,), (1,), (None,), (2,)], "id long")
    b = spark.createDataFrame([(1,), (3,), (None,)], "ref long")
    got = {r.check: r.n for r in ledger.key_faults({"a": a, "b": b}, {"a": ["id"]}, [("b", "ref", "a", "id")]).collect()}
    assert got == {"a: repeated keys": 1, "a: null keys": 1, "b.ref: not in a": 1}
    before = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (2, 1, 1)], "query_id int, doc_id int, rank int")
    after = spark.createDataFrame([(1, 1, 1), (1, 3, 2), (1, 2, 3), (2, 4, 1)], "query_id int, doc_id int, rank int")
    rows = {r.query_id: r for r in ledger.association_gate(before, after, spark.createDataFrame([(1,)], "query_id int")).collect()}
    assert rows[1].parity and rows[1].inert and rows[1].seeded and not rows[2].parity and not rows[2].inert


def test_graph_is_saved_grown_and_queried(spark, tmp_path):
    rows = [(1, "alpha", "t"), (1, "beta", "t"), (2, "alpha", "t"), (3, "gamma", "t"), (3, "gamma", "t")]
    mentions = spark.createDataFrame(rows, "doc_id long, label string, etype string")
    path = str(tmp_path / "g")
    persist.save_graph(EntityGraph(mentions), path)
    back = persist.load_graph(spark, path)
    q = spark.createDataFrame([(1, "alpha beta")], "query_id int, query_text string")
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(back.query(q)) == key(EntityGraph(mentions).query(q)) and back.stats().first() == EntityGraph(mentions).stats().first()
    new = spark.createDataFrame([(2, "gamma", "t"), (4, "alpha", "t")], "doc_id long, label string, etype string")
    grown = persist.grown(back.mentions, new)
    rebuilt = EntityGraph(spark.createDataFrame([r for r in rows if r[0] != 2] + [(2, "gamma", "t"), (4, "alpha", "t")], "doc_id long, label string, etype string"))
    assert key(grown.edges) == key(rebuilt.edges)


def test_command_line(spark, tmp_path):
    docs, graph = str(tmp_path / "d"), str(tmp_path / "g")
    spark.createDataFrame([(1, "Sarah met Boris on 2024-01-02"), (2, "nobody here")], "doc_id long, text string").write.parquet(docs)
    assert cli.main(["build", docs, graph], spark) == [f"saved {graph}"]
    assert json.loads(cli.main(["stats", graph], spark)[0])["value_nodes"] == 1
    assert cli.main(["query", graph, "when was 2024-01-02"], spark)[0].endswith("\t1")


def test_stores_migrate_forwards(spark):
    new = persist.empty_store(spark)
    assert set(new) == {n for v in persist.VERSIONS for n in v} and "importance" in new["atoms"].columns
    old = {"atoms": spark.createDataFrame([("a", "t", "atom", 1, "live")], persist.VERSIONS[0]["atoms"]), "edges": spark.createDataFrame([], persist.VERSIONS[0]["edges"])}
    tables, version = persist.migrated(spark, old, 0)
    assert version == 4 and tables["atoms"].first().project is None and tables["atoms"].schema == new["atoms"].schema
    with pytest.raises(ValueError):
        persist.migrated(spark, old, 5)


def test_index_cache_and_logs(spark, tmp_path):
    made = []
    make = lambda df: made.append(1) or df
    root = str(tmp_path / "cache")
    for k in (1, 1, 2, 3):
        vectors = spark.createDataFrame([(d, [float(d), float(k)]) for d in range(5)], "doc_id long, embedding array<float>")
        assert persist.cached_index(vectors.repartition(3), make, root).count() == 5
    assert len(made) == 3 and len(list((tmp_path / "cache").iterdir())) == 2
    lines = spark.createDataFrame([(k, k % 2 == 0) for k in range(120)], "query_id int, same_first boolean").coalesce(1)
    persist.append_shadow(lines, str(tmp_path / "log"))
    persist.append_shadow(lines, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 240
    persist.write_proposals(lines, str(tmp_path / "p"))
    assert sorted(len(f.read_text().splitlines()) for f in (tmp_path / "p").glob("*.json")) == [20, 50, 50]
    assert persist.select_index(31_000, True) == "flat" and persist.select_index(31_000, False) == "lists"


def test_scores_by_matrix_and_by_join(spark, monkeypatch):
    words = ["alpha", "beta", "gamma", "delta", "x-1", "y"]
    docs = spark.createDataFrame([(d, " ".join(RNG.choice(words) for _ in range(RNG.randint(0, 9)))) for d in range(40)], "doc_id long, text string")
    terms = spark.createDataFrame([(q, RNG.choice([*words, "none"])) for q in range(6) for _ in range(4)], "query_id int, term string")
    posts = ranking.Postings(docs, F.filter(F.split("text", " "), lambda w: w != ""))
    keep = docs.filter("doc_id % 3 <> 0").select("doc_id")
    for part in (ranking.bm25_plus(), ranking.bm25_fts()):
        one = {(r.query_id, r.doc_id): r.score for r in posts.score(terms, part, keep).collect()}
        best = {(r.query_id, r.doc_id) for r in ranking.top_by(posts.score(terms, part, keep, top=3), 3).collect()}
        with monkeypatch.context() as m:
            m.setattr(ranking, "MAX_ASKED", 3)
            other = {(r.query_id, r.doc_id): r.score for r in posts.score(terms, part, keep).collect()}
        assert one.keys() == other.keys() and all(abs(one[k] - other[k]) < 1e-8 for k in one)
        want = {(q, d) for q in range(6) for d in sorted((d for p, d in one if p == q), key=lambda d: (-one[q, d], d))[:3]}
        assert best == want
    assert posts.score(terms.limit(0), ranking.bm25_plus()).count() == 0


def test_dense_by_matrix_and_by_join(spark):
    rng = np.random.default_rng(0)
    vectors = spark.createDataFrame([(k, [float(x) for x in rng.normal(size=4 if k % 5 else 3)], k % 2) for k in range(60)] + [(99, None, 0)], "doc_id long, embedding array<double>, class_pos int")
    queries = vectors.filter("doc_id < 10 OR doc_id = 10").select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("q")).filter("size(q) = 4")
    for by in (("query_id",), ("query_id", "class_pos")):
        one = sorted(tuple(r) for r in ranking.dense_top(queries, vectors.filter("size(embedding) = 4"), 3, skip_own=True, by=by).collect())
        two = sorted(tuple(r) for r in ranking.dense_top(queries, vectors.filter("size(embedding) = 4"), 3, skip_own=True, max_components=10, by=by).collect())
        assert [r[:2] + r[3:] if len(r) == 5 else r for r in one] == [r[:2] + r[3:] if len(r) == 5 else r for r in two] and len(one) == 8 * 3 * len(by)
    pairs = {(r.a, r.b): r.similarity for r in ranking.similar_pairs(vectors.filter("size(embedding) = 4").select("doc_id", "embedding"), 0.6, max_components=50).collect()}
    own = {r.doc_id: np.array(r.embedding) for r in vectors.filter("size(embedding) = 4").collect()}
    cosine = lambda a, b: float(own[a] @ own[b] / np.linalg.norm(own[a]) / np.linalg.norm(own[b]))
    assert pairs.keys() == {(a, b) for a in own for b in own if a < b and cosine(a, b) >= 0.6} and all(abs(pairs[p] - cosine(*p)) < 1e-6 for p in pairs)


def test_association_and_supersession(spark):
    atoms = spark.createDataFrame([(k, f"t{k}", k, "live" if k != 4 else "superseded") for k in range(8)], "id long, text string, created_at long, status string")
    facets = spark.createDataFrame([(0, "tag", "a"), (1, "tag", "a"), (4, "tag", "a"), (2, "entity", "e"), (0, "entity", "e"), (3, "tag", "b")], "atom_id long, key string, value string")
    edges = spark.createDataFrame([(0, 5, 0.5), (5, 0, 0.4), (5, 6, 1.0), (7, 5, 0.5)], "src_atom long, dst_atom long, weight double")
    got = {r.doc_id: r.score for r in associate.association(spark.createDataFrame([(1, 0)], "query_id int, seed long"), facets, edges, atoms).collect()}
    assert got == {1: 0.5, 2: 0.5, 6: round(0.5 / 3, 9), 7: round(0.25 / 3, 9)}
    vectors = spark.createDataFrame([(k, [1.0, 0.001 * k]) for k in range(8)], "doc_id long, embedding array<double>")
    said = spark.createDataFrame([(1, "person-x")], "atom_id long, source string")
    pairs = lambda p: sorted((r.old_id, r.new_id) for r in associate.supersession_pairs(atoms, vectors, facets, p).collect())
    assert pairs(said.limit(0)) == [(0, 1), (0, 2)] and pairs(said) == [(0, 2)]


def test_model_family_is_known():
    assert [m[:2] for m in entities.Extractor(tuple(entities.REAL)).spans("we ran gpt-4 and llama 3") if m[1] == "model"]


def test_shared_top_counts_hubs_and_is_exact(spark):
    rng = np.random.default_rng(5)
    draw = lambda ids: {int(i): ([None, "p", "q", "r"][rng.integers(4)], {f"v{x}" for x in np.minimum(rng.zipf(1.3, rng.integers(1, 9)), 60)}) for i in ids}
    mine, theirs = draw(range(0, 1400, 2)), draw(range(1, 1400, 2))
    theirs |= {i: ("q", {"v1"}) for i in range(1401, 1440, 2)} | {1999: ("s", {"lone"})}  # equal sets, and one that no source shares
    n = {}
    for _, own in (*mine.values(), *theirs.values()):
        for x in own:
            n[x] = n.get(x, 0) + 1
    assert max(n.values()) > 500  # values of so many atoms were left out
    want = {}
    for m, (p, own) in mine.items():
        scores = [(-round(sum(1 / n[x] for x in own & has) + (0.05 if p and p == r else 0), 9), c) for c, (r, has) in theirs.items() if own & has]
        want[m] = [(c, -s) for s, c in sorted(scores) if -s >= 0.02][:3]
    frame = lambda rows, name: spark.createDataFrame([(i, p, x) for i, (p, own) in rows.items() for x in own], f"{name} long, project string, value string")
    degree = spark.createDataFrame(list(n.items()), "value string, n long")
    for sizes in ({}, {"max_others": 300, "max_own": 500}):
        got = {}
        for r in associate.shared_top(frame(mine, "query_id"), frame(theirs, "doc_id"), degree, **sizes).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.doc_id, r.score))
        for m, own in want.items():
            assert [c for c, _ in got.get(m, [])] == [c for c, _ in own] and np.allclose([s for _, s in got.get(m, [])], [s for _, s in own], atol=2e-9), m


def test_hubs_bring_proposals_as_in_the_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    from memloom.plans import registry

    rows = [(i, f"Common {'Rare' if i in (7, 14) else 'words'}", "de", "web", 12) for i in range(1, 700)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(7, [1.0, 0.0]), (14, [0.6, 0.8])], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(tuple(r) for r in registry.QUERIES["j16_edge_proposals"](spark, str(tmp_path)).collect())
    with duckdb.connect() as c:
        for name in ("documents", "labels", "embeddings"):
            c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
        want = sorted(c.execute(registry.ORACLES["j16_edge_proposals"]).fetchall())
    assert got == want and {r[0] for r in got} >= {8, 9, 10, 11, 16} and (7, 14) in {r[:2] for r in got}


def test_mentions_are_whole_words(spark):
    text = "\U0001d400Hello \U0001f600Smile Smile\U0001d400 Hello\nWorld\u00e9 \u00c9world World_ _World ABCDE9 ABCde AbTech-AbcD X1234 HelloTechs\n\nThere"
    rows = [(1, text), (2, text.replace("\U0001d400", "\u00e9").replace("\U0001f600", "-")), (3, None)]
    got = {}
    for r in entities.native_mentions(spark.createDataFrame(rows, "doc_id int, text string")).collect():
        got.setdefault(r.doc_id, []).append((r.label, r.etype))
    want = [("smile", "proper"), ("hello", "proper"), ("abcde9", "code"), ("abcde", "company"), ("abtech", "company"), ("abcd", "company"), ("hellotechs", "company"), ("there", "proper")]
    assert got == {1: want, 2: want}


def test_dense_top_of_large_batches(spark):
    rng = np.random.default_rng(2)
    x, q = rng.integers(-2, 3, (300, 3)).astype(float), rng.integers(-2, 3, (4100, 3)).astype(float)  # many ties
    frame = lambda a, names: spark.createDataFrame([(i, row) for i, row in enumerate(a.tolist())], names)
    got = {}
    for r in ranking.dense_top(frame(q, "query_id long, q array<double>"), frame(x, "doc_id long, embedding array<double>"), 5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.doc_id)
    assert [got[j] for j in range(len(q))] == np.argsort(-(x @ q.T), axis=0, kind="stable")[:5].T.tolist()
