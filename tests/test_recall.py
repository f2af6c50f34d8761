"""The switches of the recall: rerank, an auxiliary list, enrichment within the budget."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from memloom.functions import text as tx
from memloom.operators import enrich, models, recall, store, trust

LINES = "query_id long, doc_id long, position int, confidence double, should_trust boolean, handle string, entry string, extra array<string>"


def tokens(text):
    return -(-len(text) // 3)


def by_hand(rows, budget):
    """Entries with the extras that fit, one after another."""
    emitted, chosen = [], {}
    for _, doc, _, _, trusted, handle, entry, extra in rows:
        own = handle
        if trusted:
            left = budget - (tokens("\n\n".join(emitted)) + 1 if emitted else 0)
            kept = list(extra or [])
            while kept and tokens("\n".join([entry, *kept])) > left:
                kept.pop()
            own = "\n".join([entry, *kept])
            chosen[doc] = own
        emitted.append(own)
    return chosen


def test_attachments_go_first(spark):
    rows = [
        (1, 1, 1, 0.9, True, "h1", "entry one", ["at f#L1-2", "relates -> p3://9 nine", "relates -> p3://8 eight"]),
        (1, 2, 2, 0.8, False, "h2", "entry two", ["at g#L1-2"]),
        (1, 3, 3, 0.7, True, "h3", "entry three", None),
        (1, 4, 4, 0.7, True, "h4", "entry four", ["relates -> p3://7 seven", "x" * 40]),
    ]
    lines = spark.createDataFrame(rows, LINES)
    for budget in (0, 3, 8, 12, 20, 27, 30, 34, 36, 50, 500):
        got = {r.doc_id: r.entry for r in trust.enriched(lines, budget).collect()}
        assert {d: got[d] for d in (1, 3, 4)} == by_hand(rows, budget), budget
        assert got[2] == "entry two"
        assert trust.payloads(trust.enriched(lines, budget), budget).first().tokens <= budget
    bare = trust.payloads(lines.drop("extra"), 12).first().payload
    assert trust.payloads(trust.enriched(lines, 12), 12).first().payload.startswith("entry one") and bare.startswith("entry one")
    assert trust.enriched(lines.limit(0)).count() == 0


def test_tiers():
    assert store.tier_defaults("L2")[1:] == (False, True) and store.tier_defaults("L3") == (None, False, True)
    assert recall.Request().enrich is True and recall.Request(enrich=False).enrich is False and recall.Request(rerank=True).rerank is True
    with pytest.raises(ValueError):
        recall.Request(tier="L4")


def broken(texts):
    raise ConnectionError("no model")


def test_embedder_that_fails_adds_nothing(spark):
    q = spark.createDataFrame([(1, "a b"), (2, None)], "query_id long, query_text string")
    assert models.embedded_queries(q, broken).count() == 0
    assert models.embedded_queries(q, lambda t: np.ones((1, 3))).count() in (0, 2)
    assert {r.query_id: len(r.q) for r in models.embedded_queries(q, models.hashed_words).collect()} == {1: 64, 2: 64}


def test_rerank_keeps_the_tail(spark):
    ordered = spark.createDataFrame([(1, d, float(10 - d), d, 0) for d in range(1, 7)], "query_id long, doc_id long, score double, position int, class_pos int")
    atoms = spark.createDataFrame([(1, "x"), (2, "red"), (3, "red fox"), (4, "red fox"), (5, "red fox"), (6, None)], "id long, text string")
    asked = spark.createDataFrame([(1, "red fox")], "query_id long, query_text string")
    got = recall.reranked(ordered, asked, atoms, models.word_share, 4).orderBy("position").collect()
    assert [(r.doc_id, r.position, r.score) for r in got] == [(3, 1, 1.0), (4, 2, 1.0), (2, 3, 0.5), (1, 4, 0.0), (5, 5, 5.0), (6, 6, 4.0)]


@pytest.fixture(scope="module")
def memory(spark):
    now = 1_700_000_000
    texts = {1: ("red fox runs", "document_chunk"), 2: ("red fox sleeps", "atom"), 3: ("blue whale", "narrative"), 4: ("green tree", "atom"), 5: ("fox tail", "snapshot")}
    atoms = spark.createDataFrame([(i, t, k, "p", now, now, 0.5, "live") for i, (t, k) in texts.items()], "id long, text string, kind string, project string, created_at long, occurred_at long, importance double, status string")
    provenance = spark.createDataFrame([(i, "bulk" if i == 1 else "explicit-emit", "a", f"f{i}#x", now) for i in texts], "atom_id long, source string, agent string, source_ref string, recorded_at long")
    facets = spark.createDataFrame([(1, "entity", "fox"), (2, "entity", "fox"), (5, "entity", "fox"), (1, "entity", "red"), (2, "entity", "red"), (3, "entity", "whale")], "atom_id long, key string, value string")
    vectors = spark.createDataFrame([(i, [1.0, float(i)]) for i in texts], "doc_id long, embedding array<double>")
    files = spark.createDataFrame([("f1", "top\nred fox\nruns\n")], "source_ref string, text string")
    none = spark.createDataFrame([], "src_atom long, dst_atom long")
    return recall.Memory(atoms, provenance, facets, none, vectors, None, files)


def test_attachments(spark, memory):
    results = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "query_id long, doc_id long")
    got = {r.doc_id: r.extra for r in enrich.attachments(results, memory.atoms, memory.provenance, memory.facets, None, memory.files).collect()}
    assert got == {1: ["at f1#L2-3", "relates -> p3://2 red fox sleeps", "relates -> p3://5 fox tail"]}
    edges = spark.createDataFrame([(1, 4, "relates", 0.5), (1, 3, "cites", 0.9)], "src_atom long, dst_atom long, type string, weight double")
    got = {r.doc_id: r.extra for r in enrich.attachments(results, memory.atoms, memory.provenance, memory.facets, edges).collect()}
    assert got == {1: ["relates -> p3://4 green tree"]}
    assert enrich.attachments(results.limit(0), memory.atoms, memory.provenance, memory.facets, edges, memory.files).count() == 0


def test_whole_recall_with_all_switches(spark, memory):
    asked = spark.createDataFrame([(1, "red fox", [1.0, 0.0]), (2, " ", None)], "query_id long, query_text string, q array<double>")
    labels = spark.createDataFrame([(1, "fox")], "query_id long, label string")
    own = memory.atoms.select(F.col("id").alias("query_id"), F.col("text").alias("query_text"))
    vectors = models.embedded_queries(own, models.hashed_words).select(F.col("query_id").alias("doc_id"), F.col("q").alias("embedding"))
    req = recall.Request(tier="L3", rerank=True)
    results, payloads = recall.answer(memory, asked, labels, 1_700_000_000, req, recall.Auxiliary(models.hashed_words, vectors))
    first = results.orderBy("position").collect()
    assert {r.doc_id for r in first[:2]} == {1, 2} and {r.query_id for r in first} == {1}
    text = payloads.first().payload
    assert "at f1#L2-3" in text and "relates -> p3://2 red fox sleeps" in text
    plain = recall.payload(memory, results)
    assert "relates ->" not in plain.first().payload
    failed = recall.recall(memory, asked, labels, 1_700_000_000, req, recall.Auxiliary(broken, vectors)).collect()
    without = recall.recall(memory, asked, labels, 1_700_000_000, req).collect()
    assert sorted(failed) == sorted(without)


def test_frequent_terms_count_in_large_stores(spark, memory):
    ids = spark.range(10_001).withColumn("text", F.when(F.col("id") == 7, "common rare").otherwise("common"))
    columns = {"kind": F.lit("atom"), "project": F.lit("p"), "created_at": F.lit(1), "occurred_at": F.lit(1), "importance": F.lit(0.5), "status": F.lit("live")}
    large = recall.Memory(ids.withColumns(columns), memory.provenance, memory.facets, memory.supersedes, memory.vectors.limit(0))
    asked = spark.createDataFrame([(1, "common rare", None)], "query_id long, query_text string, q array<double>")
    ranks = lambda **more: [r.doc_id for r in recall.signals(large, asked, recall.Request(per_signal=4, **more)).orderBy("rank").collect()]
    assert ranks() == [7, 0, 1, 2]
    assert ranks(prune=True) == [7]


def test_rounding_is_that_of_the_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    values = [0.0040899725, 0.0020093775, 1.0000000005, -0.0040899725, 0.5, 2.5, 0.0, 1e-10]
    x = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double")
    got = [r.v for r in x.select("k", tx.rounded("v", 9).alias("v")).orderBy("k").collect()]
    assert got == [duckdb.execute("SELECT round(?::DOUBLE, 9)", [v]).fetchone()[0] for v in values]
    assert got[0] == 0.004089972


def test_all_terms_of_a_query_count(spark, memory):
    asked = spark.createDataFrame([(1, "word " * 70 + "whale", None)], "query_id long, query_text string, q array<double>")
    found = lambda **more: [r.doc_id for r in recall.signals(memory, asked, recall.Request(**more)).collect()]
    assert found() == [3] and found(first_terms=64) == []


@pytest.fixture(scope="module")
def long_queries(spark, tmp_path_factory):
    """Tables whose queries have 100 words each."""
    root, rng = tmp_path_factory.mktemp("long"), np.random.default_rng(3)
    words = np.array([f"{'W' if k % 5 == 0 else 'w'}ord{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(150)])
    text = lambda n: " ".join(rng.choice(words, n))
    tables = {
        "documents": ([(i, text(20), "en", "web", 140 + i) for i in range(60)], "doc_id long, text string, lang string, source string, n_chars long"),
        "labels": ([(i, i % 2) for i in range(60)], "doc_id long, quality int"),
        "embeddings": ([(i, rng.normal(size=4).tolist()) for i in range(60)], "vec_id long, embedding array<float>"),
        "benchmark": ([(i, text(100)) for i in range(3)], "item_id long, text string"),
    }
    for name, (rows, columns) in tables.items():
        spark.createDataFrame(rows, columns).write.parquet(f"{root}/{name}.parquet")
    return str(root)


@pytest.mark.parametrize("name", ["r24_recall", "r24_recall_reranked"])
def test_long_queries_as_in_the_sql(spark, long_queries, name):
    duckdb = pytest.importorskip("duckdb")
    from memloom.plans import registry

    assert "[1:64]" not in registry.ORACLES[name] and "[1:64]" in registry.ORACLES["r25_records"]
    got = sorted(tuple(r) for r in registry.QUERIES[name](spark, long_queries).collect())
    with duckdb.connect() as c:
        for table in ("documents", "labels", "embeddings", "benchmark"):
            c.execute(f"CREATE VIEW {table} AS SELECT * FROM '{long_queries}/{table}.parquet/*.parquet'")
        assert got == sorted(c.execute(registry.ORACLES[name]).fetchall()) and len(got) == 30
