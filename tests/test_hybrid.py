"""Hybrids, learning from gaps, context, mined cases, the benchmark and inverted lists."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from memloom.operators import cases, graph, hybrid, inverted, models, ranking, store


def test_agreement_weights(spark):
    a = spark.createDataFrame([(1, 1, 1), (1, 2, 2)], "query_id int, doc_id int, rank int")
    b = spark.createDataFrame([(1, 2, 1), (1, 3, 2)], "query_id int, doc_id int, rank int")
    got = {r.doc_id: (r.score, r.source) for r in ranking.agreement_merge(a, b).collect()}
    assert got == {1: (30.0, "graph"), 2: (150.0, "both"), 3: (25.0, "dense")}
    with pytest.raises(ValueError):
        ranking.agreement_merge(a, b, dense_only=20)


def test_two_stage_falls_back(spark):
    hits = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 99, 1)], "query_id int, doc_id int, rank int")
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0])], "query_id int, q array<float>")
    x = spark.createDataFrame([(10, [0.1, 0.0]), (11, [0.9, 0.0]), (12, [1.0, 2.0])], "doc_id int, embedding array<float>")
    got = {(r.query_id, r.doc_id): r.source for r in hybrid.two_stage(hits, q, x).collect()}
    assert got[1, 10] == got[1, 11] == "both" and (1, 12) not in got  # candidates only
    assert got[2, 99] == "graph" and got[2, 12] == "dense" and got[3, 12] == "dense"
    wary = {(r.query_id, r.doc_id) for r in hybrid.two_stage(hits, q, x, spark.createDataFrame([(1,)], "query_id int")).collect()}
    assert (1, 12) in wary
    none = hybrid.two_stage(hits, q, x, fall_back=False).filter("query_id = 3").count()
    assert none == 0


def test_gaps_are_learnt_and_injected(spark):
    q = spark.createDataFrame([(1, "zeppelin hangar"), (2, "known thing")], "query_id int, query_text string")
    g = spark.createDataFrame([(2, 5, 1.0)], "query_id int, doc_id int, score double")
    d = spark.createDataFrame([(1, 7, 1), (2, 7, 1)], "query_id int, doc_id int, rank int")
    docs = spark.createDataFrame([(5, "nothing"), (7, "Two zeppelins"), (8, "a ZEPPELIN HANGAR"), (9, None)], "doc_id int, text string")
    learned = hybrid.learn_gaps(q, g, d, docs)
    assert {r.term: (r.frequency, r.first_query) for r in learned.collect()} == {"zeppelin": (2, 1), "hangar": (1, 1), "zeppelin hangar": (1, 1)}
    got = {(r.query_id, r.doc_id, r.score) for r in hybrid.inject_learned(g, q, learned, docs).collect()}
    assert got == {(2, 5, 1.0), (1, 7, 0.5), (1, 8, 0.5)}
    assert hybrid.inject_learned(g, q, learned.limit(0), docs).count() == 1
    assert hybrid.learn_gaps(q, g, d, docs, least=2).count() == 1
    heard = []
    assert hybrid.learn_gaps(q, g, d, docs, on_learn=heard.append).count() == 3
    assert [(h["term"], h["frequency"]) for h in heard] == [("hangar", 1), ("zeppelin", 2), ("zeppelin hangar", 1)]


def test_context_keeps_the_first_place(spark):
    q = spark.createDataFrame([(1, "about Alpha"), (2, "x")], "query_id int, query_text string")
    recent = spark.createDataFrame([(1, 1, "Beta"), (1, 2, "alpha")], "query_id int, pos int, label string")
    near = spark.createDataFrame([(1, 1, "gamma"), (1, 2, "BETA")], "query_id int, pos int, label string")
    active = spark.createDataFrame([(1, "gamma"), (2, "delta")], "pos int, label string")
    rows = hybrid.context_for(q, recent, near, active).orderBy("query_id", "pos").collect()
    assert [(r.query_id, r.label) for r in rows] == [(1, "beta"), (1, "gamma"), (1, "delta"), (2, "gamma"), (2, "delta")]
    assert hybrid.context_for(q, recent, near, active, 1).filter("query_id = 1").first().label == "beta"


def test_mining_finds_what_context_resolves(spark):
    rows = [(1, "atlas", "t"), (2, "atlas", "t"), (1, "alpha", "t"), (2, "beta", "t"), (3, "solo", "t")]
    g = graph.EntityGraph(spark.createDataFrame(rows, "doc_id long, label string, etype string"))
    got = cases.mine(g, cases.frequent_labels(g)).collect()
    assert [(r.query, r.baseline_top, r.recovery_context, r.recovery_top, r.recovery_confidence) for r in got] == [("atlas", 1, ["alpha"], 1, "high")]
    two = cases.mined_cases(cases.mine(g, cases.frequent_labels(g))).collect()
    assert {(r.case_id, r.reliable) for r in two} == {("mined-atlas-ambiguous", False), ("mined-atlas-alpha", True)}


def test_built_in_benchmark(spark):
    g, values, asked = cases.built_in(spark)
    reports = cases.benchmark(g, values, asked)
    got = {r.case_id: r for r in reports.collect()}
    assert len(got) == 6 and all(r.should_trust == r.reliable and r.correct in (None, True) for r in got.values())
    assert got["nonsense-query"].recommended_action == "no_result" and got["ambiguous-no-context"].recommended_action == "request_context"
    s = cases.summary(reports).first()
    assert (s.total_cases, s.answerable_cases, s.top1_accuracy, s.unreliable_recall, s.reliable_false_positive_rate) == (6, 4, 1.0, 1.0, 0.0)


def test_inverted_lists_recall(spark, tmp_path):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 16)) + 3 * rng.normal(size=(20, 16))[rng.integers(20, size=1500)]
    vectors = spark.createDataFrame([(k, [float(v) for v in row]) for k, row in enumerate(x)] + [(9999, None)], "doc_id int, embedding array<float>")
    queries = vectors.filter("doc_id % 50 = 0").selectExpr("doc_id AS query_id", "embedding AS q")
    centres = inverted.learn_centres(vectors)
    assert len(centres) == inverted.list_count(1500) == 38 and inverted.list_count(10**9) == 256
    index = inverted.write_index(vectors, centres, str(tmp_path / "lists"))
    assert index.count() == 1500
    exact = {(r.query_id, r.doc_id) for r in ranking.dense_top(queries, vectors.filter("embedding IS NOT NULL"), 10).collect()}
    near = {(r.query_id, r.doc_id) for r in inverted.search(index, centres, queries, 10).collect()}
    every = {(r.query_id, r.doc_id) for r in inverted.search(index, centres, queries, 10, probes=38).collect()}
    assert every == exact and len(near & exact) / len(exact) >= 0.9
    assert inverted.search(inverted.assign(vectors.limit(0), inverted.learn_centres(vectors.limit(0))), np.zeros((0, 0)), queries).count() == 0


def test_rerank(spark):
    hits = spark.createDataFrame([(1, 10, 5.0, 1), (1, 11, 4.0, 2), (1, 12, 3.0, 3)], "query_id int, doc_id int, score double, rank int")
    q = spark.createDataFrame([(1, "red fox")], "query_id int, query_text string")
    texts = spark.createDataFrame([(10, None), (11, "a red hen"), (12, "x" * 512 + " red fox")], "doc_id int, text string")
    blend = models.rerank_blend(hits, q, texts).collect()
    assert [(r.doc_id, round(r.score, 6)) for r in blend] == [(11, 4.6), (10, 2.0), (12, 1.2)]
    assert [r.doc_id for r in models.rerank_replace(hits, q, texts).orderBy("rank").collect()] == [12, 11, 10]
    assert models.rerank_replace(hits.limit(0), q, texts).count() == 0
    with pytest.raises(Exception, match="no text for candidate"):
        models.rerank_replace(hits, q, texts.filter("doc_id <> 10")).collect()


def test_embed_missing_is_idempotent(spark):
    atoms = spark.createDataFrame([(1, "a c", "live"), (2, None, "live"), (3, "c", "tombstone"), (4, "d", "live")], "id long, text string, status string")
    have = spark.createDataFrame([(4, "m", [1.0]), (1, "other", [1.0])], "atom_id long, model_id string, embedding array<float>")
    new = models.embed_missing(atoms, have, "m")
    got = {r.atom_id: r.embedding for r in new.collect()}
    assert set(got) == {1, 2} and abs(sum(x * x for x in got[1]) - 1) < 1e-6 and not any(got[2])
    assert models.embed_missing(atoms, have.unionByName(new), "m").count() == 0


def test_verdicts_apply_in_order_and_roll_back(spark):
    edges = spark.createDataFrame([(1, 2, 0.5, None)], "src_atom long, dst_atom long, weight double, campaign string")
    atoms = spark.createDataFrame([(k,) for k in (1, 2, 3)], "id long")
    rows = [(1, 2, 1, True, 0.9), (2, 3, 1, True, 0.1), (3, 3, 1, True, None), (4, 9, 1, True, 0.5), (5, None, 1, True, 0.5), (6, 3, 2, False, 0.5)]
    verdicts = spark.createDataFrame(rows, "pos long, mem_id long, chunk_id long, keep boolean, confidence double")
    new = store.apply_verdicts(edges, verdicts, atoms, "c")
    assert {tuple(r) for r in new.collect()} == {(1, 2, 0.9, None), (1, 3, 1.0, "c")}
    assert {r.outcome: r.n for r in store.verdict_report(edges, verdicts, atoms).collect()} == {"updated": 2, "written": 1, "missing": 1, "malformed": 1, "rejected": 1}
    assert {tuple(r) for r in store.rollback_campaign(new, "c").collect()} == {(1, 2, 0.9, None)}


def test_the_active_model_stays(spark):
    none = spark.createDataFrame([], "atom_id long, model_id string")
    with pytest.raises(ValueError, match="active"):
        store.drop_model(none, none, "m", "m")


def test_large_batches_multiply_blocks(spark):
    rng = np.random.default_rng(4)
    rows = [(k, [float(x) for x in rng.integers(-3, 4, 8 if k % 11 else 4)], k % 3) for k in range(300)] + [(300, None, 0)]
    vectors = spark.createDataFrame(rows, "doc_id long, embedding array<double>, class_pos int")
    queries = vectors.filter("doc_id % 5 = 0 AND embedding IS NOT NULL").select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("q"))
    for skip_own, by in ((False, ("query_id",)), (True, ("query_id",)), (True, ("query_id", "class_pos"))):
        small = ranking.dense_top(queries, vectors, 4, skip_own, by=by)
        large = ranking.dense_top(queries, vectors, 4, skip_own, max_components=100, by=by)
        assert "aggregate(" not in large._jdf.queryExecution().optimizedPlan().toString()
        assert sorted(map(tuple, large.select(*small.columns).collect())) == sorted(map(tuple, small.collect()))
