import itertools
import re
import time
import zlib

import numpy as np
import pyarrow as pa

from memloom.llm import langid, pii, quality

GOOD = "A plain sentence about the river and the town stands here. It goes on for a while.\n"
BAD = "SHOUT!! NOW!! WIN!! CASH!! CLICK!! "


def test_quality_learns_and_takes_any_text(spark):
    texts = [(GOOD if k % 2 else BAD) * (1 + k % 20) for k in range(120)]
    model = quality.train(texts, [k % 2 for k in range(120)])
    scores = quality._score_texts(model, iter([GOOD * 3, BAD * 3, "", None, GOOD * 4000]))
    assert scores[0] > 0.5 > scores[1] and all(0 <= s <= 1 for s in scores) and len(scores) == 5
    docs = spark.createDataFrame([(k, t, k) for k, t in enumerate(texts)] + [(None, None, 1)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(k, k % 2) for k in range(120)], "doc_id long, quality int")
    rows = quality.score_quality(docs, quality.fit_quality(docs, labels)).collect()
    assert len(rows) == 121 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows if r.doc_id is not None)
    kept = quality.keep_quality(docs, model)
    assert kept.columns == docs.columns and 55 <= kept.count() <= 65
    assert quality.fit_quality(docs, labels.limit(0)).constant == 0.5


def test_attention_gradients():
    rng = np.random.default_rng(0)
    x, starts, y = rng.normal(size=(7, quality.N_FEATURES)), np.array([0, 3]), np.array([1.0, 0.0])
    p = {"W": rng.normal(size=(quality.N_FEATURES, 4)) / 9, "b": np.zeros(4), "V": rng.normal(size=(4, 3)), "U": rng.normal(size=(4, 3)), "w": rng.normal(size=3), "c": rng.normal(size=4), "d": np.zeros(1)}
    loss = lambda: -np.mean(y * np.log(s := quality._forward(p, x, starts)[0]) + (1 - y) * np.log(1 - s))
    g = quality._gradients(p, x, starts, y, 0.0)
    for k in p:
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        was = p[k][at]
        p[k][at] = was + 1e-6
        up = loss()
        p[k][at] = was - 1e-6
        down = loss()
        p[k][at] = was
        assert abs((up - down) / 2e-6 - g[k][at]) < 1e-4 * max(1, abs(g[k][at]))


def test_langid_learns_and_defines_odd_texts():
    texts = ["the river and the town here " * 4, "der fluss und die stadt hier " * 4] * 30
    model = langid.train(texts, ["en", "de"] * 30, epochs=4)
    names, scores = langid.predict(model, pa.array(["the town and the river", "die stadt und der fluss", None, "", "123 !!", "the " * 9000 + "x" * 5000]))
    assert names == ["en", "de", "und", "und", "und", "en"] and all(0 <= s <= 1 for s in scores)
    assert langid.predict(langid.train([], []), pa.array(["a"]))[0] == ["und"]


def test_langid_is_independent_of_batches():
    model = langid.train(["ab cd", "xy zw"] * 20, ["p", "q"] * 20)
    texts = ["ab xy " * n for n in (1, 2, 7, 8, 9, 60)] + ["é" * 24, "é" * 25, "a"]
    whole = model.pooled([t.encode() for t in texts])
    assert np.allclose(whole, [model.pooled([t.encode()])[0] for t in texts], atol=1e-6) and np.allclose(whole.sum(1), 1, atol=1e-5)
    # one position after the other, by the training's forward pass over the padded text
    for text, own in zip(texts, whole, strict=True):
        raw = text.encode()
        total = np.zeros(2)
        for at in range(0, len(raw), langid.CORE):
            window = (b" " * langid.MARGIN + raw + b" " * langid.WINDOW)[at : at + langid.WINDOW]
            probs = langid._tag(model.p, np.frombuffer(window, np.uint8)[None])[0][0]
            total += probs[langid.MARGIN : langid.MARGIN + min(langid.CORE, len(raw) - at)].sum(0)
        assert np.allclose(total / len(raw), own, atol=1e-4)


def test_langid_gradients():
    rng = np.random.default_rng(6)
    n = 3
    p = {"fx": rng.normal(0, 0.4, (256, 3 * n)), "fh": rng.normal(0, 0.4, (n, 3 * n)), "bx": rng.normal(0, 0.4, (256, 3 * n)), "bh": rng.normal(0, 0.4, (n, 3 * n)), "o": rng.normal(0, 0.4, (2 * n, 2)), "ob": np.zeros(2)}
    x, target, weight = rng.integers(97, 101, (4, 9)).astype(np.uint8), np.array([0, 1, 1, 0]), rng.random((4, 9))
    _, g = langid.gradients(p, x, target, weight)
    for k in p:
        for at in itertools.islice(zip(*np.unravel_index(np.argsort(-np.abs(g[k]).ravel()), g[k].shape), strict=True), 3):
            was = p[k][at]
            p[k][at] = was + 1e-6
            up = langid.gradients(p, x, target, weight)[0]
            p[k][at] = was - 1e-6
            down = langid.gradients(p, x, target, weight)[0]
            p[k][at] = was
            assert abs((up - down) / 2e-6 - g[k][at]) < 1e-4 * max(1, abs(g[k][at])), (k, at)


def test_langid_over_a_table(spark):
    words = {"en": "the river and the town here are old ", "de": "der fluss und die stadt hier sind alt "}
    rows = [(k, words["en" if k % 2 else "de"] * (1 + k % 9), "en" if k % 2 else "de", "s", 1.0) for k in range(120)]
    rows += [(500, None, "en", "s", 1.0), (501, "", "en", "s", 1.0), (502, "12 345 !", "en", "s", 1.0), (503, words["en"] * 4000, None, "s", 1.0), (None, words["de"], "de", "s", 1.0), (1, rows[1][1], "en", "s", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double")
    got = langid.identify_language(docs, langid.fit_langid(docs)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 200]
    assert all(r.lang_pred == ("en" if r.doc_id % 2 else "de") for r in held) and len(held) >= 20
    assert {r.doc_id: r.lang_pred for r in got if r.doc_id in (500, 501, 502, 503)} == {500: "und", 501: "und", 502: "und", 503: "en"}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    empty = docs.limit(0)
    assert langid.identify_language(empty, langid.fit_langid(empty)).count() == 0


def test_base_patterns():
    text = "a@b.co, x@y (z@q.r.s) 10.0.0.255 999.1.1.1 then 4111 1111 1111 1111 and 4111111111111112 or +1 (743) 555-3824 +123 @ b@@c.de"
    spans = pii.base_spans(text)
    plain = []
    for kind in pii.KINDS:
        plain += [(kind, *m.span()) for m in pii._BASE[kind].finditer(text) if pii._holds(kind, m.group())]
    assert spans == sorted(plain, key=lambda s: (s[1], pii.KINDS.index(s[0])))
    assert [text[a:b] for k, a, b in spans if k == "card"] == ["4111 1111 1111 1111"]
    assert pii.base_spans("") == []
    rng = np.random.default_rng(1)
    for _ in range(300):
        odd = "".join(rng.choice(list("0123.. -+5(")) for _ in range(40))
        plain = [(k, *m.span()) for k in pii.KINDS for m in pii._BASE[k].finditer(odd) if pii._holds(k, m.group())]
        assert pii.base_spans(odd) == sorted(plain, key=lambda s: (s[1], pii.KINDS.index(s[0]))), odd
    begin = time.time()
    pii.base_spans("1" * 300_000)
    assert time.time() - begin < 5
    # neighbouring numbers are one match, which fails as a whole: no retries
    assert pii.base_spans("4111 1111 1111 1111 4111111111111112") == []


def test_tagger_gradients_and_additions():
    rng = np.random.default_rng(3)
    texts = ["some words stand here and more of them follow soon after that " * 3] * 5
    x, y = pii.training_windows(texts, made=40)
    p = pii.train(texts, hidden=4, epochs=1)
    _, g = pii.gradients(p, x[:3], y[:3])
    for k in ("fx", "bh", "o", "trans"):
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        was = p[k][at]
        p[k][at] = was + 1e-5
        up = pii.gradients(p, x[:3], y[:3])[0]
        p[k][at] = was - 1e-5
        down = pii.gradients(p, x[:3], y[:3])[0]
        p[k][at] = was
        assert abs((up - down) / 2e-5 - g[k][at]) < 1e-4
    base = [("email", 5, 10)]
    assert pii.all_spans(base, [("phone", 8, 12), ("ip", 20, 27)]) == [*base, ("ip", 20, 27)]
    assert rng is not None and pii.tagged_spans(p, ["", "no trigger at all"]) == [[], []]


def test_best_tags_and_marginals_by_force():
    rng = np.random.default_rng(4)
    k, length = 3, 4
    e, trans = rng.normal(size=(2, length, k)), rng.normal(size=(k, k))
    best = pii._viterbi(e, trans)
    z, tags, pairs = pii._marginals(e, trans)
    summed = np.zeros((k, k))
    for row in range(2):
        paths = list(itertools.product(range(k), repeat=length))
        score = np.array([sum(e[row, t, q] for t, q in enumerate(path)) + sum(trans[a, b] for a, b in itertools.pairwise(path)) for path in paths])
        assert tuple(best[row]) == paths[score.argmax()] and abs(np.log(np.exp(score).sum()) - z[row]) < 1e-9
        share = np.exp(score - z[row])
        for t in range(length):
            for q in range(k):
                assert abs(share[[path[t] == q for path in paths]].sum() - tags[row, t, q]) < 1e-9
        for w, path in zip(share, paths, strict=True):
            for a, b in itertools.pairwise(path):
                summed[a, b] += w
    assert np.allclose(summed, pairs)


def test_pieces_of_overlapping_windows():
    join = lambda *x: {(a, b) for _, a, b, _ in pii._joined([("email", a, b, 0.9, left, right) for a, b, left, right in x])}
    assert join((5, 20, False, False)) == {(5, 20)}
    assert join((5, 64, False, True)) == set()
    assert join((30, 64, False, True), (30, 88, False, True), (48, 95, True, False)) == {(30, 95)}
    assert join((0, 30, True, False), (70, 90, False, False)) == {(70, 90)}


PLAIN = ["some words stand here and more of them follow soon after that, on 3 days of 2019 and in 14 places " * 3, "a plain text of its own kind goes on and on without end or aim " * 5] * 10


def test_tagger_adds_what_patterns_miss(spark):
    p = pii.train(PLAIN)
    seen = pii.measure(p, PLAIN, 600)
    assert seen["recall_of_missed"] > 0.5 and seen["precision"] > 0.95, seen
    texts = ["more words stand here +1 (826) 555-4081 190.137.223.204 and soon after", "write to first.last.dept (at) sub.long-domain.example.com or call (555) 123-4567 today", "nothing here but 12 days of 2019"]
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, spans int")
    rows = {r.doc_id: r for r in pii.find_pii(docs, p).collect()}
    shown = {k: [(x.split(":")[0], texts[k][int(x.split(":")[1]) : int(x.split(":")[2])]) for x in r.spans.split(",") if x] for k, r in rows.items()}
    assert any(kind == "phone" and found.endswith("(826) 555-4081") for kind, found in shown[0]) and ("ip", "190.137.223.204") in shown[0]
    assert ("email", "first.last.dept (at) sub.long-domain.example.com") in shown[1]
    assert rows[0].n_added >= 1 and rows[0].n_phone == 0 and rows[2].n_spans == 0 and all(len(v) == rows[k].n_spans for k, v in shown.items())


def test_find_pii_on_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "mail a@b.co", 1), (2, "mail a@b.co", 1), (None, "x" * 50_000, 1)], "doc_id long, text string, n_email long")
    model = pii.train(["call +1 (743) 555-3824 now"], hidden=4, epochs=1)
    rows = pii.find_pii(docs, model).collect()
    assert sorted(r.n_email for r in rows) == [0, 0, 1, 1] and len(rows) == 4
    assert pii.find_pii(docs.limit(0), model).count() == 0
    fitted = pii.fit_pii(docs)
    assert fitted["fh"].shape == (24, 96)


def test_samples_are_bounded(spark):
    from memloom.llm._common import bounded_sample

    docs = spark.createDataFrame([(k % 50, "x" * (k % 7)) for k in range(200)] + [(99, "y" * 1000)], "doc_id long, text string")
    rows = bounded_sample(docs, 60, 100)
    assert len({(r.doc_id, r.text) for r in rows}) == len(rows) and 0 < sum(len(r.text) for r in rows) <= 100
    assert re.fullmatch("[xy]*", "".join(r.text for r in rows)) and rows == bounded_sample(docs.repartition(7), 60, 100)
    assert bounded_sample(docs.limit(0), 10, 10) == []
