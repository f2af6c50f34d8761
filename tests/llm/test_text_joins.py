import hashlib
import random

import numpy as np

from memloom.llm import chat, components, decontam, line_dedup, maxscore, simhash

RNG = random.Random(4)
WORDS = ["".join(RNG.choice("abcdefgh") for _ in range(RNG.randint(2, 7))) for _ in range(400)]


def words(n):
    return [RNG.choice(WORDS) for _ in range(n)]


# ---- line dedup ---------------------------------------------------------------


def brute_lines(docs, least):
    """A line goes if a block of lines around it, of least words or more, also begins earlier."""
    rows = sorted(docs)
    blocks, full = {}, {}
    for d, text in rows:
        own = [(n, " ".join(x.split())) for n, x in enumerate((text or "").split("\n"))]
        own = full[d] = [x for x in own if x[1]]
        for i in range(len(own)):
            for j in range(i, len(own)):
                blocks.setdefault(tuple(s for _, s in own[i : j + 1]), []).append((d, i))
    gone = {d: set() for d, _ in rows}
    for block, places in blocks.items():
        if sum(len(s.split()) for s in block) >= least:
            for d, i in places:
                if (d, i) > min(places):
                    gone[d] |= {full[d][k][0] for k in range(i, i + len(block))}
    return gone


def test_lines_match_brute_force(spark):
    lines = [" ".join(words(n)) for n in (3, 5, 8, 12, 4, 6, 2, 15, 7, 9)]
    docs = [(d, "\n".join(RNG.choice(lines) if RNG.random() < 0.8 else " ".join(words(4)) for _ in range(RNG.randint(1, 9)))) for d in range(60)]
    docs += [(60, lines[7]), (61, "\n\n" + lines[7] + "\n"), (62, ""), (63, "\n".join([lines[3]] * 6))]
    gone = brute_lines(docs, 14)
    df = spark.createDataFrame([(d, t, "k") for d, t in docs] + [(None, None, "k")], "doc_id long, text string, n_lines string")
    got = {r.doc_id: r for r in line_dedup.dedup_lines(df, min_words=14).collect()}
    for d, text in docs:
        own = text.split("\n")
        kept = [x for n, x in enumerate(own) if n not in gone[d]]
        want = text if not gone[d] else "" if not any(x.strip() for x in kept) else "\n".join(kept)
        assert got[d].text == want, d
        assert got[d].line_dedup.n_removed == len(gone[d]) and got[d].line_dedup.n_words == len(text.split())
    assert got[None].text is None and line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_lines_by_pairs_and_by_stretches(spark):
    lines = [" ".join(words(n)) for n in (1, 1, 2, 3, 5, 8, 12, 30)]
    docs = [(d, "\n".join(RNG.choice(lines) if RNG.random() < 0.9 else " ".join(words(2)) for _ in range(RNG.randint(1, 14)))) for d in range(50)]
    gone = brute_lines(docs, 14)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for few in (0, 3, 10**9):
        rows = {r.d: len(r.gone) for r in line_dedup.repeated_lines(df, 14, few=few).collect()}
        assert rows == {d: len(g) for d, g in gone.items() if g}, few
    # names that the operator uses itself, and one text of very many lines
    odd = spark.createDataFrame([(1, "x", 7, "y", [1]), (2, None, 8, "z", None)], "doc_id long, text string, raw int, gone string, row array<int>")
    assert [tuple(r)[:5] for r in line_dedup.dedup_lines(odd).orderBy("doc_id").collect()] == [tuple(r) for r in odd.collect()]
    long = "\n".join(f"line {k} of a text" for k in range(20_000))
    cut = line_dedup.dedup_lines(spark.createDataFrame([(1, long), (2, long + "\nend")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert cut[0].text == long and cut[1].text == "end"


def test_equal_rows_stay(spark):
    text = " ".join(words(60))
    rows = line_dedup.dedup_lines(spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text) for r in rows) == [(1, text), (1, text), (2, "")]


# ---- SimHash --------------------------------------------------------------------


def groups_by_force(prints, radius=4):
    root = {p: p for p in prints}

    def top(p):
        while root[p] != p:
            p = root[p]
        return p

    own = sorted(root)
    for i, a in enumerate(own):
        for b in own[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                root[top(a)] = top(b)
    return {p: top(p) for p in own}


def test_near_duplicates_match_brute_force(spark):
    base = [words(60) for _ in range(25)]
    docs = []
    for w in base:
        for _ in range(RNG.randint(1, 5)):
            own = list(w)
            if RNG.random() < 0.7:
                own[RNG.randrange(60)] = RNG.choice(WORDS)
            docs.append((len(docs), " ".join(own)))
    docs += [(900, None), (901, ""), (902, " \n"), (903, "one two"), (904, "ONE  two"), (905, "one two"), (905, "one two")]
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, component_id long")
    rows = simhash.near_duplicates(df).collect()
    prints = {d: simhash.fingerprint(t) for d, t in docs}
    group = groups_by_force(set(prints.values()))
    least = {}
    for d, p in prints.items():
        least[group[p]] = min(d, least.get(group[p], d))
    assert len(rows) == len(docs)
    for r in rows:
        assert r.fingerprint == f"{prints[r.doc_id]:016x}" and r.component_id == least[group[prints[r.doc_id]]]
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_tiles_find_every_group(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**62, 300)
    near = [int(b) ^ (1 << int(rng.integers(62))) ^ (1 << int(rng.integers(62))) for b in base for _ in range(3)]
    prints = sorted({*map(int, base), *near})
    links = simhash.near_links(spark.createDataFrame([(p, [p]) for p in prints], "node long, words array<long>"), tile=64).collect()
    want = groups_by_force(prints)
    root = {r.node: r.root for r in components.smallest_reachable(spark.createDataFrame(links, "a long, b long")).collect()}
    sets = lambda m: sorted(sorted(p for p in m if m[p] == t) for t in set(m.values()))
    assert sets({p: root.get(p, p) for p in prints}) == sets(want)


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(500, 501), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components.smallest_reachable(links).collect()}
    assert all(got[k] == 0 for k in range(201)) and got[501] == 500


# ---- MaxScore --------------------------------------------------------------------


def test_search_matches_brute_force(spark):
    rng = np.random.default_rng(2)
    vecs = rng.integers(-40, 41, (300, 16))
    vecs[100:160] = vecs[100]
    rows = [(k, [int(x) for x in v]) for k, v in enumerate(vecs)]
    df = spark.createDataFrame(rows, "vec_id long, v array<int>")
    got = maxscore.search(df, df.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), k=5, components=1000).collect()
    want = set()
    for q in range(0, 300, 20):
        best = sorted(((-int(vecs[q] @ vecs[k]), k) for k in range(300) if k != q))[:5]
        want |= {(q, n + 1, k, -s) for n, (s, k) in enumerate(best)}
    assert {tuple(r) for r in got} == want


def test_search_skips_unsound_vectors(spark):
    nan = float("nan")
    df = spark.createDataFrame([(0, [0.5, 0.25], 1), (1, [0.1, None], 1), (2, [nan, 0.0], 1), (3, None, 1), (4, [-0.01, 1.0], 1), (4, [-0.01, 1.0], 1)], "vec_id long, embedding array<float>, score int")
    v = maxscore.quantized(df)
    assert sorted(r.vec_id for r in v.collect()) == [0, 4, 4]
    got = maxscore.search(v, v.filter("vec_id = 0").withColumnRenamed("vec_id", "query_id")).collect()
    assert [(r.rank, r.vec_id, r.score) for r in got] == [(1, 4, -3 * 128 + 64 * 256)] * 1 + [(2, 4, -3 * 128 + 64 * 256)]
    twice = maxscore.search(v, v.filter("vec_id = 4").withColumnRenamed("vec_id", "query_id")).collect()
    assert [(r.rank, r.vec_id) for r in twice] == [(1, 0)]  # a repeated query row is one query
    assert maxscore.search(v.limit(0), v.limit(0).withColumnRenamed("vec_id", "query_id")).count() == 0


def test_search_of_large_components(spark):
    rows = [(0, [1e8, -3e9, 1.0]), (1, [1e8, 2e9, 0.5]), (2, [-1e8, 1e15, 2.0]), (3, [1e8, -3e9, 1.0 + 2**-8]), (4, [1e307, 0.0, 0.0]), (5, [0.0, 0.0, 0.0])]
    v = maxscore.quantized(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    whole = {r.vec_id: [int(x) for x in r.v] for r in v.collect()}
    assert whole[3][2] == 257 and whole[2][1] == 256 * 10**15
    got = maxscore.search(v, v.withColumnRenamed("vec_id", "query_id"), k=6).collect()
    score = lambda a, b: max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(whole[a], whole[b], strict=True))))
    assert len(got) == 30 and all(r.score == score(r.query_id, r.vec_id) for r in got)
    assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == 0] == sorted((b for b in whole if b), key=lambda b: (-score(0, b), b))


# ---- decontamination ---------------------------------------------------------------


def brute_overlap(doc, item, least=13, similarity=0.8):
    best = None
    for shift in range(-len(item), len(doc)):
        same = [0 <= k + shift < len(doc) and doc[k + shift] == item[k] for k in range(len(item))]
        for i in range(len(item)):
            for j in range(i + 1, len(item) + 1):
                inside = 0 <= i + shift and j + shift <= len(doc)
                if inside and same[i] and same[j - 1] and sum(same[i:j]) >= similarity * (j - i) and j - i >= min(least, len(item)):
                    best = max(best or (0,), (j - i,))
    return best


def test_overlaps_match_brute_force(spark):
    items = [(k, words(n)) for k, n in enumerate((16, 20, 30, 14, 3))]
    docs = []
    for d in range(40):
        w = words(40)
        if d % 2:
            k, own = items[d % 5]
            own = list(own)
            for _ in range(len(own) // 10):
                own[RNG.randrange(len(own))] = "zzz"
            w[10:10] = own
        docs.append((d, w))
    df = spark.createDataFrame([(d, " ".join(w).upper() if d % 3 else " \n".join(w), 1) for d, w in docs] + [(99, None, 1), (98, "", 1)], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items] + [(77, " ".join(items[0][1])), (78, None), (79, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.n_words for r in decontam.overlaps(df, bench).collect()}
    want = {(d, k): b[0] for d, w in docs for k, own in items if (b := brute_overlap(w, own))}
    assert got == want and len(want) >= 15
    assert decontam.overlaps(df, bench.limit(0)).count() == 0 and decontam.overlaps(df.limit(0), bench).count() == 0


def test_longest_stretch():
    same = np.array([True] * 5 + [False] + [True] * 4 + [False] * 3 + [True])
    assert decontam.longest_stretch(same) == (0, 10, 9)
    assert decontam.longest_stretch(np.zeros(4, bool)) == (0, 0, 0)


# ---- chat ------------------------------------------------------------------------


def test_layouts_and_round_trip(spark):
    import json

    records = [
        {"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "</s>[INST] \\ <</SYS>>"}], "id": 3},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"instruction": "do", "input": "this", "output": "done"},
        {"instruction": "do", "output": "done", "extra": {"x": [1]}},
        {"prompt": "p", "completion": "c"},
        {"prompt": {"user": "u"}, "response": {"text": "r"}},
        {"messages": []},
        {"unknown": 1},
    ]
    rows = [(k, json.dumps(r)) for k, r in enumerate(records)] + [(50, "no json"), (51, None)]
    turns = chat.canonical_turns(spark.createDataFrame(rows, "conv_id long, record string"))
    out = {r.conv_id: r for r in chat.read_back(chat.format_turns(turns)).collect()}
    assert [out[k].layout for k in range(8)] == ["messages", "conversations", "instruction", "instruction", "prompt_completion", "nested_prompt", "messages", "unmapped"]
    assert out[50].layout == out[51].layout == "unreadable"
    assert [t.text for t in out[2].turns] == ["do\n\nthis", "done"]
    for r in out.values():
        assert [(t.role, t.text) for t in r.turns] == [(t.role, t.text) for t in r.turns_back]
        assert list(r.loss_texts) == [t.text for t in r.turns if t.role == "assistant"]
    assert out[0].formatted.count("</s>") == 2 and out[2].fingerprint != out[3].fingerprint


def test_conversations_with_odd_rows(spark):
    rows = spark.createDataFrame([(1, 0, "user", None), (1, 1, "assistant", "x" * 20_000), (1, 1, "assistant", "b"), (2, None, None, "t"), (None, 0, "user", "u")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.digests(chat.conversation_records(rows)).collect()}
    assert got[1].n_turns == 3 and got[1].loss_chars == 20_001 and got[2].n_turns == 1 and None in got
    # names of roles are those of the rows; only layouts with names of their own have them mapped
    named = chat.digests(chat.conversation_records(spark.createDataFrame([(5, 0, "human", "q"), (5, 1, "gpt", "a")], "conv_id long, turn long, role string, text string"))).collect()[0]
    assert named.turns_sha256 == hashlib.sha256(b"human\nq\ngpt\na\n").hexdigest() and named.loss_chars == 0
    assert chat.digests(chat.conversation_records(rows.limit(0))).count() == 0
