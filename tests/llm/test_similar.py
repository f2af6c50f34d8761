import random

import numpy as np
import pyarrow as pa

from memloom.llm import simhash

RNG = random.Random(8)
WORDS = ["".join(RNG.choice("abcdefgh") for _ in range(RNG.randint(3, 7))) for _ in range(3000)]


def words(n):
    return [RNG.choice(WORDS) for _ in range(n)]


def shingles(text, width=5):
    w = (text or "").lower().split()
    return {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_sets_of_slices():
    texts = pa.array([" ".join(words(RNG.randint(0, 30))).upper() for _ in range(50)] + [None])
    whole = [x.tolist() for x in simhash.shingle_sets(texts, 5)]
    assert [x.tolist() for at in range(0, 51, 7) for x in simhash.shingle_sets(texts.slice(at, 7), 5)] == whole
    assert [len(x) for x in whole] == [len(shingles(t)) for t in texts.to_pylist()]


def test_set_fingerprint_by_hand():
    own = np.array([3, 1 << 60, 77, 5], np.uint64)
    hashes = [[int(simhash._mix(np.array([h * m], np.uint64))[0]) for m in simhash._MULTIPLY] for h in own]
    want = [sum(1 << b for b in range(64) if 2 * sum(h[k] >> b & 1 for h in hashes) > 4) for k in range(16)]
    assert simhash.set_fingerprint(own).tolist() == want
    assert simhash.set_fingerprint(np.empty(0, np.uint64)).tolist() == [0] * 16
    many = np.arange(1000, dtype=np.uint64)
    part = simhash._mix(many[:, None] * simhash._MULTIPLY)
    assert simhash.set_fingerprint(many).tolist() == [sum(1 << b for b in range(64) if 2 * int((part[:, k] >> np.uint64(b) & np.uint64(1)).sum()) > 1000) for k in range(16)]


def grouped(n, linked):
    root = list(range(n))
    for a in range(n):
        for b in range(a + 1, n):
            if root[a] != root[b] and linked(a, b):
                x, y = root[a], root[b]
                root = [min(x, y) if r in (x, y) else r for r in root]
    return root


def test_groups_match_brute_force(spark):
    docs = []
    for size in (1, 2, 3, 5, 60):
        base = words(200)
        for _ in range(size):
            own = list(base)
            for _ in range(RNG.randint(0, 9)):
                own[RNG.randrange(200)] = RNG.choice(WORDS)
            docs.append(" ".join(own))
    docs += [None, "", " \n", "one two", "ONE  two", "one three"]
    RNG.shuffle(docs)
    rows = [(k, t) for k, t in enumerate(docs)] + [(3, docs[3]), (None, docs[5]), (None, "alone"), (None, "alone")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, component_id int")
    got = simhash.similar_documents(df).collect()
    prints = [np.array(simhash.set_fingerprint(x)) for x in simhash.shingle_sets(pa.array(docs), 5)]
    root = grouped(len(docs), lambda a, b: int(np.bitwise_count(prints[a] ^ prints[b]).sum()) <= simhash.REACH)
    assert len(got) == len(docs) + 2  # rows of equal id and text are one document
    assert all(r.component_id == root[r.doc_id] and r.stays == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)
    assert sorted((r.component_id is None, r.stays) for r in got if r.doc_id is None) == [(False, False), (True, True)]
    assert simhash.similar_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_fingerprints_tell_similarity():
    close = far = linked = lost = 0
    for _ in range(150):
        n = RNG.choice((40, 200, 600))
        a = words(n)
        b = list(a)
        for k in RNG.sample(range(n), RNG.randint(1, max(1, n // 12))):
            b[k] = RNG.choice(WORDS)
        texts = [" ".join(a), " ".join(b)]
        similar = jaccard(*map(shingles, texts))
        x, y = (simhash.set_fingerprint(s) for s in simhash.shingle_sets(pa.array(texts), 5))
        near = int(np.bitwise_count(x ^ y).sum()) <= simhash.REACH
        if similar >= 0.84:
            close, lost = close + 1, lost + (not near)
        elif similar <= 0.7:
            far, linked = far + 1, linked + near
    assert close >= 10 and far >= 10 and lost <= 1 and linked <= 1


def test_wide_tiles_find_every_group(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(-(2**62), 2**62, (40, 16))
    near = []
    for b in base:
        for _ in range(4):
            own = b.copy()
            for bit in rng.choice(1024, int(rng.integers(1, 120)), replace=False):
                own[bit // 64] ^= np.int64(1) << np.int64(bit % 64)
            near.append(own)
    every = np.unique(np.concatenate([base, near]), axis=0)
    links = simhash.near_links(spark.createDataFrame([(f"{k:04d}", [int(x) for x in w]) for k, w in enumerate(every)], "node string, words array<long>"), 166, 50, 1024).collect()
    by_links = list(range(len(every)))
    for r in links:
        x, y = by_links[int(r.a)], by_links[int(r.b)]
        by_links = [min(x, y) if q in (x, y) else q for q in by_links]
    assert by_links == grouped(len(every), lambda a, b: int(np.bitwise_count(every[a].view(np.uint64) ^ every[b].view(np.uint64)).sum()) <= 166)


def test_fingerprint_by_hand():
    """The 64-bit fingerprint, from the rule alone: bytes hashed by a library, bits counted one by one."""
    import re

    import xxhash

    def by_hand(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        if not w:
            return 0
        parts = [" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))]
        h = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in parts]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    texts = [None, "", " \t\n", "One", "one two three", "one two three four", "A b\x0bC d\x1ce É f É g", "a b c d a b c d a b c d", "x " * 700, " y z w v u t"]
    texts += [" ".join(words(RNG.randint(1, 90))).upper() for _ in range(30)]
    assert [simhash.fingerprint(t) for t in texts] == [by_hand(t) for t in texts]


def test_sizes_that_rule_out_similarity(spark):
    rng = np.random.default_rng(5)
    near, sizes = [], []
    for b in rng.integers(-(2**62), 2**62, (30, 16)):
        for _ in range(8):
            own = b.copy()
            for bit in rng.choice(1024, int(rng.integers(1, 90)), replace=False):
                own[bit // 64] ^= np.int64(1) << np.int64(bit % 64)
            near.append(own)
            sizes.append(int(rng.choice((0, 1, 2, 4, 5, 6, 8, 10, 80, 99, 100, 125, 126, 20_000))))
    rows = [(f"{k:04d}", [int(x) for x in w], n) for k, (w, n) in enumerate(zip(near, sizes, strict=True))]
    fits = lambda a, b: 5 * min(sizes[a], sizes[b]) >= 4 * max(sizes[a], sizes[b])
    want = grouped(len(near), lambda a, b: fits(a, b) and int(np.bitwise_count(near[a].view(np.uint64) ^ near[b].view(np.uint64)).sum()) <= 166)
    for tile in (7, 1000):
        got = list(range(len(near)))
        for r in simhash.near_links(spark.createDataFrame(rows, "node string, words array<long>, size long"), 166, tile, 1024, simhash.RATIO).collect():
            x, y = got[int(r.a)], got[int(r.b)]
            got = [min(x, y) if q in (x, y) else q for q in got]
        assert got == want
    left, right = (np.array(x, np.int64).view(np.uint64) for x in (near[:100], near[100:]))
    member, root = simhash.near_groups(left, right, 166, [np.array(sizes[:100]), np.array(sizes[100:])], simhash.RATIO)
    assert len(member) and all(m < 100 or r < 100 or want[m] == want[r] for m, r in zip(member, root, strict=True))
