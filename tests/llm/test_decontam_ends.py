from itertools import combinations

from memloom.llm import decontam

FILL = [f"fill{k}" for k in range(60)]


def test_substitutions_anywhere_in_short_items(spark):
    items, docs, want = [], [], set()
    for n in range(5, 17):
        item = [f"w{n}x{k}" for k in range(n)]
        items.append((n, " ".join(item)))
        for gone in combinations(range(n), n // 5):
            own = ["zzz" if k in gone else w for k, w in enumerate(item)]
            docs.append((len(docs), " ".join(FILL[:30] + own + FILL[30:])))
            want.add((docs[-1][0], n))
        if 10 <= n <= 13:  # one word too many differs
            own = ["zzz" if k % 3 == 0 and k < 3 * (n // 5 + 1) else w for k, w in enumerate(item)]
            docs.append((len(docs), " ".join(FILL[:30] + own + FILL[30:])))
    got = decontam.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    found = {(r.doc_id, r.item_id) for r in got}
    assert want <= found and found == want
    assert all(r.n_same <= r.n_words <= r.item_id for r in got)


def test_documents_that_end_within_an_item(spark):
    item = [f"w{k}" for k in range(13)]
    docs = [(1, " ".join(item[1:])), (2, " ".join(item[2:])), (3, " ".join(item[3:]))]
    got = decontam.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).collect()
    assert {(r.doc_id, r.doc_start, r.item_start, r.n_words, r.n_same) for r in got} == {(1, 0, 1, 12, 12), (2, 0, 2, 11, 11)}
