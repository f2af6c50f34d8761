import random
from pathlib import Path

import public_tokenizers
import sentencepiece

import corpus_pipeline

RNG = random.Random(21)
WORDS = ["".join(RNG.choice("abcdefghilmno") for _ in range(RNG.randint(3, 8))) for _ in range(2000)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, t string"


def words(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


def lines(n, each=20):
    return "\n".join(words(each) for _ in range(n))


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", None if t is None else len(t), "more") for d, t in rows], SCHEMA)


def kept(df):
    assert df.columns == ["doc_id", "text", "lang", "source", "n_chars", "t"]
    rows = df.collect()
    assert all(r.n_chars == (None if r.text is None else len(r.text)) and r.t == "more" for r in rows)
    return sorted(((r.doc_id, r.text) for r in rows), key=str)


def test_line_stage(spark):
    a, b, own, licence, short = lines(20), lines(3), lines(8), lines(16), lines(4)
    rows = [(1, a), (2, a + "\n" + b), (3, own + "\n" + b), (4, licence), (5, licence + "\n" + short), (6, b), (7, own + "\n" + b), (8, None), (9, ""), (None, words(9))]
    got = kept(corpus_pipeline.line_stage(spark, frame(spark, rows), ""))
    assert got == sorted([(1, a), (2, b), (3, own), (4, licence), (5, short), (8, None), (9, ""), rows[-1]], key=str)
    assert corpus_pipeline.line_stage(spark, frame(spark, rows).limit(0), "").count() == 0


def test_near_stage(spark):
    base = words(300).split()
    edited = list(base)
    for k in (30, 80, 130, 180, 230, 280):  # 30 of 296 shingles change: 266 / 326 = 0.816
        edited[k] = "changed"
    far = list(edited)
    for k in (20, 60, 110, 160):
        far[k] = "other"
    a, b, c = " ".join(base), " ".join(edited), words(300)
    rows = [(1, a), (2, b), (3, c), (3, c), (4, None), (5, ""), (None, a), (None, "alone here"), (None, "alone here"), (7, words(2)), (8, c.upper())]
    got = kept(corpus_pipeline.near_stage(spark, frame(spark, rows), ""))
    assert got == sorted([(1, a), (3, c), (4, None), (None, "alone here"), rows[9]], key=str)
    assert [r[0] for r in kept(corpus_pipeline.near_stage(spark, frame(spark, [(1, a), (2, " ".join(far))]), ""))] == [1, 2]
    assert corpus_pipeline.near_stage(spark, frame(spark, rows).limit(0), "").count() == 0


def test_run_against_single_steps(spark, tmp_path):
    good = [words(25) + ".\n" + words(30) + ".\n" + words(12) + "." for _ in range(60)]
    bad = ["!!! $$$ " + " ".join("9" * RNG.randint(1, 9) for _ in range(40)) for _ in range(40)]
    docs = [(k, t) for k, t in enumerate(good + bad)]
    item = words(30)
    docs += [(200, words(20) + " " + item + " " + words(9)), (201, good[0]), (202, good[1].replace(" ", "  ", 3) + " end"), (None, words(40) + "."), (203, None)]
    frame(spark, docs).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, int(k < 60), 0) for k in range(100)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert {*range(60)} <= {*got} and not {*range(60, 100), 200, 201} & {*got}
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = dict(docs)
    for d, r in got.items():
        if d != 202:
            want = library.encode(texts[d] or "")
            assert list(r.ids) == want and r.n_tokens == len(want), d
    assert Path(corpus_pipeline.__file__).name == "corpus_pipeline.py" and [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "decontamination", "sentencepiece"]
