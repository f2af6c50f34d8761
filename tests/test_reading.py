"""Lines by number across splits, and progress of ingestion."""

import pytest

from memloom.sources import exports


def test_lines_are_numbered_across_splits(spark, tmp_path):
    texts = {"a.txt": "".join(f"line {k}\n" if k % 7 else "\n" for k in range(3000)), "b.txt": "one\r\n\ntwo", "c.txt": ""}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        lines = exports.numbered_lines(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() > 1
        got = {(r.file.rsplit("/", 1)[1], r.line): r.raw for r in lines.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = {(n, k): raw for n, t in texts.items() for k, raw in enumerate(t.split("\n")) if k < t.count("\n") or raw}
    assert got == want


def test_progress_hears_of_each_source(spark, tmp_path):
    (tmp_path / "c.csv").write_text("Comment Text,timestamp\nfirst thoughts,2024-01-01\nsecond thoughts,2024-01-02\n")
    heard = []
    docs = exports.ingest(spark, {"youtube": str(tmp_path / "c.csv")}, lambda name, n: heard.append((name, n)))
    n = docs.count()
    assert n > 0 and heard == [("Starting youtube", 0), ("Finished youtube", n)]
    assert exports.ingest(spark, {"youtube": str(tmp_path / "c.csv")}).count() == n
    for wrong in ({}, {"fax": "x"}):
        with pytest.raises(ValueError):
            exports.ingest(spark, wrong)
