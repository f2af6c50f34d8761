"""Helpers that several operators share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read by Spark so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where the
    session names none, as in tests on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    made = tempfile.mkdtemp(prefix="memloom-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def durable(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back.

    This cuts the lineage: a lost executor costs the rereading of a file, not
    the recomputing of what went before, and joins after it see plain
    exchanges that adaptive execution can split where keys are skewed.  The
    files go when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/memloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def bounded_sample(rows: DataFrame, max_rows: int, max_bytes: int) -> list[Row]:
    """Distinct rows of rows (doc_id, text, labels ...) for the driver to learn from.

    They are those with the smallest hashes of their ids: of the first ``max_rows``
    (repeated ones count) as many, in this order, as fit into ``max_bytes`` of text
    together.  What comes to the driver is bounded by these two alone, and no
    partition sends a text that isn't chosen.
    """
    keyed = rows.withColumn("text_hash", F.xxhash64("text"))
    sizes = keyed.select(F.xxhash64("doc_id").alias("h"), "doc_id", "text_hash", F.octet_length("text").alias("n"))
    chosen, total = set(), 0
    for r in sizes.orderBy("h", "doc_id", "text_hash").limit(max_rows).collect():
        if (r["doc_id"], r["text_hash"]) not in chosen and total + r["n"] <= max_bytes:
            chosen.add((r["doc_id"], r["text_hash"]))
            total += r["n"]
    wanted = rows.sparkSession.createDataFrame(sorted(chosen), T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("text_hash", T.LongType())]))
    return keyed.join(F.broadcast(wanted), ["doc_id", "text_hash"]).dropDuplicates().orderBy("doc_id", "text_hash", *[c for c in rows.columns if c not in ("doc_id", "text")]).collect()


class Memo(dict):
    """A dictionary that computes what it lacks and keeps a bounded number of
    results in two generations, so that frequent keys stay.  The results don't
    depend on what is kept."""

    def __init__(self, compute, limit: int = 300_000):
        super().__init__()
        self.compute, self.limit, self.older = compute, limit, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.compute(key)
        # very long keys are rare and would make the bound on entries useless
        if len(key) <= 64:
            if len(self) >= self.limit:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value

    def forget(self) -> None:
        self.older = {}
        self.clear()


_PER_PROCESS: dict = {}


def once_per_process(key, make):
    """make()'s result, kept for the tasks that follow in the same worker."""
    if key not in _PER_PROCESS:
        _PER_PROCESS[key] = make()
        gc.freeze()  # large tables needn't be walked at each collection
    return _PER_PROCESS[key]
