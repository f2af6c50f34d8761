"""Documents to a clean tokenized corpus, in five stages.

Each stage takes (spark, docs, sf_dir), with what its predecessor kept as docs,
and returns a DataFrame; run() writes each result to the shared folder and reads
it again, so a lost executor never costs more than a stage.

Each stage judges what it is given.  So the line stage decides for repeated runs
of lines, and the near stage compares what these leave of the documents.

Defined results, of every stage: null and empty texts are texts and stay unless
another one like them stands for them; a null id is an id; rows of equal id and
text are one document, and the near stage keeps one of them; an empty table gives
an empty table; further columns pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from memloom.llm import decontam, line_dedup, piece_bpe, quality, simhash
from memloom.llm._common import durable, table
from memloom.llm.queries import vocabulary


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labels of docs."""
    return quality.keep_quality(docs, quality.fit_quality(docs, table(spark, sf_dir, "labels")))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines go, and a document that loses all of its words;
    n_chars follows the text.  The first occurrence of a run always stays, so no text
    is lost with a document."""
    cut = line_dedup.dedup_lines(docs)
    info = F.col("line_dedup")
    left = cut.filter((info["n_words_removed"] == 0) | (info["n_words_removed"] < info["n_words"]))
    n_chars = F.when(info["n_removed"] > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return left.withColumn("n_chars", n_chars).select(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, by shingles of five words and a similarity of
    0.8, one document stays: that of the smallest id."""
    stay = durable(simhash.similar_documents(docs).filter("stays").select("doc_id", "t"))
    key = lambda t: [F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("d0"), F.col("doc_id").isNull().alias("no_id"), t.alias("t0")]
    # the columns of docs are fields of one, so no name can clash
    rows = docs.select(F.struct("*").alias("row"), *key(F.xxhash64("text")))
    kept = rows.join(stay.select(*key(F.col("t"))).hint("merge"), ["d0", "no_id", "t0"], "left_semi")
    once = kept.withColumn("n", F.row_number().over(Window.partitionBy("d0", "no_id", "t0").orderBy("t0"))).filter("n = 1")
    return once.select("row.*")


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with a benchmark item go."""
    found = durable(decontam.overlaps(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct())
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as ids: doc_id, n_tokens and ids, with a digest of the text that
    the ids decode to."""
    done = piece_bpe.encode_documents(docs, vocabulary("piece_bpe_32k.model"), digest=True)
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded_sha256")


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("decontamination", benchmark_stage),
    ("sentencepiece", token_stage),
]

#: A learnt score and a tokenizer's vocabulary are no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, over the whole table of documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir))
    return docs
