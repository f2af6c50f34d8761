"""Builds and queries a saved graph: python -m memloom.cli build|query|stats ..."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from memloom.functions import entities
from memloom.operators import persist
from memloom.operators.graph import EntityGraph


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> list[str]:
    """Runs a command and returns what it prints, one line each."""
    p = argparse.ArgumentParser(prog="memloom")
    sub = p.add_subparsers(dest="command", required=True)
    build = sub.add_parser("build", help="a graph of Parquet documents")
    build.add_argument("documents")
    build.add_argument("graph")
    build.add_argument("--id", default="doc_id")
    build.add_argument("--text", default="text")
    ask = sub.add_parser("query", help="the best documents of a query")
    ask.add_argument("graph")
    ask.add_argument("text")
    ask.add_argument("-k", type=int, default=10)
    stats = sub.add_parser("stats", help="numbers of nodes and edges")
    stats.add_argument("graph")
    a = p.parse_args(argv)
    spark = spark or SparkSession.builder.appName("memloom").getOrCreate()
    if a.command == "build":
        docs = spark.read.parquet(a.documents)
        found = docs.select(F.col(a.id).alias("doc_id"), F.explode(entities.extract_entities(F.col(a.text))).alias("m")).select("doc_id", "m.label", "m.etype")
        persist.save_graph(EntityGraph(found), a.graph)
        return [f"saved {a.graph}"]
    graph = persist.load_graph(spark, a.graph)
    if a.command == "stats":
        return [json.dumps(graph.stats().first().asDict())]
    hits = graph.query(spark.createDataFrame([(0, a.text)], "query_id int, query_text string"), a.k).orderBy("rank")
    return [f"{r['rank']}\t{r['score']:.4f}\t{r['doc_id']}" for r in hits.collect()]


if __name__ == "__main__":
    print("\n".join(main()))
