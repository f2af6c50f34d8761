"""Saved graphs, stores and index caches, and their growth.

A folder is complete once its manifest is there, which is written last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memloom.operators import store
from memloom.operators.graph import EntityGraph, GraphConfig

#: Tables of a store by the version that brought them, with their columns.
VERSIONS: tuple[dict[str, str], ...] = (
    {"atoms": "id string, text string, kind string, created_at long, status string", "edges": "src_atom string, dst_atom string"},
    {"provenance": "atom_id string, source string, agent string, source_ref string, recorded_at long", "facets": "atom_id string, key string, value string"},
    {"atoms": "project string, occurred_at long, importance double", "embeddings": "atom_id string, model_id string, embedding array<float>"},
    {"checkpoints": "task_id string, agent string, revision int, request_id string, recorded_at long, body string", "receipts": "receipt_id string, agent string, task_id string, query string, recorded_at long"},
    {"exposures": "receipt_id string, atom_id string, rank int, score double, delivery string", "feedback": "event_id string, receipt_id string, atom_id string, feedback_type string, agent string, task_id string, note string, recorded_at long, processed_at long"},
)


def migrated(spark: SparkSession, tables: dict[str, DataFrame], version: int) -> tuple[dict[str, DataFrame], int]:
    """tables of a version brought to the newest one, forwards only: tables that a version
    adds begin empty, and columns that it adds are null.  A newer version is refused."""
    newest = len(VERSIONS) - 1
    if version > newest:
        raise ValueError(f"version {version} is newer than {newest}")
    out = dict(tables)
    for step in VERSIONS[version + 1 :]:
        for name, columns in step.items():
            fields = T.StructType.fromDDL(columns)
            if name not in out:
                out[name] = spark.createDataFrame([], fields)
            else:
                out[name] = out[name].withColumns({f.name: F.lit(None).cast(f.dataType) for f in fields if f.name not in out[name].columns})
    return out, newest


def empty_store(spark: SparkSession) -> dict[str, DataFrame]:
    """The tables of a new store."""
    return migrated(spark, {}, -1)[0]


def grown(mentions: DataFrame, new: DataFrame, config: GraphConfig | None = None) -> EntityGraph:
    """The graph after new mentions of documents; a document that is there already is replaced.

    Weights depend on frequencies, which are sums over mentions, so the graph over the
    union is that of a rebuild; only saved mentions are read, never texts.
    """
    kept = mentions.join(new.select("doc_id").distinct(), "doc_id", "left_anti")
    return EntityGraph(kept.unionByName(new.select(*kept.columns)), config)


def save_graph(graph: EntityGraph, path: str) -> None:
    """Mentions, edges and entities as Parquet, edges in order of their label so that a
    query's labels read few row groups."""
    edges = graph.edges.repartitionByRange("label").sortWithinPartitions("label", "doc_id")
    store.save_snapshot({"mentions": graph.mentions, "edges": edges, "entities": graph.entities}, path)


def load_graph(spark: SparkSession, path: str, config: GraphConfig | None = None) -> EntityGraph:
    """A saved graph, refused if its tables aren't what its manifest says; queries read
    its edges and entities and compute nothing anew."""
    tables = store.load_snapshot(spark, path)
    out = EntityGraph(tables["mentions"], config)
    out.edges, out.entities = tables["edges"], tables["entities"]
    return out


def index_fingerprint(vectors: DataFrame) -> str:
    """The name of what an index over (doc_id, embedding) was made of, whatever the rows' order."""
    row = F.xxhash64("doc_id", F.transform("embedding", lambda x: x.cast("double"))).cast("decimal(38,0)")
    n, total = vectors.agg(F.count("*"), F.coalesce(F.sum(row), F.lit(0))).first()
    return f"{n}-{int(total) & (1 << 64) - 1:016x}"


def cached_index(vectors: DataFrame, make, root: str, keep: int = 2) -> DataFrame:
    """make(vectors), or what is saved under the vectors' fingerprint; of older ones the
    newest stay, ``keep`` in all."""
    spark = vectors.sparkSession
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(root)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    path = f"{root}/{index_fingerprint(vectors)}"
    if not files.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")):
        make(vectors).write.mode("overwrite").parquet(path)
    there = sorted(files.listStatus(folder), key=lambda s: (str(s.getPath()).endswith(path.rsplit("/", 1)[1]), s.getModificationTime()))
    for old in there[:-keep]:
        files.delete(old.getPath(), True)
    return spark.read.parquet(path)


def append_shadow(lines: DataFrame, path: str) -> None:
    """Appends comparisons to a log of JSON lines."""
    lines.write.mode("append").json(path)


def write_proposals(proposals: DataFrame, path: str, per_file: int = 50) -> None:
    """Self-contained batches of at most per_file proposals, as JSON files."""
    proposals.write.option("maxRecordsPerFile", per_file).json(path)


def boundary_cases(spark: SparkSession, path: str) -> DataFrame:
    """Cases of the boundary benchmark from a JSON list."""
    return spark.read.json(path, multiLine=True)


def select_index(n: int, memory: bool, whole_memory: int = 32_000, small: int = 5_000) -> str:
    """How a class of n vectors is searched: all of them, or by inverted lists."""
    return "flat" if n < small or (memory and n <= whole_memory) else "lists"
