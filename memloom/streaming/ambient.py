"""Streams: transcript capture, near-duplicate gate, drift notices and event windows."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from memloom.operators import ranking
from memloom.sources.exports import spans

NEAR, RECENT, COOLDOWN_S, DRIFT_FLOOR = 0.96, 200, 900, 0.97


def capture(deltas: DataFrame, path: str, checkpoint: str, distill: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Writes the spans of a stream of transcript rows (session_id, offset, role, text)
    as atoms below path, each source reference once.

    References are kept in the stream's state, so a batch costs what it brings and not
    what went before.  It writes a folder of its own, replaced if the batch runs again,
    and state and input are taken up where the checkpoint left them; so a restart neither
    loses nor repeats a span.  distill may reword a batch's spans; without it they are
    kept verbatim.
    """

    def write(batch: DataFrame, number: int) -> None:
        (distill(batch) if distill else batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return spans(deltas).dropDuplicates(["source_ref"]).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()


def near_copies(candidates: DataFrame, atoms: DataFrame, floor: float = NEAR, recent: int = RECENT) -> DataFrame:
    """The best match of each candidate (id, embedding) among the most recent atoms
    (atom_id, embedding, t): id, atom_id, similarity.  The limit is the gate's rule
    and bounds what is broadcast."""
    last = atoms.orderBy(F.desc("t"), "atom_id").limit(recent).select("atom_id", F.col("embedding").alias("e")).withColumn("one", F.lit(1))
    pairs = candidates.withColumn("one", F.lit(1)).join(F.broadcast(last), "one").withColumn("similarity", ranking.cosine(F.col("embedding"), F.col("e")))
    best = Window.partitionBy("id").orderBy(F.desc("similarity"), "atom_id")
    return pairs.filter(F.col("similarity") >= floor).withColumn("n", F.row_number().over(best)).filter("n = 1").select("id", "atom_id", "similarity")


_DRIFT = "session_id string, at long, atom_id long, score double"


def _notices(rows: pd.DataFrame, last: int | None) -> tuple[pd.DataFrame, int | None]:
    out = []
    for r in rows.sort_values(["at", "atom_id"]).itertuples(index=False):
        # a clock that went back starts a new count
        if r.score >= DRIFT_FLOOR and not r.in_context and (last is None or r.at < last or r.at - last >= COOLDOWN_S):
            out.append((r.session_id, r.at, r.atom_id, r.score))
            last = int(r.at)
    return pd.DataFrame(out, columns=["session_id", "at", "atom_id", "score"]), last


def drift(hits: DataFrame) -> DataFrame:
    """At most one notice per session and cooldown of hits (session_id, at, atom_id,
    score, in_context); works on streams and on tables.  State is one number per session."""
    if hits.isStreaming:

        def fold(key, frames, state: GroupState):
            rows = pd.concat(list(frames))
            found, last = _notices(rows, state.get[0] if state.exists else None)
            if last is not None:
                state.update((last,))
            yield found

        return hits.groupBy("session_id").applyInPandasWithState(fold, _DRIFT, "last long", "append", GroupStateTimeout.NoTimeout)
    return hits.groupBy("session_id").applyInPandas(lambda rows: _notices(rows, None)[0], _DRIFT)


def event_windows(events: DataFrame, size: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Counts and sums per window and type with a watermark; an extension that Spark offers."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def index_maintenance(vectors: DataFrame, added: DataFrame, retired: DataFrame) -> DataFrame:
    """Vectors (doc_id, embedding) with additions; a newer vector replaces an older one,
    retired ids go."""
    kept = vectors.join(added.select("doc_id"), "doc_id", "left_anti").unionByName(added)
    return kept.join(retired.select("doc_id"), "doc_id", "left_anti")
