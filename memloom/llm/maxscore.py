"""Exact top-k search over integer vectors by MaxScore.

Vectors are spread over shards by a hash of their id.  In a shard every
dimension is a term whose postings are the shard's vectors with their values;
its score bound for a query is the largest product of the query's component
with a value in the shard.  The best heads of the strongest terms' postings are
scored first and give a threshold.  The terms are split in order of what they
can still change: while the bounds of the rest could lift a vector over the
threshold a term is essential.  The essential postings are traversed; a vector
that stays competitive with the bounds of the rest is probed there, term by
term, and dropped as soon as it can't reach the threshold.  Each shard returns
its k best, the merge keeps the k best of all.  No competitive vector is ever
dropped: equal scores stay until ids decide.

Shards and blocks of queries hold a bounded number of components; a block is sent
to each shard once, and neither side is broadcast.

Defined results: vectors that are null or hold a null or non-finite component
take no part, as query or candidate; vectors of another length than the
query's don't meet it; ties go to the smaller id; a query with fewer candidates
gets all of them; repeated rows are candidates each but one query; a row with
null id takes no part; an empty table gives an empty table.  Other columns are ignored.
Scores are exact: where doubles might round, bounds are widened by what they can
round and the vectors that stay are scored in whole numbers of any size.  A score that
no long can hold becomes the nearest long, and a component the nearest double.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Components of a shard's vectors, or of a block's queries, on average.
COMPONENTS = 1 << 21
_SEEDS, _HEADS = 8, 8
_STEP = 8
_LONG = 1 << 63


class Shard:
    """The postings of one shard's vectors of one length."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.columns = ids, np.ascontiguousarray(vectors.T.astype(np.float64))
        self.whole = vectors
        self.low, self.high = self.columns.min(1), self.columns.max(1)
        self.most = np.maximum(-self.low, self.high)
        heads = min(_HEADS, len(ids))
        self.heads = {True: np.argpartition(-self.columns, heads - 1, axis=1)[:, :heads], False: np.argpartition(self.columns, heads - 1, axis=1)[:, :heads]}

    def search(self, query: np.ndarray, k: int, own: int | None) -> list[tuple[int, int]]:
        """(id, score) of the k best, best first; own is left out."""
        q = query.astype(np.float64)
        if max(np.abs(q).max(), self.most.max()) > 1e150:  # sums of doubles might overflow
            return self._exactly(query, np.flatnonzero(np.ones(len(self.ids), bool) if own is None else self.ids != own), k)
        reach_of_all = float(np.abs(q) @ self.most)
        exact = reach_of_all < 2.0**52
        slack = 0.0 if exact else reach_of_all * len(q) * 2.0**-50
        bound = np.maximum(q * self.low, q * self.high)
        order = np.argsort(-(bound - np.minimum(q * self.low, q * self.high)), kind="stable")
        rest = np.append(np.cumsum(bound[order][::-1])[::-1], 0.0)  # rest[n]: what terms from the n-th on can add
        allowed = np.ones(len(self.ids), bool) if own is None else self.ids != own
        # the heads of the strongest postings give the first threshold
        seeds = np.unique(np.concatenate([self.heads[bool(q[d] > 0)][d] for d in order[:_SEEDS]]))
        seeds = seeds[allowed[seeds]]
        scores = np.sort(q @ self.columns[:, seeds]) if len(seeds) else np.empty(0)
        least = scores[-k] - slack if len(scores) >= k else -np.inf
        # essential: the shortest run of terms after which the rest can't reach the threshold alone
        reach = np.flatnonzero(rest < least)
        n_essential = max(1, int(reach[0])) if len(reach) else len(order)
        terms = order[:n_essential]
        partial = q[terms] @ self.columns[terms]
        alive = np.flatnonzero(allowed & (partial + rest[n_essential] + slack >= least))
        partial = partial[alive]
        for at in range(n_essential, len(order), _STEP):
            terms = order[at : at + _STEP]
            partial = partial + q[terms] @ self.columns[np.ix_(terms, alive)]
            left = rest[min(at + _STEP, len(order))]
            if len(partial) > k:  # the k-th best of what is sure raises the threshold
                floor = np.minimum(q * self.low, q * self.high)[order[at + _STEP :]].sum()
                least = max(least, np.partition(partial, -k)[-k] + floor - slack)
            keep = partial + left + slack >= least
            alive, partial = alive[keep], partial[keep]
        if not exact:
            return self._exactly(query, alive, k)
        best = np.lexsort((self.ids[alive], -partial))[:k]
        return [(int(self.ids[alive[b]]), int(partial[b])) for b in best]

    def _exactly(self, query: np.ndarray, places: np.ndarray, k: int) -> list[tuple[int, int]]:
        """The k best of the vectors at these places, in whole numbers of any size."""
        whole = [int(x) for x in query]
        dot = lambda j: sum(a * int(b) for a, b in zip(whole, self.whole[j], strict=True))
        scored = sorted((-max(-_LONG, min(_LONG - 1, dot(j))), int(self.ids[j])) for j in places)
        return [(i, -s) for s, i in scored[:k]]


_HITS = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.LongType())])


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, skip_own: bool = True, components: int = COMPONENTS) -> DataFrame:
    """The k best of vectors (vec_id, v) for each of queries (query_id, v): query_id,
    rank, vec_id, score.  v is an array of whole doubles without nulls."""
    sizes = vectors.select(F.count("*").alias("n"), F.coalesce(F.sum(F.size("v")), F.lit(0)).alias("c")).first()
    asked = queries.dropDuplicates(["query_id", "v"])
    blocks = max(1, -(-(asked.select(F.sum(F.size("v"))).first()[0] or 0) // components))
    shards = max(1, min(sizes["n"], -(-sizes["c"] // components)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda i, n: F.expr(f"CAST(pmod(xxhash64({i}), {n}) AS INT)")
    spread = vectors.select(own("vec_id", shards).alias("shard"), every(blocks).alias("block"), F.lit(0).alias("kind"), F.col("vec_id").alias("id"), "v")
    sent = asked.select(every(shards).alias("shard"), own("query_id", blocks).alias("block"), F.lit(1).alias("kind"), F.col("query_id").alias("id"), "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, held, built = None, [], [], None
        for batch in batches:
            out = []
            rows = zip(*(batch.column(c).to_numpy(zero_copy_only=False) for c in range(5)), strict=True)
            for shard, block, kind, i, v in rows:
                if (shard, block) != now:
                    now, ids, held, built = (shard, block), [], [], None
                if kind == 0:
                    ids.append(i)
                    held.append(v)
                    continue
                if built is None:
                    built = {}
                    for n in {len(x) for x in held}:
                        chosen = [j for j, x in enumerate(held) if len(x) == n and n]
                        if chosen:
                            built[n] = Shard(np.array([ids[j] for j in chosen], np.int64), np.stack([held[j] for j in chosen]))
                    ids, held = [], []
                if len(v) in built:
                    out += [(i, x, s) for x, s in built[len(v)].search(np.asarray(v), k, i if skip_own else None)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=_HITS.names)

    hits = spread.union(sent).repartition("shard", "block").sortWithinPartitions("shard", "block", "kind", "id").mapInArrow(run, _HITS)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


# floor() of a double is a long and can't hold every double; from 2**52 on doubles are whole
_WHOLE = "if(abs(256 * CAST(x AS DOUBLE)) < 4503599627370496D, CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE), greatest(-1.7976931348623157E308D, least(1.7976931348623157E308D, 256 * CAST(x AS DOUBLE))))"


def quantized(embeddings: DataFrame) -> DataFrame:
    """(vec_id, v): floor(256 x) of every component, for vectors without null or
    non-finite components."""
    sound = "vec_id IS NOT NULL AND embedding IS NOT NULL AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))"
    return embeddings.filter(sound).select(F.col("vec_id").cast("long").alias("vec_id"), F.expr(f"transform(embedding, x -> {_WHOLE})").alias("v"))
