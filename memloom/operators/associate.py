"""Pairs and neighbours of atoms through shared facets, stored edges and vectors."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from memloom.operators import ranking
from memloom.operators.graph import top_by
from memloom.sources.tables import durable

#: What one task compares: so many facet values of candidates, and of sources.
MAX_OTHERS, MAX_OWN = 1 << 22, 1 << 17
#: More than rounding to nine decimals and the order of summation can move a score.
_MARGIN = 1e-8


def supersession_pairs(atoms: DataFrame, vectors: DataFrame, facets: DataFrame, provenance: DataFrame, least: float = 0.98) -> DataFrame:
    """(old_id, new_id, similarity): pairs of live atoms with different texts, the older
    first, that share a facet value and whose vectors have at least this cosine; atoms of
    a person's own provenance take no part.

    Similar pairs are few, so they come first, from matrix products; facets are only
    joined to them, and no facet's atoms are paired with each other.
    """
    person = provenance.filter("source LIKE 'person-%'").select(F.col("atom_id").alias("id")).distinct()
    live = atoms.filter("status = 'live'").join(person, "id", "left_anti").select("id", F.sha2("text", 256).alias("t"), "created_at")
    pairs = ranking.similar_pairs(vectors.join(live.select(F.col("id").alias("doc_id")), "doc_id", "left_semi").select("doc_id", "embedding"), least)
    side = lambda n: live.select(F.col("id").alias(n), F.col("t").alias(f"{n}_t"), F.col("created_at").alias(f"{n}_c"))
    told = pairs.join(side("a"), "a").join(side("b"), "b").filter("a_t <> b_t AND a_c <> b_c")
    told = durable(told.select(F.expr("if(a_c < b_c, a, b)").alias("old_id"), F.expr("if(a_c < b_c, b, a)").alias("new_id"), "similarity"))
    value = lambda n: facets.select(F.col("atom_id").alias(n), "key", "value")
    shared = told.select("old_id", "new_id").join(value("old_id"), "old_id").join(value("new_id"), ["new_id", "key", "value"], "left_semi").select("old_id", "new_id").distinct()
    return told.join(shared, ["old_id", "new_id"], "left_semi").select("old_id", "new_id", "similarity")


def shared_top(sources: DataFrame, others: DataFrame, degree: DataFrame, k: int = 3, least: float = 0.02, bonus: float = 0.05, max_others: int = MAX_OTHERS, max_own: int = MAX_OWN) -> DataFrame:
    """(query_id, doc_id, score, rank): for each of sources (query_id, project, value) the k
    best of others (doc_id, project, value) that share a value with it, each value worth one
    over its degree (value, n), and a bonus more for the same project; scores of at least
    ``least``, rounded to nine decimals.  Rows of both sides are distinct.

    All values count, hubs too, but pairs are not made by joining on them: blocks of
    sources meet blocks of others, where each source reads its values' lists from the rarest
    on, only as long as what is left of its values could bring in a document that it hasn't met.
    Sources with the same values and project are searched for once, and of such others the
    k smallest ids stand for all.
    """
    held = lambda df: df.select("value").distinct()
    terms = durable(degree.join(held(sources), "value", "left_semi").join(held(others), "value", "left_semi").withColumn("term", F.monotonically_increasing_id()))
    mine, theirs = (durable(_value_sets(df.withColumnRenamed(name, "id"), terms)) for df, name in ((sources, "query_id"), (others, "doc_id")))
    alike = Window.partitionBy("key").orderBy("id")
    first = lambda df, n: durable(df.withColumn("place", F.row_number().over(alike)).filter(F.col("place") <= n).drop("place"))
    asked, stored = first(mine, 1), first(theirs, k)
    size = lambda df: df.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    parts, blocks = 1 + size(asked) // max_own, 1 + size(stored) // max_others
    salt = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select(F.col("id").alias("query_id"), "project", F.col("terms.term").alias("terms"), F.col("terms.n").alias("ns"), salt(parts).alias("part"), every(blocks).alias("block"))
    right = stored.select(F.col("id").alias("doc_id"), "project", F.col("terms.term").alias("terms"), salt(blocks).alias("block"), every(parts).alias("part"))
    out = T.StructType([T.StructField("query_id", sources.schema["query_id"].dataType), T.StructField("doc_id", others.schema["doc_id"].dataType), T.StructField("score", T.DoubleType())])
    found = top_by(left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInArrow(_sharing(k, least, bonus, to_arrow_schema(out)), out), k)
    members = mine.select("id", "key").join(asked.select("key", F.col("id").alias("query_id")), "key").drop("key")
    return found.join(members, "query_id").select(F.col("id").alias("query_id"), "doc_id", "score", "rank")


def _value_sets(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """(id, project, terms, key) of (id, project, value): values (n, term) from the rarest on,
    and a key that is the same for the same values and project."""
    sets = rows.join(terms, "value").groupBy("id", "project").agg(F.sort_array(F.collect_list(F.struct("n", "term"))).alias("terms"))
    return sets.withColumn("key", F.sha2(F.concat_ws("/", F.array_join(F.col("terms.term").cast("array<string>"), ","), "project"), 256))


def _sharing(k: int, least: float, bonus: float, schema: pa.Schema) -> Callable:
    """A function of a block of sources and one of others that finds the k best of each source."""

    def flat(table: pa.Table, name: str) -> np.ndarray:
        return np.asarray(pc.list_flatten(table.column(name)).combine_chunks()).astype(np.int64)

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        names = pc.unique(pa.chunked_array([*left.column("project").chunks, *right.column("project").chunks]).drop_null())
        coded = lambda t: np.asarray(pc.fill_null(pc.index_in(t.column("project"), names), -1).combine_chunks()).astype(np.int64)
        right = right.take(pa.array(np.lexsort((right.column("doc_id").to_numpy(), coded(right)))))
        docs, project = right.column("doc_id").to_numpy(), coded(right)
        sizes = np.asarray(pc.list_value_length(right.column("terms")).combine_chunks()).astype(np.int64)
        begins = np.append(0, np.cumsum(sizes))
        known, held = np.unique(flat(right, "terms"), return_inverse=True)
        order = np.argsort(held, kind="stable")
        posts = np.repeat(np.arange(len(docs)), sizes)[order]  # within a term by project, then by id
        width = len(names) + 1
        cell = held[order] * width + project[posts] + 1
        worth = np.zeros(len(known))
        # a source's values that others have, with their lists, whole and of its project
        asked, own = left.column("query_id").to_numpy(), coded(left)
        counts = np.asarray(pc.list_value_length(left.column("terms")).combine_chunks()).astype(np.int64)
        owner, term, ns = np.repeat(np.arange(len(asked)), counts), flat(left, "terms"), flat(left, "ns")
        place = np.minimum(np.searchsorted(known, term), len(known) - 1)
        there = known[place] == term
        owner, place, ns = owner[there], place[there], ns[there]
        ends = np.searchsorted(owner, np.arange(len(asked) + 1))
        lists = np.searchsorted(cell, place * width), np.searchsorted(cell, (place + 1) * width)
        near = np.searchsorted(cell, place * width + own[owner] + 1), np.searchsorted(cell, place * width + own[owner] + 2)

        def met(lo, hi, w, tail, floor, more):
            """Documents that may be among the k best with a score of floor or more: all
            that no unread list could bring in, with their scores from the lists read."""
            ids, parts, done, budget = np.empty(0, np.int64), np.empty(0), 0, 512
            total = np.cumsum(hi - lo)
            while done < (need := int(np.searchsorted(-tail[:-1], more - floor + _MARGIN, "right"))):
                done = min(need, max(done + 1, int(np.searchsorted(total, budget)) + 1))
                budget *= 4
                read = np.concatenate([posts[a:b] for a, b in zip(lo[:done], hi[:done], strict=True)])
                weights = np.repeat(w[:done], hi[:done] - lo[:done])
                if len(read) * 16 > len(docs):
                    parts = np.bincount(read, weights, len(docs))
                    ids = np.flatnonzero(parts)
                    parts = parts[ids]
                else:
                    ids, at = np.unique(read, return_inverse=True)
                    parts = np.bincount(at, weights, len(ids))
                if len(ids) >= k:
                    floor = max(floor, np.partition(parts, -k)[-k] + more)
            keep = parts + tail[done] + more >= floor - _MARGIN
            return ids[keep], parts[keep], done

        def whole(ids, place, w):
            """Scores of documents from all of their values."""
            worth[place] = w
            n = sizes[ids]
            starts = np.append(0, np.cumsum(n)[:-1])
            parts = np.add.reduceat(worth[held[np.repeat(begins[ids] - starts, n) + np.arange(n.sum())]], starts)
            worth[place] = 0
            return parts

        def best(ids, scores):
            y = scores * 1e9  # halves go up, as in SQL
            scores = (np.floor(y) + (y - np.floor(y) >= 0.5)) / 1e9
            sound = scores >= least
            ids, scores = ids[sound], scores[sound]
            if len(ids) > 64:
                sound = scores >= np.partition(scores, -k)[-k]
                ids, scores = ids[sound], scores[sound]
            chosen = np.lexsort((docs[ids], -scores))[:k]
            return ids[chosen], scores[chosen]

        rows = []
        for j in range(len(asked)):
            a, b = ends[j], ends[j + 1]
            if a == b:
                continue
            w = 1 / ns[a:b]
            tail = np.append(np.cumsum(w[::-1])[::-1], 0.0)
            ids, scores = np.empty(0, np.int64), np.empty(0)
            for lo, hi, same in ((*near, True), (*lists, False)):
                if same and own[j] < 0:
                    continue
                more = bonus if same else 0.0
                floor = max(least, scores[-1] if len(scores) == k else least)
                new, parts, done = met(lo[a:b], hi[a:b], w, tail, floor, more)
                if not same and own[j] >= 0:  # those of its project are judged
                    other = project[new] != own[j]
                    new, parts = new[other], parts[other]
                if len(new):
                    parts = parts if done == b - a else whole(new, place[a:b], w)
                    old = best(new, parts + more)
                    ids, scores = np.append(ids, old[0]), np.append(scores, old[1])
                    chosen = np.lexsort((docs[ids], -scores))[:k]
                    ids, scores = ids[chosen], scores[chosen]
            rows.append((np.full(len(ids), j), ids, scores))
        j, ids, scores = (np.concatenate(x) for x in zip(*rows, strict=True)) if rows else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        return pa.table([pa.array(asked[j]), pa.array(docs[ids]), pa.array(scores)], names=schema.names).cast(schema)

    return compare


def proposals(by_entity: DataFrame, by_vector: DataFrame) -> DataFrame:
    """Both channels' proposals (mem_id, chunk_id, score): of a pair the higher score, at
    equal ones the entity's."""
    every = by_entity.select("mem_id", "chunk_id", "score", F.lit(1).alias("own")).union(by_vector.select("mem_id", "chunk_id", "score", F.lit(0).alias("own")))
    best = every.groupBy("mem_id", "chunk_id").agg(F.max(F.struct("score", "own")).alias("b"))
    return best.select("mem_id", "chunk_id", "b.score", F.when(F.col("b.own") == 1, "entity").otherwise("dense").alias("channel"))


def association(seeds: DataFrame, facets: DataFrame, edges: DataFrame, atoms: DataFrame, hub: int = 128, per_seed: int = 32, k: int = 128) -> DataFrame:
    """(query_id, doc_id, score, rank): live neighbours of each query's seeds (query_id,
    seed) by shared facets, each worth one over its live degree, and over two stored edges
    (src_atom, dst_atom, weight), worth the product of their weights over the degree of
    the atom between.  Edges count in both directions, once, at their largest weight;
    values of one atom or of more than hub are left out, and so are seeds."""
    live = atoms.filter("status = 'live'").select(F.col("id").alias("atom_id"))
    alive = facets.join(live, "atom_id", "left_semi").select("atom_id", "key", "value").distinct()
    degree = alive.groupBy("key", "value").agg(F.count("*").alias("n")).filter(F.col("n").between(2, hub))
    place = F.row_number().over(Window.partitionBy("query_id", "seed").orderBy("key", "value"))
    own = seeds.join(facets.select(F.col("atom_id").alias("seed"), "key", "value").distinct(), "seed").join(degree, ["key", "value"]).withColumn("k", place).filter(F.col("k") <= per_seed)
    by_facet = own.join(alive.withColumnRenamed("atom_id", "doc_id"), ["key", "value"]).select("query_id", "doc_id", (1 / F.col("n")).alias("part"))
    both = edges.select(F.least("src_atom", "dst_atom").alias("a"), F.greatest("src_atom", "dst_atom").alias("b"), "weight").filter("a <> b").groupBy("a", "b").agg(F.max("weight").alias("w"))
    way = durable(both.select(F.col("a").alias("x"), F.col("b").alias("y"), "w").union(both.select("b", "a", "w")))
    through = way.groupBy("x").agg(F.count("*").alias("d"))
    first = seeds.join(way.withColumnRenamed("x", "seed"), "seed").select("query_id", F.col("y").alias("x"), F.col("w").alias("w1")).join(through, "x")
    by_edge = first.join(way, "x").select("query_id", F.col("y").alias("doc_id"), (F.col("w1") * F.col("w") / F.col("d")).alias("part"))
    every = by_facet.union(by_edge).groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), 9).alias("score"))
    fresh = every.join(seeds.select("query_id", F.col("seed").alias("doc_id")), ["query_id", "doc_id"], "left_anti").join(live.withColumnRenamed("atom_id", "doc_id"), "doc_id", "left_semi")
    return top_by(fresh, k)
