"""Supersession, confidence and the payload of a recall."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from memloom.functions import text as tx
from memloom.sources.tables import durable

TRUST_FLOOR, SUPERSEDED_CAP, CORPUS_CAP = 0.6, 0.4, 0.4
NO_MATCH, TOO_SMALL = "low confidence: no trusted match", "recall: token budget too small"


def chain_ends(supersedes: DataFrame, rounds: int = 40) -> DataFrame:
    """(id, end, forked) for each superseded atom: where following the smallest
    successor leads, and whether a step had a choice.

    Pointers are doubled, so rounds grow with the logarithm of the longest chain;
    a pointer that is never settled is a cycle, which raises an error.
    """
    step = supersedes.groupBy(F.col("dst_atom").alias("id")).agg(F.min("src_atom").alias("end"), (F.countDistinct("src_atom") > 1).alias("forked"))
    now = durable(step)
    for _ in range(rounds):
        ahead = now.select(F.col("id").alias("end"), F.col("end").alias("next"), F.col("forked").alias("next_forked"))
        moved = now.join(ahead, "end", "left")
        if moved.filter("next IS NOT NULL").isEmpty():
            return now
        now = durable(moved.select("id", F.coalesce("next", "end").alias("end"), (F.col("forked") | F.coalesce("next_forked", F.lit(False))).alias("forked")))
    raise ValueError("supersession cycle detected among atoms")


def _smallest_linked(links: DataFrame, rounds: int = 40) -> DataFrame:
    """(id, root): for each end of the undirected links (a, b) the smallest id of its
    component.  A round takes the smallest label around and then that label's own, so
    rounds grow with the logarithm of a long chain; each is written out."""
    both = durable(links.select("a", "b").union(links.select("b", "a")).distinct())
    now = durable(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("a"), F.min("b")).alias("root")))
    for _ in range(rounds):
        near = both.join(now.select(F.col("id").alias("b"), "root"), "b").groupBy(F.col("a").alias("id")).agg(F.min("root").alias("seen"))
        step = now.join(near, "id").select("id", F.least("root", "seen").alias("root"))
        told = step.groupBy(F.col("root").alias("id")).agg(F.lit(1).alias("one")).join(now.withColumnRenamed("root", "next"), "id").select(F.col("id").alias("root"), "next")
        ahead = durable(step.join(told, "root", "left").select("id", F.least("root", F.coalesce("next", "root")).alias("root")))
        if now.join(ahead.withColumnRenamed("root", "then"), "id").filter("then <> root").isEmpty():
            return ahead
        now = ahead
    raise ValueError("components didn't settle")


def components_in_order(supersedes: DataFrame, rounds: int = 10_000) -> DataFrame:
    """(id, root, depth): each atom of a correction graph, the smallest id of its
    undirected component, and its place there, oldest first.

    An atom comes after all that it supersedes: by the longest way to an atom that
    supersedes none, then by id.  Members of cycles, and what is newer than one, come
    last by id.  A level at a time is peeled off, all components at once, and the atoms
    that are left shrink with each; a chain takes as many rounds as it is long.
    """
    edges = durable(supersedes.select(F.col("src_atom").alias("new"), F.col("dst_atom").alias("old")).distinct())
    members = _smallest_linked(edges.select(F.col("new").alias("a"), F.col("old").alias("b")))
    left, placed, level = edges, None, 0
    ready = durable(members.select("id").join(edges.select(F.col("new").alias("id")), "id", "left_anti"))
    for _ in range(rounds):
        if ready.isEmpty():
            break
        here = ready.select("id", F.lit(level).alias("level"))
        placed = here if placed is None else placed.union(here)
        rest = durable(left.join(ready.select(F.col("id").alias("old")), "old", "left_anti"))
        freed = left.join(ready.select(F.col("id").alias("old")), "old", "left_semi").select(F.col("new").alias("id")).distinct()
        ready = durable(freed.join(rest.select(F.col("new").alias("id")), "id", "left_anti"))
        left, level = rest, level + 1
    else:
        raise ValueError("a correction chain is longer than the rounds allowed")
    known = members.withColumn("level", F.lit(None).cast("int")) if placed is None else members.join(placed, "id", "left")
    order = Window.partitionBy("root").orderBy(F.col("level").asc_nulls_last(), "id")
    return known.select("id", "root", (F.row_number().over(order) - 1).alias("depth"))


def assess(ranked: DataFrame, atoms: DataFrame, sources: DataFrame, ends: DataFrame, now: int) -> DataFrame:
    """Confidence of ranked (query_id, doc_id, score, position, signals): trust, why and
    the live successor of superseded atoms; retracted atoms and dead chains go."""
    info = atoms.select(F.col("id").alias("doc_id"), "status", "kind", tx.effective_time().alias("t"))
    imported = sources.groupBy(F.col("atom_id").alias("doc_id")).agg(F.min((F.col("source") == "bulk-import").cast("int")).alias("imported"))
    top = ranked.groupBy("query_id").agg((F.max(F.when(F.col("position") == 1, F.col("score"))) - F.max(F.when(F.col("position") == 2, F.col("score")))).alias("gap"))
    x = ranked.join(info, "doc_id").join(imported, "doc_id", "left").join(top, "query_id")
    has = lambda s: F.array_contains("signals", s)
    agree = F.least(F.lit(1.0), F.when(has("bm25") | has("dense"), 0.5).otherwise(0.0) + F.when(has("bm25") & has("dense"), 0.4).otherwise(0.0) + F.when(has("facet"), 0.1).otherwise(0.0))
    lead = F.when(F.col("position") > 1, 0.5).when(F.col("gap").isNull(), 1.0).otherwise(F.greatest(F.lit(0.5), 1 - F.exp(-F.greatest(F.lit(0.0), F.col("gap")) / 1.5)))
    fresh = tx.time_factor(F.lit(now) - F.col("t"), 180)
    x = x.withColumns({"agree": agree, "lead": lead, "fresh": fresh}).withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 * F.col("agree") + 0.3 * F.col("lead") + 0.2 * F.col("fresh"))))
    evidence = F.when(has("bm25") & has("dense"), "both signals agree").when(has("bm25"), "keyword signal only").when(has("dense"), "semantic signal only")
    facet = F.when(has("facet"), "facet match")
    none = F.when(evidence.isNull() & facet.isNull(), "no signal evidence")
    tight = F.when((F.col("position") == 1) & (F.col("lead") >= 0.75), "decisive gap").when((F.col("position") == 1) & (F.col("lead") <= 0.5), "tight gap")
    age = F.when(F.col("fresh") >= 0.9, "recent").when(F.col("fresh") <= 0.6, "aged")
    lone = F.col("kind").isin("document_chunk") & (F.coalesce("imported", F.lit(0)) == 1) & (F.size(F.array_intersect("signals", F.array(F.lit("bm25"), F.lit("dense"), F.lit("facet")))) < 2)
    x = x.withColumn("why", F.when(lone, "imported corpus, insufficient independent signals, uncorroborated").otherwise(F.concat_ws(", ", evidence, facet, none, tight, age)))
    live = x.filter("status = 'live'").withColumn("confidence", F.when(lone, F.least("confidence", F.lit(CORPUS_CAP))).otherwise(F.col("confidence"))).withColumn("superseded_by", F.lit(None).cast("long"))
    old = x.filter("status = 'superseded'").join(ends.withColumnRenamed("id", "doc_id"), "doc_id").join(atoms.filter("status = 'live'").select(F.col("id").alias("end")), "end", "left_semi")
    old = old.withColumns({"confidence": F.least("confidence", F.lit(SUPERSEDED_CAP)), "why": F.when(F.col("forked"), "superseded by newer atom (forked)").otherwise("superseded by newer atom"), "superseded_by": F.col("end")})
    cols = ["query_id", "doc_id", "score", "position", "confidence", "why", "superseded_by"]
    return live.select(*cols).union(old.select(*cols)).withColumn("should_trust", F.col("confidence") >= TRUST_FLOOR)


def rendered(results: DataFrame, atoms: DataFrame, provenance: DataFrame) -> DataFrame:
    """results with their handle line and their whole entry."""
    first = provenance.groupBy(F.col("atom_id").alias("doc_id")).agg(F.min_by(F.struct("source", "agent", "recorded_at"), F.struct("recorded_at", "source_ref")).alias("p"))
    x = results.join(atoms.select(F.col("id").alias("doc_id"), "text", tx.effective_time().alias("t")), "doc_id").join(first, "doc_id", "left")
    plain = tx.one_line(F.concat(F.lit("p3://"), F.col("doc_id").cast("string"), F.lit(" | "), tx.utc_date("t"), F.lit(" | "), F.format_string("%.2f", "confidence"), F.lit(" | "), tx.gist("text")))
    pointer = F.when(F.col("superseded_by").isNotNull(), F.concat(F.lit(", superseded by p3://"), F.col("superseded_by").cast("string"))).otherwise("")
    source = tx.one_line(F.concat(F.lit("source "), F.coalesce("p.source", F.lit("unknown")), F.lit(", "), F.coalesce("p.agent", F.lit("unknown")), F.lit(", recorded "), tx.utc_date("p.recorded_at"), pointer))
    handle = F.concat(plain, F.when(F.col("should_trust"), "").otherwise(" [untrusted]"), pointer)
    return x.select("query_id", "doc_id", "position", "confidence", "should_trust", handle.alias("handle"), F.concat_ws("\n", plain, tx.indented("text"), source).alias("entry"))


def enriched(lines: DataFrame, budget: int = 1500) -> DataFrame:
    """lines (query_id, position, should_trust, handle, entry, extra) with as many of the
    array extra appended to each trusted entry as fit into what its predecessors leave of
    the budget; the last go first.  Null extra is empty.

    Only lengths are folded, in rank order; texts stay in their rows."""
    extra = F.coalesce("extra", F.array().cast("array<string>"))
    size = lambda n: F.slice(extra, 1, n)
    whole = F.transform(F.sequence(F.lit(0), F.size(extra)), lambda n: F.length("entry") + F.aggregate(size(n), F.lit(0), lambda s, line: s + 1 + F.length(line)))
    x = lines.withColumn("lens", F.when(F.col("should_trust"), whole).otherwise(F.array(F.length("handle"))))
    tokens = lambda chars: F.ceil(chars / tx.CHARS_PER_TOKEN)
    fits = lambda s, r: F.size(F.filter(r["lens"], lambda n: tokens(n) <= budget - F.when(s["used"] == 0, 0).otherwise(tokens(s["used"] - 2) + 1)))
    step = lambda s, r: F.struct((s["used"] + 2 + F.element_at(r["lens"], F.greatest(F.lit(1), fits(s, r)))).alias("used"), (F.greatest(F.lit(1), fits(s, r)) - 1).alias("n"))
    w = Window.partitionBy("query_id").orderBy("position").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = x.withColumn("so_far", F.collect_list(F.struct("position", "lens")).over(w))
    x = x.withColumn("n", F.aggregate("so_far", F.struct(F.lit(0).alias("used"), F.lit(0).alias("n")), step)["n"])
    entry = F.when(F.col("should_trust"), F.array_join(F.concat(F.array("entry"), F.slice(extra, F.lit(1), F.col("n"))), "\n")).otherwise(F.col("entry"))
    return x.withColumn("entry", entry).drop("extra", "lens", "so_far", "n")


def payloads(lines: DataFrame, budget: int = 1500) -> DataFrame:
    """One text per query within a token budget: entries while they fit, then handles
    from the first misfit on; without a trusted result, a notice and three handles.

    The prefix is a running sum of lengths, so no query's rows meet in Python."""
    w = Window.partitionBy("query_id").orderBy("position")
    so_far, all_rows = w.rowsBetween(Window.unboundedPreceding, Window.currentRow), Window.partitionBy("query_id")
    tokens = lambda chars: F.ceil(chars / 3)
    x = lines.withColumn("any", F.max(F.col("should_trust").cast("int")).over(all_rows) == 1).withColumn("own", F.when(F.col("should_trust"), F.col("entry")).otherwise(F.col("handle")))
    x = x.withColumn("n", F.row_number().over(w))
    x = x.withColumn("fits", tokens(F.sum(F.length("own")).over(so_far) + 2 * (F.col("n") - 1)) <= budget)
    x = x.withColumn("body", F.min(F.col("fits").cast("int")).over(so_far) == 1)
    x = x.withColumn("line", F.when(F.col("body"), F.col("own")).otherwise(F.col("handle")))
    x = x.withColumn("shown", F.min((F.col("body") | (tokens(F.sum(F.length("line")).over(so_far) + 2 * (F.col("n") - 1)) <= budget)).cast("int")).over(so_far) == 1)
    good = x.filter("any AND shown").groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "line"))), lambda s: s["line"]), "\n\n").alias("payload"), F.lit(False).alias("low_confidence"))
    starved = x.filter("any").groupBy("query_id").agg(F.max("shown").alias("s")).filter("NOT s").select("query_id", F.lit(TOO_SMALL if -(-len(TOO_SMALL) // 3) <= budget else "").alias("payload"), F.lit(False).alias("low_confidence"))
    weak = x.filter("NOT any AND n <= 3").withColumn("upto", tokens(F.sum(F.length("handle") + 1).over(so_far) + len(NO_MATCH)) <= budget)
    weak = weak.withColumn("upto", F.min(F.col("upto").cast("int")).over(so_far) == 1)
    fits = -(-len(NO_MATCH) // 3) <= budget
    low = weak.groupBy("query_id").agg(F.concat_ws("\n", F.lit(NO_MATCH), F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("upto"), F.struct("n", "handle")))), lambda s: s["handle"]), "\n")).alias("payload"))
    low = low.select("query_id", F.when(F.lit(fits), F.regexp_replace("payload", "\n$", "")).otherwise("").alias("payload"), F.lit(True).alias("low_confidence"))
    return good.union(starved).union(low).withColumn("tokens", tx.token_estimate("payload"))
