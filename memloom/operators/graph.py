"""The bipartite graph of entities and documents, and activation over it.

For this graph the spreading of activation has a closed form: a document's score
is the maximum, over matched entities, of seed * decay * edge weight.  So a batch
of queries is one join with the seed terms, one with the edges, a maximum and a
top-k.  ``spread`` is the general form for other graphs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from memloom.functions import text as tx

# Words that are neither seeds nor partial matches.
STOPWORDS = (
    "a an the and or but in on at to for of with by from up about into over after is are was were be been being have has had do "
    "does did will would could should may might shall can need dare ought used must not no nor so if when what which who whom how "
    "where why that this these those it its he she they we you me him her us them my your his our their mine yours ours theirs all "
    "each every both few more most other some such any only own same than too very just also now here there then once much many "
    "well back even still new old long big good bad great right left high low part first last made make like get got set put see say "
    "said know take come think look want give use find tell ask work seem feel try leave call keep let begin show hear play run move "
    "live believe hold bring happen write provide sit stand lose pay meet include continue end start turn help way yes using going able"
).split()


@dataclass(frozen=True)
class GraphConfig:
    """Weights and thresholds of the activation."""

    spec_power: float = 0.2
    edge_weight: float = 5.0
    exact_boost: float = 1.5
    partial_boost: float = 0.8
    token_boost: float = 0.5
    decay: float = 0.6
    threshold: float = 0.15
    max_hops: int = 4
    max_active: int = 50
    token_label_limit: int = 10_000

    def __post_init__(self):
        if not 0 < self.decay <= 1 or self.threshold < 0 or self.max_hops < 0 or self.max_active < 1 or self.edge_weight <= 0:
            raise ValueError("a weight or limit is out of its range")


class EntityGraph:
    """Tables of a graph built from mentions (doc_id, label, etype)."""

    def __init__(self, mentions: DataFrame, config: GraphConfig | None = None):
        self.config = config or GraphConfig()
        self.mentions = mentions
        self.frequency = mentions.groupBy("label").agg(F.count("*").alias("freq"))
        spec = F.pow(F.col("freq").cast("double"), F.lit(-self.config.spec_power))
        links = mentions.filter(F.length("label") >= 2).select("doc_id", "etype", "label").distinct()
        self.edges = links.join(self.frequency, "label").select("doc_id", "etype", "label", spec.alias("spec"), (spec * self.config.edge_weight).alias("weight"))
        self.entities = links.select("etype", "label").distinct().join(self.frequency, "label").select("etype", "label", "freq", spec.alias("spec"))

    def stats(self) -> DataFrame:
        """Numbers of nodes and edges, in one row."""
        e = self.edges.agg(F.count("*").alias("edges"), F.countDistinct("etype", "label").alias("entity_nodes"), F.countDistinct("doc_id").alias("value_nodes"), F.countDistinct("label").alias("labels"))
        return e.select((F.col("entity_nodes") + F.col("value_nodes")).alias("nodes"), "edges", "entity_nodes", "value_nodes", "labels")

    def seed_terms(self) -> DataFrame:
        """(term, etype, label, class): 1 the label itself, 2 a word of it, 3 an alphanumeric part."""
        e = self.entities.select("etype", "label")
        words = e.select(F.explode(F.split("label", r"\s+")).alias("term"), "etype", "label").filter(~F.col("term").isin(STOPWORDS))
        tokens = e.select(F.explode(F.regexp_extract_all("label", F.lit("[a-z0-9]+"), 0)).alias("term"), "etype", "label").filter("length(term) >= 2")
        every = e.select(F.col("label").alias("term"), "etype", "label", F.lit(1).alias("class")).union(words.filter("term <> label").withColumn("class", F.lit(2))).union(tokens.filter("term <> label").withColumn("class", F.lit(3)))
        return every.groupBy("term", "etype", "label").agg(F.min("class").alias("class"))

    def seeds(self, words: DataFrame, with_tokens: bool = False) -> DataFrame:
        """Activated entities of (query_id, word): query_id, etype, label, seed.

        Parts of labels (class 3) count only where nothing better matched the
        entity; they are meant for graphs of at most ``token_label_limit`` labels.
        """
        c = self.config
        asked = words.filter(~F.col("word").isin(STOPWORDS)).distinct()
        hits = asked.join(self.seed_terms(), asked["word"] == F.col("term")).filter(F.col("class").isin(1, 2) | (F.lit(with_tokens) & (F.length("word") >= 4)))
        best = hits.groupBy("query_id", "etype", "label").agg(F.min("class").alias("class"))
        boost = F.when(F.col("class") == 1, c.exact_boost).when(F.col("class") == 2, c.partial_boost).otherwise(c.token_boost)
        return best.join(self.entities.select("etype", "label", "spec"), ["etype", "label"]).select("query_id", "etype", "label", (boost * F.col("spec")).alias("seed"))

    def activate(self, seeds: DataFrame) -> DataFrame:
        """(query_id, doc_id, score) of all documents that seeds reach, before the threshold."""
        live = seeds.filter(F.col("seed") >= self.config.threshold)
        return live.join(self.edges.select("etype", "label", "doc_id", "weight"), ["etype", "label"]).groupBy("query_id", "doc_id").agg(F.max(F.col("seed") * self.config.decay * F.col("weight")).alias("score"))

    def query(self, queries: DataFrame, top_k: int = 10, context: DataFrame | None = None, with_tokens: bool = False) -> DataFrame:
        """The best documents of (query_id, query_text): query_id, doc_id, score, rank.

        context (query_id, word) multiplies the score of what it reaches itself by
        one plus its own activation, before the threshold.
        """
        if top_k <= 0:
            return self.activate(self.seeds(queries.select("query_id", F.explode(tx.query_words("query_text")).alias("word")))).limit(0).withColumn("rank", F.lit(1))
        words = queries.select("query_id", F.explode(tx.query_words("query_text")).alias("word"))
        scores = self.activate(self.seeds(words, with_tokens))
        if context is not None:
            own = context.filter(F.length("word") > 1).select("query_id", F.regexp_replace(F.lower("word"), r"^[?.,]+|[?.,]+$", "").alias("word"))
            more = self.activate(self.seeds(own, with_tokens)).withColumnRenamed("score", "ctx")
            scores = scores.join(more, ["query_id", "doc_id"], "left").select("query_id", "doc_id", (F.col("score") * (1 + F.coalesce("ctx", F.lit(0.0)))).alias("score"))
        return top_by(scores.filter(F.col("score") >= self.config.threshold), top_k)


def top_by(scores: DataFrame, k: int, by=("query_id",), item: str = "doc_id") -> DataFrame:
    """The k best of each group by score, ties to the smaller item, with their rank."""
    w = Window.partitionBy(*by).orderBy(F.desc("score"), item)
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def spread(edges: DataFrame, seeds: DataFrame, hops: int, config: GraphConfig | None = None) -> DataFrame:
    """Activation (query_id, node, score) over any graph (src, dst, weight), hop by hop.

    In each hop a node keeps its decayed activation and passes decayed activation
    times weight to its neighbours if it reaches the threshold; the strongest
    ``max_active`` of a query go on.  Each hop is written out, so lineage stays short.
    """
    from memloom.sources.tables import durable

    c = config or GraphConfig()
    now = seeds.select("query_id", "node", "score")
    for _ in range(hops):
        kept = now.select("query_id", "node", (F.col("score") * c.decay).alias("score"))
        sent = now.filter(F.col("score") >= c.threshold).join(edges, F.col("node") == F.col("src")).select("query_id", F.col("dst").alias("node"), (F.col("score") * c.decay * F.col("weight")).alias("score"))
        best = kept.union(sent).groupBy("query_id", "node").agg(F.max("score").alias("score"))
        now = durable(top_by(best, c.max_active, item="node").drop("rank").filter(F.col("score") >= c.threshold))
    return now


def bands(frequency: DataFrame, n_bands: int = 5) -> DataFrame:
    """(label, band): frequency bands at equal quantiles of the log frequency.

    A band is at least half a unit wide in log1p, and there are no more bands than
    distinct frequencies.  What is aggregated is one row per distinct frequency.
    """
    logs = frequency.groupBy("freq").agg(F.count("*").alias("n")).withColumn("lf", F.log1p(F.col("freq").cast("double")))
    span = logs.agg(F.least(F.lit(n_bands), F.count("*"), F.greatest(F.lit(1), F.floor((F.max("lf") - F.min("lf")) / 0.5))).cast("int").alias("b"), *[F.expr(f"percentile(lf, array({', '.join(str(k / n) for k in range(1, n + 1))}), n)").alias(f"q{n}") for n in range(2, n_bands + 1)])
    edge = F.lit(None).cast("array<double>")
    for n in range(2, n_bands + 1):
        edge = F.when(F.col("b") == n, F.col(f"q{n}")).otherwise(edge)
    by_freq = _banded(logs, span, edge)
    return frequency.join(by_freq, "freq").select("label", "band")


def _banded(logs: DataFrame, span: DataFrame, edge) -> DataFrame:
    one = span.withColumn("one", F.lit(1))  # a single row
    both = logs.withColumn("one", F.lit(1)).join(F.broadcast(one), "one")
    return both.select("freq", F.when(F.col("b") <= 1, 0).otherwise(F.least(F.col("b") - 1, F.size(F.filter(edge, lambda e: e <= F.col("lf"))))).alias("band"))


def boundary(results: DataFrame, graph: EntityGraph, words: DataFrame, n_bands: int = 5) -> DataFrame:
    """Diagnosis of each query's results (query_id, doc_id, score, rank): distance to
    the threshold, gap to the runner-up, band crossing, whether context is needed,
    which labels would help, confidence and advice."""
    t = graph.config.threshold
    two = results.filter("rank <= 2").groupBy("query_id").agg(
        F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("s1"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("s2"),
        F.max(F.when(F.col("rank") == 1, F.col("doc_id"))).alias("d1"), F.max(F.when(F.col("rank") == 2, F.col("doc_id"))).alias("d2"),
    )
    crossing = graph.seeds(words).join(bands(graph.frequency, n_bands), "label").groupBy("query_id").agg((F.countDistinct("band") > 1).alias("band_crossing"))
    out = two.join(crossing, "query_id", "left").withColumns({"boundary_distance": F.col("s1") - t, "disambiguation_gap": F.col("s1") - F.col("s2"), "band_crossing": F.coalesce("band_crossing", F.lit(False))})
    out = out.withColumn("context_needed", F.coalesce(F.col("disambiguation_gap") < 0.05, F.lit(False)))
    tied = out.filter("context_needed").select("query_id", F.explode(F.array(F.struct(F.lit(1).alias("side"), F.col("d1").alias("doc_id")), F.struct(F.lit(2).alias("side"), F.col("d2").alias("doc_id")))).alias("x")).select("query_id", "x.side", "x.doc_id")
    own = tied.join(graph.edges.select("doc_id", "label").distinct(), "doc_id").groupBy("query_id", "label").agg(F.countDistinct("side").alias("n"))
    help_ = own.filter("n = 1").groupBy("query_id").agg(F.sort_array(F.collect_set("label")).alias("suggested_context"))
    out = out.join(help_, "query_id", "left").withColumn("suggested_context", F.coalesce("suggested_context", F.array().cast("array<string>")))
    out = out.withColumn("fundamentally_ambiguous", F.col("context_needed") & (F.size("suggested_context") == 0))
    gap, dist = F.col("disambiguation_gap"), F.col("boundary_distance")
    conf = F.when(F.col("context_needed"), "low").when((dist >= 0.15) & (gap.isNull() | (gap >= 0.10)), "high").when((dist < 0.05) & (gap < 0.05), "low").otherwise("medium")
    out = out.withColumn("confidence", conf)
    advice = F.when(F.col("context_needed") & ~F.col("fundamentally_ambiguous"), "request_context").when(F.col("context_needed"), "warn_ambiguous").when(F.col("confidence") == "low", "warn_low_confidence").otherwise("trust")
    return out.select("query_id", "boundary_distance", "disambiguation_gap", "band_crossing", "context_needed", "suggested_context", "fundamentally_ambiguous", "confidence", advice.alias("recommended_action"))
