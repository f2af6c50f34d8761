"""A quality classifier that learns where in a document its quality shows.

Attention-based multiple-instance learning: a document is a bag of passages and
only the bag has a label.  Every passage is encoded, a gated attention gives
each a weight, and the document's score is the logistic of the weighted mean of
the encoded passages.  The network is trained in numpy, the gradients are
written out below.

A passage's raw features are counts of pairs of neighbouring byte classes and
three measures of repetition, all from its own bytes; ids, sources, languages
and labels are never inputs.  Passages are consecutive stretches of
``PASSAGE`` bytes of the whole text, with no limit on their number.

Defined results: a null text is an empty one, and an empty text has a single
passage without bytes, so it gets a score too; a null label is no label; a
document that has several labels is learnt from once for each; if there is
nothing to learn from, or all labels agree, the score is the share of label 1
(0.5 without labels).  Other columns are ignored, whatever they are called;
an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memloom.llm._common import bounded_sample

PASSAGE = 512
_KINDS = 14


def _byte_kinds() -> np.ndarray:
    kinds = np.full(256, 11, np.uint8)  # 11: other controls
    kinds[ord("a") : ord("z") + 1] = 0
    for c in b"aeiou":
        kinds[c] = 1
    kinds[ord("A") : ord("Z") + 1] = 2
    kinds[ord("0") : ord("9") + 1] = 3
    kinds[ord(" ")] = 4
    kinds[10] = kinds[13] = 5
    for c in range(33, 127):
        if not chr(c).isalnum():
            kinds[c] = 6
    for c in b".,;:'":
        kinds[c] = 7
    for c in b"!?":
        kinds[c] = 8
    for c in b"()[]{}<>|/\\":
        kinds[c] = 9
    kinds[9] = 10
    kinds[128:192] = 12
    kinds[192:] = 13
    return kinds


_KIND = _byte_kinds()
N_FEATURES = _KINDS * _KINDS + 3


def passage_features(text: str | None) -> np.ndarray:
    """One row of features for each passage of the whole text."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    n = len(raw)
    if not n:
        return np.zeros((1, N_FEATURES), np.float32)
    m = -(-n // PASSAGE)
    kinds = _KIND[raw].astype(np.int32)
    place = np.arange(n, dtype=np.int32) // PASSAGE
    sizes = np.bincount(place, minlength=m).astype(np.float32)[:, None]
    pairs = np.bincount(place[1:] * (_KINDS * _KINDS) + kinds[:-1] * _KINDS + kinds[1:], minlength=m * _KINDS * _KINDS)
    pairs = pairs.reshape(m, _KINDS * _KINDS).astype(np.float32) / sizes
    # repetition: how few of 1024 cells the passage's four-byte strings fill,
    # and whether its 4- and 12-byte strings were there one passage ago
    four = raw.astype(np.uint32)
    four = (four[:-3] | four[1:-2] << 8 | four[2:-1] << 16 | four[3:] << 24) if n > 3 else np.zeros(1, np.uint32)
    code = (four * np.uint32(2654435761)) >> 22
    where = place[: len(code)]
    cells = np.bincount(where * 1024 + code.astype(np.int32), minlength=m * 1024).reshape(m, 1024)
    filled = (cells > 0).sum(1)[:, None] / sizes
    top = cells.max(1)[:, None] / sizes
    return np.hstack([np.sqrt(pairs), filled, top, np.minimum(sizes, PASSAGE) / PASSAGE]).astype(np.float32)


@dataclass
class Attention:
    """The network's parameters; small, whatever the corpus."""

    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray]
    constant: float | None = None

    def scores(self, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Scores of bags; the bag k has the rows from starts[k] on."""
        if self.constant is not None:
            return np.full(len(starts), self.constant)
        return _forward(self.p, (x - self.mean) / self.scale, starts)[0]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _forward(p: dict, x: np.ndarray, starts: np.ndarray):
    sizes = np.diff(np.append(starts, len(x)))
    bag = np.repeat(np.arange(len(starts)), sizes)
    h = np.tanh(x @ p["W"] + p["b"])
    v, u = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
    logit = (v * u) @ p["w"]
    e = np.exp(logit - np.maximum.reduceat(logit, starts)[bag])
    a = e / np.add.reduceat(e, starts)[bag]
    z = np.add.reduceat(h * a[:, None], starts)
    return _sigmoid(z @ p["c"] + p["d"][0]), (bag, h, v, u, a, z)


def _gradients(p: dict, x: np.ndarray, starts: np.ndarray, y: np.ndarray, decay: float) -> dict:
    score, (bag, h, v, u, a, z) = _forward(p, x, starts)
    ds = (score - y) / len(y)
    dz = ds[:, None] * p["c"]
    da = (h * dz[bag]).sum(1)
    dlogit = a * (da - np.add.reduceat(a * da, starts)[bag])
    dgate = dlogit[:, None] * p["w"]
    dv, du = dgate * u * (1 - v * v), dgate * v * u * (1 - u)
    dh = (a[:, None] * dz[bag] + dv @ p["V"].T + du @ p["U"].T) * (1 - h * h)
    g = {"W": x.T @ dh, "b": dh.sum(0), "V": h.T @ dv, "U": h.T @ du, "w": (v * u).T @ dlogit, "c": z.T @ ds, "d": np.array([ds.sum()])}
    for k in ("W", "c"):
        g[k] = g[k] + decay * p[k]
    return g


def train(texts: list[str | None], labels: list[int], hidden: int = 24, gate: int = 12, epochs: int = 30, batch: int = 64, rate: float = 0.004, decay: float = 1e-4, seed: int = 7) -> Attention:
    """Fit the network by Adam on whole texts."""
    y = np.array(labels, np.float64)
    if not len(y) or y.min() == y.max():
        return Attention(np.zeros(N_FEATURES), np.ones(N_FEATURES), {}, float(y.mean()) if len(y) else 0.5)
    rng = np.random.default_rng(seed)
    bags = [passage_features(t) for t in texts]
    every = np.concatenate(bags)
    mean, scale = every.mean(0), every.std(0) + 0.02
    bags = [(b - mean) / scale for b in bags]
    init = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
    p = {"W": init(N_FEATURES, hidden), "b": np.zeros(hidden), "V": init(hidden, gate), "U": init(hidden, gate), "w": init(gate), "c": init(hidden), "d": np.zeros(1)}
    m1, m2, t = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(bags))
        step = rate * 0.5 * (1 + np.cos(np.pi * epoch / epochs)) + 1e-5
        for at in range(0, len(order), batch):
            chosen = order[at : at + batch]
            starts = np.cumsum([0, *(len(bags[k]) for k in chosen[:-1])])
            g = _gradients(p, np.concatenate([bags[k] for k in chosen]), starts, y[chosen], decay)
            t += 1
            for k in p:
                m1[k] += 0.1 * (g[k] - m1[k])
                m2[k] += 0.001 * (g[k] * g[k] - m2[k])
                p[k] -= step * (m1[k] / (1 - 0.9**t)) / (np.sqrt(m2[k] / (1 - 0.999**t)) + 1e-8)
    return Attention(mean.astype(np.float32), scale.astype(np.float32), {k: v.astype(np.float32) for k, v in p.items()})


def held_out(id_col: str = "doc_id"):
    """Rows that are never learnt from."""
    return F.expr(f"crc32(encode(CAST(`{id_col}` AS STRING), 'UTF-8')) % 5 = 0")


def fit_quality(docs: DataFrame, labels: DataFrame, max_docs: int = 3000, max_bytes: int = 64 << 20) -> Attention:
    """Learn from labelled rows that aren't held out.

    ``max_docs`` bounds the labels that are used, those with the smallest hash of
    their id, an even sample at any size; of their documents as many as ``max_bytes``
    hold come to the driver.
    """
    known = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").filter(~held_out()).select("doc_id", "quality")
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(max_docs).distinct()
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = bounded_sample(texts, max_docs, max_bytes)
    return train([r["text"] for r in rows], [int(r["quality"]) for r in rows])


OUT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
#: Passages that are scored at once.
_AT_ONCE = 4096
#: Rows that are copied at once.
_ROWS = 640


def _score_texts(model: Attention, texts: Iterator[str | None]) -> list[float]:
    out: list[float] = []
    held, starts, n = [], [], 0

    def flush() -> None:
        nonlocal n
        if held:
            out.extend(model.scores(np.concatenate(held), np.array(starts)).tolist())
        held.clear()
        starts.clear()
        n = 0

    for text in texts:
        x = passage_features(text)
        held.append(x)
        starts.append(n)
        n += len(x)
        if n >= _AT_ONCE:
            flush()
    flush()
    return out


def score_quality(docs: DataFrame, model: Attention, threshold: float = 0.3) -> DataFrame:
    """Per row of docs: id, whether it is held out, score, and 1 if score >= threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = _score_texts(model, (x.as_py() for x in batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())], names=OUT.names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(run, OUT)


def keep_quality(docs: DataFrame, model: Attention, threshold: float = 0.3) -> DataFrame:
    """The rows of docs, with all their columns, that the classifier doesn't reject."""
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, _ROWS) for b in batches for at in range(0, b.num_rows, _ROWS)):
            scores = _score_texts(model, (x.as_py() for x in batch.column(place)))
            yield batch.filter(pa.array([s >= threshold for s in scores], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
