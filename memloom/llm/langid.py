"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the bytes of a text, blanks included, forwards and backwards and
labels every byte position with probabilities of the languages; a document's
probabilities are the mean over all positions of the whole text.  It reads
overlapping windows: ``CORE`` positions that it labels, and ``MARGIN`` more on either
side that only bring the states up.  Outside the text there are blanks.  So a
position's label depends on its own text alone, whatever else is in a batch.  The
network is trained in numpy by backpropagation through time, written out below.
Gates are piecewise linear, which is exact and cheap.

Defined results: a text that is null or has no letter is ``und`` with score 0;
ties go to the language that sorts first; rows with null language aren't learnt
from; with nothing to learn from every language is ``und``.  Language, source and
id are never inputs.  Repeated rows give repeated rows; other columns are ignored,
whatever they are called; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memloom.llm._common import bounded_sample

CORE, MARGIN = 48, 8
WINDOW = CORE + 2 * MARGIN
#: Windows that are read at once.
_AT_ONCE = 2048
_LETTER = regex.compile(r"\p{L}")


def _gate(x):
    return np.clip(0.25 * x + 0.5, 0, 1)


def _gate_slope(y):
    return 0.25 * ((y > 0) & (y < 1))


def _flat(x):
    return np.clip(x, -1, 1)


def _flat_slope(y):
    return 1.0 * ((y > -1) & (y < 1))


@dataclass
class ByteTagger:
    """Parameters: for each direction an input table (byte to gates), recurrent
    weights, and the output layer over both states."""

    langs: list[str]
    p: dict[str, np.ndarray]

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """For each text the mean of its positions' probabilities; zeros if it is empty."""
        sizes = np.array([len(t) for t in texts], np.int64)
        x, inside, owner = windows(texts)
        sums = np.zeros((len(texts), len(self.langs)))
        for at in range(0, len(owner), _AT_ONCE):
            part = slice(at, at + _AT_ONCE)
            np.add.at(sums, owner[part], _core_sums(self.p, x[part], inside[part]))
        return sums / np.maximum(sizes, 1)[:, None]


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The windows of all texts (one row each), how many of a window's core positions
    are inside its text, and whose it is."""
    counts = np.array([-(-len(t) // CORE) for t in texts], np.int64)
    side = b" " * MARGIN
    raw = np.frombuffer(b"".join(side + t + b" " * (-len(t) % CORE) + side for t in texts if t), np.uint8)
    owner = np.repeat(np.arange(len(texts)), counts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    # each text before has its cores and two margins in raw
    starts = np.arange(len(owner)) * CORE + 2 * MARGIN * np.repeat(np.cumsum(counts > 0) - (counts > 0), counts)
    sizes = np.array([len(t) for t in texts], np.int64)[owner]
    x = np.lib.stride_tricks.sliding_window_view(raw, WINDOW)[starts] if len(owner) else np.empty((0, WINDOW), np.uint8)
    return x, np.minimum(CORE, sizes - nth * CORE), owner


def _states(p: dict, x: np.ndarray, way: str) -> np.ndarray:
    """The states of one direction at the core positions: (positions, windows, hidden)."""
    wh = p[f"{way}h"]
    n = wh.shape[0]
    # the gates' slope and offset go into their weights
    scale = np.concatenate([np.full(2 * n, 0.25), np.ones(n)]).astype(np.float32)
    table = (p[f"{way}x"] * scale + np.concatenate([np.full(2 * n, 0.5), np.zeros(n)])).astype(np.float32)
    gates_h, content_h = np.ascontiguousarray(0.25 * wh[:, : 2 * n]).astype(np.float32), np.ascontiguousarray(wh[:, 2 * n :])
    h = np.zeros((len(x), n), np.float32)
    out = np.empty((CORE, len(x), n), np.float32)
    columns = np.ascontiguousarray(x.T)
    for t in range(WINDOW - MARGIN) if way == "f" else range(WINDOW - 1, MARGIN - 1, -1):
        gx = table.take(columns[t], 0)
        gates = h @ gates_h
        gates += gx[:, : 2 * n]
        np.maximum(gates, 0, out=gates)
        np.minimum(gates, 1, out=gates)
        c = (gates[:, n:] * h) @ content_h
        c += gx[:, 2 * n :]
        np.maximum(c, -1, out=c)
        np.minimum(c, 1, out=c)
        c -= h
        c *= gates[:, :n]
        h += c
        if MARGIN <= t < MARGIN + CORE:
            out[t - MARGIN] = h
    return out


def _core_sums(p: dict, x: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """For each window the sum of the probabilities at its core positions inside the text."""
    n = p["fh"].shape[0]
    logits = _states(p, x, "f") @ p["o"][:n] + _states(p, x, "b") @ p["o"][n:] + p["ob"]
    logits -= logits.max(-1, keepdims=True)
    e = np.exp(logits, out=logits)
    e *= ((np.arange(CORE)[:, None] < inside[None, :]) / e.sum(-1))[:, :, None].astype(np.float32)
    return e.sum(0)


def _run(p: dict, x: np.ndarray, way: str) -> list[tuple]:
    """The states of one direction, step by step."""
    wx, wh = p[f"{way}x"], p[f"{way}h"]
    n_hidden = wh.shape[0]
    h = np.zeros((len(x), n_hidden), wx.dtype)
    steps = []
    order = range(x.shape[1]) if way == "f" else range(x.shape[1] - 1, -1, -1)
    for t in order:
        gx = wx[x[:, t]]
        gates = _gate(gx[:, : 2 * n_hidden] + h @ wh[:, : 2 * n_hidden])
        z, r = gates[:, :n_hidden], gates[:, n_hidden:]
        rh = r * h
        c = _flat(gx[:, 2 * n_hidden :] + rh @ wh[:, 2 * n_hidden :])
        before, h = h, h + z * (c - h)
        steps.append((t, before, z, r, rh, c, h))
    return steps


def _tag(p: dict, x: np.ndarray):
    forward, backward = _run(p, x, "f"), _run(p, x, "b")
    both = np.stack([np.concatenate([f[-1], b[-1]], 1) for f, b in zip(forward, reversed(backward), strict=True)], 1)
    logits = both @ p["o"] + p["ob"]
    e = np.exp(logits - logits.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True), forward, backward, both


def _through_time(p: dict, x: np.ndarray, steps: list[tuple], dstates: np.ndarray, way: str, g: dict) -> None:
    """Backpropagation through the steps of one direction; adds to g."""
    wh, n_hidden = p[f"{way}h"], p[f"{way}h"].shape[0]
    dh = np.zeros_like(steps[0][1])
    for t, before, z, r, rh, c, _ in reversed(steps):
        dh = dh + dstates[:, t]
        dz, dc = dh * (c - before) * _gate_slope(z), dh * z * _flat_slope(c)
        drh = dc @ wh[:, 2 * n_hidden :].T
        dr = drh * before * _gate_slope(r)
        dg = np.concatenate([dz, dr], 1)
        g[f"{way}h"][:, : 2 * n_hidden] += before.T @ dg
        g[f"{way}h"][:, 2 * n_hidden :] += rh.T @ dc
        np.add.at(g[f"{way}x"], x[:, t], np.concatenate([dg, dc], 1))
        dh = dh * (1 - z) + drh * r + dg @ wh[:, : 2 * n_hidden].T


def gradients(p: dict, x: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[float, dict]:
    """Cross-entropy summed over all positions, weighted position by position, and its gradients."""
    probs, forward, backward, both = _tag(p, x)
    rows = np.arange(len(x))
    loss = -(weight * np.log(probs[rows, :, target])).sum()
    d = probs.copy()
    d[rows, :, target] -= 1
    d *= weight[:, :, None]
    g = {k: np.zeros_like(v) for k, v in p.items()}
    g["o"] += np.einsum("nth,ntl->hl", both, d)
    g["ob"] += d.sum((0, 1))
    dboth, hidden = d @ p["o"].T, p["fh"].shape[0]
    _through_time(p, x, forward, dboth[:, :, :hidden], "f", g)
    _through_time(p, x, backward, dboth[:, :, hidden:], "b", g)
    return float(loss), g


def train(texts: list[str], langs: list[str], hidden: int = 12, windows_per_text: int = 6, epochs: int = 3, batch: int = 128, rate: float = 0.01, seed: int = 11) -> ByteTagger:
    """Fit the network by Adam on windows drawn evenly from the whole of each text."""
    names = sorted(set(langs))
    if not names:
        return ByteTagger([], {})
    rng = np.random.default_rng(seed)
    x, inside, owner = windows([(t or "").encode("utf-8", "surrogatepass") for t in texts])
    order = rng.permutation(len(owner))
    first = np.argsort(owner[order], kind="stable")
    place = np.arange(len(owner)) - np.searchsorted(owner[order][first], owner[order][first])
    chosen = order[first[place < windows_per_text]]
    x, inside = x[chosen], inside[chosen]
    target = np.array([names.index(v) for v in langs], np.int64)[owner[chosen]]
    at = np.arange(WINDOW)
    learnt = ((at >= MARGIN) & (at[None, :] < MARGIN + inside[:, None])).astype(np.float32)
    init = lambda *s: rng.normal(0, 0.3, s).astype(np.float32)
    n_lang = len(names)
    p = {"fx": init(256, 3 * hidden), "fh": init(hidden, 3 * hidden), "bx": init(256, 3 * hidden), "bh": init(hidden, 3 * hidden), "o": init(2 * hidden, n_lang), "ob": np.zeros(n_lang, np.float32)}
    m1, m2, t = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    share = np.bincount(target, learnt.sum(1), n_lang) / max(1.0, learnt.sum())
    even = np.where(share > 0, 1 / np.maximum(n_lang * share, 1e-9), 0)  # every language counts as much as any other
    for epoch in range(epochs):
        shuffled = rng.permutation(len(x))
        for first_row in range(0, len(x), batch):
            rows = shuffled[first_row : first_row + batch]
            weight = learnt[rows] * even[target[rows]][:, None].astype(np.float32)
            _, g = gradients(p, x[rows], target[rows], (weight / max(1.0, learnt[rows].sum())).astype(np.float32))
            t += 1
            step = rate / (1 + epoch)
            for k in p:
                m1[k] += 0.1 * (g[k] - m1[k])
                m2[k] += 0.001 * (g[k] * g[k] - m2[k])
                p[k] -= (step * (m1[k] / (1 - 0.9**t)) / (np.sqrt(m2[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return ByteTagger(names, p)


def predict(model: ByteTagger, texts: pa.Array) -> tuple[list[str], list[float]]:
    """The language and its probability for each text."""
    own = [x or "" for x in texts.to_pylist()]
    known = [bool(model.langs) and _LETTER.search(x) is not None for x in own]
    names, scores = ["und"] * len(own), [0.0] * len(own)
    rows = np.flatnonzero(known)
    if len(rows):
        mean = model.pooled([own[k].encode("utf-8", "surrogatepass") for k in rows])
        for k, best, share in zip(rows.tolist(), mean.argmax(1).tolist(), mean.max(1).tolist(), strict=True):
            names[k], scores[k] = model.langs[best], min(1.0, max(0.0, share))
    return names, scores


def held_out(id_col: str = "doc_id"):
    """Rows that are never learnt from."""
    return F.expr(f"crc32(encode(CAST(`{id_col}` AS STRING), 'UTF-8')) % 4 = 2")


def fit_langid(docs: DataFrame, max_docs: int = 1500, max_bytes: int = 32 << 20) -> ByteTagger:
    """Learn from rows with a language that aren't held out: of those with the
    ``max_docs`` smallest hashes of their id as many as ``max_bytes`` hold."""
    known = docs.select("doc_id", "text", "lang").filter("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL").filter(~held_out())
    rows = bounded_sample(known, max_docs, max_bytes)
    return train([r["text"] for r in rows], [r["lang"] for r in rows])


OUT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
#: Rows whose windows are gathered at once.
_ROWS = 200


def identify_language(docs: DataFrame, model: ByteTagger) -> DataFrame:
    """Per row of docs: id, whether it is held out, language and its probability."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                names, scores = predict(model, part.column(2))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=OUT.names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(run, OUT)
