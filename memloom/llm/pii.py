"""Personal data in texts: fixed patterns, and a character tagger that adds to them.

The patterns find e-mail addresses, IPv4 addresses, payment cards and phone
numbers as written in the usual way; what they find stays.  A bidirectional
LSTM over characters with a CRF over its tags reads the neighbourhood of every
digit, at sign or bracketed "at", in overlapping windows of the whole text.  Spans
that a window's edge cuts are put together with what overlapping windows say of
them; then all are reconciled over the whole text (the surer one wins, then the
longer, then the earlier), held against the arithmetic of their kind (digits, parts,
check sum, word borders) and added where they overlap nothing found before.  A span
of these kinds has such a character, so windows without one can hold none and aren't
read.

The tagger is trained in numpy from labelled spans: those of the patterns in a
bounded sample of documents, and made-up ones, many in spellings or neighbourhoods
that the patterns don't cover, set into the same texts.  ``measure`` says how many
of made-up ones it finds and how much of what it finds is one.

Defined results: a null text is an empty one; rows are independent of each
other; offsets are code points, ends exclusive; other columns are ignored,
whatever they are called; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from memloom.llm._common import bounded_sample

KINDS = ("email", "ip", "card", "phone")
_BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_TRIGGER, _SPELT = re.compile("[0-9@]"), re.compile(r"[(\[]at[)\]]")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
WINDOW, STRIDE = 64, 24


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _holds(kind: str, s: str) -> bool:
    """What a match must have beyond its pattern."""
    if kind == "ip":
        return all(len(x.lstrip("0")) <= 3 and int(x[-3:]) <= 255 for x in s.split("."))
    if kind == "card":
        d = _digits(s)
        return 12 <= len(d) <= 19 and luhn(d)
    if kind == "phone":
        return 9 <= len(_digits(s)) <= 15
    return True


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The leftmost matches, found from their at signs so that long words
    without one cost nothing."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _BASE["email"].match(text, start) if start < at else None
        if m:
            yield m.span()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _ips(text: str) -> Iterator[tuple[int, int]]:
    """The leftmost matches: in each chain of numbers and dots, four numbers at a time."""
    for m in _CHAIN.finditer(text):
        parts = m.group().split(".")
        at = m.start()
        for k in range(0, len(parts) - 3, 4):
            size = sum(map(len, parts[k : k + 4])) + 3
            yield at, at + size
            at += size + 1


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The patterns' spans by start, then kind as listed."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if re.search("[0-9]", text):
        for kind in KINDS[1:]:
            if kind == "phone" and "+" not in text:
                continue
            found = _ips(text) if kind == "ip" else (m.span() for m in _BASE[kind].finditer(text))
            out += [(kind, a, b) for a, b in found if _holds(kind, text[a:b])]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


# ---- the tagger -----------------------------------------------------------

N_TAGS = 1 + 2 * len(KINDS)
_N_CHARS = 132


def _codes(text: str) -> np.ndarray:
    """Character classes: ASCII as it is, then letters, digits, blanks and the rest."""
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(raw) and raw.max() >= 128:
        other = np.array([128 + (0 if c.isalpha() else 1 if c.isdigit() else 2 if c.isspace() else 3) if ord(c) > 127 else ord(c) for c in text], np.int64)
        return other
    return raw.astype(np.int64)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _lstm(p: dict, way: str, x: np.ndarray) -> list[tuple]:
    """One direction's steps; gates in the order input, forget, output, content."""
    wx, wh = p[f"{way}x"], p[f"{way}h"]
    n = wh.shape[0]
    h = c = np.zeros((len(x), n))
    steps = []
    for t in range(x.shape[1]) if way == "f" else range(x.shape[1] - 1, -1, -1):
        g = wx[x[:, t]] + h @ wh
        s, q = _sigmoid(g[:, : 3 * n]), np.tanh(g[:, 3 * n :])
        i, f, o = s[:, :n], s[:, n : 2 * n], s[:, 2 * n :]
        c_before, h_before = c, h
        c = f * c + i * q
        tc = np.tanh(c)
        h = o * tc
        steps.append((t, h_before, c_before, i, f, o, q, tc, h))
    return steps


def _emissions(p: dict, x: np.ndarray):
    f, b = _lstm(p, "f", x), _lstm(p, "b", x)
    both = np.stack([np.concatenate([u[-1], v[-1]], 1) for u, v in zip(f, reversed(b), strict=True)], 1)
    return both @ p["o"] + p["ob"], f, b, both


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return np.log(np.exp(x - m).sum(axis)) + m.squeeze(axis)


def _marginals(e: np.ndarray, trans: np.ndarray):
    """Forward-backward: log partition, tag marginals and summed transition marginals."""
    n, length, k = e.shape
    alpha, beta = np.empty_like(e), np.zeros_like(e)
    alpha[:, 0] = e[:, 0]
    for t in range(1, length):
        alpha[:, t] = e[:, t] + _log_sum(alpha[:, t - 1, :, None] + trans, 1)
    for t in range(length - 2, -1, -1):
        beta[:, t] = _log_sum(trans + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
    z = _log_sum(alpha[:, -1], 1)
    tags = np.exp(alpha + beta - z[:, None, None])
    pairs = np.zeros((k, k))
    for t in range(1, length):
        pairs += np.exp(alpha[:, t - 1, :, None] + trans + (e[:, t] + beta[:, t])[:, None, :] - z[:, None, None]).sum(0)
    return z, tags, pairs


def _viterbi(e: np.ndarray, trans: np.ndarray) -> np.ndarray:
    n, length, _ = e.shape
    best, back = e[:, 0], []
    for t in range(1, length):
        s = best[:, :, None] + trans
        back.append(s.argmax(1))
        best = s.max(1) + e[:, t]
    out = np.empty((n, length), np.int64)
    out[:, -1] = best.argmax(1)
    for t in range(length - 2, -1, -1):
        out[:, t] = back[t][np.arange(n), out[:, t + 1]]
    return out


def _rules() -> np.ndarray:
    """Transitions that can't be: the inside of a kind after anything but its own."""
    out = np.zeros((N_TAGS, N_TAGS))
    for k in range(len(KINDS)):
        inside = 2 + 2 * k
        out[:, inside] = -1e4
        out[inside - 1, inside] = out[inside, inside] = 0
    return out


def _through_time(p: dict, x: np.ndarray, steps: list, dstates: np.ndarray, way: str, g: dict) -> None:
    wh, n = p[f"{way}h"], p[f"{way}h"].shape[0]
    dh = dc = np.zeros_like(steps[0][1])
    for t, h_before, c_before, i, f, o, q, tc, _ in reversed(steps):
        dh = dh + dstates[:, t]
        dc = dc + dh * o * (1 - tc * tc)
        d = np.concatenate([dc * q * i * (1 - i), dc * c_before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - q * q)], 1)
        g[f"{way}h"] += h_before.T @ d
        np.add.at(g[f"{way}x"], x[:, t], d)
        dh, dc = d @ wh.T, dc * f


def gradients(p: dict, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
    """Mean negative log likelihood of the tags y, and its gradients."""
    e, f, b, both = _emissions(p, x)
    trans = p["trans"] + _rules()
    z, tags, pairs = _marginals(e, trans)
    n, length = y.shape
    own = e[np.arange(n)[:, None], np.arange(length), y].sum(1) + trans[y[:, :-1], y[:, 1:]].sum(1)
    d = tags.copy()
    d[np.arange(n)[:, None], np.arange(length), y] -= 1
    d /= n
    g = {k: np.zeros_like(v) for k, v in p.items()}
    g["trans"] += pairs / n
    np.add.at(g["trans"], (y[:, :-1].ravel(), y[:, 1:].ravel()), -1 / n)
    g["trans"] *= _rules() == 0
    g["o"] += np.einsum("nth,ntl->hl", both, d)
    g["ob"] += d.sum((0, 1))
    dboth, hidden = d @ p["o"].T, p["fh"].shape[0]
    _through_time(p, x, f, dboth[:, :, :hidden], "f", g)
    _through_time(p, x, b, dboth[:, :, hidden:], "b", g)
    return float((z - own).mean()), g


def _made_up(rng: np.random.Generator) -> tuple[str, list[tuple[str, int, int]]]:
    """A made-up string with the spans in it; it may look alike and hold none."""
    d = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    word = lambda n: "".join(chr(97 + c) for c in rng.integers(0, 26, n))
    pick = lambda *x: x[int(rng.integers(len(x)))]

    def one() -> tuple[str, str | None]:
        what = int(rng.integers(10))
        if what <= 1:
            name = f"{word(int(rng.integers(2, 9)))}{pick('.', '', '_')}{word(3)}{d(int(rng.integers(3)))}"
            return f"{name}{pick('@', '@', '(at)', '[at]', ' (at) ', ' [at] ')}{word(int(rng.integers(3, 9)))}{pick('', '-' + word(4), '.' + word(5))}.{pick('com', 'org', 'net', 'example.com', 'example')}", "email"
        if what in (2, 3):
            a, b, c = d(3), d(3), d(4)
            return pick(f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{d(1)} ({a}) {b}-{c}", f"+{d(1)} ({a}) {b}-{c}", f"+{d(2)} {a} {b} {c}", f"+{d(2)} {d(2)} {d(4)} {d(4)}", f"+{d(11)}"), "phone"
        if what in (4, 5):
            body = str(int(rng.integers(3, 7))) + d(14)
            number = next(body + str(k) for k in range(10) if luhn(body + str(k)))
            return pick(number, number, pick("-", " ", " ", ".").join(number[k : k + 4] for k in range(0, 16, 4))), "card"
        if what in (6, 7):
            return pick(".", ".", "[.]").join(str(int(x)) for x in rng.integers(0, 256, 4)), "ip"
        if what == 8:
            return pick(f"{d(4)}-{d(2)}-{d(2)}", f"v{d(1)}.{d(1)}.{d(2)}", d(4), d(7), d(10), f"{d(2)}.{d(2)}", f"{d(2)}:{d(2)}", f"{d(3)},{d(3)}", f"{d(3)} {d(3)}", f"{d(3)}-{d(4)}", f"{d(1)}.{d(1)}.{d(1)}", f"@{word(6)}"), None
        return "".join(pick(d(1), word(1), d(2), word(1).upper()) for _ in range(int(rng.integers(8, 24)))), None

    # one, or two in a row, which patterns may take for a single number
    out, spans = "", []
    for _ in range(1 + (rng.random() < 0.35)):
        out += pick(" ", " ", " ", ", ", " or ", "; ") if out else ""
        text, kind = one()
        spans += [(kind, len(out), len(out) + len(text))] if kind else []
        out += text
    return out, spans


def training_windows(texts: list[str], made: int = 4000, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Windows of character classes and their tags."""
    rng = np.random.default_rng(seed)
    xs, ys = [], []

    def add(text: str, spans: list, near: int) -> None:
        at = max(0, min(near - int(rng.integers(0, WINDOW)), len(text) - WINDOW))
        part = text[at : at + WINDOW].ljust(WINDOW)
        tags = np.zeros(WINDOW, np.int64)
        for kind, a, b in spans:
            if a >= at and b <= at + WINDOW:
                k = 1 + 2 * KINDS.index(kind)
                tags[a - at] = k
                tags[a - at + 1 : b - at] = k + 1
            elif a < at + WINDOW and b > at:
                return  # cut spans teach nothing
        xs.append(_codes(part))
        ys.append(tags)

    texts = [t for t in texts if t] or ["a plain text"]
    for text in texts:
        spans = base_spans(text)
        for _, a, b in spans[:6]:
            add(text, spans, (a + b) // 2)
        for m in list(_TRIGGER.finditer(text))[:3]:
            add(text, spans, m.start())
    for _ in range(made):
        whole, spans, near = planted(rng, texts)
        add(whole, spans, near)
    return np.array(xs), np.array(ys)


def planted(rng: np.random.Generator, texts: list[str]) -> tuple[str, list[tuple[str, int, int]], int]:
    """A piece of one of the texts with made-up spans set into it, these, and their middle."""
    text = texts[int(rng.integers(len(texts)))]
    at = text.find(" ", int(rng.integers(len(text)))) + 1
    what, spans = _made_up(rng)
    before, rest = text[max(0, at - WINDOW) : at], text[at : at + WINDOW]
    if _TRIGGER.search(before) or _TRIGGER.search(rest):
        before, rest = "", ""
    end = "" if not rest or rng.random() < 0.2 else " "
    tail = "," if rng.random() < 0.15 else ""
    moved = [(kind, a + len(before), b + len(before)) for kind, a, b in spans]
    return before + what + tail + end + rest, moved, len(before) + len(what) // 2


def train(texts: list[str], hidden: int = 24, epochs: int = 10, batch: int = 64, rate: float = 0.01, seed: int = 5) -> dict[str, np.ndarray]:
    """Fit the tagger by Adam; the parameters are a few thousand numbers."""
    x, y = training_windows(texts, seed=seed)
    rng = np.random.default_rng(seed)
    init = lambda *s: rng.normal(0, 0.2, s)
    p = {"fx": init(_N_CHARS, 4 * hidden), "fh": init(hidden, 4 * hidden), "bx": init(_N_CHARS, 4 * hidden), "bh": init(hidden, 4 * hidden), "o": init(2 * hidden, N_TAGS), "ob": np.zeros(N_TAGS), "trans": np.zeros((N_TAGS, N_TAGS))}
    for way in "fb":
        p[f"{way}x"][:, hidden : 2 * hidden] += 1  # remember at first
    m1, m2, t = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        step = rate * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            _, g = gradients(p, x[rows], y[rows])
            t += 1
            for k in p:
                m1[k] += 0.1 * (g[k] - m1[k])
                m2[k] += 0.001 * (g[k] * g[k] - m2[k])
                p[k] = p[k] - step * (m1[k] / (1 - 0.9**t)) / (np.sqrt(m2[k] / (1 - 0.999**t)) + 1e-8)
    return p


def window_starts(text: str) -> list[int]:
    """Where windows begin that hold a trigger; they overlap by WINDOW - STRIDE."""
    out: set[int] = set()
    spelt = _SPELT.finditer(text) if "at)" in text or "at]" in text else ()
    for m in (*_TRIGGER.finditer(text), *spelt):
        k = m.start() // STRIDE
        out.update(STRIDE * j for j in range(max(0, k - WINDOW // STRIDE), k + 1) if STRIDE * j + WINDOW > m.start())
    return sorted(out)


def _sound(kind: str, text: str, a: int, b: int) -> bool:
    """What a span must have beyond its tags: whole words, and its kind's arithmetic."""
    s, d = text[a:b], _digits(text[a:b])
    if (a and (text[a - 1].isalnum() or text[a - 1] in "+@.-_=/")) or (b < len(text) and (text[b].isalnum() or text[b] in "@-_=/")):
        return False
    if kind == "email":
        parts = re.split(r"\s?[(\[]at[)\]]\s?|@", s)
        return len(parts) == 2 and bool(parts[0]) and "." in parts[1].strip(".") and not re.search(r"\s", parts[0] + parts[1])
    if any(c.isalpha() for c in s):
        return False
    if kind == "ip":
        numbers = re.findall("[0-9]+", s)
        return len(numbers) == 4 and all(len(x) <= 3 and int(x) <= 255 for x in numbers)
    if kind == "card":
        return 12 <= len(d) <= 19 and luhn(d)
    return 9 <= len(d) <= 15


def _pieces(p: dict, texts: list[str]) -> list[list[tuple[str, int, int, float, bool, bool]]]:
    """What the windows of each text say: kind, start, end, trust, and whether the
    window's edges cut it on the left and on the right."""
    place = [(k, at) for k, text in enumerate(texts) for at in window_starts(text)]
    found: list[list[tuple[str, int, int, float, bool, bool]]] = [[] for _ in texts]
    trans = p["trans"] + _rules()
    for first in range(0, len(place), 512):
        part = place[first : first + 512]
        x = np.array([_codes(texts[k][at : at + WINDOW].ljust(WINDOW)) for k, at in part])
        e = _emissions(p, x)[0]
        tags, (_, marginal, _) = _viterbi(e, trans), _marginals(e, trans)
        for row, t in zip(*np.nonzero(tags % 2 == 1), strict=True):
            k, at = part[row]
            end = t + 1
            while end < WINDOW and tags[row, end] == tags[row, t] + 1:
                end += 1
            a, b = at + int(t), min(at + int(end), len(texts[k]))
            trust = float(marginal[row, np.arange(t, end), tags[row, t:end]].min())
            found[k].append((KINDS[tags[row, t] // 2], a, b, trust, t == 0 and at > 0, end == WINDOW and at + WINDOW < len(texts[k])))
    return found


def _joined(pieces: list[tuple[str, int, int, float, bool, bool]]) -> set[tuple[float, int, int, str]]:
    """Whole spans (trust, start, end, kind): those that no edge cuts, and those that
    overlapping pieces of one kind make up, where an edge cuts them."""
    whole = {(trust, a, b, kind) for kind, a, b, trust, left, right in pieces if not left and not right}
    if not any(x[4] or x[5] for x in pieces):
        return whole
    for of in KINDS:
        now: tuple[int, int, float, bool, bool] | None = None
        for _, a, b, trust, left, right in sorted(x for x in pieces if x[0] == of):
            if now and a < now[1] and (now[4] or left):
                if b > now[1] or (b == now[1] and not right):
                    now = (now[0], b, min(now[2], trust), now[3] and (left or a > now[0]), right)
                else:
                    now = (now[0], now[1], min(now[2], trust), now[3] and (left or a > now[0]), now[4])
            else:
                if now and not now[3] and not now[4]:
                    whole.add((now[2], now[0], now[1], of))
                now = (a, b, trust, left, right)
        if now and not now[3] and not now[4]:
            whole.add((now[2], now[0], now[1], of))
    return whole


def tagged_spans(p: dict, texts: list[str], sure: float = 0.5) -> list[list[tuple[str, int, int]]]:
    """The tagger's spans of each text, reconciled over all of its windows."""
    out = []
    for text, pieces in zip(texts, _pieces(p, texts), strict=True):
        kept: list[tuple[str, int, int]] = []
        spans = [s for s in _joined(pieces) if s[0] >= sure and _sound(s[3], text, s[1], s[2])]
        for _, a, b, kind in sorted(spans, key=lambda s: (-round(s[0], 6), s[1] - s[2], s[1])):
            if all(b <= x or a >= y for _, x, y in kept):
                kept.append((kind, a, b))
        out.append(kept)
    return out


def measure(p: dict, texts: list[str], made: int = 1000, seed: int = 99, sure: float = 0.5) -> dict[str, float]:
    """Of made-up spans in pieces of the texts: how many the patterns find, how many of
    those that they miss the tagger adds, and the share of its additions that are one."""
    rng = np.random.default_rng(seed)
    rows = [planted(rng, texts)[:2] for _ in range(made)]
    more = tagged_spans(p, [t for t, _ in rows], sure)
    total = found = missed = added = right = 0
    for (text, spans), own in zip(rows, more, strict=True):
        base = base_spans(text)
        new = set(all_spans(base, own)) - set(base)
        left = {s for s in spans if s not in base}
        total, found, missed, added, right = total + len(spans), found + len(spans) - len(left), missed + len(left), added + len(new), right + len(new & left)
    return {"spans": total, "by_patterns": found / max(1, total), "missed": missed, "recall_of_missed": right / max(1, missed), "precision": right / max(1, added)}


def all_spans(base: list[tuple[str, int, int]], more: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """The patterns' spans, and the tagger's where they overlap none of these."""
    added = [s for s in more if all(s[2] <= a or s[1] >= b for _, a, b in base)]
    return sorted([*base, *added], key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def fit_pii(docs: DataFrame, max_docs: int = 400, max_bytes: int = 8 << 20) -> dict[str, np.ndarray]:
    """Learn from a bounded sample: of the documents that have a trigger and the
    ``max_docs`` smallest hashes of their ids as many as ``max_bytes`` hold."""
    fit = docs.select("doc_id", "text").filter("doc_id IS NOT NULL AND text rlike '[0-9@]'")
    return train([r["text"] for r in bounded_sample(fit, max_docs, max_bytes)])


OUT = T.StructType([T.StructField("doc_id", T.LongType()), *(T.StructField(f"n_{k}", T.LongType()) for k in KINDS), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("n_added", T.LongType()), T.StructField("n_spans", T.LongType())])


def find_pii(docs: DataFrame, model: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: id, the patterns' counts and digest, all spans, how many of
    them the tagger added, and their number."""
    p = {k: v.astype(np.float64) for k, v in model.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        say = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        for batch in batches:
            texts = [x.as_py() or "" for x in batch.column(1)]
            base = [base_spans(t) for t in texts]
            every = [all_spans(b, m) for b, m in zip(base, tagged_spans(p, texts), strict=True)]
            counts = [pa.array([sum(s[0] == k for s in b) for b in base], pa.int64()) for k in KINDS]
            sha = [hashlib.sha256(say(b).encode()).hexdigest() for b in base]
            more = [len(e) - len(b) for e, b in zip(every, base, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array(sha, pa.string()), pa.array(list(map(say, every)), pa.string()), pa.array(more, pa.int64()), pa.array(list(map(len, every)), pa.int64())], names=OUT.names)

    return docs.selectExpr(f"CAST(`{id_col}` AS BIGINT) AS doc_id", f"`{text_col}` AS text").mapInArrow(run, OUT)
