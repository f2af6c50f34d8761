"""Exact token counts of every prefix of a text, for byte-level BPE vocabularies.

A byte-pair encoding has a property that makes counting a dynamic program: if a
sequence of tokens is the encoding of a string, then dropping the last token
leaves the encoding of the shorter string, and a sequence is an encoding as
soon as each pair of neighbours is the encoding of the two tokens' own bytes.
For each prefix of a word there is therefore exactly one last token that fits
the last token of the prefix before it.  The program stores, for each prefix,
that last token and the number of tokens; the final entry is the count of the
whole word and the others answer questions about truncation and budgets
without encoding anything again.

Defined results: a null text is an empty one (0 tokens); special strings in a
text count as one token each, as the vocabulary's library has it by default;
rows, ties and repeated rows are independent of each other; other columns are
ignored, whatever they are called; an empty table gives an empty table.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from memloom.llm._common import Memo, once_per_process

# Characters for which the standard library's classes and Unicode's letter and
# number properties agree; texts of other characters take the slower pattern.
_PLAIN = re.compile("[\x00-\x1b\x20-±´-¸º»¿-ɏ‐-‧‰-⁞₠-₿]*")
_FAST = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_SPACE = r"\t-\r \x85\xa0  -     　"
_BLANK = re.compile(rf"[{_SPACE}]+")
_FULL = regex.compile(rf"'(?:[stmd]|re|ve|ll)| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")


def split_words(text: str) -> list[str]:
    """The pieces that byte-level BPE encodes on their own."""
    return (_FAST if _PLAIN.fullmatch(text) else _FULL).findall(text)


def _byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class PrefixCounter:
    """The dynamic program for one vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kind = (spec.get("pre_tokenizer") or {}).get("type")
        if spec["model"]["type"] != "BPE" or kind != "ByteLevel" or spec.get("normalizer"):
            raise ValueError("a byte-level BPE vocabulary without normalizer is needed")
        if spec["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("vocabularies that add a space before texts aren't supported")
        letters = _byte_letters()
        vocab = spec["model"]["vocab"]
        special = {x["content"] for x in spec.get("added_tokens", [])}
        spell = {name: bytes(letters[c] for c in name) for name in vocab if name not in special}
        ids = {b: vocab[name] for name, b in spell.items()}
        self.bytes_of = {i: b for b, i in ids.items()}
        self.single = [ids.get(bytes([b])) for b in range(256)]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b = spell[left], spell[right]
            self.merges.setdefault((ids[a], ids[b]), (rank, ids[a + b]))
        formed: dict[int, list[tuple[int, int, int]]] = {}
        for (a, b), (rank, made) in self.merges.items():
            formed.setdefault(made, []).append((rank, a, b))
        self.tree = {made: min(ways) for made, ways in formed.items()}
        rank_of = lambda t: self.tree[t][0] if t in self.tree else -1
        #: In a trained vocabulary a token is made by one rule, after its parts.
        self.regular = all(len(w) == 1 for w in formed.values()) and all(r > max(rank_of(a), rank_of(b)) for r, a, b in self.tree.values())
        self.edges: tuple[dict, dict] = ({}, {})
        # only tokens that encode to themselves can end a prefix
        self.ids = {b: i for b, i in ids.items() if self.encode_word(b) == [i]}
        #: Tokens, and with -1 what only begins tokens.
        self.starts = {b[:k]: -1 for b in self.ids for k in range(1, len(b))} | self.ids
        if not all(bytes([b]) in self.ids for b in range(256)):
            raise ValueError("the vocabulary lacks single bytes")
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.fits: Memo = Memo(self._fit, 1_000_000)
        self.count: Memo = Memo(lambda w: self.prefixes(w.encode("utf-8", "surrogatepass"))[-1])

    def encode_word(self, word: bytes) -> list[int]:
        """The merges as such: used for single tokens and pairs of tokens."""
        ids = [self.single[b] for b in word]
        while len(ids) > 1:
            best = min((self.merges.get(p, (1 << 60, 0))[0], k) for k, p in enumerate(zip(ids, ids[1:], strict=False)))
            if best[0] == 1 << 60:
                break
            k = best[1]
            ids[k : k + 2] = [self.merges[ids[k], ids[k + 1]][1]]
        return ids

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """What stands at one end of a token while it is being built: parts and
        the rank at which each disappears into a larger one."""
        if token not in self.edges[side]:
            out, ends, part = [], 1 << 60, token
            while True:
                out.append((part, ends))
                if part not in self.tree:
                    break
                ends = self.tree[part][0]
                part = self.tree[part][2 - side]
            self.edges[side][token] = out
        return self.edges[side][token]

    def _fit(self, pair: tuple[int, int]) -> bool:
        """Whether two tokens side by side are the encoding of their bytes: no
        rule joins what stands at the border while both sides still stand.  Of
        equal rules the left one goes first."""
        if not self.regular:
            return self.encode_word(self.bytes_of[pair[0]] + self.bytes_of[pair[1]]) == [*pair]
        right_edges, merges = self._edge(pair[1], 1), self.merges
        for a, a_ends in self._edge(pair[0], 0):
            for b, b_ends in right_edges:
                rule = merges.get((a, b))
                if rule and rule[0] < a_ends and rule[0] <= b_ends:
                    return False
        return True

    def prefixes(self, word: bytes) -> list[int]:
        """Token counts of word[:0], word[:1], ... as the encoder would give them."""
        starts, fits, n = self.starts, self.fits, len(word)
        last, count = [None] * (n + 1), [0] * (n + 1)
        for start in range(n):
            held = last[start]
            for end in range(start + 1, n + 1):
                token = starts.get(word[start:end])
                if token is None:
                    break  # no token begins like this
                if token >= 0 and last[end] is None and (not start or fits[held, token]):
                    last[end] = token
                    count[end] = count[start] + 1
        return count

    def parts(self, text: str) -> list[tuple[str, bool]]:
        """Stretches of plain text and special strings, in order."""
        if not self.special or not self.special.search(text):
            return [(text, False)]
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [(text[at : m.start()], False), (m.group(), True)]
            at = m.end()
        return [x for x in [*out, (text[at:], False)] if x[0]]

    def total(self, text: str) -> int:
        """The token count of a whole text: the last entry of its prefix table."""
        return sum(1 if whole else sum(map(self.count.__getitem__, split_words(part))) for part, whole in self.parts(text))

    def table(self, text: str) -> np.ndarray:
        """Exact token counts of text[:k] for every k.

        A cut inside a word leaves the words before it alone, and the rest of
        that word is a word; but a cut inside white space joins the last blank
        with those before it, and a cut inside a contraction or a special
        string undoes it.
        """
        out, base, plain = [0], 0, (0, "")  # plain: the count before the stretch that a special string follows, and the stretch
        for part, whole in self.parts(text):
            if whole:
                out += [plain[0] + self.total(plain[1] + part[:k]) for k in range(1, len(part))]
                base += 1
                out.append(base)
                plain = (base, "")
                continue
            plain = (base, part)
            words = split_words(part)
            for k, word in enumerate(words):
                run = ""  # white space before this word, which belongs to the same run
                if k and _BLANK.fullmatch(words[k - 1]) and _BLANK.match(word):
                    run = words[k - 1]
                if word[0] == "'" and len(word) > 1 and word[1].isalpha():
                    counts = [sum(map(self.count.__getitem__, split_words(word[:n]))) for n in range(1, len(word) + 1)]
                else:
                    raw = self.prefixes(word.encode("utf-8", "surrogatepass"))
                    ends = np.cumsum([len(c.encode("utf-8", "surrogatepass")) for c in word])
                    counts = [raw[e] for e in ends]
                if run:
                    joined = base - self.count[run]
                    out.append(joined + self.count[run + word[0]])
                    if _BLANK.fullmatch(word):
                        out += [joined + self.count[run + word[:n]] for n in range(2, len(word) + 1)]
                    else:
                        out += [base + n for n in counts[1:]]
                else:
                    out += [base + n for n in counts]
                base += counts[-1]
        return np.array(out, dtype=np.int64)

    def fit(self, text: str, budget: int) -> int:
        """The length of the longest prefix of at most budget tokens."""
        return int(np.flatnonzero(self.table(text) <= budget)[-1])


OUT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: id, UTF-8 length, exact token count, whether it is over limit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = once_per_process(("prefix-counter", vocabulary), lambda: PrefixCounter(vocabulary))
        for batch in batches:
            sizes, counts = [], []
            for x in batch.column(1):
                text = x.as_py() or ""
                sizes.append(len(text) if text.isascii() else len(text.encode("utf-8", "surrogatepass")))
                counts.append(counter.total(text))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())], names=OUT.names)

    return docs.selectExpr(f"CAST(`{id_col}` AS BIGINT) AS doc_id", f"`{text_col}` AS text").mapInArrow(run, OUT)
