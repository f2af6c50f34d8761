"""Entity extraction: pattern sets, the extractor, and its native fast path.

A pattern is (regular expression with one group, type, whether case is ignored).
The extractor runs literal words first, then one alternation of the patterns
that ignore case, then one of those that don't; duplicates stay, labels are in
lower case.  It is an Arrow UDF because alternatives must not overlap, which
separate native extractions can't ensure.  Patterns that match single words of
one spelling don't need it: ``native_mentions`` splits words in the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Pattern = tuple[str, str, bool]

# The patterns of the supported sets, in order of precedence.
BASE: list[Pattern] = [
    (r"\b(\d{4}-\d{2}-\d{2})\b", "date", True),
    (r"\b((?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\w*\s+\d{1,2},?\s*\d{4})\b", "date", True),
    (r'(https?://[^\s<>"{}|\\^\`\[\]]+)', "url", True),
    (r'(/(?:home|usr|var|etc|opt|tmp)/[^\s<>"]+)', "filepath", True),
    (r'(~/[^\s<>"]+)', "filepath", True),
    (r"\b(\d+(?:\.\d+)?(?:ms|MB|GB|TB|KB|%|fps|Hz|GHz|tok/s))\b", "metric", True),
    (r"\$(\d+(?:,\d{3})*(?:\.\d+)?[MBK]?)", "money", True),
    (r"\b(v?\d+\.\d+(?:\.\d+)?(?:-[a-zA-Z0-9.]+)?)\b", "version", True),
]
TECH: list[Pattern] = [
    (r"\b(rocm|pytorch|triton|faiss|cuda|hip|vulkan|opencl|tensorflow|jax|numpy|pandas|sqlalchemy|flask|fastapi|django|redis|nginx|docker|kubernetes)\b", "tech", True),
    (r"\b(flash\s+attention|spreading\s+activation|kv[\s_-]?cache|vector[\s_-]?search|knowledge\s+graph|fine[\s-]?tun(?:e|ing)|quantiz(?:e|ation)|inference|embedding|tokenizer|transformer)\b", "concept", True),
    (r"\b(llama\.?cpp|exllama(?:v2)?|vllm|ollama|lm[\s_-]?studio|stable[\s_-]?diffusion|midjourney|dall[\s-]?e|comfyui)\b", "tool", True),
    (r"\b(7900\s*xtx|mi300x|a100|h100|3090|4090|9900x|epyc|instinct)\b", "hardware", True),
    (r"\b(gpt-?(?:oss-?)?\d+(?:\.\d+)?[a-z]*(?:-(?:turbo|mini|preview|o))?)\b", "model", True),
    (r"\b(claude[\s-]?(?:opus|sonnet|haiku)?[\s-]?\d*(?:\.\d+)?)\b", "model", True),
    (r"\b(llama[\s-]?\d+(?:\.\d+)?(?:[\s-]?\d+[bB])?)\b", "model", True),
    (r"\b(qwen\d?[\s-]?\d+[bBmM]?)\b", "model", True),
    (r"\b(mistral[\s-]?\d*(?:\.\d+)?(?:[\s-]?\d+[bBmM])?)\b", "model", True),
    (r"\b(gemini[\s-]?(?:pro|ultra|nano|flash)?[\s-]?\d*(?:\.\d+)?)\b", "model", True),
    (r"\b(phi[\s-]?\d+)\b", "model", True),
    (r"\b(\d+[bBmM])\b", "model_size", True),
    (r"(\d+(?:\.\d+)?%?\s*(?:->|-->|\u2192|to)\s*\d+(?:\.\d+)?%?)", "perf_change", True),
]
GENERAL: list[Pattern] = [
    (r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?\s+(?:Office|HQ|Center|Lab|Hub|Campus|Annex|R&D))\b", "location", False),
    (r"\b([A-Z][a-z]+\s+(?:Industries|Dynamics|Consulting|Systems|Solutions|Technologies|Analytics|Ventures|Partners|Group|Corp|Labs|Inc))\b", "organization", False),
    (r"Project\s+([A-Z][a-z]{2,})", "project", False),
    (
        r"\b(?!(?:Project|The|New|Old|North|South|East|West|Upper|Lower|Greater|Central|Advanced|Global|Total|Chief|Senior|Junior|General)\s)([A-Z][a-z]{2,}\s+(?:O\')?(?!(?:Office|Center|Lab|Hub|Campus|Annex|Industries|Dynamics|Consulting|Systems|Solutions|Technologies|Analytics|Ventures|Partners|Group|Corp|Labs|Inc|Engineering|Operations|Services|Resources|Security|Marketing|Finance|Sales|Legal|Team|Initiative|Project)\b)[A-Z][a-z]{2,})\b",
        "person",
        False,
    ),
    (r"\(([A-Z][A-Za-z\s]+?(?:Engineering|Operations|Analytics|Services|Resources|Security|Marketing|Finance|Sales|Legal|QA|DevOps|SRE))\)", "department", False),
]
INFRA: list[Pattern] = [
    (r"\b([A-Z]-\d{2,4})\b", "room", False),
    (r"\b(prod-[a-z0-9-]+|gateway-[a-z0-9-]+|staging-[a-z0-9-]+)\b", "server", True),
    (r"\b(eu-[a-z]+-\d+|us-[a-z]+-\d+|ap-[a-z]+-\d+)\b", "datacenter", True),
    (r"\b([A-Z]{2,}[A-Z0-9]{3,})\b", "code", False),
    (r"badge\s+(?:number\s+)?(\d{4,6})", "badge", True),
    (r"Employee\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)", "person", False),
    (r"Dr\.\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)", "person", False),
    (r"Project\s+([A-Z][a-z]+)", "project", False),
    (r"the\s+([A-Z][a-z]+)\s+initiative", "initiative", True),
    (r"the\s+([A-Z][a-z]+)\s+team", "team", True),
    (r"\b([A-Z][a-z]+(?:Tech|Sys|Corp|Labs|AI))\b", "company", False),
    (r"\b([A-Z]{2,}[a-z]+)\b", "company", False),
    (r"\b([A-Z][a-z]+[A-Z][a-z]*)\b", "company", False),
    (r"\b([A-Z][a-z]{3,})\b", "proper", False),
]


def pattern_set(*lists: Sequence[Pattern]) -> list[Pattern]:
    """The lists in order; of patterns with the same expression the first stays."""
    out: dict[str, Pattern] = {}
    for own in lists:
        for p in own:
            out.setdefault(p[0], p)
    return list(out.values())


def named_projects(*names: str) -> list[Pattern]:
    """A pattern for projects that are known by name; to be put before the technical ones."""
    return [(rf"\b({'|'.join(names)})\b", "project", True)] if names else []


REAL, SYNTHETIC, ALL = pattern_set(BASE, TECH, GENERAL), pattern_set(BASE, INFRA), pattern_set(BASE, TECH, GENERAL, INFRA)
MENTIONS = "array<struct<label:string,etype:string,raw:string,start:int,end:int>>"


class Extractor:
    """Compiles a pattern set; one instance per worker process."""

    def __init__(self, patterns: Sequence[Pattern] = tuple(SYNTHETIC)):
        for k, (expr, _, _) in enumerate(patterns):
            try:
                compiled = re.compile(expr)
            except re.error as e:
                raise ValueError(f"pattern {k} ({expr!r}) is not a valid expression: {e}") from e
            if compiled.groups != 1 or compiled.groupindex:
                raise ValueError(f"pattern {k} ({expr!r}) needs exactly one group, without a name")
        self.literals: list[dict[str, str]] = [{}, {}]  # spelt as they are; in lower case
        rest: list[list[tuple[str, str]]] = [[], []]
        for expr, kind, loose in patterns:
            words = re.fullmatch(r"\\b\(([^()]*)\)\\b", expr)
            alternatives = words[1].split("|") if words else [""]
            plain = [a for a in alternatives if words and re.fullmatch("[a-zA-Z0-9]+", a)]
            for a in plain:
                self.literals[loose][a.lower() if loose else a] = kind
            if not plain:
                rest[loose].append((expr, kind))
            elif other := [a for a in alternatives if a not in plain]:
                rest[loose].append((rf"\b({'|'.join(other)})\b", kind))
        self.kinds = [[k for _, k in own] for own in rest]
        self.mega = [re.compile("|".join(e for e, _ in own), re.I if loose else 0) if own else None for loose, own in enumerate(rest)]

    def spans(self, text: str | None) -> list[tuple[str, str, str, int, int]]:
        """(label, type, raw, start, end): literals, then the loose patterns, then the strict ones."""
        out = []
        if not text:
            return out
        if any(self.literals):
            for m in re.finditer("[a-zA-Z0-9]+", text):
                kind = self.literals[1].get(m.group().lower()) or self.literals[0].get(m.group())
                edge = lambda k: 0 <= k < len(text) and (text[k].isalnum() or text[k] == "_")
                if kind and not edge(m.start() - 1) and not edge(m.end()):
                    out.append((m.group().lower(), kind, m.group(), m.start(), m.end()))
        for loose in (1, 0):
            if self.mega[loose]:
                for m in self.mega[loose].finditer(text):
                    raw = m.group(m.lastindex)
                    out.append((raw.lower(), self.kinds[loose][m.lastindex - 1], raw, m.start(m.lastindex), m.end(m.lastindex)))
        return out


def extract_entities(text: Column, patterns: Sequence[Pattern] = tuple(SYNTHETIC), in_order: bool = False) -> Column:
    """Mentions of a text column; in_order sorts them by place."""
    chosen = tuple(patterns)
    made: dict = {}

    @F.pandas_udf(MENTIONS)
    def run(texts: pd.Series) -> pd.Series:
        if "x" not in made:
            made["x"] = Extractor(chosen)
        found = texts.map(made["x"].spans)
        if in_order:
            found = found.map(lambda own: sorted(own, key=lambda m: (m[3], m[4])))
        return found.map(lambda own: [dict(zip(("label", "etype", "raw", "start", "end"), m, strict=True)) for m in own])

    return run(text)


# Single-word types, in the order in which they are tried.
_WORD_TYPES = (("[A-Z]{2,}[A-Z0-9]{3,}", "code"), ("[A-Z][a-z]+(Tech|Sys|Corp|Labs|AI)", "company"), ("[A-Z]{2,}[a-z]+", "company"), ("[A-Z][a-z]+[A-Z][a-z]*", "company"), ("[A-Z][a-z]{3,}", "proper"))


def native_mentions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, label, etype) of single-word entities, a row for each mention, in the JVM."""
    word, types = r"[\p{L}\p{N}_]", "|".join(e for e, _ in _WORD_TYPES)  # all types begin with a capital
    text = F.col(text_col)
    # looking behind takes what follows a letter beyond the basic plane for a word of its own
    split = F.filter(F.regexp_extract_all(text, F.lit(f"{word}+"), 0), lambda w: w.rlike(f"^({types})$"))
    words = F.when(text.rlike(r"[\x{10000}-\x{10FFFF}]"), split).otherwise(F.regexp_extract_all(text, F.lit(f"(?=[A-Z])(?<!{word})(?:{types})(?!{word})"), 0))
    kind = None
    for expr, name in _WORD_TYPES:
        test = F.col("w").rlike(f"^({expr})$")
        kind = F.when(test, name) if kind is None else kind.when(test, name)
    return docs.select(F.col(id_col).alias("doc_id"), F.explode(words).alias("w")).select("doc_id", F.lower("w").alias("label"), kind.alias("etype"))


#: The same mentions in DuckDB.
MENTIONS_SQL = r"""
SELECT doc_id, lower(w) AS label, CASE
  WHEN regexp_full_match(w, '[A-Z]{2,}[A-Z0-9]{3,}') THEN 'code'
  WHEN regexp_full_match(w, '[A-Z][a-z]+(Tech|Sys|Corp|Labs|AI)') THEN 'company'
  WHEN regexp_full_match(w, '[A-Z]{2,}[a-z]+') THEN 'company'
  WHEN regexp_full_match(w, '[A-Z][a-z]+[A-Z][a-z]*') THEN 'company'
  ELSE 'proper' END AS etype
FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS w FROM documents)
WHERE regexp_full_match(w, '[A-Z]{2,}[A-Z0-9]{3,}|[A-Z][a-z]+(Tech|Sys|Corp|Labs|AI)|[A-Z]{2,}[a-z]+|[A-Z][a-z]+[A-Z][a-z]*|[A-Z][a-z]{3,}')
"""
