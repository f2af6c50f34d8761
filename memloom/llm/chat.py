"""Chat records of many layouts, brought to turns and formatted for training.

A record is a JSON object.  The nested paths of its fields (list items count as
``[]``) are restricted to those that any known layout mentions and hashed: this
fingerprint selects the layout, a declarative mapping from paths to turns.
Optional paths make several fingerprints for one layout; all are computed from
the declarations when they are loaded.  Records whose fingerprint is unknown are
returned with the status ``unmapped`` and no turns, those that aren't JSON
objects with ``unreadable``; neither is dropped.

The template writes each turn as ``<s>[INST]role[/INST]text</s>``.  In roles and
texts a backslash is doubled and one is put after the first character of any
control string, so control strings occur in the output only as marks, and
reading back restores everything.  The loss mask is a list of spans over the
output, in code points: the texts of assistant turns.

Defined results: null and missing texts and roles are empty; turns keep the
order of their list, and rows of a conversation the order of their turn number
(null first), then role, then text; a conversation is one record, whatever its
number of turns; a null conversation id is an id of its own; an empty table
gives an empty table.  Other columns are ignored, whatever they are called.
"""

from __future__ import annotations

import hashlib
import itertools
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Layout:
    """A declarative mapping: either a list of messages or single fields in order.

    items: (path of the list, role field, text field); roles: its own names of
    roles, all others stay as they are;
    fields: (path, role) in the order of the turns; optional ones may be absent
    or empty, and an empty optional field makes no turn.
    """

    name: str
    items: tuple[str, str, str] | None = None
    fields: tuple[tuple[str, str], ...] = ()
    optional: tuple[str, ...] = ()
    roles: tuple[tuple[str, str], ...] = ()

    def paths(self) -> tuple[str, ...]:
        if self.items:
            where, role, text = self.items
            return (where, f"{where}[].{role}", f"{where}[].{text}", *(p for p, _ in self.fields))
        return tuple(p for p, _ in self.fields)


#: Names of roles in layouts that have their own.
SPEAKERS = (("human", "user"), ("prompter", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"), ("chatgpt", "assistant"))
LAYOUTS = (
    Layout("messages", items=("messages", "role", "content"), fields=(("system", "system"),), optional=("system",)),
    Layout("conversations", items=("conversations", "from", "value"), fields=(("system", "system"),), optional=("system",), roles=SPEAKERS),
    Layout("dialog", items=("dialog", "speaker", "text"), roles=SPEAKERS),
    Layout("instruction", fields=(("system", "system"), ("instruction", "user"), ("input", "user+"), ("output", "assistant")), optional=("system", "input")),
    Layout("prompt_response", fields=(("system", "system"), ("prompt", "user"), ("response", "assistant")), optional=("system",)),
    Layout("prompt_completion", fields=(("system", "system"), ("prompt", "user"), ("completion", "assistant")), optional=("system",)),
    Layout("question_answer", fields=(("context", "user"), ("question", "user+"), ("answer", "assistant")), optional=("context",)),
    Layout("nested_prompt", fields=(("prompt.system", "system"), ("prompt.user", "user"), ("response.text", "assistant")), optional=("prompt.system",)),
)

def field_paths(value: object, prefix: str = "") -> set[str]:
    """The nested paths of a record's fields."""
    out: set[str] = set()
    if isinstance(value, dict):
        for key, inner in value.items():
            path = f"{prefix}.{key}" if prefix else str(key)
            out |= {path} | field_paths(inner, path)
    elif isinstance(value, list):
        for inner in value:
            out |= field_paths(inner, f"{prefix}[]")
    return out


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


class Registry:
    """Layouts by the fingerprints that they can have."""

    def __init__(self, layouts: tuple[Layout, ...] = LAYOUTS):
        self.known = {p for x in layouts for p in x.paths()}
        self.known |= {p.rsplit(".", n)[0] for p in self.known for n in range(1, p.count(".") + 1) if not p.rsplit(".", n)[0].endswith("[]")}
        self.by_print: dict[str, Layout] = {}
        for x in layouts:
            must = [p for p in x.paths() if p not in x.optional]
            for n in range(len(x.optional) + 1):
                for extra in itertools.combinations(x.optional, n):
                    variants = [[*must, *extra]]
                    if x.items:
                        variants.append([p for p in variants[0] if "[]" not in p])  # an empty list
                    for paths in variants:
                        own = set(paths) | {p.split(".")[0] for p in paths if "." in p and "[]" not in p}
                        self.by_print.setdefault(fingerprint(own), x)

    def layout_of(self, record: dict) -> tuple[str, Layout | None]:
        key = fingerprint(field_paths(record) & self.known)
        return key, self.by_print.get(key)


def _at(record: object, path: str) -> object:
    for key in path.split("."):
        record = record.get(key) if isinstance(record, dict) else None
    return record


def _text(value: object) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def turns_of(record: dict, layout: Layout) -> list[tuple[str, str]]:
    """The canonical turns (role, text) of a record of the layout."""
    out: list[tuple[str, str]] = []
    for path, role in layout.fields:
        text = _text(_at(record, path))
        if path in layout.optional and not text:
            continue
        if role.endswith("+") and out and out[-1][0] == role[:-1]:
            out[-1] = (role[:-1], f"{out[-1][1]}\n\n{text}")
        else:
            out.append((role.rstrip("+"), text))
    if layout.items:
        where, role, text = layout.items
        names = dict(layout.roles)
        for item in _at(record, where) or []:
            item = item if isinstance(item, dict) else {}
            name = _text(item.get(role))
            out.append((names.get(name, name), _text(item.get(text))))
    return out


TURNS = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))


def canonical_turns(records: DataFrame, id_col: str = "conv_id", record_col: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """Per record: id, fingerprint, layout (or unmapped, unreadable) and turns."""
    out = T.StructType([T.StructField(id_col, T.LongType()), T.StructField("fingerprint", T.StringType()), T.StructField("layout", T.StringType()), T.StructField("turns", TURNS)])
    arrow = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        registry = Registry(layouts)
        for batch in batches:
            prints, names, turns = [], [], []
            for x in batch.column(1):
                try:
                    record = json.loads(x.as_py() or "")
                except ValueError:
                    record = None
                key, layout, own = None, "unreadable", []
                if isinstance(record, dict):
                    key, found = registry.layout_of(record)
                    layout = found.name if found else "unmapped"
                    own = turns_of(record, found) if found else []
                prints.append(key)
                names.append(layout)
                turns.append([{"role": r, "text": t} for r, t in own])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.string()), pa.array(names, pa.string()), pa.array(turns, arrow)], names=out.names)

    return records.select(F.col(id_col).cast("long").alias(id_col), record_col).mapInArrow(run, out)


_CONTROL = r"(<|\\[)(s>|/s>|INST\\]|/INST\\]|<SYS>>|</SYS>>)"


def _escaped(column: str) -> str:
    doubled = f"replace({column}, '\\\\', '\\\\\\\\')"
    return f"regexp_replace({doubled}, '{_CONTROL}', '$1\\\\\\\\$2')"


def _unescaped(column: str) -> str:
    return f"regexp_replace({column}, '(?s)\\\\\\\\(.)', '$1')"


def format_turns(turns: DataFrame) -> DataFrame:
    """Adds the formatted text and the loss mask (spans of code points, ends exclusive)."""
    parts = F.expr(f"transform(turns, x -> struct(concat('<s>[INST]', {_escaped('x.role')}, '[/INST]') AS head, {_escaped('x.text')} AS body, x.role = 'assistant' AS learnt))")
    blocks = turns.withColumn("_parts", parts)
    spans = F.expr(
        "filter(aggregate(_parts, struct(0 AS n, CAST(array() AS array<struct<a:int,b:int,learnt:boolean>>) AS spans), "
        "(s, x) -> struct(s.n + length(x.head) + length(x.body) + 4 AS n, concat(s.spans, array(struct(s.n + length(x.head) AS a, s.n + length(x.head) + length(x.body) AS b, x.learnt AS learnt))) AS spans)).spans, x -> x.learnt)"
    )
    return blocks.select(*turns.columns, F.expr("array_join(transform(_parts, x -> concat(x.head, x.body, '</s>')), '')").alias("formatted"), F.transform(spans, lambda x: F.struct(x["a"].alias("start"), x["b"].alias("end"))).alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds what the formatted text and the mask alone give: turns_back and loss_texts."""
    find = "regexp_extract_all(formatted, '(?s)<s>\\\\[INST\\\\](.*?)\\\\[/INST\\\\](.*?)</s>', {0})"
    turns = f"zip_with({find.format(1)}, {find.format(2)}, (r, t) -> struct({_unescaped('r')} AS role, {_unescaped('t')} AS text))"
    texts = f"transform(loss_spans, x -> {_unescaped('substring(formatted, x.start + 1, x.end - x.start)')})"
    return formatted.withColumns({"turns_back": F.expr(turns), "loss_texts": F.expr(texts)})


def conversation_records(rows: DataFrame) -> DataFrame:
    """Rows by turn as records of the messages layout: conv_id, record."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))
    grouped = rows.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("t"))
    return grouped.select("conv_id", F.to_json(F.struct(F.expr("transform(t, x -> struct(x.role AS role, x.content AS content))").alias("messages"))).alias("record"))


def digests(records: DataFrame) -> DataFrame:
    """Formats records and returns, read back from the output, one row for each."""
    back = read_back(format_turns(canonical_turns(records)))
    loss = "array_join(loss_texts, '')"
    return back.select(
        "conv_id",
        F.size("turns_back").cast("long").alias("n_turns"),
        F.expr("sha2(array_join(transform(turns_back, x -> concat(x.role, '\\n', x.text, '\\n')), ''), 256)").alias("turns_sha256"),
        F.expr(f"CAST(length({loss}) AS BIGINT)").alias("loss_chars"),
        F.expr(f"sha2({loss}, 256)").alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "layout",
    )


#: The same rows for DuckDB, from the turns themselves.
ORACLE_SQL = r"""
WITH rows_in AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, 'messages' AS layout FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]', 'prompt_response'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]', 'prompt_response'
), marked AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k,
    length(regexp_replace(replace(text, '\', '\\'), '(<|\[)(s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>)', '\1#\2', 'g')) AS text_chars,
    length(regexp_replace(replace(role, '\', '\\'), '(<|\[)(s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>)', '\1#\2', 'g')) AS role_chars
  FROM rows_in
)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(role_chars + text_chars + 20) AS BIGINT) AS formatted_chars,
  min(layout) AS layout
FROM marked GROUP BY conv_id
"""
