"""Readers of export formats: chats, messengers, mail, calendars, comments, places,
session logs and transcripts.

Every reader takes paths and returns a DataFrame of documents: doc_id, content,
value (a line for lists of results), query, source, timestamp (seconds).  Files are
read by Spark's own readers, so any store and any number of files will do.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from memloom.functions import text as tx
from memloom.functions.python_text import chunk_text, chunks
from memloom.sources.tables import counted

COLUMNS = ("doc_id", "content", "value", "query", "source", "timestamp")
# Names under which comment exports keep text and time.
TEXT_NAMES = ("comment text", "comment_text", "comment", "text", "content", "comment content", "message", "body", "snippet")
TIME_NAMES = ("comment create timestamp", "timestamp", "created_at", "created at", "published at", "published_at", "date", "time", "create time")


def _documents(df: DataFrame, source: str) -> DataFrame:
    value = F.col("value") if "value" in df.columns else F.substring("content", 1, 200)
    return df.select(F.col("doc_id").cast("string").alias("doc_id"), "content", value.alias("value"), "query", F.lit(source).alias("source"), F.col("timestamp").cast("double").alias("timestamp"))


def _chunked(df: DataFrame, when=None) -> DataFrame:
    """A row for each chunk of content; where the condition fails the whole is one."""
    parts = chunks(F.col("content")) if when is None else F.when(when, chunks(F.col("content"))).otherwise(F.array("content"))
    return df.select(*[c for c in df.columns if c != "content"], F.posexplode(parts).alias("chunk", "content"))


def _thread(mapping: dict) -> list[tuple[str, dict]]:
    """The messages from the root to the latest leaf of a conversation tree."""
    leaves = [k for k, n in mapping.items() if not n.get("children")]
    if not leaves:
        return []
    time = lambda k: ((mapping[k].get("message") or {}).get("create_time") or 0, k)
    at, out, seen = max(leaves, key=time), [], set()
    while at in mapping and at not in seen:
        seen.add(at)
        if mapping[at].get("message"):
            out.append((at, mapping[at]["message"]))
        at = mapping[at].get("parent")
    return out[::-1]


_CHAT = T.StructType([T.StructField(n, t) for n, t in (("conv", T.StringType()), ("msg", T.StringType()), ("title", T.StringType()), ("role", T.StringType()), ("timestamp", T.DoubleType()), ("chunk", T.IntegerType()), ("content", T.StringType()))])


def read_chat_export(spark: SparkSession, path: str, shortest: int = 20) -> DataFrame:
    """Trees of chat messages: of each conversation the thread to its latest leaf, texts
    of more than ``shortest`` characters, in chunks."""
    rows = spark.read.text(path, wholetext=True)
    each = rows.select(F.explode(F.from_json("value", "array<variant>")).alias("c")).select(F.to_json("c").alias("c"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.column(0):
                c = json.loads(x.as_py())
                conv = str(c.get("conversation_id") or c.get("id") or "")[:12]
                for k, m in _thread(c.get("mapping") or {}):
                    content = m.get("content") or {}
                    text = "\n".join(p for p in content.get("parts") or [] if isinstance(p, str)).strip() if content.get("content_type", "text") == "text" else ""
                    role = (m.get("author") or {}).get("role")
                    if role in ("user", "assistant") and len(text) > shortest:
                        out += [(conv, k, c.get("title") or "Untitled", role, m.get("create_time") or c.get("create_time") or 0.0, n, part) for n, part in enumerate(chunk_text(text))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(col, t) for col, t in zip(zip(*out, strict=True), (pa.string(),) * 4 + (pa.float64(), pa.int32(), pa.string()), strict=True)], names=_CHAT.names)

    m = each.mapInArrow(run, _CHAT)
    doc_id = F.concat_ws("-", F.lit("chatgpt"), "conv", "msg", F.col("chunk").cast("string"))
    return _documents(m.select(doc_id.alias("doc_id"), "content", tx.chat_question("title", "role", "content").alias("query"), "timestamp"), "chatgpt")


_MESSENGER = "title string, thread_path string, participants array<struct<name:string>>, messages array<struct<sender_name:string,timestamp_ms:bigint,content:string>>"


def read_messenger_export(spark: SparkSession, paths: str | list[str], shortest: int = 10) -> DataFrame:
    """Message threads; mojibake is mended, short messages go."""
    rows = spark.read.schema(_MESSENGER).json(paths, multiLine=True)
    m = rows.select(F.coalesce("thread_path", "title").alias("thread"), F.explode("messages").alias("m")).select("thread", tx.mended("m.sender_name").alias("sender"), "m.timestamp_ms", tx.mended("m.content").alias("content")).filter(F.length("content") >= shortest)
    m = _chunked(m)
    thread = F.substring(F.regexp_extract("thread", "([^/]*)$", 1), 1, 16)
    doc_id = F.concat_ws("-", F.lit("fb"), thread, F.col("timestamp_ms").cast("string"), F.col("chunk").cast("string"))
    return _documents(m.select(doc_id.alias("doc_id"), "content", tx.sender_question("sender", "content").alias("query"), (F.col("timestamp_ms") / 1000).alias("timestamp")), "facebook")


def read_mail(spark: SparkSession, paths: str | list[str], shortest: int = 20, whole: int = 1200) -> DataFrame:
    """Mail as JSON lines; bad lines and short bodies go, long mails are chunked."""
    m = spark.read.schema("`from` string, `to` string, subject string, `date` string, body string").json(paths).filter(F.length(F.trim("body")) >= shortest)
    m = m.fillna({"from": "", "to": "", "subject": "(no subject)", "date": ""})
    head = F.concat(F.lit("From: "), "from", F.lit("\nTo: "), "to", F.lit("\nSubject: "), "subject", F.lit("\nDate: "), "date")
    key = F.concat(F.lit("email-"), F.substring(F.sha2(F.concat_ws(":", "date", "from", "subject"), 256), 1, 16))
    full = m.select(key.alias("key"), "from", "to", "subject", "date", F.concat(head, F.lit("\n\n"), "body").alias("content"))
    parts = F.when(F.length("content") > whole, chunks(F.col("content"))).otherwise(F.array("content"))
    each = full.withColumn("parts", parts).withColumn("n", F.size("parts")).select("key", "from", "to", "subject", "date", "n", F.posexplode("parts").alias("k", "content"))
    part = lambda text: F.when(F.col("n") > 1, text).otherwise("")
    line = F.concat(F.lit("["), F.when(F.col("date") == "", "?").otherwise(F.substring("date", 1, 10)), F.lit("] "), "from", F.lit(" -> "), "to", F.lit(": "), "subject", part(F.format_string(" (part %d/%d)", F.col("k") + 1, F.col("n"))))
    return _documents(each.select(F.concat("key", part(F.concat(F.lit("-"), F.col("k").cast("string")))).alias("doc_id"), "content", line.alias("value"), tx.email_question("from", "subject", "content").alias("query"), F.unix_timestamp(F.try_to_timestamp("date")).alias("timestamp")), "email")


def read_calendar(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Calendar events that have a summary: folded lines are joined and parameters of
    names dropped."""
    rows = spark.read.text(paths, wholetext=True)
    unfolded = F.regexp_replace(F.regexp_replace("value", "\r\n?", "\n"), "\n[ \t]", "")
    event = rows.select(F.explode(F.regexp_extract_all(unfolded, F.lit(r"(?s)BEGIN:VEVENT\n(.*?)END:VEVENT"), 1)).alias("e"))
    field = lambda name: F.trim(F.regexp_extract("e", rf"(?m)^{name}(?:;[^:\n]*)?:(.*)$", 1))
    x = event.select(field("SUMMARY").alias("summary"), field("UID").alias("uid"), field("DTSTART").alias("raw"), tx.ics_date(field("DTSTART")).alias("start"), field("LOCATION").alias("place"), field("DESCRIPTION").alias("more")).filter("summary <> ''")
    x = x.withColumn("day", F.when(F.col("start") == "", "unknown date").otherwise(F.col("start")))
    plain = F.replace(F.replace("more", F.lit("\\n"), F.lit(" ")), F.lit("\\,"), F.lit(","))
    content = F.concat_ws(". ", F.concat(F.lit("Calendar event: "), "summary", F.lit(" on "), "day"), F.when(F.col("place") != "", F.concat(F.lit("Location: "), "place")), F.when(F.col("more") != "", F.concat(F.lit("Description: "), plain)))
    key = F.when(F.col("uid") != "", F.substring("uid", 1, 16)).otherwise(F.substring(F.sha2(F.concat_ws(":", "summary", "raw"), 256), 1, 16))
    return _documents(x.select(F.concat(F.lit("gcal-"), key).alias("doc_id"), content.alias("content"), F.concat("summary", F.lit(" ("), "day", F.lit(")")).alias("value"), tx.calendar_question("summary", "day").alias("query"), F.unix_timestamp(F.try_to_timestamp("start")).alias("timestamp")), "google_calendar")


def read_comments(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Comments as CSV whose columns go by one of several names; a comment's id has its
    place in its file, which Spark reads in order when rows may have line breaks."""
    rows = spark.read.csv(paths, header=True, multiLine=True, escape='"')
    by_name = {c.strip().lower(): c for c in rows.columns}
    text = next((by_name[n] for n in TEXT_NAMES if n in by_name), None)
    if text is None:
        raise ValueError(f"no text column among {rows.columns}")
    time = next((by_name[n] for n in TIME_NAMES if n in by_name), None)
    at = F.coalesce(F.col(f"`{time}`"), F.lit("")) if time else F.lit("")
    x = rows.select(F.trim(F.col(f"`{text}`")).alias("content"), at.alias("at"), F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("place"))
    x = x.withColumn("n", F.row_number().over(Window.partitionBy("file").orderBy("place")) - 1).filter("content <> ''")
    key = F.substring(F.sha2(F.concat_ws(":", "content", "at", F.col("n").cast("string")), 256), 1, 12)
    return _documents(x.select(F.concat(F.lit("ytcomment-"), key).alias("doc_id"), "content", F.concat(F.lit("What did I comment on YouTube? "), F.array_join(tx.key_terms("content"), " ")).alias("query"), F.unix_timestamp(F.try_to_timestamp("at")).alias("timestamp")), "youtube_comments")


def read_places(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Labelled places as GeoJSON; a place needs a name or an address."""
    schema = "features array<struct<properties:struct<name:string,title:string,address:string,location:string>>>"
    f = spark.read.schema(schema).json(paths, multiLine=True).select(F.posexplode("features").alias("n", "f"))
    first = lambda *names: F.trim(F.coalesce(*[F.when(F.col(f"f.properties.{c}") != "", F.col(f"f.properties.{c}")) for c in names], F.lit("")))
    x = f.select("n", first("name", "title").alias("name"), first("address", "location").alias("address")).filter("name <> '' OR address <> ''")
    x = x.withColumn("shown", F.when(F.col("name") == "", "Unnamed place").otherwise(F.col("name")))
    content = F.concat(F.lit("Saved place: "), "shown", F.when(F.col("address") != "", F.concat(F.lit(" at "), "address")).otherwise(""))
    key = F.substring(F.sha2(F.concat_ws(":", "name", "address", F.col("n").cast("string")), 256), 1, 12)
    return _documents(x.select(F.concat(F.lit("gmaps-"), key).alias("doc_id"), content.alias("content"), F.col("shown").alias("value"), F.concat(F.lit("Where is "), "shown", F.lit("?")).alias("query"), F.lit(None).alias("timestamp")), "google_maps")


def numbered_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, line, raw) of text files, lines from 0; a file is read in splits by many tasks.

    Rows of a split have consecutive numbers, so a line's place is that in its split plus
    the lines of the splits before it: of these, only counts are gathered."""
    rows = spark.read.option("lineSep", "\n").text(paths).select(F.input_file_name().alias("file"), F.input_file_block_start().alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("raw"))
    splits = rows.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", "block", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    return rows.join(splits, ["file", "block"]).select("file", (F.col("at") + F.col("shift")).cast("int").alias("line"), "raw")


def read_session_log(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Session logs as JSON lines: events by file and line; where a file has assistant
    messages as response items, their copies among event messages are left out."""
    lines = numbered_lines(spark, paths).filter(F.trim("raw") != "")
    schema = "type string, payload struct<type:string,role:string,message:string,content:array<struct<type:string,text:string>>,name:string,arguments:string>"
    x = lines.select("file", "line", F.from_json("raw", schema).alias("j")).filter("j.type IS NOT NULL").select("file", "line", F.col("j.type").alias("kind"), "j.payload.role", "j.payload.message", "j.payload.content", "j.payload.name", "j.payload.arguments", F.col("j.payload.type").alias("ptype"))
    items = (F.col("kind") == "response_item") & (F.col("ptype") == "message") & (F.col("role") == "assistant")
    copies = (F.col("kind") == "event_msg") & (F.col("ptype") == "agent_message")
    preferred = x.filter(items).select("file").distinct().withColumn("has_items", F.lit(True))
    joined = x.join(preferred, "file", "left").filter(~(copies & F.coalesce("has_items", F.lit(False))))
    text = F.coalesce(F.when(F.size("content") > 0, F.array_join(F.transform("content", lambda c: c["text"]), "\n")), F.col("message"))
    arguments = F.when(F.get_json_object("arguments", "$").startswith("{"), F.col("arguments")).when(F.col("arguments").isNotNull(), F.to_json(F.struct(F.col("arguments").alias("raw"))))
    role = F.when(copies, "assistant").otherwise(F.col("role"))
    return joined.select("file", F.col("line").alias("offset"), role.alias("role"), text.alias("text"), F.col("name").alias("tool"), arguments.alias("arguments"))


def spans(deltas: DataFrame) -> DataFrame:
    """Candidate spans of transcript rows (session_id, offset, role, text): assistant
    paragraphs that a cue gives a kind, with their references."""
    p = deltas.filter("role = 'assistant'").select("session_id", "offset", F.posexplode(tx.paragraphs("text")).alias("n", "text"))
    return p.withColumn("kind", tx.classify("text")).filter("kind IS NOT NULL").select("session_id", "offset", "n", "kind", "text", tx.span_ref("session_id", "offset", "text").alias("source_ref"))


READERS = {"chatgpt": read_chat_export, "facebook": read_messenger_export, "email": read_mail, "google_calendar": read_calendar, "youtube": read_comments, "google_maps": read_places}


def ingest(spark: SparkSession, sources: dict[str, str | list[str]], progress: Callable[[str, int], None] | None = None) -> DataFrame:
    """The documents of all sources (a reader's name: paths), written one source after
    another; progress hears when one starts, with 0, and how many documents it gave."""
    if not sources or not sources.keys() <= READERS.keys():
        raise ValueError(f"sources are some of {sorted(READERS)}, not {sorted(sources)}")
    tell = progress or (lambda name, n: None)
    out = None
    for name, paths in sources.items():
        tell(f"Starting {name}", 0)
        one = counted(READERS[name](spark, paths).select(*COLUMNS), lambda n, name=name: tell(f"Finished {name}", n))
        out = one if out is None else out.unionByName(one)
    return out
