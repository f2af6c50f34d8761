"""Text functions as column expressions: tokenizers, gists, terms, templates.

All of them stay in the JVM.  Functions take column names or columns and return
columns; lists of fixed words stand together below.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cues by kind, in the order in which kinds are tried.
CUES = {
    "correction": ("actually,", "actually i", "actually the", "correction:", "i was wrong", "we were wrong", "scratch that", "on second thought", "let me fix", "that was wrong", "to correct", "revert"),
    "failure": ("failed", "doesn't work", "does not work", "didn't work", "did not work", "that broke", "broke the", "dead end", "no luck", "regression", "the error was", "still failing", "not working"),
    "discovery": ("turns out", "it turns out", "found that", "i found ", "we found ", "the root cause", "root cause:", "discovered", "realized", "the bug is", "the bug was", "the issue is", "the issue was", "the problem is", "it works because", "the reason is", "the key insight"),
    "decision": ("i'll ", "we'll ", "let's ", "let us ", "i will ", "we will ", "going with", "decided to", "decision:", "the plan is", "the approach is", "we should ", "i should ", "plan:", "going to use"),
}
# Words that are no key terms.
TERM_STOPWORDS = (
    "the a an is are was were be been have has had do does did will would could should may might can shall must need "
    "this that these those from with into onto upon about between through during before after above below some any each "
    "every other such than also then more very just only still even both well here there where when what which while "
    "because since until like your their they them said says went been being back over most much many made make know"
).split()
# Words that are never learnt as entities.
LEARNER_STOPWORDS = (
    "a an the and or but in on at to for of with by from up about into over after is are was were be been being have has had "
    "do does did will would could should may might not no so if when what which who whom how where why that this it he she "
    "they we you my your his her our their me him us them all some any most other such only own same than too very just also "
    "now here there then well back even still get got like know think want see look make go come take use find give tell say "
    "said ask try need feel become leave put mean keep let begin seem help show hear play run move live believe hold bring "
    "happen write provide sit stand lose pay meet include continue set learn change lead understand watch follow stop create "
    "speak read allow add spend grow open walk win offer remember love consider appear buy wait serve die send expect build "
    "stay fall cut reach kill remain killed"
).split()
GIST_CHARS = 80
CHARS_PER_TOKEN = 3
WORD = r"[\p{L}\p{N}_]+"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _list(words) -> Column:
    return F.array(*[F.lit(w) for w in words])


def words_of(text) -> Column:
    """Runs of letters, digits and underscores, in order."""
    return F.regexp_extract_all(_c(text), F.lit(WORD), 0)


def query_words(text) -> Column:
    """Query words: split on white space, two characters or more, lower case,
    without question marks, full stops and commas at the ends."""
    parts = F.filter(F.split(F.trim(F.regexp_replace(_c(text), r"\s+", " ")), " "), lambda w: F.length(w) >= 2)
    return F.transform(parts, lambda w: F.regexp_replace(F.lower(w), r"^[?.,]+|[?.,]+$", ""))


def lexical_tokens(text) -> Column:
    """Tokens that keep identifiers whole: hexadecimal numbers, or words joined by - and dots."""
    return F.regexp_extract_all(F.lower(_c(text)), F.lit(rf"0x[0-9a-f]+|{WORD}(?:[-.]{WORD})*"), 0)


def fts_terms(text, limit: int | None = 64) -> Column:
    """The first terms of a full-text query, repeats included, all without a limit; null if
    there is none."""
    terms = words_of(text) if limit is None else F.slice(words_of(text), 1, limit)
    return F.when(F.size(terms) > 0, terms)


def fts_query(text, limit: int = 64) -> Column:
    """The terms quoted and joined by OR."""
    return F.array_join(F.transform(fts_terms(text, limit), lambda t: F.concat(F.lit('"'), t, F.lit('"'))), " OR ")


def key_terms(text, n: int = 3) -> Column:
    """The most distinctive words: four characters or more, no stopwords, first
    spelling of each, by length (+3 for a capital, +2 for a digit), then by place."""
    words = F.filter(F.regexp_extract_all(_c(text), F.lit("[A-Za-z0-9]+"), 0), lambda w: (F.length(w) >= 4) & ~F.array_contains(_list(TERM_STOPWORDS), F.lower(w)))
    lows = F.transform(words, lambda w: F.lower(w))
    first = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"), F.array_position(lows, F.lower(w)).alias("p"))), lambda x: x["p"] == x["i"] + 1)
    scored = F.transform(first, lambda x: F.struct((-(F.length(x["w"]) + F.when(x["w"].rlike("^[A-Z]"), 3).otherwise(0) + F.when(x["w"].rlike("[0-9]"), 2).otherwise(0))).alias("s"), x["i"].alias("i"), x["w"].alias("w")))
    return F.transform(F.slice(F.array_sort(scored), 1, n), lambda x: x["w"])


def _ask(head: Column, text) -> Column:
    return F.concat(head, F.lit(" "), F.array_join(key_terms(text), " "))


def chat_question(title, role, text) -> Column:
    start = F.when(_c(role) == "user", "What did I discuss about ").otherwise("What was the response about ")
    return _ask(F.concat(start, _c(title), F.lit("?")), text)


def sender_question(sender, text) -> Column:
    return _ask(F.concat(F.lit("What did "), _c(sender), F.lit(" say?")), text)


def calendar_question(summary, date) -> Column:
    return F.concat(F.lit("What was scheduled for "), _c(date), F.lit("? "), _c(summary))


def session_question(project, text) -> Column:
    return _ask(F.concat(F.lit("What happened in "), _c(project), F.lit("?")), text)


def email_question(sender, subject, body) -> Column:
    who = F.trim(F.coalesce(_c(sender), F.lit("")))
    about = F.trim(F.coalesce(_c(subject), F.lit("")))
    about = F.when(about == "", "(no subject)").otherwise(about)
    head = F.when(who != "", F.concat(F.lit("What did "), who, F.lit(" email about "), about)).otherwise(F.concat(F.lit("What was the email about "), about))
    return _ask(F.concat(head, F.lit("?")), body)


def token_estimate(text) -> Column:
    """A cautious number of tokens: a third of the characters, rounded up."""
    return F.ceil(F.length(_c(text)) / CHARS_PER_TOKEN).cast("long")


def _collapsed(text) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def gist(text) -> Column:
    """The most telling 80 characters on one line: a principle if one is stated,
    else from the first line on that is no scaffold, question or mere markup,
    else the beginning."""
    lines = F.filter(F.transform(F.split(F.coalesce(_c(text), F.lit("")), r"\r\n|[\n\r]"), _collapsed), lambda x: x != "")
    claims = F.filter(F.transform(F.filter(lines, lambda x: F.lower(x).startswith("principle:")), lambda x: F.trim(F.substring(x, 11, 2147483647))), lambda x: x != "")
    skip = lambda x: F.lower(x).rlike("^(approach:|outcome:|domain:|dead ends:|next steps:)") | F.lower(x).isin("discovery", "failed approach") | x.endswith("?") | x.rlike(r"^[\s\-*+#>|`_=~.:]+$")
    good = F.filter(F.transform(lines, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: ~skip(s["x"]))
    rest = F.array_join(F.slice(lines, F.get(good, F.lit(0))["i"] + 1, F.size(lines)), " ")
    chosen = F.when(F.size(claims) > 0, F.get(claims, F.lit(0))).when(F.size(good) > 0, rest).otherwise(F.array_join(lines, " "))
    return F.substring(chosen, 1, GIST_CHARS)


def utc_date(seconds) -> Column:
    """Unix seconds as a UTC date, or unknown."""
    return F.coalesce(F.date_format(F.timestamp_seconds(_c(seconds)), "yyyy-MM-dd"), F.lit("unknown"))


def one_line(text) -> Column:
    return F.regexp_replace(_c(text), r"\r\n|[\n\r\u000B\u000C]", " ")


def indented(text) -> Column:
    """Every line of a body set in by two blanks, so that furniture alone begins a line."""
    return F.concat(F.lit("  "), F.regexp_replace(F.regexp_replace(_c(text), r"(\r\n|[\n\r])$", ""), r"\r\n|[\n\r]", "\n  "))


def effective_time(occurred="occurred_at", created="created_at") -> Column:
    return F.coalesce(_c(occurred), _c(created))


def time_factor(age, tau_days: float = 90, floor: float = 0.5) -> Column:
    """Decay by age in seconds to a floor; the future counts as now."""
    return F.lit(floor) + F.lit(1 - floor) * F.exp(-F.greatest(F.lit(0.0), _c(age).cast("double")) / F.lit(tau_days * 86400.0))


def rounded(x, digits: int) -> Column:
    """x to so many decimals as DuckDB rounds doubles: scaled first, then halves go away from
    zero.  Spark's own round looks at the shortest decimal that names the double, so that a
    value which was rounded once before, and now ends in 5, can go the other way."""
    scale = F.lit(10.0**digits)
    return F.round(_c(x) * scale, 0) / scale


def importance_factor(importance) -> Column:
    return 1 + F.least(_c(importance), F.lit(1.0))


def classify(text) -> Column:
    """The kind of a paragraph by its cues, or null."""
    low = F.lower(_c(text))
    out = None
    for kind, cues in CUES.items():
        any_cue = None
        for cue in cues:
            any_cue = low.contains(cue) if any_cue is None else any_cue | low.contains(cue)
        out = F.when(any_cue, kind) if out is None else out.when(any_cue, kind)
    return out


def paragraphs(text) -> Column:
    return F.filter(F.transform(F.split(_c(text), "\n\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")


def learner_candidates(text, shortest: int = 3) -> Column:
    """Words and pairs of neighbouring words that may become entities."""
    words = F.transform(F.regexp_extract_all(_c(text), F.lit("[a-zA-Z]+"), 0), lambda w: F.lower(w))
    ok = lambda w: (F.length(w) >= shortest) & ~F.array_contains(_list(LEARNER_STOPWORDS), w)
    pairs = F.zip_with(words, F.slice(words, F.lit(2), F.size(words)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    good = F.filter(pairs, lambda p: p["b"].isNotNull() & ok(p["a"]) & ok(p["b"]))
    return F.array_distinct(F.concat(F.filter(words, ok), F.transform(good, lambda p: F.concat_ws(" ", p["a"], p["b"]))))


def slug(text) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(_c(text)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def first_words(text, n: int = 500) -> Column:
    """The first n words, joined by blanks."""
    return F.array_join(F.slice(F.filter(F.split(_c(text), r"\s+"), lambda w: w != ""), 1, n), " ")


def comma_list(text) -> Column:
    return F.filter(F.transform(F.split(_c(text), ","), lambda x: F.trim(x)), lambda x: x != "")


def normalized_answer(text) -> Column:
    return F.lower(F.trim(F.regexp_replace(_c(text), r"\s+", " ")))


def ics_date(raw) -> Column:
    """Calendar dates as YYYY-MM-DD, with HH:MM where there is a time."""
    raw = _c(raw)
    day = F.concat_ws("-", F.substring(raw, 1, 4), F.substring(raw, 5, 2), F.substring(raw, 7, 2))
    return F.when(raw.rlike(r"^\d{8}T\d{6}Z?$"), F.concat(day, F.lit(" "), F.substring(raw, 10, 2), F.lit(":"), F.substring(raw, 12, 2))).when(raw.rlike(r"^\d{8}$"), day).otherwise(raw)


def mended(text) -> Column:
    """Undoes UTF-8 that was read as Latin-1; what isn't such stays."""
    text = _c(text)
    narrow = ~text.rlike("[^\\x{00}-\\x{FF}]")
    again = F.when(narrow, F.encode(text, "ISO-8859-1")).cast("string")
    return F.when(narrow & F.is_valid_utf8(again), again).otherwise(text)


def is_atom_id(text) -> Column:
    return _c(text).rlike("^[0-9A-HJKMNP-TV-Z]{26}$")


def normalized_atom_id(text) -> Column:
    """The id without one leading scheme; null unless it is a valid one."""
    bare = F.regexp_replace(_c(text), "^p3://", "")
    return F.when(is_atom_id(bare), bare)


def ulid_of(ms, salt) -> Column:
    """A sortable 26-character id: 48 bits of time, 80 of a salt's digest, base 32."""
    bits = F.concat(F.lpad(F.bin(_c(ms)), 50, "0"), F.lpad(F.bin(F.conv(F.substring(F.sha2(_c(salt).cast("string"), 256), 1, 10), 16, 10).cast("long")), 40, "0"), F.lpad(F.bin(F.conv(F.substring(F.sha2(_c(salt).cast("string"), 256), 11, 10), 16, 10).cast("long")), 40, "0"))
    letters = F.lit("0123456789ABCDEFGHJKMNPQRSTVWXYZ")
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(25)), lambda k: F.substring(letters, F.conv(F.substring(bits, k * 5 + 1, F.lit(5)), 2, 10).cast("int") + 1, F.lit(1))), "")


def safe_ref(ref) -> Column:
    """Whether a reference stays within its root."""
    ref = _c(ref)
    return ~ref.startswith("/") & ~ref.startswith("~") & ~F.array_contains(F.split(ref, "/"), "..")


def span_ref(session, offset, text) -> Column:
    from memloom.functions.python_text import span_digest

    return F.concat(_c(session), F.lit("#"), _c(offset).cast("string"), F.lit("."), span_digest(_c(text)))


def composed_body(**fields) -> Column:
    """Non-blank labelled fields, one per line, in the order given; shape has no label."""
    parts = []
    for label, value in fields.items():
        v = F.trim(_c(value))
        line = v if label == "shape" else F.concat(F.lit(label.replace("_", " ") + ": "), v)
        parts.append(F.when(v != "", line))
    return F.concat_ws("\n", *parts)
