"""Removes runs of lines that repeat earlier ones, by winnowing over line hashes.

The lines from any line on that just reach ``min_words`` words are a window.  A
window selects the leftmost of its least line hashes as a fingerprint, so two equal
runs of that many words are guaranteed to have a selected position in common.  A
selected position carries its hash and its context: the line hashes before and
after it, to the line that makes ``min_words`` words on either side.

Positions of equal hash are joined, each with all earlier ones, and every match is
extended line by line in both directions; if it has ``min_words`` words, the later
lines go.  A run that is longer than a context has further selected positions, whose
matches cover the rest of it.

A hash with more than ``FEW`` positions would make too many pairs.  Its positions'
contexts are cut into all stretches that just reach ``min_words`` words, forwards
or backwards; equal ones are aggregated, and all but the first go.  This finds the
same lines: a match of that many words is made up of such stretches, and each
belongs to the position that the window at its first line selects.

So a line goes if it is part of some block of consecutive lines, of at least
``min_words`` words together, that also begins at an earlier position, by id and
place.

Lines are what ``\n`` separates, compared with runs of white space as one blank
and none at the ends, by 96 bits of hashes for each line; lines of white space alone
aren't counted, end no run and are kept.  Everything is DataFrame operations; the
joins are sort-merge joins at every size, since none of their sides has a bound, and
adaptive execution splits those on hashes where a hash is frequent.

Defined results: a null text stays null and has no lines; an empty text stays
empty; a text of which only blank lines are left becomes empty; rows with equal
id and text are the same document and all stay or lose the same lines; a null id
comes before all others; other columns pass through, whatever they are called, and
one named ``line_dedup`` is replaced; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.llm._common import durable

MIN_WORDS = 50
#: Positions of one hash that are joined in pairs.
FEW = 8
_TIDY = "trim(BOTH ' ' FROM regexp_replace({0}, '[ \\\\t\\\\r\\\\f\\\\x0B]+', ' '))"


def _let(value: str, name: str, body: str) -> str:
    """body with name for value, which is computed once: in a lambda function the
    optimizer may put a column's expression in the place of its name."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _lines(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """(d, t, h, v, w) for each document: its key, and of its lines that aren't blank
    two hashes and the numbers of words, which min_words cuts off."""
    lines = docs.select(
        F.col(id_col).cast("long").alias("d"),
        F.xxhash64(text_col).alias("t"),
        F.expr(f"filter(transform(split(`{text_col}`, '\\n'), x -> {_TIDY.format('x')}), x -> x <> '')").alias("s"),
    )
    counted = lines.select("d", "t", "s", F.expr(f"transform(s, x -> least({min_words}, length(x) - length(replace(x, ' ', '')) + 1))").alias("w"))
    return counted.select("d", "t", F.expr("transform(s, x -> xxhash64(x))").alias("h"), F.expr("transform(s, x -> hash(x))").alias("v"), "w")


def _selected(lines: DataFrame, min_words: int) -> DataFrame:
    """(d, t, h, v, w, sums, at) with the selected positions of each document, counted
    from 1, and sums[k][i], the words of the 2 ** k lines from the i-th on."""
    levels = max(1, (min_words - 1).bit_length())
    name = lambda k: f"s{k}"
    summed = lines.withColumn(name(0), F.col("w"))
    for k in range(1, levels):
        before = name(k - 1)
        summed = summed.withColumn(name(k), F.expr(f"zip_with({before}, slice({before}, {1 + (1 << k - 1)}, size({before})), (x, y) -> x + coalesce(y, 0))"))
    summed = summed.select("d", "t", "h", "v", "w", F.array(*map(name, range(levels))).alias("sums"))
    # as many lines as stay below min_words; the next one completes the window
    below = _below("sums", "i - 1 + a.n", levels, min_words)
    choose = _let("slice(x.h, i, c + 1)", "own", "i - 1 + CAST(array_position(own, array_min(own)) AS INT)")
    chosen = _let(below, "c", f"if(i + c > size(x.h), 0, {choose})").replace("get(sums", "get(x.sums")
    every = _let("struct(h, sums)", "x", f"transform(sequence(1, size(x.h)), i -> {chosen})")
    return summed.withColumn("at", F.expr(f"array_distinct(filter({every}, p -> p > 0))"))


def _below(sums: str, at: str, levels: int, min_words: int, back: bool = False) -> str:
    """How many lines from the index ``at`` (a.n: those taken so far) on have fewer than
    min_words words together, by halving: 2 ** k lines at once, from the largest k on."""
    steps = f"sequence({levels - 1}, 0, -1)" if levels > 1 else "array(0)"
    size = "CAST(shiftleft(1, k) AS INT)"
    inside = f"{at} - {size} + 1 >= 0 AND" if back else ""
    where = f"{at} - {size} + 1" if back else at
    more = f"coalesce(get(get({sums}, k), {where}), 0)"
    return f"aggregate({steps}, struct(0 AS n, 0 AS s), (a, k) -> if({inside} a.s + {more} < {min_words}, struct(a.n + {size} AS n, a.s + {more} AS s), a), a -> a.n)"


def _positions(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """A row for each selected position: the document's key, place p and hash f, and
    outwards from it what is before (bh, bv, bw) and from it on (fh, fv, fw)."""
    found = _selected(_lines(docs, id_col, text_col, min_words), min_words)
    levels = max(1, (min_words - 1).bit_length())
    # on each side the lines below min_words, and the one that reaches it
    after = _below("x.sums", "p + a.n", levels, min_words)
    before = _below("x.sums", "p - 2 - a.n", levels, min_words, back=True)
    fields = [f"reverse(slice(x.{c}, p - nb, nb)) AS b{c}" for c in "hvw"] + [f"slice(x.{c}, p, nf + 1) AS f{c}" for c in "hvw"]
    context = _let(f"least({after} + 1, size(x.h) - p)", "nf", _let(f"least({before} + 1, p - 1)", "nb", f"struct(p, get(x.h, p - 1) AS f, {', '.join(fields)})"))
    every = _let("struct(h, v, w, sums)", "x", f"transform(at, p -> {context})")
    # an outer one, as for an inner one a filter on its array would be computed beforehand
    each = found.select("d", "t", F.explode_outer(F.expr(every)).alias("c"))
    return each.filter("c IS NOT NULL").select("d", "t", "c.*")


def _pairs(cold: DataFrame, min_words: int) -> DataFrame:
    """(d, t, a, z): lines a to z of documents that repeat earlier ones, from positions
    of hashes that have few."""
    own = F.struct(F.struct("d", "t", "p").alias("place"), "bh", "bv", "bw", "fh", "fv", "fw")
    joined = cold.groupBy("f").agg(F.collect_list(own).alias("near")).select(F.explode("near").alias("x"), "near")
    earlier = joined.select("x", F.expr("filter(near, y -> y.place < x.place)").alias("near")).filter("size(near) > 0")
    # equal lines in a row, outwards from the position
    equal = lambda c: f"array_position(zip_with(x.{c}, y.{c}, (u, w) -> u <=> w), false) - 1"
    length = lambda side: f"CAST(least(if({equal(side + 'h')} < 0, least(size(x.{side}h), size(y.{side}h)), {equal(side + 'h')}), if({equal(side + 'v')} < 0, least(size(x.{side}v), size(y.{side}v)), {equal(side + 'v')})) AS INT)"
    matches = earlier.select("x", F.expr(f"transform(near, y -> struct({length('b')} AS b, {length('f')} AS f))").alias("m"))
    words = "aggregate(concat(slice(x.bw, 1, y.b), slice(x.fw, 1, y.f)), 0, (s, n) -> s + n)"
    long = matches.select("x.place", F.expr(f"filter(m, y -> {words} >= {min_words})").alias("m")).filter("size(m) > 0")
    return long.select("place.d", "place.t", F.expr("place.p - array_max(transform(m, y -> y.b))").alias("a"), F.expr("place.p + array_max(transform(m, y -> y.f)) - 1").alias("z"))


def _stretches(hot: DataFrame, min_words: int) -> DataFrame:
    """The same from positions of hashes that have many: (d, t, a, z)."""
    running = lambda c: f"aggregate({c}, array(0), (s, n) -> concat(s, array(element_at(s, -1) + n)))"
    # starts at which the window selects this position: no hash up to it is as small
    first = "CAST(array_position(transform(bh, u -> u <= f), true) AS INT)"
    known = hot.select("d", "t", "p", "f", "bh", "bv", "bw", "fh", "fv", "fw", F.expr(running("bw")).alias("ub"), F.expr(running("fw")).alias("uf"), F.expr(f"if({first} = 0, size(bh), {first} - 1)").alias("most"))
    # a lines before the position and n from it on just reach min_words, forwards or backwards
    total = "get(x.ub, a) + get(x.uf, {0})"
    start = "if(a = 0, get(x.fw, 0), get(x.bw, a - 1))"
    least = f"filter(sequence(1, size(x.fw)), n -> get(x.ub, a) < {min_words} AND {total.format('n')} >= {min_words} AND ({total.format('n - 1')} < {min_words} OR {total.format('n')} - {start} < {min_words}))"
    # the window at this start ends with the first n; its other hashes aren't smaller
    chosen = _let(least, "ns", "if(size(ns) > 0 AND forall(slice(x.fh, 1, get(ns, 0)), u -> u >= x.f), transform(ns, n -> struct(a, n)), array())")
    blocks = _let("struct(f, bw, fw, fh, ub, uf, most)", "x", f"flatten(transform(sequence(0, x.most), a -> {chosen}))")
    each = known.select("d", "t", "p", "bh", "bv", "fh", "fv", F.explode_outer(F.expr(blocks)).alias("b")).filter("b IS NOT NULL")
    content = lambda c: F.xxhash64(F.expr(f"concat(reverse(slice(b{c}, 1, b.a)), slice(f{c}, 1, b.n))"))
    keyed = each.select("d", "t", (F.col("p") - F.col("b.a")).alias("a"), (F.col("p") + F.col("b.n") - 1).alias("z"), content("h").alias("k1"), content("v").alias("k2"))
    keyed = durable(keyed)
    begin = F.struct("d", "t", "a")
    first_ones = durable(keyed.groupBy("k1", "k2").agg(F.min(begin).alias("lo"), F.max(begin).alias("hi")).filter("NOT (lo <=> hi)").select("k1", "k2", "lo"))
    return keyed.join(first_ones.hint("merge"), ["k1", "k2"]).filter("NOT (struct(d, t, a) <=> lo)").select("d", "t", "a", "z")


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", few: int = FEW) -> DataFrame:
    """(d, t, gone): document keys and the lines that go, counted from 1 without blank ones."""
    positions = durable(_positions(docs, id_col, text_col, min_words))
    again = durable(positions.groupBy("f").agg(F.count("*").alias("n")).filter("n > 1"))
    joined = durable(positions.join(again.hint("merge"), "f"))
    later = _pairs(joined.filter(F.col("n") <= few), min_words).unionByName(_stretches(joined.filter(F.col("n") > few), min_words))
    runs = later.groupBy("d", "t").agg(F.collect_set(F.struct("a", "z")).alias("runs"))
    return runs.select("d", "t", F.expr("array_distinct(flatten(transform(runs, r -> sequence(r.a, r.z))))").alias("gone"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the later repeated runs deleted from their texts, and a column
    line_dedup: numbers of lines, of lines removed, of words, of words removed."""
    gone = durable(repeated_lines(docs, min_words, id_col, text_col))
    names = docs.drop("line_dedup").columns
    # the columns of docs are fields of one, so no name can clash
    keyed = docs.select(F.col(id_col).cast("long").alias("d1"), F.xxhash64(text_col).alias("t1"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    text = f"row.`{text_col}`"
    both = keyed.join(gone.hint("merge"), F.expr("d1 <=> d AND t1 = t"), "left").select("row", "gone", F.expr(f"split({text}, '\\n')").alias("raw"))
    full = F.expr(f"filter(transform(raw, (x, n) -> struct(n AS n, {_TIDY.format('x')} AS s)), x -> x.s <> '')")
    marked = both.withColumn("full", F.when(F.col("gone").isNotNull(), full))
    marked = marked.withColumn("out", F.expr(_let("struct(gone, full)", "x", "transform(x.gone, k -> get(x.full, k - 1))")))
    kept = _let("struct(raw, out)", "x", "transform(array_except(sequence(0, size(x.raw) - 1), transform(x.out, y -> y.n)), k -> get(x.raw, k))")
    joined = f"if(size(gone) = size(full), '', array_join({kept}, '\\n'))"
    words = "aggregate({0}, 0, (a, x) -> a + length(x) - length(replace(x, ' ', '')) + 1)"
    all_words = f"if({text} IS NULL, 0, size(filter(split({text}, '[ \\\\t\\\\r\\\\f\\\\x0B\\\\n]+'), x -> x <> '')))"
    info = F.struct(
        F.expr("if(raw IS NULL, 0, size(raw))").alias("n_lines"),
        F.expr("if(gone IS NULL, 0, size(gone))").alias("n_removed"),
        F.expr(all_words).alias("n_words"),
        F.expr("if(gone IS NULL, 0, " + words.format("transform(out, x -> x.s)") + ")").alias("n_words_removed"),
    )
    cut = F.expr(f"if(gone IS NULL, {text}, {joined})")
    return marked.select(*[cut.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in names], info.alias("line_dedup"))


#: The same rows by brute force, for DuckDB: windows of lines as texts.
ORACLE_SQL = """
WITH split_docs AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents
), lines AS (
  SELECT doc_id, n, ls[n] AS line, trim(regexp_replace(ls[n], '[ \\t\\r\\f\\v]+', ' ', 'g'), ' ') AS s
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS n FROM split_docs)
), full_lines AS (
  SELECT doc_id, n, s, length(s) - length(replace(s, ' ', '')) + 1 AS w,
         row_number() OVER (PARTITION BY doc_id ORDER BY n) AS k
  FROM lines WHERE s <> ''
), summed AS (
  SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS upto FROM full_lines
), spans AS (
  SELECT a.doc_id, a.k AS i, min(b.k) AS j FROM summed a JOIN summed b
    ON a.doc_id = b.doc_id AND b.k BETWEEN a.k AND a.k + 49 AND b.upto - a.upto + a.w >= 50 GROUP BY ALL
  UNION
  SELECT b.doc_id, max(a.k) AS i, b.k AS j FROM summed a JOIN summed b
    ON a.doc_id = b.doc_id AND a.k BETWEEN b.k - 49 AND b.k AND b.upto - a.upto + a.w >= 50 GROUP BY b.doc_id, b.k
), contents AS (
  SELECT p.doc_id, p.i, p.j, string_agg(l.s, chr(10) ORDER BY l.k) AS content
  FROM spans p JOIN full_lines l ON l.doc_id = p.doc_id AND l.k BETWEEN p.i AND p.j GROUP BY ALL
), firsts AS (
  SELECT content, min(doc_id * 1000000 + i) AS lo FROM contents GROUP BY content
), gone AS (
  SELECT DISTINCT l.doc_id, l.n, l.w FROM contents c JOIN firsts f ON c.content = f.content AND c.doc_id * 1000000 + c.i > f.lo
  JOIN full_lines l ON l.doc_id = c.doc_id AND l.k BETWEEN c.i AND c.j
), kept AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.n) AS text, count(*) FILTER (WHERE l.s <> '') AS n_full
  FROM lines l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.n = l.n WHERE g.n IS NULL GROUP BY l.doc_id
)
SELECT d.doc_id, CAST(coalesce(len(d.ls), 0) AS INTEGER) AS n_lines,
       CAST((SELECT count(*) FROM gone g WHERE g.doc_id = d.doc_id) AS INTEGER) AS n_removed,
       CASE WHEN d.text IS NULL THEN NULL
            WHEN NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = d.doc_id) THEN d.text
            WHEN coalesce(k.n_full, 0) = 0 THEN '' ELSE k.text END AS text
FROM split_docs d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""
