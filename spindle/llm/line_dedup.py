"""Line dedup by winnowing over line hashes, in DataFrame operations only.

A window is the shortest stretch of consecutive lines with a word, from a given one on, that holds `run_chars` characters;
a text that holds fewer is one window. So a line of that length is a window of its own, and shorter lines only count together:
`run_chars` is the length from which a repeated run of lines is no accident (40 characters are some seven words; "Yes." or "* * *"
recur in unrelated texts).

Every window selects its smallest line hash, the rightmost on ties, as its fingerprint; equal windows select the same line at the
same place, so every repeated window shares a fingerprint. Consecutive windows mostly select the same line: only selected places
go on, a row for each, with the lines that their windows reach to both sides. Then:

1. join: the earliest place of each fingerprint that is found at two places or more is joined to the others.
2. extend: from the fingerprint both ways, line by line, as far as the two texts agree; the windows inside the agreement are repeated.
3. rest: windows that the earliest place does not share, as its surroundings differ there, are compared among themselves: the
   earliest place of each is joined to the others.

All lines of a later repeated window are deleted. Lines are compared as text, or by SHA-256 where they are longer than such a digest. Matches
are never paired within a group: the earliest place is a minimum, combined before the shuffle, and joined back by unique keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CLASS, settled, table, unused, written

#: Characters in a window, at least.
RUN_CHARS = 40
_DIGEST = 32


def _at(array: str, i: Column) -> Column:
    return F.get(F.col(array), i)


def line_hash(line: Column) -> Column:
    """What windows select by: any function of the line does."""
    return F.xxhash64(line)


def _token(line: Column) -> Column:
    """Binary that is equal for equal lines only: the line, or its SHA-256 if that is shorter."""
    raw = line.cast("binary")
    return F.when(F.octet_length(line) < _DIGEST, raw).otherwise(F.unhex(F.sha2(raw, 256)))


def places(docs: DataFrame, run_chars: int = RUN_CHARS) -> DataFrame:
    """(doc_id, row, at, fp, left, right, windows, lines): a row for each selected place of `docs` (doc_id, text).

    row tells apart repeated ids with other texts; at is the place among lines with a word; left are the lines before it, the next one first,
    right it and those after it, both as far as its windows reach; windows are (before, after), the lines of each on either side; lines are
    the positions, among all lines of the text, of the stretch, which begins size(left) lines before the place.
    """
    worded = F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("at"), x.alias("line"))), lambda s: s.line.rlike(SPACE_CLASS.replace("[", "[^")))
    src = docs.where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("row"), worded.alias("w"))
    z = src.select("doc_id", "row", F.transform("w", lambda s: F.struct(s.at.alias("at"), line_hash(s.line).alias("h"), F.length(s.line).alias("n"), _token(s.line).alias("t"))).alias("z"))
    # From each line on: characters so far, the smallest hash and its place, the last line. A line has a character, so a window at most run_chars lines.
    began = F.struct(F.lit(0).alias("n"), F.lit(None).cast("long").alias("h"), F.lit(0).alias("fp"), F.lit(-1).alias("end"))

    def grown(a: Column, x: Column) -> Column:
        less = a.h.isNull() | (x.h <= a.h)
        more = F.struct((a.n + x.n).alias("n"), F.when(less, x.h).otherwise(a.h).alias("h"), F.when(less, a.end + 1).otherwise(a.fp).alias("fp"), (a.end + 1).alias("end"))
        return F.when(a.n >= run_chars, a).otherwise(more)

    each = F.transform("z", lambda x, i: F.aggregate(F.slice("z", i + 1, F.lit(run_chars)), began, grown, lambda a: F.struct(a.n.alias("n"), i.alias("start"), (a.fp + i).alias("fp"), (a.end + i).alias("end"))))
    z = z.withColumn("v", F.filter(each, lambda s: (s.n >= run_chars) | (s.start == 0)))
    # Starts are ascending, and so are the places they select: a place's windows are next to each other.
    firsts = F.filter(F.sequence(F.lit(0), F.size("v") - 1), lambda i: (i == 0) | (_at("v", i).fp != _at("v", i - 1).fp))
    z = z.withColumn("b", F.when(F.size("v") > 0, firsts))
    # Of an inner explode the planner would infer a filter that computes the arrays again, within lambdas for each line.
    own = z.select("doc_id", "row", "z", "v", F.posexplode_outer("b").alias("j", "from"), F.col("b")).where("from is not null")
    own = own.withColumn("windows", F.slice("v", F.col("from") + 1, F.coalesce(_at("b", F.col("j") + 1), F.size("v")) - F.col("from")))
    own = own.withColumn("at", F.element_at("windows", 1).fp).withColumn("lo", F.element_at("windows", 1).start).withColumn("hi", F.element_at("windows", -1).end)
    stretch = F.slice("z", F.col("lo") + 1, F.col("hi") - F.col("lo") + 1)
    own = own.withColumn("short", F.element_at("windows", 1).n < run_chars).withColumn("h", _at("z", F.col("at")).h).withColumn("z", stretch)
    mid = F.col("at") - F.col("lo")
    tokens = F.transform("z", lambda s: s.t)
    return own.select(
        "doc_id", "row", "at", F.when(F.col("short"), F.xxhash64("h", F.lit("short"), F.size("z"))).otherwise(F.col("h")).alias("fp"),
        F.reverse(F.slice(tokens, 1, mid)).alias("left"), F.slice(tokens, mid + 1, F.size("z")).alias("right"),
        F.transform("windows", lambda s: F.struct((F.col("at") - s.start).alias("before"), (s.end - F.col("at")).alias("after"))).alias("windows"),
        F.transform("z", lambda s: s.at).alias("lines"),
    )


def _agreeing(x: str, y: str) -> Column:
    """How many of the first elements of two arrays are equal."""
    same = F.zip_with(x, y, lambda a, b: F.coalesce(a == b, F.lit(False)))
    return F.when(F.forall(same, lambda s: s), F.size(same)).otherwise(F.array_position(same, False) - 1).cast("int")


def _lines_of(windows: Column) -> Column:
    """The lines of the stretch that windows of one place cover: they all hold the place, so they are next to each other."""
    before, after = F.array_max(F.transform(windows, lambda s: s.before)), F.array_max(F.transform(windows, lambda s: s.after))
    return F.slice("lines", F.size("left") - before + 1, before + after + 1)


def repeated_lines(docs: DataFrame, run_chars: int = RUN_CHARS) -> DataFrame:
    """(doc_id, row, lines): positions of lines to delete from `docs` (doc_id, text); a row of a document may have several such rows."""
    selected = written(places(docs, run_chars), "places")
    place = F.struct("doc_id", "at")
    first = selected.groupBy("fp").agg(F.min(F.struct("doc_id", "at", "row", "left", "right")).alias("q"), F.max(F.struct("doc_id", "at", "row")).alias("last"))
    first = written(first.where((F.col("q.doc_id") != F.col("last.doc_id")) | (F.col("q.at") != F.col("last.at"))).select("fp", F.col("q.doc_id").alias("q_doc"), F.col("q.at").alias("q_at"), F.col("q.left").alias("q_left"), F.col("q.right").alias("q_right")), "first-places")
    later = selected.join(first, "fp").where(place > F.struct("q_doc", "q_at"))
    later = later.withColumn("to_left", _agreeing("left", "q_left")).withColumn("to_right", _agreeing("right", "q_right"))
    inside = lambda s: (s.before <= F.col("to_left")) & (s.after < F.col("to_right"))
    met = written(later.select("doc_id", "row", "at", "fp", "left", "right", "lines", F.filter("windows", inside).alias("same"), F.filter("windows", lambda s: ~inside(s)).alias("other")), "extended")
    gone = met.where(F.size("same") > 0).select("doc_id", "row", _lines_of(F.col("same")).alias("lines"))
    rest = met.where(F.size("other") > 0).select("doc_id", "row", "at", "left", "right", "lines", F.explode("other").alias("s"))
    content = F.concat(F.reverse(F.slice("left", F.lit(1), F.col("s.before"))), F.slice("right", F.lit(1), F.col("s.after") + 1))
    rest = rest.select("doc_id", "row", "at", content.alias("content"), F.slice("lines", F.size("left") - F.col("s.before") + 1, F.col("s.before") + F.col("s.after") + 1).alias("lines"))
    least = rest.groupBy("content").agg(F.min(place).alias("x"), F.max(place).alias("y")).where("x <> y").select("content", "x")
    again = rest.join(written(least, "first-windows"), "content").where(place > F.col("x"))
    return gone.union(again.select("doc_id", "row", "lines"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run_chars: int = RUN_CHARS) -> DataFrame:
    """All columns of `docs`, the text without lines of later repeated windows, and n_lines and n_removed.

    A window is repeated if the same lines, lines without a word not counted, are a window at a smaller (doc_id, place among the lines with
    a word). Removal is judged on the input. Null texts stay null, with 0 lines; an empty text is one line; rows of a null id are
    kept as they are and remove nothing; equal rows are one place; rows of one id with other texts remove each other's
    lines as lines of one text would. An empty table gives an empty one. Extra columns pass through, also ones named as the columns that are made inside.
    """
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    gone = settled(lambda: repeated_lines(src, run_chars).select("doc_id", "row", F.explode("lines").alias("line")).groupBy("doc_id", "row").agg(F.collect_set("line").alias("gone")), "lines-to-delete")
    own_id, own_row, own_gone = (unused(docs, c) for c in ("__id", "__row", "__gone"))
    gone = gone.select(F.col("doc_id").alias(own_id), F.col("row").alias(own_row), F.col("gone").alias(own_gone))
    text = F.col(text_col).cast("string")
    met = docs.join(gone, (F.col(id_col) == F.col(own_id)) & (F.xxhash64(text) == F.col(own_row)), "left")
    lines = F.split(text, "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), own_gone)
    cleaned = F.when(F.col(own_gone).isNull(), text).otherwise(F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n"))
    counts = {"n_lines": F.when(text.isNull(), 0).otherwise(F.size(lines)).cast("long"), "n_removed": F.coalesce(F.size(own_gone), F.lit(0)).cast("long")}
    own = [F.col(c) for c in docs.columns if c not in (text_col, *counts)]
    return met.select(*own, cleaned.alias(text_col), *[v.alias(k) for k, v in counts.items()])


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


QUERIES = {"op5_line_dedup": op5_line_dedup}
SQL = {
    "op5_line_dedup": f"""
with lines as (
  select doc_id, unnest(range(len(l))) as pos, unnest(l) as line
  from (select doc_id, string_split(text, chr(10)) as l from documents where text is not null)),
worded as (
  select doc_id, pos, line, row_number() over d as k, sum(length(line)) over d as upto, sum(length(line)) over (partition by doc_id) as total
  from lines where regexp_matches(line, '[^\\x20\\x09-\\x0D]') window d as (partition by doc_id order by pos)),
spans as (
  select a.doc_id, a.k, b.k as last
  from worded a asof join worded b on a.doc_id = b.doc_id and a.upto - length(a.line) + {RUN_CHARS} <= b.upto
  union all select doc_id, 1, max(k) from worded where total < {RUN_CHARS} group by doc_id),
windows as (
  select s.doc_id, s.k, s.last, string_agg(w.line, chr(10) order by w.k) as content
  from spans s join worded w on s.doc_id = w.doc_id and w.k between s.k and s.last group by s.doc_id, s.k, s.last),
later as (
  select doc_id, k, last from (select *, row_number() over (partition by content order by doc_id, k) as n from windows) where n > 1),
gone as (select distinct w.doc_id, w.pos from later s join worded w on s.doc_id = w.doc_id and w.k between s.k and s.last),
kept as (
  select l.doc_id, count(*) as n_lines, count(g.pos) as n_removed,
         coalesce(string_agg(case when g.pos is null then l.line end, chr(10) order by l.pos), '') as kept_text
  from lines l left join gone g on l.doc_id = g.doc_id and l.pos = g.pos group by l.doc_id)
select d.doc_id, coalesce(k.n_lines, 0) as n_lines, coalesce(k.n_removed, 0) as n_removed, sha256(coalesce(k.kept_text, '')) as kept_sha256
from documents d left join kept k on d.doc_id = k.doc_id"""
}
