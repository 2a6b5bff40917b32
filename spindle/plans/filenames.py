"""The grammar of image names: date, series, resolution, markers. Images are never opened; the name is all there is.

All of it is one column expression, in which each step's state is bound once, so that its size grows with the steps only. A rule reads its first match in what is left of the name and leaves blanks of the match's length there,
so that no later rule reads the same characters; the rules of dates are tried together and the first that gives a day wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import stem

# The grammar's patterns and word lists.
_END = r"(?=$|[_\-. ])"
ISO_DT = r"(?<!\d)(\d{4})-(\d{2})-(\d{2})[ _](\d{2})-(\d{2})-(\d{2})(?!\d)"
ISO = r"(?<!\d)(\d{4})-(\d{2})-(\d{2})(?!\d)"
DDMMYYYY = r"(?<!\d)(\d{2})(\d{2})(\d{4})(?!\d)"
SIX = r"(?<!\d)(\d{2})(\d{2})(\d{2})(?!\d)"
YEAR = r"(?<!\d)((?:19|20)\d{2})(?!\d)"
MALFORMED = r"(?<!\d)\d{9,}(?!\d)"
RESOLUTION = r"(?<!\d)(\d{3,5})[xX](\d{3,5})(?!\d)"
DPI = r"(?i)(?<!\d)(\d{2,4})\s*dpi"
INDEX, NR = r"[_\-#](\d{1,4})" + _END, r"_?nr(\d{1,3})" + _END
ROMAN_VALUES = {"I": 1, "II": 2, "III": 3, "IV": 4, "V": 5, "VI": 6, "VII": 7, "VIII": 8, "IX": 9, "X": 10}
COPY = ("_copy", "-copy", "_kopi", " copy", "_copy2")
VARIANTS = ("small", "ny", "hdpi", "ldpi", "thumb", "web", "print", "final")
MONTHS = {
    "januar": 1, "februar": 2, "mars": 3, "april": 4, "mai": 5, "juni": 6, "juli": 7, "august": 8, "september": 9, "oktober": 10, "november": 11, "desember": 12,
    "january": 1, "february": 2, "march": 3, "may": 5, "june": 6, "july": 7, "october": 10, "december": 12,
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "sept": 9, "oct": 10, "okt": 10, "nov": 11, "dec": 12, "des": 12,
}
FIELDS = ("date", "date_kind", "time", "indices", "resolution", "dpi", "copy", "variant", "malformed", "series_stem", "stem")
def _any(words) -> str:
    return "(" + "|".join(words) + ")"


def _blanked(left: Column, pattern: Column) -> Column:
    """`left` with blanks where `pattern` first matches; as it was where the pattern is null or matches nowhere."""
    blanks = F.repeat(F.lit(" "), F.length(F.regexp_substr(left, pattern)))
    return F.coalesce(F.regexp_replace(left, F.concat(F.lit("(?s)^(.*?)(?:"), pattern, F.lit(")")), F.concat(F.lit("$1"), blanks)), left)


def _got(left: Column, pattern: str, group: int) -> Column:
    """A group of the first match; null where there is none."""
    return F.nullif(F.regexp_extract(left, pattern, group), F.lit(""))


def _listed(left: Column, words, form: str) -> Column:
    """The first of the words whose form is found."""
    return F.coalesce(*[F.when(left.rlike(form.format(w)), F.lit(w)) for w in words])


def _stepped(state: Column, names: list[str], step) -> Column:
    """The state, a struct of `names`, with what `step` makes of it; bound as a lambda's variable."""

    def body(s: Column) -> Column:
        new = {n: s[n] for n in names} | step(s)
        return F.struct(*[v.alias(k) for k, v in new.items()])

    return F.element_at(F.transform(F.array(state), body), 1)


def _day(y: Column, m: Column, d: Column) -> Column:
    return F.when(y != "0000", F.try_to_date(F.concat_ws("-", y, m, d), "yyyy-MM-dd"))


def _dates(left: Column, as_of: str) -> Column:
    """struct(date, kind, time, pattern) of the first rule that gives a day. Six digits are read year first, unless that is no day or in the future; then day first."""

    def rule(kind: str, day: Column, pattern: str, time: Column | None = None) -> Column:
        text = day.cast("string")
        return F.when(text.isNotNull(), F.struct(text.alias("date"), F.lit(kind).alias("kind"), (F.lit(None).cast("string") if time is None else time).alias("time"), F.lit(pattern).alias("pattern")))

    def parts(pattern: str, *order: int) -> tuple[Column, ...]:
        return tuple(_got(left, pattern, i) for i in order)

    def past(day: Column) -> Column:
        return F.when(day <= F.lit(as_of).cast("date"), day)

    a, b, c = parts(SIX, 1, 2, 3)
    century = F.when(c < "50", "20").otherwise("19")
    named = rf"(?i)[_\- ]{_any(MONTHS)}[_\- ]((?:19|20)\d{{2}})"
    numbers = F.create_map(*[F.lit(x) for name, n in MONTHS.items() for x in (name, f"{n:02d}")])
    return F.coalesce(
        rule("iso_dt", _day(*parts(ISO_DT, 1, 2, 3)), ISO_DT, F.concat_ws(":", *parts(ISO_DT, 4, 5, 6))),
        rule("iso", _day(*parts(ISO, 1, 2, 3)), ISO),
        rule("ddmmyyyy", _day(*parts(DDMMYYYY, 3, 2, 1)), DDMMYYYY),
        rule("yymmdd", past(_day(F.concat(F.lit("20"), a), b, c)), SIX),
        rule("ddmmyy", past(_day(F.concat(century, c), b, a)), SIX),
        rule("monthname", F.concat(_got(left, named, 2), F.lit("-"), F.try_element_at(numbers, F.lower(_got(left, named, 1)))), named),
        rule("year", _got(left, YEAR, 1), YEAR),
    )


def _rules(as_of: str) -> list:
    """The steps in order; each gives new fields and what is left of the name."""
    roman, values = rf"[_\-]{_any(ROMAN_VALUES)}{_END}", F.create_map(*[F.lit(x) for kv in ROMAN_VALUES.items() for x in kv])

    def read(pattern: str, **fields):
        return lambda s: {k: v(s.left) for k, v in fields.items()} | {"left": _blanked(s.left, F.lit(pattern))}

    def rest(s: Column) -> dict[str, Column]:
        found = F.transform(F.regexp_extract_all(s.left, F.lit(INDEX), F.lit(1)), lambda v: v.cast("int"))
        before = F.substring(s.stem, F.lit(1), F.length(F.regexp_extract(s.left, f"(?s)^(.*?){INDEX}", 1)))
        series = F.when(s.left.rlike(INDEX), before).otherwise(s.stem)
        return {"indices": F.concat(F.array_compact(F.array(s.nr, s.roman)), found), "series_stem": F.btrim(series, F.lit(" _-#"))}

    return [
        lambda s: {"mark": _listed(s.left, COPY, "(?i){}")},
        lambda s: {"copy": s.mark.isNotNull(), "left": _blanked(s.left, F.concat(F.lit("(?i)"), s.mark))},
        read(DPI, dpi=lambda x: _got(x, DPI, 1).cast("int")),
        read(RESOLUTION, resolution=lambda x: F.concat(_got(x, RESOLUTION, 1), F.lit("x"), _got(x, RESOLUTION, 2))),
        read(MALFORMED, malformed=lambda x: x.rlike(MALFORMED)),
        lambda s: {"day": F.when(~s.malformed, _dates(s.left, as_of))},
        lambda s: {"date": s.day.date, "date_kind": s.day.kind, "time": s.day.time, "left": _blanked(s.left, s.day.pattern)},
        lambda s: {"variant": _listed(s.left, VARIANTS, rf"(?i)[_\- ]{{}}{_END}")},
        lambda s: {"left": F.coalesce(F.regexp_replace(s.left, F.concat(F.lit(r"(?i)[_\- ]"), s.variant, F.lit(_END)), F.repeat(F.lit(" "), F.length(s.variant) + 1)), s.left)},
        read(NR, nr=lambda x: _got(x, NR, 1).cast("int")),
        read(roman, roman=lambda x: F.try_element_at(values, _got(x, roman, 1))),
        rest,
    ]


def parsed_names(images: DataFrame, as_of: str) -> DataFrame:
    """images: (path, ...) with FIELDS. Names are read as of a day, so that the same name is always read the same."""
    name = stem(F.col("path"))
    state, names = F.struct(name.alias("stem"), name.alias("left")), ["stem", "left"]
    steps = [("mark",), ("copy",), ("dpi",), ("resolution",), ("malformed",), ("day",), ("date", "date_kind", "time"), ("variant",), (), ("nr",), ("roman",), ("indices", "series_stem")]
    for rule, new in zip(_rules(as_of), steps, strict=True):
        state = _stepped(state, names, rule)
        names = [*names, *new]
    return images.withColumn("__n", state).select(*images.columns, *[F.col(f"__n.{f}").alias(f) for f in FIELDS])


def collection(path: Column, roots: tuple[str, ...]) -> Column:
    """The directory below the first image root that holds the path, the root's own name at its top; else the parent's name."""
    parent = F.regexp_replace(path, "/[^/]*$", "")
    out = F.element_at(F.split(parent, "/"), -1)
    for root in reversed([r.rstrip("/") for r in roots]):
        inside = F.substring(parent, len(root) + 2, 1 << 30)
        out = F.when(parent == root, root.rsplit("/", 1)[-1]).when(parent.startswith(root + "/"), inside).otherwise(out)
    return out
