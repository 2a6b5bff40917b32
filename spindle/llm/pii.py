"""Personal data by gradient-boosted candidates, in DataFrame operations only.

Base patterns with their checks (parts of an address, Luhn sum, number of digits) give the
base spans. Beside them three high-recall generators propose candidates that overlap them and each other:
written-out mail addresses, loose groups of digits, and long runs of letters, digits and marks, as credentials are. Boosted
trees score a candidate by its format and its surroundings. They learn from evidence that can be checked and that is no feature:

* email, phone: a base span overlaps, which the mark (`@`, `+`) gives; the features are blind to marks. Others are unlabelled,
  not negative: thresholds count them by the positive-unlabelled estimate (Elkan and Noto, 2008).
* card: the Luhn sum. Only groups that pass are taken; one group in ten passes by chance, so a ninth of those that fail is
  taken off those that pass.
* ip: the range of its parts. Only groups that pass are taken.
* secret: a credential's name stands before it (`token = "..."`); the features are blind to names.

Trees are fitted on one half of the documents, by a hash of their id; a threshold for each kind is calibrated on the
counts of all candidates of the other half. Of those above it that overlap each other the set of the greatest total score is
taken (weighted interval scheduling). Base spans always stay, and no added span overlaps one.

Trees are fitted on the driver on at most TRAIN_ROWS candidates and applied as CASE expressions. Texts are read
once; positions are running sums over the pieces between matches, so work is linear in a text. Only matches
with a few characters around them are shuffled, by row.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table, written

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
# Possessive forms of the base patterns: they match the same, without stepping back or recursion. A match begins at the
# start of a run or where the last match ended; elsewhere in a run it could only begin if it also could there.
_LOCAL, _D = "A-Za-z0-9._%+-", "[0-9]++"
PATTERNS = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": rf"(?:(?<![0-9])|\G){_D}\.{_D}\.{_D}\.{_D}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "mail": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++(?:@|\x20?[\[(]at[\])]\x20?)[A-Za-z0-9-]++(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[A-Za-z0-9-]++)++",
    # A card's 19 digits with two separators between any two are 55 characters.
    "num": r"(?<![A-Za-z0-9])[0-9(][0-9().\x20-]{5,53}[0-9](?![A-Za-z0-9])",
    "run": r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}+",
}
GENERATORS = ("mail", "num", "run")
#: What stands before a credential's value. Fixed values.
_NAMED = r"(?i)(?:token|key|secret|passwd|password|pwd|credential|bearer|auth)[\"']?\x20{0,2}[:=]?\x20{0,2}[\"']?$"
TRAIN_ROWS, TREES, DEPTH, RATE, PRECISION, BINS, SEED = 20_000, 30, 3, 0.2, 0.98, 100, 3
#: Confirmed candidates of the calibration half that a threshold needs.
LEAST_CONFIRMED = 10
#: No lower score is ever taken, also where all candidates of a kind were confirmed.
FLOOR = 0.05
AROUND = 16
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


def _row(gen: str, pieces: Column):
    def row(m: Column, i: Column) -> Column:
        before, after = F.get(pieces, i), F.get(pieces, i + 1)
        return F.struct(F.lit(gen).alias("gen"), i.alias("i"), m.alias("m"), F.length(before).alias("n"), F.substring(before, -AROUND, AROUND).alias("before"), F.substring(after, 1, AROUND).alias("after"))

    return row


def _matches(docs: DataFrame) -> DataFrame:
    """(rid, doc_id, gen, i, m, n, before, after): every match of every pattern; one row of nulls where there is none. n: characters since the last match."""
    t = F.col("t")
    digits = t.rlike("[0-9]")
    wanted = {"email": t.contains("@"), "phone": t.contains("+"), "mail": t.contains("@") | t.rlike(r"[\[(]at[\])]"), "run": F.lit(True)}
    every = None
    src = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.coalesce("text", F.lit("")).alias("t"))
    src = src.select("rid", "doc_id", "t", digits.alias("digits"))
    for gen, p in PATTERNS.items():
        on = wanted.get(gen, F.col("digits"))
        src = src.withColumn(f"m_{gen}", F.when(on, F.regexp_extract_all("t", F.lit(p), F.lit(0))))
        src = src.withColumn(f"p_{gen}", F.when(F.size(f"m_{gen}") > 0, F.split("t", p, -1)))
    for gen in PATTERNS:
        pieces = F.col(f"p_{gen}")

        row = _row(gen, pieces)
        own = F.when(pieces.isNotNull(), F.transform(F.col(f"m_{gen}"), row))
        own = F.coalesce(own, F.array().cast("array<struct<gen:string,i:int,m:string,n:int,before:string,after:string>>"))
        every = own if every is None else F.concat(every, own)
    return src.select("rid", "doc_id", F.explode_outer(every).alias("x")).select("rid", "doc_id", "x.*")


def _luhn(digits: Column) -> Column:
    """Whether up to 19 digits have a Luhn sum that ends in 0."""
    plain = F.rpad(F.reverse(digits), 19, "0")
    twice = F.translate(plain, "0123456789", "0246813579")
    total = sum((F.ascii(F.substring(twice if i % 2 else plain, i + 1, 1)) - 48 for i in range(19)), F.lit(0))
    return total % 10 == 0


def _spans(docs: DataFrame) -> DataFrame:
    """_matches with start and end, whether a row is a base span, its kind, what its kind's check says (null: none), and whether a base span of its row overlaps it."""
    line = W.partitionBy("rid", "gen").orderBy("i").rowsBetween(W.unboundedPreceding, W.currentRow)
    size, digits = F.length("m"), F.regexp_replace("m", "[^0-9]", "")
    at = _matches(docs).repartition("rid").withColumn("end", F.sum(F.col("n") + size).over(line))
    at = at.withColumn("start", F.col("end") - size).withColumn("digits", F.length(digits))
    ip = F.col("m").rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    base = (
        F.when(F.col("gen") == "email", True)
        .when(F.col("gen") == "ip", ip)
        .when(F.col("gen") == "card", F.when(F.col("digits").between(16, 19), _luhn(digits)).otherwise(False))
        .when(F.col("gen") == "phone", F.col("digits").between(8, 15))
        .otherwise(False)
    )
    kind = (
        F.when(F.col("gen").isin(*BASE_KINDS), F.col("gen")).when(F.col("gen") == "mail", "email").when(F.col("gen") == "run", F.when(F.col("m").rlike("[A-Za-z]"), "secret"))
        .when(F.col("m").rlike(r"^[0-9]+(?:\.[0-9]+){3}$"), "ip").when(F.col("digits").between(16, 19), "card").when(F.col("digits").between(8, 15), "phone")
    )
    checked = F.when(F.col("kind") == "ip", ip).when(F.col("kind") == "card", F.when(F.col("digits").between(16, 19), _luhn(digits)).otherwise(False)).when(F.col("kind") == "secret", F.col("before").rlike(_NAMED))
    at = at.withColumn("base", base).withColumn("kind", kind).withColumn("checked", checked)
    order = W.partitionBy("rid").orderBy("start", "end", "gen", "i")
    ended = F.max(F.when(F.col("base"), F.col("end"))).over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    begins = F.min(F.when(F.col("base"), F.col("start"))).over(order.rowsBetween(W.currentRow, W.unboundedFollowing))
    met = F.coalesce(ended > F.col("start"), F.lit(False)) | F.coalesce(begins < F.col("end"), F.lit(False))
    return at.withColumn("met", met)


def _features() -> dict[str, Column]:
    """Format and surroundings of a candidate, without the marks of the base patterns."""
    body = F.regexp_replace("m", "@|[\\[(]at[\\])]", "")
    before = F.rtrim(F.regexp_replace("before", r"\+$", ""))
    count = lambda c, p: F.length(F.regexp_replace(c, f"[^{p}]", ""))
    last, first = F.substring(before, -1, 1), F.substring("after", 1, 1)
    kind = lambda c: F.when(c == "", 0).when(c.rlike(r"\p{L}"), 1).when(c.rlike("[0-9]"), 2).when(c == " ", 3).when(c == ".", 4).when(c == ",", 5).when(c.rlike("[\"'=:]"), 6).otherwise(7)
    return {
        "kind": sum((F.when(F.col("kind") == k, i).otherwise(0) for i, k in enumerate(KINDS)), F.lit(0)),
        "length": F.length(body), "digits": F.col("digits"), "spaces": count(body, " "), "dots": count(body, "."),
        "dashes": count(body, "-"), "brackets": count(body, "()"), "letters": count(body, "A-Za-z"), "capitals": count(body, "A-Z"), "hex": count(body, "0-9A-Fa-f"),
        "distinct": F.when(F.col("kind") == "secret", F.size(F.array_distinct(F.split(F.lower(F.substring(body, 1, 64)), "")))).otherwise(0),
        "first_digit": F.coalesce(F.try_to_number(F.regexp_extract("m", "[0-9]", 0), F.lit("9")).cast("int"), F.lit(-1)),
        "left": kind(last), "right": kind(first),
        "left_digits": count(F.col("before"), "0-9"), "right_digits": count(F.col("after"), "0-9"),
        "left_marks": count(F.col("before"), "#*$%&|"), "right_marks": count(F.col("after"), "#*$%&|"),
        "left_capitals": count(F.col("before"), "A-Z"),
    }


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> tuple[float, list]:
    """Gradient boosting of log loss by exact greedy splits: (first raw score, trees); a tree is a number or (feature, cut, left, right)."""
    if not len(y) or y.min() == y.max():
        return (6.0 if len(y) and y.max() else -6.0), []
    mean = float(y.mean())
    first = float(np.log(mean / (1 - mean)))
    raw, made = np.full(len(y), first), []

    def grow(own: np.ndarray, g: np.ndarray, h: np.ndarray, left: int):
        gs, hs = g[own].sum(), h[own].sum()
        leaf = float(-rate * gs / (hs + 1.0))
        best, chosen = 1e-3, None
        if left:
            for f in range(x.shape[1]):
                values, back = np.unique(x[own, f], return_inverse=True)
                if len(values) < 2:
                    continue
                gl, hl = np.cumsum(np.bincount(back, g[own]))[:-1], np.cumsum(np.bincount(back, h[own]))[:-1]
                gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                k = int(gain.argmax())
                if gain[k] > best:
                    best, chosen = gain[k], (f, float(values[k] + values[k + 1]) / 2)
        if chosen is None:
            raw[own] += leaf
            return leaf
        low = x[own, chosen[0]] < chosen[1]
        return (*chosen, grow(own[low], g, h, left - 1), grow(own[~low], g, h, left - 1))

    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        made.append(grow(np.arange(len(y)), p - y, p * (1 - p), depth))
    return first, made


def score(model: tuple[float, list], names: list[str]) -> Column:
    """The model as one expression over its feature columns."""

    def case(tree) -> Column:
        if isinstance(tree, float):
            return F.lit(tree)
        f, cut, low, high = tree
        return F.when(F.col(names[f]) < cut, case(low)).otherwise(case(high))

    raw = sum((case(t) for t in model[1]), F.lit(model[0]))
    return 1 / (1 + F.exp(-raw))


def calibrate(counts: list[tuple[str, int, bool, int]], precision: float = PRECISION) -> dict[str, float]:
    """From (kind, score bin, confirmed, number): for each kind the lowest threshold above which an estimated `precision` of what is taken is right."""
    found = {}
    for kind in {k for k, *_ in counts}:
        good, other = np.zeros(BINS + 1), np.zeros(BINS + 1)
        for k, b, ok, n in counts:
            if k == kind:
                (good if ok else other)[b] += n
        above = lambda x: x[::-1].cumsum()[::-1]
        if kind in ("email", "phone"):
            p = np.clip(np.arange(BINS + 1) / BINS, 0.005, 0.995)
            c = float(np.clip((good * p).sum() / max(1.0, good.sum()), 0.005, 0.995))  # how often a true one is confirmed
            right, taken = good + other * np.minimum(1.0, (1 - c) / c * p / (1 - p)), good + other
        elif kind == "card":
            right, taken = good - other / 9, good
        elif kind == "ip":
            right, taken = good, good
        else:
            right, taken = good, good + other
        fine = np.flatnonzero((above(good) >= LEAST_CONFIRMED) & (above(right) >= precision * above(taken)))
        if len(fine):
            found[kind] = int(fine[0]) / BINS
    return found


def best_apart(items: str) -> Column:
    """Of an array of (start, end, kind, p), by start: those of the greatest total p of which no two overlap; the earlier found on ties."""
    best = lambda front: F.array_max(F.transform(front, lambda f: F.struct(f.total.alias("total"), (-f.at).alias("at"))))
    # The front has the best choice that ends before the next start, and the choices that don't end before it.
    first = F.struct(F.array(F.struct(F.lit(0).cast("long").alias("end"), F.lit(0.0).alias("total"), F.lit(-1).alias("at"))).alias("front"), F.array().cast("array<int>").alias("prev"))

    def step(a: Column, x: Column) -> Column:
        ended = best(F.filter(a.front, lambda f: f.end <= x.start))
        kept = F.struct(F.lit(0).cast("long").alias("end"), ended.total.alias("total"), (-ended.at).alias("at"))
        new = F.struct(x.end.alias("end"), (ended.total + x.p).alias("total"), F.size(a.prev).alias("at"))
        return F.struct(F.concat(F.array(kept), F.filter(a.front, lambda f: f.end > x.start), F.array(new)).alias("front"), F.concat(a.prev, F.array(-ended.at)).alias("prev"))

    done = F.aggregate(items, first, step, lambda a: F.struct((-best(a.front).at).alias("at"), a.prev.alias("prev")))
    back = lambda a, i: F.when(i == a.at, F.struct(F.get(a.prev, i).alias("at"), a.prev.alias("prev"), F.concat(a.own, F.array(i)).alias("own"))).otherwise(a)
    started = F.transform(F.array(done), lambda d: F.struct(d.at.alias("at"), d.prev.alias("prev"), F.array().cast("array<int>").alias("own")))
    chosen = F.aggregate(F.sequence(F.size(items) - 1, F.lit(0), F.lit(-1)), F.element_at(started, 1), back, lambda a: a.own)
    return F.filter(items, lambda x, i: F.array_contains(chosen, i))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS, precision: float = PRECISION) -> DataFrame:
    """(doc_id, base, spans) for every row of `docs`: arrays of (order, kind, start, end), ends exclusive, in code points.

    `base` has the base spans, `spans` these and the added ones, by kind as in KINDS, then start. Added spans overlap no
    other span. Null texts count as empty and have none; repeated rows and null ids
    are judged row by row; an empty table gives an empty one; other columns are not read.
    """
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    spans = written(_spans(src).drop("n", "i"), "matches")
    made = _features()
    proposed = spans.where(F.col("gen").isin(*GENERATORS) & F.col("kind").isNotNull())
    names = [f"f_{k}" for k in made]
    confirmed = F.coalesce("checked", "met")
    half = F.pmod(F.xxhash64(F.lit(SEED + 1), "doc_id"), F.lit(2))
    seen = proposed.select("rid", "doc_id", "kind", "start", "end", "met", "checked", confirmed.alias("ok"), half.alias("half"), *[v.cast("double").alias(f"f_{k}") for k, v in made.items()])
    seen = written(seen, "candidates")
    rows = seen.where("half = 0").orderBy(F.xxhash64(F.lit(SEED), "doc_id", "start"), "doc_id", "start", "end", "kind").limit(train_rows).select(*names, "ok").toPandas()
    model = fit_trees(rows[names].to_numpy(np.float64), rows["ok"].to_numpy(np.float64))
    scored = seen.withColumn("p", score(model, names))
    counts = scored.where("half = 1").groupBy("kind", F.floor(F.col("p") * BINS).cast("int").alias("bin"), "ok").count().collect()  # bins times kinds
    limits = calibrate([tuple(r) for r in counts], precision)
    limit = F.coalesce(*[F.when(F.col("kind") == k, F.lit(max(v, FLOOR))) for k, v in limits.items()], F.lit(2.0))
    passes = ~F.col("kind").isin("ip", "card") | F.col("checked")
    taken = scored.where((F.col("p") >= limit) & ~F.col("met") & passes).select("rid", "doc_id", "kind", "start", "end", "p")
    # Candidates that overlap, directly or through others, are chosen from together.
    order = W.partitionBy("rid").orderBy("start", "end", "kind")
    reach = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    group = F.sum(F.when(reach > F.col("start"), 0).otherwise(1)).over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    held = F.sort_array(F.collect_list(F.struct("start", "end", "kind", "p"))).alias("held")
    taken = taken.withColumn("group", group).groupBy("rid", "doc_id", "group").agg(held)
    taken = taken.select("rid", "doc_id", F.explode(F.when(F.size("held") == 1, F.col("held")).otherwise(best_apart("held"))).alias("x"))
    taken = taken.select("rid", "doc_id", "x.kind", "x.start", "x.end", F.lit(False).alias("base"))
    base = F.coalesce("base", F.lit(False))
    every = spans.select("rid", "doc_id", F.when(base, F.col("kind")).alias("kind"), "start", "end", base.alias("base")).union(taken)
    place = sum((F.when(F.col("kind") == k, i).otherwise(0) for i, k in enumerate(KINDS)), F.lit(0))
    span = F.when(F.col("kind").isNotNull(), F.struct(place.alias("order"), "kind", "start", "end"))
    both = every.groupBy("rid", "doc_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("base"), span))).alias("base"),
        F.sort_array(F.collect_list(span)).alias("spans"),
    )
    return both.select("doc_id", "base", "spans")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    kinds = F.transform("base", lambda s: s.kind)
    counts = [(F.size("base") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    added = (F.size("spans") - F.size("base")).cast("long").alias("n_added")
    return found.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"), added)


QUERIES = {"op9_pii": op9_pii}
SQL: dict[str, str] = {}
