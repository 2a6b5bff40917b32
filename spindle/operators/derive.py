"""Operators that derive edges. Each returns (src_key, dst_key, rel, method) rows unless it says otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.paths import basename, dirname, normalise, shared_parts
from ..functions.text import stands_alone

CO_CHANGE_LEAST, COHORT_DAYS, COHORT_MODELS, BODY_LEAST = 3, 2, 2, 20
#: Rows (commit, file) of a part in which commits are paired.
PART_ROWS = 250_000
#: Names that a containment join may hand to every task, by count; beyond it names meet bodies by their words.
BROADCAST_NAMES = 50_000
# Markers that a copy's stem carries.
COPY_MARKERS = ("_copy2", "_copy", "-copy", "_kopi", " copy")


def _edges(df: DataFrame, src: str | Column, dst: str | Column, rel: str, method: str | Column) -> DataFrame:
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    return df.select(as_col(src).alias("src_key"), as_col(dst).alias("dst_key"), F.lit(rel).alias("rel"), (F.lit(method) if isinstance(method, str) else method).alias("method"))


def chain(members: DataFrame, group: list[str], key: str, rel: str, method: str) -> DataFrame:
    """Consecutive members of each group in order of their key. A group of n gives n - 1 edges."""
    nxt = F.lead(key).over(W.partitionBy(*group).orderBy(key))
    return _edges(members.select(*group, key).distinct().withColumn("__n", nxt).where("__n is not null"), key, "__n", rel, method)


def same_author(authored: DataFrame) -> DataFrame:
    """authored: (node_key, author)."""
    return chain(authored.where("author is not null"), ["author"], "node_key", "SAME_AUTHOR", "exact")


def stripped_of_copy(stem: Column) -> Column:
    """A stem without copy markers, to the point where none is left: each round takes out all and may join another."""
    import re

    pattern = "|".join(re.escape(m) for m in COPY_MARKERS)
    for _ in range(4):  # a round that leaves a marker shortens the stem; four undo any nesting a file name of 255 bytes is seen with
        stem = F.regexp_replace(stem, pattern, "")
    return F.trim(stem)


def likely_copies(images: DataFrame) -> DataFrame:
    """images: (path, stem, copy). Equal base names in a chain, and marked copies with the unmarked name they stem from."""
    named = images.select("path", basename(F.col("path")).alias("base"))
    same = chain(named, ["base"], "path", "LIKELY_COPY", "basename")
    marked = images.where("copy").select(F.col("path").alias("other"), stripped_of_copy(F.col("stem")).alias("s"))
    plain = images.where("not copy").select("path", F.trim("stem").alias("s"))
    return same.union(_edges(plain.join(marked, "s"), "path", "other", "LIKELY_COPY", "basename")).distinct()


def series_members(images: DataFrame) -> DataFrame:
    """images: (path, collection, series_stem, indices). Members of a series of more than one that carry an index."""
    own = images.where(F.size("indices") > 0).withColumn("n", F.count("*").over(W.partitionBy("collection", "series_stem")))
    return _edges(own.where("n > 1"), "path", F.concat(F.lit("series:"), "collection", F.lit("/"), "series_stem"), "SERIES_MEMBER", "exact")


def contains(parents: DataFrame, children: str = "sections") -> DataFrame:
    """parents: (node_key, <array>). An edge to node_key#i for each element."""
    return _edges(parents.select("node_key", F.posexplode(children).alias("i", "x")), "node_key", F.concat("node_key", F.lit("#"), "i"), "CONTAINS", "exact")


def listed(items: DataFrame, values: str, prefix: str, rel: str, limit: int | None = None) -> DataFrame:
    """An edge to `prefix` + value for each of the first `limit` distinct values of an array column."""
    own = F.array_distinct(F.filter(values, lambda v: v.isNotNull() & (v != "")))
    each = items.select("node_key", F.explode(F.slice(own, 1, limit) if limit else own).alias("v"))
    return _edges(each, "node_key", F.concat(F.lit(prefix), "v"), rel, "exact")


def resolved_links(links: DataFrame, nodes: DataFrame, rel: str, method: str = "exact") -> tuple[DataFrame, DataFrame]:
    """links: (node_key, target), targets relative to the file's directory. Edges to nodes of that path, and the links that lead nowhere."""
    target = F.regexp_replace("target", r"[#?].*$", "")
    full = F.when(target.startswith("/"), target).otherwise(F.concat(dirname(F.col("node_key")), F.lit("/"), target))
    met = links.withColumn("__p", normalise(full)).join(nodes.where("node_key = path").select(F.col("path").alias("__p"), F.col("node_key").alias("__t")), "__p", "left")
    return _edges(met.where("__t is not null and __t <> node_key"), "node_key", "__t", rel, method).distinct(), met.where("__t is null").select("node_key", "target")


def wikilinks(links: DataFrame, pages: DataFrame) -> DataFrame:
    """links: (node_key, target); pages: (path, name). A target is the page of that name; of several, the one that shares most
    of the path's beginning, then the shallower, then the smaller; without one, a broken stub."""
    met = links.distinct().join(pages.select("path", F.col("name").alias("target")), "target", "left")
    best = W.partitionBy("node_key", "target")
    order = [F.desc(shared_parts(F.col("node_key"), F.col("path"))), F.size(F.split("path", "/")), F.col("path")]
    ranked = met.withColumn("n", F.count("path").over(best)).withColumn("r", F.row_number().over(best.orderBy(*order))).where("r = 1")
    dst = F.coalesce("path", F.concat(F.lit("wikilink:"), "target"))
    return _edges(ranked, "node_key", dst, "WIKILINKS_TO", F.when(F.col("n") > 1, "path_prefix").otherwise("exact"))


def first_existing(candidates: DataFrame, nodes: DataFrame, rel: str = "REFERENCES_FILE", method: str = "mention") -> DataFrame:
    """candidates: (node_key, token, paths), the paths in order of trust. An edge to the first that is a node other than the file itself."""
    each = candidates.select("node_key", "token", F.posexplode("paths").alias("pos", "p"))
    met = each.join(nodes.select(F.col("node_key").alias("p")), "p").where("p <> node_key")
    return _edges(met.groupBy("node_key", "token").agg(F.min_by("p", "pos").alias("p")), "node_key", "p", rel, method).distinct()


def mention_candidates(mentions: DataFrame, root: str) -> DataFrame:
    """mentions: (node_key, token) -> (node_key, token, paths): from the home root, absolute, beside the file, below the root."""
    t = F.col("token")
    home = normalise(F.concat(F.lit(root), F.substring(t, 2, 1 << 30)))
    beside, below = normalise(F.concat(dirname(F.col("node_key")), F.lit("/"), t)), normalise(F.concat(F.lit(root.rstrip("/") + "/"), t))
    return mentions.select("node_key", "token", F.when(t.startswith("~"), F.array(home)).when(t.startswith("/"), F.array(normalise(t))).otherwise(F.array(beside, below)).alias("paths"))


def _tokens(text: Column) -> Column:
    """The runs of letters and digits of a text, in order; the first or last is empty where the text begins or ends between runs."""
    return F.split(text, r"[^\p{L}\p{N}]+", -1)


def _containing(bodies: DataFrame, names: DataFrame) -> DataFrame:
    """Pairs of bodies (src_key, body, ...) and names (dst_key, name, ...) where the body holds the name.

    A few names go to every task. Many meet the bodies by a word. A run of letters and digits inside a name is a whole run of any
    body that holds the name, so the name is keyed by that of its inner runs which the fewest bodies have. A name without an inner run,
    as a base name, is keyed by its longest run, which lies within a run of the body: it is looked for in the vocabulary, by
    trigrams, and stands for the words that it is found in. Bodies are cut into distinct words without copies of them, and joined
    back by key for the test of the pairs that are left.
    """
    if names.limit(BROADCAST_NAMES + 1).count() <= BROADCAST_NAMES:
        return bodies.join(F.broadcast(names), F.col("body").contains(F.col("name")))
    names = names.where("name <> ''").distinct()
    own = F.struct(*names.columns)
    runs = _tokens(F.col("name"))
    cut = names.select(own.alias("x"), F.filter(F.slice(runs, 2, F.greatest(F.size(runs) - 2, F.lit(0))), lambda t: t != "").alias("inner"), runs.alias("runs"))
    longest = F.array_max(F.transform("runs", lambda t: F.struct(F.length(t).alias("n"), t.alias("t")))).t
    words = bodies.select("src_key", F.explode(F.array_distinct(_tokens(F.col("body")))).alias("word")).where("word <> ''")
    vocabulary = words.groupBy("word").agg(F.count("*").alias("held"))

    inner = cut.select("x", F.explode("inner").alias("word")).join(vocabulary, "word", "left")
    rarest = inner.groupBy("x").agg(F.min(F.struct(F.coalesce("held", F.lit(0)).alias("held"), "word")).alias("k")).where("k.held > 0")
    by_word = rarest.select("x", "k.word")

    edge = cut.where(F.size("inner") == 0).select("x", longest.alias("part"))
    grams = F.transform(F.sequence(F.lit(1), F.length("word") - 2), lambda i: F.substring(F.col("word"), i, F.lit(3)))
    parts = edge.where(F.length("part") > 2).withColumn("g", F.substring("part", 1, 3))
    met = vocabulary.where(F.length("word") > 2).select("word", F.explode(F.array_distinct(grams)).alias("g")).join(parts, "g").where(F.col("word").contains(F.col("part")))
    brief = edge.where(F.length("part").between(1, 2))
    kinds = brief.select(F.col("part").alias("p")).distinct()  # at most the pairs of characters there are
    within = vocabulary.select("word").join(F.broadcast(kinds), F.col("word").contains(F.col("p"))).join(brief, F.col("p") == F.col("part"))

    keyed = by_word.unionByName(met.select("x", "word")).unionByName(within.select("x", "word"))
    pairs = words.join(keyed, "word").select("src_key", "x").distinct()
    found = bodies.join(pairs, "src_key").select(*bodies.columns, "x.*").where(F.col("body").contains(F.col("name")))
    bare = edge.where("part = ''").select("x.*")  # names of marks only
    return found.unionByName(bodies.join(bare, F.col("body").contains(F.col("name"))))


def figures_for(texts: DataFrame, images: DataFrame) -> DataFrame:
    """texts: (node_key, body); images: (node_key, path). A text that holds an image's base name."""
    names = images.select(F.col("node_key").alias("dst_key"), basename(F.col("path")).alias("name")).where("name <> ''")
    return _edges(_containing(texts.select(F.col("node_key").alias("src_key"), "body"), names), "src_key", "dst_key", "FIGURE_FOR", "basename").distinct()


def mentions_file(nodes: DataFrame, boundary: bool = False) -> DataFrame:
    """nodes: (node_key, model, kind, path, body). A file's body that holds the path of a node of another model; `boundary` asks that it stands alone."""
    bodies = nodes.where(F.col("kind").isin("file", "document") & (F.col("model") != "m2") & (F.length("body") > BODY_LEAST))
    bodies = bodies.select(F.col("node_key").alias("src_key"), F.col("model").alias("m"), "body")
    paths = nodes.where("node_key like '%::%' or node_key = path").where("path is not null").groupBy("path").agg(F.max_by(F.struct("node_key", "model"), "model").alias("x"))
    names = paths.select(F.col("path").alias("name"), F.col("x.node_key").alias("dst_key"), F.col("x.model").alias("n"))
    met = _containing(bodies, names).where("m <> n")
    met = met.where(stands_alone(F.col("body"), F.col("name"), True)) if boundary else met
    return _edges(met, "src_key", "dst_key", "MENTIONS_FILE", "mention").distinct()


def cites_code(texts: DataFrame, code: DataFrame, root: str) -> DataFrame:
    """texts: (node_key, body); code: (node_key, path). A path that stands alone in a body counts as a mention; a base name
    that only one code file has counts by base name, unless its path was met."""
    bodies = texts.select(F.col("node_key").alias("src_key"), "body")
    top = root.rstrip("/") + "/"
    forms = code.select(F.col("node_key").alias("dst_key"), F.explode(F.array_distinct(F.array("path", F.when(F.col("path").startswith(top), F.substring("path", len(top) + 1, 1 << 30)).otherwise(F.col("path"))))).alias("name"))
    forms = forms.where(F.col("name").contains("/"))
    by_path = _containing(bodies, forms).where(stands_alone(F.col("body"), F.col("name"), True)).select("src_key", "dst_key").distinct()
    bases = code.select(F.col("node_key").alias("dst_key"), basename(F.col("path")).alias("name")).withColumn("n", F.count("*").over(W.partitionBy("name"))).where("n = 1").drop("n")
    by_name = _containing(bodies, bases).where(stands_alone(F.col("body"), F.col("name"), False)).select("src_key", "dst_key").distinct()
    by_name = by_name.join(by_path, ["src_key", "dst_key"], "left_anti")
    return _edges(by_path, "src_key", "dst_key", "CITES_CODE", "mention").union(_edges(by_name, "src_key", "dst_key", "CITES_CODE", "basename"))


def cohorts(nodes: DataFrame) -> DataFrame:
    """nodes: (node_key, model, datelist_int, anchor). Nodes of one anchor and mask of two days or more, over two models or more: a star from the
    first by (model, key) to those of other models. The first is a minimum, joined back; groups are never gathered."""
    own = nodes.where(F.bit_count("datelist_int") >= COHORT_DAYS).select("node_key", "model", "datelist_int", "anchor")
    group = ["anchor", "datelist_int"]
    first = own.groupBy(*group).agg(F.min(F.struct("model", "node_key")).alias("f"), F.max("model").alias("m")).where("f.model <> m")
    return _edges(own.join(first, group).where("model <> f.model"), "f.node_key", "node_key", "TEMPORAL_COHORT", "cohort")


def co_changes(commits: DataFrame, least: int = CO_CHANGE_LEAST) -> DataFrame:
    """commits: (sha, path) -> (a, b, shared, union): pairs of files with `least` shared commits or more, a < b.

    Files with fewer commits than `least` can't be in a pair, so they go before commits are paired. The number of parts follows
    from the number of rows, so that the memory of a task, which sorts and pairs one, doesn't grow with the input.
    """
    parts = max(1, -(-commits.count() // PART_ROWS))
    own = commits.select("sha", "path").repartition(parts, "path").distinct()
    counts = own.groupBy("path").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    own = own.join(counts.hint("merge"), "path").repartition(parts, "sha")
    a = own.select("sha", F.col("path").alias("a"), F.col("n").alias("na"))
    b = own.select("sha", F.col("path").alias("b"), F.col("n").alias("nb"))
    pairs = a.join(b.hint("merge"), "sha").where("a < b").repartition(2 * parts, "a", "b").groupBy("a", "b", "na", "nb").agg(F.count("*").alias("shared")).where(F.col("shared") >= least)
    return pairs.select("a", "b", "shared", (F.col("na") + F.col("nb") - F.col("shared")).alias("union"))


def co_changed(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of co_changes between nodes (node_key, path), ends sorted."""
    n = nodes.select("node_key", "path")
    met = pairs.join(n.select(F.col("path").alias("a"), F.col("node_key").alias("x")), "a").join(n.select(F.col("path").alias("b"), F.col("node_key").alias("y")), "b")
    return _edges(met, F.least("x", "y"), F.greatest("x", "y"), "CO_CHANGED_WITH", "co-change")


def heading_in_force(headings: DataFrame, links: DataFrame, group: str, at: str) -> DataFrame:
    """headings: (group, at, title); links: (group, at, ...). Links with `heading`, the last before them (null if there is none): an as-of join by one sorted pass."""
    both = headings.select(group, at, "title", F.lit(None).cast("boolean").alias("__link"), F.lit(None).alias("__row")).unionByName(
        links.select(group, at, F.lit(None).cast("string").alias("title"), F.lit(True).alias("__link"), F.struct(*links.columns).alias("__row")), allowMissingColumns=True
    )
    before = W.partitionBy(group).orderBy(at).rangeBetween(W.unboundedPreceding, -1)
    return both.withColumn("heading", F.last("title", True).over(before)).where("__link").select("__row.*", "heading")


def section_leaves(headings: DataFrame, group: str, at: str) -> DataFrame:
    """headings with `leaf`: the last of its group, or the next is not deeper."""
    return headings.withColumn("leaf", F.coalesce(F.lead("level").over(W.partitionBy(group).orderBy(at)) <= F.col("level"), F.lit(True)))


def categorised(links: DataFrame, headings: DataFrame) -> DataFrame:
    """From an index page: an edge from each linked page to every heading it is listed under. links: (group, at, page); headings: (group, at, title)."""
    met = heading_in_force(headings, links, "group", "at").where("heading is not null")
    return _edges(met.select("page", "heading").distinct(), "page", F.concat(F.lit("category:"), "heading"), "CATEGORIZED_UNDER", "exact")
