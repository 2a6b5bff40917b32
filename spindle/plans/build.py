"""Builders: from files of a partition to a store's nodes and edges. Extraction is per file; edges are derived over all of them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import CannotUpdate, ConfigChanged, NotBuilt
from ..functions.dates import month
from ..functions.paths import basename, dirname, stem
from ..operators import derive, state, temporal
from ..operators.graph import pruned
from ..operators.reports import cold_rollup
from ..sources import archives, documents, files, markdown
from ..store import Store, as_edges, as_nodes
from . import filenames

FILE_REFS, CITED, SHOWN_TABLES = 40, 40, 40


@dataclass
class Parts:
    """What a builder derives: node rows, edge rows, and counts for its report."""

    nodes: DataFrame
    edges: DataFrame
    counts: dict[str, DataFrame] = field(default_factory=dict)


def _key(*parts) -> Column:
    return F.concat(*[F.lit(p) if i % 2 == 0 else p for i, p in enumerate(parts)])


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def _file_ids(df: DataFrame) -> DataFrame:
    return df.withColumn("node_key", F.col("path"))


def _sections(df: DataFrame, extra: list[str]) -> DataFrame:
    each = df.select("path", "subtype", F.posexplode("sections").alias("i", "x"))
    return each.select(F.concat("path", F.lit("#"), "i").alias("node_key"), F.lit("section").alias("kind"), "subtype", "path", F.col("x.title").alias("title"), *extra)


def markdown_parts(spark: SparkSession, extracted: DataFrame, root: str = "/", index_file: str | None = None) -> Parts:
    """M3 from rows of sources.markdown.SCHEMA. The index page, if there is one, files pages under its headings."""
    f = _file_ids(extracted)
    crumb = F.array_join("x.heading_path", markdown.BREADCRUMB).alias("body")
    nodes = [
        f.select("node_key", F.lit("file").alias("kind"), "subtype", "path", "title", "body", "size", "content_hash", "title_method"),
        _sections(f, [crumb, F.col("x.content_hash").alias("content_hash"), F.col("x.heading_path").alias("heading_path"), F.col("x.leaf").alias("section_leaf")]),
        f.select(F.explode("tags").alias("t")).select(_key("tag:", F.col("t")).alias("node_key"), F.lit("tag").alias("kind"), F.col("t").alias("title")),
    ]
    links = f.select("node_key", F.explode("wikilinks").alias("target"))
    wiki = derive.wikilinks(links, f.select("path", "name"))
    broken = wiki.where("dst_key like 'wikilink:%'").select("dst_key").distinct()
    nodes.append(broken.select(F.col("dst_key").alias("node_key"), F.lit("wikilink").alias("kind"), F.lit("broken").alias("subtype"), F.substring("dst_key", 10, 1 << 30).alias("title")))
    targets = f.select(F.col("node_key"), F.col("path"))
    local = lambda c: f.select("node_key", F.explode(c).alias("target")).where(~F.col("target").rlike("^(?:https?://|mailto:|#)"))
    link_edges, _ = derive.resolved_links(local("links"), targets, "LINKS_TO")
    embed_edges, _ = derive.resolved_links(local("embeds"), targets, "EMBEDS")
    home = F.when(F.col("target").startswith("~"), F.concat(F.lit(root.rstrip("/")), F.substring("target", 2, 1 << 30))).otherwise(F.col("target"))
    mentions, unresolved = derive.resolved_links(f.select("node_key", F.explode("path_mentions").alias("target")).withColumn("target", home), targets, "MENTIONS_PATH", "mention")
    edges = [derive.contains(f), wiki, derive.listed(f, "tags", "tag:", "TAGGED"), link_edges, embed_edges, mentions]
    if index_file is not None:
        index = f.where(F.col("path") == index_file)
        placed = index.select(F.col("node_key").alias("group"), F.explode("placed_links").alias("x")).select("group", F.col("x.offset").alias("at"), F.col("x.target").alias("target"))
        pages = derive.wikilinks(placed.select(F.col("group").alias("node_key"), "target"), f.select("path", "name")).select(F.col("src_key").alias("group"), F.col("dst_key").alias("page"))
        names = f.select(F.col("path").alias("page"), F.col("name").alias("target"))
        placed = placed.join(names, "target").join(pages, ["group", "page"], "left_semi")
        heads = index.select(F.col("node_key").alias("group"), F.explode("sections").alias("x")).select("group", F.col("x.offset").alias("at"), F.col("x.title").alias("title"))
        filed = derive.categorised(placed.select("group", "at", "page"), heads)
        nodes.append(filed.select(F.col("dst_key").alias("node_key"), F.lit("category").alias("kind"), F.substring("dst_key", 10, 1 << 30).alias("title")))
        edges.append(filed)
    return Parts(_union(nodes), _union(edges), {"unresolved_mentions": unresolved})


def document_parts(spark: SparkSession, extracted: DataFrame, root: str, extensions: frozenset[str]) -> Parts:
    """M1 from rows of sources.documents.SCHEMA. What can't be read is a node with its status."""
    f = _file_ids(extracted)
    meta = lambda k: F.try_element_at("metadata", F.lit(k))
    subtype = F.when(F.col("status") == "ok", F.col("doctype")).otherwise(F.concat("doctype", F.lit("/"), "status"))
    titled = meta("title")
    f = f.withColumn("subtype", subtype)
    author = F.trim(meta("author"))
    authored = f.where(author != "").select("node_key", author.alias("author"))
    refs = f.select("node_key", F.transform(F.slice("outbound_refs", 1, CITED), lambda r: F.concat(r.kind, F.lit(":"), r.value)).alias("refs"))
    cites = derive.listed(refs, "refs", "ref:", "CITES", CITED)
    nodes = [
        f.select("node_key", F.lit("document").alias("kind"), "subtype", "path", F.coalesce(titled, stem(F.col("path"))).alias("title"), F.col("text").alias("body"), F.when(titled.isNotNull(), "declared").otherwise("verbatim").alias("title_method")),
        _sections(f, []),
        authored.select(_key("author:", F.col("author")).alias("node_key"), F.lit("author").alias("kind"), F.col("author").alias("title")),
        cites.select(F.col("dst_key").alias("node_key"), F.lit("reference").alias("kind"), F.regexp_extract("dst_key", "^ref:([a-z]+):", 1).alias("subtype"), F.regexp_replace("dst_key", "^ref:[a-z]+:", "").alias("title")),
    ]
    token = F.regexp_extract_all("text", F.lit("(?U)" + documents.FILEREF.pattern), F.lit(1))
    known = F.filter(F.array_distinct(token), lambda t: F.lower(F.concat(F.lit("."), F.element_at(F.split(t, r"\."), -1))).isin(*sorted(extensions)) & (F.length(stem(t)) >= 2))
    mentions = f.select("node_key", F.explode(F.slice(known, 1, FILE_REFS)).alias("token"))
    edges = [
        derive.contains(f), authored.select(F.col("node_key").alias("src_key"), _key("author:", F.col("author")).alias("dst_key"), F.lit("AUTHORED_BY").alias("rel"), F.lit("exact").alias("method")),
        cites, derive.same_author(authored), derive.first_existing(derive.mention_candidates(mentions, root), f.select("node_key")),
    ]
    return Parts(_union(nodes), _union(edges), {"status": f.groupBy("doctype", "status").count()})


def image_parts(spark: SparkSession, named: DataFrame, as_of: str, roots: tuple[str, ...]) -> Parts:
    """M2 from (path, size, mtime) with the fields of their names, read once for all that derives from them; no image is opened."""
    f = _file_ids(named.withColumn("collection", filenames.collection(F.col("path"), roots)))
    body = F.concat_ws(" ", basename(F.col("path")), "stem", basename(dirname(F.col("path"))))
    series = derive.series_members(f)
    kinds = {"collection": "IN_COLLECTION", "date": "NAMED_DATE", "resolution": "SAME_RESOLUTION"}
    named = {c: f.where(F.col(c).isNotNull()).select("node_key", F.col(c).alias("v")) for c in kinds}
    nodes = [f.select("node_key", F.lit("image").alias("kind"), F.lit("image").alias("subtype"), "path", F.col("stem").alias("title"), body.alias("body"), "size", "mtime", F.lit("verbatim").alias("title_method"))]
    nodes += [df.select(_key(f"{c}:", F.col("v")).alias("node_key"), F.lit("datebucket" if c == "date" else c).alias("kind"), F.col("v").alias("title")) for c, df in named.items()]
    nodes.append(series.select(F.col("dst_key").alias("node_key"), F.lit("series").alias("kind"), F.substring("dst_key", 8, 1 << 30).alias("title")))
    edges = [df.select(F.col("node_key").alias("src_key"), _key(f"{c}:", F.col("v")).alias("dst_key"), F.lit(kinds[c]).alias("rel"), F.lit("exact").alias("method")) for c, df in named.items()]
    return Parts(_union(nodes), _union([*edges, series, derive.likely_copies(f)]), {})


def misc_parts(spark: SparkSession, stats: DataFrame, contents: DataFrame, as_of: str, root: str) -> Parts:
    """M4 from (path, size, mtime) and (path, content). Warm files are nodes; cold ones are counted by app and month."""
    kinds = contents.select("path", files.sniffed(F.col("content"), F.col("path")).alias("s"))
    large = F.col("size") > files.LARGE
    kind = lambda field, big, else_: F.when(large, big).otherwise(F.coalesce(f"s.{field}", F.lit(else_))).alias(field)
    f = stats.join(kinds, "path", "left").select("path", "size", "mtime", kind("subtype", "binary", "unknown"), kind("detected", "large", "unreadable"), files.owning_app(F.col("path"), root).alias("app"))
    warm, cold = cold_rollup(f, as_of)
    warm_contents = contents.join(warm.select("path"), "path", "left_semi")
    w = _file_ids(warm.join(archives.schemas(warm_contents), "path", "left"))
    listed_tables = F.concat(F.lit(" | tables: "), F.array_join(F.slice("tables", 1, SHOWN_TABLES), ", "))
    body = F.concat(basename(F.col("path")), F.when(F.size("tables") > 0, listed_tables).otherwise(""))
    listing = archives.listed(warm_contents)
    held = archives.archive_edges(listing)
    rollup = cold.withColumn("node_key", F.concat(F.lit("rollup:"), "app", F.lit(":"), "month"))
    nodes = [
        w.select("node_key", F.lit("file").alias("kind"), "subtype", "path", basename(F.col("path")).alias("title"), body.alias("body"), "size", "mtime", F.lit("verbatim").alias("title_method")),
        f.select(_key("app:", F.col("app")).alias("node_key"), F.lit("app").alias("kind"), F.col("app").alias("title")),
        w.select(_key("format:", F.col("detected")).alias("node_key"), F.lit("format").alias("kind"), F.col("detected").alias("title")),
        rollup.select("node_key", F.lit("rollup").alias("kind"), F.col("detected").alias("subtype"), F.concat_ws(" ", "files", F.lit("files,"), "bytes", F.lit("bytes")).alias("title"), F.col("bytes").alias("size")),
        held.select(F.col("dst_key").alias("node_key"), F.lit("archive_entry").alias("kind"), F.regexp_extract("dst_key", "!(.*)$", 1).alias("title")),
    ]
    to = lambda df, prefix, c, rel: df.select(F.col("node_key").alias("src_key"), _key(prefix, F.col(c)).alias("dst_key"), F.lit(rel).alias("rel"), F.lit("exact").alias("method"))
    edges = [to(w, "app:", "app", "BELONGS_TO_APP"), to(rollup, "app:", "app", "BELONGS_TO_APP"), to(w, "format:", "detected", "SAME_FORMAT"), held]
    return Parts(_union(nodes), _union(edges), {"unlistable": listing.where("entries is null"), "rolled_up": cold})


def built(spark: SparkSession, parts: Parts, as_of: str, model: str, fingerprint: str | None = None) -> Store:
    """A store of one state, observed on its day."""
    nodes = as_nodes(parts.nodes, as_of).withColumn("datelist_anchor", F.when(F.col("path").isNotNull(), F.lit(as_of)))
    seen = nodes.where("node_key = path").select(F.col("id").alias("node_id"), F.lit(as_of).alias("seen_date"), "content_hash", "size")
    nodes = temporal.refreshed(nodes, seen, as_of, only_anchored=True)
    meta = {"datelist_anchor": as_of} | ({"config_fingerprint": fingerprint} if fingerprint else {})
    return Store.empty(spark, model).having(metadata=meta, nodes=nodes, edges=as_edges(parts.edges, nodes, as_of), observations=seen)


def updated(old: Store, parts: Parts, current: DataFrame, as_of: str, fingerprint: str | None = None) -> Store:
    """The store after another look at its files: equal, as sets of nodes and edges, to a new build of that state.

    parts: what all current files give; current: (path, size, mtime, content_hash) of them. Edges are derived over everything,
    so no neighbour of a change can be missed; the history of what stays is kept.
    """
    model = old.metadata.get("model", "")
    if model == "m4":
        raise CannotUpdate("counts of cold files have no difference by file; build anew")
    if old.nodes.limit(1).isEmpty():
        raise NotBuilt("an empty store is built, not updated")
    if fingerprint and old.metadata.get("config_fingerprint", fingerprint) != fingerprint:
        raise ConfigChanged("the roots or roles have changed since the store was built")
    changes = state.differences(old.nodes.where("node_key = path").select("path", "size", F.coalesce("mtime", F.lit(0.0)).alias("mtime"), "content_hash"), current)
    fresh = as_nodes(parts.nodes, as_of).withColumn("datelist_anchor", F.when(F.col("path").isNotNull(), F.lit(as_of)))
    first = old.nodes.select("node_key", F.col("first_seen").alias("__f"))
    nodes = fresh.join(first, "node_key", "left").withColumn("first_seen", F.coalesce("__f", "first_seen")).drop("__f").select(*old.nodes.columns)
    rebuilt = nodes.join(changes.where("change in ('added', 'changed')").select("path"), "path", "left_semi").select("id")
    derived = as_edges(parts.edges, nodes, as_of)
    kept = old.edges.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi")
    held = kept.join(derived.select("src", "dst", "rel"), ["src", "dst", "rel"], "left_semi")
    edges = state.updated_edges(held, derived, rebuilt, as_of)
    new = nodes.where("node_key = path").select(F.col("id").alias("node_id"), F.lit(as_of).alias("seen_date"), "content_hash", "size", F.lit(0).alias("seq"))
    seen = temporal.recorded(old.observations, new).join(nodes.select(F.col("id").alias("node_id")), "node_id", "left_semi")
    seen, monthly = temporal.retained(seen, old.observations_monthly, as_of)
    nodes, edges = pruned(temporal.refreshed(nodes, seen, as_of, only_anchored=True), edges)
    vectors = old.embeddings.join(nodes.select(F.col("id").alias("node_id")), "node_id", "left_semi").join(rebuilt.select(F.col("id").alias("node_id")), "node_id", "left_anti")
    return old.having(metadata={"datelist_anchor": as_of}, nodes=nodes, edges=edges.withColumn("id", F.xxhash64("src", "dst", "rel")), observations=seen, observations_monthly=monthly, embeddings=vectors)


def months(stats: DataFrame) -> DataFrame:
    """(month, n) of modification times."""
    return stats.groupBy(month(F.to_date(F.timestamp_seconds("mtime"))).alias("month")).agg(F.count("*").alias("n"))
