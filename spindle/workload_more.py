"""More named queries: mentions, links, members, updates, lookups and searches, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import paths, vectors
from .operators import derive, graph, reports, search, state, temporal
from .workload import SQL, ANCHOR, D, G, O, _MASK, _STEP, _bm25_sql, _iso, _single, d_index, d_nodes, g_edges, g_nodes, o_table, query, table


# ---- derivation -----------------------------------------------------------------------------------------------------


@query("select distinct 'm1::' || d.doc_id as src_key, b.text as dst_key, 'MENTIONS_FILE' as rel, 'mention' as method from documents d join benchmark b on contains(d.text, b.text) where length(d.text) > 20 and b.text <> ''")
def mentions_file(spark, d):
    none = F.lit(None).cast("string")
    docs = table(spark, d, "documents").select(F.concat(F.lit("m1::"), "doc_id").alias("node_key"), F.lit("m1").alias("model"), F.lit("document").alias("kind"), none.alias("path"), F.col("text").alias("body"))
    files = table(spark, d, "benchmark").select(F.col("text").alias("node_key"), F.lit("m4").alias("model"), F.lit("file").alias("kind"), F.col("text").alias("path"), none.alias("body"))
    return derive.mentions_file(docs.unionByName(files))


_CRM = "'/crm/customers/' || c_custkey || '.md'"


@query(f"select {_CRM} as src_key, '/crm/nations/' || c_nationkey || '.md' as dst_key, 'REFERENCES_FILE' as rel, 'mention' as method from customer where c_nationkey % 3 <> 0 union all "
       f"select {_CRM}, '/home/nations/' || c_nationkey || '.md', 'REFERENCES_FILE', 'mention' from customer where c_nationkey % 3 = 0 and c_nationkey % 2 = 0")  # fmt: skip
def references_file(spark, d):
    """A mention is looked for beside the file first, then below the root; what is in neither place gives no edge."""
    c = table(spark, d, "customer").select(F.concat(F.lit("/crm/customers/"), "c_custkey", F.lit(".md")).alias("node_key"), F.concat(F.lit("../nations/"), "c_nationkey", F.lit(".md")).alias("token"))
    mentions = derive.mention_candidates(c.withColumn("token", F.when(F.regexp_extract("token", r"(\d+)", 1).cast("int") % 3 == 0, F.regexp_replace("token", r"^\.\./", "")).otherwise(F.col("token"))), "/home")
    n = table(spark, d, "nation")
    beside, below = n.select(F.concat(F.lit("/crm/nations/"), "n_nationkey", F.lit(".md")).alias("node_key")), n.where("n_nationkey % 2 = 0").select(F.concat(F.lit("/home/nations/"), "n_nationkey", F.lit(".md")).alias("node_key"))
    return derive.first_existing(mentions, beside.union(below))


def _relative(spark, d):
    links = table(spark, d, "customer").select(F.concat(F.lit("/crm/"), "c_mktsegment", F.lit("/"), "c_custkey", F.lit(".md")).alias("node_key"), F.concat(F.lit("../nations/./"), "c_nationkey", F.lit(".md#about?x")).alias("target"))
    key = F.concat(F.lit("/crm/nations/"), "n_nationkey", F.lit(".md"))
    return derive.resolved_links(links, table(spark, d, "nation").where("n_regionkey < 3").select(key.alias("node_key"), key.alias("path")), "LINKS_TO")


_OWN = "'/crm/' || c_mktsegment || '/' || c_custkey || '.md'"


@query(f"select {_OWN} as src_key, '/crm/nations/' || c_nationkey || '.md' as dst_key, 'LINKS_TO' as rel, 'exact' as method from customer join nation on c_nationkey = n_nationkey where n_regionkey < 3")
def relative_links(spark, d):
    return _relative(spark, d)[0]


@query(f"select {_OWN} as node_key, '../nations/./' || c_nationkey || '.md#about?x' as target from customer join nation on c_nationkey = n_nationkey where n_regionkey >= 3")
def relative_links_to_nowhere(spark, d):
    return _relative(spark, d)[1]


@query("with p as (select p_brand, p_type, p_partkey from part where p_partkey % 3 <> 0), n as (select p_brand, p_type from p group by all having count(*) > 1) "
       "select '/p/' || p_partkey as src_key, 'series:' || p_brand || '/' || p_type as dst_key, 'SERIES_MEMBER' as rel, 'exact' as method from p join n using (p_brand, p_type)")  # fmt: skip
def series_member(spark, d):
    indices = F.when(F.col("p_partkey") % 3 != 0, F.array(F.col("p_partkey").cast("int"))).otherwise(F.array().cast("array<int>"))
    return derive.series_members(table(spark, d, "part").select(F.concat(F.lit("/p/"), "p_partkey").alias("path"), F.col("p_brand").alias("collection"), F.col("p_type").alias("series_stem"), indices.alias("indices")))


@query("with i as (select '/i/' || lpad(p_partkey::varchar, 8, '0') || '/' as dir, 'x' || (p_partkey // 8) as stem, p_partkey % 2 = 0 as copy from part), "
       "f as (select dir || stem || case when copy then '_copy.png' else '.png' end as path, stem || case when copy then '_copy.png' else '.png' end as base, stem, copy from i), "
       "c as (select path, lead(path) over (partition by base order by path) as nxt from f) "
       "select path as src_key, nxt as dst_key, 'LIKELY_COPY' as rel, 'basename' as method from c where nxt is not null union "
       "select a.path, b.path, 'LIKELY_COPY', 'basename' from f a join f b on a.stem = b.stem where not a.copy and b.copy")  # fmt: skip
def likely_copies(spark, d):
    copy, stem = F.col("p_partkey") % 2 == 0, F.concat(F.lit("x"), F.expr("p_partkey div 8"))
    marked = F.concat(stem, F.when(copy, "_copy").otherwise(""))
    return derive.likely_copies(table(spark, d, "part").select(F.concat(F.lit("/i/"), F.lpad(F.col("p_partkey").cast("string"), 8, "0"), F.lit("/"), marked, F.lit(".png")).alias("path"), marked.alias("stem"), copy.alias("copy")))


@query("select 'order:' || l_orderkey as src_key, 'order:' || l_orderkey || '#' || (row_number() over (partition by l_orderkey) - 1) as dst_key, 'CONTAINS' as rel, 'exact' as method from lineitem")
def contains_sections(spark, d):
    return derive.contains(table(spark, d, "lineitem").groupBy(F.concat(F.lit("order:"), "l_orderkey").alias("node_key")).agg(F.collect_list("l_linenumber").alias("sections")))


@query("with w as (select p_partkey, unnest(string_split(p_type || ' ' || p_brand || ' ' || p_type, ' ')) as v, unnest(range(100)) as i from part), "
       "u as (select p_partkey, v, min(i) as i from w where v <> '' group by all), r as (select *, row_number() over (partition by p_partkey order by i) as k from u) "
       "select 'part:' || p_partkey as src_key, 'tag:' || v as dst_key, 'TAGGED' as rel, 'exact' as method from r where k <= 3")  # fmt: skip
def tagged_first_three(spark, d):
    return derive.listed(table(spark, d, "part").select(F.concat(F.lit("part:"), "p_partkey").alias("node_key"), F.split(F.concat_ws(" ", "p_type", "p_brand", "p_type"), " ").alias("v")), "v", "tag:", "TAGGED", limit=3)


@query("select distinct 'p' || l_partkey as src_key, 'category:' || o_orderpriority as dst_key, 'CATEGORIZED_UNDER' as rel, 'exact' as method from lineitem join orders on o_orderkey = l_orderkey")
def categorised_under(spark, d):
    o, lines = table(spark, d, "orders"), table(spark, d, "lineitem")
    headings = o.select(F.col("o_orderkey").alias("group"), F.lit(0).alias("at"), F.col("o_orderpriority").alias("title"))
    return derive.categorised(lines.select(F.col("l_orderkey").alias("group"), F.col("l_linenumber").cast("int").alias("at"), F.concat(F.lit("p"), "l_partkey").alias("page")), headings)


# ---- graph ----------------------------------------------------------------------------------------------------------


@query("select * from (" + SQL["shortest_path"] + ") where dst_key in ('nation:3', 'region:1', 'customer:1', 'order:1', 'nowhere')")
def shortest_path_to(spark, d):
    found = graph.shortest_paths(g_nodes(spark, d), g_edges(spark, d), "supplier:1", ["nation:3", "region:1", "customer:1", "order:1", "nowhere"], 3)
    return found.select("dst_key", "length", F.array_join("path", " > ").alias("path"))


@query(f"with {G.strip()}, {_STEP} select way, rel, b as node_key, confidence < 1 as derived from s where a = 'customer:1'")
def neighbourhood(spark, d):
    return graph.neighbourhood(g_nodes(spark, d), g_edges(spark, d), "customer:1")


@query(f"with {G.strip()} select 2 as depth, 1 as x, e.src as node_key, e.dst as neighbour_key, e.rel from g_edges e where e.src in (select dst from g_edges where src = 'order:1') union all select 1, 1, src, dst, rel from g_edges where src = 'order:1'")
def neighbours_forward(spark, d):
    return graph.neighbours(g_nodes(spark, d), g_edges(spark, d), "order:1", 2, directed=True).select("depth", F.lit(1).alias("x"), "node_key", "neighbour_key", "rel")


@query("select 'order:1' as asked, 'm1::order:1' as found union all select 'm1::order:2', 'm1::order:2' union all select 'order:none', null")
def resolved_keys(spark, d):
    nodes = g_nodes(spark, d).select(F.concat(F.lit("m1::"), "node_key").alias("node_key"))
    return spark.createDataFrame([(k, graph.resolve_key(nodes, k)) for k in ("order:1", "m1::order:2", "order:none")], "asked string, found string")


@query("select 'n' || c_nationkey as title, c_mktsegment as subtype, count(*) as n from customer where c_nationkey % 4 = 0 group by all")
def broken_links_report(spark, d):
    c = table(spark, d, "customer").where("c_nationkey % 4 = 0")
    pages = c.select(F.col("c_custkey").alias("id"), F.lit("file").alias("kind"), F.col("c_mktsegment").alias("subtype"), F.concat(F.lit("c"), "c_custkey").alias("title"))
    stubs = c.select((-1 - F.col("c_nationkey")).cast("long").alias("id"), F.lit("wikilink").alias("kind"), F.lit("broken").alias("subtype"), F.concat(F.lit("n"), "c_nationkey").alias("title")).distinct()
    return graph.broken_report(pages.unionByName(stubs), c.select(F.col("c_custkey").alias("src"), (-1 - F.col("c_nationkey")).cast("long").alias("dst")))


@query(f"with {G.strip()} select (select count(*) from g_nodes) as nodes, (select count(path) from g_nodes) as nodes_with_path, (select count(*) - count(path) from g_nodes) as derived, (select count(distinct subtype) from g_nodes) as labels, "
       "(select count(*) from g_edges) as edges, (select count(*) from g_edges where confidence < 1) as uncertain_edges, (select count(distinct rel) from g_edges) as relations, (select min(first_seen) from g_nodes) as first_seen, (select count(*) from events) as observations")  # fmt: skip
def store_status(spark, d):
    found = reports.status(g_nodes(spark, d), g_edges(spark, d), table(spark, d, "events"), None, 0)
    cols = ("nodes", "nodes_with_path", "derived", "labels", "edges", "uncertain_edges", "relations", "first_seen", "observations")
    return spark.createDataFrame([tuple(found[c] for c in cols)], "nodes long, nodes_with_path long, derived long, labels long, edges long, uncertain_edges long, relations long, first_seen string, observations long")


@query(f"with {G.strip()} select node_key from g_nodes where kind = 'order' and first_seen <= '1995-06-17' and subtype <> 'P'")
def shown_as_of(spark, d):
    nodes = g_nodes(spark, d)
    own = search.shown(nodes.withColumn("subtype", F.when(F.col("subtype") == "P", "transcript").otherwise(F.col("subtype"))), as_of="1995-06-17", kind="order")
    return own.select("node_key")


@query("select c_custkey, starts_with(p, '/crm/BUILDING/') as below, p as lexical from (select c_custkey, '/crm/' || c_mktsegment || '/' || c_custkey as p from customer)")
def paths_under(spark, d):
    p = paths.normalise(F.concat(F.lit("/crm/x/.././"), "c_mktsegment", F.lit("//"), "c_custkey", F.lit("/y/..")))
    return table(spark, d, "customer").select("c_custkey", paths.under(p, "/crm/BUILDING").alias("below"), p.alias("lexical"))


# ---- search ---------------------------------------------------------------------------------------------------------


@query(f"with r as ({_bm25_sql(_single(chr(39) + 'eaux' + chr(39)), '')}) select node_id, score, row_number() over (order by score, node_id) as rank from r order by score, node_id limit 20")
def fts_topk(spark, d):
    return search.full_text(d_index(spark, d), d_nodes(spark, d), "eaux", 20, include_all=True).select("node_id", F.round("score", 9).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"with {D.strip()} select distinct node_id from d_tok where term in ('enes', 'eaux') and node_id in (select doc_id from documents where lang <> 'es' or lang is null)")
def shortlist_candidates(spark, d):
    """A shortlist that is longer than the hits has every node with any of the terms."""
    return search.shortlist(d_index(spark, d), d_nodes(spark, d), "enes eaux", 1_000_000).select("node_id")


@query("select vec_id, array_to_string(list_transform(embedding::double[], lambda x: round(x / (list_max(list_transform(embedding::double[], lambda y: abs(y))) / 127))::bigint), ',') as codes from embeddings")
def quantised_vectors(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.array_join(vectors.quantised(F.col("embedding")).getField("values").cast("array<string>"), ",").alias("codes"))


# ---- time and state -------------------------------------------------------------------------------------------------


@query(f"with {O}, {_MASK}, u as (select distinct user_id as id from events), l as (select node_id, count(distinct seen_date) as days from o group by 1) "
       f"select id, case when id % 2 = 0 then 0 else days end as days, case when id % 2 = 0 then 7 else coalesce(mask, 0) end::bigint as datelist_int, case when id % 2 = 1 then '{ANCHOR}' end as datelist_anchor from u join l on l.node_id = id left join m on m.node_id = id")  # fmt: skip
def refreshed_masks(spark, d):
    """Only nodes that had an anchor get the new one."""
    none = F.lit(None).cast("string")
    users = table(spark, d, "events").select(F.col("user_id").alias("id")).distinct()
    nodes = users.select("id", F.array().cast("array<string>").alias("activity_datelist"), F.lit(7).cast("long").alias("datelist_int"), F.when(F.col("id") % 2 == 1, "2020-01-01").otherwise(none).alias("datelist_anchor"))
    got = temporal.refreshed(nodes, o_table(spark, d), ANCHOR, only_anchored=True)
    return got.select("id", F.size("activity_datelist").cast("long").alias("days"), "datelist_int", "datelist_anchor")


@query("with c as (select c_custkey as k, c_name as t from customer) select 'c' || k as node_key, case when k % 3 = 0 then t else 'new ' || t end as title, case when k % 5 = 0 then '2025-01-01' else '2020-01-01' end as first_seen from c where k % 3 <> 0 or k % 5 <> 0")
def upsert_nodes(spark, d):
    """Old rows of all customers but each fifth, new ones of all but each third."""
    c = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("c"), "c_custkey").alias("node_key"), F.col("c_name").alias("title"))
    old = c.where("c_custkey % 5 <> 0").select("node_key", "title", F.lit("2020-01-01").alias("first_seen"))
    new = c.where("c_custkey % 3 <> 0").select("node_key", F.concat(F.lit("new "), "title").alias("title"), F.lit("2025-01-01").alias("first_seen"))
    return state.merged_nodes(old, new)


@query("with e as (select o_orderkey as id, o_custkey as c, strftime(o_orderdate, '%Y-%m-%d') as seen from orders), m as (select c, max(seen) as l from e group by 1) "
       "select id, case when e.c % 2 = 0 and seen = l then '2030-01-01' else seen end as last_seen from e join m on e.c = m.c")  # fmt: skip
def advanced_edges(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("src"), _iso("o_orderdate").alias("last_seen"))
    return state.advanced(o, o.where("src % 2 = 0").select(F.col("src").alias("id")), "2030-01-01").select("id", "last_seen")


@query("select c_custkey as id, case when c_custkey % 7 = 0 then 'none' when c_nationkey % 3 = 0 then 'unknown' when c_nationkey % 3 = 1 then 'stale' else 'current' end as embedding_status from customer")
def embedding_states(spark, d):
    c = table(spark, d, "customer")
    states = c.select(F.col("c_custkey").alias("id"), F.element_at(F.array(F.lit("missing"), F.lit("stale"), F.lit("current")), (F.col("c_nationkey") % 3 + 1).cast("int")).alias("state"))
    return state.embedding_status(c.select(F.col("c_custkey").alias("id")), states, c.where("c_custkey % 7 <> 0").select(F.col("c_custkey").alias("node_id")))


@query("select o_orderkey as src, o_custkey as dst from orders where o_custkey % 10 <> 0 and o_orderkey % 2 = 1")
def forgotten_edges(spark, d):
    """Edges that are left when the files of each second order and each tenth customer are forgotten."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    key = lambda kind, k: F.concat(F.lit(f"/{kind}/"), F.col(k))
    nodes = o.select(F.concat(F.lit("o"), "o_orderkey").alias("id"), key("o", "o_orderkey").alias("path")).union(c.select(F.concat(F.lit("c"), "c_custkey"), key("c", "c_custkey"))).withColumn("node_key", F.col("path"))
    edges = o.select(F.concat(F.lit("o"), "o_orderkey").alias("src"), F.concat(F.lit("c"), "o_custkey").alias("dst"))
    gone = o.where("o_orderkey % 2 = 0").select(key("o", "o_orderkey").alias("path")).union(c.where("c_custkey % 10 = 0").select(key("c", "c_custkey")))
    left = state.forgotten(nodes, edges, nodes.select(F.col("id").alias("node_id")), gone)[1]
    return left.select(*[F.substring(F.col(x), 2, 20).cast("long").alias(x) for x in ("src", "dst")])


# ---- reports --------------------------------------------------------------------------------------------------------


@query("with f as (select '/' || p_brand as dir, p_type as category, p_size > 10 as counted from part), p as (select dir, category, count(*) as n, count(*) filter (counted) as c from f group by all), "
       "t as (select *, sum(n) over (partition by dir)::bigint as total from p) select dir, category, n, total from t where c >= 1 and n > 0.03 * total")  # fmt: skip
def dominant_roles(spark, d):
    files = table(spark, d, "part").select(F.concat(F.lit("/"), "p_brand").alias("dir"), F.col("p_type").alias("category"), (F.col("p_size") > 10).alias("counted"))
    return reports.dominant_roles(files, 1, 0.03)


@query("select round(count(*) filter (o_orderstatus = 'P') / count(*), 9) as rate from orders")
def extraction_errors(spark, d):
    rate = reports.error_rate(table(spark, d, "orders").select(F.when(F.col("o_orderstatus") == "P", "corrupt").otherwise("ok").alias("status")))
    return spark.createDataFrame([(round(rate, 9),)], "rate double")
