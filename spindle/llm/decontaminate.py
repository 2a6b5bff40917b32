"""Benchmark decontamination by size-partitioned MinHash containment search, in DataFrame operations only.

Items are partitioned by their number of distinct shingles n, by powers of two. An item of which a document
holds the share t or more has ceil(t * n) shingles in common with it, so among any n - ceil(t * n) + 1 of
its shingles one is shared. A partition's sketch is the bottom-k MinHash of its items, where k is that
number for the largest size of the partition: about a fifth of the shingles. No contained item is missed,
however long the document.

Three steps, of which each passes on only what the one before found:

1. search: a document's shingle hashes are probed against the sketches alone. What meets is a candidate pair.
2. fetch: only documents of candidate pairs are cut into shingles again.
3. verify: their shingles, compared as text, are counted against the whole shingle sets of their candidate items.

Items of fewer words than a shingle are one shingle of all their words and are met by windows of that many words.

Sketches and item shingles go to every executor while their counted size is below BROADCAST_BYTES; beyond that
both sides are shuffled by hash. Texts are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import row_key, table, unused, words, written

SHINGLE, CONTAINMENT, BROADCAST_BYTES = 5, 0.8, 64 << 20
_LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _window(m: int) -> list[Column]:
    return [F.get("w", F.col("p") + i) for i in range(m)]


def _windows(df: DataFrame, m: int) -> DataFrame:
    """A row for each window of m words of `w`, with its place p and its 64-bit hash h."""
    each = df.where(F.size("w") >= m).withColumn("p", F.explode(F.sequence(F.lit(0), F.size("w") - m)))
    return each.withColumn("h", F.xxhash64(F.lit(m), *_window(m)))


def _shingles(df: DataFrame, m: int) -> DataFrame:
    return _windows(df, m).withColumn("s", F.concat_ws(" ", *_window(m)))


def _lowered(df: DataFrame, id_col: str, text_col: str, as_id: str) -> DataFrame:
    return df.select(F.col(id_col).alias(as_id), words(F.translate(F.col(text_col).cast("string"), *_LOWER)).alias("w"))


def item_shingles(items: DataFrame, item_id: str = "item_id", item_text: str = "text", k: int = SHINGLE) -> tuple[DataFrame, list[int]]:
    """(item_id, m, h, s), distinct: the shingles of each item, of m words; and the numbers of words m < k that occur."""
    every = _lowered(items, item_id, item_text, "item_id").where("item_id is not null")
    sets = _shingles(every, k).select("item_id", F.lit(k).alias("m"), "h", "s")
    for m in range(1, k):
        sets = sets.union(_shingles(every.where(F.size("w") == m), m).select("item_id", F.lit(m).alias("m"), "h", "s"))
    sets = written(sets.distinct(), "item-shingles")
    return sets, sorted(r["m"] for r in sets.where(F.col("m") < k).select("m").distinct().collect())  # under k values


def sketches(sets: DataFrame, least: float = CONTAINMENT) -> DataFrame:
    """(item_id, part, m, h): the bottom-k of each item's hashes; part is the power of two of its size, and sets k."""
    sizes = sets.groupBy("item_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("h", "m"))).alias("hs"))
    part = F.floor(F.log2(F.col("n"))).cast("int")
    largest = F.pow(F.lit(2), part + 1) - 1
    bottom = (largest - F.ceil(largest * F.lit(least) - 1e-9) + 1).cast("int")
    return sizes.select("item_id", part.alias("part"), F.explode(F.slice("hs", 1, bottom)).alias("x")).select("item_id", "part", "x.m", "x.h")


def _small(df: DataFrame, *wide: str) -> DataFrame:
    """`df`, written before, with a broadcast hint if its rows and the bytes of its `wide` columns, counted, are within BROADCAST_BYTES."""
    size = F.lit(80) + sum((F.octet_length(F.col(c).cast("string")) for c in wide), F.lit(0))
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES else df


def contained_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = SHINGLE, least: float = CONTAINMENT) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_shared): the items of which a document holds `least` of the distinct shingles or more.

    Words are compared with A-Z lower-cased. Null and wordless texts on either side match nothing; rows
    with a null id give none; repeated rows of one id count as one document (or item) with the shingles of all;
    an item at exactly `least` counts; empty tables give an empty one; other columns are not read.
    """
    sets, short = item_shingles(items, item_id, item_text, k)
    probe = _small(written(sketches(sets, least).select(F.col("item_id").alias("item"), F.col("m").alias("im"), F.col("h").alias("ih")), "sketches"), "item")
    texts = _lowered(docs, id_col, text_col, "doc_id").where("doc_id is not null")
    met = None
    for m in [k, *short]:
        found = _windows(texts, m).select("doc_id", "h").join(probe.where(F.col("im") == m), F.col("h") == F.col("ih")).select("doc_id", "item")
        met = found if met is None else met.union(found)
    candidates = _small(written(met.distinct(), "candidates"), "doc_id", "item")
    chosen = candidates.select(F.col("doc_id").alias("chosen"))
    again = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(chosen, F.col("doc_id") == F.col("chosen"), "left_semi")
    again = _lowered(again, "doc_id", "text", "doc_id")  # only now are texts cut into words
    side = _small(sets, "s", "item_id").select("item_id", "m", F.col("h").alias("ih"), F.col("s").alias("is"))
    hits = None
    for m in [k, *short]:
        seen = _shingles(again, m).join(side.where(F.col("m") == m), (F.col("h") == F.col("ih")) & (F.col("s") == F.col("is"))).select("doc_id", "item_id", "s")
        hits = seen if hits is None else hits.union(seen)
    # Only candidate pairs are counted; an item's shingles bound the rows of a pair once repeats within a document are put together.
    own = candidates.withColumnRenamed("doc_id", "d")
    hits = hits.join(own, (F.col("doc_id") == F.col("d")) & (F.col("item_id") == F.col("item")), "left_semi")
    shared = hits.groupBy("doc_id", "item_id").agg(F.count_distinct("s").alias("n_shared"))
    sizes = sets.groupBy("item_id").agg(F.count("*").alias("n_shingles"))
    return shared.join(sizes, "item_id").where(F.col("n_shared") >= F.col("n_shingles") * F.lit(least) - 1e-9).select("doc_id", "item_id", "n_shingles", "n_shared")


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of `docs` that hold no item; each row is judged by its own text, also where ids repeat. Rows with null ids or texts stay, columns as they are."""
    key = unused(docs, "__key")
    own = F.when(F.col(id_col).isNotNull(), row_key(id_col, text_col))
    bad = contained_items(docs.select(own.alias("doc_id"), F.col(text_col).alias("text")), items, **how)
    bad = written(bad.select(F.col("doc_id").alias(key)).distinct(), "contaminated")
    return docs.join(_small(bad, key), own == F.col(key), "left_anti")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_SQL_WORDS = """select {id}, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from {table}"""
_SQL_WINDOWS = "select distinct {id}, m, s from (select {id}, m, array_to_string(w[p:p + m - 1], ' ') as s from (select {id}, w, m, unnest(range(1, len(w) - m + 2)) as p from {table} where len(w) >= m))"
QUERIES = {"op3_decontaminate": op3_decontaminate}
#: An item has windows of five words, or one of all its words if there are fewer; a document has the windows of each such length.
SQL = {
    "op3_decontaminate": f"""
with bw as (select item_id, w, least(5, len(w)) as m from ({_SQL_WORDS.format(id="item_id", table="benchmark")}) where len(w) > 0),
dw as (select doc_id, w, m from ({_SQL_WORDS.format(id="doc_id", table="documents")}), (select distinct m from bw)),
b as ({_SQL_WINDOWS.format(id="item_id", table="bw")}),
d as ({_SQL_WINDOWS.format(id="doc_id", table="dw")}),
n as (select item_id, count(*) as n_shingles from b group by item_id)
select d.doc_id, b.item_id, n.n_shingles, count(*) as n_shared
from d join b on d.m = b.m and d.s = b.s join n on b.item_id = n.item_id
group by d.doc_id, b.item_id, n.n_shingles having count(*) >= 0.8 * n.n_shingles - 1e-9"""
}
