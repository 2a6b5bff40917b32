"""Listings of archives and of database files. Members and rows are never read."""

from __future__ import annotations

import io
import sqlite3
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import extension

ENTRIES, LARGEST, TABLES = 200, 512 << 20, 200
DECLINED = ("xpi",)  # listed by no one: an extension's members are not documents


def members(content: bytes | None) -> list[str] | None:
    """Member names of a zip in the order of its directory; None if it can't be listed, [] if it is empty."""
    if content is None or len(content) > LARGEST:
        return None
    try:
        return zipfile.ZipFile(io.BytesIO(content)).namelist()
    except Exception:  # noqa: BLE001  whatever a broken directory raises, it can't be listed
        return None


def top_level(names: Column, limit: int = ENTRIES) -> Column:
    """Distinct first components of member names, in order, folders with a slash."""
    heads = F.transform(names, lambda n: F.regexp_extract(n, "^/*([^/]+/?)", 1))
    return F.slice(F.filter(F.array_distinct(heads), lambda h: h != ""), 1, limit)


def tables(content: bytes | None) -> list[str]:
    """Table names of an SQLite file's bytes; [] if it can't be read."""
    if not content:
        return []
    db = sqlite3.connect(":memory:")
    try:
        db.deserialize(content)
        return [r[0] for r in db.execute(f"select name from sqlite_master where type = 'table' order by name limit {TABLES}")]
    except sqlite3.Error:
        return []
    finally:
        db.close()


def listed(files: DataFrame) -> DataFrame:
    """files: (path, content) -> (path, entries array or null) of zip archives whose listing isn't declined."""
    names = F.pandas_udf(lambda c: pd.Series([members(bytes(x) if x is not None else None) for x in c]), "array<string>")
    own = files.where(F.hex(F.substring("content", 1, 4)) == "504B0304").where(~extension(F.col("path")).isin(*DECLINED))
    return own.select("path", names("content").alias("names")).select("path", top_level(F.col("names")).alias("entries"))


def schemas(files: DataFrame) -> DataFrame:
    """files: (path, content) -> (path, tables) of SQLite files: names only, never a row."""
    names = F.pandas_udf(lambda c: pd.Series([tables(bytes(x) if x is not None else None) for x in c]), "array<string>")
    own = files.where(F.hex(F.substring("content", 1, 16)) == "53514C69746520666F726D6174203300")
    return own.select("path", names("content").alias("tables"))


def archive_edges(listings: DataFrame) -> DataFrame:
    each = listings.select("path", F.explode("entries").alias("e"))
    return each.select(F.col("path").alias("src_key"), F.concat(F.lit("archive:"), "path", F.lit("!"), "e").alias("dst_key"), F.lit("ARCHIVE_CONTAINS").alias("rel"), F.lit("exact").alias("method"))
