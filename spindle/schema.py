"""Schemas of a store's tables and the closed vocabularies they use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import UnknownMethod

# Confidence follows from the method of an edge or of a title.
EDGE_METHODS = {"exact": 1.0, "path_prefix": 0.7, "basename": 0.6, "mention": 0.5, "co-change": 0.45, "cohort": 0.4}
TITLE_METHODS = {"declared": 1.0, "verbatim": 1.0, "inferred": 0.5}
MODELS = {"m1": "documents", "m2": "images", "m3": "markdown", "m4": "misc"}
HIDDEN_SUBTYPES = ("transcript",)
FILE_KINDS = ("file", "document", "image", "code")
LINKING_RELS = ("WIKILINKS_TO", "LINKS_TO", "MENTIONS_PATH")
SCHEMA_VERSION = 4


_TYPES = {
    "bigint": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "double": T.DoubleType(), "boolean": T.BooleanType(),
    "array<string>": T.ArrayType(T.StringType()), "array<float>": T.ArrayType(T.FloatType()),
}


def _struct(spec: str) -> T.StructType:
    """A schema from `name type [not null], ...`; works without a session."""
    fields = [f.split(" ", 2) for f in spec.split(", ")]
    return T.StructType([T.StructField(f[0], _TYPES[f[1]], len(f) < 3) for f in fields])


NODES = _struct(
    "id bigint not null, node_key string not null, kind string not null, subtype string, path string, title string, body string, size bigint, mtime double, "
    "content_hash string, first_seen string not null, last_seen string not null, activity_datelist array<string>, datelist_int bigint, datelist_anchor string, "
    "title_method string, title_confidence double, heading_path array<string>, section_leaf boolean"
)
EDGES = _struct("id bigint, src bigint not null, dst bigint not null, rel string not null, first_seen string not null, last_seen string not null, method string not null, confidence double not null")
OBSERVATIONS = _struct("node_id bigint not null, seen_date string not null, content_hash string, size bigint")
MONTHLY = _struct("node_id bigint not null, month string not null, change_days int, last_hash string, max_size bigint")
EMBEDDINGS = _struct("node_id bigint not null, provider string not null, model string not null, dim int not null, vec array<float>")
TABLES = {"nodes": NODES, "edges": EDGES, "observations": OBSERVATIONS, "observations_monthly": MONTHLY, "embeddings": EMBEDDINGS}


def node_id(key: Column) -> Column:
    """A node's id follows from its key, so that rebuilding gives the same ids."""
    return F.xxhash64(key)


def edge_id(src: Column, dst: Column, rel: Column) -> Column:
    return F.xxhash64(src, dst, rel)


def _looked_up(value: Column, table: dict[str, float], what: str) -> Column:
    found = None
    for name, confidence in table.items():
        found = F.when(value == name, F.lit(confidence)) if found is None else found.when(value == name, F.lit(confidence))
    return found.otherwise(F.raise_error(F.concat(F.lit(f"unknown {what} method: "), F.coalesce(value, F.lit("null")))).cast("double"))


def edge_confidence(method: Column) -> Column:
    """Confidence is looked up from the method, never passed; an unknown method fails the query."""
    return _looked_up(method, EDGE_METHODS, "edge")


def title_confidence(method: Column) -> Column:
    """As edge_confidence; null (not recorded) stays null."""
    return F.when(method.isNotNull(), _looked_up(method, TITLE_METHODS, "title"))


def check_method(method: str, table: dict[str, float] = EDGE_METHODS) -> float:
    if method not in table:
        raise UnknownMethod(f"unknown method {method!r}; known: {', '.join(table)}")
    return table[method]
