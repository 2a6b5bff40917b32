"""Directory scans and what can be said of a file without reading it whole."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import extension
from ..plans.classifier import Classifier

HEADER = 512
#: Bytes from which a file is known by its metadata only; its content is never read.
LARGE = 100 << 20
# Leading bytes (hex), kind and type, in order of test.
MAGIC = (
    ("53514C69746520666F726D6174203300", "database", "sqlite"), ("7F454C46", "binary", "elf"), ("504B0304", "archive", "zip"),
    ("1F8B", "archive", "gzip"), ("425A68", "archive", "bzip2"), ("FD377A585A00", "archive", "xz"), ("377ABCAF271C", "archive", "7z"),
    ("25504446", "document", "pdf"), ("89504E47", "media", "png"), ("FFD8FF", "media", "jpeg"), ("47494638", "media", "gif"),
    ("52494646", "media", "riff"), ("4F676753", "media", "ogg"), ("494433", "media", "mp3"), ("0001000000", "media", "truetype"),
    ("4F54544F", "media", "opentype"), ("774F4646", "media", "woff"), ("CAFEBABE", "binary", "java-class"), ("213C617263683E", "archive", "ar"),
)
HINTS = {
    "json": ("config", "json"), "jsonl": ("log", "jsonl"), "yaml": ("config", "yaml"), "yml": ("config", "yaml"), "toml": ("config", "toml"),
    "ini": ("config", "ini"), "conf": ("config", "conf"), "cfg": ("config", "conf"), "proto": ("config", "protobuf"), "log": ("log", "log"),
    "txt": ("text", "text"), "csv": ("text", "csv"), "html": ("text", "html"), "css": ("text", "css"), "db": ("database", "sqlite"),
    "sqlite": ("database", "sqlite"), "sqlite3": ("database", "sqlite"),
}


def stats(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """(path, size, mtime) of all files below `root`. The scan's content column is pruned, so no file is opened."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    reader = reader.option("pathGlobFilter", glob) if glob else reader
    files = reader.load(root).select("path", "length", "modificationTime")
    return files.select(plain(F.col("path")).alias("path"), F.col("length").alias("size"), F.col("modificationTime").cast("double").alias("mtime"))


def plain(path: Column) -> Column:
    return F.regexp_replace(path, "^file:(//)?(?=/)", "")


def walk(spark: SparkSession, root: str) -> DataFrame:
    """(path, is_symlink) of a local tree, links to directories shown and not entered. The listing is the driver's; Spark's own scan follows links."""
    rows = []
    for at, dirs, files in os.walk(root):
        links = [d for d in dirs if os.path.islink(os.path.join(at, d))]
        dirs[:] = sorted(set(dirs) - set(links))
        rows += [(os.path.join(at, f), os.path.islink(os.path.join(at, f))) for f in sorted(files)] + [(os.path.join(at, d), True) for d in links]
    return spark.createDataFrame(rows, "path string, is_symlink boolean")


def hashed(spark: SparkSession, paths: DataFrame, root: str) -> DataFrame:
    """(path, content_hash) of those of `paths` that can be read; only they are read."""
    content = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").load(root)
    return content.withColumn("path", plain(F.col("path"))).join(paths.select("path"), "path", "left_semi").select("path", F.sha2("content", 256).alias("content_hash"))


def corpus(spark: SparkSession, root: str, label: str, classifier: Classifier) -> tuple[DataFrame, DataFrame]:
    """Paths of one label, and all decisions."""
    decided = classifier.classify(walk(spark, root))
    return decided.where(F.col("label") == label).select("path"), decided


def code_inventory(spark: SparkSession, root: str, classifier: Classifier, asked: bool) -> DataFrame | None:
    """Code paths; None, not an empty frame, where nobody asked."""
    return corpus(spark, root, "code", classifier)[0] if asked else None


def sniffed(content: Column, path: Column) -> Column:
    """struct(subtype, detected) from the first bytes, else from the extension, else from how much of them is printable."""

    def out(subtype: str, detected: str) -> Column:
        return F.struct(F.lit(subtype).alias("subtype"), F.lit(detected).alias("detected"))

    head = F.substring(content, 1, HEADER)
    hexed, ext = F.hex(head), extension(path)
    odd = F.length(F.regexp_replace(F.decode(head, "ISO-8859-1"), r"[\x20-\x7E\t\n\r]", ""))
    case = F.when(content.isNull(), out("unknown", "unreadable"))
    for magic, subtype, detected in MAGIC:
        case = case.when(hexed.startswith(magic), out(subtype, detected))
    for e, (subtype, detected) in HINTS.items():
        case = case.when(ext == e, out(subtype, detected))
    case = case.when(F.length(head) == 0, out("unknown", "empty"))
    return case.when((F.length(head) - odd) / F.length(head) > 0.9, out("text", "text")).otherwise(out("binary", "unknown"))


def owning_app(path: Column, root: str) -> Column:
    """The application whose folder below the root holds a path; `home` for files at its top."""
    inside = F.substring(path, len(root.rstrip("/")) + 2, 1 << 30)
    lib, hidden, plain_dir = (F.regexp_extract(inside, p, 1) for p in (r"^\.local/lib/([^/]+)/", r"^\.([a-zA-Z0-9_-]+)/", r"^([a-zA-Z0-9_-]+)/"))
    return F.when(~path.startswith(root.rstrip("/") + "/"), "home").when(lib != "", lib).when(hidden != "", hidden).when(plain_dir != "", plain_dir).otherwise("home")
