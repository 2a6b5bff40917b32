"""Markdown extraction: front matter, headings as a tree, links, tags, mentions.

A file is one row and is read line by line, in Python in Arrow batches: fences, front matter and headings are matters of lines. What joins files (link resolution, categories) is done in the plan, from the rows that this gives.
"""

from __future__ import annotations

import hashlib
import os
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .files import plain

# The forms that count as a fence, code, heading, link, tag and path.
FENCE = re.compile(r"```+|~~~+")
RULER = "---"
HEADING = re.compile(r"(#{1,6})\s+(.+?)\s*#*\s*")
WIKI = re.compile(r"(!?)\[\[([^\]|#]+?)(?:#[^\]|]*)?(?:\|[^\]]*)?\]\]")
LINK = re.compile(r"(!?)\[[^\]]*\]\(\s*<?([^)\s>]+)>?[^)]*\)")
TAG = re.compile(r"(?:(?<=\s)|\A)#([A-Za-zÆØÅæøå][\w/-]{1,40})")
PATH = r"(?:(?<=\s)|\A|(?<=[`'\"(]))((?:~|{root}|\./|\.\./)[\w./~@+-]*[\w/])"
GENERATED = ("GRAPH_REPORT.md",)
MEMORY = ("/memory/",)
READMES = ("readme.md", "readme.mdx", "readme.markdown")
BREADCRUMB = " > "
REMOTE = ("http://", "https://", "mailto:", "#")

_S, _L = T.StringType(), T.ArrayType(T.StringType())
SECTION = T.StructType(
    [T.StructField("level", T.IntegerType()), T.StructField("title", _S), T.StructField("offset", T.IntegerType()), T.StructField("heading_path", _L), T.StructField("leaf", T.BooleanType()), T.StructField("content_hash", _S)]
)
PLACED = T.StructType([T.StructField("target", _S), T.StructField("offset", T.IntegerType())])
SCHEMA = T.StructType(
    [T.StructField(n, _S) for n in ("path", "name", "subtype", "title", "title_method", "body", "content_hash")]
    + [T.StructField("size", T.LongType()), T.StructField("frontmatter", T.MapType(_S, _S)), T.StructField("problems", _L), T.StructField("sections", T.ArrayType(SECTION))]
    + [T.StructField(n, _L) for n in ("wikilinks", "embeds", "links", "tags", "path_mentions")]
    + [T.StructField("placed_links", T.ArrayType(PLACED))]
)


def _blank(text: str) -> str:
    return "".join(c if c.isspace() else " " for c in text)


def _unfenced(lines: list[str]) -> list[str]:
    """The lines, those of closed fences blank. A fence is closed by a line of nothing but its own mark, as often at least; one that isn't is text."""
    out, i = list(lines), 0
    while i < len(out):
        m = FENCE.match(out[i])
        close = m and next((j for j in range(i + 1, len(out)) if out[j].startswith(m[0]) and not out[j].rstrip().strip(m[0][0])), None)
        if close:
            out[i : close + 1] = map(_blank, out[i : close + 1])
            i = close
        i += 1
    return out


def blanked(text: str) -> str:
    """Fences and inline code as blanks of equal length, so that offsets stay valid and nothing in code is read as markup.

    Inline code runs from a run of backticks to the next run of as many.
    """
    text = "\n".join(_unfenced(text.split("\n")))
    runs = [m.span() for m in re.finditer("`+", text)]
    places = defaultdict(list)
    for i, (a, b) in enumerate(runs):
        places[b - a].append(i)
    out, done, i = [], 0, 0
    while i < len(runs):
        like = places[runs[i][1] - runs[i][0]]
        k = bisect_right(like, i)
        if k < len(like):
            start, end = runs[i][0], runs[like[k]][1]
            out += [text[done:start], _blank(text[start:end])]
            done, i = end, like[k]
        i += 1
    return "".join(out) + text[done:]


def _value(text: str) -> str | list[str]:
    if text[:1] == "[" and text[-1:] == "]":
        return [v for v in (x.strip().strip("'\"") for x in text[1:-1].split(",")) if v]
    return text.strip("'\"")


def front_matter(text: str) -> tuple[dict, str, list[str]]:
    """(properties, body, lines that are none). A property is `key: value`, the value a text or a list; indented lines belong to the one above."""
    lines = text.split("\n")
    rulers = [i for i, line in enumerate(lines[:-1]) if line.removesuffix("\r") == RULER][:2] if lines[0].rstrip() == RULER else []
    if len(rulers) < 2:
        return {}, text, []
    held: dict = {}
    problems = []
    for n in range(1, rulers[1]):
        line = lines[n].rstrip()
        key, colon, value = line.partition(":")
        if colon and not line[0].isspace() and line[0] != "#":
            held[key.strip()] = _value(value.strip())
        elif line and line.lstrip()[0] != "#" and not (line[0].isspace() and held):
            problems.append(f"{n + 1}: {line.strip()}")
    return held, "\n".join(lines[rulers[1] + 1 :]), problems


def sections(body: str, clean: str) -> list[dict]:
    """Headings with their ancestors, whether nothing deeper follows, and a digest of the text between a heading's line and the next heading."""
    found, at = [], 0
    for line in clean.split("\n"):
        if m := HEADING.fullmatch(line):
            found.append((at, at + len(line) + 1, len(m[1]), m[2]))
        at += len(line) + 1
    ends = ([(f[0], f[2]) for f in found] + [(len(body), 0)])[1:]
    out, trail = [], {}
    for (at, text_at, level, title), (end, next_level) in zip(found, ends, strict=True):
        trail = {k: v for k, v in trail.items() if k < level} | {level: title}
        own = hashlib.sha256(body[text_at:end].encode()).hexdigest()
        out.append({"level": level, "title": title, "offset": at, "heading_path": list(trail.values()), "leaf": next_level <= level, "content_hash": own})
    return out


def targets(clean: str, image_extensions: frozenset[str]) -> Iterator[tuple[str, str, int]]:
    """(field, target, offset) of the links of a text."""
    for m in WIKI.finditer(clean):
        yield "embeds" if m[1] else "wikilinks", m[2].strip(), m.start()
    for m in LINK.finditer(clean):
        image = m[1] or os.path.splitext(m[2])[1].lower().lstrip(".") in image_extensions
        yield "embeds" if image and not m[2].startswith(REMOTE) else "links", m[2], m.start()


def _unique(items) -> list[str]:
    return [x for x in dict.fromkeys(items) if x]


def subtype_of(path: str, transcript_roots: tuple = (), generated: tuple = (), memory: tuple = MEMORY) -> str:
    """The first kind whose mark the path has: where it begins, what it holds, what it is named."""
    marks = {
        "transcript": path.startswith(tuple(transcript_roots)),
        "generated": any(map(path.__contains__, (*GENERATED, *generated))),
        "memory": any(map(path.__contains__, memory)),
        "readme": os.path.basename(path).lower() in READMES,
    }
    return next((kind for kind, found in marks.items() if found), "note")


def extract(path: str, text: str, root: str = "/", image_extensions: frozenset[str] = frozenset(), **kinds) -> dict:
    """The fields of SCHEMA for one file's text. Pure."""
    held, body, problems = front_matter(text)
    clean, raw = blanked(body), text.encode()
    tree, name = sections(body, clean), os.path.splitext(os.path.basename(path))[0]
    flat = {k: v if isinstance(v, str) else ", ".join(v) for k, v in held.items()}
    tagged = held.get("tags", [])
    fields: dict[str, list[str]] = {"wikilinks": [], "embeds": [], "links": []}
    placed = []
    for field, target, at in targets(clean, image_extensions):
        fields[field].append(target)
        if field == "wikilinks":
            placed.append({"target": target, "offset": at})
    fields["tags"] = [*([x.strip() for x in tagged.split(",")] if isinstance(tagged, str) else tagged), *TAG.findall(clean)]
    fields["path_mentions"] = re.findall(PATH.replace("{root}", re.escape(root)), clean)
    titles = (("declared", flat.get("title")), ("inferred", tree[0]["title"] if tree else None), ("verbatim", name))
    method, title = next((x for x in titles if x[1]), titles[-1])
    return {
        "path": path, "name": name, "subtype": subtype_of(path, **kinds), "title": title, "title_method": method, "body": body, "content_hash": hashlib.sha256(raw).hexdigest(), "size": len(raw),
        "frontmatter": flat, "problems": problems, "sections": tree, "placed_links": placed, **{k: _unique(v) for k, v in fields.items()},
    }


def read(spark: SparkSession, paths: list[str] | str, **how) -> DataFrame:
    """SCHEMA rows of files; bytes that aren't UTF-8 are replaced."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    return extracted(files.select(plain(F.col("path")).alias("path"), F.decode("content", "UTF-8").alias("text")), **how)


def extracted(texts: DataFrame, **how) -> DataFrame:
    """texts: (path, text) -> SCHEMA."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame([extract(p, t or "", **how) for p, t in zip(part["path"], part["text"], strict=True)], columns=SCHEMA.names)

    return texts.select("path", "text").mapInPandas(run, SCHEMA)
