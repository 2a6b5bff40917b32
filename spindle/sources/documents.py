"""Extraction from office documents, PDF and TeX. Nothing raises: what can't be read has a status that says why.

Python reads the formats, in Arrow batches; references are found in the plan, from the text that a reader hands on.
"""

from __future__ import annotations

import io
import os
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import pdf

CELLS, REFS = 2000, 200
# The forms of references and mentions. A DOI ends before a bracket, where a digit runs on into a capital, and before punctuation.
DOI = r"10\.[0-9]{4,9}/(?:(?!\)/|(?<=[0-9])\.?[A-Z])[-._;)/:A-Za-z0-9])+(?<![).,;:])"
ARXIV = r"(?i)arXiv:\s*([0-9]{4}\.[0-9]{4,5})"
URL = r"https?://[^\s<>\"')\]}]*[^\s<>\"')\]}.,;]"
DOI_LEAST = 8
FILEREF = re.compile(r"(?<![\w@/.-])((?:~/|\.{1,2}/|/)?(?:[\w.+-]+/)*[\w.+-]+\.[A-Za-z0-9]{1,8})(?![\w/])")
DTD = re.compile(rb"<!(?:DOCTYPE|ENTITY)", re.IGNORECASE)

_S = T.StringType()
SECTION = T.StructType([T.StructField("level", T.IntegerType()), T.StructField("title", _S), T.StructField("offset", T.IntegerType())])
REF = T.StructType([T.StructField("kind", _S), T.StructField("value", _S)])
SCHEMA = T.StructType(
    [T.StructField(n, _S) for n in ("path", "doctype", "status", "text")]
    + [T.StructField("sections", T.ArrayType(SECTION)), T.StructField("metadata", T.MapType(_S, _S)), T.StructField("outbound_refs", T.ArrayType(REF)), T.StructField("problems", T.ArrayType(_S))]
)
#: What the readers give: keys cited by name, and the text to look for references in where it isn't `text`.
READ = T.StructType([f for f in SCHEMA if f.name != "outbound_refs"] + [T.StructField("cited", T.ArrayType(_S)), T.StructField("searched", _S)])


class UnsafeXML(ValueError): ...


def parse_xml(data: bytes) -> ElementTree.Element:
    """An XML tree; declarations of document types or entities are refused."""
    if DTD.search(data[:65536]):
        raise UnsafeXML("declares a document type or entity")
    return ElementTree.fromstring(data)


def _name(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2]


def _all(root: ElementTree.Element, *names: str) -> list[ElementTree.Element]:
    return [e for e in root.iter() if _name(e) in names]


def references(text: Column, cited: Column | None = None) -> Column:
    """array<struct<kind, value>>: DOIs, arXiv numbers and addresses of a text, then the keys cited by name; each once, at most REFS found ones."""
    body = F.coalesce(text, F.lit(""))
    dois = F.filter(F.regexp_extract_all(body, F.lit(DOI), F.lit(0)), lambda v: F.length(v) >= DOI_LEAST)
    kinds = (("doi", dois), ("arxiv", F.regexp_extract_all(body, F.lit(ARXIV), F.lit(1))), ("url", F.regexp_extract_all(body, F.lit(URL), F.lit(0))))

    def tagged(kind: str, values: Column) -> Column:
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    found = F.slice(F.array_distinct(F.concat(*[tagged(k, v) for k, v in kinds])), 1, REFS)
    return found if cited is None else F.concat(found, tagged("citekey", F.coalesce(cited, F.array().cast("array<string>"))))


def _result(doctype: str, **what) -> dict:
    return {"doctype": doctype, "status": "ok", "text": "", "sections": [], "metadata": {}, "problems": [], "cited": [], "searched": None} | what


def _joined(parts: list[tuple[str, int]]) -> tuple[str, list[dict]]:
    """Text of (paragraph, heading level or 0) rows, and its sections at their offsets."""
    at, sections = 0, []
    for text, level in parts:
        if level and text.strip():
            sections.append({"level": level, "title": text.strip(), "offset": at})
        at += len(text) + 1
    return "\n".join(t for t, _ in parts), sections


def _texts(e: ElementTree.Element, *names: str) -> str:
    return "".join(x.text or "" for x in _all(e, *names))


def office(data: bytes, ext: str) -> dict:
    """docx, pptx, xlsx and the formats that share their names. What is no zip is an old binary format or broken."""
    doctype = {"doc": "docx", "ppt": "pptx", "xls": "xlsx"}.get(ext, ext)
    status, problems = "ok", []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        numbered = lambda p: sorted((n for n in names if re.fullmatch(p, n)), key=lambda n: int(re.search(r"(\d+)\.xml", n)[1]))
        meta = {}
        if "docProps/core.xml" in names:
            kinds = {"creator": "author", "title": "title", "subject": "subject", "lastModifiedBy": "last_modified_by", "created": "created", "modified": "modified"}
            meta = {kinds[_name(e)]: e.text.strip() for e in parse_xml(z.read("docProps/core.xml")) if _name(e) in kinds and (e.text or "").strip()}
        if doctype == "docx":
            parts = []
            for p in _all(parse_xml(z.read("word/document.xml")), "p"):
                style = next((v for e in _all(p, "pStyle") for k, v in e.attrib.items() if k.endswith("val")), "")
                m = re.match(r"(?i)heading\s*(\d)", style)
                parts.append((_texts(p, "t"), int(m[1]) if m else 0))
        elif doctype == "pptx":
            parts = []
            for n in numbered(r"ppt/slides/slide\d+\.xml"):
                lines = [t for t in (_texts(p, "t") for p in _all(parse_xml(z.read(n)), "p")) if t.strip()]
                parts += [(t, int(i == 0)) for i, t in enumerate(lines)]
        else:
            shared = [_texts(e, "t") for e in _all(parse_xml(z.read("xl/sharedStrings.xml")), "si")] if "xl/sharedStrings.xml" in names else []
            cells: list[str] = []
            for n in numbered(r"xl/worksheets/sheet\d+\.xml"):
                for c in _all(parse_xml(z.read(n)), "c"):
                    kind = c.attrib.get("t")
                    value = _texts(c, "v")
                    value = shared[int(value)] if kind == "s" and value.isdigit() and int(value) < len(shared) else _texts(c, "t") if kind == "inlineStr" else value if kind == "str" else ""
                    if value.strip():
                        cells.append(value)
            if len(cells) > CELLS:
                status, problems = "partial", [f"{len(cells)} cells, {CELLS} read"]
            parts = [(c, 0) for c in cells[:CELLS]]
    text, sections = _joined(parts)
    return _result(doctype, status=status, text=text, sections=sections, metadata=meta, problems=problems)


def open_document(data: bytes, ext: str) -> dict:
    """odt, odp, ods; rtf by its plain runs."""
    doctype = {"odp": "pptx", "ods": "xlsx"}.get(ext, "odt")
    if data.startswith(b"{\\rtf"):
        text = re.sub(r"\\'[0-9a-f]{2}|\\[a-z]+-?\d* ?|[{}]", "", data.decode("latin-1"))
        return _result(doctype, text=text.strip())
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        meta = {}
        if "meta.xml" in z.namelist():
            tree = parse_xml(z.read("meta.xml"))
            kinds = {"creator": "author", "initial-creator": "author", "title": "title", "subject": "subject", "creation-date": "created", "date": "modified"}
            for e in tree.iter():
                if _name(e) in kinds and (e.text or "").strip():
                    meta.setdefault(kinds[_name(e)], e.text.strip())
                for k, v in e.attrib.items():
                    if k.endswith("page-count") and v.isdigit():
                        meta["pages"] = v
        parts = []
        for e in _all(parse_xml(z.read("content.xml")), "h", "p"):
            level = next((int(v) for k, v in e.attrib.items() if k.endswith("outline-level") and v.isdigit()), 1) if _name(e) == "h" else 0
            parts.append(("".join(e.itertext()), level))
    text, sections = _joined(parts)
    return _result(doctype, text=text, sections=sections, metadata=meta)


def portable(data: bytes, ext: str = "pdf") -> dict:
    """PDF. Where no text is recovered, references are looked for in the bytes themselves."""
    found = pdf.read(data)
    return _result("pdf", **found, searched=None if found.get("text") else data.decode("latin-1"))


TEX_COMMAND = re.compile(r"\\(title|author|(?:sub){0,2}section|cite[a-z]*)\*?\s*(?:\[[^\]]*\]\s*)*\{")


def _argument(text: str, at: int) -> str:
    """What stands in the braces that were opened before `at`, inner braces counted."""
    depth = 1
    for m in re.compile(r"\\.|[{}]", re.DOTALL).finditer(text, at):
        depth += (m[0] == "{") - (m[0] == "}")
        if not depth:
            return text[at : m.start()]
    return text[at:]


def _plain(value: str) -> str:
    """A TeX argument as text: commands and braces gone, dashes single, blanks collapsed."""
    words = (w.translate({123: None, 125: None}) for w in re.split(r"(?:\\[a-zA-Z]+|\s|~)+", value))
    return " ".join(w.replace("--", "-") for w in words if w)


def tex(data: bytes, ext: str = "tex") -> dict:
    text = data.decode("utf-8", "replace")
    meta: dict[str, str] = {}
    sections, cited = [], {}
    for m in TEX_COMMAND.finditer(text):
        command, value = m[1], _argument(text, m.end())
        if command.startswith("cite"):
            cited |= dict.fromkeys(filter(None, map(str.strip, value.split(","))))
        elif command.endswith("section"):
            sections.append({"level": 1 + command.count("sub"), "title": _plain(value), "offset": m.start()})
        else:  # what follows a line break in an author's name is the place
            meta.setdefault(command, _plain(value.partition(r"\\")[0] if command == "author" else value))
    return _result("tex", text=text, sections=sections, metadata={k: v for k, v in meta.items() if v}, cited=list(cited))


EXTRACTORS = {**dict.fromkeys(("docx", "doc", "pptx", "ppt", "xlsx", "xls"), office), **dict.fromkeys(("odt", "odp", "ods", "rtf"), open_document), "pdf": portable, "tex": tex}


def extract(path: str, data: bytes | None) -> dict:
    """The fields of READ but the path."""
    ext = os.path.splitext(path)[1].lower().lstrip(".")
    if ext not in EXTRACTORS:
        return _result("unknown", status="missing_extractor", problems=[f"no extractor for .{ext}"])
    try:
        return EXTRACTORS[ext](data or b"", ext)
    except Exception as e:  # noqa: BLE001  any malformed file is a status, not the end of a build
        return _result(ext, status="corrupt", problems=[repr(e)])


def extracted(files: DataFrame) -> DataFrame:
    """files: (path, content) -> SCHEMA."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [{"path": p} | extract(p, None if c is None else bytes(c)) for p, c in zip(part["path"], part["content"], strict=True)]
            yield pd.DataFrame(rows, columns=READ.names)

    read = files.select("path", F.col("content")).mapInPandas(run, READ)
    return read.withColumn("outbound_refs", references(F.coalesce("searched", "text"), F.col("cited"))).select(*SCHEMA.names)
