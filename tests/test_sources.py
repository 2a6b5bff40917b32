"""Extraction, names, classification."""

import io
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from spindle.plans import filenames
from spindle.plans.classifier import Classifier, origin_owner
from spindle.sources import archives, documents, files, git, markdown

# A date in every notation that names have, with what may stand beside it: a number, two, a size, a density, a mark of a copy, a word.
NAMES = [
    ("Harbour_14032021_7.png", "2021-03-14", "ddmmyyyy", "7", None, None, False, None),
    ("14032021_7_copy.png", "2021-03-14", "ddmmyyyy", "7", None, None, True, None),
    ("301420215_8_1024x768.jpg", None, "malformed", "8", "1024x768", None, False, None),
    ("301420215_9.jpg", None, "malformed", "9", None, None, False, None),
    ("sunset_2019-11-02_015.jpg", "2019-11-02", "iso", "15", None, None, False, None),
    ("Marta_2017-02-28_009_small.jpeg", "2017-02-28", "iso", "9", None, None, False, "small"),
    ("Fractal-180131-4.jpg", "2018-01-31", "yymmdd", "4", None, None, False, None),
    ("09101999_3_ny.png", "1999-10-09", "ddmmyyyy", "3", None, None, False, "ny"),
    ("Tower_310118_6_2.jpg", "2018-01-31", "ddmmyy", "6,2", None, None, False, None),
    ("Lake_170825_300dpi.png", "2017-08-25", "yymmdd", "", None, 300, False, None),
    ("Meadow#14.jpg", None, None, "14", None, None, False, None),
    ("Orchard(1998).jpg", "1998", "year", "", None, None, False, None),
    ("Frost-7_mars_2016.png", "2016-03", "monthname", "7", None, None, False, None),
    ("Skjermbilde fra 2023-04-05 06-07-08.png", "2023-04-05", "iso_dt", "", None, None, False, None),
]


def _parsed(spark, names):
    df = spark.createDataFrame([("/p/" + n, 7) for n in names], "path string, size long")
    return {r["path"][3:]: r for r in filenames.parsed_names(df, "2026-07-22").collect()}


def test_names(spark):
    got = _parsed(spark, [row[0] for row in NAMES])
    for name, day, kind, indices, size, dpi, copy, variant in NAMES:
        n = got[name]
        assert (n["date"], "malformed" if n["malformed"] else n["date_kind"], ",".join(map(str, n["indices"])), n["resolution"], n["dpi"], n["copy"], n["variant"]) == (day, kind, indices, size, dpi, copy, variant), name
    assert got["Skjermbilde fra 2023-04-05 06-07-08.png"]["time"] == "06:07:08" and got["Meadow#14.jpg"]["size"] == 7


def test_odd_names(spark):
    odd = {
        "\U0001f600_2020-02-30_4.png": ("2020", "year", [2, 30, 4], "\U0001f600_2020"), "Plate_nr12_IV_3.png": (None, None, [12, 4, 3], "Plate_nr12_IV"), "x_IIV.png": (None, None, [], "x_IIV"),
        "$1_a\\b_7.png": (None, None, [7], "$1_a\\b"), "991231_1.png": (None, None, [1], "991231"), ".png": (None, None, [], ".png"), "a_small_5_small.png": (None, None, [5], "a_small"),
    }
    got = _parsed(spark, odd)
    assert {k: (r["date"], r["date_kind"], list(r["indices"]), r["series_stem"]) for k, r in got.items()} == odd


def test_names_can_be_filtered_and_joined(spark):
    d = filenames.parsed_names(spark.createDataFrame([("/a_1.png",), ("/b_2020-01-01_2.png",)], "path string"), "2026-01-01")
    assert d.where("date is not null and size(indices) > 0 and series_stem <> ''").count() == 1
    assert d.where("date is not null").join(d.select("series_stem"), "series_stem").count() == 1


def test_names_are_read_in_the_plan(spark):
    plan = filenames.parsed_names(spark.createDataFrame([("/a.png",)], "path string"), "2026-01-01")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_series_group_by_what_stands_before_the_index(spark):
    names = ("03122025_1.png", "03122025_2.png", "05122025_2.png")
    got = _parsed(spark, names)
    assert [got[n]["series_stem"] for n in names] == ["03122025", "03122025", "05122025"]


DOC = """---
title: Worked example
tags: [a, b]
---
# Alpha
intro under alpha

## Beta

### Gamma
gamma text with `inline code` here

## Delta > Epsilon
delta text

```python
# not a heading
```

# Zeta
"""
HASHES = [
    "9343b1e136079d8b2085b2dc01b1b19c14c7b92db8213252a7f67e0bb90158a6", "01ba4719c80b6fe911b091a7c05124b64eeece964e09c058ef8f9805daca546b",
    "3076b1a92ecc5f6484e29cc395e5b33d6ce7a4bf933c5a7f2c9ee5273597b87d", "5c1a67df39300844c2c21e5540c43f425c69d931eab437c7ed5f2c5f60911ab7",
    "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855",
]


def test_heading_tree():
    got = markdown.extract("/x/doc.md", DOC)
    assert [(s["level"], s["heading_path"], s["leaf"]) for s in got["sections"]] == [
        (1, ["Alpha"], False), (2, ["Alpha", "Beta"], False), (3, ["Alpha", "Beta", "Gamma"], True), (2, ["Alpha", "Delta > Epsilon"], True), (1, ["Zeta"], True),
    ]
    assert [s["content_hash"] for s in got["sections"]] == HASHES
    assert (got["title"], got["title_method"], got["tags"]) == ("Worked example", "declared", ["a", "b"])


def test_links_and_code():
    text = "# Top\n[[page|shown]] ![[pic.png]] `[[not]]` #tag x#no\n~~~\n[[nor]]\n~~~\n[l](a/b.md) ![i](c.jpg) [w](https://x.y) see ./d/e.md and [p](q.png)\n## Sub\n[[page#part]]\n"
    got = markdown.extract("/x/a.md", text, image_extensions=frozenset({"png", "jpg"}))
    assert got["wikilinks"] == ["page"] and got["embeds"] == ["pic.png", "c.jpg", "q.png"] and got["links"] == ["a/b.md", "https://x.y"]
    assert got["tags"] == ["tag"] and "./d/e.md" in got["path_mentions"] and got["title_method"] == "inferred"
    assert [p["target"] for p in got["placed_links"]] == ["page", "page"]
    assert markdown.subtype_of("/a/memory/x.md") == "memory" and markdown.subtype_of("/a/README.md") == "readme"


def test_code_is_blanked():
    text = "a ``x ` y`` z\n````\n```\n[[in]]\n```\n````  \n~~~ never closed\nb `c` `` d\n"
    got = markdown.blanked(text)
    assert len(got) == len(text) and got.split() == ["a", "z", "~~~", "never", "closed", "b", "``", "d"]


def test_front_matter():
    got = markdown.extract("/x/n.md", "---\r\n# note\r\ntitle: 'T: x'\r\nnested:\r\n  a: 1\r\nbad line\r\ntags: p, q\r\n---\r\nbody #rr\n")
    assert got["frontmatter"] == {"title": "T: x", "nested": "", "tags": "p, q"} and got["problems"] == ["6: bad line"] and got["tags"] == ["p", "q", "rr"] and got["body"] == "body #rr\n"
    assert markdown.extract("/x/n.md", "---\ntitle: x\n# Head\n")["title"] == "Head" and markdown.extract("/x/n.md", "")["title_method"] == "verbatim"


def _zip(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, v in members.items():
            z.writestr(k, v)
    return out.getvalue()


def test_office_documents():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    core = '<cp xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:creator>Ann</dc:creator><dc:title>T</dc:title></cp>'
    body = f'<w:document {w}><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>10.1234/abcd-25-00031-5Next and appendix-b.pdf</w:t></w:r></w:p></w:document>'
    got = documents.extract("a.docx", _zip({"docProps/core.xml": core, "word/document.xml": body}))
    assert got["status"] == "ok" and got["metadata"] == {"author": "Ann", "title": "T"} and got["sections"] == [{"level": 1, "title": "Head", "offset": 0}]
    slide = '<s xmlns:a="x"><a:p><a:t>First</a:t></a:p><a:p><a:t>rest</a:t></a:p></s>'
    assert documents.extract("a.pptx", _zip({"ppt/slides/slide1.xml": slide}))["sections"][0]["title"] == "First"
    sheet = '<w><row><c t="s"><v>0</v></c><c><v>5</v></c></row></w>'
    assert documents.extract("a.xlsx", _zip({"xl/sharedStrings.xml": "<s><si><t>name</t></si></s>", "xl/worksheets/sheet1.xml": sheet}))["text"] == "name"
    odt = '<o xmlns:text="t"><text:h text:outline-level="2">H</text:h><text:p>p</text:p></o>'
    meta = '<m xmlns:meta="m"><meta:document-statistic meta:page-count="7"/></m>'
    got = documents.extract("a.odt", _zip({"content.xml": odt, "meta.xml": meta}))
    assert got["metadata"] == {"pages": "7"} and got["sections"][0]["level"] == 2
    assert documents.extract("a.docx", b"broken")["status"] == "corrupt" and documents.extract("a.epub", b"")["status"] == "missing_extractor"
    evil = '<!DOCTYPE x [<!ENTITY a "b">]><x/>'
    assert documents.extract("a.docx", _zip({"word/document.xml": evil}))["status"] == "corrupt"


def test_pdf_and_tex():
    page = b"%PDF-1.4\n/Title <FEFF00500061> /Author (Ann \\(A\\)) /Type /Page \nstream\nBT [(Hel) -20 (lo) -300 (there)] TJ ET\nendstream\n/Count 0"
    got = documents.extract("a.pdf", page)
    assert got["status"] == "ok" and got["metadata"] == {"title": "Pa", "author": "Ann (A)", "pages": "1"} and "Hello there" in got["text"]
    assert documents.extract("a.pdf", b"%PDF /Font")["status"] == "needs_ocr" and documents.extract("a.pdf", b"%PDF")["status"] == "partial"
    assert documents.extract("a.pdf", b"%PDF /Encrypt")["status"] == "encrypted" and documents.extract("a.pdf", b"x")["status"] == "corrupt"
    got = documents.extract("a.tex", b"\\title{A \\emph{b}}\n\\author{Ann\\\\Place}\n\\section{S}\\subsection*{T} \\citep[x]{k1, k2}")
    assert got["metadata"] == {"title": "A b", "author": "Ann"} and [s["level"] for s in got["sections"]] == [1, 2]
    assert got["cited"] == ["k1", "k2"]


REFERENCES = [
    ("see 10.1234/abcd-25-00031-5Next and more", ["10.1234/abcd-25-00031-5"]),
    ("raw 10.1038/s44260-025-00031-5)/Author(Ann)", ["10.1038/s44260-025-00031-5"]),
    ("10.1103/PhysRevLett.1.2, (10.1016/j.x.2022.101866.) 10.1/x", ["10.1103/PhysRevLett.1.2", "10.1016/j.x.2022.101866"]),
    ("arXiv: 2101.01234v2 https://a.b/c. https://a.b/c, http://x)", ["2101.01234", "https://a.b/c", "http://x"]),
    ("", []), (None, []),
]


def test_references(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(REFERENCES)], "i long, t string")
    got = {r["i"]: [x["value"] for x in r["r"]] for r in df.select("i", documents.references(F.col("t")).alias("r")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(REFERENCES)}


def test_pdf_syntax():
    content = zlib.compress(b"q BT /F1 12 Tf (A\\(b\\) \\344) Tj 0 -12 Td <4142> Tj [(x) -50 (y)] TJ ET Q (outside) Tj")
    noise = b"stream\n" + bytes(range(128, 256)) * 4 + b"BT (no) Tj ET\nendstream\n"
    data = b"%PDF-1.7\n1 0 obj << /Title (T \\050x\\051 (in)) /Count 3 /Type /Pages >> endobj\n% /Encrypt in a comment\n2 0 obj << /Length 9 >> stream\r\n" + content + b"\nendstream endobj\n" + noise
    got = documents.extract("a.pdf", data)
    assert got["status"] == "ok" and got["metadata"] == {"title": "T (x) (in)", "pages": "3"} and got["text"] == "A(b) \u00e4 ABxy" and got["searched"] is None
    for broken in (b"%PDF-1.4 (never closed", b"%PDF <</Title", b"%PDF stream", b"%PDF >> ] )", b"%PDF\nstream\nBT ((((\nendstream"):
        assert documents.extract("a.pdf", broken)["status"] == "partial"


def test_tex_arguments():
    got = documents.extract("a.tex", rb"\title[short]{A {nested {title}} --- x} \subsubsection{Deep \textbf{one}} \cite{a}\citet[p.~3]{b,a} \section{open")
    assert got["metadata"] == {"title": "A nested title -- x"}
    assert [(s["level"], s["title"]) for s in got["sections"]] == [(3, "Deep one"), (1, "open")] and got["cited"] == ["a", "b"]


def test_documents_in_the_plan(spark):
    rows = [("/x/a.tex", b"10.1234/abc-1 \\cite{k}"), ("/x/b.pdf", b"%PDF 10.5555/abc-2 /Font"), ("/x/c.epub", b""), ("/x/d.pdf", None)]
    df = spark.createDataFrame([(p, None if c is None else bytearray(c)) for p, c in rows], "path string, content binary")
    out = documents.extracted(df)
    got = {r["path"]: (r["status"], [(x["kind"], x["value"]) for x in r["outbound_refs"]]) for r in out.collect()}
    assert out.columns == documents.SCHEMA.names
    assert got == {"/x/a.tex": ("ok", [("doi", "10.1234/abc-1"), ("citekey", "k")]), "/x/b.pdf": ("needs_ocr", [("doi", "10.5555/abc-2")]), "/x/c.epub": ("missing_extractor", []), "/x/d.pdf": ("corrupt", [])}


def test_archives(spark):
    good = _zip({"README": "", "src/a": "", "src/b": "", "notes.md": ""})
    assert archives.members(good) == ["README", "src/a", "src/b", "notes.md"] and archives.members(_zip({})) == [] and archives.members(b"PK\x03\x04x") is None is archives.members(None)
    df = spark.createDataFrame([("/z/a.zip", bytearray(good)), ("/z/b.zip", bytearray(b"PK\x03\x04x")), ("/z/c.xpi", bytearray(good))], "path string, content binary")
    got = {r["path"]: r["entries"] for r in archives.listed(df).collect()}
    assert got == {"/z/a.zip": ["README", "src/", "notes.md"], "/z/b.zip": None}


def test_sniffing(spark):
    rows = [("a.bin", b"%PDF-1"), ("b.json", b"{}"), ("c", b""), ("d", b"plain text"), ("e", bytes(range(128, 200))), ("f.db", b"SQLite format 3\x00"), ("g", None)]
    df = spark.createDataFrame([(p, None if c is None else bytearray(c)) for p, c in rows], "p string, c binary").select("p", files.sniffed(F.col("c"), F.col("p")).alias("s"))
    got = {r["p"]: r["s"]["detected"] for r in df.collect()}
    assert got == {"a.bin": "pdf", "b.json": "json", "c": "empty", "d": "text", "e": "unknown", "f.db": "sqlite", "g": "unreadable"}
    apps = spark.createDataFrame([("/h/.local/lib/app/x",), ("/h/.vim/x",), ("/h/work/a/x",), ("/h/x",)], "p string").select(files.owning_app(F.col("p"), "/h"))
    assert [r[0] for r in apps.collect()] == ["app", "vim", "work", "home"]


CASES = [
    ("/h/docs/a/b/.cache/x/y.md", "EXCLUDED", "cache"), ("/h/p/.env", "EXCLUDED", "redacted"), ("/h/.ssh/id_rsa", "EXCLUDED", "redacted"), ("/h/environment.md", "markdown", "note"),
    ("/h/their/README.md", "markdown", "note"), ("/h/their/sub/x.md", "EXCLUDED", "vendored-repo"), ("/h/x.mdx", "markdown", "note"), ("/h/p/[rpc].ts", "code", "-"),
    ("/h/x.bak-20260620", "misc", "unknown"), ("/h/x.bak", "EXCLUDED", "cache"), ("/h/pics/thumbs/a.png", "EXCLUDED", "cache"), ("/h/pics/a.png", "image", "-"), ("/h/a.png", "EXCLUDED", "image-outside-root"),
    ("/h/.face", "EXCLUDED", "app-state"), ("/h/.config/a.toml", "EXCLUDED", "app-state"), ("/h/.claude/agents/a.md", "markdown", "note"), ("/h/.claude/history.jsonl", "EXCLUDED", "app-state"),
    ("/h/a/node_modules/b/c.js", "EXCLUDED", "dependency"), ("/h/a.DOC", "document", "docx"), ("/h/link.md", "EXCLUDED", "symlink"), ("/h/.bashrc", "misc", "unknown"),
]


def test_classifier(spark):
    c = Classifier("/h", image_roots=("/h/pics",), vendored=("/h/their",))
    df = spark.createDataFrame([(p, p == "/h/link.md") for p, *_ in CASES], "path string, is_symlink boolean")
    got = {r["path"]: (r["label"], r["subtype"]) for r in c.classify(df).collect()}
    assert got == {p: (a, b) for p, a, b in CASES}
    assert Classifier("/h").classify(df.where("path = '/h/pics/a.png'")).first()["subtype"] == "image-outside-root"


def test_origins():
    assert origin_owner('[remote "origin"]\n\turl = git@host:ann/x.git') == "ann" == origin_owner('[remote "origin"]\nurl=https://host/ann/x')
    assert origin_owner('[remote "up"]\nurl = https://h/bob/x') is None


def test_git_log():
    log = "c1\0\n1\t1\ta.md\0" + "1\t0\thøst.md\0" + "c2\0\n0\t0\t\0old.md\0new.md\0" + "c3\0"
    assert git.parse_log(log) == [("c1", "a.md"), ("c1", "høst.md"), ("c2", "new.md")]
