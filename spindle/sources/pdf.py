"""Text and properties of PDF files, by a lexer of their syntax.

A file is a run of tokens. Outside of streams, a name and the value after it give properties, pages and marks. A content stream is
run as the operators it holds: operands pile up until an operator takes them, and those that show text give theirs. Fonts'
own encodings are not read, so text in them stays unreadable and is dropped with its stream.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

# The properties that are kept, the share of a content stream that is printable, the gap that is a space, the text's limit.
INFO = {b"/Title": "title", b"/Author": "author", b"/Creator": "creator", b"/Producer": "producer", b"/Subject": "subject"}
PRINTABLE_SHARE, WIDE, MAX_CHARS = 0.7, 100, 400_000

LARGEST_STREAM = 64 << 20
PRINTABLE = bytes([9, 10, 13, *range(32, 127)])
ESCAPED = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\n": b"", b"\r": b"", b"\r\n": b""}
TOKEN = re.compile(
    rb"""(?P<space>[\s\0]+|%[^\r\n]*)
    | (?P<open>\()
    | (?P<mark><<|>>|[\[\]{}])
    | <(?P<hex>[0-9A-Fa-f\s]*)>
    | (?P<name>/[^\s\0()<>\[\]{}/%]*)
    | (?P<number>[+-]?(?:\d+\.?\d*|\.\d+)(?=[\s\0()<>\[\]{}/%]|\Z))
    | (?P<word>[^\s\0()<>\[\]{}/%]+)""",
    re.VERBOSE,
)
PIECE = re.compile(rb"[^()\\]+|\\(?:[0-7]{1,3}|\r\n|.)|[()]", re.DOTALL)
IMAGE_END = re.compile(rb"\sEI(?=\s|\Z)")
SHOWS, NEXT_LINE = (b"Tj", b"TJ", b"'", b'"'), (b"T*", b"'", b'"')


def _string(data: bytes, at: int) -> tuple[bytes, int]:
    """What a bracketed string that was opened before `at` stands for, and where it ends."""
    out, depth = bytearray(), 1
    for m in PIECE.finditer(data, at):
        piece = m[0]
        depth += (piece == b"(") - (piece == b")")
        if not depth:
            return bytes(out), m.end()
        if piece[:1] == b"\\":
            mark = piece[1:]
            piece = bytes([int(mark, 8) & 255]) if mark[:1] in b"01234567" else ESCAPED.get(mark, mark)
        out += piece
    return bytes(out), len(data)


def tokens(data: bytes, at: int = 0) -> Iterator[tuple[str, bytes]]:
    """(kind, value): string, name, number, mark, word, and stream with its raw bytes. What is no token is stepped over."""
    while at < len(data):
        m = TOKEN.match(data, at)
        if m is None:
            at += 1
            continue
        at, kind, value = m.end(), m.lastgroup, m[m.lastgroup]
        if kind == "open":
            value, at = _string(data, at)
            yield "string", value
        elif kind == "hex":
            digits = b"".join(value.split()).decode()
            yield "string", bytes.fromhex(digits + "0" * (len(digits) % 2))
        elif value == b"stream" and kind == "word":
            end = data.find(b"endstream", at)
            end = len(data) if end < 0 else end
            yield "stream", data[at:end].removeprefix(b"\r").removeprefix(b"\n")
            at = end + len(b"endstream")
        elif value == b"ID" and kind == "word" and (m := IMAGE_END.search(data, at)):
            at = m.end()
        elif kind != "space":
            yield kind, value


def text_string(raw: bytes) -> str:
    return (raw[2:].decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else raw.decode("latin-1")).strip()


def inflated(raw: bytes) -> bytes:
    """A stream's content, up to LARGEST_STREAM bytes; as it is if it isn't deflated."""
    try:
        return zlib.decompressobj().decompress(raw, LARGEST_STREAM)
    except zlib.error:
        return raw


def shown(content: bytes) -> str:
    """The text that a content stream shows; empty where the stream holds no text object or is mostly unprintable."""
    if b"BT" not in content or len(content.translate(None, PRINTABLE)) > (1 - PRINTABLE_SHARE) * len(content):
        return ""
    out: list[str] = []
    operands: list[tuple[str, bytes]] = []
    inside = False
    for kind, value in tokens(content):
        if kind != "word":
            operands.append((kind, value))
            continue
        if value in (b"BT", b"ET"):
            inside = value == b"BT"
            out.append(" ")
        elif inside and (value in NEXT_LINE or (value in (b"Td", b"TD") and operands and operands[-1][0] == "number" and float(operands[-1][1]))):
            out.append(" ")
        if inside and value in SHOWS:
            for k, v in operands:
                if k == "string":
                    out.append(v.decode("latin-1"))
                elif k == "number" and value == b"TJ" and abs(float(v)) > WIDE:
                    out.append(" ")
        operands = []
    return "".join(out)


def read(data: bytes) -> dict:
    """status, text, metadata and problems of a file's bytes."""
    if not data.startswith(b"%PDF"):
        return {"status": "corrupt", "problems": ["no header"]}
    meta: dict[str, str] = {}
    streams, names = [], set()
    pages, declared, before = 0, None, b""
    for kind, value in tokens(data, re.match(rb"%PDF(?:-[\d.]*)?", data).end()):
        if kind == "stream":
            streams.append(value)
        elif kind == "string" and before in INFO and (held := text_string(value)):
            meta.setdefault(INFO[before], held)
        elif kind == "number" and before == b"/Count" and declared is None:
            declared = int(float(value))
        elif kind == "name":
            names.add(value)
            pages += before == b"/Type" and value == b"/Page"
        before = value if kind == "name" else b""
    pages = max(pages, declared or 0)
    if pages:
        meta["pages"] = str(pages)
    text = ""
    for raw in streams:
        if len(text) <= MAX_CHARS:
            text += shown(inflated(raw)) + " "
    text = " ".join("".join(c if c >= " " else " " for c in text).split())
    if b"/Encrypt" in names:
        return {"status": "encrypted", "text": text, "metadata": meta, "problems": ["encrypted; not decrypted"]}
    if text:
        return {"status": "ok", "text": text, "metadata": meta}
    fonts = any(n.startswith(b"/Font") for n in names)
    return {"status": "needs_ocr" if fonts else "partial", "metadata": meta, "problems": ["no text recovered"]}
