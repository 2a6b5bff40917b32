"""Tokenisers: of the full-text index, of queries and of identifiers."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _accents() -> tuple[str, str]:
    """Letters that decompose into one base letter and marks, from the character database."""
    plain = {}
    for cp in range(0xC0, 0x1F00):
        d = unicodedata.normalize("NFD", chr(cp))
        if len(d) > 1 and unicodedata.category(d[0])[0] == "L" and all(unicodedata.combining(c) for c in d[1:]):
            plain[chr(cp)] = d[0]
    return "".join(plain), "".join(plain.values())


_FROM, _TO = _accents()
#: A character of a term: letters, digits, private use.
TERM = r"[\p{L}\p{N}\p{Co}]+"


def folded(text: Column) -> Column:
    """Lower-cased, accents dropped; letters that don't decompose stay as they are."""
    return F.regexp_replace(F.translate(F.lower(text), _FROM, _TO), r"\p{Mn}+", "")


def terms(text: Column) -> Column:
    """The index's terms of a text, in order."""
    return F.regexp_extract_all(folded(F.coalesce(text, F.lit(""))), F.lit(TERM), F.lit(0))


def fold_one(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))


def query_phrases(text: str) -> list[list[str]]:
    """The phrases of a query: one for each run of word characters, split into the index's terms.

    `snake_case` is one run and two terms, so it asks for the two next to each other.
    """
    found = [re.findall(r"[^\W_]+", fold_one(run)) for run in re.findall(r"\w+", text)]
    return [p for p in found if p]


#: Where identifiers part: at other than ASCII letters and digits, before a capital after a lower letter or digit, before the last capital of an acronym.
PARTS = r"[^A-Za-z0-9]+|(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])"


def identifier_tokens(text: Column) -> Column:
    """Parts of identifiers, lower-cased."""
    return F.array_remove(F.transform(F.split(text, PARTS), F.lower), "")


def quoted(text: Column) -> Column:
    """A regular expression that matches the text literally."""
    return F.regexp_replace(text, r"([\\.^$|?*+()\[\]{}\-])", r"\\$1")


def stands_alone(body: Column, name: Column, path_like: bool) -> Column:
    """Whether a name occurs in a body on its own: no word character, dot or dash (for paths also no slash) before it, no word character after it.

    The cheap containment test goes first.
    """
    left = r"(?U)(?<![\w.\-/])" if path_like else r"(?U)(?<![\w.\-])"
    return body.contains(name) & F.call_function("rlike", body, F.concat(F.lit(left), quoted(name), F.lit(r"(?!\w)")))
