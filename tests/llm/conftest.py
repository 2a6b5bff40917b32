import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, rule string, node string"


@pytest.fixture(scope="session")
def make(spark):
    """A documents table, with extra columns whose names clash, from (doc_id, text[, lang[, source]]) rows."""

    def build(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or ""), "x", "y") for r in rows]
        return spark.createDataFrame(full, DOCS)

    return build


@pytest.fixture(scope="session")
def texts():
    """Texts with nulls, empty and very long ones, ties and repeats."""
    import random

    rng = random.Random(1)
    vocabulary = [a + b + c for a in "bdgklmnprst" for b in "aeiou" for c in ("", "n", "r", "st")]

    def prose(n, seed):
        r = random.Random(seed)
        return " ".join(r.choice(vocabulary) for _ in range(n))

    passage = prose(70, 99)
    rows = [(0, prose(120, 0)), (1, None), (2, ""), (3, " \t\n\x0b "), (4, prose(300, 4)), (5, prose(300, 4)), (6, prose(40, 6) + " " + passage + "\n" + prose(30, 7)),
            (7, prose(25, 8) + "\n" + passage + " " + prose(60, 9)), (8, prose(300, 4).replace(" ", "  ", 3) + " tail"), (9, prose(4000, 10)), (10, "one"), (11, "Straße ünï\u00a0code a\u2003b é"),
            (12, "w " * 200), (13, "w " * 200), (4, prose(300, 4)), (14, prose(60, 11) + "\n" + prose(60, 12)), (None, prose(300, 4))]
    rows += [(100 + i, prose(rng.randint(1, 90), 500 + i % 7)) for i in range(25)]
    return rows
