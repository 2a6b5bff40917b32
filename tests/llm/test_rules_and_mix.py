"""Quality rules, mixing, URL filters."""

import math
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from spindle.llm import mixing, quality_rules, url_filter

EDGE = [(1, None), (2, ""), (3, " \n"), (4, "a b c d e f g h i"), (5, "a b c d e " * 6), (6, "Straße é " * 9), (7, "x\nx\n \nx"), (8, "one two three four five six seven eight nine ten # | <>"), (9, "v\u00a0w x\x1cy " * 12)]


def brute_figures(t):
    t = t or ""
    ws = [w for w in __import__("re").split("[\x20\x09-\x0d]+", t) if w]
    lines = [x for x in t.split("\n") if x.strip("\x20\t\n\x0b\x0c\r")]
    wins = [tuple(ws[i : i + 5]) for i in range(len(ws) - 4)]
    hit = {j for i, w in enumerate(wins) if wins.count(w) > 1 for j in range(i, i + 5)}
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in t), sum(x in lines[:i] for i, x in enumerate(lines)), len(hit)


def test_figures(spark, make, texts):
    rows = EDGE + [r for r in texts if r[0] is not None]
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = quality_rules.quality_rules(make(rows), labels).collect()
    assert sorted((r["doc_id"], *r[1:6]) for r in got) == sorted((d, *brute_figures(t)) for d, t in rows)
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]) and r["kept"] == (not r["base_failed"])
    assert quality_rules.quality_rules(make([]), labels).count() == 0


def test_exact_bound():
    for k, n, p in ((0, 50, 0.1), (3, 40, 0.2), (40, 40, 0.5)):
        want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert math.isclose(quality_rules.binomial_p(k, n, p), want, rel_tol=1e-9)


def test_cutoffs_are_certified_or_not_used():
    grid = quality_rules.GRID
    none = [0] * len(grid)
    good, bad = [*none, 2000], [*none, 100]
    bad[4] = 300
    cut = quality_rules.certified(good, bad, n_tests=20)
    assert cut == grid[4]
    assert quality_rules.certified([*none, 100], bad, n_tests=20) is None, "too few labels certify nothing"
    risky = list(good)
    risky[0] = 200
    assert quality_rules.certified(risky, bad, n_tests=20) is None
    same = [*none, 2000]
    same[4] = 3
    assert quality_rules.certified(same, [*none[:4], 1, *none[5:], 700], n_tests=20) is None, "no lift"


def test_false_rejections_stay_below_the_risk():
    import numpy as np

    rng, over = np.random.default_rng(0), 0
    for _ in range(300):
        n, p = 3000, 0.0125  # the rule's true rate is above its share of the risk
        good = [0] * len(quality_rules.GRID) + [n]
        good[5] = int(rng.binomial(n, p))
        good[-1] -= good[5]
        bad = [0] * len(quality_rules.GRID) + [100]
        bad[5] = 200
        over += quality_rules.certified(good, bad, n_tests=1) is not None
    assert over <= 300 * quality_rules.DELTA


def test_certified_rules_reject(spark, make):
    clean = [(i, f"the {i} quick brown fox jumps over a lazy dog in town {i}") for i in range(1500)]
    junk = [(5000 + i, f"the{i} ### quick$$ brown%%% fox*** jumps&&& over### a$$$ lazy%%% dog*** in### town{i}") for i in range(300)]
    docs = make(clean + junk)
    labels = docs.select("doc_id", (F.col("doc_id") < 5000).cast("int").alias("quality"))
    got = quality_rules.quality_rules(docs, labels.union(labels))
    assert got.where("doc_id < 5000 and kept").count() == 1500 and got.where("doc_id >= 5000 and kept").count() == 0


def test_targets():
    got = mixing.targets([100, 10, 50])
    assert sum(got) == 240 and all(g <= 2 * s for g, s in zip(got, [100, 10, 50], strict=True)) and got[1] == 20
    assert mixing.targets([0, 0]) == [0, 0] and mixing.targets([]) == []


def test_sainte_lague():
    def brute(w, seats, most):
        got = [0] * len(w)
        for _ in range(seats):
            i = max((i for i in range(len(w)) if got[i] < most[i]), key=lambda i: (Fraction(w[i]) / (2 * got[i] + 1), -i))
            got[i] += 1
        return got

    for w, seats in (([53, 24, 23], 7), ([6, 6, 6], 4), ([1000, 1, 1], 30), ([7], 5), ([5, 3, 1], 40)):
        most = [25] * len(w)
        assert mixing.sainte_lague([Fraction(x) for x in w], min(seats, 25 * len(w)), most) == brute(w, min(seats, 25 * len(w)), most)
    assert mixing.sainte_lague([Fraction(0)], 3, [5]) == [0]


def test_mix(make, texts):
    rows = [(d, t, "en", s) for (d, t), s in zip([r[:2] for r in texts], ["b", "a", None, "c"] * 20, strict=False)]
    rows += [(1000 + i, "w " * (i % 90), "en", "big") for i in range(400)]
    got = mixing.mix(make(rows))
    out = got.collect()
    assert sorted((r["doc_id"], r["size"]) for r in out if r["doc_id"] is not None) == sorted((d, len((t or "").encode().split())) for d, t, *_ in rows if d is not None)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in out)
    names = sorted({r["source"] for r in out if r["source"] is not None}) + [None]
    sizes = [sum(r["size"] for r in out if r["source"] == s) for s in names]
    want = dict(zip(names, map(float, mixing.targets(sizes)), strict=True))
    for s, n in zip(names, sizes, strict=True):
        own = [r for r in out if r["source"] == s]
        assert {(r["source_size"], r["target"]) for r in own} == {(n, want[s])}
        assert abs(sum(r["taken"] for r in own) - want[s]) <= max(0.02 * want[s], 2 * mixing.BLOCK_WORDS)
    assert sorted(map(str, mixing.mix(make(rows[::-1])).collect())) == sorted(map(str, out))
    assert mixing.mix(make([])).count() == 0


URLS = ["http://Foo.Example.ORG/en/12?q", "https://example.org/es/", "https://a.b.com/fr/x#y", "b.com/de/", None, "", "x://com/de/q", "http://notexample.org/en/1", "http://example.org", "s://casino-win.example.com/en/1", "s://a.casino-win.example.com?x", "s://a.b.net/z://q", "s://user@com/fr/", "http://org"]


def brute_url(u):
    rest = u.split("://", 1)[1] if u and "://" in u else ""
    cut = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    tail = rest[cut:]
    path = tail[: next((i for i, c in enumerate(tail) if c in "?#"), len(tail))]
    best = None
    for rule, verdict in url_filter.RULES:
        h, s, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith(s + p) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    bad = any(host == b or host.endswith("." + b) for b in url_filter.BLOCKED)
    return host, path, best and best[0], best[1] if best else "block" if bad else "allow"


def test_urls(spark):
    df = spark.createDataFrame([(i, u, "old") for i, u in enumerate(URLS + URLS[:2])], "page_id long, url string, verdict string")
    got = url_filter.url_filter(df)
    assert [(r["host"], r["path"], r["rule"], r["verdict"]) for r in got.orderBy("page_id").collect()] == [brute_url(u) for u in URLS + URLS[:2]]
    assert url_filter.url_filter(df.limit(0)).count() == 0


def test_lists_may_be_tables(spark):
    hosts = [(f"h{i}.example.{'com' if i % 2 else 'net'}",) for i in range(500)] + [(None,), ("h1.example.com",)]
    table = spark.createDataFrame(hosts, "host string")
    entries = table.select(F.col("host").alias("entry"), F.lit("block").alias("verdict"))
    assert len(url_filter.listed(spark, entries, shard_rows=100)) == 5 and len(url_filter.listed(spark, entries.limit(0))) == 1
    rules = spark.createDataFrame(list(url_filter.RULES), "entry string, verdict string")
    urls = [f"s://{'' if i % 3 else 'a.b.'}h{i}.example.com/x" for i in range(40)] + ["s://h2.example.net", "s://xh2.example.net", None]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = [(r["rule"], r["verdict"]) for r in url_filter.url_filter(df, rules=rules, blocked=table).orderBy("page_id").collect()]
    assert got == [(None, "block" if i % 2 else "allow") for i in range(40)] + [(None, "block"), (None, "allow"), (None, "allow")]


def test_very_long_hosts_make_few_candidates(spark):
    import time

    df = spark.createDataFrame([(1, "s://" + "a." * 200_000 + "casino-win.example.com/" + "p/" * 100_000)], "page_id long, url string")
    began = time.time()
    assert [r["verdict"] for r in url_filter.url_filter(df).collect()] == ["block"] and time.time() - began < 20


def test_mixing_of_many_words_does_not_overflow(make, monkeypatch):
    """Products of words and blocks are bounded by the shard, whatever the corpus: shards of SHARD_MOST words have room to spare."""
    n = mixing.SHARD_MOST * 2
    assert (n // mixing.BLOCK_WORDS + 1) * n < 2**60
    monkeypatch.setattr(mixing, "SHARD_MOST", 50)
    got = mixing.mix(make([(i, "w " * 30) for i in range(400)]), n_shards=1).collect()
    assert sum(r["taken"] for r in got) == 18_000


def test_colliding_keys_are_told_apart(tmp_path, monkeypatch):
    monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", lambda s: len(s))
    entries = [("aaa.org/", "block"), ("bbb.org/", "allow"), ("c.net/x", "block"), ("bbb.org/", "block")]
    (tmp_path / "l").write_bytes(url_filter.packed_list(entries))
    d = url_filter.DigestList(str(tmp_path / "l"))
    places = d.probe([b"bbb.org/", b"ccc.org/", b"c.net/x"])
    assert places[1] == -1 and not d.block[places[0]] and d.block[places[2]]
    (tmp_path / "e").write_bytes(url_filter.packed_list([]))
    assert url_filter.DigestList(str(tmp_path / "e")).probe([b"x"]) == [-1]


@pytest.mark.parametrize("n", [1, 2, 7, 16, 30])
def test_strides_permute(n):
    step = mixing._stride(n, 11)
    assert sorted((step * i + 3) % n for i in range(n)) == list(range(n))
