"""Names inside of bodies: many names meet bodies by words; the pairs are those of a plain search."""

import random

import pytest
from pyspark.sql import functions as F

from spindle.operators import derive

WORDS = ["plot", "Plot", "home", "user", "data", "é9", "a", "x1", "img", "png", "txt", "rapport", "løv"]


def drawn(rng, n):
    return "".join(rng.choice([*WORDS, *"/._- "]) for _ in range(n))


@pytest.mark.parametrize("seed", range(3))
def test_many_names_meet_by_words(spark, monkeypatch, seed):
    monkeypatch.setattr(derive, "BROADCAST_NAMES", 0)
    rng = random.Random(seed)
    names = [("n%d" % i, drawn(rng, rng.randint(1, 5))) for i in range(60)] + [("m", "--"), ("s", "a"), ("s2", "a"), ("e", "/home/user/x1.txt")]
    bodies = [("b%d" % i, drawn(rng, rng.randint(0, 60)) + rng.choice(["", rng.choice(names)[1]])) for i in range(60)] + [("b0", "other a"), ("z", None), ("y", ""), ("w", "in-/home/user/x1.txts")]
    got = derive._containing(spark.createDataFrame(bodies, "src_key string, body string"), spark.createDataFrame(names + names[:5], "dst_key string, name string"))
    found = [(r["src_key"], r["body"], r["dst_key"], r["name"]) for r in got.collect()]
    want = {(s, b, d, n) for s, b in bodies if b is not None for d, n in names if n in b}
    assert len(found) == len(want) and set(found) == want


def test_ten_thousand_paths_of_one_home(spark, monkeypatch):
    monkeypatch.setattr(derive, "BROADCAST_NAMES", 0)
    n = 10_000
    names = spark.range(n).select(F.concat(F.lit("k"), "id").alias("dst_key"), F.concat(F.lit("/home/user/work/part"), F.col("id") % 100, F.lit("/file"), "id", F.lit(".txt")).alias("name"))
    other = (F.col("id") * 7919) % (2 * n)
    bodies = spark.range(n).select(F.concat(F.lit("b"), "id").alias("src_key"), F.concat(F.lit("see /home/user/work/part"), other % 100, F.lit("/file"), other, F.lit(".txt and more of it "), F.repeat(F.lit("words of a body "), 40)).alias("body"))
    got = derive._containing(bodies, names)
    assert got.count() == sum((i * 7919) % (2 * n) < n for i in range(n))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
