"""Language identification, quality classification, personal data; the pipeline."""

import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindle.llm import language_id, pii, quality_classifier, quality_rules
from spindle.llm.common import fold

SF = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def test_gradients_are_those_of_the_loss():
    net = language_id.BiGru(["a", "b"], hidden=3, seed=1)
    data = np.random.default_rng(0).integers(97, 110, (7, 4)).astype(np.intp)
    data[5:, 1] = language_id.PAD
    y = np.array([0, 1, 1, 0])
    _, grads = net.gradients(data, y)
    for name, at in (("o", (1, 2)), ("c", (0, 0)), ("u", (0, 1, 2)), ("u", (1, 4, 0)), ("u", (1, 7, 1)), ("x", (0, 2, data[0, 0])), ("x", (1, 5, data[3, 2])), ("x", (0, 8, data[2, 3]))):
        own = getattr(net, name).astype(np.float64)
        loss = []
        for step in (1e-2, -1e-2):
            moved = own.copy()
            moved[at] += step
            setattr(net, name, moved.astype(np.float32))
            loss.append(net.gradients(data, y)[0])
        setattr(net, name, own.astype(np.float32))
        assert abs((loss[0] - loss[1]) / 2e-2 - grads[name][at]) < 2e-3


def test_pooling_does_not_depend_on_the_batch():
    net = language_id.BiGru(["a", "b", "c"])
    texts = [b"short", b"", b"x" * 1000, "müßig ".encode() * 50, b"y" * language_id.WINDOW]
    together = net.pooled(texts)
    alone = np.concatenate([net.pooled([t]) for t in texts])
    assert np.allclose(together, alone, atol=1e-5) and np.allclose(together.sum(axis=1), 1, atol=1e-5) and np.allclose(together[1], 1 / 3)


@needs_tables
def test_languages_are_told_apart(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(-1, None, "en", "s", 0), (-2, "", "de", "s", 0), (-3, "12 34 !?", "fr", "s", 0), (-4, "the and of " * 20000, None, "s", 0)], docs.schema)
    got = language_id.language_id(docs.union(extra), per_language=400)
    rows = {r["doc_id"]: r for r in got.collect()}
    assert len(rows) == docs.count() + 4 and all(0 <= r["score"] <= 1 for r in rows.values())
    assert [rows[i]["lang_pred"] for i in (-1, -2, -3, -4)] == ["und", "und", "und", "en"]
    held = got.where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert held.where("lang = lang_pred").count() >= 0.95 * held.count() > 0
    nothing = language_id.language_id(docs.limit(0))
    assert nothing.count() == 0


def test_fold(spark):
    import zlib

    df = spark.createDataFrame([(i,) for i in (0, 7, -3, 123456789012)], "i long").select("i", fold(F.col("i")).alias("f"))
    assert all(r["f"] == zlib.crc32(str(r["i"]).encode()) % 5 for r in df.collect())


def test_pairs_by_sums_of_squares():
    fm = quality_classifier.FactorisationMachine(seed=2)
    fm.w[:] = np.random.default_rng(1).normal(size=len(fm.w))
    rows = [quality_classifier.features(t, 5) for t in (b"a b c a", b"", None, b"x" * 5000)]
    idx, x, starts, owner = quality_classifier._flat(rows)
    got = fm.raw(rows)[0]
    for k in range(len(rows)):
        i, v = idx[owner == k], x[owner == k]
        pairs = sum(float(fm.v[i[p]] @ fm.v[i[q]]) * v[p] * v[q] for p in range(len(i)) for q in range(p))
        assert abs(got[k] - (fm.w0 + float(fm.w[i] @ v) + pairs)) < 1e-3


@needs_tables
def test_quality_is_learnt(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    extra = spark.createDataFrame([(-1, None, "en", "s", None), (-2, "", None, None, 0)], docs.schema)
    got = quality_classifier.quality_scores(docs.union(extra), labels)
    rows = got.collect()
    assert len(rows) == docs.count() + 2 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    held = got.where("held_out").join(labels, "doc_id").collect()
    good = [r["score"] for r in held if r["quality"] == 1]
    bad = [r["score"] for r in held if r["quality"] == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.97
    assert {r["score"] for r in quality_classifier.quality_scores(docs.limit(3), labels.limit(0)).collect()} == {0.5}
    assert quality_classifier.quality_scores(docs.limit(0), labels).count() == 0


def luhn(s):
    return sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(s))) % 10 == 0


def digits(s):
    return re.sub("[^0-9]", "", s)


BASE = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
)


def brute_spans(t):
    return [f"{k}:{m.start()}:{m.end()}" for k, p, ok in BASE for m in re.finditer(p, t or "") if ok(m[0])]


PRIVATE = [
    (1, None), (2, ""), (3, "a.b+c@x.y.zz, q@@r@s.t a@b"), (4, "é 😀 1.2.3.4.5.6.7.8 0255.1.1.1 256.1.1.1 1.2.3"), (5, "4512 1602 1872 1939 4111111111111111 4111-1111-1111-1111 41111111111111112222"),
    (6, "+1 (944) 555-6250 +47 22 33 44 55. +123 ++1234567890 +1(((((((2"), (7, "a@b.c+d@e.f a@b.c@d.e"), (8, "1" * 5000 + "@x.y"), (9, "x" * 20000 + " " + "y.z" * 5000), (10, "a." * 3000 + "@b.c"),
    (3, "a.b+c@x.y.zz"), (None, "me@here.now"), (11, "0000000000000000 0 0-0--1"), (12, "call 944 555 6250 or name [at] host [dot] org"),
]


@pytest.fixture(scope="module")
def found(make):
    return pii.find_pii(make(PRIVATE)).collect()


def test_base_spans(found):
    text = lambda spans: [f"{s['kind']}:{s['start']}:{s['end']}" for s in spans]
    assert sorted((str(r["doc_id"]), text(r["base"])) for r in found) == sorted((str(d), brute_spans(t)) for d, t in PRIVATE)
    for r in found:
        assert [s for s in r["spans"] if s in r["base"]] == r["base"] and r["spans"] == sorted(r["spans"], key=lambda s: (s["order"], s["start"], s["end"]))
        assert all(a["end"] <= b["start"] or b["end"] <= a["start"] for a in r["spans"] if a not in r["base"] for b in r["base"])


def test_pii_of_nothing(make):
    assert pii.find_pii(make([])).count() == 0


def test_trees_and_thresholds():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 10, (600, 3)).astype(float)
    y = ((x[:, 0] > 5) & (x[:, 1] < 4)).astype(float)
    first, trees = pii.fit_trees(x, y)

    def value(tree, row):
        return tree if isinstance(tree, float) else value(tree[2] if row[tree[0]] < tree[1] else tree[3], row)

    raw = [first + sum(value(t, r) for t in trees) for r in x]
    assert np.mean((np.array(raw) > 0) == (y == 1)) > 0.99
    assert pii.calibrate([("phone", 10, False, 5), ("phone", 60, True, 98), ("phone", 60, False, 2), ("card", 90, False, 3)]) == {"phone": 0.11}
    assert pii.fit_trees(x[:0], y[:0])[1] == [] and pii.calibrate([]) == {}


def test_added_spans(make):
    """Loose numbers in a place where confirmed ones stand are added; those elsewhere are not."""
    rows = [(i, f"tel: +1 (944) 555-{1000 + i}; id {i}{i * 7919 % 10**9:09d}x") for i in range(400)] + [(1000 + i, f"tel: 1 (944) 555-{2000 + i};") for i in range(5)]
    got = {r["doc_id"]: r for r in pii.find_pii(make(rows), precision=0.9).collect()}
    assert all([s["kind"] for s in got[1000 + i]["spans"]] == ["phone"] and not got[1000 + i]["base"] for i in range(5))
    assert all(len(got[i]["spans"]) == len(got[i]["base"]) == 1 for i in range(400))


def test_credentials_are_learnt_from_names_and_found_without(make):
    import hashlib

    value = lambda i: hashlib.sha1(b"%d" % i).hexdigest()
    rows = [(i, f'words before token = "{value(i)}" and after incomprehensibilities {i}') for i in range(300)]
    rows += [(1000 + i, f'words before "{value(5000 + i)}" and after internationalisation') for i in range(5)]
    got = {r["doc_id"]: r["spans"] for r in pii.find_pii(make(rows), precision=0.9).collect()}
    for d, t in rows:
        at = t.index('"') + 1
        assert [(s["kind"], s["start"], s["end"]) for s in got[d]] == [("secret", at, at + 40)]


def test_overlapping_candidates_are_chosen_by_total_score(spark):
    import itertools

    rng = np.random.default_rng(2)
    groups = []
    for _ in range(150):
        n = int(rng.integers(1, 9))
        starts = np.sort(rng.integers(0, 30, n))
        groups.append(sorted((int(s), int(s + rng.integers(1, 12)), "email", float(rng.integers(1, 64)) / 64) for s in starts))
    df = spark.createDataFrame([(i, g) for i, g in enumerate(groups)], "i long, held array<struct<start:long,end:long,kind:string,p:double>>")
    got = {r["i"]: [tuple(x) for x in r["own"]] for r in df.select("i", pii.best_apart("held").alias("own")).collect()}
    for i, g in enumerate(groups):
        apart = lambda own: all(a[1] <= b[0] for a, b in itertools.pairwise(own))
        most = max(sum(x[3] for x in own) for k in range(1, len(g) + 1) for own in itertools.combinations(g, k) if apart(own))
        assert apart(got[i]) and sum(x[3] for x in got[i]) == most


def test_a_card_needs_its_sum(make):
    """Groups of 16 digits with other separators are added if they pass; those that fail are not, though they look alike."""
    import random

    r = random.Random(4)

    def number(ok):
        while True:
            d = "".join(r.choice("0123456789") for _ in range(16))
            if luhn(d) == ok:
                return d

    rows = [(i, f"card no {number(True)} paid") for i in range(200)] + [(1000 + i, "card no {0[0]}.{0[1]}.{0[2]}.{0[3]} paid".format([number(i % 2 == 0)[j : j + 4] for j in (0, 4, 8, 12)])) for i in range(8)]
    got = {x["doc_id"]: x for x in pii.find_pii(make(rows), precision=0.9).collect()}
    for d, t in rows[200:]:
        assert not got[d]["base"] and all(luhn(digits(t[s["start"] : s["end"]])) for s in got[d]["spans"])


def test_pii_plan_has_no_python(make):
    plan = pii._spans(make([(1, "a@b.c")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_ids_may_be_texts_null_or_repeated(spark):
    words = {"xx": "alpha beta gamma delta", "yy": "uno dos tres cuatro"}
    rows = [(None if i % 50 == 0 else f"id{i % 150}", f"{words[k]} {i} " * (1 + i % 4), k, "z", "t") for i in range(200) for k in words]
    rows += [("long", "alpha beta " * 30_000, "xx", "z", "t"), ("id1", None, "xx", "z", "t"), ("id1", "", "yy", "z", "t")]
    docs = spark.createDataFrame(rows, "doc_id string, text string, lang string, score string, features string").withColumn("n_chars", F.length("text").cast("long"))
    langs = language_id.language_id(docs, per_language=40)
    assert langs.count() == len(rows) and langs.schema["doc_id"].dataType.simpleString() == "string"
    assert {r["lang_pred"] for r in langs.where("doc_id = 'id1' and lang_pred = 'und'").collect()} == {"und"}
    labels = docs.where("doc_id is not null and text > ''").groupBy("doc_id").agg((F.max("lang") == "xx").cast("int").alias("quality"))
    scores = quality_classifier.quality_scores(docs, labels.union(labels))
    assert scores.count() == len(rows) and scores.where("score between 0 and 1").count() == len(rows)
    assert quality_classifier.quality_scores(docs.limit(0), labels).count() == 0 and language_id.language_id(docs.limit(0)).count() == 0
    rules = quality_rules.quality_rules(docs, labels, carry=True)
    assert rules.count() == len(rows) and rules.select("carried.score").first()[0] == "z"


@needs_tables
def test_pipeline(spark):
    import corpus_pipeline as p
    from spindle.llm import decontaminate, line_dedup, mixing
    from test_dedup import brute_firsts

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    stages = dict(p.STAGES)
    kept = stages["quality_rules"](spark, docs, SF)
    want = {r["doc_id"] for r in quality_rules.quality_rules(docs, labels).where("kept").collect()}
    assert kept.columns == p.COLUMNS and {r["doc_id"] for r in kept.collect()} == want
    cleaned = stages["line_dedup"](spark, kept, SF)
    assert {(r["doc_id"], r["text"]) for r in cleaned.collect()} == {(r["doc_id"], r["text"]) for r in line_dedup.line_dedup(kept, run_chars=1).collect()}
    firsts = stages["simhash_near_dedup"](spark, cleaned, SF)
    assert sorted(r["doc_id"] for r in firsts.collect()) == brute_firsts([(r["doc_id"], r["text"]) for r in cleaned.collect()])
    clean = stages["benchmark_decontamination"](spark, firsts, SF)
    bad = {r["doc_id"] for r in decontaminate.contained_items(firsts, items).collect()}
    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in firsts.collect()} - bad
    assert sorted(map(tuple, p.run(spark, SF).collect())) == sorted(map(tuple, mixing.mix(clean).collect()))


def test_pipeline_keeps_null_and_repeated_ids(spark, tmp_path):
    import corpus_pipeline as p

    line = lambda i: " ".join(f"w{i}x{j}" for j in range(40))
    item = "the answer to this question is known to be forty two"
    rows = [(1, line(1)), (1, "too short"), (1, f"{line(2)} {item}"), (None, line(3)), (None, "too short"), (2, line(1)), (2, line(4)), (None, line(4)), (3, None), (4, ""), (5, line(5)), (5, line(5)), (6, f"{line(6)} x" * 3000)]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or ""), "clash") for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, row string")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = p.stage_rules(spark, docs, str(tmp_path))
    want = [r for r in rows if len((r[1] or "").split()) >= 10 and r[0] != 6]
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted(want, key=str)
    near = p.stage_near(spark, kept, str(tmp_path))
    want = [(1, line(1)), (1, f"{line(2)} {item}"), (None, line(3)), (2, line(4)), (5, line(5))]
    assert sorted(((r["doc_id"], r["text"]) for r in near.collect()), key=str) == sorted(want, key=str)
    clean = p.stage_benchmark(spark, near, str(tmp_path))
    assert sorted(((r["doc_id"], r["text"]) for r in clean.collect()), key=str) == sorted((r for r in want if item not in r[1]), key=str)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert p.run(spark, str(tmp_path)).count() >= 4
    empty = tmp_path / "none"
    for t in ("benchmark", "labels"):
        spark.read.parquet(f"{tmp_path}/{t}.parquet").limit(0).write.parquet(f"{empty}/{t}.parquet")
    docs.limit(0).write.parquet(f"{empty}/documents.parquet")
    assert p.run(spark, str(empty)).count() == 0
