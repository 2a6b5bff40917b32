"""Line, substring and SimHash dedup, decontamination: against brute force."""

import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from spindle.llm import common, decontaminate, jaccard, line_dedup, simhash, substring_dedup
from spindle.llm.components import connected_components


def words(t):
    return (t or "").encode().split()


def brute_substrings(rows, k=50):
    first = {}
    for d, t in rows:
        ws = words(t)
        for i in range(len(ws) - k + 1):
            w = tuple(ws[i : i + k])
            if d is not None:
                first[w] = min(first.get(w, d), d)
    out = []
    for d, t in rows:
        ws = words(t)
        gone = set()
        for i in range(len(ws) - k + 1):
            if d is not None and first[tuple(ws[i : i + k])] < d:
                gone |= set(range(i, i + k))
        out.append((d, len(ws), len(gone), hashlib.sha256(b" ".join(w for i, w in enumerate(ws) if i not in gone)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("hot", "longer"), [(substring_dedup.HOT, substring_dedup.LONGER), (1, substring_dedup.LONGER), (1, (16, 32)), (3, ()), (0, (24,))])
def test_substrings(make, texts, hot, longer, monkeypatch):
    monkeypatch.setattr(substring_dedup, "LONGER", longer)
    got = substring_dedup.substring_dedup(make(texts), hot=hot).select("doc_id", "n_words", "n_removed", F.sha2("text", 256)).collect()
    assert sorted(map(tuple, got), key=str) == brute_substrings([r[:2] for r in texts])


def test_a_passage_of_many_documents(make):
    passage = " ".join(f"p{i}" for i in range(80))
    rows = [(i, " ".join(f"a{i}x{j}" for j in range(i % 5 * 20)) + f" {passage} " + " ".join(f"b{i % 3}x{j}" for j in range(60))) for i in range(60)]
    rows += [(100 + i, rows[7][1]) for i in range(20)] + [(3, rows[3][1])]
    got = substring_dedup.substring_dedup(make(rows), hot=8).select("doc_id", "n_words", "n_removed", F.sha2("text", 256)).collect()
    assert sorted(map(tuple, got), key=str) == brute_substrings(rows)


def test_substrings_of_nothing(make):
    assert substring_dedup.substring_dedup(make([])).count() == 0


def test_super_kmers_cover_each_window_once():
    ws = [b"w%d" % (i * i % 37) for i in range(2000)]
    _, s, c = substring_dedup.super_kmers(ws)
    assert s[0] == 0 and (s[1:] == (s + c)[:-1]).all() and s[-1] + c[-1] == len(ws) - 49 and c.max() <= substring_dedup.LONGEST


def brute_lines(rows, chars=40):
    spans = []
    for d, t in rows:
        if d is not None and t is not None:
            own = [(i, x) for i, x in enumerate(t.split("\n")) if x.encode().split()]
            for j in range(len(own)):
                e, n = j, len(own[j][1])
                while n < chars and e + 1 < len(own):
                    e, n = e + 1, n + len(own[e + 1][1])
                if n >= chars or j == 0:
                    spans.append((d, xxhash.xxh64_intdigest(t), j, [i for i, _ in own[j : e + 1]], tuple(x for _, x in own[j : e + 1])))
    first = {}
    for d, _, at, _, content in spans:
        first[content] = min(first.get(content, (d, at)), (d, at))
    gone = defaultdict(set)
    for d, h, at, lines, content in spans:
        if (d, at) > first[content]:
            gone[d, h] |= set(lines)
    out = []
    for d, t in rows:
        cut = gone[d, xxhash.xxh64_intdigest(t)] if t is not None else set()
        out.append((d, None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in cut), len(cut)))
    return sorted(out, key=str)


def lines_of(got):
    return sorted(((r["doc_id"], r["text"], r["n_removed"]) for r in got.collect()), key=str)


def test_lines(make):
    a, b, c, d = (f"line {x} " * 8 for x in "abcd")
    rows = [(1, f"{a}\n{b}\n{c}"), (2, f"x\n{a}\n{b}\n{c}\ny"), (3, f"{b}\n\n{c}\n{a}"), (4, f"{a}\n{a}\n{a}"), (5, "k\nk\nk"), (6, "k\nk"), (7, None), (8, ""), (9, "\n\n"), (2, f"x\n{a}\n{b}\n{c}\ny"), (None, f"{a}\n{b}"), (10, f"{d}\n{a}"), (11, f"{d}\n{a}" * 300), (12, "k\n \nk"), (13, d * 2000), (14, d * 2000), (10, f"\n{d}\nz")]
    got = line_dedup.line_dedup(make(rows))
    assert lines_of(got) == brute_lines(rows)
    assert "rule" in got.columns and "node" in got.columns
    assert line_dedup.line_dedup(make([])).count() == 0


def test_lines_of_many_lengths(make):
    rng = np.random.default_rng(6)
    vocabulary = ["%d " % i * int(n) for i, n in enumerate(rng.integers(1, 16, 14))] + ["", " \t", "é" * 39, "é" * 40, "z" * 41]
    rows = [(int(rng.integers(0, 90)), "\n".join(rng.choice(vocabulary, rng.integers(1, 14)))) for _ in range(120)]
    assert lines_of(line_dedup.line_dedup(make(rows))) == brute_lines(rows)


def test_windows_meet_by_their_fingerprints_alone(make, monkeypatch):
    a = "a line of forty characters or more, so a window"
    rows = [(1, f"{a}\nb"), (2, f"{a}\nc")]
    assert [n for _, _, n in lines_of(line_dedup.line_dedup(make(rows)))] == [0, 1]
    monkeypatch.setattr(line_dedup, "line_hash", lambda line: F.xxhash64(line, F.col("doc_id")))
    assert [n for _, _, n in lines_of(line_dedup.line_dedup(make(rows)))] == [0, 0]


def test_fewer_places_than_windows_are_selected(make):
    docs = make([(1, "\n".join(f"short {i * i % 101}" for i in range(400)))])
    got = line_dedup.places(docs)
    windows = got.select(F.explode("windows")).count()
    assert got.count() < 0.6 * windows and windows > 390


def test_inner_names_may_be_taken(spark, make):
    line = "a line of words that is long enough to count in a run"
    docs = make([(1, f"{line}\n{line} b"), (2, f"{line}\n{line} b\nc"), (None, line)])
    for c in ("__id", "__ROW", "__gone", "fp", "content", "h", "s", "w"):
        docs = docs.withColumn(c, F.lit(c))
    got = line_dedup.line_dedup(docs)
    assert {r["doc_id"]: r["text"] for r in got.collect()}[2] == "c" and set(docs.columns) < set(got.columns)
    items = spark.createDataFrame([(1, f"{line} {line}")], "item_id long, text string")
    kept = decontaminate.decontaminate(docs, items)
    assert kept.columns == docs.columns and [r["doc_id"] for r in kept.collect()] == [None]


def test_lines_plan_has_no_python(make):
    plan = line_dedup.line_dedup(make([(1, "a\nb")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def brute_pairs(docs, items, k=5, least=0.8):
    low = lambda t: [w.lower() for w in words(t)]
    sh = lambda ws, m: {tuple(ws[i : i + m]) for i in range(len(ws) - m + 1)}
    out, by = set(), defaultdict(set)
    for i, t in items:
        ws = low(t)
        if i is not None and ws:
            by[i] |= sh(ws, min(k, len(ws)))
    held = defaultdict(set)
    for d, t in docs:
        if d is not None:
            for m in range(1, k + 1):
                held[d] |= sh(low(t), m)
    for d, have in held.items():
        for i, want in by.items():
            n = len(want & have)
            if n >= least * len(want) - 1e-9:
                out.add((d, i, len(want), n))
    return out


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_BYTES, 0])
def test_contained_items(spark, make, texts, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", limit)
    base = words(texts[4][1])
    item = lambda a, b: b" ".join(base[a:b]).decode()
    items = [(1, item(0, 40)), (2, item(10, 30).upper()), (3, item(0, 20) + " " + " ".join("zzz" for _ in range(30))), (4, item(50, 70) + " zz"), (5, "one"), (6, ""), (7, None), (None, item(0, 9)), (8, item(3, 6)), (1, item(0, 40)), (9, "absent words only here now then")]
    b = spark.createDataFrame(items, "item_id long, text string")
    docs = make(texts)
    got = decontaminate.contained_items(docs, b)
    assert set(map(tuple, got.collect())) == brute_pairs([r[:2] for r in texts], items) and got.count() == len(set(map(tuple, got.collect())))
    kept = decontaminate.decontaminate(docs, b)
    bad = {r[0] for r in brute_pairs([r[:2] for r in texts], items)}
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted((r[0] for r in texts if r[0] not in bad), key=str)
    assert decontaminate.contained_items(make([]), b).count() == 0 and decontaminate.contained_items(docs, b.limit(0)).count() == 0


def test_sketches_are_small_decide_and_miss_nothing(spark, make, monkeypatch):
    rng = np.random.default_rng(8)
    item = [f"i{k}" for k in rng.permutation(400)]
    items, docs = [], []
    for i, n in enumerate((5, 6, 9, 12, 20, 36, 37, 150)):
        items.append((i, " ".join(item[i : i + n])))
        for j in range(30):  # windows broken by changed words, on both sides of the threshold
            ws = items[-1][1].split()
            for at in rng.choice(n, int(rng.integers(0, 1 + n // 20 + 1)), replace=False):
                ws[at] = f"x{j}"
            docs.append((1000 * i + j, " ".join([f"d{i}x{j}y{k}" for k in range(60)] + ws)))
    b = spark.createDataFrame(items, "item_id long, text string")
    sets, _ = decontaminate.item_shingles(b)
    sketch = decontaminate.sketches(sets)
    assert sketch.count() < 0.45 * sets.count()
    want = brute_pairs(docs, items)
    assert set(map(tuple, decontaminate.contained_items(make(docs), b).collect())) == want and 30 < len({d for d, i, *_ in want if i == d // 1000}) < 230
    whole = decontaminate.sketches
    monkeypatch.setattr(decontaminate, "sketches", lambda s, least: whole(s, least).where("item_id <> 5"))
    assert set(map(tuple, decontaminate.contained_items(make(docs), b).collect())) == {p for p in want if p[1] != 5}


def test_repeated_ids_are_judged_by_row(spark, make):
    item = "one two three four five six"
    rows = [(1, f"x {item} y"), (1, "clean text of the same number"), (None, f"{item}"), (None, "clean"), (2, None)]
    kept = decontaminate.decontaminate(make(rows), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert sorted((r["text"] for r in kept.collect()), key=str) == sorted([rows[1][1], item, "clean", None], key=str)


def brute_fingerprint(t):
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode())
    ws = low.split()
    if not ws:
        return 0
    sh = [b" ".join(ws[i : i + 3]) for i in range(max(1, len(ws) - 2))]
    hs = [xxhash.xxh64_intdigest(s, seed=42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps):
    ids = list(fps)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in ids:
        for j in ids:
            if i < j and (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def test_fingerprints_and_groups(make, texts):
    rows = [r for r in texts if r[0] is not None]
    got = {r["doc_id"]: (r["fp"] % (1 << 64), r["component_id"]) for r in simhash.near_duplicates(make(texts)).collect() if r["doc_id"] is not None}
    fps = {d: brute_fingerprint(t) for d, t in rows}
    assert {d: f for d, (f, _) in got.items()} == fps
    assert {d: c for d, (_, c) in got.items()} == brute_components(fps)
    assert simhash.near_duplicates(make([])).count() == 0


def test_spark_hashes_shingles_alike(spark):
    got = spark.createDataFrame([("a b c",)], "s string").select(F.xxhash64("s")).first()[0]
    assert got % (1 << 64) == xxhash.xxh64_intdigest(b"a b c", seed=42)


def test_every_close_pair_meets():
    masks = simhash.covering_masks()
    rng = np.random.default_rng(0)
    for _ in range(2000):
        diff = sum(1 << int(b) for b in rng.choice(64, 3, replace=False))
        assert any(diff & m == 0 for m in masks)
    assert len(masks) == 15 and all(m.bit_count() >= 32 for m in masks)


@pytest.mark.parametrize("split_over", [simhash.SPLIT_OVER, 3])
def test_links_of_crowded_buckets(spark, split_over):
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 1 << 63, 6, dtype=np.int64)
    fps = {int(c) ^ sum(1 << int(b) for b in rng.choice(63, rng.integers(0, 5), replace=False)) for c in centres for _ in range(40)}
    reps = dict(enumerate(sorted(fps)))
    df = spark.createDataFrame(list(reps.items()), "rep long, fp long")
    found = connected_components(simhash.near_links(df, split_over=split_over))
    got = {i: i for i in reps} | {r["node"]: r["component"] for r in found.collect()}
    assert got == brute_components(reps)


def test_linear_search_of_large_groups(monkeypatch):
    rng = np.random.default_rng(4)
    fps = np.unique(np.bitwise_or(rng.integers(0, 1 << 14, 300).astype(np.uint64), np.uint64(7 << 40)))
    small = simhash.linked(fps)
    monkeypatch.setattr(simhash, "PAIRWISE_UP_TO", 10)
    assert (simhash.linked(fps) == small).all()


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (10, 11), (7, 7), (None, 3), (20, 21), (21, 20), *[(100, i) for i in range(101, 140)], *[(i, i + 1) for i in range(200, 260)]]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 10: 10, 11: 10, 20: 20, 21: 20} | {i: 100 for i in range(100, 140)} | {i: 200 for i in range(200, 261)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline_drops_single_repeated_lines(spark, make):
    a, b = "a line that two documents share", "once"
    rows = [(1, f"x 1\n{a}\ny 1"), (2, f"x 2\n{a}\ny 2"), (3, a), (4, f"{b}\n \nx 4"), (5, f"y 5\n{b}"), (None, a)]
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.stage_lines(spark, make(rows), "").collect()}
    seen, want = set(), {None: a}
    for d, t in rows[:-1]:
        want[d] = "\n".join(x for x in t.split("\n") if not x.strip() or x not in seen)
        seen |= set(t.split("\n"))
    assert got == {d: (t, len(t)) for d, t in want.items()}


def brute_firsts(rows, k=5, least=0.8):
    sets = {}
    for d, t in rows:
        ws = (t or "").encode().lower().split()
        sets[d] = {tuple(ws[i : i + k]) for i in range(max(1, len(ws) - k + 1))} if ws else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            x, y = sets[a], sets[b]
            if a < b and len(x & y) >= least * len(x | y) - 1e-9:
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    return sorted(d for d in sets if find(d) == d)


def test_pipeline_links_texts_at_similarity_of_four_fifths(spark, make, texts):
    rng = np.random.default_rng(5)
    rows = [(d, t) for d, t, *_ in texts if d is not None and d != 4] + [(4, texts[4][1])]
    for g in range(12):  # copies with up to a dozen changed words, on both sides of 0.8, chained copies among them
        base = [f"g{g}w{i}" for i in range(150)]
        for i in range(8):
            for j in rng.choice(150, rng.integers(0, 6), replace=False):
                base[j] = f"c{g}x{i}y{j}"
            rows.append((1000 + 10 * g + i, " ".join(base)))
    rows += [(2000 + n, " ".join(f"s{i}" for i in range(n))) for n in (1, 4, 5, 6, 20, 21, 24, 25, 26)]
    got = corpus_pipeline.stage_near(spark, make(rows), "")
    assert sorted(r["doc_id"] for r in got.collect()) == brute_firsts(rows)
    assert corpus_pipeline.stage_near(spark, make([]), "").count() == 0


def test_wide_fingerprints_of_close_pairs_meet():
    rng = np.random.default_rng(6)
    hashes = rng.integers(0, 1 << 63, 700, dtype=np.uint64)
    one = [(int(h) + int(s)) % (1 << 64) for h in hashes[:5] for s in jaccard._SALTS[:1]]
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        one = [(x ^ x >> shift) * factor % (1 << 64) for x in one]
    assert int(jaccard.fingerprint(hashes[:5], 2)[0]) == sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in one) > 5)
    assert (jaccard.fingerprint(hashes, 9)[3:5] == jaccard.fingerprint(hashes, 2, 3)).all() and not jaccard.fingerprint(hashes[:0], 2).any()
    for width in (3, 4, 6):
        blocks = jaccard.blocks_for(width)
        bits = 3 * width * blocks
        for _ in range(100):  # as many differences as never part a pair, as evenly spread as they come
            x = rng.integers(0, 2, 64 * -(-bits // 64)).astype(np.uint8)
            y = x.copy()
            spread = [3 * width * b + int(i) for b in range(blocks) for i in rng.choice(3 * width, 2, replace=False)]
            y[rng.permutation(spread)[: 2 * blocks - 1]] ^= 1
            a, b = jaccard.table_keys(np.stack([np.packbits(v, bitorder="little").view(np.uint64) for v in (x, y)]), width, blocks)
            assert (a == b).any()


def test_share_of_differing_bits_is_bounded():
    drawn = lambda n: np.array([math.comb(n, k) / 2**n for k in range(n + 1)])
    for a in range(4, 30):
        for b in range(a, int(a / 0.8) + 1):
            i = math.ceil(0.8 * (a + b) / 1.8 - 1e-9)  # the least common windows of sets of these sizes at 0.8
            if i <= a:
                up = lambda k, n: sum(p for j, p in enumerate(drawn(n - i)) if 2 * (k + j) > n)  # noqa: E731, B023
                share = sum(p * (up(k, a) * (1 - up(k, b)) + up(k, b) * (1 - up(k, a))) for k, p in enumerate(drawn(i)))
                assert share <= jaccard.differing(0.8, a)


@pytest.mark.parametrize("width", [None, 5])
def test_near_groups_of_crowds(make, width):
    rng = np.random.default_rng(7)
    rows = []
    for g, changes in ((0, 3), (1, 5), (2, 9)):  # crowds of which most, some and few copies are within 0.8 of each other
        for i in range(70):
            copy = [f"g{g}w{j}" for j in range(160)]
            for j in rng.choice(160, rng.integers(0, changes), replace=False):
                copy[j] = f"c{g}x{i}y{j}"
            rows.append((1000 * g + i, " ".join(copy)))
    found = jaccard.near_groups(make(rows).select(F.col("doc_id").alias("row"), "text"), width=width).collect()
    assert sorted({r["group"] for r in found}) == brute_firsts(rows) and len(found) == len(rows)


def test_near_links_come_from_simhash_tables_alone(spark, make, monkeypatch):
    rows = [(i, " ".join(f"w{j}" for j in range(100 + i))) for i in range(3)] + [(3, " ".join(f"w{j}" for j in range(100)))]
    assert {r["doc_id"] for r in corpus_pipeline.stage_near(spark, make(rows), "").collect()} == {0}
    tables = jaccard.buckets
    monkeypatch.setattr(jaccard, "buckets", lambda *a: tables(*a).limit(0))
    assert {r["doc_id"] for r in corpus_pipeline.stage_near(spark, make(rows), "").collect()} == {0, 1, 2}


@pytest.mark.parametrize("bitmaps", [4096, 0])
def test_rows_are_picked_by_number(spark, bitmaps):
    numbers = [None, -(1 << 40), -32769, -32768, -9, -1, 0, 1, 7, 8, 9, 32767, 32768, 32769, 40000, 65536, 1 << 33, (1 << 33) + 5, (1 << 62) + 3]
    df = spark.createDataFrame([(r, f"t{r}") for r in numbers], "row long, text string")
    chosen = [r for i, r in enumerate(numbers) if i % 2] + [12, 12, 7]
    rows = spark.createDataFrame([(r,) for r in chosen], "row long")
    ids = lambda df: sorted((r["row"] is not None, r["row"]) for r in df.collect())
    want = lambda keep: sorted((r is not None, r) for r in numbers if (r in chosen) == keep)
    assert ids(common.picked(df, rows, "picked", bitmaps=bitmaps)) == want(True)
    assert ids(common.picked(df, rows, "picked", others=True, bitmaps=bitmaps)) == want(False)


def test_what_goes_to_every_task_is_bounded(spark):
    """The driver holds a broadcast table; half a million numbers of a table numbered in order are a few kB, and as many pairs aren't broadcast."""
    df = spark.range(1 << 20).withColumnRenamed("id", "row")
    plan = common.picked(df, df.where("row % 2 = 0"), "half")
    assert plan.count() == 1 << 19
    sizes = [e.stats().sizeInBytes() for e in [plan._jdf.queryExecution().optimizedPlan().collectLeaves().apply(1)]]
    assert "BroadcastHashJoin" in plan._jdf.queryExecution().toString() and max(sizes) < 1 << 20
    pairs = spark.range(200_000).select(F.col("id").alias("a"), F.col("id").alias("b"))
    assert "strategy=broadcast" not in common.narrow(pairs, "pairs")._jdf.queryExecution().toString()


def test_rows_of_buckets_are_not_joined(spark, monkeypatch):
    """A set has 51 rows or more in the buckets, so a plan that takes them for as small as the sets would send them to the driver."""
    seen, met = [], jaccard._met
    monkeypatch.setattr(jaccard, "_met", lambda keyed, *more: seen.append(keyed._jdf.queryExecution().optimizedPlan().toString()) or met(keyed, *more))
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base[:50] + [f"x{i}"] + base[51:])) for i in range(6)]
    found = jaccard.near_groups(spark.createDataFrame(rows, "row long, text string")).collect()
    assert {r["group"] for r in found} == {0} and len(seen) == 3 and not any("Join" in p for p in seen)
