"""Jaccard join, vector codes and resampling against brute force: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokenloom.llm import codes, common, partenum, resample, simhash
from tokenloom.operators import shared

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
VOCABULARY = "the of and river stone écran über 中文 naïve light under mountain gold seven grass o'clock it's 1995 MIT license Apache".split()


def text(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(VOCABULARY) + str(rng.randrange(50)) for _ in range(n))


def edited(rng: random.Random, t: str, n: int) -> str:
    w = t.split(" ")
    for _ in range(n):
        w[rng.randrange(len(w))] = "changed" + str(rng.randrange(10**6))
    return " ".join(w)


def rows(seed: int = 3) -> list[tuple]:
    """Ids and texts with copies, chains of near copies, nulls, empty and short texts, repeated rows and shared ids."""
    rng = random.Random(seed)
    made = [text(rng, rng.randint(1, 200)) for _ in range(40)]
    for _ in range(30):
        t = rng.choice(made)
        made.append(edited(rng, t, rng.choice([0, 1, 1, 2, 3])) if len(t.split()) > 20 else t)
    made += [None, "", " \n\t", "one", "One two", "ONE TWO", "one two three", "a b c a b c a b c", "é" * 400, text(rng, 20_000)]
    made.append(edited(rng, made[-1], 200))
    return list(enumerate(made)) + [(None, made[0]), (3, made[3]), (3, made[3]), (5, "other text under an id that is there"), (None, None)]


def shingles(t: str | None, size: int) -> frozenset:
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
    return frozenset(" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def brute_join(given: list[tuple], size: int = 3, num: int = 90, den: int = 100) -> list[str]:
    sets = [shingles(t, size) for _, t in given]
    low = [common.NULL_ID if i is None else i for i, _ in given]
    root = list(range(len(given)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(given)):
        for b in range(a):
            if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    best = {}
    for i in range(len(given)):
        best[find(i)] = min(best.get(find(i), low[i]), low[i])
    real = lambda x: None if x == common.NULL_ID else x
    return sorted(repr((given[i][0], len(sets[i]), real(best[find(i)]))) for i in range(len(given)))


def table(spark, given):
    """Columns that clash with names inside the operators are there too, and not looked at."""
    df = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in given], "doc_id long, text string, node string, n int, root string")
    return df.repartition(5)


def test_join_against_brute_force(spark):
    given = rows()
    got = partenum.joined(table(spark, given)).collect()
    assert sorted(map(repr, map(tuple, got))) == brute_join(given)
    assert partenum.joined(table(spark, given).limit(0)).count() == 0


@pytest.mark.parametrize("likeness, size", [((1, 2), 2), ((8, 10), 5), ((1, 1), 3)])
def test_join_at_other_thresholds(spark, likeness, size):
    given = rows(5)[:60]
    got = partenum.joined(table(spark, given), likeness=likeness, size=size).collect()
    assert sorted(map(repr, map(tuple, got))) == brute_join(given, size, *likeness)


def test_join_of_groups_over_many_blocks(spark, monkeypatch):
    """Large groups, of copies near each other and of texts that only nearly are, are compared block by block."""
    monkeypatch.setattr(simhash, "SETS", 6)
    rng = random.Random(8)
    base, given = text(rng, 150), []
    given += [edited(rng, base, 1) for _ in range(60)]
    far = text(rng, 150)
    given += [edited(rng, far, 4) for _ in range(40)]
    walk = text(rng, 150)
    for _ in range(30):
        given.append(walk)
        walk = edited(rng, walk, 2)
    given = list(enumerate(given))
    rng.shuffle(given)
    got = partenum.joined(table(spark, given)).collect()
    assert sorted(map(repr, map(tuple, got))) == brute_join(given)


def test_alike_sets_share_a_signature():
    """At and just above the threshold, for all sizes, also of sets that only one band's end parts."""
    rng = np.random.default_rng(4)
    bands = partenum.Bands((90, 100))
    met = far = 0
    for trial in range(3_000):
        n = int(rng.integers(1, 60)) if trial % 2 else int(rng.integers(60, 900))
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        gone, more = int(rng.integers(0, n // 9 + 2)), int(rng.integers(0, n // 9 + 2))
        b = np.unique(np.concatenate([a[gone:], rng.integers(0, 1 << 63, more, dtype=np.uint64)]))
        a = np.unique(a)
        if not len(b):
            continue
        both = len(np.intersect1d(a, b))
        if 100 * both >= 90 * (len(a) + len(b) - both) and both < max(len(a), len(b)):
            assert len(np.intersect1d(partenum.signatures(a, bands), partenum.signatures(b, bands)))
            met += 1
        elif 2 * both < len(a):
            far += len(np.intersect1d(partenum.signatures(a, bands), partenum.signatures(b, bands))) > 0
    assert met > 500 and far == 0


def test_tree_finds_the_first_of_equals():
    rng = np.random.default_rng(1)
    for n, d, span in ((1, 3, 5), (5, 1, 2), (64, 4, 3), (64, 4, 400), (40, 2, 1), (33, 0, 9), (200, 3, 6)):
        entries = rng.integers(-span, span + 1, (n, d))
        queries = rng.integers(-span - 2, span + 3, (500, d))
        index, dist = codes.Tree(entries).nearest(queries)
        every = ((queries[:, None, :] - entries[None]) ** 2).sum(axis=2)
        assert (index == every.argmin(axis=1)).all() and (dist == every.min(axis=1)).all()


def brute_codes(given: list[tuple], parts: int, entries: int, rounds: int) -> list[str]:
    kept = [(i, [math.floor(256 * x) for x in v], lab) for i, v, lab in given if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    size = len(kept[0][1]) // parts
    cut = [[tuple(v[p * size : (p + 1) * size]) for p in range(parts)] for _, v, _ in kept]
    first = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))[:entries]
    books = [[cut[k][p] for k in first] for p in range(parts)]

    def near(book, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), j) for j, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            mine = {}
            for c in cut:
                mine.setdefault(near(books[p], c[p])[1], []).append(c[p])
            books[p] = [tuple(sum(col) // len(mine[j]) for col in zip(*mine[j])) if j in mine else e for j, e in enumerate(books[p])]
    found = [[near(books[p], c[p]) for p in range(parts)] for c in cut]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    total = {}
    for (_, _, lab), f in zip(kept, found):
        total[lab] = total.get(lab, 0) + sum(d for d, _ in f)
    return sorted(repr((i, "".join(f"{j:02x}" for _, j in f), sum(d for d, _ in f), total[lab], digest)) for (i, _, lab), f in zip(kept, found))


def vectors(seed: int, n: int, span: float, dims: int) -> list[tuple]:
    rng = random.Random(seed)
    made = [(i, [round(rng.uniform(-span, span) * 256) / 256 - rng.choice([0, 0.001]) for _ in range(dims)], rng.choice([None, 1, 1, 1, 2])) for i in range(n)]
    made += [(n, None, 1), (n + 1, [None] * dims, 2), (n + 2, [float("nan")] + [0.0] * (dims - 1), 1), (n + 3, [float("inf")] * dims, None), (None, [0.25] * dims, 7), (5, [0.5] * dims, 1), (5, [0.5] * dims, 1)]
    rng.shuffle(made)
    return made


def coded(spark, given, parts, entries, rounds):
    schema = "vec_id long, embedding array<double>, label int, error string, v int, indexes string, label_error int"
    df = spark.createDataFrame([(*r, "x", 1, "y", 2) for r in given], schema).repartition(4)
    books = codes.train(df, parts=parts, entries=entries, rounds=rounds)
    made = codes.label_errors(common.stored(codes.encode(df, books)))
    return books, made


@pytest.mark.parametrize("n, span, dims, parts, entries, rounds", [(300, 2.0, 32, 16, 64, 2), (300, 0.01, 8, 4, 64, 2), (90, 0.004, 4, 4, 200, 3), (10, 1.0, 16, 16, 64, 2), (0, 1.0, 16, 16, 64, 2)])
def test_codes_against_brute_force(spark, n, span, dims, parts, entries, rounds):
    """Wide vectors, and narrow ones whose parts tie all the time; fewer vectors than entries."""
    given = vectors(n, n, span, dims)
    books, made = coded(spark, given, parts, entries, rounds)
    got = [repr((r["vec_id"], "".join(f"{x:02x}" for x in r["indexes"]), r["error"], r["label_error"], codes.digest(books))) for r in made.collect()]
    assert sorted(got) == brute_codes(given, parts, entries, rounds)
    back = codes.decode(made, books).select("indexes", "vector").first()
    assert back["vector"] == [x / 256 for b, j in zip(books, back["indexes"]) for x in b[j].tolist()]


def test_codes_of_nothing(spark):
    for given in ([], [(1, None, 1)]):
        books, made = coded(spark, given, 16, 64, 2)
        assert books == [] and made.count() == 0 and made.columns == ["vec_id", "label", "indexes", "error", "label_error"]
    with pytest.raises(Exception, match="components"):
        coded(spark, [(1, [0.0] * 16, 1), (2, [0.0] * 32, 1)], 16, 64, 1)
    with pytest.raises(Exception, match="scale the vectors"):
        coded(spark, [(1, [1e9] * 16, 1)], 16, 64, 1)


def brute_draw(given: list[tuple], target: list, longest: int, buckets: int, least: int, percent: int) -> list[str]:
    def features(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
        return w, [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    own, other = [features(t) for _, t in given], [f for t in target for f in features(t)[1]]
    s, t = {}, {}
    for f in (f for _, fs in own for f in fs):
        s[f] = s.get(f, 0) + 1
    for f in other:
        t[f] = t.get(f, 0) + 1
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {f: math.floor(1000 * math.log((t.get(f, 0) + 1) * (all_s + buckets) / ((s[f] + 1) * (all_t + buckets)))) for f in s}
    made = []
    for (i, _), (w, fs) in zip(given, own):
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[f] for f in fs)
        made.append((i, len(w), len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((x for x in made if x[1] >= least), key=lambda x: (-x[4], x[0] is None, x[0] or 0, x[2], x[3]))
    drawn = able[: percent * len(able) // 100]
    out = [(i, n, weight, score, k + 1) for k, (i, _, n, weight, score) in enumerate(drawn)]
    rest = able[len(drawn) :] + [x for x in made if x[1] < least]
    return sorted(map(repr, out + [(i, n, weight, score, None) for i, _, n, weight, score in rest]))


@pytest.mark.parametrize("longest, buckets, least, percent, held", [(1, 10_000, 20, 10, 1 << 20), (2, 64, 3, 50, 100), (3, 7, 0, 100, 5)])
def test_resampling_against_brute_force(spark, monkeypatch, longest, buckets, least, percent, held):
    """Few buckets and small steps too, so that every bucket has many records and every row many contributions."""
    monkeypatch.setattr(resample, "HELD", held)
    given = rows(7)
    rng = random.Random(2)
    target = [text(rng, 60), None, "", "Gold 7; gold. river3"]
    docs = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in given], "doc_id long, text string, weight int, rank int, bucket string").repartition(5)
    goal = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = resample.resampled(docs, goal, longest=longest, buckets=buckets, least_words=least, percent=percent)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(repr, map(tuple, got.collect()))) == brute_draw(given, target, longest, buckets, least, percent)


def test_resampling_without_rows(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = docs.limit(0)
    assert resample.resampled(none, docs).count() == 0
    assert [tuple(r) for r in resample.resampled(docs, none, least_words=1, percent=100).collect()] == [eval(x) for x in brute_draw([(1, "a b c")], [], 1, 10_000, 1, 100)]


def test_gains_above_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(shared, "BROADCAST_ROWS", 1)
    given = rows(7)[:20]
    docs = spark.createDataFrame(given, "doc_id long, text string")
    got = resample.resampled(docs, docs.limit(3))
    assert sorted(map(repr, map(tuple, got.collect()))) == brute_draw(given, [r["text"] for r in docs.limit(3).collect()], 1, 10_000, 20, 10)


def test_postings_are_dealt_in_slices(spark):
    """A bucket that all rows have is many records, in many parts."""
    docs = spark.range(4_000).select("id", F.lit("same words here").alias("text")).repartition(16)
    raw = resample.postings(resample.counted(docs, id_col="id"))
    by = raw.withColumn("p", F.spark_partition_id()).groupBy("bucket").agg(F.sum("total").alias("n"), F.count("*").alias("records")).collect()
    assert {r["n"] for r in by} == {4_000} and all(r["records"] > 1 for r in by)
