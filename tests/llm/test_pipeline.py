"""The pipeline's stages against brute force, and the registered queries on small tables."""

from __future__ import annotations

import os
import random
import sys

import pyarrow as pa
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from compare import duck, rows  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

import corpus_pipeline as pipeline  # noqa: E402
from tokenloom.llm import common, quality, queries, simhash, suffixes  # noqa: E402


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf, name):
    made = queries.QUERIES[name](spark, sf)
    own = made.toPandas()
    assert list(own.columns) == made.columns and len(own) > 0
    if name in queries.ORACLE_SQL:
        assert rows(own) == rows(duck(sf, queries.ORACLE_SQL[name]))


def like(a: set, b: set) -> bool:
    return 5 * len(a & b) >= 4 * len(a | b)


def test_stages(spark, sf):
    docs = common.documents(spark, sf)
    before = docs
    for name, stage in pipeline.STAGES[:-1]:
        after = common.stored(stage(spark, before, sf))
        assert after.columns == docs.columns
        old, new = ({r["doc_id"]: r["text"] for r in d.select("doc_id", "text").collect()} for d in (before, after))
        assert set(new) <= set(old) and new
        if name == "quality_classifier":
            labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
            good = [i for i in old if labels.get(i) == 1]
            assert sum(i in new for i in good) >= 0.98 * len(good) and all(new[i] == old[i] for i in new)
        elif name == "line_dedup":
            assert set(new) == set(old)
            for i, t in new.items():
                own = t.split("\n")
                it = iter(old[i].split("\n"))
                assert all(line in it for line in own)  # a subsequence of the lines
        elif name == "simhash_near_dedup":
            sets = {i: set(simhash.shingle_set((t or "").encode()).tolist()) for i, t in old.items()}
            kept, gone = sorted(new), sorted(set(old) - set(new))
            assert not any(like(sets[a], sets[b]) for n, a in enumerate(kept) for b in kept[:n])
            assert gone and all(any(like(sets[a], sets[b]) for b in old if b != a) for a in gone)
        else:
            ids = sorted(old)
            want = dict(zip(ids, suffixes.brute_force([old[i].encode() for i in ids])))
            assert all(len(old[i].encode()) - want[i][0] >= len(new[i].encode()) >= len(old[i].encode()) - want[i][0] - 8 * max(1, want[i][1]) for i in ids)
        before = after
    packed = pipeline.STAGES[-1][1](spark, before, sf)
    total = packed.agg(F.sum("length"), F.countDistinct("sequence_id")).first()
    assert total[1] <= -(-total[0] // 4096) + 1


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(None, "a " * 50, "en", "s", 1), (1, None, None, None, None), (1, None, None, None, None), (2, "", "en", "s", 0), (3, "b\n" * 10, "en", "s", 2), (None, None, "en", None, None), (3, "c d e f g h", "en", "s", 2)]


def test_quality_stage_on_odd_rows(spark, sf):
    """Just the rows go whose score is below the threshold, whatever is null, empty, shared or repeated."""
    docs = common.stored(common.documents(spark, sf).select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame(ODD, COLUMNS)))
    model = quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    rows_ = docs.collect()
    scores = model.score(quality.text_features(*common.flat_text(pa.array([r["text"] for r in rows_]))))
    want = sorted(repr(tuple(r)) for r, s in zip(rows_, scores) if s >= quality.THRESHOLD)
    assert sorted(repr(tuple(r)) for r in pipeline.stage_quality(spark, docs, sf).collect()) == want and 0 < len(want) < len(rows_)
    assert pipeline.stage_quality(spark, docs.limit(0), sf).count() == 0


def test_stages_take_odd_rows(spark, sf):
    """Each stage's rows for null, empty, shared and repeated rows."""
    docs = common.stored(spark.createDataFrame(ODD, COLUMNS))
    kept = {name: sorted(repr((r["doc_id"], r["text"])) for r in stage(spark, docs, sf).collect()) for name, stage in pipeline.STAGES[1:4]}
    every = [(i, t) for i, t, *_ in ODD]
    assert kept["line_dedup"] == sorted(map(repr, every))
    # texts without words are alike: the row without an id comes first
    assert kept["simhash_near_dedup"] == sorted(map(repr, [(None, "a " * 50), (None, None), (3, "b\n" * 10), (3, "c d e f g h")]))
    assert kept["suffix_array_dedup"] == sorted(map(repr, every))
    packed = pipeline.stage_packing(spark, docs, sf).collect()
    assert len(packed) == len(ODD) and sorted(r["length"] for r in packed)[:4] == [1, 1, 1, 1] and len({r["sequence_id"] for r in packed}) == 1
    made = docs.limit(0)
    for _, stage in pipeline.STAGES[1:]:
        made = common.stored(stage(spark, made, sf))
        assert made.count() == 0


def test_run_keeps_what_it_returns(spark, sf):
    before = common.mark()
    made = pipeline.run(spark, sf)
    assert made.count() > 0 and made.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert len(common.mark() - before) == 1


def test_near_stage_links_by_likeness_of_texts(spark, sf):
    """Texts of a likeness of 0.8 or more are linked however far their 64-bit fingerprints are, and no others."""

    def pair(letter, n, edits):
        words = [f"{letter}{k}" for k in range(n)]
        own = list(words)
        for k in range(edits):
            own[(9 + n // 10 * k) % n] = f"new{edits}x{k}"
        x, y = ({tuple(w[i : i + 5]) for i in range(n - 4)} for w in (words, own))
        texts = [" ".join(words), " ".join(own)]
        a, b = (simhash.fingerprint(t.encode(), 5) for t in texts)
        return texts, len(x & y) / len(x | y), (a ^ b).bit_count()

    near, far = pair("y", 100, 2), pair("w", 400, 10)
    assert near[1] >= 0.8 and near[2] > 6
    assert far[1] < 0.8 and far[2] <= 6
    docs = spark.createDataFrame([(n, t, "en", "s", len(t)) for n, t in enumerate(near[0] + far[0])], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"] for r in pipeline.stage_near(spark, common.stored(docs), sf).collect()} == {0, 2, 3}


def test_near_stage_recall(spark, sf):
    """Of near copies at a likeness of 0.8 to 0.9 to their text, each alone with it, at least nine in ten go."""
    rng = random.Random(11)
    rows_, wanted = [], set()
    for k in range(400):
        words = [rng.choice("abcdefghij") + str(rng.randrange(3000)) for _ in range(rng.randint(60, 400))]
        own = list(words)
        while True:  # deletions, insertions and replacements until just above the threshold
            x, y = (set(simhash.shingle_set(" ".join(w).encode()).tolist()) for w in (words, own))
            if not like(x, y):
                own = last
                break
            last, at, how = list(own), rng.randrange(len(own)), rng.randrange(3)
            own[at : at + (how != 1)] = [] if how == 0 else [f"n{rng.randrange(10**6)}"]
        rows_ += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(own))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows_], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in pipeline.stage_near(spark, common.stored(docs), sf).collect()}
    assert set(range(0, 800, 2)) <= kept
    found = 800 - len(kept)
    print(f"recall just above the threshold: {found / 400:.3f}")
    assert found >= 0.9 * 400


def test_near_stage_against_brute_force(spark, sf):
    docs = common.documents(spark, sf)
    for _, stage in pipeline.STAGES[:2]:
        docs = common.stored(stage(spark, docs, sf))
    sets = {}
    for r in docs.select("doc_id", "text").collect():
        w = (r["text"] or "").encode().lower().split()
        sets[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    root = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            if j < i and root[i] != root[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = {k: new if r == old else r for k, r in root.items()}
    got = {r["doc_id"] for r in pipeline.stage_near(spark, docs, sf).collect()}
    assert got == set(root.values()) and len(got) < len(sets)


def test_near_stage_tells_rows_apart(spark, sf):
    """Rows with equal or no ids go only if their texts are near others, and then the copy, not the clean one."""
    unlike = [" ".join(f"{c}{n}" for n in range(50)) for c in "abcdef"]
    rows_ = [
        (None, unlike[0]), (None, unlike[1]),  # no id, unlike texts
        (7, unlike[2]), (7, unlike[3]),  # one id, unlike texts
        (7, unlike[2]),  # a repeated row
        (3, unlike[4]), (9, unlike[4]), (9, unlike[5]),  # a copy shares its id with a clean text
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows_], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((r["doc_id"] or 0, r["text"]) for r in pipeline.stage_near(spark, common.stored(docs), sf).collect())
    assert got == sorted([(0, unlike[0]), (0, unlike[1]), (7, unlike[2]), (7, unlike[3]), (3, unlike[4]), (9, unlike[5])])
