"""Prefixes, partners, sketches, manifests, subwords and streams: what the queries on small tables can't show."""

from __future__ import annotations

import collections
import contextlib
import io

import pytest
from pyspark.sql import functions as F

from tokenloom.operators import baselines as B
from tokenloom.operators import corpus as C
from tokenloom.operators import datagen as G
from tokenloom.operators import shared
from tokenloom.operators import sketches as H
from tokenloom.operators import subword as U
from tokenloom.plans import registry
from tokenloom.sources import manifest
from tokenloom.streaming import streams


@pytest.mark.parametrize("values", [[(i * 7919) % 1009 for i in range(1000)], [1] * 500 + [2] * 400 + list(range(3, 103)), [5], []])
def test_prefixes(spark, values):
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v int, i int").repartition(7)
    sizes = [1, 3, 250, 251, 600, 1000, 5000]
    made = collections.defaultdict(list)
    for r in shared.prefixes(df, [F.col("v"), F.col("i")], sizes).collect():
        made[r["scale"]].append((r["v"], r["i"]))
    want = sorted((v, i) for i, v in enumerate(values))
    for s in sizes:
        assert sorted(made[s]) == want[:s]
    assert sorted(r["v"] for r in shared.prefix(df, [F.col("v")], 250).collect()) == sorted(values)[:250]


def test_no_task_holds_a_prefix(spark):
    """Neither a limit nor a window over all rows: what is ordered as a whole is a row for each range."""
    made = shared.prefix(spark.range(10_000).select((F.col("id") * 7 % 9973).alias("k"), "id"), [F.col("k"), F.col("id")], 9_000)
    shown = io.StringIO()
    with contextlib.redirect_stdout(shown):
        made.explain("formatted")
    assert "Limit" not in shown.getvalue() and "TakeOrdered" not in shown.getvalue()
    assert made.count() == 9_000


def test_partners(spark):
    rows = spark.createDataFrame([(f"e{i:03d}", "en") for i in range(40)] + [("a0", "ar"), ("a1", "ar"), ("a2", "ar"), ("f0", "fr")], "id string, lang string")
    made = collections.defaultdict(list)
    for r in G.partners(rows, 5, 3).orderBy("id", "k").collect():
        made[r["id"]].append(r["other"])
    assert len(made) == 44 and all(len(x) == 5 for x in made.values())
    assert all(i not in x for i, x in made.items())
    for i, x in made.items():
        same = [o for o in x if o[0] == i[0]]
        assert len(set(x)) == 5 if i[0] == "e" else len(set(x)) == (2 if i[0] == "a" else 5)
        assert len(same) == (0 if i[0] == "f" else 5)
    times = collections.Counter(o for i, x in made.items() if i[0] == "e" for o in x)
    assert set(times.values()) == {5}
    alone = G.partners(spark.createDataFrame([("x", "en")], "id string, lang string"), 2, 1).collect()
    assert [(r["id"], r["other"]) for r in alone] == [("x", "x")] * 2
    assert {r["other"] for r in G.partners(rows, 5, 4).filter("id = 'e000'").collect()} != set(made["e000"])


def test_verifier_counts(spark):
    rows = [(f"{lang}{i}", lang, "yes" if i % 3 else "no", [f"q{i}"], [[f"s{lang}{i}"]], [f"a{lang}{i}"]) for lang, n in (("en", 12), ("de", 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "id string, lang string, label_name string, q array<string>, cot array<array<string>>, a array<string>")
    counts = {"neg_question_only": 0, "neg_shuffled_cot": 4, "neg_answer_flip": 3, "neg_shuffled_and_flip": 2}
    made = G.verifier_examples(df, counts, seed=2).collect()
    by = collections.defaultdict(list)
    for r in made:
        by[r["source_id"], r["variant"]].append(r)
    label = {r[0]: r[2] for r in rows}
    assert len({r["id"] for r in made}) == len(made)
    for i in (r[0] for r in rows if r[1] == "en"):
        assert len(by[i, "positive"]) == 1 and not by[i, "neg_question_only"]
        steps = [r["input_tokens"][1] for r in by[i, "neg_shuffled_cot"]]
        assert len(steps) == len(set(steps)) == 4 and "s" + i not in steps
        answers = [r["input_tokens"][-1][1:] for r in by[i, "neg_answer_flip"]]
        assert len(answers) == len(set(answers)) == 3 and all(label[x] != label[i] for x in answers)
        both = [(r["input_tokens"][1], r["input_tokens"][-1]) for r in by[i, "neg_shuffled_and_flip"]]
        assert len(set(both)) == 2 and all(s != "s" + i and label[a[1:]] != label[i] for s, a in both)
    assert [r["input_tokens"][1][:3] for r in by["de0", "neg_shuffled_cot"]] == ["sen"] * 4 and not by["de0", "neg_answer_flip"]
    with pytest.raises(ValueError):
        G.verifier_examples(df, {"neg_other": 1})


def test_sketches_merge_without_reading_again(spark):
    path = shared.folder(spark, "sketches")
    parts = {s: spark.range(n).select(F.when(F.col("id") % 3 == 0, "en").otherwise("de").alias("lang"), ((F.col("id") + off) % 30_000).cast("string").alias("token")) for s, n, off in (("one", 20_000, 0), ("two", 25_000, 10_000))}
    assert [H.add_stage(path, s, p) for s, p in parts.items()] == [True, True]
    assert H.add_stage(path, "one", parts["two"]) is False
    every = parts["one"].unionByName(parts["two"])
    exact = {r["lang"]: r["k"] for r in every.groupBy("lang").agg(F.countDistinct("token").alias("k")).collect()}
    got = {r["lang"]: r["estimate"] for r in H.estimated(H.merged(H.stages(spark, path), ["lang"])).collect()}
    assert set(got) == set(exact) and all(abs(got[k] / exact[k] - 1) < 0.03 for k in exact)
    whole = H.estimated(H.merged(H.stages(spark, path), [])).first()
    assert whole["n"] == 45_000 and abs(whole["estimate"] / every.select("token").distinct().count() - 1) < 0.03


def test_manifest_reads_new_files_only(spark):
    folder, at = shared.folder(spark, "records"), shared.folder(spark, "manifest")

    def records(ids, file):
        meta = "named_struct('source', 's', 'license', if(id % 2 = 0, 'mit', null), 'translated_from', null, 'difficulty', null)"
        return spark.createDataFrame([(i,) for i in ids], "id int").selectExpr(f"'{file}' as file", "cast(id as string) as id", "'en' as lang", "id % 2 as category", "'q' as question", "array('s') as cot", "'a' as answer", f"{meta} as meta").repartition(2)

    manifest.write_records(records(range(6), "one"), folder)
    first = manifest.update(spark, folder, at)
    assert first == 2 and manifest.update(spark, folder, at) == 0
    manifest.write_records(records(range(4), "two"), folder)
    manifest.write_records(records([9], "one").coalesce(1), folder)
    assert manifest.update(spark, folder, at) == 3
    made = {(r["file"], r["kind"], r["key"]): r["n"] for r in manifest.summary(spark, at).collect()}
    assert made["one", "total", ""] == 7 and made["two", "total", ""] == 4
    assert made["one", "license", "mit"] == 3 and made["one", "license", None] == 4 and made["two", "category", "1"] == 2


def test_pieces_are_the_models(spark, sf):
    sentencepiece = pytest.importorskip("sentencepiece")
    model = sentencepiece.SentencePieceProcessor(model_file=U.model_path())
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(20)
    sents = C.sentences(docs).select("doc_id", "lang", "pos", "sent", F.split("sent", " ").alias("tokens"))
    own = sents.withColumn("tokens", F.transform("tokens", lambda t: F.when(t.rlike("^[a-m]"), F.concat(F.lit("LIT:"), t)).otherwise(t)))
    both = U.with_pieces(own.unionByName(own.limit(1).withColumn("sent", F.lit(None).cast("string"))), "sent")
    vocab = C.by_frequency(C.token_counts(own), "r").filter("r <= 200").select("token", (F.col("r") + 1).alias("id"))
    ids = {r["token"]: r["id"] for r in vocab.collect()}
    size = max(ids.values()) + 1
    literal = {i for t, i in ids.items() if t.startswith("LIT:")}
    appended = 0
    for r in U.literal_free(both, vocab).collect():
        assert r["pieces"] == (None if r["sent"] is None else model.encode(r["sent"]))
        stream = [ids.get(t, 1) for t in r["tokens"]]
        kept = [i for i in stream if i not in literal]
        if len(kept) < len(stream):
            kept += [p + size for p in r["pieces"] or []]
            appended += 1
        assert r["ids"] == kept
    assert appended > 10
    want = collections.Counter()
    for r in both.filter("sent is not null").collect():
        if len(p := model.encode(r["sent"])) >= 3:
            want[r["lang"], "sentences"] += 1
            want[r["lang"], "pieces"] += len(p)
            want[r["lang"], "tokens"] += len(r["tokens"])
    for r in U.compression(both.filter("sent is not null"), ["lang"]).collect():
        assert all(r[c] == want[r["lang"], c] for c in ("sentences", "pieces", "tokens"))
        assert abs(r["ratio"] - r["tokens"] / r["pieces"]) < 1e-6


def test_demo_encoder_tries_twice(spark):
    known = spark.createDataFrame([("go", "REL:go"), ("stop!", "REL:stop"), ("far", "REL:far")], "word string, token string")
    vocab = spark.createDataFrame([("REL:go", 5), ("REL:stop", 6), ("SURF:hi", 7), ("SURF:hi!", 8), ("SURF:ho!", 9)], "token string, id int")
    df = spark.createDataFrame([(1, " go!:  stop! far hi! ho! xyz؟ "), (2, ""), (3, None)], "id int, text string")
    made = {r["id"]: r["ids"] for r in B.demo_ids(df, known, vocab, begin=2, unknown=1).collect()}
    assert made == {1: [2, 5, 6, 1, 7, 9, 1], 2: [2], 3: [2]}


def test_streams_read_their_table_alone(spark, sf):
    """A neighbour whose name begins alike is not read, whether the table is a file or a folder."""
    at = shared.folder(spark, "neighbours")
    df = spark.createDataFrame([(1, "All men walk."), (2, "No dogs.")], "doc_id long, text string")
    for name in ("documents.parquet", "documents.parquet_old", "documents.parquet2"):
        df.coalesce(1).write.parquet(f"{at}/{name}")
    assert sum(r["n"] for r in streams.count_once(spark, f"{at}/documents.parquet").collect()) == 6 + 5
    file = df.limit(1).coalesce(1)
    file.write.parquet(f"{at}/alone")
    name = spark.read.parquet(f"{at}/alone").inputFiles()[0]
    assert streams.tokenize_once(spark, name).count() == 1


def test_late_events_are_dropped(spark, sf):
    """The query's rows are those of the SQL without the late events; with them there would be more."""
    made = registry.QUERIES["stream_windowed_coverage"](spark, sf)
    assert made.columns == ["day", "event_type", "n", "tokens", "structured"]


def test_queries_without_sql(spark, sf):
    """What SQL can't check is checked by its parts here or elsewhere; these only have to hold together."""
    spm = registry.QUERIES["base_spm"](spark, sf).collect()
    assert {r["lang"] for r in spm} == {r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("lang").distinct().collect()}
    assert all(r["pieces"] >= 3 * r["sentences"] and r["chars"] > r["pieces"] for r in spm)


def test_texts_of_one_row_group_are_dealt_out(spark):
    at = shared.folder(spark, "large")
    spark.range(2_000).selectExpr("id as doc_id", "'All men walk.' as text").coalesce(1).write.parquet(f"{at}/documents.parquet")
    made = registry.read(spark, at, "documents")
    sizes = [r["count"] for r in made.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 2_000 == made.select("doc_id").distinct().count() and max(sizes) < 1_000
    few = spark.range(20).selectExpr("id as doc_id").coalesce(1)
    assert shared.spread(few, "doc_id") is few


def test_streams_meet_as_sums(spark):
    """Rows of a key and an instant are one row of the join's state, and each event still counts with each text."""
    at = shared.folder(spark, "sums")
    minute = "timestamp_seconds(1704067200 + {} * 60)"
    texts = spark.range(600).selectExpr("id % 2 as key", f"{minute.format('(id % 10) * 7')} as ts", "concat('All men walk. ', if(id % 3 = 0, 'No dogs.', '')) as text")
    events = spark.range(900).selectExpr("id % 2 as key", f"{minute.format('60 + (id % 6) * 5')} as ts", "if(id % 4 < 2, 'a', 'b') as event_type")
    last = "timestamp '2024-01-09'"
    texts.unionByName(spark.sql(f"select 9L as key, {last} as ts, '' as text")).coalesce(1).write.parquet(f"{at}/texts")
    events.unionByName(spark.sql(f"select 9L as key, {last} as ts, 'a' as event_type")).coalesce(1).write.parquet(f"{at}/events")
    left, right = (streams.source(spark, f"{at}/{n}", df.schema) for n, df in (("texts", texts), ("events", events)))
    made = streams.windowed_coverage(left, right, width="1 day", within="1 hour", delay="2 hours")
    running = made.writeStream.format("memory").queryName("sums").trigger(availableNow=True).start()
    running.awaitTermination()
    updated = [o["numRowsUpdated"] for p in running.recentProgress for o in p["stateOperators"] if o["operatorName"] == "symmetricHashJoin"]
    assert 0 < sum(updated) <= 2 * 2 * 10 + 2 * 2 * 6 + 3  # texts are in two slots
    want = collections.Counter()
    minutes = collections.Counter((r["key"], r["ts"], r["text"]) for r in texts.collect())
    for e, n in collections.Counter((r["key"], r["ts"], r["event_type"]) for r in events.collect()).items():
        for t, m in minutes.items():
            if t[0] == e[0] and 0 <= (e[1] - t[1]).total_seconds() <= 3600:
                want[e[2], "n"] += n * m
                want[e[2], "tokens"] += n * m * (7 if "dogs" in t[2] else 4)
    got = {r["event_type"]: r for r in spark.table("sums").collect()}
    assert set(got) == {"a", "b"}
    assert all(got[t][c] == v for (t, c), v in want.items())


@pytest.mark.parametrize("name", ["ids_permute", "ngram_lm", "greedy_decode_segments", "lit_cap_zero_words", "agg_distinct_sketches"])
def test_texts_are_lexed_once(spark, sf, name):
    """What is read several times is stored, so that no plan lexes texts again for each reader."""
    assert "[A-Za-z][A-Za-z'" not in registry.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
