"""The English tokenizer on real sentences, with lexicons of the caller's, small and large, and its entry points."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from tokenloom import api
from tokenloom import lexicon as L
from tokenloom.functions import text as T
from tokenloom.functions import tokens as K
from tokenloom.operators import corpus as C
from tokenloom.operators import datagen as G
from tokenloom.operators import downstream as W
from tokenloom.operators import shared
from tokenloom.operators import stats as S
from tokenloom.sources import readers

SENTENCES = [
    "Will you send the document to the teacher?", "The writer cannot rewrite the book!", "She was in London with the students.", "Unreadable books cost 42 dollars.", "If it rains, the library opens before 3.14 p.m.",
]


def tokens_of(spark, sentences, **options):
    df = spark.createDataFrame(list(enumerate(sentences)), "id int, text string")
    return {r["id"]: r["tokens"] for r in C.tokenize_texts(df, **options).collect()}


def test_real_sentences(spark):
    got = tokens_of(spark, SENTENCES)
    assert got[0][:2] == ["STR:question", "STR:future"] and {"ROOT:send", "CMP:write:instance", "REL:to", "CMP:know:agent", "LIT:the"} <= set(got[0])
    assert {"STR:negation", "STR:emphasis", "CMP:write:agent", "CMP:write:repeat", "REL:negate"} <= set(got[1])
    assert "STR:past" in got[2] and "LIT:london" in got[2] and "CMP:know:plural" in got[2] and "REL:in" in got[2]
    assert {"CMP:know:negate", "ROOT:size"} <= set(got[3])
    assert "STR:condition" in got[4] and "REL:before" in got[4] and "REL:condition" in got[4]


def test_names_come_first(spark):
    lex = C.Lexicon(entities=spark.createDataFrame([("send",), ("before",)], "word string"))
    got = tokens_of(spark, ["send it before noon in 1995"], lexicon=lex)[0]
    assert "LIT:send" in got and "LIT:before" in got and "ROOT:send" not in got
    made = C.emit(C.analyse(spark.createDataFrame([("send",), ("know",)], "word string"), lex), lexicon=lex)
    assert {r["word"]: (r["type"], r["confidence"]) for r in made.collect()} == {"send": ("LIT", 1.0), "know": ("ROOT", 0.8)}


@pytest.mark.parametrize("atomic", [False, True])
def test_large_lexicons_are_joined(spark, monkeypatch, atomic):
    """Tables that fit no literal give the same tokens by joins, also for rows that share an id."""
    df = spark.createDataFrame([(i % 3, t) for i, t in enumerate([*SENTENCES, "", None, SENTENCES[0]])], "id int, text string")
    lex = C.Lexicon(
        lemmas=spark.createDataFrame(list(L.LEMMAS.items()), "word string, lemma string"), fields=spark.createDataFrame(list(L.FIELDS.items()), "spelling string, field string"),
        entities=spark.createDataFrame([(w,) for w in L.ENTITIES], "word string"),
    )
    small = sorted(map(repr, C.tokenize_texts(df, atomic=atomic).collect()))
    monkeypatch.setattr(shared, "few", lambda df, rows=0: None)
    assert sorted(map(repr, C.tokenize_texts(df, atomic=atomic, lexicon=lex).collect())) == small


def test_weights_are_the_tokens_counts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(30)
    each = C.tokenize_english(docs).select("lang", F.explode("tokens").alias("token")).groupBy("lang", "token").count()
    assert sorted(map(tuple, each.collect())) == sorted(map(tuple, C.token_weights(docs, keys=["lang"]).collect()))


def test_sentences_keep_their_marks(spark):
    df = spark.createDataFrame([("It is 3.14! Really? \"Yes.\" Then\nv1.2.3 ends", "en"), ("أ. ب؟ ج", "ar"), (None, "en"), ("", "en")], "t string, l string")
    got = [r["s"] for r in df.select(T.sentences(F.col("t"), F.col("l")).alias("s")).collect()]
    assert got == [["It is 3.14!", "Really?", '"Yes."', "Then", "v1.2.3 ends"], ["أ", "ب", "ج"], None, []]


def test_marks_occur_in_the_corpus(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = {r["token"] for r in C.token_weights(docs).filter("token like 'STR:%'").collect()}
    assert {"STR:emphasis", "STR:past"} <= seen
    lexed = C.sentences(docs).select(F.explode(K.lex_english(F.col("sent"))).alias("t")).filter("t = 'STR:clause_end'")
    assert lexed.count() > 900


def test_read_lexicon(spark, tmp_path):
    (tmp_path / "relation_map.json").write_text(json.dumps({"near": "REL:near", "send": "REL:sent"}))
    (tmp_path / "suffix_roles.json").write_text(json.dumps([["ish", "like"]]))
    (tmp_path / "semantic_fields.json").write_text(json.dumps({"green": "color"}))
    (tmp_path / "entities.json").write_text(json.dumps(["zeus"]))
    lex = readers.read_lexicon(spark, str(tmp_path))
    assert tokens_of(spark, ["send greenish zeus the writer"], lexicon=lex)[0] == ["REL:sent", "CMP:color:like", "LIT:zeus", "LIT:the", "LIT:writer"]


def test_facade(spark):
    df = spark.createDataFrame([(1, "The teacher knows."), (1, "Will it rain?"), (2, "")], "id int, text string")
    made = [r.asDict() for r in api.tokenize(df, "en").collect()]
    assert len(made) == 3 and all(r["tokens"][0] == "[BOS]" and r["tokens"][-1] == "[EOS]" and r["ids"] is None for r in made)
    assert ["[BOS]", "LIT:the", "ROOT:know", "ROLE:causer", "ROOT:know", "ROLE:plural", "[EOS]"] in [r["tokens"] for r in made]
    vocab = spark.createDataFrame([("[UNK]", 1), ("[BOS]", 2), ("[EOS]", 3), ("LIT:the", 7)], "token string, id long")
    ids = [r["ids"] for r in api.tokenize(df, "en", vocab=vocab).collect()]
    assert sorted(ids) == sorted([[2, 7, 1, 1, 1, 1, 3], [2, 1, 1, 1, 1, 1, 3], [2, 3]])
    logic = [r["tokens"] for r in api.tokenize(df, "en", "logic", add_bos_eos=False).collect()]
    assert sum("[Q]" in t for t in logic) == 1
    for bad in ({"lang": "ru"}, {"lang": "en", "level": "deep"}, {"lang": "ar"}):
        with pytest.raises(ValueError):
            api.tokenize(df, **bad)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = _next(row, i, x, b)
    return row[-1]


def _next(old, i, x, b):
    new = [i]
    for j, y in enumerate(b, 1):
        new.append(min(old[j] + 1, new[-1] + 1, old[j - 1] + (x != y)))
    return new


def test_edit_distance_of_tokens(spark):
    rng = random.Random(3)
    pool = ["ROOT:é", "ROOT:中文", "REL:a", "REL:b", "[BOS]", "x" * 50, ""]
    pairs = [([rng.choice(pool) for _ in range(rng.randint(0, 12))], [rng.choice(pool) for _ in range(rng.randint(0, 12))]) for _ in range(60)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a array<string>, b array<string>")
    got = {r["i"]: r["d"] for r in df.select("i", T.edit_distance(F.col("a"), F.col("b")).alias("d")).collect()}
    assert got == {i: distance(a, b) for i, (a, b) in enumerate(pairs)}


def test_edit_distance_query(spark, sf):
    from tokenloom.plans import registry

    turns = {(r["conv_id"], r["turn"]): r["text"] for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()}
    df = spark.createDataFrame([(c, t, x) for (c, t), x in turns.items()], "c long, t long, text string")
    lexed = {(r["c"], r["t"]): (len(r["d"]), r["r"]) for r in df.select("c", "t", K.lex_english(F.col("text")).alias("d")).withColumn("r", K.project_reasoning(F.col("d"), "en")).collect()}
    want: dict = {}
    for c, t in turns:
        if (c, t + 1) in turns:
            want.setdefault(["entails", "neutral", "contradicts"][t % 3], []).append(distance(lexed[c, t][1], lexed[c, t + 1][1]))
    got = {r["label"]: (r["n"], r["mean"], r["median"]) for r in registry.QUERIES["agg_edit_distance_by_label"](spark, sf).filter("kind = 'distance'").collect()}
    assert got == {k: (len(v), pytest.approx(sum(v) / len(v), abs=6e-4), pytest.approx(sorted(v)[len(v) // 2] if len(v) % 2 else sum(sorted(v)[len(v) // 2 - 1 : len(v) // 2 + 1]) / 2)) for k, v in want.items()}


def test_ranks_in_ranges(spark):
    rng = random.Random(1)
    rows = [(rng.choice("aaab"), rng.randrange(50), i) for i in range(500)]
    got = shared.ranked(spark.createDataFrame(rows, "k string, n int, i int"), [F.col("k"), -F.col("n"), F.col("i")], "r").collect()
    want = sorted(rows, key=lambda r: (r[0], -r[1], r[2]))
    assert [tuple(r)[:3] for r in sorted(got, key=lambda r: r["r"])] == want and sorted(r["r"] for r in got) == list(range(1, 501))
    assert shared.ranked(spark.createDataFrame([], "k string"), [F.col("k")], "r").count() == 0


def test_no_growing_rows_in_one_window(spark, sf):
    """Ranks, splits and rotations: what goes through a window without a partition are rows of ranges or keys, never the table's."""
    from tokenloom.plans import registry

    for name in ("split_90_10", "split_shuffled", "split_stratified", "balance_by_answer", "join_rotate", "vocab_first_seen", "win_rank_freq", "cap_vocab_lit"):
        plan = registry.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        for part in plan.split("Window ")[1:]:
            assert "_part" in part.split("\n")[0] or "Aggregate" in part.split("\n")[1], (name, part[:300])


def test_next_of_language(spark):
    rows = [("a", "en", [1]), ("b", "fr", [2]), ("c", "en", [3]), ("d", "de", [4])]
    df = spark.createDataFrame(rows, "id string, lang string, c array<int>")
    assert {r["id"]: r["other"] for r in G.next_of_language(df, "c").collect()} == {"a": [3], "c": [1], "b": [2], "d": [4]}
    assert {r["id"]: r["other"] for r in G.next_of_language(df, "c", fallback=True).collect()} == {"a": [3], "c": [1], "b": [4], "d": [1]}
    alone = G.next_of_language(df.limit(1), "c", fallback=True).collect()
    assert [r["other"] for r in alone] == [[1]] and G.next_of_language(df.limit(0), "c").count() == 0


def test_downstream(spark):
    vocab = spark.createDataFrame([("[UNK]", 1), ("a", 5), ("b", 6)], "token string, id long")
    rows = W.classification(spark.createDataFrame([(1, ["a", "z"], 1), (2, [], 0), (3, ["b"], 0)], "id int, tokens array<string>, label int"), vocab)
    assert sorted(map(tuple, rows.collect())) == [(1, [5, 1], 1), (3, [6], 0)]
    s = W.summary(rows).first()
    assert (s["n"], s["unk_rate"], s["label_counts"]) == (2, pytest.approx(1 / 3), {0: 1, 1: 1})
    asked = spark.createDataFrame([(1, ["a"], [["b"], ["z", "a"]], 1), (2, [], [["b"]], 0), (3, ["a"], [["b"], []], 0), (4, ["a"], [], 0)], "id int, context array<string>, candidates array<array<string>>, gold int")
    made = W.lm_scoring(asked, vocab)
    assert sorted(map(tuple, made.collect())) == [(1, [5], [[6], [1, 5]], 1)] and W.summary(made).first()["unk_rate"] == 0.25


def test_records(spark):
    rows = spark.createDataFrame([(7, " How many? ", "One. Two! Three\nfour #### 3 #### 42 "), (8, "q", "no mark")], "idx long, question string, solution string")
    got = {r["id"]: (r["question"], r["cot"], r["answer"], r["category"]) for r in readers.solution_records(rows).collect()}
    assert got == {"gsm8k-en-000007": ("How many?", ["One.", "Two!", "Three", "four #### 3"], "42", 3), "gsm8k-en-000008": ("q", ["no mark"], "", 3)}
    lines = spark.createDataFrame([('{"id": "1", "lang": "en", "question": "q", "answer": "2", "cot": ["s"], "meta": {"question_cst": ["A:SOLVE"]}}',), ("",)], "text string")
    (r,) = readers.engine_records(lines).collect()
    assert (r["id"], r["cot"], r["meta"]["difficulty"], r["meta"]["license"], r["question_cst"], r["cot_cst"]) == ("algebra-1", ["s"], "medium", "isc", ["A:SOLVE"], None)
    pairs = spark.createDataFrame([(3, "ar", "أ", "ب", 2), (4, "en", " ", "x", 0), (5, "en", None, "x", 0)], "idx long, lang string, premise string, hypothesis string, label int")
    (r,) = readers.nli_records(pairs).collect()
    assert (r["id"], r["answer"]) == ("xnli-ar-0000003", "يناقض") and "هل تستلزم" in r["question"]


def test_parity(spark):
    df = spark.createDataFrame([(["A:x", "B:y"], ["A:x", "B:y"]), (["A:x", "B:y"], ["B:y", "A:x"]), (["A:x"], ["A:z"]), (["A:x"], ["C"])], "a array<string>, b array<string>")
    got = {(r["kind"], r["type"]): tuple(r)[2:] for r in S.parity(df, "a", "b").collect()}
    assert got["rows", ""][:4] == (4, 1, 2, 3) and got["type", "A"][4:] == (4, 3, 25.0) and got["type", "C"][4:] == (0, 1, 100.0)
