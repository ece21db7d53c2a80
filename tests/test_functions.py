"""Vectors worked out by hand from the rules, and properties of projections and vocabularies."""

from __future__ import annotations

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tokenloom.functions import text as T
from tokenloom.functions import tokens as K
from tokenloom.operators import corpus as C
from tokenloom.operators import generators as N
from tokenloom.operators import reasoning as R
from tokenloom.operators import shared
from tokenloom.operators import stats as S
from tokenloom.sources import readers


def one(spark, value, kind, f):
    df = spark.createDataFrame([(value,)], f"x {kind}").withColumn("x", F.col("x"))
    return df.select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("sentence", "want"),
    [
        ("Will you send the document?", "[BOS] AUX:will ROOT:you ROOT:send DET:the ROOT:document STR:question [EOS]"),
        ("a, b!", "[BOS] DET:a ROOT:, ROOT:b ROOT:! [EOS]"),
        ("", "[BOS] [EOS]"),
    ],
)
def test_lexer(spark, sentence, want):
    assert " ".join(one(spark, sentence, "string", K.lex_english)) == want


def test_reasoning_projection(spark):
    tokens = one(spark, "Will you send the document?", "string", K.lex_english)
    assert one(spark, tokens, "array<string>", lambda x: K.project_reasoning(x, "en")) == "[BOS] STR:future ROOT:you ROOT:send ROOT:document STR:question [EOS]".split()


def test_dropped_token_does_not_break_adjacency(spark):
    tokens = "REL:and REL:and DET:the REL:and ROOT:x ROOT:x".split()
    df = spark.createDataFrame([(tokens,)], "x array<string>").withColumn("k", K.reasoning_kept(F.col("x"), "en")).select(K.reasoning_collapse(F.col("k")).alias("y"))
    assert df.first()["y"] == ["REL:and", "ROOT:x", "ROOT:x"]


def test_unknown_language_is_an_error(spark):
    with pytest.raises(ValueError):
        K.project_reasoning(F.col("x"), "ru")


@pytest.mark.parametrize(
    ("formula", "want"),
    [
        ("2*x + 3 = 7", "N:SMALL A:TIMES V:X A:PLUS N:SMALL R:EQUALS N:SMALL"), ("(p ∧ q) → r", "L:LPAREN V:P L:AND V:Q L:RPAREN L:IMPL V:R"),
        ("x >= 0 and y != 1", "V:X R:GE N:ZERO L:AND V:Y R:NE N:ONE"), ("1000 - 42", "N:LARGE A:MINUS N:SMALL"), ("exists ∃", "Q:EXISTS Q:SOME"),
    ],
)
def test_formal(spark, formula, want):
    assert " ".join(one(spark, formula, "string", K.lex_formal)) == want


def test_logic_projection(spark):
    tokens = "CMP:move:agent FEAT:asp:p FEAT:def FEAT:3ms REL:to".split()
    assert one(spark, tokens, "array<string>", K.logic_parts) == ["C:ACTION", "RO:AGENT", "T:PAST"]
    assert one(spark, ["REL:by"], "array<string>", K.logic_parts) == ["[UNK]"]
    assert one(spark, ["ROOT:x.y.z", "NUM:other", "PAT:1", "NE:a", "LIT:b"], "array<string>", K.logic_parts) == ["C:CONCEPT", "N:INT", "C:PERSON", "[UNK]"]


@pytest.mark.parametrize(
    ("word", "lemma", "root", "role"),
    [("unreadable", "read", "readable", "negate"), ("country", "country", "untry", "mutual"), ("writer", "write", "write", "agent"), ("students", "student", "student", "plural"), ("send", "send", "send", None), ("red", "red", "red", None)],
)
def test_decompose(spark, word, lemma, root, role):
    df = spark.createDataFrame([(word, lemma)], "w string, l string").select(T.decompose(F.col("w"), F.col("l")).alias("d"))
    assert tuple(df.first()["d"]) == (root, role)


def test_normalize_and_structure(spark):
    assert one(spark, " It’s  «NOT» so! ", "string", T.normalize) == 'it\'s "not" so!'
    assert one(spark, "will you not go if it was so?", "string", T.structure) == ["STR:question", "STR:negation", "STR:condition", "STR:future", "STR:past"]
    assert one(spark, "nothing", "string", T.structure) == []


def test_cuts_and_pads(spark):
    ids = list(range(10))
    assert one(spark, ids, "array<int>", lambda x: K.head_tail(x, 5)) == [0, 1, 7, 8, 9]
    assert one(spark, ids, "array<int>", lambda x: K.tail(x, 3)) == [7, 8, 9]
    assert one(spark, [1, 2], "array<int>", lambda x: K.pad(x, 4)) == [1, 2, 0, 0]
    assert one(spark, [1, 2], "array<int>", K.shifted_labels) == [2, -100]
    assert one(spark, ["[BOS]", "[BOS]", "[EOS]", "[EOS]"], "array<string>", K.unwrap) == ["[BOS]", "[EOS]"]
    assert one(spark, ["[BOS]", "a"], "array<string>", K.unwrap) == ["[BOS]", "a"]
    assert one(spark, ["[BOS]", "[BOS]", "a", "[EOS]"], "array<string>", K.unmark) == ["a"]
    assert one(spark, [2, 5, 6, 3, 2, 7, 3], "array<int>", lambda x: K.segments(x, 2, 3)) == ["5 6", "7"]


words = st.lists(st.sampled_from("REL:and REL:or STR:clause_end DET:the AUX:will AUX:be ROOT:x ROOT:y FEAT:def LIT:1 [BOS] [EOS]".split()), max_size=12)


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(words, min_size=1, max_size=20))
def test_projection_is_idempotent(spark, streams):
    def project(df):
        return df.withColumn("k", K.reasoning_kept(F.col("x"), "en")).select("i", K.reasoning_collapse(F.col("k")).alias("x"))

    df = spark.createDataFrame(list(enumerate(streams)), "i int, x array<string>")
    once = project(df)
    twice = {r["i"]: r["x"] for r in project(once).collect()}
    once = {r["i"]: r["x"] for r in once.collect()}
    assert once == twice
    assert not any(t.startswith(("FEAT:", "DET:")) for x in once.values() for t in x)


def test_cap_below_core_is_an_error(spark):
    counts = spark.createDataFrame([("ROOT:a", 5), ("LIT:b", 9), ("LIT:c", 9), ("LIT:d", 1)], "token string, n long")
    with pytest.raises(ValueError):
        C.cap_vocabulary(counts, 5, policy="core")
    made = C.cap_vocabulary(counts, 8, policy="core").orderBy("id").collect()
    assert [r["token"] for r in made][5:] == ["ROOT:a", "LIT:b", "LIT:c"] and [r["id"] for r in made] == list(range(8))
    with pytest.raises(ValueError):
        C.cap_vocabulary(counts, 8, policy="other")


def test_ranks_match_a_global_sort(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1009).alias("k"))
    made = {r["k"]: r["r"] for r in shared.ranked(df, [F.col("k")], "r").collect()}
    assert [made[k] for k in sorted(made)] == list(range(1, 1001))


def test_evaluator():
    assert R.evaluate_text("p=true; q=false; p ∧ q") is False
    assert R.evaluate_text("p=1; ¬(p & ~p)") is True
    assert R.evaluate_text("p=t; p → q") is None
    assert R.evaluate_text("") is None


def test_syllogisms_have_the_known_valid_moods(spark):
    valid = R.syllogism_table(spark).filter("valid")
    assert valid.count() == 15
    first = {r[0] for r in valid.filter("figure = 1").select(F.concat("major", "minor", "conclusion")).collect()}
    assert first == {"AAA", "EAE", "AII", "EIO"}


def test_generators_are_reproducible(spark):
    a, b = (sorted(map(tuple, N.prop_logic(spark, 20, 7).select("id", "answer").collect())) for _ in range(2))
    assert a == b and len(a) == 40


def test_generated_formulas(spark):
    """Questions, read by the parser, have the answers and end in the last step of their traces."""
    made = N.prop_logic(spark, 60, 3).unionByName(N.holdout_prop(spark, 30, 4)).collect()
    assert {r["depth"] for r in made if "holdout" in r["id"]} == {5, 6, 7}
    negated = 0
    for r in made:
        if r["lang"] == "en":
            given, formula = re.split(r", what is the value of |; evaluate: ", r["question"].removeprefix("Given ").removesuffix("?"))
            assert R.evaluate_text(f"{given}; {formula}") == r["gold"], r
        assert r["cot"][-1].endswith(" = " + ({"true": "T", "false": "F"}[r["answer"]] if "holdout" in r["id"] else r["answer"]))
        negated += r["depth"] >= 2 and "value of not " in r["question"]
    assert negated
    both = {r["id"].replace("-ar-", "-en-"): r["gold"] for r in made if r["lang"] == "ar"}
    assert all(both[r["id"]] == r["gold"] for r in made if r["id"] in both)


def test_generated_syllogisms(spark):
    rows = N.syllogisms(spark, 2000, 5).filter("lang = 'en'").collect()
    assert [len(N.slots(k)[False]) for k in N.SOUND] == [24, 60]
    share = {k: sum(r["kind"] == k for r in rows) / 2000 for k in ("figure1", "figure2", "chain")}
    assert abs(share["figure1"] - 0.7) < 0.04 and abs(share["figure2"] - 0.2) < 0.04
    assert abs(sum(r["answer"] == "yes" for r in rows) / 2000 - 0.5) < 0.04
    chains = [r for r in rows if r["kind"] == "chain"]
    for r in chains:
        links = re.findall(r"All (.+?) are (.+?)\.", r["question"])
        assert (links[0][1], links[1][1]) == (links[1][0], links[2][0]) if r["answer"] == "yes" else (links[0][1], links[1][0]) == (links[1][1], links[2][0])
    published = [r["question"] for r in N.syllogisms(spark, 200, 5, as_published=True).filter("lang = 'en' and kind = 'chain' and answer = 'no'").collect()]
    assert published
    for q in published:
        links = re.findall(r"All (.+?) are (.+?)\.", q)
        assert links[0][1] == links[1][0] and links[1][1] == links[2][0]
    for lang in N.LANGS:
        words = [w for t in N.TRIPLES[lang] for w in t]
        assert len(set(words)) == 75


def test_generated_algebra(spark):
    rows = N.holdout_algebra(spark, 90, 1).collect()
    assert {r["kind"] for r in rows} == {"solve", "simplify", "evaluate"}
    equations = spark.createDataFrame([(r["question"].replace("solve:", "solve"), r["answer"]) for r in rows if r["kind"] == "solve"], "s string, answer string")
    assert all(int(r["solution"]) == int(r["answer"]) for r in R.solve(equations).collect())
    for r in rows:
        task = r["question"].split(": ")[1]
        if r["kind"] == "evaluate":
            assert eval(task) == int(r["answer"])
        if r["kind"] == "simplify":
            task, short = (re.sub(r"(\d)x", r"\1*x", t) for t in (task, r["answer"]))
            assert all(eval(task, {"x": x}) == eval(short, {"x": x}) for x in (-3, 0, 7))


def test_metrics_of_no_rows(spark):
    empty = spark.createDataFrame([], "p int, g int")
    r = S.binary_metrics(empty, "p", "g").first()
    assert r["n"] == 0
    one_run = spark.createDataFrame([("a", 1.0)], "k string, v double")
    assert S.mean_std(one_run, ["k"], "v").first()["std"] == 0.0


def test_vocabulary_layouts(spark, tmp_path):
    import json

    layouts = {
        "plain": {"[PAD]": 0, "[UNK]": 1, "a": 2}, "ids": {"0": "[PAD]", "1": "[UNK]", "2": "a"}, "nested": {"token_to_id": {"[PAD]": 0, "[UNK]": 1, "a": 2}},
        "list": ["[PAD]", "[UNK]", "a"], "entries": [{"token": "[PAD]", "id": 0}, {"token": "[UNK]", "id": 1}, {"token": "a", "id": 2}], "langs": {"en": {"[PAD]": 0, "[UNK]": 1}, "ar": {"a": 0}},
    }
    for name, blob in layouts.items():
        (tmp_path / name).write_text(json.dumps(blob))
        got = {r["token"]: r["id"] for r in readers.read_vocabulary(spark, str(tmp_path / name)).collect()}
        assert got == {"[PAD]": 0, "[UNK]": 1, "a": 2}, name


def test_json_fields(spark):
    df = spark.createDataFrame([('{"text": "a"}',), ('{"other": 1}',), ("no json",)], "line string")
    assert sorted(r["text"] for r in readers.json_field(df, "line", "text").collect()) == ["a", "no json"]
    arrays = spark.createDataFrame([(1, '["a", {"text": "b"}]')], "k int, j string")
    assert [r["text"] for r in readers.json_array(arrays, "j", ["k"]).orderBy("i").collect()] == ["a", "b"]


def test_streams(spark, sf, tmp_path):
    from tokenloom.streaming import streams

    events = spark.read.parquet(f"{sf}/events.parquet")
    stream = streams.source(spark, f"{sf}/events.parquet*", events.schema)
    made = streams.run_once(spark, streams.windowed_counts(stream, "ts", "1 hour", "1 hour"))
    assert made.count() > 0
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    counts = streams.token_counts(streams.source(spark, f"{sf}/documents.parquet*", docs.schema))
    q = counts.writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).option("checkpointLocation", f"file://{tmp_path}/c").start()
    q.awaitTermination()
    assert spark.table("counts").filter("token = '[BOS]'").first()["count"] == docs.count()


@pytest.mark.parametrize(("pos", "want"), [("part_neg", "STR:neg:general"), ("pron_interrog", "REL:what"), ("pron_rel", "REL:which"), ("noun", "REL:what")])
def test_arabic_ma_by_part_of_speech(spark, pos, want):
    from tokenloom import lexicon_ar as A
    from tokenloom.operators import arabic as R

    reading = tuple({"root": "م.ا.#", "pos": pos}.get(f) for f in A.FIELDS)
    analyses = spark.createDataFrame([("ما", [reading])], R.ANALYSES)
    made = R.word_tokens(spark.createDataFrame([("ما",)], "word string"), analyses, R.root_table(spark)).first()
    assert made["tokens"] == [want]


def test_facade(spark):
    from tokenloom import api

    df = spark.createDataFrame([(1, "All men are not free."), (2, "")], "id int, text string")
    standard = api.tokenize(df, "en")
    vocab = spark.createDataFrame([("[PAD]", 0), ("[UNK]", 1), ("[BOS]", 2), ("[EOS]", 3), ("REL:all", 4)], "token string, id int")
    ids = {r["id"]: r["ids"] for r in api.encode(standard.select("id", "tokens"), vocab).collect()}
    assert ids == {1: [2, 1, 4, 1, 1, 1, 1, 3], 2: [2, 3]}
    back = api.decode(spark.createDataFrame(list(ids.items()), "id int, ids array<int>"), vocab).filter("id = 1").first()
    assert back["tokens"][:3] == ["[BOS]", "[UNK]", "REL:all"]
    logic = {r["id"]: r["tokens"] for r in api.tokenize(df, "en", "logic", add_bos_eos=False).collect()}
    assert logic[1][:2] == ["L:NOT", "Q:ALL"] and logic[2] == []
    for bad in (("ru", "standard"), ("en", "other")):
        with pytest.raises(ValueError):
            api.tokenize(df, *bad)
    with pytest.raises(ValueError):
        api.encode(standard.select("id", "tokens"), vocab.filter("id > 1"))


def test_sampling_from_the_best(spark):
    rows = [(u / 10, [1.0, 3.0, 3.0, -2.0]) for u in range(10)]
    df = spark.createDataFrame(rows, "u double, l array<double>")
    u = F.col("u")
    made = S.sample_top(S.sample_top(df, "l", "two", u, top=2), "l", "greedy", temperature=0).collect()
    assert [r["two"] for r in made] == [1] * 6 + [2] * 4 and {r["greedy"] for r in made} == {1}
    assert {r["x"] for r in S.sample_top(df, "l", "x", u, top=1).collect()} == {1}
    assert S.sample_top(df.limit(1).withColumn("l", F.array().cast("array<double>")), "l", "x", u).first()["x"] is None


def test_answer_candidates(spark):
    counts = spark.createDataFrame([("en", 1, t, n) for n, t in enumerate("f e d c b a".split())] + [("ar", 0, "z", 1), ("ar", 1, "z", 1)], "lang string, label int, token string, n long")
    vocab = spark.createDataFrame([("c",), ("e",), ("no",), ("[UNK]",)], "token string")
    made = {(r["lang"], r["label"]): (r["top"], r["chosen"]) for r in S.answer_candidates(counts, vocab, {1: ["[UNK]"], 0: ["maybe", "no"]}).collect()}
    assert made == {("en", 1): (["a", "b", "c", "d", "e"], "c"), ("ar", 0): (["z"], "no"), ("ar", 1): (["z"], "z")}


def test_candidates_are_scored_by_brute_force(spark):
    from collections import Counter
    from math import log

    from tokenloom.operators import downstream as W

    texts = ["a b c a b".split(), "b c".split(), ["a"]]
    rows = [(1, ["x", "a"], [["b", "c"], ["c", "b"]], 0), (2, ["c"], [["q"], ["q"]], 1), (3, [], [["a"], ["b"]], 0), (4, ["a"], [["b"], []], 0), (5, list("abcab"), [["c", "z", "z"], ["c"]], 1)]
    made = W.candidate_scores(spark.createDataFrame(rows, "id int, context array<string>, candidates array<array<string>>, gold int"), spark.createDataFrame([(t,) for t in texts], "tokens array<string>"), max_len=5)
    pairs = Counter(p for t in texts for p in zip(t, t[1:]))
    firsts = Counter(a for p in pairs.elements() for a in p[:1])
    kinds = len({x for p in pairs for x in p})
    got = {r["id"]: (r["nlls"], r["pred"]) for r in made.collect()}
    assert set(got) == {1, 2, 5}
    for i, context, candidates, _ in rows:
        if i in got:
            seqs = [context[-1:] + c[: max(5 - min(len(context), 3), 1)] for c in candidates]
            want = [round(sum(-log((pairs[p] + 1) / (firsts[p[0]] + kinds)) for p in zip(s, s[1:])), 6) for s in seqs]
            assert got[i] == (pytest.approx(want, abs=2e-6), want.index(min(want)))


def test_runs_compared(spark):
    streams = spark.createDataFrame([("g", "a", ["x", "x"], 4), ("g", "b", ["x", "y"], 4), ("h", "a", ["x"], 1)], "group string, name string, tokens array<string>, n_chars int")
    made = S.compare_runs(S.unigram_runs(streams), "a", "b").collect()
    assert [tuple(r) for r in made] == [("g", 0.0, 0.5, 100.0, 1.0, "a")]


def test_caps_report_what_is_lost(spark):
    counts = spark.createDataFrame([("ROOT:a", 5), ("LIT:b", 3), ("LIT:c", 2)], "token string, n long")
    vocab = C.cap_vocabulary(counts, 4, policy="literal")
    r = C.cap_report(counts, vocab, F.col("token").startswith("LIT:")).first()
    assert (r["kinds"], r["kinds_kept"], r["dynamic_kept"], r["tokens"], r["dynamic_coverage"], r["unknown_rate"], r["size"]) == (3, 2, 1, 10, 0.6, 0.2, 4)


def test_gloss_fields(spark):
    from tokenloom.operators import arabic as A

    rows = [
        ("شَرِبَ", "food", "to drink, then open the name", "", [], "ش.ر.ب", "open"), ("كتاب", None, "nothing", "", ["works", "كتاب", "heal"], "ك.ت.ا.ب", "body"), ("مدرسة", "science", "reopened", "", [], None, "science"),
        (None, "everyday", None, None, None, None, None), ("قل", "home", "", "work", ["write"] * 7, None, "write"), ("بيت", "home", "", "", ["x"] * 6 + ["write"], "ب.ي.ت", "dwell"),
    ]
    df = spark.createDataFrame(rows, "arabic string, domain string, covers string, semantic_field string, keywords array<string>, r string, f string")
    assert all((x["root"], x["field"]) == (x["r"], x["f"]) for x in A.gloss_fields(df, {"heal": "body"}).collect())
