"""What keeps time and shuffled bytes in step with the input, by small plans and tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tokenloom import lexicon as L
from tokenloom.functions import tokens as K
from tokenloom.operators import arabic as R
from tokenloom.operators import baselines as B
from tokenloom.operators import codec
from tokenloom.operators import corpus as C
from tokenloom.operators import datagen as G
from tokenloom.plans import registry


def _plan(made) -> str:
    return made._jdf.queryExecution().optimizedPlan().toString()


def test_steps_come_with_the_last_join(spark):
    """Whole texts meet their examples once, last, so that no later shuffle carries a copy for each of them."""
    rows = [(f"en{i}", "en", "yes" if i % 3 else "no", [f"q{i}"], [[f"s{i}"]], [f"a{i}"]) for i in range(6)]
    df = spark.createDataFrame(rows, "id string, lang string, label_name string, q array<string>, cot array<array<string>>, a array<string>")
    made = G.verifier_examples(df)
    joins = [x for x in _plan(made).splitlines() if "Join Inner" in x]
    assert "cot_of#" in joins[0]
    assert {(r["id"], tuple(r["input_tokens"])) for r in made.collect() if r["source_id"] == "en0" and r["label"] == 1} == {("en0:pos", ("q0", "s0", "a0"))}


def test_fields_are_sought_once_a_word(spark, sf):
    """No filter on a word's field stands below the distinct words, where it would run for each token."""
    for name in ("en_resolve_field", "en_prefix_role", "en_suffix_role"):
        plan = _plan(registry.QUERIES[name](spark, sf))
        below = plan[plan.rindex("Aggregate") :].split("\n", 1)[1]
        assert not any(x in below for x in ("EndsWith", "StartsWith", "ies"))


def test_demo_words_are_tried_once(spark, sf, monkeypatch):
    """Neither way makes four keys of each word before it is looked up, where the table is small; both ways give the same ids."""
    known = spark.createDataFrame([("go", "REL:go"), ("stop!", "REL:stop"), ("far", "REL:far")], "word string, token string")
    vocab = spark.createDataFrame([("REL:go", 5), ("REL:stop", 6), ("SURF:hi", 7), ("SURF:go", 8), ("SURF:ho!", 9), ("SURF:hi", 4)], "token string, id int")
    df = spark.createDataFrame([(1, "go!: stop! far hi! ho! xyz؟ !"), (2, ""), (3, None), (4, " hi\u2028 hi!\u2028 go. go.")], "id int, text string")
    small = B.demo_ids(df, known, vocab, begin=2, unknown=1)
    assert "W:" not in _plan(small)
    got = {r["id"]: r["ids"] for r in small.collect()}
    assert got == {1: [2, 5, 6, 1, 4, 9, 1, 1], 2: [2], 3: [2], 4: [2, 1, 1, 5, 5]}
    monkeypatch.setattr(B.shared, "few", lambda df, rows=0: None)
    assert {r["id"]: r["ids"] for r in B.demo_ids(df, known, vocab, begin=2, unknown=1).collect()} == got


def test_words_are_counted_before_they_are_pooled(spark, sf):
    plan = _plan(registry.QUERIES["agg_missed_roots"](spark, sf))
    assert "md5" in plan and "md5" not in plan[plan.rindex("Aggregate") :]


def test_running_sums_are_one_pass(spark, sf):
    df = spark.createDataFrame([([2, 1, None, 3],), ([],), (None,), ([5],)], "x array<int>").coalesce(1)
    assert [r["s"] for r in codec.running(df, "x", "s").collect()] == [[0, 2, 3, 3], [], None, [0]]
    assert "slice(" not in _plan(registry.QUERIES["win_cumulative_cursor"](spark, sf))


def test_slices_are_cut_without_going_over_the_sentence(spark, sf):
    assert "slice(" not in _plan(registry.QUERIES["agg_lookup_w2t"](spark, sf))


def test_glosses_are_searched_once(spark, sf):
    """Not once for each field: what a lambda names only once is put into it as a whole. Half a letter borders no name."""
    plan = _plan(registry.QUERIES["aae_root_classify"](spark, sf))
    assert not any("lambdafunction(array_contains" in x for x in plan.splitlines())
    rows = [(1, "an 😀write", "write"), (2, "an 𝒳write", None), (3, "écrit knowé to know", "know"), (4, "art open", "open"), (5, "tréad read", "know")]
    df = spark.createDataFrame([(i, None, "x", t, "", [], f) for i, t, f in rows], "id int, arabic string, domain string, covers string, semantic_field string, keywords array<string>, want string")
    assert all(r["field"] == r["want"] for r in R.gloss_fields(df, {"read": "know"}).collect())


def test_parsed_sentences_stay_in_their_rows(spark, sf):
    for name in ("en_reason_dep", "en_reason_dep_composed"):
        plan = _plan(registry.QUERIES[name](spark, sf))
        assert "Window" not in plan and "Aggregate" not in plan


def test_logic_tokens_are_counted_where_words_are_looked_up(spark, sf):
    """Only counts leave the tasks: no token is projected, collapsed or exploded behind the look-up."""
    plan = _plan(registry.QUERIES["agg_logic_bucket"](spark, sf))
    behind = plan[: plan.index("MapInArrow")]
    assert "lambda" not in behind and "Generate" not in behind


LOGIC_TEXTS = [
    "I will not, not never and and or go. Was it not?", "No no NO! Won't you? Didn't. And – and / and", "12 and 7; s t x … (and)", "and", "–", "...", "", None, "?", "!", "Writers and  readers rewrote libraries. If if unless",
    "was was had. Will shall gonna!", "não_not ñnot not_ not1 1not", "mit 12mit Paris teacher students. Teacher? all some Some", "don't\u00a0and\tand «and» and—and", "flies 0 ٣ 3.5 co-op",
]


def test_logic_counts_equal_the_collapsed_tokens(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "en", "x", t) for i, t in enumerate(LOGIC_TEXTS * 3)], "doc_id long, lang string, source string, text string").coalesce(1)
    for atomic in (True, False):
        parts = C.tokenize_english(docs, atomic=atomic).select("doc_id", "pos", K.logic_parts(F.col("tokens")).alias("p"))
        want = {(r["t"], r["count"]) for r in parts.select(F.explode(K.logic_collapse(F.col("p"))).alias("t")).groupBy("t").count().collect()}
        assert len(want) > 8
        assert {(r["token"], r["n"]) for r in C.logic_counts(docs, atomic=atomic).collect()} == want
        sentences = {(r["doc_id"], r["pos"], tuple(r["tokens"])) for r in C.logic_sentences(docs, atomic=atomic).collect()}
        assert sentences == {(r["doc_id"], r["pos"], tuple(r["p"])) for r in parts.collect()}
    with monkeypatch.context() as m:  # a table that is too large to go to the tasks
        m.setattr(codec.shared, "few", lambda df, rows=0: None)
        assert {(r["token"], r["n"]) for r in C.logic_counts(docs).collect()} == want
    assert C.logic_counts(docs.limit(0)).collect() == []


def test_only_words_that_may_be_known_are_analysed(spark):
    """All that analysis knows passes the filter in front of it, whatever stands about a spelling; few other words do."""
    stems = {*L.FIELDS, *L.LEMMAS, *L.ENTITIES, *(x[:-1] for x in L.FIELDS), *(x[:-1] + "i" for x in L.FIELDS)}
    ends = ["", "es", "ies", "x", *(s for s, _ in L.SUFFIXES), *(s + "s" for s in L.FIELD_SUFFIXES), "ersment"]
    words = {p + x + s for p in ("", "x", *(p for p, _ in L.PREFIXES)) for x in stems for s in ends} | {*L.RELATIONS, *L.FUNCTION_WORDS, "12"}
    distinct = spark.createDataFrame([(w,) for w in sorted(words)], "word string")
    full = C._known(C.emit(C.analyse(distinct), atomic=True))
    assert sorted(map(str, C.known_words(distinct, atomic=True).collect())) == sorted(map(str, full.collect()))
    other = spark.createDataFrame([(w,) for w in ("zebra", "table", "begin", "gnu", "orange", "lovely", "12")], "word string")
    assert other.filter(C._possible(F.col("word"), C.Lexicon())).count() == 1
