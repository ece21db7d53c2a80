"""The Arabic tokenizer on sentences worked out by hand, with lexicons and roots as parameters."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tokenloom import lexicon_ar as A
from tokenloom.functions import text as T
from tokenloom.operators import arabic as R
from tokenloom.operators import shared
from tokenloom.operators import stats as S
from tokenloom.plans import arabic as fixtures
from tokenloom.plans import registry
from tokenloom.sources import readers


def test_sentences(spark):
    made = {r["id"]: " ".join(r["tokens"]) for r in R.tokenize(*fixtures.fixture(spark)).collect()}
    assert made == dict(fixtures.TOKENS_AR)


def test_all_relations_are_reached(spark):
    """Every word of the relation table that stripping leaves as it is gives its relation, alone in a sentence."""
    words = spark.createDataFrame([(w,) for w in A.RELATIONS], "id string").select("id", F.col("id").alias("text"), T.strip_arabic(F.col("id")).alias("bare"))
    _, analyses, roots = fixtures.fixture(spark)
    own = words.filter((F.length("bare") >= 2) & (F.col("bare") == F.col("text")) & (F.col("text") != "ما"))
    made = {r["id"]: r["tokens"] for r in R.tokenize(own.select("id", "text"), analyses, roots).collect()}
    assert len(made) > 80
    assert all(x == ["[BOS]", A.RELATIONS[w], "[EOS]"] for w, x in made.items())
    for w in ("لكنه", "لكنها", "كأن", "لعله", "لعلها", "عدا", "خلا", "كلا", "سائر", "أغلب"):
        assert w in made


def test_a_lexicon_and_roots_from_files(spark):
    folder = shared.folder(spark, "lexicon")

    def write(name: str, value) -> None:
        spark.createDataFrame([(json.dumps(value, ensure_ascii=False),)], "value string").coalesce(1).write.text(f"{folder}/{name}")

    write("relations.json", {"قرب": "REL:near"})
    write("numerals.json", ["مليار"])
    spark.createDataFrame([("كون", "exist"), ("# a comment", None), ("قول", "speak"), ("و", "x"), ("ك.ت.ب", "write")], "root string, field string").coalesce(1).write.json(f"{folder}/roots.jsonl")
    lex = readers.read_arabic_lexicon(spark, folder)
    assert lex.relations == {"قرب": "REL:near"} and lex.numerals == ["مليار"] and lex.marks == A.MARKS
    assert {tuple(r) for r in lex.roots.collect()} == {("ك.و.ن", "exist"), ("ق.و.ل", "speak"), ("ك.ت.ب", "write")}
    sents = spark.createDataFrame([(1, "قال قرب مليار في كتب")], "id int, text string")
    made = R.tokenize(sents, fixtures.fixture(spark)[1], lexicon=lex).first()["tokens"]
    assert made == ["[BOS]", "ROOT:speak", "FEAT:asp:p", "FEAT:3ms", "REL:near", "ROOT:size", "FOREIGN:في", "ROOT:write", "FEAT:asp:p", "FEAT:3ms", "[EOS]"]


def test_closure_of_many_roots(spark):
    """A caller's table of any size: each weak letter may be hidden, and the first field of a spelling counts."""
    letters = "بتثجحخدذرزسشصضطظعغفقكلمن"
    roots = spark.createDataFrame([(f"{a}.و.{b}", f"f{i % 5}") for i, (a, b) in enumerate((a, b) for a in letters for b in letters)], "root string, field string")
    made = {r["root"]: r["field"] for r in R.root_closure(roots).collect()}
    assert len(made) == 2 * len(letters) ** 2
    assert all(made[f"{a}.#.ب"] == made[f"{a}.و.ب"] for a in letters)


def test_verdicts(spark):
    cases = {
        "advantage_supported": [(True, 0.81, 0.12, 0.2, "256", 1000, False, 0.7, 0.05, 0.1, "256", 1000), (True, 0.81, 0.12, 0.2, "256", 1000, True, 0.7, 0.05, 0.1, "256", 1000)],
        "inconclusive_both_pass": [(True, 0.71, 0.06, 0.11, "256", 1000, True, 0.7, 0.05, 0.1, "512", 1000)], "disadvantage_baseline_wins": [(False, 0.5, 0.0, 0.0, "256", 900, True, 0.7, 0.05, 0.1, "256", 1000)],
        "better_but_not_ready": [(False, 0.6, 0.08, 0.13, None, None, False, 0.55, 0.05, 0.1, "256", 1000), (False, 0.53, 0.02, 0.02, "256", 1000, False, 0.5, 0.0, 0.0, "256", 1000)],
        "no_evidence_of_advantage": [(False, 0.5, 0.01, 0.1, "256", 900, False, 0.5, 0.0, 0.1, "512", 1000)],
    }
    side = "struct<passed: boolean, full: double, gap_q: double, gap_s: double, config: map<string, string>, sizes: map<string, int>>"
    rows = [(want, *((p, f, q, s, None if c is None else {"d_model": c}, None if c is None else {"train": t}) for p, f, q, s, c, t in (r[:6], r[6:]))) for want, rs in cases.items() for r in rs]
    made = S.verdict(spark.createDataFrame(rows, f"want string, own {side}, base {side}")).collect()
    assert all(r["verdict"] == r["want"] for r in made)
    assert [r["warnings"] for r in made] == [[], [], ["architecture"], ["train"], ["partial"], [], ["architecture", "train"]]


def test_missed_roots_are_sought_without_proclitics(spark):
    """Any reading's root counts, then that of what a proclitic leaves, if two letters stay; words count as often as they stand there."""
    rows = [("كتب", "ك.ت.ب"), ("محمد", "ح.م.د"), ("لكتاب", None), ("كتاب", "ك.ت.ب"), ("قال", "ق.#.ل"), ("وز", "NTWS")]
    analyses = spark.createDataFrame([(w, [fixtures._a(root="ص.غ.ر", pos="adj"), fixtures._a(root=r)] if w == "كتاب" else [fixtures._a(root=r)]) for w, r in rows], R.ANALYSES)
    want = {
        "كتب": "root_field", "كتاب": "root_field", "والكتب": "root_field", "والكتاب": "root_field", "بالكتاب": "root_field", "وبكتاب": "root_field", "فالكتب": "root_field", "محمد": "root_no_field", "المحمد": "no_root",
        "لقال": "no_root", "للقال": "root_field", "وز": "no_root", "لكتاب": "no_root", "في": "function", "عشرة": "function", "": "no_root",
    }
    words = spark.createDataFrame([(w, i + 1) for i, w in enumerate(want)], "word string, n long")
    made = R.root_outcomes(words, analyses, R.root_table(spark)).collect()
    assert {r["word"]: r["outcome"] for r in made} == want
    assert sorted(r["n"] for r in made) == list(range(1, len(want) + 1))


def test_missed_roots_cover_the_corpus(spark, sf):
    made = {r["outcome"]: r for r in registry.QUERIES["agg_missed_roots"](spark, sf).collect()}
    n = sum(r["n"] for r in made.values())
    assert n > 10_000  # occurrences, where the distinct words of the pool are some 150
    assert {r["coverage"] for r in made.values()} == {(made["function"]["n"] + made["root_field"]["n"]) * 100 // n}
    assert {o: r["pct"] for o, r in made.items()} == {o: r["n"] * 100 // n for o, r in made.items()}
