"""Parsed tokens: lemmas by first context, spans of entities and rules by dependency, on tables as a parser gives them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tokenloom.operators import corpus as C
from tokenloom.operators import parsed as P
from tokenloom.plans import registry

SCHEMA = "doc_id int, pos int, i int, text string, lemma string, upos string, tag string, dep string, iob string, label string"


def table(spark, *sentences):
    rows = []
    for n, words in enumerate(sentences):
        for i, w in enumerate(words):
            text, lemma, upos, *rest = w
            tag, dep, iob, label = [*rest, *[""] * (4 - len(rest))]
            rows.append((1, n, i, text, lemma, upos, tag, dep, iob or "O", label or None))
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_first_context_wins(spark):
    parsed = table(spark, [("Saw", "see", "VERB"), ("saws", "saw", "NOUN")], [("saw", "saw", "NOUN"), ("Saws", "SAWS", "PROPN"), ("left", None, "VERB")], [("left", "leave", "VERB")])
    assert {r["word"]: r["lemma"] for r in P.first_context(parsed).collect()} == {"saw": "see", "saws": "saw", "left": "left"}


def test_spans_and_rules(spark):
    parsed = table(
        spark,
        [
            ("If", "if", "SCONJ"), ("New", "new", "PROPN", "NNP", "nsubj", "B", "GPE"), ("York", "york", "PROPN", "NNP", "nsubj", "I", "GPE"), ("Paris", "paris", "PROPN", "NNP", "nsubj", "B", "GPE"),
            ("IBM", "ibm", "PROPN", "NNP", "dobj", "I", "ORG"), ("'s", "'s", "PART", "POS"), ("all", "all", "DET"), ("teachers", "teacher", "NOUN", "NNS", "nsubj"), ("wo", "will", "AUX"),
            ("n't", "not", "PART", "RB", "neg"), ("and", "and", "CCONJ"), ("upon", "upon", "ADP"), ("12", "12", "NUM"), ("quickly", "quickly", "ADV", "RB", "advmod"), ("run", "run", "VERB"), ("\"", "\"", "PUNCT"),
            ("hm", "hm", "INTJ"), (" ", " ", "SPACE"), (";", ";", "PUNCT"), ("?", "?", "PUNCT"), (" ", " ", "SPACE"),
        ],
        [("The", "the", "DET"), ("end", "end", "NOUN", "NN", "ROOT"), (".", ".", "PUNCT")],
    )
    made = {r["pos"]: r["tokens"] for r in P.dependency_tokens(parsed).collect()}
    assert made[0] == [
        "[BOS]", "STR:question", "STR:conditional", "LIT:If", "LIT:New York", "LIT:Paris", "LIT:IBM", "POSS:'s", "REL:quant:all", "ROOT:teacher", "ROLE:agent", "AUX:will", "REL:neg", "REL:and", "REL:upon",
        "LIT:12", "ROOT:quickly", "ROLE:manner", "ROOT:run", "STR:quote", "LIT:hm", "STR:clause_end", "[EOS]",
    ]
    assert made[1] == ["[BOS]", "DET:the", "ROOT:end", "STR:clause_end", "[EOS]"]
    composed = {r["pos"]: r["tokens"] for r in P.dependency_tokens(parsed, atomic=False).collect()}
    assert "CMP:teacher:agent" in composed[0] and "CMP:quickly:manner" in composed[0]


def test_entities_only_in_their_sentences(spark):
    sents = spark.createDataFrame([(1, 0, "A book by Reed."), (1, 1, "The reed sent books."), (1, 2, "...")], "doc_id int, pos int, sent string")
    parsed = table(
        spark,
        [("A", "a", "DET"), ("book", "book", "NOUN"), ("by", "by", "ADP"), ("Reed", "Reed", "PROPN", "", "", "B", "PERSON"), (".", ".", "PUNCT")],
        [("The", "the", "DET"), ("reed", "grass", "NOUN"), ("sent", "send", "VERB"), ("books", "book", "NOUN"), (".", ".", "PUNCT")],
    )
    fields = spark.createDataFrame([("reed", "name"), ("send", "send"), ("book", "write")], "spelling string, field string")
    made = {r["pos"]: r["tokens"] for r in P.tokenize(sents, parsed, lexicon=C.Lexicon(fields=fields)).collect()}
    assert made[0] == ["LIT:a", "ROOT:write", "REL:by", "LIT:reed"]
    assert made[1] == ["LIT:the", "ROOT:name", "ROOT:send", "CMP:write:plural"]
    assert made[2] == []
    odd = parsed.withColumn("label", P.F.when(P.F.col("label") == "PERSON", "DATE"))
    assert P.entity_words(odd).count() == 0


ODD = [
    "The New York's dogs is not in the Paris office, and A Dog's wishes were quickly boxed.", "İstanbul saw ΑΣ and Ali-Baba was here", "", None, " \t ", "Not NOT not", "'s 's’s don't (in) \"the\" Big Apple!", "0٣ 12 3.5 ties axes boxes buses dies",
    "Dies Dies dies in of the in the Reed Teams", "dogs\nCats\rCats Cats", "T A I'll Don't", "x" * 50 + " " + "Y" * 50, "Reed has had has Has", "In In The In A Reed",
]


def _odd(spark):
    rows = [(d, p, s) for d in (None, 3, 1) for p, s in enumerate(reversed(ODD) if d == 1 else ODD)]
    return spark.createDataFrame(rows, "doc_id int, pos int, sent string").repartition(2)


def test_rules_in_batches_are_the_expressions(spark, monkeypatch):
    """All columns agree with the expressions', whatever the slices are; what is left out has no first context or entity."""
    sents = _odd(spark)
    want = P.parsed_sentences(sents).select(*P.KEYS, F.explode("tokens").alias("t")).select(*P.KEYS, "t.*")
    assert P.rule_parsed(sents).schema.simpleString() == want.schema.simpleString()
    asked = [tuple(r) for r in want.collect()]
    assert sorted(map(tuple, P.rule_parsed(sents).collect()), key=repr) == sorted(asked, key=repr)
    assert sorted(map(tuple, P.rule_entities(sents).collect()), key=repr) == sorted((r for r in asked if r[8] != "O"), key=repr)
    assert sorted(map(tuple, P.first_context(P.rule_contexts(sents)).collect())) == sorted(map(tuple, P.first_context(want).collect()))
    assert P.rule_contexts(sents).count() < want.count()
    tokens = {(r["doc_id"], r["pos"]): r["tokens"] for r in P.rule_tokenize(sents.filter("doc_id is not null"), atomic=True).collect()}
    assert tokens == {(r["doc_id"], r["pos"]): r["tokens"] for r in P.tokenize(sents.filter("doc_id is not null"), want.filter("doc_id is not null"), atomic=True).collect()}
    texts = P.pa.array(ODD * 2)
    for size in (1, 40, 1 << 20):
        monkeypatch.setattr(P, "SLICE", size)
        parts = list(P._slices(texts))
        assert [x for a, n in parts for x in range(a, a + n)] == list(range(len(texts)))
    assert list(P._slices(texts[:0])) == []


def test_parsed_tokens_are_made_once(spark, sf):
    """Not once for each field, as where a generator's fields are asked for one by one; a sentence stays in its row."""
    for name in ("parsed_tokens", "en_ner_parsed", "en_lemma", "en_tokenize_parsed"):
        plan = registry.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert "regexp_extract_all" not in plan
        assert name != "en_tokenize_parsed" or "Join" not in plan
