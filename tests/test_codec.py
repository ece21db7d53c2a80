"""Look-ups of arrays: the same rows whatever the table's size, shared and null keys, null and empty arrays."""

from __future__ import annotations

import pytest

from tokenloom import api
from tokenloom.operators import arabic as R
from tokenloom.operators import codec, corpus as C, downstream as W, shared
from tokenloom.plans import arabic as fixtures


@pytest.fixture(params=["whole", "by chunks"])
def bound(request, monkeypatch):
    """The table goes to the tasks whole, or meets the rows by chunks."""
    if request.param == "by chunks":
        monkeypatch.setattr(shared.few, "__defaults__", (1,))
    return request.param


ROWS = [(1, ["a"]), (1, ["b"]), (2, None), (2, []), (None, ["a", "zzz", None, "a"]), (None, ["b"]), (3, ["a"]), (3, ["a"])]
VOCAB = [("[UNK]", 1), ("a", 2), ("b", 3), ("b", 9), (None, 7)]


def key(r):
    return repr(r)


def test_encode_and_decode(spark, bound):
    df = spark.createDataFrame(ROWS, "id int, tokens array<string>")
    vocab = spark.createDataFrame(VOCAB, "token string, id long")
    ids = {"a": 2, "b": 3}
    want = [(i, None if t is None else [ids.get(x, 1) for x in t]) for i, t in ROWS]
    made = C.encode(df, vocab, ["id"])
    assert sorted(map(key, map(tuple, made.collect()))) == sorted(map(key, want))
    names = {2: "a", 3: "b", 1: "[UNK]"}
    back = [(i, None if x is None else [names[y] for y in x]) for i, x in want]
    got = C.decode(made, vocab.filter("id <> 9"), ["id"]).collect()
    assert sorted(map(key, map(tuple, got))) == sorted(map(key, back))


def test_decode_of_an_unknown_id(spark, bound):
    df = spark.createDataFrame([(1, [5, None, 2]), (1, [])], "id int, ids array<int>")
    vocab = spark.createDataFrame([("a", 2), ("b", 3)], "token string, id long")
    assert sorted(map(key, map(tuple, C.decode(df, vocab, ["id"]).collect()))) == sorted(map(key, [(1, ["[UNK]", "[UNK]", "a"]), (1, [])]))


def test_large_vocabularies_give_the_same_ids(spark, monkeypatch):
    """More tokens than the bound has, as they come, against a vocabulary that fits."""
    n = shared.BROADCAST_ROWS + 500
    vocab = spark.range(n).selectExpr("concat('t', id) as token", "id")
    rows = [(i % 7, [f"t{(i * 7919 + k) % (n + 50)}" for k in range(i % 5)]) for i in range(2_000)]
    df = spark.createDataFrame(rows, "id int, tokens array<string>").repartition(3)
    want = sorted(key((i, [int(x[1:]) if int(x[1:]) < n else 1 for x in t])) for i, t in rows)
    assert sorted(map(key, map(tuple, C.encode(df, vocab, ["id"]).collect()))) == want


def test_tokenizers_and_tasks_of_any_vocabulary(spark, bound):
    df = spark.createDataFrame([(1, "The student wrote to London."), (1, "Run!"), (None, None), (2, ""), (1, "Run!")], "id int, text string")
    vocab = spark.createDataFrame([("[UNK]", 0), ("[BOS]", 1), ("[EOS]", 2), ("REL:to", 3), ("STR:emphasis", 4)], "token string, id long")
    made = sorted(map(key, ((r["id"], r["tokens"], r["ids"]) for r in api.tokenize(df, "en", vocab=vocab).collect())))
    one = ["[BOS]", "LIT:the", "ROOT:know", "ROLE:seeker", "ROOT:write", "REL:to", "LIT:london", "[EOS]"]
    run = ["[BOS]", "STR:emphasis", "ROOT:move", "[EOS]"]
    want = [(1, one, [1, 0, 0, 0, 0, 3, 0, 2]), (1, run, [1, 4, 0, 2]), (1, run, [1, 4, 0, 2]), (None, ["[BOS]", "[EOS]"], [1, 2]), (2, ["[BOS]", "[EOS]"], [1, 2])]
    assert made == sorted(map(key, want))
    asked = spark.createDataFrame([(1, ["a", "b"], [["a"], ["b", "zz"]], 1), (1, ["b"], [["b", "b"], ["a"]], 0), (2, [], [["a"]], 0), (3, ["a"], [["a"], []], 0)], "id int, context array<string>, candidates array<array<string>>, gold int")
    ids = spark.createDataFrame([("a", 5), ("b", 6)], "token string, id long")
    got = sorted(map(key, map(tuple, W.lm_scoring(asked, ids).collect())))
    assert got == sorted(map(key, [(1, [5, 6], [[5], [6, 1]], 1), (1, [6], [[6, 6], [5]], 0)]))
    labelled = spark.createDataFrame([(1, ["a"], 0), (1, ["b", "x"], 1), (None, ["a"], None), (4, [], 1)], "id int, tokens array<string>, label int")
    assert sorted(map(key, map(tuple, W.classification(labelled, ids).collect()))) == sorted(map(key, [(1, [5], 0), (1, [6, 1], 1), (None, [5], None)]))


def test_arabic_rows_may_share_ids(spark, bound):
    sents, analyses, roots = fixtures.fixture(spark)
    rows = [(1, "كتب الطالب"), (1, "لم يذهب محمد"), (None, "كتب الطالب"), (None, None), (2, "كتب الطالب"), (2, "كتب الطالب")]
    made = R.tokenize(spark.createDataFrame(rows, "id int, text string"), analyses, roots).collect()
    wrote = ["[BOS]", "ROOT:write", "FEAT:asp:p", "FEAT:3ms", "ROOT:want", "ROLE:agent", "[EOS]"]
    went = ["[BOS]", "STR:neg:past", "ROOT:move", "FEAT:asp:i", "FEAT:3ms", "NE:محمد", "[EOS]"]
    assert sorted(map(key, ((r["id"], r["tokens"]) for r in made))) == sorted(map(key, [(1, wrote), (1, went), (None, wrote), (None, ["[BOS]", "[EOS]"]), (2, wrote), (2, wrote)]))


def test_other_columns_pass_and_values_may_be_lists(spark, bound):
    df = spark.createDataFrame([(1, ["x", "y"], {"k": 1}), (2, None, None)], "id int, words array<string>, m map<string,int>")
    table = spark.createDataFrame([("x", ["p", "q"]), ("z", ["r"])], "word string, tokens array<string>")
    made = codec.mapped(df, "words", table, "parts", missing=lambda w: [f"own {w}"]).orderBy("id").collect()
    assert [tuple(r) for r in made] == [(1, ["x", "y"], {"k": 1}, [["p", "q"], ["own y"]]), (2, None, None, None)]
    assert codec.mapped(df.limit(0), "words", table, "parts", missing=[]).count() == 0
