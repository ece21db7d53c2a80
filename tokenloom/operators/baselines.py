"""Word-level and subword baselines, and a smoothed bigram model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.functions import tokens as K
from tokenloom.operators import codec
from tokenloom.operators import corpus as C
from tokenloom.operators import shared


def top_vocabulary(counts: DataFrame, specials: list[str], cap: int) -> DataFrame:
    """(token, id): specials first, then the most frequent others up to cap ids in all."""
    spark = counts.sparkSession
    head = C.table(spark, [(t, i) for i, t in enumerate(specials)], "token string, id long")
    # a sort with a limit: the long tail is never ranked
    best = counts.filter(~F.col("token").isin(specials)).orderBy(F.desc("n"), "token").limit(max(0, cap - len(specials)))
    ranked = best.withColumn("id", F.row_number().over(Window.orderBy(F.desc("n"), "token")) - 1 + len(specials))
    return head.unionByName(ranked.select("token", F.col("id").cast("long").alias("id")))


def first_seen(each: DataFrame, offset: int = 0) -> DataFrame:
    """(token, id, n) in the order in which tokens of (doc_id, pos, i, token) appear first."""
    first = each.groupBy("token").agg(F.min(F.struct("doc_id", "pos", "i")).alias("at"), F.count("*").alias("n"))
    ranked = shared.ranked(first.select("token", "n", "at.*"), [F.col("doc_id"), F.col("pos"), F.col("i")], "id")
    return ranked.select("token", (F.col("id") - 1 + offset).alias("id")) if not offset else ranked.select("token", (F.col("id") - 1 + offset).alias("id"), "n")


def whitespace_vocabulary(sents: DataFrame) -> DataFrame:
    spaced = F.regexp_replace(F.lower("sent"), "([.,!?;:])", " $1 ")
    words = sents.select("doc_id", "pos", F.filter(F.split(spaced, "[ \\t\\r\\n]+"), lambda w: w != "").alias("w")).filter(F.size("w") >= 3)
    return first_seen(words.select("doc_id", "pos", F.posexplode("w").alias("i", "token")), 4)


WORD = "[A-Za-z0-9_À-ɏ؀-ۿ]+|[^A-Za-z0-9_À-ɏ؀-ۿ \\t\\r\\n]"


def word_ids(sents: DataFrame, size: int, most: int) -> DataFrame:
    words = sents.select("doc_id", "pos", F.regexp_extract_all(F.lower("sent"), F.lit(WORD), F.lit(0)).alias("tokens")).filter(F.size("tokens") >= 4)
    every = sents.select(F.explode(F.regexp_extract_all(F.lower("sent"), F.lit(WORD), F.lit(0))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    vocab = top_vocabulary(every, ["<pad>", "<unk>"], size)
    return C.encode(words, vocab, ["doc_id", "pos"]).select("doc_id", "pos", F.slice("ids", 1, most).alias("ids"))


#: Marks that the small encoder takes from a word's end.
DEMO_MARKS = "،؛.؟!:"


def demo_words(text):
    """White-space words of a text."""
    return F.filter(F.split(F.trim(text), "[ \\t\\r\\n]+"), lambda w: w != "")


def demo_clean(word):
    """A word without its trailing marks."""
    return F.regexp_replace(word, f"[{DEMO_MARKS}]+\\z", "")


def demo_ids(df: DataFrame, known: DataFrame, vocab: DataFrame, *, begin: int, unknown: int) -> DataFrame:
    """df (text) with ids: begin, then of each word the id of its token in known (word, token).

    A word is sought without its trailing marks first, then as it is. One that neither way is known has the id of its
    surface, again both ways. What vocab (token, id) lacks is unknown.
    """
    table = known.join(vocab, "token", "left").select(F.concat(F.lit("W:"), "word").alias("key"), F.coalesce("id", F.lit(unknown)).cast("int").alias("id"))
    surfaces = vocab.filter(F.col("token").startswith("SURF:")).select(F.concat(F.lit("S:"), F.substr("token", F.lit(6))).alias("key"), F.col("id").cast("int").alias("id"))
    table = table.unionByName(surfaces).groupBy("key").agg(F.min("id").alias("id"))
    split = df.withColumn("_w", demo_words(F.coalesce("text", F.lit(""))))
    rows = shared.few(table)
    if rows is not None:  # a batch's different words are tried once each, in the tasks
        ids = {r["key"]: r["id"] for r in rows}

        def tried(w: str) -> int:
            clean = w.rstrip(DEMO_MARKS)
            return next((ids[k] for k in (f"W:{clean}", f"W:{w}", f"S:{clean}", f"S:{w}") if k in ids), unknown)

        found = codec.mapped(split, "_w", table.limit(0), "_ids", missing=tried)
        return found.withColumn("ids", F.concat(F.array(F.lit(begin)), "_ids")).drop("_w", "_ids")
    tries = F.flatten(F.transform("_w", lambda w: F.array(*(F.concat(F.lit(p), x) for p in ("W:", "S:") for x in (demo_clean(w), w)))))
    found = codec.mapped(split.withColumn("_tries", tries), "_tries", table, "_ids", missing=None)
    each = F.transform("_w", lambda w, i: F.coalesce(*(F.get("_ids", 4 * i + k) for k in range(4)), F.lit(unknown)))
    return found.withColumn("ids", F.concat(F.array(F.lit(begin)), each)).drop("_w", "_tries", "_ids")


def _pairs(lexed: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, a, b): neighbours inside each array, so nothing is shuffled to find them."""
    t = F.col("tokens")
    zipped = F.arrays_zip(F.slice(t, F.lit(1), F.size(t) - 1).alias("a"), F.slice(t, F.lit(2), F.size(t) - 1).alias("b"))
    return lexed.filter(F.size(t) >= 2).select(*keys, F.explode(zipped).alias("p")).select(*keys, "p.a", "p.b")


def bigrams(lexed: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(a, b, nab, nll) with add-one smoothing over the tokens seen; pairs (a, b, n) may be counted already."""
    pairs = _pairs(lexed, []).groupBy("a", "b").agg(F.count("*").alias("nab")) if pairs is None else pairs.groupBy("a", "b").agg(F.sum("n").alias("nab"))
    pairs = shared.stored(pairs)  # read for the pairs, their firsts and the tokens' number
    firsts = pairs.groupBy("a").agg(F.sum("nab").alias("na"))
    size = pairs.select("a").union(pairs.select("b")).distinct().agg(F.count("*").alias("v"))
    return pairs.join(firsts, "a").join(F.broadcast(size)).select("a", "b", "nab", (-F.log((F.col("nab") + 1.0) / (F.col("na") + F.col("v")))).alias("nll"))


def score_languages(lexed: DataFrame) -> DataFrame:
    """(lang, nll, n_tokens) under the bigram model of the same sentences (lang, tokens): a pair is scored once a language."""
    counted = shared.stored(_pairs(lexed, ["lang"]).groupBy("lang", "a", "b").agg(F.count("*").alias("n")))
    scored = counted.join(bigrams(lexed, counted).select("a", "b", "nll"), ["a", "b"])
    return scored.groupBy("lang").agg(F.sum(F.col("n") * F.col("nll")).alias("nll"), F.sum("n").alias("n_tokens"))


def score_pairs(pairs: DataFrame, lexed: DataFrame) -> DataFrame:
    """pairs (a, b, ...) with nll under the add-one bigram model of lexed; pairs that it never saw have one too."""
    counted = shared.stored(_pairs(lexed, []).groupBy("a", "b").agg(F.count("*").alias("nab")))
    firsts = counted.groupBy("a").agg(F.sum("nab").alias("na"))
    size = counted.select("a").union(counted.select("b")).distinct().agg(F.count("*").alias("v"))  # one row
    joined = pairs.join(counted, ["a", "b"], "left").join(firsts, "a", "left").join(F.broadcast(size))
    p = (F.coalesce("nab", F.lit(0)) + 1.0) / (F.coalesce("na", F.lit(0)) + F.col("v"))
    return joined.withColumn("nll", -F.log(p)).drop("nab", "na", "v")


def word_sequences(aligned: DataFrame) -> DataFrame:
    """(word, tokens, n): each word's most common token sequence, of equal ones the first by name.

    A word's slice begins behind the marks and the tokens of the words before it. Tokens are taken one by one: slice() goes
    over the whole array each time.
    """
    made = codec.running(aligned.select("tokens", "words", "counts", "n_marks"), "counts", "starts")

    def cut(w: Column, i: Column) -> Column:
        at, n = (F.col("n_marks") + F.get("starts", i)).cast("int"), F.get("counts", i)
        several = F.array_join(F.transform(F.sequence(at, at + n - 1), lambda j: F.get("tokens", j)), " ")
        return F.struct(w.alias("word"), F.when(n == 1, F.get("tokens", at)).when(n > 1, several).otherwise("").alias("tokens"))

    each = made.select(F.explode(F.transform("words", cut)).alias("x")).select("x.word", "x.tokens")
    counted = each.groupBy("word", "tokens").agg(F.count("*").alias("n"))
    best = counted.groupBy("word").agg(F.min(F.struct((-F.col("n")).alias("m"), "tokens")).alias("x"))
    return best.select("word", "x.tokens", (-F.col("x.m")).alias("n"))


def permuted(vocab: DataFrame, seed: int) -> DataFrame:
    """(token, id, new_id): structured tokens exchange ids by a seeded order, the others keep theirs."""
    structured = vocab.filter(~F.col("token").startswith("LIT:") & ~F.col("token").startswith("["))
    by_id = structured.withColumn("r", F.row_number().over(Window.orderBy("id")))  # at most the cap's rows
    by_hash = structured.select("token", F.row_number().over(Window.orderBy(F.md5(F.concat_ws(":", F.lit(seed), "token")), "token")).alias("r"))
    moved = by_hash.join(by_id.select("r", F.col("id").alias("new_id")), "r").select("token", "new_id")
    return vocab.join(moved, "token", "left").select("token", "id", F.coalesce("new_id", "id").alias("new_id"))


def padded(ids: DataFrame, batch: list[str], value: int = 0) -> DataFrame:
    """ids (batch keys, ids) with padded and mask, as wide as the longest of the batch, and labels moved by one.

    A batch is a bounded group by its nature: it is one window partition.
    """
    width = F.max(F.size("ids")).over(Window.partitionBy(*batch))
    wide = ids.withColumn("_w", width)
    return wide.select("*", K.pad(F.col("ids"), F.col("_w"), value).alias("padded"), K.mask(F.col("ids"), F.col("_w")).alias("mask"), K.shifted_labels(F.col("ids")).alias("labels")).drop("_w")
