"""Rows for downstream tasks: encoded texts with labels, and contexts with candidates to score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.operators import baselines as B
from tokenloom.operators import corpus


def classification(df: DataFrame, vocab: DataFrame, *, unknown: int = 1) -> DataFrame:
    """(id, ids, label) from df (id, tokens, label) and vocab (token, id) of any size; rows without tokens are left out."""
    return corpus.encode(df.filter(F.size("tokens") > 0), vocab, ["id", "label"], unknown=unknown).select("id", "ids", "label")


def lm_scoring(df: DataFrame, vocab: DataFrame, *, unknown: int = 1) -> DataFrame:
    """(id, context_ids, candidates, gold) from df (id, context, candidates, gold); rows with an empty part are left out.

    A row's parts are encoded as one array, and cut again by their sizes.
    """
    whole = (F.size("context") > 0) & (F.size("candidates") > 0) & ~F.exists("candidates", lambda c: F.size(c) == 0)
    sizes = F.transform("candidates", lambda c: F.size(c))
    flat = df.filter(whole).select("id", "gold", F.size("context").alias("n"), sizes.alias("sizes"), F.concat("context", F.flatten("candidates")).alias("tokens"))
    made = corpus.encode(flat, vocab, ["id", "gold", "n", "sizes"], unknown=unknown)
    before = lambda k: F.aggregate(F.slice("sizes", F.lit(1), k), F.lit(0), lambda a, x: a + x)
    cut = F.transform("sizes", lambda size, k: F.slice("ids", F.col("n") + before(k) + 1, size))
    return made.select("id", F.slice("ids", F.lit(1), F.col("n")).alias("context_ids"), cut.alias("candidates"), "gold")


def summary(made: DataFrame, *, unknown: int = 1) -> DataFrame:
    """(task, n, unk_rate, label_counts) of classification or lm_scoring rows; label_counts is null for the latter."""
    scored = "candidates" in made.columns
    flat = F.concat("context_ids", F.flatten("candidates")) if scored else F.col("ids")
    each = made.select(F.size(flat).cast("long").alias("n_ids"), F.size(F.filter(flat, lambda x: x == unknown)).cast("long").alias("n_unk"), (F.lit(None).cast("int") if scored else F.col("label").cast("int")).alias("label"))
    by = each.groupBy("label").agg(F.count("*").alias("n"), F.sum("n_ids").alias("n_ids"), F.sum("n_unk").alias("n_unk"))  # a row for each label
    counts = F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "n"))))
    rate = F.sum("n_unk") / F.greatest(F.sum("n_ids"), F.lit(1))
    return by.agg(F.lit("lm_scoring" if scored else "classification").alias("task"), F.sum("n").alias("n"), rate.alias("unk_rate"), (F.lit(None).cast("map<int,bigint>") if scored else counts).alias("label_counts"))


def candidate_scores(df: DataFrame, lexed: DataFrame, *, max_len: int = 128) -> DataFrame:
    """(id, gold, nlls, pred) from df (id, context, candidates, gold): the candidate with the least summed nll, of equal ones the first.

    Contexts keep their last max_len - 2 tokens, candidates as many of their first as have room, one at least. The model is
    the bigram model of lexed, so a candidate's first token is scored by the context's last. Rows with an empty part are left out.
    """
    whole = (F.size("context") > 0) & (F.size("candidates") > 0) & ~F.exists("candidates", lambda c: F.size(c) == 0)
    room = F.greatest(F.lit(max_len) - F.least(F.size("context"), F.lit(max_len - 2)), F.lit(1))
    last = F.slice("context", -1, 1)
    each = df.filter(whole).select("id", "gold", room.alias("room"), last.alias("last"), F.posexplode("candidates").alias("k", "c"))
    each = each.select("id", "gold", "k", F.concat("last", F.slice("c", F.lit(1), F.col("room"))).alias("tokens"))
    scored = B.score_pairs(B._pairs(each, ["id", "gold", "k"]), lexed)
    sums = scored.groupBy("id", "gold", "k").agg(F.round(F.sum("nll"), 6).alias("nll"))
    made = sums.groupBy("id", "gold").agg(F.array_sort(F.collect_list(F.struct("k", "nll"))).alias("x"), F.min(F.struct("nll", "k")).alias("best"))  # a few candidates
    return made.select("id", "gold", "x.nll", F.col("best.k").alias("pred")).withColumnRenamed("nll", "nlls")
