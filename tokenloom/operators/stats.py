"""Reports over token streams and scores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.functions import text as T

STRUCTURED = ["CMP", "ROOT", "STR", "REL"]


def coverage(weights: DataFrame, keys: list[str], gate: float = 0.55) -> DataFrame:
    """Tokens by type and the structured share, from counts (keys, token, n)."""
    kind = F.substring_index("token", ":", 1)

    def count(kinds: list[str]) -> Column:
        return F.sum(F.when(kind.isin(kinds), F.col("n")).otherwise(0))

    kinds = {k.lower(): count([k]) for k in ("CMP", "ROOT", "STR", "REL", "LIT")}
    made = weights.groupBy(*keys).agg(F.sum("n").alias("total"), *(c.alias(k) for k, c in kinds.items()), count(STRUCTURED).alias("structured"))
    return made.withColumn("ratio", F.col("structured") / F.col("total")).withColumn("gate", F.col("ratio") >= gate)


def top(weights: DataFrame, keep: Callable[[Column], Column], key: Callable[[Column], Column], n: int) -> DataFrame:
    """The n most frequent keys of the tokens (token, n) that keep picks; of equal ones the first by name."""
    each = weights.filter(keep(F.col("token")))
    return each.groupBy(key(F.col("token")).alias("key")).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "key").limit(n)


def literal_buckets(counts: DataFrame) -> DataFrame:
    own = counts.filter(F.col("token").startswith("LIT:")).select(T.literal_bucket(F.substr("token", F.lit(5))).alias("bucket"), "n")
    made = own.groupBy("bucket").agg(F.count("*").alias("kinds"), F.sum("n").alias("n"))
    over = Window.partitionBy(F.lit(0))  # a row for each bucket, seven at most
    share = {f"{c}_pct": F.round(100.0 * F.col(c) / F.sum(c).over(over), 2) for c in ("kinds", "n")}
    return made.withColumns(share)


def length_distribution(sizes: DataFrame, left: str = "d", right: str = "r", names: tuple[str, str] = ("default", "reasoning")) -> DataFrame:
    made = []
    for c, n in zip((left, right), names):
        made += [F.avg(c).alias(f"mean_{n}"), F.median(c).alias(f"median_{n}"), F.percentile(c, F.lit(0.9)).alias(f"p90_{n}"), F.max(c).alias(f"max_{n}")]
    return sizes.agg(*made, (F.avg(left) / F.avg(right)).alias("ratio"))


def binary_metrics(df: DataFrame, pred: str, gold: str, keys: list[str] | None = None) -> DataFrame:
    def count(p: int, g: int) -> Column:
        return F.sum(F.when((F.col(pred) == p) & (F.col(gold) == g), 1).otherwise(0))

    made = df.groupBy(*(keys or [])).agg(F.count("*").alias("n"), count(1, 1).alias("tp"), count(1, 0).alias("fp"), count(0, 0).alias("tn"), count(0, 1).alias("fn"))
    precision, recall = F.col("tp") / F.greatest(F.lit(1), F.col("tp") + F.col("fp")), F.col("tp") / F.greatest(F.lit(1), F.col("tp") + F.col("fn"))
    f1 = 2 * precision * recall / F.greatest(F.lit(1e-12), precision + recall)
    accuracy = (F.col("tp") + F.col("tn")) / F.greatest(F.lit(1), F.col("n"))
    return made.withColumns({"accuracy": F.round(accuracy, 4), "precision": F.round(precision, 4), "recall": F.round(recall, 4), "f1": F.round(f1, 4)})


def grouped_accuracy(df: DataFrame, keys: list[str]) -> DataFrame:
    """Accuracy over all and by each key, in one pass of grouping sets; df has a boolean `right`."""
    return df.groupingSets([[], *([k] for k in keys)], *keys).agg(
        F.grouping_id(*keys).alias("level"), F.count("*").alias("n"), F.avg(F.col("right").cast("int")).alias("accuracy")
    )


def mean_std(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean and sample deviation, which is 0 for one value."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"))


def welch(stats: DataFrame, key: str) -> DataFrame:
    """t and degrees of freedom of each pair of groups (n, mean, std); null for fewer than two values.

    stats has a row for each group of runs, so the pairs are few whatever the runs measured.
    """
    a = stats.select(F.col(key).alias("a"), F.col("n").alias("na"), F.col("mean").alias("ma"), (F.col("std") ** 2).alias("va"))
    b = stats.select(F.col(key).alias("b"), F.col("n").alias("nb"), F.col("mean").alias("mb"), (F.col("std") ** 2).alias("vb"))
    pair = a.join(b, F.col("a") < F.col("b"))
    ea, eb = F.col("va") / F.col("na"), F.col("vb") / F.col("nb")
    ok = (F.col("na") > 1) & (F.col("nb") > 1) & (ea + eb > 0)
    return pair.select(
        "a", "b", F.when(ok, (F.col("ma") - F.col("mb")) / F.sqrt(ea + eb)).alias("t"),
        F.when(ok, (ea + eb) ** 2 / (ea**2 / (F.col("na") - 1) + eb**2 / (F.col("nb") - 1))).alias("dof"),
    )


def signal_gate(scores: DataFrame, *, full: float = 0.6, gap: float = 0.03, wins: float = 0.6) -> DataFrame:
    """Means of three controls, gaps, win rates, and whether all thresholds hold."""
    made = scores.agg(
        F.count("*").alias("n"), F.avg("p_full").alias("mean_full"), F.avg("p_qonly").alias("mean_qonly"), F.avg("p_shuf").alias("mean_shuf"),
        F.avg((F.col("p_full") > F.col("p_qonly")).cast("int")).alias("wins_qonly"), F.avg((F.col("p_full") > F.col("p_shuf")).cast("int")).alias("wins_shuf"),
    )
    made = made.withColumns({"gap_qonly": F.col("mean_full") - F.col("mean_qonly"), "gap_shuf": F.col("mean_full") - F.col("mean_shuf")})
    return made.withColumn("passed", (F.col("mean_full") >= full) & (F.col("gap_qonly") >= gap) & (F.col("gap_shuf") >= gap) & (F.col("wins_qonly") >= wins) & (F.col("wins_shuf") >= wins))


ARCHITECTURE = ["max_len", "d_model", "n_heads", "n_layers", "d_ff", "dropout"]
SIZES = ["train", "val", "test"]


def verdict(runs: DataFrame, *, full: float = 0.03, gap_qonly: float = 0.02, gap_shuffled: float = 0.02) -> DataFrame:
    """The six-way decision from two evaluations in a row: structs own and base of (passed, full, gap_q, gap_s, config, sizes).

    Deltas are rounded to four places before they meet the thresholds. The comparison is fair if architectures and split
    sizes agree; without both configs it is not, and is said to be partial.
    """
    own, base = F.col("own"), F.col("base")
    deltas = {f"delta_{n}": F.round(own[c] - base[c], 4) for n, c in (("full", "full"), ("gap_q", "gap_q"), ("gap_s", "gap_s"))}
    both = own["config"].isNotNull() & base["config"].isNotNull()
    same = F.lit(True)
    for k in ARCHITECTURE:
        same = same & own["config"][k].eqNullSafe(base["config"][k])
    sized = {k: own["sizes"][k].eqNullSafe(base["sizes"][k]) for k in SIZES}
    warnings = [F.when(~both, "partial"), F.when(both & ~same, "architecture"), *(F.when(both & ~c, k) for k, c in sized.items())]
    made = runs.withColumns(deltas).withColumn("stronger", (F.col("delta_full") >= full) & (F.col("delta_gap_q") >= gap_qonly) & (F.col("delta_gap_s") >= gap_shuffled))
    made = made.withColumn("warnings", F.array_compact(F.array(*warnings))).withColumn("fair", F.size("warnings") == 0)
    o, b, stronger = own["passed"], base["passed"], F.col("stronger")
    said = (
        F.when(o & ~b, "advantage_supported").when(o & b & stronger, "advantage_supported").when(o & b, "inconclusive_both_pass")
        .when(~o & b, "disadvantage_baseline_wins").when(stronger, "better_but_not_ready").otherwise("no_evidence_of_advantage")
    )
    return made.withColumn("verdict", said)


def hard_logic_gate(rows: DataFrame, *, examples: int = 1000, full: float = 0.6, majority: float = 0.1, question: float = 0.05, shuffled: float = 0.05) -> DataFrame:
    """Accuracy in three modes from rows (gold, full, question_only, shuffled: predictions), gaps, and which of five criteria fail.

    Rows without a gold label don't count for the majority, whose share is over the rows with one.
    """
    modes = ["full", "question_only", "shuffled"]
    counted = rows.filter("gold is not null").groupBy("gold").agg(F.count("*").alias("n"), *(F.sum((F.col(m) == F.col("gold")).cast("long")).alias(m) for m in modes))
    made = counted.agg(F.sum("n").alias("n"), (F.max("n") / F.sum("n")).alias("majority"), *((F.sum(m) / F.sum("n")).alias(f"acc_{m}") for m in modes))
    gaps = {"gap_majority": "majority", "gap_question": "acc_question_only", "gap_shuffled": "acc_shuffled"}
    made = made.withColumns({g: F.round(F.col("acc_full") - F.col(c), 4) for g, c in gaps.items()})
    checks = [("enough_examples", F.col("n") >= examples), ("full_acc", F.col("acc_full") >= full), ("gap_majority", F.col("gap_majority") >= majority), ("gap_question", F.col("gap_question") >= question), ("gap_shuffled", F.col("gap_shuffled") >= shuffled)]
    failed = F.array_compact(F.array(*(F.when(~c, F.lit(n)) for n, c in checks)))
    return made.withColumn("failed", F.array_join(failed, " ")).withColumn("passed", F.size(failed) == 0)


def parity(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """How far two tokenizations (arrays left and right of the same rows) agree.

    A row with kind `rows` has the numbers of rows that agree exactly, as sorted tokens and as sorted types; each other
    row has a type's tokens on both sides and their difference in percent of the larger.
    """

    def types(c):
        return F.transform(c, lambda t: F.substring_index(t, ":", 1))

    def same(f):
        return F.sum((f(F.col(left)) == f(F.col(right))).cast("long"))

    none = F.lit(None).cast("long")
    totals = pairs.agg(F.count("*").alias("n"), same(lambda c: F.array_join(c, " ")).alias("exact"), same(lambda c: F.array_join(F.array_sort(c), " ")).alias("same_set"), same(lambda c: F.array_join(F.array_sort(types(c)), " ")).alias("same_types"))
    totals = totals.select(F.lit("rows").alias("kind"), F.lit("").alias("type"), "n", "exact", "same_set", "same_types", none.alias("left"), none.alias("right"), F.lit(None).cast("double").alias("diff_pct"))
    sides = [pairs.select(F.explode(types(F.col(c))).alias("type"), F.lit(int(c == left)).alias("l")) for c in (left, right)]
    by = sides[0].unionByName(sides[1]).groupBy("type").agg(F.sum("l").alias("left"), F.sum(1 - F.col("l")).alias("right"))
    by = by.withColumn("diff_pct", F.round(100 * F.abs(F.col("left") - F.col("right")) / F.greatest("left", "right", F.lit(1)), 4))
    return totals.unionByName(by.select(F.lit("type").alias("kind"), "type", *(none.alias(c) for c in ("n", "exact", "same_set", "same_types")), "left", "right", "diff_pct"))


def compared(runs: DataFrame) -> DataFrame:
    """runs (run, own, base; less is better) with their difference, its share of base in percent, and the winner."""
    delta = F.col("own") - F.col("base")
    winner = F.when(delta < 0, "own").when(delta > 0, "base").otherwise("tie")
    return runs.select("run", "own", "base", F.round(delta, 4).alias("delta"), F.round(100 * delta / F.col("base"), 2).alias("pct"), winner.alias("winner"))


def bits_per_character(scored: DataFrame, keys: list[str]) -> DataFrame:
    """From rows (nll, n_tokens, n_chars): bits per character and perplexity with the exponent held at 20."""
    made = scored.groupBy(*keys).agg(F.sum("nll").alias("nll"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_chars").alias("n_chars"))
    return made.withColumns({"bpc": F.col("nll") / F.col("n_chars") / F.log(F.lit(2.0)), "perplexity": F.exp(F.least(F.col("nll") / F.col("n_tokens"), F.lit(20.0)))})


def examples(rows: DataFrame, bucket: str, first: str, names: list[str], *, seen: int = 200, most: int = 50) -> DataFrame:
    """rows with k: of the first `seen` rows of each bucket by `first`, the `most` with the largest n, then by name."""
    early = Window.partitionBy(bucket).orderBy(first)
    often = Window.partitionBy(bucket).orderBy(F.desc("n"), *names)
    kept = rows.withColumn("_r", F.row_number().over(early)).filter(F.col("_r") <= seen).drop("_r")
    return kept.withColumn("k", F.row_number().over(often)).filter(F.col("k") <= most)


def sample_top(df: DataFrame, scores: str, name: str, u: Column | None = None, *, temperature: float = 1.0, top: int = 40) -> DataFrame:
    """df with `name`: the place, from 0, of one of the `top` best scores, drawn by u in [0, 1) from their softmax; at no temperature the best's.

    Of equal scores the first is the better. Each step is a projection of its own, so that none is evaluated again for every score.
    """
    if temperature <= 0:
        return df.withColumn(name, F.array_position(scores, F.array_max(scores)).cast("int") - 1)
    best = F.slice(F.array_sort(F.transform(scores, lambda x, i: F.struct((-x).alias("m"), i.alias("i")))), 1, top)
    made = df.withColumn("_b", best).withColumn("_m", F.get("_b", F.lit(0))["m"])
    made = made.withColumn("_w", F.transform("_b", lambda b: F.exp((F.col("_m") - b["m"]) / temperature))).withColumn("_r", u * F.aggregate("_w", F.lit(0.0), lambda a, b: a + b))
    # how many sums of the first weights stay below the drawn share
    below = F.aggregate("_w", F.struct(F.lit(0.0).alias("c"), F.lit(0).alias("n")), lambda a, w: F.struct((a["c"] + w).alias("c"), (a["n"] + (a["c"] + w < F.col("_r")).cast("int")).alias("n")))
    made = made.withColumn("_n", below["n"])
    at = F.when(F.col("_n") < F.size("_b"), F.col("_n")).otherwise(0)
    return made.withColumn(name, F.get("_b", at)["i"].cast("int")).drop("_b", "_m", "_w", "_r", "_n")


def answer_candidates(counts: DataFrame, vocab: DataFrame, fallback: dict[int, list[str]], *, most: int = 5) -> DataFrame:
    """(lang, label, top, chosen) from counts (lang, label, token, n): each group's most frequent tokens, and of them and the
    label's fallbacks the first that the vocabulary (token) has, else the very first."""
    order = Window.partitionBy("lang", "label").orderBy(F.desc("n"), "token")
    ranked = counts.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= most).select("lang", "label", "token", "r")
    rest = F.lit(None).cast("array<string>")
    for label, tokens in fallback.items():
        rest = F.when(F.col("label") == label, F.array(*map(F.lit, tokens))).otherwise(rest)
    more = ranked.select("lang", "label").distinct().select("lang", "label", F.posexplode(rest).alias("r", "token")).select("lang", "label", "token", (F.col("r") + most + 1).alias("r"), F.lit(False).alias("seen"))
    # a few rows for each group
    each = F.broadcast(ranked.withColumn("seen", F.lit(True)).unionByName(more))
    known = vocab.filter("token <> '[UNK]'").select("token", F.lit(True).alias("known"))
    found = each.join(known, "token", "left").groupBy("lang", "label").agg(
        F.array_sort(F.collect_list(F.when(F.col("seen"), F.struct("r", "token")))).alias("x"), F.min_by("token", F.struct(F.col("known").isNull(), F.col("r"))).alias("chosen"),
    )
    return found.select("lang", "label", F.col("x.token").alias("top"), F.when(F.size("x") > 0, F.col("chosen")).alias("chosen"))


def unigram_runs(streams: DataFrame) -> DataFrame:
    """(group, name, n, avg_tokens, bpc) from streams (group, name, tokens, n_chars): what each tokenizer's tokens cost by their own frequencies."""
    sizes = streams.groupBy("group", "name").agg(F.count("*").alias("n"), F.sum(F.size("tokens")).alias("total"), F.sum("n_chars").alias("chars"))  # a row for each run
    counts = streams.select("group", "name", F.explode("tokens").alias("token")).groupBy("group", "name", "token").agg(F.count("*").alias("k"))
    bits = counts.join(F.broadcast(sizes), ["group", "name"]).groupBy("group", "name").agg(F.sum(-F.col("k") * F.log2(F.col("k") / F.col("total"))).alias("bits"))
    return sizes.join(F.broadcast(bits), ["group", "name"]).select("group", "name", "n", (F.col("total") / F.col("n")).alias("avg_tokens"), (F.col("bits") / F.col("chars")).alias("bpc"))


def compare_runs(runs: DataFrame, a: str, b: str) -> DataFrame:
    """Two names of each group side by side: what a saves of b's bits per character in percent, the ratio of tokens, the winner."""
    picked = [F.max(F.when(F.col("name") == name, F.struct("bpc", "avg_tokens"))).alias(side) for name, side in ((a, "_a"), (b, "_b"))]
    both = runs.groupBy("group").agg(*picked).filter("_a is not null and _b is not null")
    x, y = F.round("_a.bpc", 6), F.round("_b.bpc", 6)
    return both.select(
        "group", x.alias("bpc_a"), y.alias("bpc_b"), F.round(100 * (y - x) / y, 1).alias("delta_pct"), F.round(F.col("_a.avg_tokens") / F.col("_b.avg_tokens"), 2).alias("token_ratio"),
        F.when(x < y, a).when(x > y, b).otherwise("tie").alias("winner"),
    )
