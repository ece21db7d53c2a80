"""Metrics, gates, significance, parity and scores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tokenloom import lexicon as L
from tokenloom.functions import text as T
from tokenloom.functions import tokens as K
from tokenloom.operators import corpus as C
from tokenloom.operators import downstream as W
from tokenloom.operators import shared
from tokenloom.operators import stats as S
from tokenloom.plans import dialect as D
from tokenloom.plans.registry import query, read
from tokenloom.streaming import streams
from tokenloom.plans.vocabulary import _BI, CAP, _shown, _top, _vocab


def _predicted(spark, sf):
    """(doc_id, lang, source, pred, gold): a rule's guess of each label."""
    docs = read(spark, sf, "documents").select("doc_id", "lang", "source", (F.col("n_chars") > 1000).cast("int").alias("pred"))
    return docs.join(read(spark, sf, "labels").select("doc_id", F.col("quality").alias("gold")), "doc_id")


_PRED = "pred as (select doc_id, lang, source, (n_chars > 1000)::int as pred, quality as gold from documents join labels using (doc_id))"
_METRICS = """count(*) as n, count(*) filter (where pred = 1 and gold = 1) as tp, count(*) filter (where pred = 1 and gold = 0) as fp, count(*) filter (where pred = 0 and gold = 0) as tn, count(*) filter (where pred = 0 and gold = 1) as fn"""


@query(f"""with {_PRED}, m as (select lang, {_METRICS} from pred group by lang), r as (select *, tp / greatest(1, tp + fp) as p, tp / greatest(1, tp + fn) as rc from m)
    select lang, n, tp, fp, tn, fn, round((tp + tn) / greatest(1, n), 4) as accuracy, round(p, 4) as precision, round(rc, 4) as recall, round(2 * p * rc / greatest(1e-12, p + rc), 4) as f1 from r""")
def agg_binary_metrics(spark, sf):
    return S.binary_metrics(_predicted(spark, sf), "pred", "gold", ["lang"])


@query(f"with {_PRED} select lang, gold, grouping_id(lang, gold) as level, count(*) as n, avg((pred = gold)::int) as accuracy from pred group by grouping sets ((), (lang), (gold))")
def agg_grouped_accuracy(spark, sf):
    return S.grouped_accuracy(_predicted(spark, sf).withColumn("right", F.col("pred") == F.col("gold")), ["lang", "gold"])


@query(f"with {_PRED}, c as (select lang, gold, count(*) as n from pred group by lang, gold) select lang, arg_max(gold, (n, -gold)) as majority, max(n) / sum(n) as share from c group by lang")
def agg_majority(spark, sf):
    """The most frequent label of each language; of equal ones the smaller."""
    counts = _predicted(spark, sf).groupBy("lang", "gold").agg(F.count("*").alias("n"))
    return counts.groupBy("lang").agg(F.max_by("gold", F.struct("n", -F.col("gold"))).alias("majority"), (F.max("n") / F.sum("n")).alias("share"))


FALLBACK = {1: ["ROOT:yes", "ROOT:true"], 0: ["REL:neg", "STR:neg:general", "ROOT:false"]}
ANSWER_CAP = 12


@query(f"""with {_top(ANSWER_CAP).replace('lexed', 'lexed_all')}, {D.REASON}, t as (select lang, quality as label, unnest(reasoning_tokens) as token from proj join labels using (doc_id)), c as (select lang, label, token, count(*) as n from t where token not in {D.items(L.SPECIALS)} group by all),
    o as (select lang, label, token, row_number() over (partition by lang, label order by n desc, token) as r, true as seen from c), fall(label, token, r) as ({' union all '.join(f"select {k}, {D.quote(t)}, {i + 6}" for k, ts in FALLBACK.items() for i, t in enumerate(ts))}),
    x as (select * from o where r <= 5 union all select distinct lang, o.label, fall.token, fall.r, false from o join fall using (label))
    select lang, label, string_agg(token, ' ' order by r) filter (where seen) as top, arg_min(token, (token not in (select token from vocab where token <> '[UNK]'), r)) as chosen from x group by lang, label""")
def agg_top5_answer_tokens(spark, sf):
    """The five most common reasoning tokens of each language and label, and the first that a small vocabulary has."""
    docs = C.sentences(read(spark, sf, "documents")).select("doc_id", "lang", K.reasoning_kept(K.lex_english(F.col("sent")), "en").alias("k")).select("doc_id", "lang", K.reasoning_collapse(F.col("k")).alias("tokens"))
    labelled = docs.join(read(spark, sf, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id")
    counts = labelled.select("lang", "label", F.explode("tokens").alias("token")).filter(~F.col("token").isin(L.SPECIALS)).groupBy("lang", "label", "token").agg(F.count("*").alias("n"))
    counts = shared.stored(counts)  # read for the answers and for their fallbacks
    return _shown(S.answer_candidates(counts, _vocab(spark, sf, ANSWER_CAP), FALLBACK), "top")


@query()
def agg_edit_distance_by_label(spark, sf):
    """Edit distance of the reasoning tokens of a turn and the next one by label, and the tokens that the projection keeps of 1000.

    No SQL: the other engine's distance counts bytes. A test holds it against brute force.
    """
    turns = read(spark, sf, "conversations").select("conv_id", "turn", K.lex_english(F.col("text")).alias("d")).withColumn("k", K.reasoning_kept(F.col("d"), "en"))
    turns = turns.select("conv_id", "turn", F.size("d").alias("size"), K.reasoning_collapse(F.col("k")).alias("r"))
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("r").alias("r2"), F.col("size").alias("size2"))
    pairs = turns.join(after, ["conv_id", "turn"]).withColumn("label", F.element_at(F.array(F.lit("entails"), F.lit("neutral"), F.lit("contradicts")), F.pmod("turn", F.lit(3)).cast("int") + 1))
    distance = pairs.select(F.lit("distance").alias("kind"), "label", T.edit_distance(F.col("r"), F.col("r2")).cast("long").alias("x"))
    sides = pairs.select(F.explode(F.array(F.struct(F.col("r").alias("r"), F.col("size").alias("size")), F.struct(F.col("r2").alias("r"), F.col("size2").alias("size")))).alias("s")).filter("s.size > 0")
    kept = sides.select(F.lit("kept_of_1000").alias("kind"), F.lit("").alias("label"), (F.size("s.r") / F.col("s.size") * 1000).cast("long").alias("x"))
    std = F.round(F.coalesce(F.stddev_samp("x"), F.lit(0.0)), 3)
    return distance.unionByName(kept).groupBy("kind", "label").agg(F.count("*").alias("n"), F.round(F.avg("x"), 3).alias("mean"), F.median("x").alias("median"), std.alias("std"))


@query("select source, count(*) as n, avg(n_chars) as mean, round(coalesce(stddev_samp(n_chars), 0), 6) as std from documents group by source")
def agg_mean_std(spark, sf):
    return S.mean_std(read(spark, sf, "documents").select("source", "n_chars"), ["source"], "n_chars").withColumn("std", F.round("std", 6))


@query("""with s as (select lang, count(*) as n, avg(n_chars) as m, coalesce(stddev_samp(n_chars), 0) ** 2 as v from documents group by lang)
    select a.lang as a, b.lang as b, round((a.m - b.m) / sqrt(a.v / a.n + b.v / b.n), 6) as t, round((a.v / a.n + b.v / b.n) ** 2 / ((a.v / a.n) ** 2 / (a.n - 1) + (b.v / b.n) ** 2 / (b.n - 1)), 6) as dof from s a join s b on a.lang < b.lang""")
def agg_welch_t(spark, sf):
    made = S.welch(S.mean_std(read(spark, sf, "documents").select("lang", "n_chars"), ["lang"], "n_chars"), "lang")
    return made.withColumns({"t": F.round("t", 6), "dof": F.round("dof", 6)})


_TYPES = "list_transform({}, lambda t: string_split(t, ':')[1])"


@query(f"""with {D.tokenized()}, {D.token_parts(True, "2")}, p as (select tok.tokens as a, tok2.tokens as b from tok join tok2 using (doc_id, pos)),
    t as (select unnest({_TYPES.format('a')}) as type, 1 as l from p union all select unnest({_TYPES.format('b')}), 0 from p), c as (select type, sum(l)::bigint as l, sum(1 - l)::bigint as r from t group by type)
    select 'rows' as kind, '' as type, count(*) as n, count(*) filter (where a = b) as exact, count(*) filter (where list_sort(a) = list_sort(b)) as same_set, count(*) filter (where list_sort({_TYPES.format('a')}) = list_sort({_TYPES.format('b')})) as same_types,
        null::bigint as "left", null::bigint as "right", null::double as diff_pct from p
    union all select 'type', type, null, null, null, null, l, r, round(100 * abs(l - r) / greatest(l, r, 1), 4) from c""")
def agg_parity(spark, sf):
    """How far the fused and the atomic tokenizer agree: rows paired by their ids, and tokens of each type on both sides."""
    made = C.tokenize_both(read(spark, sf, "documents"))
    return S.parity(shared.stored(made), "fused", "atomic")


_SCORES = "scores as (select event_id, 0.5 + (event_id % 7) / 14.0 as p_full, 0.4 + (event_id % 5) / 10.0 as p_qonly, 0.3 + (event_id % 3) / 10.0 as p_shuf from events)"
_GATE = """g as (select count(*) as n, avg(p_full) as mean_full, avg(p_qonly) as mean_qonly, avg(p_shuf) as mean_shuf, avg((p_full > p_qonly)::int) as wins_qonly, avg((p_full > p_shuf)::int) as wins_shuf from scores)"""


def _scores(spark, sf):
    e = F.col("event_id")
    return read(spark, sf, "events").select("event_id", (0.5 + e % 7 / 14.0).alias("p_full"), (0.4 + e % 5 / 10.0).alias("p_qonly"), (0.3 + e % 3 / 10.0).alias("p_shuf"))


@query(f"""with {_SCORES.replace('14.0', '14.0::double').replace('10.0', '10.0::double').replace('0.5 +', '0.5::double +').replace('0.4 +', '0.4::double +').replace('0.3 +', '0.3::double +')}, {_GATE}
    select n, round(mean_full, 6) as mean_full, round(mean_full - mean_qonly, 6) as gap_qonly, round(mean_full - mean_shuf, 6) as gap_shuf, wins_qonly, wins_shuf,
        mean_full >= 0.6 and mean_full - mean_qonly >= 0.03 and mean_full - mean_shuf >= 0.03 and wins_qonly >= 0.6 and wins_shuf >= 0.6 as passed from g""")
def agg_signal_gate(spark, sf):
    made = S.signal_gate(_scores(spark, sf))
    return made.select("n", *(F.round(c, 6).alias(c) for c in ("mean_full", "gap_qonly", "gap_shuf")), "wins_qonly", "wins_shuf", "passed")


_MODES = """modes as (select case when event_id % 50 <> 0 then event_id % 2 end as gold, case when event_id % 5 < 4 then event_id % 2 else 1 - event_id % 2 end as f, (event_id % 3 = 0)::int as q, (event_id % 7 < 3)::int as s from events)"""


@query(f"""with {_MODES}, c as (select gold, count(*) as n, sum((f = gold)::int) as f, sum((q = gold)::int) as q, sum((s = gold)::int) as s from modes where gold is not null group by gold),
    m as (select sum(n)::bigint as n, max(n) / sum(n) as majority, sum(f) / sum(n) as acc_full, sum(q) / sum(n) as acc_question_only, sum(s) / sum(n) as acc_shuffled from c),
    g as (select *, round(acc_full - majority, 4) as gap_majority, round(acc_full - acc_question_only, 4) as gap_question, round(acc_full - acc_shuffled, 4) as gap_shuffled from m),
    x as (select *, list_filter([case when not n >= 1000 then 'enough_examples' end, case when not acc_full >= 0.6 then 'full_acc' end, case when not gap_majority >= 0.1 then 'gap_majority' end, case when not gap_question >= 0.05 then 'gap_question' end,
        case when not gap_shuffled >= 0.05 then 'gap_shuffled' end], lambda f: f is not null) as l from g)
    select * exclude (l), array_to_string(l, ' ') as failed, len(l) = 0 as passed from x""")
def agg_hard_logic_gate(spark, sf):
    """Accuracy with everything, with the question only and with other rows' steps; gaps, and which of the five criteria fail."""
    e = F.col("event_id")
    rows = read(spark, sf, "events").select(
        F.when(e % 50 != 0, e % 2).alias("gold"), F.when(e % 5 < 4, e % 2).otherwise(1 - e % 2).alias("full"), (e % 3 == 0).cast("long").alias("question_only"), (e % 7 < 3).cast("long").alias("shuffled"),
    )
    return S.hard_logic_gate(rows)


_SIDE = """avg(value) >= 20 as p, floor(avg(value) * 50) / 1000 as f, floor(avg(event_id % 7) * 20) / 1000 as q, floor(avg(event_id % 11) * 12.5) / 1000 as s, case when count(*) % 5 = 0 then null when count(*) % 3 = 0 then '512' else '256' end as c, case when count(*) % 2 = 0 then 1000 else 900 end as t"""


@query(f"""with e as (select event_type || '-' || user_id % 10 as run, event_id % 2 as side, value, event_id from events), o as (select run, {_SIDE} from e where side = 0 group by run), b as (select run, {_SIDE} from e where side = 1 group by run),
    d as (select run, o.p as op, b.p as bp, o.c as oc, b.c as bc, o.t as ot, b.t as bt, round(o.f - b.f, 4) as delta_full, round(o.q - b.q, 4) as delta_gap_q, round(o.s - b.s, 4) as delta_gap_s, o.c is not null and b.c is not null as both_ from o join b using (run)),
    x as (select *, delta_full >= 0.03 and delta_gap_q >= 0.02 and delta_gap_s >= 0.02 as stronger, list_filter([case when not both_ then 'partial' end, case when both_ and oc <> bc then 'architecture' end, case when both_ and ot <> bt then 'train' end], lambda w: w is not null) as w from d)
    select run, delta_full, delta_gap_q, delta_gap_s, stronger, array_to_string(w, ' ') as warnings, len(w) = 0 as fair, case when op and not bp then 'advantage_supported' when op and stronger then 'advantage_supported' when op then 'inconclusive_both_pass'
        when bp then 'disadvantage_baseline_wins' when stronger then 'better_but_not_ready' else 'no_evidence_of_advantage' end as verdict from x""")
def agg_verdict(spark, sf):
    """Decisions from pairs of evaluations: thresholded deltas, and whether the comparison was fair. Runs are kinds of events of
    some users, evaluated over even events against odd ones."""
    events = read(spark, sf, "events").select(F.concat("event_type", F.lit("-"), (F.col("user_id") % 10).cast("string")).alias("run"), (F.col("event_id") % 2).alias("side"), "value", "event_id")
    n = F.count("*")
    config = F.when(n % 5 == 0, F.lit(None).cast("map<string,string>")).otherwise(F.create_map(F.lit("d_model"), F.when(n % 3 == 0, "512").otherwise("256")))
    sizes = F.create_map(F.lit("train"), F.when(n % 2 == 0, 1000).otherwise(900))
    side = F.struct(
        (F.avg("value") >= 20).alias("passed"), (F.floor(F.avg("value") * 50) / 1000).alias("full"), (F.floor(F.avg(F.col("event_id") % 7) * 20) / 1000).alias("gap_q"), (F.floor(F.avg(F.col("event_id") % 11) * 12.5) / 1000).alias("gap_s"),
        config.alias("config"), sizes.alias("sizes"),
    )
    own, base = (events.filter(F.col("side") == k).groupBy("run").agg(side.alias(c)) for k, c in enumerate(("own", "base")))
    made = S.verdict(own.join(base, "run"))
    return made.select("run", "delta_full", "delta_gap_q", "delta_gap_s", "stronger", F.array_join("warnings", " ").alias("warnings"), "fair", "verdict")


@query(f"with {_PRED} select a.lang, a.acc - b.acc as delta, a.n = b.n as same_n from (select lang, avg((pred = gold)::int) as acc, count(*) as n from pred group by lang) a join (select lang, avg((1 = gold)::int) as acc, count(*) as n from pred group by lang) b using (lang)")
def agg_paired_delta(spark, sf):
    own = _predicted(spark, sf)

    def accuracy(right):
        return own.groupBy("lang").agg(F.avg(right.cast("int")).alias("acc"), F.count("*").alias("n"))

    a, b = accuracy(F.col("pred") == F.col("gold")).alias("a"), accuracy(F.col("gold") == 1).alias("b")
    return a.join(b, "lang").select("lang", (F.col("a.acc") - F.col("b.acc")).alias("delta"), (F.col("a.n") == F.col("b.n")).alias("same_n"))


@query(f"""with {D.SENT}, {D.REASON}, r as (select source as run, round(sum(len(reasoning_tokens)) / sum(length(sent)), 6) as own, round(sum(len(string_split(sent, ' '))) / sum(length(sent)), 6) as base from proj join sent using (doc_id, pos) group by source)
    select run, own, base, round(own - base, 4) as delta, round(100 * (own - base) / base, 2) as pct, case when own < base then 'own' when own > base then 'base' else 'tie' end as winner from r""")
def agg_compare_bpc(spark, sf):
    """Two codecs' tokens a character, by source: the difference, its percentage, and which needs fewer."""
    sents = C.sentences(read(spark, sf, "documents")).select("source", "sent", K.reasoning_kept(K.lex_english(F.col("sent")), "en").alias("k"))
    sizes = sents.select("source", F.length("sent").alias("chars"), F.size(K.reasoning_collapse(F.col("k"))).alias("own"), F.size(F.split("sent", " ")).alias("base"))
    runs = sizes.groupBy(F.col("source").alias("run")).agg(*(F.round(F.sum(c) / F.sum("chars"), 6).alias(c) for c in ("own", "base")))
    return S.compared(runs)


@query(f"""with {D.SENT}, {D.REASON}, st as (select lang as "group", 'default' as name, default_tokens as tokens, doc_id, pos from proj union all select lang, 'reasoning', reasoning_tokens, doc_id, pos from proj),
    z as (select "group", name, count(*) as n, sum(len(tokens)) as total, sum(length(sent)) as chars from st join sent using (doc_id, pos) group by all), c as (select "group", name, token, count(*) as k from (select "group", name, unnest(tokens) as token from st) group by all),
    b as (select "group", name, sum(-k * log2(k / total)) as bits from c join z using ("group", name) group by all), r as (select "group", name, round((bits / chars)::double, 6) as bpc, total / n as t from b join z using ("group", name)),
    p as (select x."group" as "group", x.bpc as bpc_a, y.bpc as bpc_b, x.t / y.t as ratio from r x join r y on x."group" = y."group" and x.name = 'reasoning' and y.name = 'default')
    select "group", bpc_a, bpc_b, round(100 * (bpc_b - bpc_a) / bpc_b, 1) as delta_pct, round(ratio, 2) as token_ratio, case when bpc_a < bpc_b then 'reasoning' when bpc_a > bpc_b then 'default' else 'tie' end as winner from p""")
def agg_group_compare(spark, sf):
    """Two tokenizers side by side for each language: bits per character by their tokens' own frequencies, and token ratios."""
    sents = C.sentences(read(spark, sf, "documents")).select("lang", F.length("sent").alias("n_chars"), K.lex_english(F.col("sent")).alias("d")).withColumn("k", K.reasoning_kept(F.col("d"), "en"))
    named = F.array(F.struct(F.lit("default").alias("name"), F.col("d").alias("tokens")), F.struct(F.lit("reasoning").alias("name"), K.reasoning_collapse(F.col("k")).alias("tokens")))
    each = sents.select(F.col("lang").alias("group"), "n_chars", F.explode(named).alias("x")).select("group", "n_chars", "x.*")
    return S.compare_runs(S.unigram_runs(each), "reasoning", "default")


@query("select a.conv_id, a.turn, length(a.text) as own, length(b.text) as other from conversations a join conversations b on a.conv_id = b.conv_id and b.turn = a.turn + 1")
def join_zip_position(spark, sf):
    """Rows paired by position: an equi-join on explicit numbers."""
    turns = read(spark, sf, "conversations")
    own = turns.select("conv_id", "turn", F.length("text").alias("own"))
    return own.join(turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.length("text").alias("other")), ["conv_id", "turn"])


@query("""with s as (select vec_id, label, list_transform(embedding[1:5], lambda x: x::double) as l from embeddings), m as (select *, list_max(l) as mx from s), z as (select *, mx + ln(list_sum(list_transform(l, lambda x: exp(x - mx)))) as lse from m)
    select vec_id, (list_position(l, mx) - 1)::int as best, round(mx - lse, 6) as logp from z""")
def log_softmax(spark, sf):
    """Log-softmax of some scores and the best of them; of equal ones the first."""
    scores = read(spark, sf, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 5), lambda x: x.cast("double")).alias("l")).withColumn("m", F.array_max("l"))
    total = F.aggregate(F.transform("l", lambda x: F.exp(x - F.col("m"))), F.lit(0.0), lambda a, b: a + b)
    return scores.select("vec_id", (F.array_position("l", F.col("m")) - 1).cast("int").alias("best"), F.round(-F.log(total), 6).alias("logp"))


@query("""with s as (select vec_id, list_transform(embedding, lambda x: x::double) as l from embeddings), o as (select vec_id, l, list_sort(list_transform(range(1, len(l) + 1), lambda i: {'m': -l[i], 'i': i - 1}))[1:40] as b from s),
    w as (select vec_id, b, list_transform(b, lambda x: exp((b[1].m - x.m) / 0.8)) as w, ('0x' || md5('5:' || vec_id)[1:8])::bigint / 4294967296.0::double as u from o),
    c as (select vec_id, b, list_position(list_transform(range(1, len(w) + 1), lambda k: list_sum(w[1:k]) >= u * list_sum(w)), true) as k from w)
    select vec_id, b[1].i::int as greedy, b[greatest(coalesce(k, 1), 1)].i::int as sampled from c""")
def topk_sampling(spark, sf):
    """A seeded draw from the forty best scores at temperature 0.8, and the greedy choice."""
    scores = read(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("l"))
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(5), "vec_id")), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)
    made = S.sample_top(S.sample_top(scores, "l", "greedy", temperature=0), "l", "sampled", u, temperature=0.8)
    return made.select("vec_id", "greedy", "sampled")


@query("""with e as (select user_id % 20 as bucket, date_trunc('hour', ts) as hour, count(*) as n from events group by 1, 2) select bucket, count(*) as hours, max(n) as most from e group by bucket""")
def agg_event_hours(spark, sf):
    """Events by hour, as a batch."""
    hours = read(spark, sf, "events").groupBy((F.col("user_id") % 20).alias("bucket"), F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").alias("n"))
    return hours.groupBy("bucket").agg(F.count("*").alias("hours"), F.max("n").alias("most"))


_LATE = "event_id % 10 = 0 and ts >= timestamp '2024-01-03' and ts < timestamp '2024-01-05'"
_PAIRS = f"""d as (select doc_id % 8 as key, timestamp '2024-01-01' + to_minutes((doc_id * 7919 % 43200)::int) as born, list_filter({D.lex_english('text')}, lambda t: t not in ('[BOS]', '[EOS]')) as t from documents),
    pair as (select e.ts, event_type, len(d.t) as n, len(list_filter(d.t, lambda x: not starts_with(x, 'ROOT:') and not starts_with(x, 'LIT:'))) as s from events e join d on e.event_id % 8 = d.key and e.ts >= d.born and e.ts <= d.born + interval 1 hour where not ({_LATE})),
    closed as (select least((select max(ts) from events), (select max(born) from d)) - interval 3 hour as w)"""


@query(f"""with {_PAIRS} select date_trunc('day', ts) as day, event_type, count(*) as n, sum(n)::bigint as tokens, sum(s)::bigint as structured from pair, closed where date_trunc('day', ts) + interval 1 day <= w group by 1, 2""")
def stream_windowed_coverage(spark, sf):
    """Events joined with the texts of the hour before them under two watermarks, by day and type, as three arrivals.

    Some events of the third and fourth day only come with the last arrival: they are late, and dropped.
    """
    start = F.lit("2024-01-01").cast("timestamp_ntz")
    minutes = (F.col("doc_id") * 7919 % 43200).cast("int")
    at = F.timestamp_add("MINUTE", minutes, start) if hasattr(F, "timestamp_add") else start + F.make_dt_interval(mins=minutes)

    def step(ts):
        return F.least(F.floor(F.datediff(ts, start) / 10), F.lit(2)).cast("int")

    docs = read(spark, sf, "documents").select((F.col("doc_id") % 8).alias("key"), at.alias("ts"), "text").withColumn("step", step(F.col("ts")))
    late = F.expr("event_id % 10 = 0 and ts >= timestamp_ntz '2024-01-03' and ts < timestamp_ntz '2024-01-05'")
    events = read(spark, sf, "events").select((F.col("event_id") % 8).alias("key"), F.col("ts").cast("timestamp_ntz").alias("ts"), "event_type", F.when(late, 2).otherwise(step(F.col("ts"))).alias("step"))
    made = streams.coverage_in_steps(spark, docs, events, 3)
    return made.select(F.col("window.start").cast("timestamp_ntz").alias("day"), "event_type", "n", "tokens", "structured")


_LABELLED = f"labelled as (select doc_id as id, list_filter({D.lex_english('text')}, lambda t: t not in ('[BOS]', '[EOS]')) as toks, quality as label from documents join labels using (doc_id))"


def _labelled(spark, sf):
    tokens = K.unmark(K.lex_english(F.col("text"))).alias("tokens")
    return read(spark, sf, "documents").select(F.col("doc_id").alias("id"), tokens).join(read(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("label")), "id")


_PART = "list_filter({}, lambda t: t not in ('[BOS]', '[EOS]'))"
_SCORED = f"""turns as (select conv_id, turn, {_PART.format(D.lex_english('text'))} as toks from conversations), asked as (select q.conv_id * 1000 + q.turn as id, q.toks as context, case when q.turn % 4 = 0 then [a.toks, q.toks] else [q.toks, a.toks] end as candidates, (q.turn % 4 <> 0)::int as gold
    from turns q join turns a on a.conv_id = q.conv_id and a.turn = q.turn + 1), part as (select id, 0 as part, context as toks from asked union all select id, 1, candidates[1] from asked union all select id, 2, candidates[2] from asked),
    whole as (select id from part group by id having min(len(toks)) > 0), pid as (select id, part, string_agg(coalesce(v.id2, 1)::varchar, ' ' order by i) as ids from (select id, part, unnest(toks) as token, generate_subscripts(toks, 1) as i from part semi join whole using (id)) e
    left join (select token, id as id2 from vocab) v using (token) group by id, part)"""


def _asked(spark, sf):
    """Turns as contexts; the next turn and the turn itself are the candidates."""
    turns = shared.stored(read(spark, sf, "conversations").select("conv_id", "turn", K.unmark(K.lex_english(F.col("text"))).alias("toks")))
    pairs = turns.join(turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("toks").alias("after")), ["conv_id", "turn"])
    first = F.col("turn") % 4 == 0
    return pairs.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("toks").alias("context"), F.when(first, F.array("after", "toks")).otherwise(F.array("toks", "after")).alias("candidates"), F.when(first, 0).otherwise(1).alias("gold"))


@query(f"""with {_top(CAP)}, {_LABELLED}, e as (select id, label, unnest(toks) as token, generate_subscripts(toks, 1) as i from labelled)
    select e.id as id, label, string_agg(coalesce(v.id, 1)::varchar, ' ' order by i) as ids from e left join vocab v using (token) group by e.id, label""")
def downstream_prep(spark, sf):
    """Labelled documents as ids and labels; those without tokens are left out."""
    return _shown(W.classification(_labelled(spark, sf), _vocab(spark, sf)))


@query(f"""with {_top(CAP)}, {_SCORED} select a.id, c.ids as context_ids, x.ids as first, y.ids as second, gold from asked a join pid c on c.id = a.id and c.part = 0 join pid x on x.id = a.id and x.part = 1 join pid y on y.id = a.id and y.part = 2""")
def downstream_lm_scoring(spark, sf):
    """Contexts with two candidates and the place of the right one; rows with an empty part are left out."""
    made = W.lm_scoring(_asked(spark, sf), _vocab(spark, sf))
    shown = made.select("id", "context_ids", F.get("candidates", F.lit(0)).alias("first"), F.get("candidates", F.lit(1)).alias("second"), "gold")
    return _shown(shown, "context_ids", "first", "second")


MAX_LEN = 24


@query(f"""with {_BI}, {_SCORED[:_SCORED.index(", part as")]}, c as (select id, gold, k, least(len(context), {MAX_LEN - 2}) as n, context[-1] as last, candidates[k + 1] as cand from asked, range(2) r(k) where len(context) > 0 and len(candidates[1]) > 0 and len(candidates[2]) > 0),
    q as (select id, gold, k, [last] || cand[1:greatest({MAX_LEN} - n, 1)] as seq from c), p as (select id, gold, k, unnest(seq[1:len(seq) - 1]) as a, unnest(seq[2:]) as b from q),
    s as (select id, gold, k, round(sum(-ln((coalesce(nab, 0) + 1.0) / (coalesce(na, 0) + v))), 6) as nll from p left join bi using (a, b) left join uni using (a), size group by id, gold, k)
    select id, gold, max(case when k = 0 then nll end) as nll_first, max(case when k = 1 then nll end) as nll_second, arg_min(k, (nll, k))::int as pred from s group by id, gold""")
def score_candidates(spark, sf):
    """Candidates scored behind their contexts by a bigram model of the documents, in place of a neural one; the least nll wins."""
    lexed = C.sentences(read(spark, sf, "documents")).select(K.lex_english(F.col("sent")).alias("tokens"))
    made = W.candidate_scores(_asked(spark, sf), lexed, max_len=MAX_LEN)
    return made.select("id", "gold", *(F.get("nlls", F.lit(i)).alias(n) for i, n in enumerate(("nll_first", "nll_second"))), "pred")


@query(f"""with {_top(CAP)}, {_LABELLED}, e as (select id, label, coalesce(v.id2, 1) as x from (select id, label, unnest(toks) as token from labelled) left join (select token, id as id2 from vocab) v using (token)), {_SCORED},
    f as (select id, coalesce(v.id2, 1) as x from (select id, unnest(toks) as token from part semi join whole using (id)) left join (select token, id as id2 from vocab) v using (token))
    select 'classification' as task, count(distinct id) as n, round(count(*) filter (where x = 1) / count(*), 9) as unk_rate, (select string_agg(label || ':' || n, ' ' order by label) from (select label, count(distinct id) as n from e group by label)) as labels from e
    union all select 'lm_scoring', count(distinct id), round(count(*) filter (where x = 1) / count(*), 9), null from f""")
def downstream_summary(spark, sf):
    """Rows, unknown rates and label counts of both tasks."""
    vocab = _vocab(spark, sf)
    both = W.summary(W.classification(_labelled(spark, sf), vocab)).unionByName(W.summary(W.lm_scoring(_asked(spark, sf), vocab)))
    labels = F.array_join(F.transform(F.map_entries("label_counts"), lambda x: F.concat(x["key"].cast("string"), F.lit(":"), x["value"].cast("string"))), " ")
    return both.select("task", "n", F.round("unk_rate", 9).alias("unk_rate"), labels.alias("labels"))
