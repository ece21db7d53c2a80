"""Generated data, verifier examples and joins between rows of a language."""

from __future__ import annotations

from pyspark.sql import functions as F

from tokenloom.functions import tokens as K
from tokenloom.operators import corpus as C
from tokenloom.operators import datagen as G
from tokenloom.operators import generators as N
from tokenloom.plans import dialect as D
from tokenloom.plans.logic import SYLLOGISMS
from tokenloom.plans.registry import query, read
from tokenloom.sources import readers


def _records(spark, sf):
    """(id, doc_id, lang, q, cot, a): documents as records; the first four words ask, the last four answer, the rest is a step."""
    docs = read(spark, sf, "documents").select("doc_id", "lang", F.split("text", " ").alias("w"))
    return docs.select(F.format_string("d-%010d", "doc_id").alias("id"), "doc_id", "lang", F.slice("w", 1, 4).alias("q"), F.array(F.slice("w", F.lit(5), F.greatest(F.size("w") - 8, F.lit(0)))).alias("cot"), F.slice("w", F.greatest(F.size("w") - 3, F.lit(1)), F.lit(4)).alias("a"))


def _rows(spark, sf):
    """Records with a gold label: examples for verifiers are made of those only."""
    labels = read(spark, sf, "labels").select("doc_id", F.when(F.col("quality") == 1, "yes").otherwise("no").alias("label_name"))
    return _records(spark, sf).join(labels, "doc_id").drop("doc_id")


_RECORDS = """records as (select doc_id, printf('d-%010d', doc_id) as id, lang, w[1:4] as q, w[5:len(w) - 4] as c, w[greatest(len(w) - 3, 1):len(w)] as a from (select doc_id, lang, string_split(text, ' ') as w from documents))"""
_ROWS = f"""{_RECORDS}, rows as (select r.*, case when quality = 1 then 'yes' else 'no' end as label_name from records r join labels using (doc_id))"""
_NEXT = "coalesce(lead(c) over (partition by lang order by id), first_value(c) over (partition by lang order by id))"


@query(f"with {_RECORDS} select id, lang, array_to_string({_NEXT}, ' ') as other from records")
def join_rotate(spark, sf):
    made = G.next_of_language(_records(spark, sf).withColumn("c", F.col("cot")[0]), "c")
    return made.select("id", "lang", F.array_join("other", " ").alias("other"))


@query(f"""with {_RECORDS}, t as (select *, row_number() over (order by lang, id) as r, count(*) over (partition by lang) as k, count(*) over () as n from records)
    select id, lang, array_to_string(case when k > 1 then {_NEXT} else coalesce(lead(c) over (order by r), first_value(c) over (order by r)) end, ' ') as other from t""")
def join_sample_other(spark, sf):
    """Another row's steps: of the same language, else of any, else its own. Always the next one, so results repeat."""
    made = G.next_of_language(_records(spark, sf).withColumn("c", F.col("cot")[0]), "c", fallback=True)
    return made.select("id", "lang", F.array_join("other", " ").alias("other"))


def _place(rank: str, n: str, seed: int) -> str:
    """A rank's place in the seeded order of n rows."""
    primes = G.PRIMES[seed % len(G.PRIMES) :] + G.PRIMES[: seed % len(G.PRIMES)]
    factor = "case " + " ".join(f"when {n} % {p} <> 0 then {p}" for p in primes[:-1]) + f" else {primes[-1]} end"
    return f"({rank} * ({factor}) + {seed}) % {n}"


_GROUPS = """g as (select *, row_number() over (partition by lang order by id) - 1 as r, count(*) over (partition by lang) as n, row_number() over (order by id) - 1 as r_all, count(*) over () as n_all,
    row_number() over (partition by lang, label_name order by id) - 1 as r_label, count(*) over (partition by lang, label_name) as n_label from rows)"""


def _seeded(seed: int, k: int) -> str:
    """partner{seed} and flip{seed}: k others of the language, and k of the other label, for each row."""
    return f"""p{seed} as (select *, {_place('r', 'n', seed)} as s, {_place('r_all', 'n_all', seed)} as s_all, {_place('r_label', 'n_label', seed)} as s_label from g),
    partner{seed} as (select x.id, k, y.id as other from p{seed} x join range({k}) t(k) on x.n > 1 join p{seed} y on y.lang = x.lang and y.s = (x.s + 1 + k % (x.n - 1)) % x.n
        union all select x.id, k, y.id from p{seed} x join range({k}) t(k) on x.n = 1 join p{seed} y on y.s_all = case when x.n_all > 1 then (x.s_all + 1 + k % (x.n_all - 1)) % x.n_all else x.s_all end),
    flip{seed} as (select x.id, k, y.id as other from p{seed} x, range({k}) t(k), p{seed} y where y.lang = x.lang and y.label_name = case x.label_name when 'yes' then 'no' else 'yes' end and y.s_label = (x.s_label + k) % y.n_label)"""


def _examples(counts: dict[str, int]) -> str:
    most = max(counts.values())
    qonly, shuffled, flipped, both = (counts[v] for v in G.NEGATIVES)
    return f"""{_ROWS}, {_GROUPS}, {_seeded(0, most)}, {_seeded(1, most)}, x as (
    select id || ':pos' as id, id as source_id, lang, label_name, 'positive' as variant, 1 as label, list_concat(list_concat(q, c), a) as t from rows union all
    select id || ':neg_qonly:' || k, id, lang, label_name, 'neg_question_only', 0, list_concat(q, a) from rows, range({qonly}) t(k) union all
    select r.id || ':neg_shuf:' || k, r.id, r.lang, r.label_name, 'neg_shuffled_cot', 0, list_concat(list_concat(r.q, o.c), r.a) from rows r join partner0 p on p.id = r.id and k < {shuffled} join rows o on o.id = p.other union all
    select r.id || ':neg_flip:' || k, r.id, r.lang, r.label_name, 'neg_answer_flip', 0, list_concat(list_concat(r.q, r.c), o.a) from rows r join flip0 p on p.id = r.id and k < {flipped} join rows o on o.id = p.other union all
    select r.id || ':neg_both:' || p.k, r.id, r.lang, r.label_name, 'neg_shuffled_and_flip', 0, list_concat(list_concat(r.q, o.c), f.a) from rows r join partner1 p on p.id = r.id and p.k < {both} join rows o on o.id = p.other
        join flip1 l on l.id = r.id and l.k = p.k join rows f on f.id = l.other)"""


@query(f"""with {_examples(G.NEGATIVES)} select variant, label, lang, grouping_id(variant, label, lang) as level, count(*) as n, count(distinct source_id) as sources from x group by grouping sets ((variant, label), (lang), ())""")
def gen_verifier_summary(spark, sf):
    return G.verifier_summary(G.verifier_examples(_rows(spark, sf)))


COUNTS = {"neg_question_only": 2, "neg_shuffled_cot": 3, "neg_answer_flip": 2, "neg_shuffled_and_flip": 2}


@query(f"with {_examples(COUNTS)} select id, source_id, lang, label_name as answer_label, variant, label, array_to_string(t, ' ') as input_tokens from x")
def gen_verifier_dataset(spark, sf):
    """Positives with several negatives of each kind, whose steps and answers come from different rows."""
    return G.verifier_examples(_rows(spark, sf), COUNTS).withColumn("input_tokens", F.array_join("input_tokens", " "))


@query(f"""with {_RECORDS}, rows as (select *, '' as label_name from records), {_GROUPS}, {_seeded(5, 4)} select id, k, other from partner5""")
def join_sample_partners(spark, sf):
    """Four partners of each record in its language, none twice and never itself where there are others."""
    return G.partners(_records(spark, sf).select("id", "lang"), 4, 5)


@query(f"""with {_examples(G.NEGATIVES)} select p.source_id, n.variant, array_to_string(p.t, ' ') as positive, array_to_string(n.t, ' ') as negative from x p join x n on n.source_id = p.source_id and n.variant in ('neg_question_only', 'neg_shuffled_cot') where p.variant = 'positive'""")
def join_source_group(spark, sf):
    pairs = G.pairwise(G.verifier_examples(_rows(spark, sf)), ["neg_question_only", "neg_shuffled_cot"])
    return pairs.select("source_id", "variant", F.array_join("positive", " ").alias("positive"), F.array_join("negative", " ").alias("negative"))


@query(f"with {_ROWS} select lang, case label_name when 'yes' then 'no' else 'yes' end as label_name, array_to_string(min(a), ' ') as flip, count(*) as n from rows group by lang, rows.label_name")
def join_by_lang_pool(spark, sf):
    pool = _rows(spark, sf).groupBy("lang", "label_name").agg(F.min("a").alias("flip"), F.count("*").alias("n"))
    return pool.select("lang", F.when(F.col("label_name") == "yes", "no").otherwise("yes").alias("label_name"), F.array_join("flip", " ").alias("flip"), "n")


@query(f"with {_RECORDS} select id, array_to_string(list_concat(list_concat(q, c), a), ' ') as tokens from records")
def compose_tokens(spark, sf):
    return _records(spark, sf).select("id", F.array_join(K.compose(F.col("q"), F.col("cot"), F.col("a")), " ").alias("tokens"))


@query(f"with {_RECORDS} select id, array_to_string(case when len(c) > 0 then c else q end, ' ') as tokens from records")
def view_fallback(spark, sf):
    """The default view, or the reasoning one where that is empty."""
    first = F.col("cot")[0]
    return _records(spark, sf).select("id", F.array_join(F.when(F.size(first) > 0, first).otherwise(F.col("q")), " ").alias("tokens"))


@query(f"with {_ROWS} select id, array_to_string(case when label_name = 'yes' and len(a) > 0 then a else c end, ' ') as tokens from rows")
def cst_override(spark, sf):
    """Precomputed tokens in the place of derived ones; an empty list counts as missing."""
    given = F.when(F.col("label_name") == "yes", F.col("a"))
    return _rows(spark, sf).select("id", F.array_join(F.when(F.size(F.coalesce(given, F.array().cast("array<string>"))) > 0, given).otherwise(F.col("cot")[0]), " ").alias("tokens"))


@query("""select kind, sum(n)::bigint as n from (select 'text' as kind, count(*) as n from documents union all select 'reasoning', count(*) from conversations union all select 'verifier', count(*) from labels
    union all select 'logic', count(*) from embeddings union all select 'unknown', count(*) from events) group by kind""")
def record_schema(spark, sf):
    """The kind of each JSON record by which fields it has; tables stand for files of each kind."""
    c = F.col
    made = [
        read(spark, sf, "documents").select(F.to_json(F.struct("doc_id", "text"))), read(spark, sf, "conversations").select(F.to_json(F.struct(c("text").alias("question"), c("role").alias("answer"), "text"))),
        read(spark, sf, "labels").select(F.to_json(F.struct(F.array("doc_id").alias("input_tokens"), c("quality").alias("label")))), read(spark, sf, "embeddings").select(F.to_json(F.struct(F.array("vec_id").alias("q_ids")))),
        read(spark, sf, "events").select(F.to_json(F.struct("event_id"))),
    ]
    each = made[0].toDF("json")
    for m in made[1:]:
        each = each.union(m)
    return each.groupBy(readers.record_kind(F.col("json")).alias("kind")).agg(F.count("*").alias("n"))


def _numbers(spark, sf):
    """Rows to make data for: the documents' numbers."""
    return read(spark, sf, "documents").select(F.col("doc_id").alias("i"))


_NUMBERS = "r as (select doc_id as i from documents)"


@query()
def gen_prop_logic(spark, sf):
    """Formulas with the steps of their evaluation, one for each document; a test evaluates them by the parser."""
    return N.prop_logic(spark, _numbers(spark, sf), 7)


@query()
def gen_holdout_prop(spark, sf):
    """Formulas in symbols, five to seven deep, one for each document; a test evaluates them by the parser."""
    return N.holdout_prop(spark, _numbers(spark, sf), 11)


def _pick(seed: int, draw: int, n: int) -> str:
    return f"(('0x' || md5(concat_ws(':', {seed}, i, {draw}))[1:8])::bigint % {n})"


def _list(xs) -> str:
    return "[" + ", ".join(_list(x) if isinstance(x, tuple) else D.quote(x) for x in xs) + "]"


def _said(form: str, a: str, b: str, lang: str) -> str:
    return f"replace(replace(case {form} " + " ".join(f"when '{f}' then {D.quote(t)}" for f, t in N.SAID[lang].items()) + f" end, '{{a}}', {a}), '{{b}}', {b})"


def _syllogism_sql(seed: int) -> str:
    """Moods are judged by the table of all moods here, so that labels are checked too."""
    mood = " ".join(f"when kind = '{k}' and {'' if f else 'not '}follows then {_list(ms)}[{_pick(seed, 2, len(ms))} + 1]" for k in N.SOUND for f, ms in N.slots(k).items())
    parts = []
    for lang in N.LANGS:
        first = f"case when figure in (1, 3) then {_said('major', 'm', 'p', lang)} else {_said('major', 'p', 'm', lang)} end"
        second = f"case when figure in (1, 2) then {_said('minor', 's', 'm', lang)} else {_said('minor', 'm', 's', lang)} end"
        chain = " || ' ' || ".join(_said("'A'", a, b, lang) for a, b in (("s", "m"), ("m2", "p2"), ("p", "last")))
        (no, yes), (t1, t2, t3, bad, good), (c1, c2, cbad, cgood) = N.ANSWERS[lang], N.STEPS[lang], N.CHAIN_STEPS[lang]
        q = D.quote
        terms = f"replace(replace(replace({q(t1)}, '{{s}}', s), '{{m}}', m), '{{p}}', p)"
        links = q(c1)
        for k, x in enumerate(("s", "m", "m2", "p2", "p", "last")):
            links = f"replace({links}, '{{{k + 1}}}', {x})"
        parts.append(f"""select 'syllog-' || case when kind = 'chain' then 'sorites-' else '' end || '{lang}-' || printf('%06d', i) as id, '{lang}' as lang, kind, mood,
            case when kind <> 'figure1' then 'hard' when valid then 'easy' else 'medium' end as difficulty,
            case when kind = 'chain' then {chain} || {q(N.ASKS[lang])} || {_said("'A'", 's', 'last', lang)} else {first} || ' ' || {second} || {q(N.ASKS[lang])} || {_said('conclusion', 's', 'p', lang)} end as question,
            case when kind = 'chain' then {links} || '|' || {q(c2)} || '|' || case when valid then {q(cgood)} else {q(cbad)} end else {terms} || '|' || {q(t2)} || '|' || {q(t3)} || '|' || case when valid then {q(good)} else {q(bad)} end end as cot,
            case when valid then {q(yes)} else {q(no)} end as answer
            from (select *, case when follows then m else p end as m2, case when follows then p else m end as p2 from (
                select *, t[1] as s, t[2] as m, t[3] as p from (select *, {_list(N.TRIPLES[lang])}[a + 1] as t, {_list(N.TRIPLES[lang])}[b + 1][3] as last from w)))""")
    return f"""with {_NUMBERS}, d as (select i, {_pick(seed, 0, 10000)} as u, {_pick(seed, 1, 2)} = 1 as follows, {_pick(seed, 3, 25)} as a, ({_pick(seed, 3, 25)} + 1 + {_pick(seed, 4, 24)}) % 25 as b from r),
        k as (select *, case when u < 7000 then 'figure1' when u < 9000 then 'figure2' else 'chain' end as kind from d), m0 as (select *, case {mood} end as mood from k),
        m1 as (select *, mood[1:1] as major, mood[2:2] as minor, mood[3:3] as conclusion, mood[5:5]::int as figure from m0), j as ({SYLLOGISMS}),
        w as (select m1.*, case when kind = 'chain' then follows else j.valid end as valid from m1 left join j on j.figure = m1.figure and j.major = m1.major and j.minor = m1.minor and j.conclusion = m1.conclusion)
        {' union all '.join(parts)}"""


@query(_syllogism_sql(5))
def gen_syllogism(spark, sf):
    """Syllogisms of two premises and chains of three, in two languages, half of them sound."""
    return N.syllogisms(spark, _numbers(spark, sf), 5).withColumn("cot", F.array_join("cot", "|"))


@query(f"""with {_NUMBERS}, d as (select i, ['A', 'E', 'I', 'O'] as f, {_list(N.TRIPLES['en'])}[{_pick(13, 3, 25)} + 1] as t from r),
    e as (select i, f[{_pick(13, 0, 4)} + 1] as major, f[{_pick(13, 1, 4)} + 1] as minor, f[{_pick(13, 2, 4)} + 1] as conclusion, t[1] as s, t[2] as m, t[3] as p from d), j as ({SYLLOGISMS}),
    x as (select i, major || minor || conclusion as mood, {_said('major', 'm', 'p', 'en')} as a, {_said('minor', 's', 'm', 'en')} as b, {_said('conclusion', 's', 'p', 'en')} as c, case when valid then 'valid' else 'invalid' end as answer
        from e join (select * from j where figure = 1) j using (major, minor, conclusion))
    select printf('syllogism-holdout-%06d', i) as id, mood, 'Premise 1: ' || a || ' Premise 2: ' || b || ' Conclusion: ' || c || ' Is that valid?' as question, a || '|' || b || '|therefore: ' || c || '|' || answer as cot, answer from x""")
def gen_holdout_syllogism(spark, sf):
    """All 64 moods of the first figure alike, so few are valid."""
    return N.holdout_syllogisms(spark, _numbers(spark, sf), 13).withColumn("cot", F.array_join("cot", "|"))


_BETWEEN = {c: f"({_pick(3, k, high - low + 1)} + {low})" for c, k, low, high in (("a", 1, 2, 9), ("b", 2, -20, 20), ("x", 3, -10, 10), ("c", 4, 1, 5), ("d", 5, 1, 5), ("e", 6, -10, 10), ("f", 7, -10, 10), ("g", 8, 2, 20), ("h", 9, 2, 20))}


def _signed(x: str, space: str = " ") -> str:
    return f"case when {x} >= 0 then '+{space}' else '-{space}' end || abs({x})"


@query(f"""with {_NUMBERS}, d as (select i, ['solve', 'simplify', 'evaluate'][{_pick(3, 0, 3)} + 1] as kind, ['+', '-', '*'][{_pick(3, 10, 3)} + 1] as op, {', '.join(f'{v} as {k}' for k, v in _BETWEEN.items())} from r),
    v as (select *, case op when '+' then g + h when '-' then g - h else g * h end as y, (c + d) || 'x' || case when e + f = 0 then '' else {_signed('(e + f)', '')} end as z from d)
    select printf('algebra-holdout-%06d', i) as id, kind,
        case kind when 'solve' then 'solve: ' || a || 'x ' || {_signed('b')} || ' = ' || (a * x + b) when 'simplify' then 'simplify: (' || c || 'x ' || {_signed('e')} || ') + (' || d || 'x ' || {_signed('f')} || ')' else 'evaluate: ' || g || ' ' || op || ' ' || h end as question,
        case kind when 'solve' then a || 'x = ' || (a * x) || '|x = ' || x when 'simplify' then 'of x: ' || c || '+' || d || '=' || (c + d) || '|others: ' || e || '+' || f || '=' || (e + f) || '|' || z else g || ' ' || op || ' ' || h || ' = ' || y end as cot,
        case kind when 'solve' then x::varchar when 'simplify' then z else y::varchar end as answer from v""")
def gen_holdout_algebra(spark, sf):
    return N.holdout_algebra(spark, _numbers(spark, sf), 3).withColumn("cot", F.array_join("cot", "|"))


@query("""with p as (select conv_id * 1000 + turn as idx, case when turn % 2 = 0 then 'en' else 'ar' end as lang, trim(text) as p, trim(role) as h, turn % 3 as label from conversations)
    select printf('xnli-%s-%07d', lang, idx) as id, lang, 1 as category, case when lang = 'en' then 'Premise: ' || p || chr(10) || 'Hypothesis: ' || h || chr(10) || 'Does the premise entail, contradict, or stay neutral to the hypothesis?'
        else 'المقدمة: ' || p || chr(10) || 'الفرضية: ' || h || chr(10) || 'هل تستلزم المقدمة الفرضية أم تناقضها أم محايدة؟' end as question,
        case when lang = 'en' then ['entails', 'neutral', 'contradicts'][label + 1] else ['يستلزم', 'محايد', 'يناقض'][label + 1] end as answer, 'xnli' as source, 'cc-by-nc-4.0' as license from p where p <> '' and h <> ''""")
def src_xnli(spark, sf):
    """Turns as premises and roles as hypotheses, in the two languages' templates."""
    label = F.pmod("turn", F.lit(3)).cast("int")
    pairs = read(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("idx"), F.when(F.col("turn") % 2 == 0, "en").otherwise("ar").alias("lang"), F.col("text").alias("premise"), F.col("role").alias("hypothesis"), label.alias("label"))
    return readers.nli_records(pairs).select("id", "lang", "category", "question", "answer", "meta.source", "meta.license")


_STEPS = "list_filter(list_transform(string_split(regexp_replace(trim(text) || ' ', '([.?!])[ \\t\\r\\n]+', '\\1' || chr(10), 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '')"


@query(f"""select printf('gsm8k-en-%06d', doc_id) as id, 'en' as lang, 3 as category, array_to_string(string_split(text, ' ')[1:4], ' ') as question, array_to_string({_STEPS}, '|') as cot, n_chars::varchar as answer,
    'gsm8k' as source, 'medium' as difficulty from documents""")
def src_gsm8k(spark, sf):
    """Documents as worked solutions: their sentences are steps, their length is the answer."""
    docs = read(spark, sf, "documents").select(F.col("doc_id").alias("idx"), F.array_join(F.slice(F.split("text", " "), 1, 4), " ").alias("question"), F.concat("text", F.lit(" #### "), F.col("n_chars")).alias("solution"))
    return readers.solution_records(docs).select("id", "lang", "category", "question", F.array_join("cot", "|").alias("cot"), "answer", "meta.source", "meta.difficulty")


@query("""select 'algebra-' || event_id as id, case when event_id % 2 = 0 then 'en' else 'ar' end as lang, 2 as category, event_type as question, event_type || '|' || user_id as cot, value::varchar as answer,
    case when event_id % 3 = 0 then 'hard' else 'medium' end as difficulty, case when event_id % 2 = 0 then 'A:SOLVE ' || event_type end as question_cst, 'isc' as license from events""")
def src_algebra(spark, sf):
    """An engine's JSON lines as records; fields that a line lacks have defaults."""
    e = F.col("event_id")
    line = F.struct(
        e.cast("string").alias("id"), F.when(e % 2 == 0, "en").otherwise("ar").alias("lang"), F.col("event_type").alias("question"), F.array("event_type", F.col("user_id").cast("string")).alias("cot"), F.col("value").cast("string").alias("answer"),
        F.when(e % 3 == 0, "hard").alias("difficulty"), F.when(e % 2 == 0, F.struct(F.array(F.lit("A:SOLVE"), F.col("event_type")).alias("question_cst"))).alias("meta"),
    )
    made = readers.engine_records(read(spark, sf, "events").select(F.to_json(line).alias("text")))
    return made.select("id", "lang", "category", "question", F.array_join("cot", "|").alias("cot"), "answer", "meta.difficulty", F.array_join("question_cst", " ").alias("question_cst"), "meta.license")


@query(f"with {D.SENT} select lang, count(*) as n, count(distinct sent) as kinds from sent where length(sent) > 20 group by lang")
def sentence_pool(spark, sf):
    sents = C.sentences(read(spark, sf, "documents")).filter(F.length("sent") > 20)
    return sents.groupBy("lang").agg(F.count("*").alias("n"), F.countDistinct("sent").alias("kinds"))
