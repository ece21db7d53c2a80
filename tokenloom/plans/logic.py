"""Logic tokens, the formal lexer, and small parsers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tokenloom import lexicon as L
from tokenloom.functions import text as T
from tokenloom.functions import tokens as K
from tokenloom.operators import corpus as C
from tokenloom.operators import reasoning as G
from tokenloom.plans import dialect as D
from tokenloom.plans import derived as X
from tokenloom.plans.registry import query, read

FORMULAS = [
    "2*x + 3 = 7", "(p ∧ q) → r", "x >= 0 and y != 1", "p <-> q", "∀x. P(x) → Q(x)", "not (p or q) => r", "x^2 - 42 < 1000", "∃y y ≤ 1", "solve 3x + 2 = 11", "all men are mortal ∴ qed", "a && b || !c", "", "¬¬p & & q",
]


def _events(spark, sf):
    return read(spark, sf, "events").select("event_id", "user_id")


def _counted(df, *columns: str):
    """The distinct rows, with how often each is there."""
    return df.groupBy(*columns).agg(F.count("*").alias("n"))


@query(f"with f as (select {X.chosen_sql('event_id', FORMULAS)} || ' ; x = ' || (user_id % 150 - 20) as x from events), l as (select x, count(*) as n, any_value({D.lex_formal('x')}) as toks from f group by x) select x, array_to_string({D.logic_collapse('toks')}, ' ') as tokens, n from l")
def logic_formal(spark, sf):
    """Formulas that events choose, with numbers of theirs."""
    made = _events(spark, sf).select(F.concat(X.chosen(F.col("event_id"), FORMULAS), F.lit(" ; x = "), (F.col("user_id") % 150 - 20).cast("string")).alias("x"))
    rows = _counted(made, "x").withColumn("t", K.lex_formal(F.col("x")))
    return rows.select("x", F.array_join(K.logic_collapse(F.col("t")), " ").alias("tokens"), "n")


@query(f"with {D.SENT}, f as (select doc_id, pos, {D.lex_formal('sent')} as toks from sent) select doc_id, pos, array_to_string({D.logic_collapse('toks')}, ' ') as tokens from f")
def logic_formal_corpus(spark, sf):
    rows = C.sentences(read(spark, sf, "documents")).select("doc_id", "pos", K.lex_formal(F.col("sent")).alias("t"))
    return rows.select("doc_id", "pos", F.array_join(K.logic_collapse(F.col("t")), " ").alias("tokens"))


@query(f"with {D.tokenized()}, p as (select doc_id, pos, {D.logic_parts('tokens')} as p from tok) select doc_id, pos, array_to_string({D.logic_collapse('p')}, ' ') as tokens from p")
def proj_logic(spark, sf):
    rows = C.logic_sentences(read(spark, sf, "documents"))
    return rows.select("doc_id", "pos", F.array_join(K.logic_collapse(F.col("tokens")), " ").alias("tokens"))


@query(f"with {D.tokenized(True)}, p as (select {D.logic_parts('tokens')} as p from tok), t as (select unnest({D.logic_collapse('p')}) as t from p) select case when starts_with(t, '[') then 'SPECIAL' else string_split(t, ':')[1] end as bucket, count(*) as n from t group by bucket")
def agg_logic_bucket(spark, sf):
    counts = C.logic_counts(read(spark, sf, "documents"), atomic=True)
    bucket = F.when(F.col("token").startswith("["), "SPECIAL").otherwise(F.substring_index("token", ":", 1))
    return counts.groupBy(bucket.alias("bucket")).agg(F.sum("n").alias("n"))


@query("with t as (select (doc_id % 300 - 50)::int as n from documents) select n, count(*) as c, case when n = 0 then 'N:ZERO' when n = 1 then 'N:ONE' when n < 0 then 'N:NEG' when n <= 100 then 'N:SMALL' else 'N:LARGE' end as bucket from t group by n")
def logic_int_bucket(spark, sf):
    numbers = read(spark, sf, "documents").select((F.col("doc_id") % 300 - 50).cast("int").alias("n"))
    return numbers.groupBy("n").agg(F.count("*").alias("c")).withColumn("bucket", K.integer_bucket(F.col("n")))


_BUCKETS = [(b, i, t, j) for i, (b, ts) in enumerate(L.LOGIC_BUCKETS.items()) for j, t in enumerate(ts)]


@query(f"""with {D.SENT}, u as (select t as token, count(*) as n from (select unnest({D.lex_formal('sent')}) as t from sent) group by t)
    select v.token, bucket, row_number() over (order by b, case when b = 0 then j else 0 end, v.token) - 1 as id, coalesce(n, 0) as n from ({D.values(_BUCKETS)}) v(bucket, b, token, j) left join u on u.token = v.token""")
def vocab_closed(spark, sf):
    """The closed vocabulary with the uses of its tokens in the documents, none for most."""
    used = C.token_counts(C.sentences(read(spark, sf, "documents")).select(K.lex_formal(F.col("sent")).alias("tokens")))
    return G.closed_vocabulary(spark).join(used, "token", "left").select("token", "bucket", "id", F.coalesce("n", F.lit(0)).alias("n"))


@query("select doc_id, pos, array_to_string(list_filter(w, lambda x, i: i = 1 or x <> w[i - 1]), ' ') as words from (select doc_id, pos, string_split(sent, ' ') as w from (with " + D.SENT + " select * from sent))")
def collapse_adjacent(spark, sf):
    words = C.sentences(read(spark, sf, "documents")).select("doc_id", "pos", F.split("sent", " ").alias("w"))
    return words.select("doc_id", "pos", F.array_join(K.collapse(F.col("w"), lambda t: F.lit(True)), " ").alias("words"))


ANSWERS = ["yes", " No ", "TRUE", "invalid", "maybe", "نعم", "لا", "", "Valid"]


@query(f"""with a as (select {X.chosen_sql('event_id', ANSWERS)} as a from events union all select text from conversations)
    select a, case when lower(trim(a)) in ('yes', 'نعم', 'valid', 'true') then 'yes' when lower(trim(a)) in ('no', 'لا', 'invalid', 'false') then 'no' end as label, count(*) as n from a group by a""")
def gold_label(spark, sf):
    """Labels of the answers that events choose, and of turns, which have none."""
    answers = _events(spark, sf).select(X.chosen(F.col("event_id"), ANSWERS).alias("a")).union(read(spark, sf, "conversations").select("text"))
    return _counted(answers, "a").select("a", T.gold_label(F.col("a")).alias("label"), "n")


_NLI = "(?:Premise|المقدمة): *([^\\n]*)\\n(?:Hypothesis|الفرضية): *([^\\n]*)"


@query(f"""with q as (select conv_id, turn, case turn % 3 when 0 then 'Premise: ' || trim(text) || chr(10) || 'Hypothesis: ' || role || chr(10) || 'So?' when 1 then 'المقدمة: ' || trim(text) || chr(10) || 'الفرضية: ' || role else text end as q from conversations)
    select conv_id, turn, regexp_extract(q, '{_NLI}', 1) as premise, regexp_extract(q, '{_NLI}', 2) as hypothesis from q""")
def nli_parse(spark, sf):
    """Premises and hypotheses of questions made of turns, in both languages; every third turn asks nothing."""
    text, role = F.trim("text"), F.col("role")
    asked = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("Premise: "), text, F.lit("\nHypothesis: "), role, F.lit("\nSo?"))).when(F.col("turn") % 3 == 1, F.concat(F.lit("المقدمة: "), text, F.lit("\nالفرضية: "), role)).otherwise(F.col("text"))
    return read(spark, sf, "conversations").select("conv_id", "turn", T.nli(asked).alias("x")).select("conv_id", "turn", "x.premise", "x.hypothesis")


@query("""with t as (select conv_id, string_agg(text, chr(10) order by turn) || ' #### ' || count(*) as s from conversations group by conv_id)
    select conv_id, trim(regexp_extract(s, '(?s)^(.*)####(.*)$', 2)) as answer, len(list_filter(list_transform(string_split(regexp_replace(regexp_extract(s, '(?s)^(.*)####(.*)$', 1), '([.?!])[ \\t\\r\\n]+', '\\1' || chr(10), 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> ''))::int as steps from t""")
def gsm8k_split(spark, sf):
    turns = read(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"), F.count("*").alias("n"))
    solution = F.concat(F.array_join(F.transform("t", lambda x: x["text"]), "\n"), F.lit(" #### "), F.col("n"))
    made = turns.select("conv_id", T.answer_after_hashes(solution).alias("s"))
    return made.select("conv_id", F.col("s.answer").alias("answer"), F.size("s.steps").alias("steps"))


@query("with p as (select (event_id % 9) || 'x + ' || (user_id % 5) || 'x - ' || (event_id % 4) || 'x' || case when event_id % 3 = 0 then ' - x' else '' end as p, event_id % 9 + user_id % 5 - event_id % 4 - (event_id % 3 = 0)::int as s from events) select p, any_value(s)::int as sum_x, count(*) as n from p group by p")
def poly_simplify(spark, sf):
    """Sums of terms that events choose."""
    e, u = F.col("event_id"), F.col("user_id")
    made = _events(spark, sf).select(F.concat((e % 9).cast("string"), F.lit("x + "), (u % 5).cast("string"), F.lit("x - "), (e % 4).cast("string"), F.lit("x"), F.when(e % 3 == 0, " - x").otherwise("")).alias("p"))
    return _counted(made, "p").select("p", T.sum_of_terms(F.col("p")).alias("sum_x"), "n")


SHAPES = ["All {a} are {b}.", "therefore, no {a} are {b}", "Some {a} are not {b}", "some {a} are {b}", "{a} {b}", " Therefore all {a} are {b} "]
_SAID = f"said as (select doc_id, replace(replace({X.chosen_sql('doc_id', SHAPES)}, '{{a}}', coalesce(w[1], 'x')), '{{b}}', coalesce(w[2], 'y')) as s from (select doc_id, regexp_extract_all(lower(text), '[a-z]+')[1:2] as w from documents)), low as (select *, regexp_replace(lower(trim(s)), '[.]$', '') as x from said)"


def _first(of) -> str:
    return "case " + " ".join(f"when regexp_matches(x, {D.quote(p)}) then {of(form, p)}" for form, p in T.CATEGORICAL) + " end"


_PARTS = f"form as (select doc_id, s, {_first(lambda f, p: D.quote(f))} as form, {_first(lambda f, p: f'regexp_extract(x, {D.quote(p)}, 1)')} as subject, {_first(lambda f, p: f'regexp_extract(x, {D.quote(p)}, 2)')} as predicate from low)"


def _propositions(spark, sf):
    """(doc_id, s, c): a sentence about the first two words of each document, and its parts."""
    words = F.slice(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)), 1, 2)
    shape = X.chosen(F.col("doc_id"), SHAPES)
    said = read(spark, sf, "documents").select("doc_id", shape.alias("s"), words.alias("w"))
    for k, (name, default) in enumerate((("{a}", "x"), ("{b}", "y"))):
        said = said.withColumn("s", F.replace("s", F.lit(name), F.coalesce(F.get("w", F.lit(k)), F.lit(default))))
    return said.select("doc_id", "s", T.categorical(F.col("s")).alias("c"))


@query(f"with {_SAID}, {_PARTS} select doc_id, s, form, subject, predicate from form")
def parse_categorical(spark, sf):
    return _propositions(spark, sf).select("doc_id", "s", "c.form", "c.subject", "c.predicate")


@query(f"with {_SAID}, {_PARTS} select doc_id, case form when 'A' then 'Q:ALL C:CONCEPT R:IS C:CONCEPT' when 'E' then 'Q:NO C:CONCEPT R:IS C:CONCEPT' when 'I' then 'Q:SOME C:CONCEPT R:IS C:CONCEPT' when 'O' then 'Q:SOME C:CONCEPT R:IS L:NOT C:CONCEPT' end as tokens from form")
def cat_to_logic(spark, sf):
    return _propositions(spark, sf).select("doc_id", F.array_join(T.categorical_logic(F.col("c.form")), " ").alias("tokens"))


@query("""with s as (select 'p=' || case when event_id % 2 = 0 then 'true' else '0' end || ', q = ' || case when event_id % 3 = 0 then 'f' else 't' end || case when event_id % 5 = 0 then '; p=false' else '' end || case when event_id % 7 = 0 then ' then p and q' else '' end as s,
    case when event_id % 5 = 0 then false else event_id % 2 = 0 end as p, event_id % 3 <> 0 as q from events) select s, any_value(p) as p, any_value(q) as q, count(*) as n from s group by s""")
def parse_assignments(spark, sf):
    """Values of two variables in texts that events choose; of a repeated name the last counts."""
    e = F.col("event_id")
    text = F.concat(F.lit("p="), F.when(e % 2 == 0, "true").otherwise("0"), F.lit(", q = "), F.when(e % 3 == 0, "f").otherwise("t"), F.when(e % 5 == 0, "; p=false").otherwise(""), F.when(e % 7 == 0, " then p and q").otherwise(""))
    rows = _counted(_events(spark, sf).select(text.alias("s")), "s").withColumn("m", T.assignments(F.col("s")))
    return rows.select("s", *(F.try_element_at("m", F.lit(v)).alias(v) for v in "pq"), "n")


PROPOSITIONS = ["p ∧ q", "p ∨ q → r", "¬p", "(p ↔ q) ∧ ¬false", "p → s", "p or q and r"]


@query(f"""with b as (select event_id % 2 = 0 as p, event_id // 2 % 2 = 0 as q, event_id // 4 % 2 = 0 as r, event_id // 8 % 6 as k from events),
    f as (select 'p=' || p || '; q=' || q || '; r=' || r || '; ' || {X.chosen_sql('k', PROPOSITIONS)} as s, case k when 0 then p and q when 1 then not (p or q) or r when 2 then not p when 3 then p = q when 5 then (p or q) and r end as v from b)
    select s, case any_value(v) when true then 'true' when false then 'false' else 'unknown' end as answer, count(*) as n from f group by s""")
def eval_prop(spark, sf):
    """Formulas under assignments that events choose, by a parser in Arrow batches; an unknown variable makes the value unknown."""
    e = F.col("event_id")
    given = [F.concat(F.lit(f"{v}="), (F.floor(e / d) % 2 == 0).cast("string"), F.lit("; ")) for v, d in (("p", 1), ("q", 2), ("r", 4))]
    rows = _counted(_events(spark, sf).select(F.concat(*given, X.chosen(F.floor(e / 8) % 6, PROPOSITIONS)).alias("s")), "s")
    return G.evaluate(rows)


@query("""with e as (select event_id % 7 - 3 as a, user_id % 10 as b, event_id % 23 - 11 as c, event_id % 2 = 0 as plus from events),
    s as (select 'solve ' || a || case when a % 2 = 0 then '*' else '' end || 'x ' || case when plus then '+ ' else '-' end || b || ' = ' || c as s, case when a <> 0 then 'x' end as variable, case when a <> 0 then (c - case when plus then b else -b end) / a::double end as solution from e)
    select s, any_value(variable) as variable, any_value(solution) as solution, count(*) as n from s group by s""")
def solve_algebra(spark, sf):
    """Equations whose numbers events choose; those without the unknown have no solution."""
    e = F.col("event_id")
    a, b, c = e % 7 - 3, F.col("user_id") % 10, e % 23 - 11
    text = F.concat(F.lit("solve "), a.cast("string"), F.when(a % 2 == 0, "*").otherwise(""), F.lit("x "), F.when(e % 2 == 0, "+ ").otherwise("-"), b.cast("string"), F.lit(" = "), c.cast("string"))
    return G.solve(_counted(_events(spark, sf).select(text.alias("s")), "s")).select("s", "variable", "solution", "n")


_FORMS = "(values ('A'), ('E'), ('I'), ('O'))"


def _holds(form: str, a: int, b: int) -> str:
    """SQL for whether a form holds of two sets in a population; bits of a region: 1 subject, 2 middle, 4 predicate."""
    inside = [r for r in range(1, 8) if r & a and r & b]
    outside = [r for r in range(1, 8) if r & a and not r & b]

    def any_(rs):
        return "(" + " or ".join(f"pop & {1 << (r - 1)} <> 0" for r in rs) + ")"

    return f"case {form} when 'A' then not {any_(outside)} when 'E' then not {any_(inside)} when 'I' then {any_(inside)} else {any_(outside)} end"


def _figure(f: int) -> tuple[tuple[int, int], tuple[int, int]]:
    major, minor = ((2, 4), (1, 2))
    return {1: (major, minor), 2: (major[::-1], minor), 3: (major, minor[::-1]), 4: (major[::-1], minor[::-1])}[f]


SYLLOGISMS = " union all ".join(
    f"select {f} as figure, a.f as major, b.f as minor, c.f as conclusion, bool_and(not (({_holds('a.f', *_figure(f)[0])}) and ({_holds('b.f', *_figure(f)[1])})) or ({_holds('c.f', 1, 4)})) as valid from {_FORMS} a(f), {_FORMS} b(f), {_FORMS} c(f), range(128) p(pop) group by a.f, b.f, c.f"
    for f in (1, 2, 3, 4)
)


@query(f"""with j as ({SYLLOGISMS}), d as (select (doc_id // 64 % 4 + 1)::int as figure, ['A', 'E', 'I', 'O'][doc_id % 4 + 1] as major, ['A', 'E', 'I', 'O'][doc_id // 4 % 4 + 1] as minor, ['A', 'E', 'I', 'O'][doc_id // 16 % 4 + 1] as conclusion from documents),
    n as (select figure, major, minor, conclusion, count(*) as n from d group by all) select j.figure, j.major, j.minor, j.conclusion, valid, coalesce(n, 0) as n from j left join n on n.figure = j.figure and n.major = j.major and n.minor = j.minor and n.conclusion = j.conclusion""")
def judge_syllogism(spark, sf):
    """All 256 moods and figures against all populations of the seven regions, with the documents whose number stands for each."""
    i = F.col("doc_id")
    forms = [X.chosen(F.floor(i / d), list("AEIO")).alias(c) for c, d in (("major", 1), ("minor", 4), ("conclusion", 16))]
    keys = ["figure", "major", "minor", "conclusion"]
    drawn = _counted(read(spark, sf, "documents").select((F.floor(i / 64) % 4 + 1).cast("int").alias("figure"), *forms), *keys)
    return G.syllogism_table(spark).join(drawn, keys, "left").select(*keys, "valid", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"with t as (select conv_id, turn, {D.lex_formal('text')} as t from conversations) select conv_id, turn, case when list_contains(t, 'L:TRUE') then 'true' when list_contains(t, 'L:FALSE') then 'false' when list_contains(t, 'V:Y') then 'yes' when list_contains(t, 'V:N') then 'no' else array_to_string(t, ' ') end as answer from t")
def format_answer(spark, sf):
    """What the logic tokens of each turn answer."""
    return read(spark, sf, "conversations").select("conv_id", "turn", K.lex_formal(F.col("text")).alias("t")).select("conv_id", "turn", T.format_answer(F.col("t")).alias("answer"))


_ATOMS = {"L:AND": "and", "L:OR": "or", "L:NOT": "not", "L:IMPL": "implies", "L:IFF": "iff", "L:LPAREN": "(", "L:RPAREN": ")", "L:THEREFORE": "therefore", "Q:ALL": "all", "Q:SOME": "some", "Q:NO": "no", "R:IS": "is", "R:EQUALS": "="}


@query(f"""with {D.SENT}, f as (select doc_id, pos, {D.lex_formal('sent')} as toks from sent), c as (select doc_id, pos, {D.logic_collapse('toks')} as t from f),
    p as (select doc_id, pos, array_to_string(list_transform(t, lambda t: {D.case('t', _ATOMS, "lower(regexp_replace(t, '^[A-Z]+:', ''))")}), ' ') as x from c) select doc_id, pos, replace(replace(x, '( ', '('), ' )', ')') as phrase from p""")
def humanize(spark, sf):
    """The logic tokens of each sentence as a phrase."""
    rows = C.sentences(read(spark, sf, "documents")).select("doc_id", "pos", K.lex_formal(F.col("sent")).alias("t"))
    return rows.select("doc_id", "pos", K.logic_collapse(F.col("t")).alias("t")).select("doc_id", "pos", T.humanize(F.col("t")).alias("phrase"))
