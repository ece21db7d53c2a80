"""The English tokenizer, its reports and the rule-based reasoning lexer."""

from __future__ import annotations

from pyspark.sql import functions as F

from tokenloom import lexicon as L
from tokenloom.functions import text as T
from tokenloom.functions import tokens as K
from tokenloom.operators import corpus as C
from tokenloom.operators import stats as S
from tokenloom.plans import dialect as D
from tokenloom.plans import derived as X
from tokenloom.plans.registry import query, read


def _sents(spark, sf):
    return C.sentences(read(spark, sf, "documents"))


def _distinct(spark, sf):
    """(word, lemma) of each distinct word."""
    return C.lemmas(C.distinct_words(_sents(spark, sf)))


def _analysed(spark, sf):
    return C.analyse(C.distinct_words(_sents(spark, sf)))


def _weights(spark, sf, **options):
    return C.token_weights(read(spark, sf, "documents"), **options)


def _lexed(spark, sf):
    """(doc_id, lang, pos, default_tokens, reasoning_tokens): narrow from the scan on."""
    lexed = _sents(spark, sf).select("doc_id", "lang", "pos", K.lex_english(F.col("sent")).alias("default_tokens"))
    kept = lexed.withColumn("kept", K.reasoning_kept(F.col("default_tokens"), "en"))
    return kept.withColumn("reasoning_tokens", K.reasoning_collapse(F.col("kept"))).drop("kept")


_WORDS = ", ".join([D.SENT, D.NORM, D.WORD])
_LEM = ", ".join([D.SENT, D.NORM, D.WORD, D.DISTINCT, D.LEMMA])


@query(f"with {D.SENT}, {D.NORM} select doc_id, pos, n as norm from norm")
def en_normalize(spark, sf):
    return _sents(spark, sf).select("doc_id", "pos", T.normalize(F.col("sent")).alias("norm"))


@query(f"with {D.SENT}, {D.NORM}, m as (select doc_id, pos, {D.structure('n')} as marks from norm) select doc_id, pos, array_to_string(marks, ' ') as marks from m where len(marks) > 0")
def en_structure(spark, sf):
    marks = _sents(spark, sf).select("doc_id", "pos", T.structure(T.normalize(F.col("sent"))).alias("marks"))
    return marks.filter(F.size("marks") > 0).select("doc_id", "pos", F.array_join("marks", " ").alias("marks"))


@query(f"with {D.SENT}, {D.NORM} select doc_id, pos, array_to_string({D.words('n')}, ' ') as words, len({D.words('n')})::int as n from norm")
def en_split_words(spark, sf):
    words = _sents(spark, sf).select("doc_id", "pos", T.words(T.normalize(F.col("sent"))).alias("w"))
    return words.select("doc_id", "pos", F.array_join("w", " ").alias("words"), F.size("w").alias("n"))


@query(f"with {D.SENT}, {D.NORM}, w as (select unnest({D.words('n')}) as word from norm) select word, count(*) as n from w where {D.skipped('word')} group by word")
def en_skip_token(spark, sf):
    words = _sents(spark, sf).select(F.explode(T.words(T.normalize(F.col("sent")))).alias("word"))
    return words.filter(T.skipped(F.col("word"))).groupBy("word").agg(F.count("*").alias("n"))


@query(f"with {_LEM}, {D.AFFIX} select word, p_affix as affix, p_role as role, p_stem as stem from aff where p_affix is not null")
def en_prefix_role(spark, sf):
    return _distinct(spark, sf).select("word", T.prefix_role(F.col("word")).alias("x")).filter("x is not null").select("word", "x.affix", "x.role", "x.stem")


@query(f"with {_LEM}, {D.AFFIX} select word, s_affix as affix, s_role as role, s_stem as stem from aff where s_affix is not null")
def en_suffix_role(spark, sf):
    return _distinct(spark, sf).select("word", T.suffix_role(F.col("word"), F.col("lemma")).alias("x")).filter("x is not null").select("word", "x.affix", "x.role", "x.stem")


@query(f"with {_LEM}, {D.AFFIX}, {D.DECOMPOSED} select word, lemma, root, role from dec")
def en_decompose(spark, sf):
    return _distinct(spark, sf).select("word", "lemma", T.decompose(F.col("word"), F.col("lemma")).alias("d")).select("word", "lemma", "d.root", "d.role")


@query(f"with {_LEM} select word, lemma from lem")
def en_lemma_default(spark, sf):
    """Lemmas by the small table and the rule alone; en_lemma has those of a parsed table."""
    return _distinct(spark, sf)


@query(f"with {D.EN} select word, root, field from ana where field is not null")
def en_resolve_field(spark, sf):
    return _analysed(spark, sf).filter("field is not null").select("word", "root", "field")


@query(f"with {D.EN}, {D.emitted()} select word, type, array_to_string(tokens, ' ') as tokens, confidence from em")
def en_emit(spark, sf):
    return C.emit(_analysed(spark, sf)).select("word", "type", F.array_join("tokens", " ").alias("tokens"), "confidence")


@query(f"with {D.EN}, {D.emitted(True)} select word, type, array_to_string(tokens, ' ') as tokens, confidence from em")
def en_emit_atomic(spark, sf):
    """Root and role as tokens of their own; some words have a role of their own."""
    return C.emit(_analysed(spark, sf), atomic=True).select("word", "type", F.array_join("tokens", " ").alias("tokens"), "confidence")


_OVER = D.case("lemma", L.ROLE_OVERRIDES, D.case("word", L.ROLE_OVERRIDES, "null"))
#: Words that stand for the corpus's own by their hashes, so that overrides meet some.
SCHOOL = ["the", "teacher", "teachers", "wrote", "to", "student", "students", "hospital", "hospitals", "went", "library", "libraries", "knows", "read", "reading", "books"]


@query(f"""with {D.SENT}, each as (select unnest({X.pooled_sql("list_filter(string_split(sent, ' '), lambda w: w <> '')", SCHOOL)}) as word from sent), dw as (select word, count(*) as n from each group by word), {D.LEMMA}
    select word, lemma, {_OVER} as override, n from lem join dw using (word)""")
def en_role_override(spark, sf):
    """Roles that single words have whatever their affixes say: the lemma's before the word's own."""
    words = X.pooled(F.filter(F.split("sent", " "), lambda w: w != ""), SCHOOL)
    counts = _sents(spark, sf).select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    find = T.hashed(L.ROLE_OVERRIDES)
    own = C.analyse(counts.select("word")).join(counts, "word")
    return own.select("word", "lemma", F.coalesce(find(F.col("lemma")), find(F.col("word"))).alias("override"), "n")


@query(f"with {D.tokenized()} select doc_id, pos, array_to_string(tokens, ' ') as tokens from tok")
def en_tokenize(spark, sf):
    return C.tokenize_english(read(spark, sf, "documents")).select("doc_id", "pos", F.array_join("tokens", " ").alias("tokens"))


@query(f"with {D.tokenized(True)} select doc_id, pos, array_to_string(tokens, ' ') as tokens from tok")
def en_tokenize_atomic(spark, sf):
    return C.tokenize_english(read(spark, sf, "documents"), atomic=True).select("doc_id", "pos", F.array_join("tokens", " ").alias("tokens"))


_KIND = "string_split(t, ':')[1]"


def _coverage_sql(keys: str) -> str:
    group = f"group by {keys}" if keys else ""
    lead = f"{keys}, " if keys else ""
    return f"""with {D.tokenized()}, t as (select doc_id, lang, unnest(tokens) as t from tok)
    select {lead}count(*) as total, count(*) filter (where {_KIND} = 'CMP') as cmp, count(*) filter (where {_KIND} = 'ROOT') as root, count(*) filter (where {_KIND} = 'STR') as str,
        count(*) filter (where {_KIND} = 'REL') as rel, count(*) filter (where {_KIND} = 'LIT') as lit,
        count(*) filter (where {_KIND} in ('CMP', 'ROOT', 'STR', 'REL')) as structured, count(*) filter (where {_KIND} in ('CMP', 'ROOT', 'STR', 'REL')) / count(*) as ratio,
        count(*) filter (where {_KIND} in ('CMP', 'ROOT', 'STR', 'REL')) / count(*) >= 0.55 as gate from t {group}"""


@query(_coverage_sql("lang"))
def en_coverage(spark, sf):
    return S.coverage(_weights(spark, sf, keys=["lang"]), ["lang"])


@query(_coverage_sql(""))
def agg_corpus_coverage(spark, sf):
    return S.coverage(_weights(spark, sf), [])


def _top_sql(where: str, key: str, n: int) -> str:
    return f"with {D.tokenized()}, t as (select unnest(tokens) as t from tok) select {key} as key, count(*) as n from t where {where} group by key order by n desc, key limit {n}"


@query(_top_sql("t like 'CMP:%' or (t like 'ROOT:%' and t <> 'ROOT:size')", "string_split(t, ':')[2]", 20))
def agg_top_fields(spark, sf):
    return S.top(_weights(spark, sf), lambda t: t.startswith("CMP:") | (t.startswith("ROOT:") & (t != "ROOT:size")), lambda t: F.get(F.split(t, ":"), F.lit(1)), 20)


@query(_top_sql("t like 'CMP:%'", "string_split(t, ':')[3]", 15))
def agg_top_roles(spark, sf):
    return S.top(_weights(spark, sf), lambda t: t.startswith("CMP:"), lambda t: F.get(F.split(t, ":"), F.lit(2)), 15)


@query(_top_sql("t like 'LIT:%'", "substr(t, 5)", 30))
def agg_top_literals(spark, sf):
    return S.top(_weights(spark, sf), lambda t: t.startswith("LIT:"), lambda t: F.substr(t, F.lit(5)), 30)


@query(_top_sql(f"t like 'LIT:%' and substr(t, 5) not in {D.items(L.FUNCTION_WORDS)} and not regexp_matches(substr(t, 5), '^[0-9]')", "substr(t, 5)", 50))
def agg_missed_words(spark, sf):
    """The most frequent literals that are no function words: what a lexicon should learn next."""
    return S.top(
        _weights(spark, sf),
        lambda t: t.startswith("LIT:") & ~F.substr(t, F.lit(5)).isin(L.FUNCTION_WORDS) & ~F.substr(t, F.lit(5)).rlike("^[0-9]"), lambda t: F.substr(t, F.lit(5)), 50,
    )


@query(f"with {D.tokenized()}, t as (select unnest(tokens) as t from tok) select {_KIND} as type, count(*) as n, count(distinct t) as kinds from t group by type")
def agg_type_counts(spark, sf):
    return _weights(spark, sf).groupBy(F.substring_index("token", ":", 1).alias("type")).agg(F.sum("n").alias("n"), F.count("*").alias("kinds"))


_BARE = f"regexp_replace(s, '[{T.VOWEL_MARKS}]', '', 'g')"


@query(f"""with {D.tokenized()}, c as (select substr(t, 5) as s, count(*) as n from (select unnest(tokens) as t from tok) where t like 'LIT:%' group by s),
    b as (select n, case when regexp_matches({_BARE}, '[0-9٠-٩۰-۹]') then 'num'
        when regexp_matches({_BARE}, '[A-Za-z]') and not regexp_matches({_BARE}, '[ء-ي]') then 'foreign' when regexp_matches({_BARE}, '[A-Za-z]') then 'mixed_script'
        when not regexp_matches({_BARE}, '[A-Za-zء-يÀ-ɏ]') then 'punct_only' when length({_BARE}) <= 1 then 'single_char' when length({_BARE}) <= 3 then 'short_arabic' else 'arabic_4plus' end as bucket from c)
    select bucket, count(*) as kinds, sum(n)::bigint as n, round(100.0 * count(*) / sum(count(*)) over (), 2) as kinds_pct, round(100.0 * sum(n) / sum(sum(n)) over (), 2) as n_pct from b group by bucket""")
def agg_lit_buckets(spark, sf):
    return S.literal_buckets(_weights(spark, sf))


@query(f"with {D.SENT}, {D.REASON} select doc_id, pos, array_to_string(default_tokens, ' ') as tokens from proj")
def en_reason_fallback(spark, sf):
    return _lexed(spark, sf).select("doc_id", "pos", F.array_join("default_tokens", " ").alias("tokens"))


@query(f"with {D.SENT}, {D.REASON} select doc_id, pos, array_to_string(reasoning_tokens, ' ') as tokens from proj")
def proj_reasoning(spark, sf):
    return _lexed(spark, sf).select("doc_id", "pos", F.array_join("reasoning_tokens", " ").alias("tokens"))


@query(f"""with {D.SENT}, {D.REASON} select lang, grouping(lang) as is_total, count(*) as records, sum(len(default_tokens))::bigint as default_tokens, sum(len(reasoning_tokens))::bigint as reasoning_tokens,
    sum(len(reasoning_tokens)) / sum(len(default_tokens)) as ratio from proj group by rollup (lang)""")
def agg_compression(spark, sf):
    """Tokens before and after projection, by language and over all. One narrow pass and one small aggregation."""
    sizes = _lexed(spark, sf).select("lang", F.size("default_tokens").cast("long").alias("d"), F.size("reasoning_tokens").cast("long").alias("r"))
    made = sizes.rollup("lang").agg(F.grouping("lang").alias("is_total"), F.count("*").alias("records"), F.sum("d").alias("default_tokens"), F.sum("r").alias("reasoning_tokens"))
    return made.withColumn("ratio", F.col("reasoning_tokens") / F.col("default_tokens"))


@query(f"""with {D.SENT}, {D.REASON}, d as (select doc_id, sum(len(default_tokens)) as d, sum(len(reasoning_tokens)) as r from proj group by doc_id)
    select avg(d) as mean_default, median(d) as median_default, quantile_cont(d, 0.9) as p90_default, max(d)::bigint as max_default,
           avg(r) as mean_reasoning, median(r) as median_reasoning, quantile_cont(r, 0.9) as p90_reasoning, max(r)::bigint as max_reasoning, avg(d) / avg(r) as ratio from d""")
def agg_length_distribution(spark, sf):
    sizes = _lexed(spark, sf).select("doc_id", F.size("default_tokens").cast("long").alias("d"), F.size("reasoning_tokens").cast("long").alias("r"))
    return S.length_distribution(sizes.groupBy("doc_id").agg(F.sum("d").alias("d"), F.sum("r").alias("r")))


@query(f"with {D.SENT}, {D.REASON} select floor(len(default_tokens) / 5)::bigint * 5 as bin, count(*) as n from proj group by bin")
def agg_histogram(spark, sf):
    return _lexed(spark, sf).groupBy((F.floor(F.size("default_tokens") / 5) * 5).alias("bin")).agg(F.count("*").alias("n"))


@query(f"with {D.SENT}, {D.REASON} select count(*) as n, avg(len(default_tokens)) as avg_tokens, sum(len(default_tokens))::bigint as total from proj where len(default_tokens) >= 3")
def agg_avg_tokens(spark, sf):
    return _lexed(spark, sf).filter(F.size("default_tokens") >= 3).agg(F.count("*").alias("n"), F.avg(F.size("default_tokens")).alias("avg_tokens"), F.sum(F.size("default_tokens")).alias("total"))


@query(f"with {D.SENT}, {D.REASON} select doc_id, pos, len(default_tokens)::int as n from proj where len(default_tokens) >= 4")
def min_tokens_filter(spark, sf):
    return _lexed(spark, sf).filter(F.size("default_tokens") >= 4).select("doc_id", "pos", F.size("default_tokens").alias("n"))


@query(f"""with {D.SENT}, {D.REASON}, c as (select default_tokens as x, len(default_tokens) as n, doc_id, pos from proj)
    select doc_id, pos, array_to_string(x[1:8], ' ') as head, array_to_string(case when n > 8 then x[n - 7:n] else x end, ' ') as tail,
        array_to_string(case when n > 8 then list_concat(x[1:4], x[n - 3:n]) else x end, ' ') as head_tail from c""")
def truncate_tokens(spark, sf):
    """The first 8 tokens, the last 8, and the first 4 with the last 4."""
    x = F.col("default_tokens")
    cut = [K.head(x, 8), K.tail(x, 8), K.head_tail(x, 8)]
    return _lexed(spark, sf).select("doc_id", "pos", *(F.array_join(c, " ").alias(n) for c, n in zip(cut, ("head", "tail", "head_tail"))))


@query(f"""with {D.SENT}, {D.REASON} select doc_id, pos, array_to_string(reasoning_tokens[2:len(reasoning_tokens) - 1], ' ') as inner_tokens from proj""")
def strip_bos_eos(spark, sf):
    return _lexed(spark, sf).select("doc_id", "pos", F.array_join(K.unwrap(F.col("reasoning_tokens")), " ").alias("inner_tokens"))


_CLASSES = [(f"REL:{r}", c) for r, c in L.RELATION_CLASSES.items()]


@query(f"""with {D.SENT}, {D.NORM}, {D.WORD} select class, count(distinct word.word) as words, count(distinct r.token) as kinds, count(*) as n from word join ({D.values(L.RELATIONS.items())}) r(word, token) on r.word = word.word
    left join ({D.values(_CLASSES)}) c(token, class) on c.token = r.token group by class""")
def rel_category(spark, sf):
    """Relation words of the corpus by their class; a relation without one has none."""
    counts = C.words(_sents(spark, sf)).groupBy("word").agg(F.count("*").alias("n"))
    known = counts.withColumn("token", T.hashed(L.RELATIONS)(F.col("word"))).filter("token is not null")
    own = known.withColumn("class", T.hashed(dict(_CLASSES))(F.col("token")))
    return own.groupBy("class").agg(F.count("*").alias("words"), F.countDistinct("token").alias("kinds"), F.sum("n").alias("n"))


@query(f"""with {D.tokenized()}, t as (select distinct unnest(tokens) as t from tok) select t as token from t where (t like 'REL:%' or t like 'STR:%')
    and t not in {D.items(L.LOGIC_TOKENS)} and t not in {D.items(L.LOGIC_DROPPED)}""")
def join_anti_coverage(spark, sf):
    """Relations and marks that the logic projection does not know."""
    emitted = _weights(spark, sf).select("token").filter("token like 'REL:%' or token like 'STR:%'")
    known = C.table(spark, [(t,) for t in [*L.LOGIC_TOKENS, *L.LOGIC_DROPPED]], "token string")
    return emitted.join(F.broadcast(known), "token", "left_anti")


@query(f"""with {_WORDS} select word, count(*) as n, string_agg(distinct lang, ',' order by lang) as langs from word where word in {D.items(L.FUNCTION_WORDS)} group by word""")
def join_semi_set(spark, sf):
    own = C.words(_sents(spark, sf)).filter(F.col("word").isin(L.FUNCTION_WORDS))
    return own.groupBy("word").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("langs"))
