"""The facade, sinks, entity and dependency inputs, and look-ups by name."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tokenloom import api
from tokenloom import lexicon as L
from tokenloom import lexicon_ar as A
from tokenloom.functions import text as T
from tokenloom.functions import tokens as K
from tokenloom.operators import arabic as R
from tokenloom.operators import baselines as B
from tokenloom.operators import corpus as C
from tokenloom.operators import shared
from tokenloom.plans import dialect as D
from tokenloom.plans.registry import query, read
from tokenloom.plans.vocabulary import CAP, _lexed_once, _top
from tokenloom.sources import readers

_LEXED = f"{D.SENT}, lexed as (select doc_id, lang, pos, {D.lex_english('sent')} as toks from sent)"


def _folder(spark) -> str:
    return shared.folder(spark, "sink")


def _sents(spark, sf):
    return C.sentences(read(spark, sf, "documents")).select(F.struct("doc_id", "pos").alias("id"), F.col("sent").alias("text"))


@query(f"""with {D.tokenized(True)}, p as (select doc_id, pos, len(tokens) + 2 as n, {D.logic_parts('tokens')} as p from tok)
    select doc_id, pos, n::int as n_standard, '[BOS] ' || array_to_string(list_append({D.logic_collapse('p')}, '[EOS]'), ' ') as tokens from p""")
def api_tokenize(spark, sf):
    made = api.tokenize(_sents(spark, sf), "en", "logic")
    return made.select("id.doc_id", "id.pos", "meta.n_standard", F.array_join("tokens", " ").alias("tokens"))


@query(f"""with {D.tokenized(True)} select doc_id, pos, '[BOS] ' || array_to_string(list_append(tokens, '[EOS]'), ' ') as tokens from tok""")
def api_tokenize_batch(spark, sf):
    """The facade's standard level for English: the tokenizer itself, roots and roles apart."""
    return api.tokenize(_sents(spark, sf), "en").select("id.doc_id", "id.pos", F.array_join("tokens", " ").alias("tokens"))


@query(f"with {_LEXED} select doc_id, pos, '[BOS] ' || array_to_string(list_append(toks, '[EOS]'), ' ') as doubled, array_to_string(toks[2:len(toks) - 1], ' ') as bare from lexed")
def add_strip_bos_eos(spark, sf):
    lexed = _sents(spark, sf).select("id.*", K.lex_english(F.col("text")).alias("t"))
    return lexed.select("doc_id", "pos", F.array_join(K.wrap(F.col("t")), " ").alias("doubled"), F.array_join(K.unwrap(F.col("t")), " ").alias("bare"))


@query(f"with {_LEXED} select count(*) as n, sum(len(toks))::bigint as tokens, sum(length(sent))::bigint as chars from lexed join sent using (doc_id, pos)")
def snk_jsonl(spark, sf):
    """Examples written as JSON lines and read again."""
    path = _folder(spark)
    made = _sents(spark, sf).select(F.array().cast("array<int>").alias("ids"), K.lex_english(F.col("text")).alias("tokens"), "text")
    readers.write_examples(made, path)
    back = spark.read.schema("ids array<int>, tokens array<string>, text string").json(path)
    return back.agg(F.count("*").alias("n"), F.sum(F.size("tokens")).alias("tokens"), F.sum(F.length("text")).alias("chars"))


_SPECIALS = D.items(L.SPECIALS)


@query(f"""with {_LEXED}, c as (select t, count(*) as n from (select unnest(toks) as t from lexed) group by t)
    select t as token, id::bigint as id from (select t, row_number() over (order by n desc, t) + {len(L.SPECIALS) - 1} as id from c where t not in {_SPECIALS}) where id < 500
    union all select * from ({D.values([(t, i) for i, t in enumerate(L.SPECIALS)])}) s(token, id)""")
def snk_vocab_json(spark, sf):
    """A vocabulary written as JSON lines and read again."""
    path = _folder(spark)
    counts = C.token_counts(_sents(spark, sf).select(K.lex_english(F.col("text")).alias("tokens")))
    readers.write_vocabulary(B.top_vocabulary(counts, L.SPECIALS, 500), path)
    return spark.read.schema("token string, id long").json(path)


@query(f"with {D.SENT}, {D.NORM}, {D.WORD} select word as surface, count(*) as n, null::varchar as root from word group by word order by n desc, word limit 40")
def snk_tsv_handlabel(spark, sf):
    """The most frequent words with blank columns for labels by hand, written as tab-separated values and read again."""
    path = _folder(spark)
    words = C.words(C.sentences(read(spark, sf, "documents"))).groupBy(F.col("word").alias("surface")).agg(F.count("*").alias("n"))
    readers.write_labels(words.orderBy(F.desc("n"), "surface").limit(40), path)
    return spark.read.option("sep", "\t").option("header", True).schema("surface string, n long, root string, field string").csv(path).select("surface", "n", "root")


@query("select '| ' || lang || ' | ' || count(*) || ' |' as line from documents group by lang")
def snk_markdown(spark, sf):
    counts = read(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    return counts.select(readers.markdown_row("lang", "n").alias("line"))


@query(f"with {D.SENT}, {D.NORM}, {D.WORD} select word, token, count(*) as n from word join ({D.values(L.RELATIONS.items())}) r(word, token) using (word) group by word, token")
def join_lexicon(spark, sf):
    words = C.words(C.sentences(read(spark, sf, "documents"))).groupBy("word").agg(F.count("*").alias("n"))
    return words.join(F.broadcast(C.table(spark, list(L.RELATIONS.items()), "word string, token string")), "word").select("word", "token", "n")


@query(f"with {D.EN}, hit as (select word, min(prio) - 1 as prio from cand join ({D.values(L.FIELDS.items())}) f(spelling, field) using (spelling) group by word) select word, prio::int as prio from hit")
def join_priority_fallback(spark, sf):
    """The place of the first spelling that the lexicon has."""
    rooted = C.analyse(C.distinct_words(C.sentences(read(spark, sf, "documents")))).select("word", "lemma", "root")
    spelled = rooted.select("word", F.posexplode(T.field_candidates(F.col("root"), F.col("lemma"))).alias("prio", "spelling")).filter("spelling is not null")
    return spelled.join(F.broadcast(C.field_table(spark)), "spelling").groupBy("word").agg(F.min("prio").alias("prio"))


@query(f"""with {D.SENT}, {D.NORM}, {D.WORD} select doc_id, pos, word, count(*) as n from word where word in {D.items(L.ENTITIES)} group by all""")
def en_ner(spark, sf):
    """Words of sentences that a gazetteer has: single words only, lower-cased, as the emitter meets them."""
    own = C.words(C.sentences(read(spark, sf, "documents")))
    return own.join(F.broadcast(C.entity_table(spark)), "word").groupBy("doc_id", "pos", "word").agg(F.count("*").alias("n"))


#: root, domain, gloss, field name given, keywords
GLOSSES = [
    ("كتب", "communication", "to know or write", "", ["record"]), ("كَلْب", "nature", "a kind of dog", "", ["pet"]), ("علم", "cognition", "unheard of", "", ["تعليم", "wisdom", "x"]), ("طعم", "everyday", "something", "", []),
    ("سوق", "economy", "a stall", "trading", ["books"]), ("درج", "movement", "a_move stairs", "", ["a", "b", "c", "d", "e", "f", "food"]), ("و", "home", "and", "", ["dwell"]), ("استفعل", "abstract", "", "", []),
]
_ENTRIES = "entry as (select * from (values " + ", ".join(f"({D.quote(a)}, {D.quote(d)}, {D.quote(c)}, {D.quote(f)}, [{', '.join(map(D.quote, k))}]::varchar[])" for a, d, c, f, k in GLOSSES) + ") v(arabic, domain, covers, semantic_field, keywords) union all select null, lang, text, source, []::varchar[] from documents)"


@query(f"""with {_ENTRIES}, t as (select *, lower(coalesce(covers, '') || ' ' || semantic_field || ' ' || array_to_string(list_filter(keywords[1:6], lambda k: not regexp_matches(k, '[؀-ۿ]')), ' ')) as x from entry),
    w as (select *, string_split_regex(x, '[^\\p{{L}}\\p{{N}}_]+') as words, list_transform(regexp_extract_all(x, '[a-z]+'), lambda t: {D.case('t', L.FIELDS, 'null')}) as known, regexp_extract_all(regexp_replace(arabic, '[\\x{{064B}}-\\x{{0652}}\\x{{0670}}\\s]', '', 'g'), '[؀-ۿ]') as letters from t)
    select case when len(letters) between 3 and 4 then array_to_string(letters, '.') end as root, domain, count(*) as n, coalesce(list_filter([{', '.join(map(D.quote, A.GLOSS_FIELDS))}], lambda f: list_contains(words, f))[1], list_filter(known, lambda k: k is not null)[1], {D.case('domain', A.DOMAIN_FIELDS, 'null')}) as field
    from w group by all""")
def aae_root_classify(spark, sf):
    """Dotted roots and fields of dictionary entries and, as glosses without roots, of whole documents, counted."""
    entries = C.table(spark, GLOSSES, "arabic string, domain string, covers string, semantic_field string, keywords array<string>")
    docs = read(spark, sf, "documents").select(F.lit(None).cast("string").alias("arabic"), F.col("lang").alias("domain"), F.col("text").alias("covers"), F.col("source").alias("semantic_field"), F.array().cast("array<string>").alias("keywords"))
    made = R.gloss_fields(entries.unionByName(docs), L.FIELDS)
    return made.groupBy("root", "domain", "field").agg(F.count("*").alias("n"))


@query(f"""with {_top(CAP)}, s as (select doc_id, pos, coalesce(string_agg(coalesce(v.id, 1)::varchar, ' ' order by i) filter (where e.token not in ('[BOS]', '[EOS]')), '') as ids from each e left join vocab v using (token) group by doc_id, pos)
    select doc_id, (row_number() over (partition by doc_id order by pos) - 1)::int as i, ids from s""")
def greedy_decode_segments(spark, sf):
    """The parts of each document's row of ids between begin and end: its sentences again."""
    ids = C.encode(*_lexed_once(spark, sf), ["doc_id", "pos"])
    whole = ids.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "ids"))).alias("x"))  # a document's sentences
    rows = whole.select("doc_id", F.flatten(F.transform("x", lambda x: x["ids"])).alias("ids"))
    return rows.select("doc_id", F.posexplode(K.segments(F.col("ids"), L.SPECIALS.index("[BOS]"), L.SPECIALS.index("[EOS]"))).alias("i", "ids"))


@query(f"with {_LEXED} select doc_id, pos, len(list_filter(toks, lambda t, i: i > 1 and t = toks[i - 1]))::int as repeats from lexed")
def win_adjacent(spark, sf):
    lexed = _sents(spark, sf).select("id.*", K.lex_english(F.col("text")).alias("t"))
    return lexed.select("doc_id", "pos", F.size(F.filter("t", lambda t, i: (i > 0) & (t == F.get("t", i - 1)))).alias("repeats"))


@query(f"with {D.SENT}, {D.REASON}, l as (select lang, avg(len(default_tokens)) as d, avg(len(reasoning_tokens)) as r from proj group by lang) select a.lang as lang, b.lang as other, a.d / b.d as ratio_default, a.r / b.r as ratio_reasoning from l a join l b on a.lang < b.lang")
def cross_lingual_table(spark, sf):
    lexed = C.sentences(read(spark, sf, "documents")).select("lang", K.lex_english(F.col("sent")).alias("d")).withColumn("k", K.reasoning_kept(F.col("d"), "en"))
    means = lexed.groupBy("lang").agg(F.avg(F.size("d")).alias("d"), F.avg(F.size(K.reasoning_collapse(F.col("k")))).alias("r"))
    other = means.select(F.col("lang").alias("other"), F.col("d").alias("d2"), F.col("r").alias("r2"))
    return means.join(other, F.col("lang") < F.col("other")).select("lang", "other", (F.col("d") / F.col("d2")).alias("ratio_default"), (F.col("r") / F.col("r2")).alias("ratio_reasoning"))



def _cut_sql(x: str) -> str:
    return f"with {_LEXED} select doc_id, pos, array_to_string({x}, ' ') as tokens from lexed"


def _cut(spark, sf, f):
    return _sents(spark, sf).select("id.*", K.lex_english(F.col("text")).alias("t")).select("doc_id", "pos", F.array_join(f(F.col("t")), " ").alias("tokens"))


@query(_cut_sql("toks[1:6]"))
def truncate_head(spark, sf):
    return _cut(spark, sf, lambda t: K.head(t, 6))


@query(_cut_sql("case when len(toks) > 6 then toks[len(toks) - 5:len(toks)] else toks end"))
def truncate_tail(spark, sf):
    return _cut(spark, sf, lambda t: K.tail(t, 6))


@query(_cut_sql("case when len(toks) > 7 then list_concat(toks[1:3], toks[len(toks) - 3:len(toks)]) else toks end"))
def truncate_head_tail(spark, sf):
    return _cut(spark, sf, lambda t: K.head_tail(t, 7))


@query(f"with {D.SENT}, {D.NORM}, {D.WORD}, {D.DISTINCT}, {D.LEMMA}, {D.AFFIX}, {D.DECOMPOSED}, {D.FIELD}, {D.emitted(True)}, o as (select em.tokens[1] as token, word, count(*) as n from word join em using (word) group by all), r as (select *, row_number() over (partition by token order by n desc, word) as k from o) select token, word, n from r where k = 1")
def snk_lookup_tables(spark, sf):
    """The most common word of each first token, of equal ones the first by name: the reverse of agg_lookup_w2t."""
    words = C.words(C.sentences(read(spark, sf, "documents"))).groupBy("word").agg(F.count("*").alias("n"))
    lexicon = C.emit(C.analyse(words.select("word")), atomic=True)
    each = words.join(lexicon.select("word", F.get("tokens", F.lit(0)).alias("token")), "word")
    best = each.groupBy("token").agg(F.min(F.struct((-F.col("n")).alias("m"), "word")).alias("x"))
    return best.select("token", "x.word", (-F.col("x.m")).alias("n"))


@query("select doc_id, n_chars, 1::bigint as made from documents")
def src_cached_file(spark, sf):
    """A table is made once and then read: the second time nothing is made, so the number of makings stays 1."""
    docs = read(spark, sf, "documents").select("doc_id", "n_chars")
    path, made = _folder(spark), []
    for _ in range(2):
        kept = readers.cached(spark, path, lambda: made.append(1) or docs)
    return kept.withColumn("made", F.lit(len(made)).cast("long"))


_FIRST = [t for t in ("[PAD]", "[UNK]", "[BOS]", "[EOS]", "[SEP]", "[Q]")]


@query(f"""with {_LEXED}, c as (select lang, t, count(*) as n from (select lang, unnest(toks) as t from lexed) group by all), k as (select lang, t, row_number() over (partition by lang order by n desc, t) as r from c),
    m as (select distinct t from k where r <= 100 union select '[PAD]' union select '[UNK]')
    select t as token, (row_number() over (order by coalesce(list_position({_FIRST}, t), 1000), t) - 1)::bigint as id from m where t in {D.items(_FIRST)} and t not in ('[PAD]', '[UNK]') or t not in {D.items(_FIRST)}
    union all select t, (select count(*) from m) - 2 + case t when '[PAD]' then 0 else 1 end from m where t in ('[PAD]', '[UNK]')""")
def vocab_polymorphic_load(spark, sf):
    """Vocabularies by language, written as one document and read as one: specials first, then by name; what is missing is added."""
    counts = _sents(spark, sf).select("id.doc_id", K.lex_english(F.col("text")).alias("t")).join(read(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    each = counts.select("lang", F.explode("t").alias("token")).groupBy("lang", "token").agg(F.count("*").alias("n"))
    # the rank limit is pushed below the shuffle; a hundred tokens of each language
    best = each.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "token"))).filter("r <= 100")
    by = best.groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct("token", "r"))).alias("ids"))
    whole = by.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("lang", "ids")))).alias("value"))
    path = _folder(spark)
    whole.write.text(path)
    return readers.read_vocabulary(spark, path)


#: Operators that are the same as another one, under their own names.
SAME = {
    "join_vocab": "encode", "win_prefix_rotation": "join_rotate", "gen_pairwise": "join_source_group", "gen_xnli_record": "src_xnli",
}
