"""Dictionaries, encodings, caps and word-level baselines."""

from __future__ import annotations

from pyspark.sql import functions as F

from tokenloom import lexicon as L
from tokenloom.functions import tokens as K
from tokenloom.operators import baselines as B
from tokenloom.operators import corpus as C
from tokenloom.operators import codec, shared
from tokenloom.operators import sketches as H
from tokenloom.operators import subword as U
from tokenloom.plans import dialect as D
from tokenloom.plans.registry import query, read

CAP = 2_000


def _lexed(spark, sf):
    sents = C.sentences(read(spark, sf, "documents"))
    return sents.select("doc_id", "lang", "pos", K.lex_english(F.col("sent")).alias("tokens"))


def _lexed_once(spark, sf, cap=CAP):
    """The lexed sentences, stored, and the vocabulary of their tokens: texts are lexed once for both."""
    lexed = shared.stored(_lexed(spark, sf))
    return lexed, shared.stored(B.top_vocabulary(C.token_counts(lexed), L.SPECIALS, cap))


def _shown(df, *columns):
    """Array columns as texts of numbers."""
    return df.withColumns({c: F.array_join(F.col(c).cast("array<string>"), " ") for c in columns or ("ids",)})


def _counts(spark, sf):
    return C.token_counts(_lexed(spark, sf))


def _vocab(spark, sf, cap=CAP):
    """(token, id): the specials, then the most frequent tokens; stored, so that texts are lexed once however often it is read."""
    return shared.stored(B.top_vocabulary(_counts(spark, sf), L.SPECIALS, cap))


_LEX = f"{D.SENT}, lexed as (select doc_id, lang, pos, {D.lex_english('sent')} as tokens from sent), each as (select doc_id, lang, pos, unnest(tokens) as token, generate_subscripts(tokens, 1)::int - 1 as i from lexed)"
_COUNT = f"{_LEX}, counts as (select token, count(*) as n from each group by token)"
_SPECIAL = f"special as (select t as token, (row_number() over (order by i) - 1) as id from ({D.values([(t, i) for i, t in enumerate(L.SPECIALS)])}) s(t, i))"


def _top(cap: int) -> str:
    return f"""{_COUNT}, {_SPECIAL}, vocab as (select token, id from special union all select token, id from (
        select token, row_number() over (order by n desc, token) + {len(L.SPECIALS) - 1} as id from counts where token not in {D.items(L.SPECIALS)}) where id < {cap})"""


@query(f"with {_COUNT} select token, n from counts")
def agg_token_freq(spark, sf):
    return _counts(spark, sf)


@query(f"with {_COUNT} select token, n, row_number() over (order by n desc, token) as rank from counts")
def win_rank_freq(spark, sf):
    return C.by_frequency(_counts(spark, sf)).select("token", "n", "rank")


@query(f"with {_COUNT} select token, n from counts order by n desc, token limit 50")
def sort_desc_freq(spark, sf):
    return _counts(spark, sf).orderBy(F.desc("n"), "token").limit(50)


@query(f"with {_LEX} select token, row_number() over (order by min((doc_id, pos, i))) - 1 as id from each group by token")
def vocab_first_seen(spark, sf):
    each = _lexed(spark, sf).select("doc_id", "pos", F.posexplode("tokens").alias("i", "token"))
    return B.first_seen(each)


@query(f"with {_top(CAP)} select token, id from vocab")
def agg_vocab_top(spark, sf):
    return _vocab(spark, sf)


@query(f"with {_top(CAP)} select 1 - sum(case when v.token is not null then n else 0 end) / sum(n) as oov from counts left join vocab v using (token)")
def agg_oov_fraction(spark, sf):
    counts = shared.stored(_counts(spark, sf))
    vocab = B.top_vocabulary(counts, L.SPECIALS, CAP)
    joined = counts.join(vocab.select("token", F.lit(1).alias("known")), "token", "left")
    return joined.agg((1 - F.sum(F.when(F.col("known") == 1, F.col("n")).otherwise(0)) / F.sum("n")).alias("oov"))


@query(f"with {_top(CAP)} select doc_id, pos, string_agg(coalesce(v.id, 1)::varchar, ' ' order by i) as ids from each left join vocab v using (token) group by doc_id, pos")
def encode(spark, sf):
    return _shown(C.encode(*_lexed_once(spark, sf), ["doc_id", "pos"]))


@query(f"with {_top(CAP)}, e as (select doc_id, pos, i, coalesce(v.id, 1) as id from each left join vocab v using (token)) select doc_id, pos, string_agg(coalesce(v.token, '[UNK]'), ' ' order by i) as tokens from e left join vocab v using (id) group by doc_id, pos")
def decode(spark, sf):
    lexed, vocab = _lexed_once(spark, sf)
    ids = C.encode(lexed, vocab, ["doc_id", "pos"])
    return C.decode(ids, vocab, ["doc_id", "pos"]).select("doc_id", "pos", F.array_join("tokens", " ").alias("tokens"))


@query(f"with {_top(CAP)} select doc_id, pos, string_agg((case when v.id < 500 then v.id else 1 end)::varchar, ' ' order by i) as ids from each left join vocab v using (token) group by doc_id, pos")
def vocab_frozen(spark, sf):
    """Ids of a given vocabulary cut at an id; what lies above is unknown."""
    lexed, vocab = _lexed_once(spark, sf)
    return _shown(C.encode(lexed, vocab.filter("id < 500"), ["doc_id", "pos"]))


@query(f"with {_top(CAP)} select max(id) + 1 as size, count(*) as n, max(case when token = '[UNK]' then id end) as unk, max(case when token = '[BOS]' then id end) as bos from vocab")
def vocab_export(spark, sf):
    vocab = _vocab(spark, sf)
    special = {n: F.max(F.when(F.col("token") == t, F.col("id"))).alias(n) for n, t in (("unk", "[UNK]"), ("bos", "[BOS]"))}
    return vocab.agg((F.max("id") + 1).alias("size"), F.count("*").alias("n"), *special.values())


@query(f"with {_LEX} select lang, count(distinct token) as kinds from each group by lang")
def agg_distinct_per_lang(spark, sf):
    return _lexed(spark, sf).select("lang", F.explode("tokens").alias("token")).groupBy("lang").agg(F.countDistinct("token").alias("kinds"))


_STAGED = f"""{_LEX}, turns as (select role as lang, unnest({D.lex_english('text')}) as token from conversations), items as (select 'none' as lang, unnest({D.lex_english('text')}) as token from benchmark),
    staged as (select 'documents' as stage, lang, token from each union all select 'turns', lang, token from turns union all select 'items', lang, token from items)"""


@query(f"with {_STAGED} select stage, lang, grouping_id(stage, lang) as level, count(*) as n, count(distinct token) as kinds, true as close from staged group by grouping sets ((stage, lang), (stage), ())")
def agg_distinct_sketches(spark, sf):
    """Kinds of tokens by stage and language from stored sketches that merge, held against the exact counts: within 3 % of each."""
    lexed = K.lex_english(F.col("text"))
    stages = {
        "documents": _lexed(spark, sf).select("lang", F.explode("tokens").alias("token")), "turns": read(spark, sf, "conversations").select(F.col("role").alias("lang"), F.explode(lexed).alias("token")),
        "items": read(spark, sf, "benchmark").select(F.lit("none").alias("lang"), F.explode(lexed).alias("token")),
    }
    path, each = shared.folder(spark, "sketches"), None
    for stage, tokens in stages.items():
        # counted once, for the sketches and for the exact numbers: neither needs each token's places
        counts = shared.stored(tokens.groupBy("lang", "token").agg(F.count("*").alias("n")))
        H.add_stage(path, stage, counts)
        own = counts.select(F.lit(stage).alias("stage"), "lang", "token", "n")
        each = own if each is None else each.unionByName(own)
    sketches = H.stages(spark, path)
    keys = {0: ["stage", "lang"], 1: ["stage"], 3: []}
    guess = None
    for level, k in keys.items():
        made = H.estimated(H.merged(sketches, k)).select(*(F.col(c) if c in k else F.lit(None).cast("string").alias(c) for c in ("stage", "lang")), F.lit(level).alias("level"), "estimate")
        guess = made if guess is None else guess.unionByName(made)
    exact = each.groupingSets([["stage", "lang"], ["stage"], []], "stage", "lang").agg(F.grouping_id("stage", "lang").alias("level"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.countDistinct("token").alias("kinds"))
    on = exact["stage"].eqNullSafe(guess["stage"]) & exact["lang"].eqNullSafe(guess["lang"]) & (exact["level"] == guess["level"])
    # a row for each stage and language on both sides
    both = exact.join(F.broadcast(guess), on).select(exact["stage"], exact["lang"], exact["level"], "n", "kinds", "estimate")
    return both.select("stage", "lang", "level", "n", "kinds", (F.abs(F.col("estimate") - F.col("kinds")) <= 0.03 * F.col("kinds")).alias("close"))


@query(f"with {D.SENT}, {D.REASON} select 1 - (select count(distinct t) from (select unnest(reasoning_tokens) as t from proj)) / count(distinct w) as reduction from (select unnest(string_split(lower(sent), ' ')) as w from sent)")
def agg_vocab_reduction(spark, sf):
    sents = C.sentences(read(spark, sf, "documents"))
    words = sents.select(F.explode(F.split(F.lower("sent"), " ")).alias("w")).agg(F.countDistinct("w").alias("b"))
    kept = _lexed(spark, sf).select(K.reasoning_kept(F.col("tokens"), "en").alias("k")).select(F.explode("k").alias("t")).agg(F.countDistinct("t").alias("a"))
    return kept.join(F.broadcast(words)).select((1 - F.col("a") / F.col("b")).alias("reduction"))


def _cap_sql(literal: str, first: list[str], by_name: bool, cap: int) -> str:
    n = len(first)
    special = D.values([(t, i) for i, t in enumerate(first)])
    order = "token" if by_name else "n desc, token"
    return f"""with {D.tokenized()}, counts as (select token, count(*) as n from (select unnest(tokens) as token from tok) group by token), special as (select * from ({special}) s(token, id)),
    core as (select token, row_number() over (order by {order}) + {n - 1} as id from counts where not ({literal}) and token not in {D.items(first)}),
    dyn as (select token, row_number() over (order by n desc, token) + {n - 1} + (select count(*) from core) as id from counts where {literal})
    select token, id from special union all select token, id from core union all select token, id from dyn where id < {cap}"""


def _semantic(spark, sf):
    return C.token_weights(read(spark, sf, "documents"))


@query(_cap_sql("token like 'LIT:%'", ["<PAD>", "<UNK>"], False, 1000))
def cap_vocab_lit(spark, sf):
    return C.cap_vocabulary(_semantic(spark, sf), 1000, policy="literal")


_SURF = "select case when starts_with(token, 'LIT:') then 'SURF:' || substr(token, 5) else token end as token, n from lit"


@query(_cap_sql("token like 'SURF:%'", ["<PAD>", "<UNK>"], False, 1000).replace("counts as (", "lit as (", 1).replace(", special as", f", counts as ({_SURF}), special as", 1))
def cap_vocab_surf(spark, sf):
    """The older scheme's cap: unknown words are surfaces there."""
    counts = _semantic(spark, sf).withColumn("token", F.when(F.col("token").startswith("LIT:"), F.concat(F.lit("SURF:"), F.substr("token", F.lit(5)))).otherwise(F.col("token")))
    return C.cap_vocabulary(counts, 1000, policy="surface")


@query(_cap_sql("token like 'LIT:%' or token like 'FOREIGN:%' or token like 'NE:%'", L.SPECIALS, True, 1000))
def cap_vocab_structural(spark, sf):
    return C.cap_vocabulary(_semantic(spark, sf), 1000, policy="structural")


@query(_cap_sql("token like 'LIT:%' or token like 'FOREIGN:%' or token like 'NE:%' or token like 'SURF:%'", [*L.SPECIALS, "REL:and", "REL:or"], True, 1000))
def cap_vocab_frozen(spark, sf):
    return C.cap_vocabulary(_semantic(spark, sf), 1000, policy="core", registered=[*L.SPECIALS, "REL:and", "REL:or"])


def _report_sql(literal: str, first: list[str], by_name: bool, cap: int) -> str:
    made = _cap_sql(literal, first, by_name, cap)
    last = made.rindex("select token, id from special union all")
    return f"""{made[:last].rstrip()}, vocab as ({made[last:]}), k as (select token, n, {literal} as dynamic, token in (select token from vocab) as known from counts)
    select count(*) as kinds, count(*) filter (where known) as kinds_kept, count(*) filter (where dynamic and known) as dynamic_kept, sum(n)::bigint as tokens, round(coalesce(sum(n) filter (where dynamic and known), 0) / greatest(coalesce(sum(n) filter (where dynamic), 0), 1), 9) as dynamic_coverage,
        round(coalesce(sum(n) filter (where not known), 0) / greatest(sum(n), 1), 9) as unknown_rate, (select count(*) from vocab) as size from k"""


_DYNAMIC = ["LIT:", "FOREIGN:", "NE:", "SURF:"]


@query(_report_sql(" or ".join(f"token like '{p}%'" for p in _DYNAMIC), [*L.SPECIALS, "REL:and", "REL:or"], True, 1000))
def cap_unknown_rate(spark, sf):
    """What the core policy's cap keeps, the coverage of its dynamic part, and the rate of unknown tokens to expect."""
    counts = shared.stored(_semantic(spark, sf))
    vocab = C.cap_vocabulary(counts, 1000, policy="core", registered=[*L.SPECIALS, "REL:and", "REL:or"])
    made = C.cap_report(counts, vocab, F.col("token").rlike("^(" + "|".join(_DYNAMIC) + ")"))
    return made.withColumns({c: F.round(c, 9) for c in ("dynamic_coverage", "unknown_rate")})


@query(_report_sql("token like 'LIT:%'", ["<PAD>", "<UNK>"], False, 1000))
def cap_literal_unknown_rate(spark, sf):
    """The same of the literal policy."""
    counts = shared.stored(_semantic(spark, sf))
    made = C.cap_report(counts, C.cap_vocabulary(counts, 1000, policy="literal"), F.col("token").startswith("LIT:"))
    return made.withColumns({c: F.round(c, 9) for c in ("dynamic_coverage", "unknown_rate")})


_TS = "list_filter(string_split_regex(regexp_replace(lower(sent), '([.,!?;:])', ' \\1 ', 'g'), '[ \\t\\r\\n]+'), lambda w: w <> '')"


@query(f"with {D.SENT}, w as (select doc_id, pos, {_TS} as ws from sent), e as (select doc_id, pos, unnest(ws) as token, generate_subscripts(ws, 1)::int - 1 as i from w where len(ws) >= 3) select token, row_number() over (order by min((doc_id, pos, i))) + 3 as id, count(*) as n from e group by token")
def base_word_ts(spark, sf):
    """White-space words with spaced punctuation, ids as first seen behind four specials."""
    return B.whitespace_vocabulary(C.sentences(read(spark, sf, "documents")))


_PY = "regexp_extract_all(lower(sent), '[A-Za-z0-9_À-ɏ؀-ۿ]+|[^A-Za-z0-9_À-ɏ؀-ۿ \\t\\r\\n]')"


@query(f"""with {D.SENT}, c as (select token, count(*) as n from (select unnest({_PY}) as token from sent) group by token),
    v as (select token, row_number() over (order by n desc, token) + 1 as id from c)
    select doc_id, pos, array_to_string(list(coalesce(v.id, 1)::int order by i)[1:128], ' ') as ids from (select doc_id, pos, unnest({_PY}) as token, generate_subscripts({_PY}, 1) as i from sent) e left join (select * from v where id < 1000) v using (token)
    group by doc_id, pos having count(*) >= 4""")
def base_word_py(spark, sf):
    """Word and punctuation ids of the most frequent 998; sentences under four are left out, long ones cut."""
    return _shown(B.word_ids(C.sentences(read(spark, sf, "documents")), 1000, 128))


def _two_codecs(spark, sf):
    """(doc_id, lang, pos, sent, tokens, pieces): the lexer's tokens and the given SentencePiece model's ids of each sentence."""
    sents = C.sentences(read(spark, sf, "documents")).select("doc_id", "lang", "pos", "sent", K.lex_english(F.col("sent")).alias("tokens"))
    return U.with_pieces(sents, "sent")


@query()
def base_spm(spark, sf):
    """Pieces of a given SentencePiece model by language, of sentences with three or more, and the lexer's tokens against them."""
    return U.compression(_two_codecs(spark, sf), ["lang"])


_BI = f"{_COUNT}, pair as (select doc_id, pos, token as a, lead(token) over (partition by doc_id, pos order by i) as b from each), bi as (select a, b, count(*) as nab from pair where b is not null group by a, b), uni as (select a, sum(nab) as na from bi group by a), size as (select count(*) as v from counts)"


@query(f"with {_BI} select a, b, nab, round(-ln((nab + 1.0) / (na + v)), 9) as nll from bi join uni using (a), size")
def ngram_lm(spark, sf):
    """Add-one bigram scores; a proxy of our own, not to be held against a neural model's figures."""
    return B.bigrams(_lexed(spark, sf)).withColumn("nll", F.round("nll", 9))


@query(f"""with {_BI}, sc as (select p.doc_id, p.pos, sum(-ln((nab + 1.0) / (na + v))) as nll, count(*) as n_tokens from pair p join bi on bi.a = p.a and bi.b = p.b join uni on uni.a = p.a, size where p.b is not null group by p.doc_id, p.pos)
    select lang, round(sum(nll), 4) as nll, sum(n_tokens)::bigint as n_tokens, sum(length(sent))::bigint as n_chars, round(sum(nll) / sum(length(sent)) / ln(2), 6) as bpc, round(exp(least(sum(nll) / sum(n_tokens), 20)), 4) as perplexity from sc join sent using (doc_id, pos) group by lang""")
def agg_bpc(spark, sf):
    """Bits per character under the bigram model of the same sentences: pairs are counted by language, then scored once."""
    from tokenloom.operators import stats as S

    lexed = C.sentences(read(spark, sf, "documents")).select("lang", F.length("sent").alias("size"), K.lex_english(F.col("sent")).alias("tokens"))
    lexed = shared.stored(lexed)  # read for the pairs and for the lengths
    scored = B.score_languages(lexed)
    chars = lexed.groupBy("lang").agg(F.sum("size").alias("n_chars"))
    made = S.bits_per_character(scored.join(F.broadcast(chars), "lang"), ["lang"])  # a row for each language
    return made.withColumns({"nll": F.round("nll", 4), "bpc": F.round("bpc", 6), "perplexity": F.round("perplexity", 4)})


@query(f"""with {_top(CAP)}, e as (select doc_id, pos, list(coalesce(v.id, 1)::int order by i) as ids from each left join vocab v using (token) group by doc_id, pos), g as (select *, max(len(ids)) over (partition by doc_id) as w from e)
    select doc_id, pos, array_to_string(ids || list_transform(range(w - len(ids)), lambda x: 0), ' ') as padded, array_to_string(list_transform(ids, lambda x: 1) || list_transform(range(w - len(ids)), lambda x: 0), ' ') as mask, array_to_string(list_append(ids[2:], -100), ' ') as labels from g""")
def pad_mask(spark, sf):
    """Sentences padded to the longest of their batch; a document's sentences are a batch."""
    ids = C.encode(*_lexed_once(spark, sf), ["doc_id", "pos"])
    return _shown(B.padded(ids, ["doc_id"]).select("doc_id", "pos", "padded", "mask", "labels"), "padded", "mask", "labels")


@query()
def lit_cap_zero(spark, sf):
    """Literal ids go; where any was there, the sentence's own SentencePiece ids follow, moved up by the vocabulary's size."""
    return _shown(U.literal_free(_two_codecs(spark, sf), _vocab(spark, sf)).select("doc_id", "pos", "ids"))


@query(f"""with {_top(CAP)}, ws as (select doc_id, pos, {_TS} as w from sent), wv as (select w, row_number() over (order by n desc, w) as wid from (select w, count(*) as n from (select unnest(w) as w from ws) group by w)),
    piece as (select doc_id, pos, list(wid::int order by i) as pieces from (select doc_id, pos, unnest(w) as w, generate_subscripts(w, 1) as i from ws) join wv using (w) group by doc_id, pos),
    own as (select doc_id, pos, list(case when starts_with(e.token, 'LIT:') and v.id is not null then -1 else coalesce(v.id, 1)::int end order by i) as ids from each e left join vocab v using (token) group by doc_id, pos), size as (select max(id) + 1 as n from vocab)
    select doc_id, pos, array_to_string(list_concat(list_filter(ids, lambda x: x >= 0), case when list_contains(ids, -1) then list_transform(coalesce(pieces, []), lambda x: x + n) else [] end), ' ') as ids from own left join piece using (doc_id, pos), size""")
def lit_cap_zero_words(spark, sf):
    """The same with white-space words by frequency as the second codec, stored apart and aligned on the sentence's id."""
    sents = C.sentences(read(spark, sf, "documents"))
    spaced = F.split(F.regexp_replace(F.lower("sent"), "([.,!?;:])", " $1 "), "[ \\t\\r\\n]+")
    words = shared.stored(sents.select("doc_id", "pos", F.filter(spaced, lambda w: w != "").alias("tokens")))
    vocab = C.by_frequency(C.token_counts(words), "id").select("token", "id")
    second = shared.stored(C.encode(words, vocab, ["doc_id", "pos"]).withColumnRenamed("ids", "pieces"))
    lexed, own = _lexed_once(spark, sf)
    both = U.aligned(lexed, second, ["doc_id", "pos"])
    return _shown(U.literal_free(both, own).select("doc_id", "pos", "ids"))


@query(f"""with {_top(CAP)}, s as (select token, id, row_number() over (order by id) as r, row_number() over (order by md5('11:' || token), token) as h from vocab where not starts_with(token, 'LIT:') and not starts_with(token, '['))
    select v.token, v.id, coalesce(b.id, v.id) as new_id from vocab v left join s a using (token) left join s b on b.r = a.h""")
def ids_permute(spark, sf):
    """A seeded permutation of the ids of structured tokens; literals and specials keep theirs."""
    return B.permuted(_vocab(spark, sf), seed=11)


@query(f"with {_top(CAP)} select case when starts_with(token, '[') then 'SPECIAL' else string_split(token, ':')[1] end as bucket, count(*) as n from vocab group by bucket")
def vocab_buckets(spark, sf):
    bucket = F.when(F.col("token").startswith("["), "SPECIAL").otherwise(F.substring_index("token", ":", 1))
    return _vocab(spark, sf).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


@query(f"""with {D.tokenized(True)}, own as (select w.doc_id, w.pos, w.i, w.word, em.tokens as slice from word w join em using (word)),
    seq as (select word, array_to_string(slice, ' ') as tokens, count(*) as n from own group by all), best as (select *, row_number() over (partition by word order by n desc, tokens) as k from seq)
    select word, tokens, n from best where k = 1""")
def agg_lookup_w2t(spark, sf):
    """The most common token sequence of each word, from the slices that alignment counts cut out of tokenized sentences."""
    return B.word_sequences(C.aligned(read(spark, sf, "documents"), atomic=True))


@query(f"""with {D.tokenized(True)}, c as (select doc_id, pos, row_number() over (partition by doc_id, pos order by i) - 1 as i, len(em.tokens) as c from word join em using (word))
    select doc_id, pos, i::int as i, c::int as c, coalesce(sum(c) over (partition by doc_id, pos order by i rows between unbounded preceding and 1 preceding), 0)::bigint as start from c""")
def win_cumulative_cursor(spark, sf):
    """Where each word's tokens start in its sentence: the counts before it, summed inside the row in one pass."""
    made = codec.running(C.aligned(read(spark, sf, "documents"), atomic=True).select("doc_id", "pos", "counts"), "counts", "starts")
    return made.select("doc_id", "pos", F.posexplode(F.arrays_zip("counts", "starts")).alias("i", "x")).select("doc_id", "pos", "i", F.col("x.counts").alias("c"), F.col("x.starts").alias("start"))


_CLEAN = "regexp_replace(w, '[،؛.؟!:]+$', '')"


@query(f"""with {D.SENT}, rel as ({D.values(L.RELATIONS.items())}), r(word, token) as (select * from rel), ws as (select doc_id, pos, list_filter(string_split_regex(trim(sent), '[ \\t\\r\\n]+'), lambda w: w <> '') as ws from sent),
    each as (select doc_id, pos, unnest(ws) as w, generate_subscripts(ws, 1) as i from ws), bare as (select *, {_CLEAN} as c from each),
    surf as (select c, count(*) as n from bare where c not in (select word from r) and length(c) > 3 group by c order by n desc, c limit 500),
    vocab as (select token, row_number() over (order by token) + 3 as id from (select distinct token from r union all select 'SURF:' || c from surf)),
    m as (select doc_id, pos, i, coalesce(r1.token, r2.token) as t, 'SURF:' || c as s1, 'SURF:' || w as s2 from bare left join r r1 on r1.word = c left join r r2 on r2.word = w)
    select doc_id, pos, '2 ' || string_agg(case when t is not null then coalesce(v.id, 1) else coalesce(x.id, y.id, 1) end::varchar, ' ' order by i) as ids from m left join vocab v on v.token = t left join vocab x on x.token = s1 left join vocab y on y.token = s2 group by doc_id, pos""")
def demo_encode(spark, sf):
    """Ids of white-space words as the small encoder gives them: without trailing marks first, then as they are, then as surfaces."""
    sents = C.sentences(read(spark, sf, "documents")).select("doc_id", "pos", F.col("sent").alias("text"))
    known = C.table(spark, list(L.RELATIONS.items()), "word string, token string")
    # counted as they stand there before marks are taken from them, once a word
    own = sents.select(F.explode(B.demo_words(F.col("text"))).alias("w")).groupBy("w").agg(F.count("*").alias("m"))
    bare = own.groupBy(B.demo_clean(F.col("w")).alias("c")).agg(F.sum("m").alias("n"))
    counts = bare.join(F.broadcast(known), F.col("c") == F.col("word"), "left_anti").filter(F.length("c") > 3)
    # stored: ranges are sampled before they are dealt, which would read all texts twice
    surfaces = shared.stored(counts.orderBy(F.desc("n"), "c").limit(500).select(F.concat(F.lit("SURF:"), "c").alias("token")))
    tokens = known.select("token").distinct().unionByName(surfaces)
    vocab = shared.ranked(tokens, [F.col("token")], "id").select("token", (F.col("id") + 3).alias("id"))
    return _shown(B.demo_ids(sents, known, vocab, begin=2, unknown=1).select("doc_id", "pos", "ids"))
