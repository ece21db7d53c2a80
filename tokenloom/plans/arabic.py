"""The Arabic tokenizer over sentences derived from the documents: each word becomes one of a pool by its hash.

The tables have no Arabic. What the pool's words should give is written out here by hand, part by part, and the SQL puts
it together; analyses and roots are parameters, as any analyser gives them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tokenloom import lexicon_ar as A
from tokenloom.functions import text as T
from tokenloom.operators import arabic as R
from tokenloom.operators import corpus as C
from tokenloom.operators import shared
from tokenloom.plans import dialect as D
from tokenloom.plans import derived as X
from tokenloom.plans.registry import query, read

SENTENCES_AR = [(1, "هل كتب الطالب الكتاب في 1995؟"), (2, "لم يذهب محمد إلى المكتبة"), (3, "وبكتابه قال: إن 50% من 5000 صغير!"), (4, "كتب Ali-Baba في يناير 3.5"), (5, "ما ذلك؟"), (6, "")]


def _a(**x):
    return tuple(x.get(f) for f in A.FIELDS)


ANALYSES_AR = [
    ("كتب", [_a(root="ك.ت.ب", pattern="1َ2َ3", pos="verb", lex="katab", asp="p", per="3", gen="m", num="s")]),
    ("الطالب", [_a(root="ط.ل.ب", pattern="1ا2ِ3", pos="noun", lex="TAlib", prc0="Al_det", gen="m", num="s")]),
    ("الكتاب", [_a(root="ك.ت.ب", pattern="1ِ2ا3", pos="noun", lex="kitAb", prc0="Al_det")]),
    ("يذهب", [_a(root="ذ.ه.ب", pos="verb", lex="*ahab", asp="i", per="3", gen="m", num="s")]),
    ("محمد", [_a(root="ح.م.د", pos="noun_prop", lex="muHam~ad")]),
    ("المكتبة", [_a(root="ك.ت.ب", pattern="مَ1ْ2َ3َة", pos="noun", lex="maktabap", prc0="Al_det", gen="f"), _a(root="NTWS", pos="noun_prop", lex="maktabap")]),
    ("وبكتابه", [_a(root="ك.ت.ب", pattern="1ِ2ا3", pos="noun", lex="kitAb", prc2="wa_conj", prc1="bi_prep", enc0="3ms_poss")]),
    ("قال", [_a(root="ق.#.ل", pos="verb", lex="qAl", asp="p", per="3", gen="m", num="s")]),
    ("صغير", [_a(root="ص.غ.ر", pattern="1َ2ي3", pos="adj", lex="Sagiyr")]),
    ("ما", [_a(root="NTWS", pos="part_neg", lex="mA")]),
]


def _arabic(spark):
    return C.table(spark, SENTENCES_AR, "id int, text string"), spark.createDataFrame(ANALYSES_AR, R.ANALYSES), R.root_table(spark)


TOKENS_AR = [
    (1, "[BOS] STR:question ROOT:write FEAT:asp:p FEAT:3ms ROOT:want ROLE:agent ROOT:write ROLE:instance REL:in NUM:year [EOS]"),
    (2, "[BOS] STR:neg:past ROOT:move FEAT:asp:i FEAT:3ms NE:محمد REL:to ROOT:write ROLE:place [EOS]"),
    (3, "[BOS] STR:emphasis REL:and REL:with ROOT:write ROLE:instance FEAT:pron:3ms ROOT:speak FEAT:asp:p FEAT:3ms LIT:إن NUM:percent REL:from NUM:measure ROOT:ص.غ.ر [EOS]"),
    (4, "[BOS] ROOT:write FEAT:asp:p FEAT:3ms FOREIGN:ali-baba REL:in TIME:month:jan NUM:decimal [EOS]"),
    (5, "[BOS] STR:question REL:what REL:those [EOS]"),
    (6, "[BOS] [EOS]"),
]

#: of each analysed word: proclitics, root and as it is written out, field, role, pattern, features of a verb, enclitic
WORDS = [
    ("كتب", "", "ك.ت.ب", "ك.ت.ب", "write", None, "123", "FEAT:asp:p FEAT:3ms", ""), ("الطالب", "", "ط.ل.ب", "ط.ل.ب", "want", "agent", "1ا23", "", ""), ("الكتاب", "", "ك.ت.ب", "ك.ت.ب", "write", "instance", "12ا3", "", ""),
    ("يذهب", "", "ذ.ه.ب", "ذ.ه.ب", "move", None, "", "FEAT:asp:i FEAT:3ms", ""), ("المكتبة", "", "ك.ت.ب", "ك.ت.ب", "write", "place", "م123ة", "", ""),
    ("وبكتابه", "REL:and REL:with", "ك.ت.ب", "ك.ت.ب", "write", "instance", "12ا3", "", "FEAT:pron:3ms"), ("قال", "", "ق.#.ل", "ق.و.ل", "speak", None, "", "FEAT:asp:p FEAT:3ms", ""), ("صغير", "", "ص.غ.ر", "ص.غ.ر", None, "quality", "12ي3", "", ""),
]
NAMES = [("محمد", "ح.م.د")]
PERSONS = {"كتب": "3ms", "يذهب": "3ms", "قال": "3ms"}

#: words with vowel marks, numerals of all kinds, Latin words, marks, and words that no table has
OTHERS = [
    "كِتَابٌ", "مُعَلِّم،", "ـكتـب", "1995", "12", "5000", "3.5", "50%", "2020.", "١٩٩٥", "٥٠٪", "99999999999", "0007", "٣.٥", "Ali-Baba", "Xyz", "زززز", "والكتب", "بالكتب", "كالصغير", "فالطالب", "ك", "،", "يكتبون", "aكتب", "--",
]
POOL = [*(w for w, *_ in WORDS), *(w for w, _ in NAMES), "ما", *A.RELATIONS, *A.MARKS, *A.LITERALS, *A.NUMERALS, *(m for m in A.MONTHS if " " not in m), *OTHERS]


def fixture(spark):
    return C.table(spark, SENTENCES_AR, "id int, text string"), spark.createDataFrame(ANALYSES_AR, R.ANALYSES), R.root_table(spark)


def _end():
    return F.when(F.length("sent") % 5 == 0, "؟").when(F.length("sent") % 7 == 0, "!").otherwise("")


def _sents(spark, sf):
    """(id struct<doc_id, pos>, text) of the derived sentences; some ask, some exclaim."""
    sents = C.sentences(read(spark, sf, "documents"))
    words = X.pooled(F.filter(F.split("sent", " "), lambda w: w != ""), POOL)
    return sents.select(F.struct("doc_id", "pos").alias("id"), F.concat(F.array_join(words, " "), _end()).alias("text"))


def _counted(spark, sf, pieces):
    """(raw, n): the pieces of all sentences, counted.

    No piece has a space in it, so the documents' words are counted first, the last of a sentence with its mark; each
    distinct one is put into the pool and split once.
    """
    sents = C.sentences(read(spark, sf, "documents")).select(F.filter(F.split("sent", " "), lambda w: w != "").alias("words"), _end().alias("end"))
    each = sents.select("end", F.size("words").alias("size"), F.posexplode("words").alias("i", "w")).select("w", F.when(F.col("i") == F.col("size") - 1, F.col("end")).otherwise("").alias("end"))
    counted = each.groupBy("w", "end").agg(F.count("*").alias("m"))
    text = F.concat(X.chosen(X.hashed(F.col("w"), len(POOL)), POOL), "end")
    return counted.select("m", F.explode(pieces(text)).alias("raw")).groupBy("raw").agg(F.sum("m").alias("n"))


def _surfaces(spark, sf):
    """(raw, n): the pieces of all sentences, counted."""
    return _counted(spark, sf, R.split)


def _words(spark, sf):
    """(word, n): the bare words of all sentences, counted."""
    return _surfaces(spark, sf).groupBy(T.strip_arabic(F.col("raw")).alias("word")).agg(F.sum("n").alias("n"))


def _tables(spark):
    return fixture(spark)[1:]


_D = "[0-9٠-٩۰-۹]"
_AR = f"""{D.SENT}, own as (select doc_id, pos, array_to_string({X.pooled_sql("list_filter(string_split(sent, ' '), lambda w: w <> '')", POOL)}, ' ') || case when length(sent) % 5 = 0 then '؟' when length(sent) % 7 = 0 then '!' else '' end as text from sent)"""
_STRIP = "regexp_replace({}, '[" + T.ARABIC_MARKS.replace("{", "{{").replace("}", "}}") + "]', '', 'g')"
_NUMBER = f"""case when regexp_full_match(raw, '{_D}+[.,٫]?{_D}*[%٪]') then 'NUM:percent' when regexp_full_match(raw, '{_D}+[.,٫]{_D}+') then 'NUM:decimal'
    when regexp_full_match(raw, '{_D}+') then case when length(regexp_replace(raw, '^[0٠۰]+({_D})', '\\1')) > 9 then 'NUM:measure' when translate(raw, '٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹', '01234567890123456789')::bigint between 1800 and 2100 then 'NUM:year'
        when translate(raw, '٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹', '01234567890123456789')::bigint < 1000 then 'NUM:small' else 'NUM:measure' end end"""
_PIECE = f"""{_AR}, split as (select doc_id, pos, regexp_extract_all(text, {D.quote(R.SPLIT)}, 1) as raws from own), each as (select doc_id, pos, unnest(raws) as raw, generate_subscripts(raws, 1) as i from split),
    piece as materialized (select *, {_STRIP.format('raw')} as word, {_NUMBER} as num from each)"""


def _given(*, pattern: bool = False) -> list[tuple[str, str]]:
    """(word, tokens) of the pool's known words, put together from the parts above and the closed tables."""
    made = {w: "" for w in A.MARKS}
    for table in ({w: f"TIME:month:{m}" for w, m in A.MONTHS.items()}, {"ما": "REL:what"}, A.RELATIONS, {w: f"LIT:{w}" for w in A.LITERALS}, {w: "ROOT:size" for w in A.NUMERALS}):
        made = {**table, **made}
    for w, before, _, root, field, role, shape, features, after in WORDS:
        if pattern:
            core = [f"ROOT:{root}", shape and f"PAT:{shape}", role and f"ROLE:{role}"]
        else:
            core = [f"ROOT:{field}", role and f"ROLE:{role}"] if field else [f"ROOT:{root}"]
        made.setdefault(w, " ".join(x for x in (before, *core, features, after) if x))
    for w, _ in NAMES:
        made.setdefault(w, f"NE:{w}")
    return sorted(made.items())


def _token(given: list[tuple[str, str]]) -> str:
    """SQL: the tokens of a piece with its word's row g of the given table."""
    return "case when num is not null then num when regexp_matches(raw, '^[A-Za-z]') then 'FOREIGN:' || lower(raw) when length(p.word) < 2 then '' when g.word is not null then g.tokens else 'FOREIGN:' || p.word end"


def _tokens_sql(pattern: bool = False) -> str:
    given = _given(pattern=pattern)
    return f"""{_PIECE}, g(word, tokens) as ({D.values(given)}), m(word, mark) as ({D.values(A.MARKS.items())}),
    said as (select doc_id, pos, mark, i from piece join m using (word) union all select doc_id, pos, 'STR:question', 1000000 from own where text like '%؟' or text like '%?' union all select doc_id, pos, 'STR:emphasis', 1000001 from own where text like '%!'),
    marks as (select doc_id, pos, string_agg(mark, ' ' order by i) as marks from (select doc_id, pos, mark, min(i) as i from said group by all) group by doc_id, pos),
    toks as (select doc_id, pos, string_agg(t, ' ' order by i) filter (where t <> '') as tokens from (select p.doc_id, p.pos, i, {_token(given)} as t from piece p left join g on g.word = p.word) group by doc_id, pos)
    select doc_id, pos, concat_ws(' ', '[BOS]', marks, tokens, '[EOS]') as tokens from own left join marks using (doc_id, pos) left join toks using (doc_id, pos)"""


def _of_words(columns: str, rows: list[tuple], wanted: str) -> str:
    """SQL: the corpus's words that the rows know, with their count."""
    return f"with {_PIECE}, k({columns}) as ({D.values(rows)}) select word, {wanted}, count(*) as n from piece join k using (word) group by all"


@query(f"with {_AR} select doc_id, pos, array_to_string(regexp_extract_all(text, {D.quote(R.SPLIT)}, 1), '|') as words from own")
def ar_split(spark, sf):
    return _sents(spark, sf).select("id.doc_id", "id.pos", F.array_join(R.split(F.col("text")), "|").alias("words"))


@query(f"with {_PIECE} select raw, {_STRIP.format('raw')} as bare, count(*) as n from piece group by all")
def ar_strip(spark, sf):
    return _surfaces(spark, sf).select("raw", T.strip_arabic(F.col("raw")).alias("bare"), "n")


@query(f"with {_PIECE} select raw, {_NUMBER} as kind, count(*) as n from piece group by all")
def ar_num_class(spark, sf):
    return _surfaces(spark, sf).select("raw", T.number_class(F.col("raw")).alias("kind"), "n")


@query(f"""with {_PIECE}, m(word, mark) as ({D.values(A.MARKS.items())}),
    said as (select doc_id, pos, mark, i from piece join m using (word) union all select doc_id, pos, 'STR:question', 1000000 from own where text like '%؟' or text like '%?' union all select doc_id, pos, 'STR:emphasis', 1000001 from own where text like '%!'),
    marks as (select doc_id, pos, string_agg(mark, ' ' order by i) as marks from (select doc_id, pos, mark, min(i) as i from said group by all) group by doc_id, pos) select doc_id, pos, coalesce(marks, '') as marks from own left join marks using (doc_id, pos)""")
def ar_str_markers(spark, sf):
    return _sents(spark, sf).select("id.doc_id", "id.pos", F.array_join(R.marks(F.col("text")), " ").alias("marks"))


def _best(spark, sf):
    """(word, n, a): the corpus's words with the analysis that is used; those without one are left out."""
    return _words(spark, sf).join(_tables(spark)[0], "word").select("word", "n", R.best(F.col("analyses")).alias("a"))


@query(_of_words("word, root", [*((w, r) for w, _, r, *_ in WORDS), *NAMES, ("ما", None)], "root"))
def ar_best_analysis(spark, sf):
    return _best(spark, sf).select("word", "a.root", "n")


@query(_of_words("word, role", [*((x[0], x[5]) for x in WORDS), *((w, None) for w, _ in NAMES), ("ما", None)], "role"))
def ar_role(spark, sf):
    return _best(spark, sf).select("word", R.role(F.col("a")).alias("role"), "n")


@query(_of_words("word, pattern", [*((x[0], x[6]) for x in WORDS), *((w, "") for w, _ in NAMES), ("ما", "")], "pattern"))
def ar_pattern(spark, sf):
    return _best(spark, sf).select("word", R.pattern(F.col("a")).alias("pattern"), "n")


@query(_of_words("word, clitics", [*((x[0], x[1]) for x in WORDS), *((w, "") for w, _ in NAMES), ("ما", "")], "clitics"))
def ar_clitics(spark, sf):
    return _best(spark, sf).select("word", F.array_join(F.coalesce(R.clitics(F.col("a")), F.array().cast("array<string>")), " ").alias("clitics"), "n")


@query(_of_words("word, enclitic", [*((x[0], x[8] or None) for x in WORDS), *((w, None) for w, _ in NAMES), ("ما", None)], "enclitic"))
def ar_enclitic(spark, sf):
    return _best(spark, sf).select("word", F.get(R.enclitic(F.col("a")), F.lit(0)).alias("enclitic"), "n")


@query(_of_words("word, pgn", [*((x[0], PERSONS.get(x[0])) for x in WORDS), *((w, None) for w, _ in NAMES), ("ما", None)], "pgn"))
def ar_pgn(spark, sf):
    return _best(spark, sf).select("word", R.person(F.col("a")).alias("pgn"), "n")


@query(_of_words("word, root, canonical", [*((x[0], x[2], x[3]) for x in WORDS), *((w, r, r) for w, r in NAMES)], "root, canonical"))
def ar_canonical_root(spark, sf):
    made = _best(spark, sf).filter("a.root is not null")
    return made.select("word", "a.root", R.canonical_root(F.col("a.root")).alias("canonical"), "n")


@query(_of_words("word, root, field", [(x[0], x[2], x[4]) for x in WORDS if x[4]], "root, field"))
def ar_weak_root(spark, sf):
    """Fields by the closure of the root table, whose weak letters may be written as #."""
    closure = R.root_closure(_tables(spark)[1])
    return _best(spark, sf).select("word", F.col("a.root").alias("root"), "n").join(closure, "root").select("word", "root", "field", "n")


@query(f"with {_PIECE}, g(word, tokens) as ({D.values(_given())}) select p.word, coalesce(g.tokens, 'FOREIGN:' || p.word) as tokens, count(*) as n from piece p left join g on g.word = p.word where num is null and not regexp_matches(raw, '^[A-Za-z]') and length(p.word) >= 2 group by all")
def ar_word_tokens(spark, sf):
    """Fixed words before morphology, then analyses, then what has none."""
    raw = _surfaces(spark, sf).filter(T.number_class(F.col("raw")).isNull() & ~F.col("raw").rlike("^[A-Za-z]"))
    words = raw.groupBy(T.strip_arabic(F.col("raw")).alias("word")).agg(F.sum("n").alias("n")).filter(F.length("word") >= 2)
    made = R.word_tokens(words.select("word"), *_tables(spark))
    return words.join(made, "word").select("word", F.array_join("tokens", " ").alias("tokens"), "n")


@query(f"with {_PIECE}, g(word, tokens) as ({D.values(_given())}) select p.word, g.tokens, count(*) as n from piece p join g on g.word = p.word where p.word not in {D.items([x[0] for x in WORDS] + [w for w, _ in NAMES])} and num is null and length(p.word) >= 2 group by all")
def ar_fastpath(spark, sf):
    """The words that closed tables settle, without any analysis."""
    closed = [*A.MARKS, *A.MONTHS, "ما", *A.RELATIONS, *A.LITERALS, *A.NUMERALS]
    words = _words(spark, sf).filter(F.col("word").isin(closed) & (F.length("word") >= 2))
    none = _tables(spark)[0].limit(0)
    return words.join(R.word_tokens(words.select("word"), none, _tables(spark)[1]), "word").select("word", F.array_join("tokens", " ").alias("tokens"), "n")


@query(f"with {_tokens_sql()}")
def ar_tokenize(spark, sf):
    return R.tokenize(_sents(spark, sf), *_tables(spark)).select("id.doc_id", "id.pos", F.array_join("tokens", " ").alias("tokens"))


@query(f"with {_tokens_sql(True)}")
def ar_root_pattern(spark, sf):
    """The same with roots and patterns in the place of fields."""
    return R.tokenize(_sents(spark, sf), *_tables(spark), root_pattern=True).select("id.doc_id", "id.pos", F.array_join("tokens", " ").alias("tokens"))


@query(f"with {_AR} select doc_id, pos, true as aligned from own")
def ar_alignment(spark, sf):
    made = R.tokenize(_sents(spark, sf), *_tables(spark), space=True)
    total = F.aggregate("word_token_counts", F.lit(0), lambda a, b: a + b)
    return made.select("id.doc_id", "id.pos", (F.size("tokens") == 2 + F.col("prefix_count") + total).alias("aligned"))


_PROCLITICS = list(enumerate(["", *A.PROCLITICS]))


@query(f"""with {_PIECE}, k(word, field) as ({D.values([(x[0], x[4]) for x in WORDS if x[4]])}), c(prio, p) as ({D.values(_PROCLITICS)}), w as (select raw as word, count(*) as n from piece group by raw),
    hit as (select w.word, arg_min(k.field, prio) as field from w join c on p = '' or (starts_with(w.word, p) and length(w.word) > length(p) + 1) join k on k.word = substr(w.word, length(p) + 1) group by w.word)
    select word, case when word in {D.items([*A.RELATIONS, *A.MARKS, *A.LITERALS])} then 'FUNC:' || word when field is not null then 'ROOT:' || field else 'SURF:' || word end as token, n from w left join hit using (word)""")
def ar_legacy_tokenize(spark, sf):
    """The older scheme over all pieces, with a second try without a proclitic."""
    words = _surfaces(spark, sf).withColumnRenamed("raw", "word")
    return words.join(R.legacy_tokens(words.select("word"), *_tables(spark)), "word").select("word", "token", "n")


def _outcomes(spark, sf):
    """(word, root, outcome): what became of each distinct word of the corpus."""
    analyses, roots = _tables(spark)
    words = _words(spark, sf).filter("word <> ''").select("word")
    found = words.join(analyses, "word", "left").withColumn("root", R.best(F.col("analyses"))["root"])
    closure = shared.broadcastable(R.root_closure(roots).withColumnsRenamed({"root": "_root", "field": "_field"}))
    fixed = F.col("word").isin([*A.RELATIONS, *A.MARKS, *A.LITERALS, "ما"])
    real = F.col("root").isNotNull() & ~F.col("root").isin(A.NO_ROOTS)
    outcome = F.when(fixed, "function").when(real & F.col("_field").isNotNull(), "root_field").when(real, "root_no_field").otherwise("no_root")
    return found.join(closure, F.col("root") == F.col("_root"), "left").select("word", "root", outcome.alias("outcome"))


_OUTCOME = f"""{_PIECE}, k(word, root, field) as ({D.values([*((x[0], x[2], x[4]) for x in WORDS), *((w, r, None) for w, r in NAMES)])}), o as (select word, root, case when word in {D.items([*A.RELATIONS, *A.MARKS, *A.LITERALS, "ما"])} then 'function' when field is not null then 'root_field'
    when root is not null then 'root_no_field' else 'no_root' end as outcome from (select distinct word from piece where word <> '') left join k using (word))"""


@query(f"""with {_AR}, c as (select regexp_replace(raw, '[{T.VOWEL_MARKS}]', '', 'g') as word, count(*) as n from (select unnest(regexp_extract_all(text, '{R.ARABIC_RUN}')) as raw from own) group by 1),
    k(stem, field) as ({D.values([*((x[0], x[4]) for x in WORDS), *((w, None) for w, _ in NAMES)])}), p(prio, p) as ({D.values(_PROCLITICS)}), hit as (select word, bool_or(field is not null) as fits, bool_or(prio = 0) as rooted
        from (select word, prio, substr(word, length(p) + 1) as stem from c join p on prio = 0 or (starts_with(word, p) and length(word) > length(p) + 1)) join k using (stem) group by word),
    o as (select case when word in {D.items(A.FUNCTION_WORDS)} then 'function' when fits then 'root_field' when rooted then 'root_no_field' else 'no_root' end as outcome, sum(n)::bigint as n from c left join hit using (word) group by 1)
    select outcome, n, (n * 100 // sum(n) over ())::bigint as pct, (coalesce(sum(n) filter (outcome in ('function', 'root_field')) over (), 0) * 100 // sum(n) over ())::bigint as coverage from o""")
def agg_missed_roots(spark, sf):
    """A function word, a root with or without a field, or nothing: counts and whole percents of the corpus's words, and how
    many the first two cover. Words count as often as they stand there; those without a field are tried without proclitics."""
    runs = _counted(spark, sf, lambda text: F.regexp_extract_all(text, F.lit(R.ARABIC_RUN), F.lit(0)))
    words = runs.groupBy(F.regexp_replace("raw", f"[{T.VOWEL_MARKS}]", "").alias("word")).agg(F.sum("n").alias("n"))
    by = R.root_outcomes(words, *_tables(spark)).groupBy("outcome").agg(F.sum("n").alias("n"))
    covered = F.sum(F.when(F.col("outcome").isin("function", "root_field"), F.col("n")).otherwise(0))
    total = by.agg(F.sum("n").alias("total"), covered.alias("covered"))
    return by.join(F.broadcast(total)).select("outcome", "n", F.expr("n * 100 div total").alias("pct"), F.expr("covered * 100 div total").alias("coverage"))


@query(f"with {_OUTCOME} select root, count(*) as n from o where outcome = 'root_no_field' group by root order by n desc, root limit 30")
def agg_top_missed_roots(spark, sf):
    """The thirty most frequent roots that no field has."""
    counts = _outcomes(spark, sf).filter("outcome = 'root_no_field'").groupBy("root").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "root").limit(30)


@query(f"""with {_AR}, w as (select unnest(string_split(text, ' ')) as surface from own union all select unnest(string_split(text, ' ')) from documents), c as (select surface, count(*) as n from w where surface <> '' group by surface), b as (select *, regexp_replace(surface, '[{T.VOWEL_MARKS}]', '', 'g') as x from c)
    select surface, case when regexp_matches(x, '[0-9٠-٩۰-۹]') then 'num' when regexp_matches(x, '[A-Za-z]') and not regexp_matches(x, '[ء-ي]') then 'foreign' when regexp_matches(x, '[A-Za-z]') then 'mixed_script' when not regexp_matches(x, '[A-Za-zء-يÀ-ɏ]') then 'punct_only'
        when length(x) <= 1 then 'single_char' when length(x) <= 3 then 'short_arabic' else 'arabic_4plus' end as bucket, n from b""")
def lit_audit_classify(spark, sf):
    """The surfaces of the documents and of the derived sentences by what they are written in."""
    own = _sents(spark, sf).select(F.explode(F.split("text", " ")).alias("surface")).unionByName(read(spark, sf, "documents").select(F.explode(F.split("text", " ")).alias("surface")))
    counts = own.filter("surface <> ''").groupBy("surface").agg(F.count("*").alias("n"))
    return counts.select("surface", T.literal_bucket(F.col("surface")).alias("bucket"), "n")
