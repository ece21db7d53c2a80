"""The Arabic tokenizer over a table of morphological analyses (word, analyses array<struct>)."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom import lexicon_ar as A
from tokenloom.functions import text as T
from tokenloom.operators import codec, shared

ANALYSES = "word string, analyses array<struct<" + ", ".join(f"{f}: string" for f in A.FIELDS) + ">>"
SPLIT = "([؀-ۿݐ-ݿ]+|[A-Za-z][A-Za-z\\-']*|[0-9٠-٩۰-۹][0-9٠-٩۰-۹.,٫]*[%٪]?)"
NUMERAL = "^[0-9٠-٩۰-۹]"
#: A run of the Arabic block, as missed roots are counted over.
ARABIC_RUN = "[؀-ۿ]+"


@dataclass
class Lexicon:
    """What the Arabic tokenizer knows. Closed tables are Python values; roots (root, field) is a DataFrame of any size, None the own small one."""

    marks: dict[str, str] = field(default_factory=lambda: A.MARKS)
    relations: dict[str, str] = field(default_factory=lambda: A.RELATIONS)
    literals: list[str] = field(default_factory=lambda: A.LITERALS)
    numerals: list[str] = field(default_factory=lambda: A.NUMERALS)
    months: dict[str, str] = field(default_factory=lambda: A.MONTHS)
    patterns: dict[str, str] = field(default_factory=lambda: A.PATTERNS)
    roots: DataFrame | None = None


def _none() -> Column:
    return F.array().cast("array<string>")


def _one(token: Column | str) -> Column:
    return F.array(F.lit(token) if isinstance(token, str) else token)


def split(sentence: Column) -> Column:
    """Runs of Arabic letters, Latin words and numerals. Digits of the Arabic block belong to its letter runs."""
    return F.regexp_extract_all(sentence, F.lit(SPLIT), F.lit(1))


def marks(sentence: Column, lexicon: Lexicon | None = None) -> Column:
    """Sentence marks in the order of their first words, then question and emphasis by the last character."""
    known = (lexicon or Lexicon()).marks
    found = F.transform(F.transform(split(sentence), T.strip_arabic), lambda w: T.any_of([(w == k, v) for k, v in known.items()], F.lit(None).cast("string")))
    end = F.rtrim(sentence)
    asked = F.when(end.endswith("؟") | end.endswith("?"), F.lit("STR:question"))
    return F.array_distinct(F.array_compact(F.concat(found, F.array(asked, F.when(end.endswith("!"), F.lit("STR:emphasis"))))))


def best(analyses: Column) -> Column:
    """The analysis to use: a name whose lexeme no other reading has, else the first reading with a root, else the first name."""

    def real(a: Column) -> Column:
        return (F.coalesce(a["root"], F.lit("")) != "") & ~a["root"].isin(A.NO_ROOTS)

    names = F.filter(analyses, lambda a: F.coalesce(a["pos"], F.lit("")) == "noun_prop")
    common = F.filter(analyses, lambda a: (F.coalesce(a["pos"], F.lit("")) != "noun_prop") & real(a))
    lexemes = F.transform(common, lambda a: a["lex"])
    own = F.filter(names, lambda a: (F.coalesce(a["lex"], F.lit("")) != "") & ~F.coalesce(F.array_contains(lexemes, a["lex"]), F.lit(False)))
    return F.coalesce(F.get(own, F.lit(0)), F.get(common, F.lit(0)), F.get(names, F.lit(0)))


def rootless(analyses: Column) -> Column:
    """Whether no reading has a real root; true without readings."""
    return ~F.coalesce(F.exists(analyses, lambda a: (F.coalesce(a["root"], F.lit("")) != "") & ~a["root"].isin(A.NO_ROOTS)), F.lit(False))


def pattern(a: Column) -> Column:
    return F.translate(T.strip_vowels(F.coalesce(a["pattern"], F.lit(""))), "ٱ", "ا")


def role(a: Column, lexicon: Lexicon | None = None) -> Column:
    """By pattern, else by part of speech; some roots with some patterns have a role of their own."""
    shape = pattern(a)
    made = T.any_of([(shape == k, v) for k, v in (lexicon or Lexicon()).patterns.items()], T.any_of([(a["pos"] == k, v) for k, v in A.POS_ROLES.items()], F.lit(None).cast("string")))
    return T.any_of([((a["root"] == r) & (shape == p), v) for (r, p), v in A.ROOT_PATTERN_ROLES.items()], made)


def critical(token: Column) -> Column:
    """Whether a feature stays when only critical ones do."""
    return ~token.startswith("FEAT:") | token.startswith("FEAT:asp:") | token.startswith("FEAT:pron:") | token.isin([f"FEAT:{p}" for p in A.PERSONS])


def clitics(a: Column, critical_only: bool = True) -> Column:
    """Tokens of the proclitics, outer ones first."""
    parts = [T.any_of([(a[slot] == k, F.array(*(F.lit(t) for t in v))) for k, v in table.items()], _none()) for slot, table in A.CLITICS.items()]
    made = F.flatten(F.array(*parts))
    return F.filter(made, critical) if critical_only else made


def enclitic(a: Column) -> Column:
    tag = F.substring_index(a["enc0"], "_", 1)
    return F.when(tag.isin(A.PERSONS), _one(F.concat(F.lit("FEAT:pron:"), tag))).otherwise(_none())


def person(a: Column) -> Column:
    """Person, gender and number as one tag; null where they don't make one."""
    per, gen, num = a["per"], F.when(a["gen"] == "u", "m").otherwise(a["gen"]), F.when(a["num"] == "u", "s").otherwise(a["num"])
    second = per.isin("2", "3")
    return (
        F.when((per == "1") & num.isin("s", "p"), F.concat(per, num)).when(second & (num == "d"), F.concat(per, F.lit("d")))
        .when(second & (num == "p") & (gen == "na"), F.concat(per, F.lit("p"))).when(second & num.isin("s", "p") & gen.isin("m", "f"), F.concat(per, gen, num))
    )


def canonical_root(root: Column) -> Column:
    return F.translate(root, "#", "و")


def root_closure(roots: DataFrame) -> DataFrame:
    """(root, field, prio): each root as written and with one or two weak letters as #; the first field of a spelling counts.

    Made once and joined by equality, in place of trying substitutions word by word.
    """
    letters = F.split("root", "\\.")
    weak = [*A.WEAK, "أ", "إ", "آ", "ئ", "ؤ"]
    places = F.filter(F.sequence(F.lit(0), F.size(letters) - 1), lambda i: F.get(letters, i).isin(weak))

    def masked(hidden: Column) -> Column:
        return F.array_join(F.transform(letters, lambda x, i: F.when(F.array_contains(hidden, i), F.lit("#")).otherwise(x)), ".")

    one = F.transform(places, lambda i: F.struct(F.lit(1).alias("prio"), masked(F.array(i)).alias("root")))
    two = F.flatten(F.transform(places, lambda i: F.transform(F.filter(places, lambda j: j > i), lambda j: F.struct(F.lit(2).alias("prio"), masked(F.array(i, j)).alias("root")))))
    own = F.array(F.struct(F.lit(0).alias("prio"), F.col("root")))
    each = roots.select("field", F.explode(F.concat(own, one, two)).alias("x")).select("x.root", "x.prio", "field")
    return each.groupBy("root").agg(F.min_by("field", F.struct("prio", "field")).alias("field"))


def root_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(A.ROOTS.items()), "root string, field string")


def word_tokens(words: DataFrame, analyses: DataFrame, roots: DataFrame, *, atomic: bool = True, root_pattern: bool = False, critical_only: bool = True, lexicon: Lexicon | None = None) -> DataFrame:
    """(word, tokens) for distinct clean words: fixed words first, then clitics, core, features and enclitic."""
    lex = lexicon or Lexicon()
    joined = words.select("word").distinct().join(analyses, "word", "left").withColumn("analyses", F.coalesce("analyses", F.array().cast(analyses.schema["analyses"].dataType)))
    picked = joined.withColumn("a", best(F.col("analyses"))).withColumn("lost", rootless(F.col("analyses"))).drop("analyses")
    closure = root_closure(roots).withColumnsRenamed({"root": "_root", "field": "_field"})
    picked = picked.join(shared.broadcastable(closure), F.col("a.root") == F.col("_root"), "left")
    w, a, r, field = F.col("word"), F.col("a"), F.col("a.root"), F.col("_field")
    own_role, shape = role(a, lex), pattern(a)
    has_root = F.coalesce(r, F.lit("")) != ""
    raw = _one(F.concat(F.lit("ROOT:"), canonical_root(r)))
    if root_pattern:
        core = F.when(has_root, F.concat(raw, F.when(shape != "", _one(F.concat(F.lit("PAT:"), shape))).otherwise(_none()), F.when(own_role.isNotNull() & F.lit(atomic), _one(F.concat(F.lit("ROLE:"), own_role))).otherwise(_none())))
    else:
        both = F.array(F.concat(F.lit("ROOT:"), field), F.concat(F.lit("ROLE:"), own_role)) if atomic else _one(F.concat(F.lit("CMP:"), field, F.lit(":"), own_role))
        core = F.when(field.isNotNull() & own_role.isNotNull(), both).when(field.isNotNull(), _one(F.concat(F.lit("ROOT:"), field))).when(has_root, raw)
    tag = person(a)
    verb = F.concat(
        F.when(a["asp"].isin("p", "i", "c"), _one(F.concat(F.lit("FEAT:asp:"), a["asp"]))).otherwise(_none()), F.when(tag.isNotNull(), _one(F.concat(F.lit("FEAT:"), tag))).otherwise(_none())
    )
    noun = _none()
    if not critical_only:
        number = F.when(a["num"].isin("p", "d"), _one(F.concat(F.lit("FEAT:"), a["num"]))).otherwise(_none())
        noun = F.concat(F.when(a["gen"] == "f", _one("FEAT:f")).otherwise(_none()), number)
    features = F.concat(F.when(a["pos"] == "verb", verb).otherwise(noun), enclitic(a))
    full = F.when(a["pos"] == "noun_prop", F.concat(clitics(a, critical_only), _one(F.concat(F.lit("NE:"), w)))).otherwise(
        F.concat(clitics(a, critical_only), F.coalesce(F.concat(core, features), _one(F.concat(F.lit("LIT:"), w))))
    )
    ma = F.when(a["pos"] == "part_neg", "STR:neg:general").when(a["pos"].isin("pron_rel", "adv_rel"), "REL:which").otherwise("REL:what")
    made = T.any_of(
        [
            (w.isin(list(lex.marks)), _none()),
            (w.isin(list(lex.months)), _one(F.concat(F.lit("TIME:month:"), T.hashed(lex.months)(w)))),
            (w == "ما", _one(ma)),
            (w.isin(list(lex.relations)), _one(T.hashed(lex.relations)(w))),
            (w.isin(lex.literals), _one(F.concat(F.lit("LIT:"), w))),
            (w.isin(lex.numerals), _one("ROOT:size")),
            (a.isNull() & F.col("lost"), _one(F.concat(F.lit("FOREIGN:"), w))),
            (a.isNull(), _one(F.concat(F.lit("LIT:"), w))),
        ],
        full,
    )
    return picked.select("word", made.alias("tokens"))


def tokenize(sents: DataFrame, analyses: DataFrame, roots: DataFrame | None = None, *, space: bool = False, lexicon: Lexicon | None = None, **modes) -> DataFrame:
    """(id, tokens, words, word_token_counts, prefix_count) of sentences (id, text); 2 + prefix_count + the counts is the length.

    The distinct words are looked up once, and each sentence's words in what was found: ids are only carried, so they may be
    shared or null. A null text is an empty sentence.
    """
    lex = lexicon or Lexicon()
    if roots is None:
        roots = root_table(sents.sparkSession) if lex.roots is None else lex.roots
    raw = split(F.coalesce("text", F.lit("")))
    each = sents.select("id", marks(F.coalesce("text", F.lit("")), lex).alias("marks"), raw.alias("raw"), F.transform(raw, T.strip_arabic).alias("bare"))

    def number(x: Column) -> Column:
        return T.number_class(x)

    def latin(x: Column) -> Column:
        return x.rlike("^[A-Za-z]")

    # numerals with a mark behind them are no numerals: they are looked up like words
    wanted = each.select(F.explode(F.arrays_zip("raw", "bare")).alias("x")).select("x.raw", F.col("x.bare").alias("word"))
    wanted = wanted.filter(number(F.col("raw")).isNull() & ~latin(F.col("raw")) & (F.length("word") >= 2)).select("word").distinct()
    table = shared.stored(word_tokens(wanted, analyses, roots, lexicon=lex, **modes))
    found = codec.mapped(each, "bare", table, "known", missing=[])

    def tokens(x: Column, i: Column) -> Column:
        own = F.when(number(x).isNotNull(), _one(number(x))).when(latin(x), _one(F.concat(F.lit("FOREIGN:"), F.lower(x)))).when(F.length(F.get("bare", i)) < 2, _none()).otherwise(F.get("known", i))
        return F.when(F.size(own) > 0, F.concat(own, _one("SPACE"))).otherwise(own) if space else own

    def shown(x: Column, i: Column) -> Column:
        return F.when(number(x).isNotNull() | latin(x) | (F.length(F.get("bare", i)) < 2), x).otherwise(F.get("bare", i))

    parts = found.select("id", "marks", F.transform("raw", tokens).alias("parts"), F.transform("raw", shown).alias("words"))
    return parts.select(
        "id", F.concat(_one("[BOS]"), F.col("marks"), F.flatten("parts"), _one("[EOS]")).alias("tokens"), "words",
        F.transform("parts", lambda x: F.size(x)).alias("word_token_counts"), F.size("marks").alias("prefix_count"),
    )


def _stems(words: DataFrame) -> DataFrame:
    """(word, prio, stem) of distinct words: each as it is (0), and without each proclitic that fits (its place from 1)."""
    tries = F.array(F.struct(F.lit(0).alias("prio"), F.col("word").alias("stem")), *(F.struct(F.lit(i + 1).alias("prio"), F.when(F.col("word").startswith(p) & (F.length("word") > len(p) + 1), F.substr("word", F.lit(len(p) + 1))).alias("stem")) for i, p in enumerate(A.PROCLITICS)))
    return words.select("word").distinct().select("word", F.explode(tries).alias("t")).select("word", "t.prio", "t.stem").filter("stem is not null")


def root_outcomes(words: DataFrame, analyses: DataFrame, roots: DataFrame) -> DataFrame:
    """(word, n, outcome) of words (word, n): function, root_field, root_no_field or no_root.

    A field may be that of any reading's root, and of any reading of what is left without a proclitic that fits; a root
    without a field is one of the word itself.
    """
    read = _stems(words).join(analyses.withColumnRenamed("word", "stem"), "stem").select("word", "prio", F.explode("analyses").alias("a"))
    real = read.select("word", "prio", F.col("a.root").alias("root")).filter((F.coalesce("root", F.lit("")) != "") & ~F.col("root").isin(A.NO_ROOTS))
    named = real.join(shared.broadcastable(root_closure(roots)), "root", "left")
    found = named.groupBy("word").agg(F.bool_or(F.col("field").isNotNull()).alias("fits"), F.bool_or(F.col("prio") == 0).alias("rooted"))
    outcome = F.when(F.col("word").isin(A.FUNCTION_WORDS), "function").when(F.col("fits"), "root_field").when(F.col("rooted"), "root_no_field").otherwise("no_root")
    return words.join(found, "word", "left").select("word", "n", outcome.alias("outcome"))


def legacy_tokens(words: DataFrame, analyses: DataFrame, roots: DataFrame, lexicon: Lexicon | None = None) -> DataFrame:
    """(word, token) of the older scheme: FUNC, ROOT or SURF, with a second try without the first proclitic that fits."""
    found = _stems(words).join(analyses.withColumnRenamed("word", "stem"), "stem").withColumn("a", best(F.col("analyses")))
    named = found.join(shared.broadcastable(root_closure(roots).withColumnsRenamed({"root": "_root", "field": "_field"})), F.col("a.root") == F.col("_root"))
    first = named.groupBy("word").agg(F.min_by("_field", "prio").alias("field"))
    lex = lexicon or Lexicon()
    function = F.col("word").isin([*lex.relations, *lex.marks, *lex.literals])
    return words.select("word").distinct().join(first, "word", "left").select(
        "word", F.when(function, F.concat(F.lit("FUNC:"), "word")).when(F.col("field").isNotNull(), F.concat(F.lit("ROOT:"), "field")).otherwise(F.concat(F.lit("SURF:"), "word")).alias("token")
    )


def dotted_root(arabic: Column) -> Column:
    """The three or four letters of a root with dots between them, without vowel marks; null for other numbers of letters."""
    bare = F.regexp_replace(arabic, r"[\u064B-\u0652\u0670\s]", "")
    letters = F.regexp_extract_all(bare, F.lit(r"[\u0600-\u06FF]"), F.lit(0))
    return F.when(F.size(letters).between(3, 4), F.array_join(letters, "."))


def _either(words: list[str]) -> str:
    """A regular expression of any of the words, by their first letters."""
    by: dict[str, list[str]] = {}
    for w in words:
        by.setdefault(w[:1], []).append(w[1:])
    return "|".join(f"{first}(?:{'|'.join(rest)})" for first, rest in by.items())


def gloss_fields(entries: DataFrame, lemmas: dict[str, str]) -> DataFrame:
    """entries (arabic, domain, covers, semantic_field, keywords) with root, their dotted root, and field.

    The field is the first one, in the order of the list, whose name stands in the gloss; else that of the gloss's first
    word in lemmas; else that of the domain; else null. Of the keywords the first six count, but for those with Arabic letters.
    """
    keywords = F.filter(F.slice("keywords", 1, 6), lambda k: ~k.rlike(r"[\u0600-\u06FF]"))
    made = entries.withColumn("_text", F.lower(F.concat_ws(" ", F.coalesce("covers", F.lit("")), F.coalesce("semantic_field", F.lit("")), F.coalesce(keywords, F.array().cast("array<string>")))))
    # only what is sought is taken out of a gloss, which may be a whole document; a half of a surrogate pair borders nothing
    made = made.withColumn("_names", F.regexp_extract_all("_text", F.lit(rf"(?:^|[^\p{{L}}\p{{N}}_\p{{Cs}}])({_either(A.GLOSS_FIELDS)})(?![\p{{L}}\p{{N}}_])"), F.lit(1)))
    # no lambda: what a lambda names only once is put into it as a whole, and the gloss would be searched again for each field
    named = F.get(F.array_intersect(F.array(*map(F.lit, A.GLOSS_FIELDS)), "_names"), F.lit(0))
    find, spelled = T.hashed(lemmas), [w for w in lemmas if re.fullmatch("[a-z]+", w) and lemmas[w] is not None]
    if len(spelled) <= 1_000:
        known = find(F.regexp_extract("_text", f"(?<![a-z])({_either(spelled)})(?![a-z])", 1)) if spelled else F.lit(None).cast("string")
    else:  # too many for one expression
        known = F.get(F.filter(F.transform(F.regexp_extract_all("_text", F.lit("[a-z]+"), F.lit(0)), lambda t: find(t)), lambda x: x.isNotNull()), F.lit(0))
    domain = F.try_element_at(F.create_map(*(F.lit(x) for kv in A.DOMAIN_FIELDS.items() for x in kv)), F.col("domain"))
    return made.withColumns({"root": dotted_root(F.col("arabic")), "field": F.coalesce(named, known, domain)}).drop("_text", "_names")
