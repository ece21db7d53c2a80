"""Sentences, words, ranks and dictionaries."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tokenloom import lexicon as L
from tokenloom.functions import text as T
from tokenloom.functions import tokens as K
from tokenloom.operators import codec, shared

_DIGITS = re.compile("[0-9]+")
_SKIPPED = "^(?:[.,!?;:'\"()\\-–—…/]*|" + "|".join(L.FRAGMENTS) + ")$"


def table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


@dataclass
class Lexicon:
    """What the English tokenizer knows. Closed tables are Python values, larger ones DataFrames; None takes the small own one.

    lemmas (word, lemma), fields (spelling, field) and entities (word, lower-cased) may be of any size.
    """

    relations: dict[str, str] = field(default_factory=lambda: L.RELATIONS)
    functions: list[str] = field(default_factory=lambda: L.FUNCTION_WORDS)
    overrides: dict[str, str] = field(default_factory=lambda: L.ROLE_OVERRIDES)
    prefixes: list[tuple[str, str]] = field(default_factory=lambda: L.PREFIXES)
    suffixes: list[tuple[str, str]] = field(default_factory=lambda: L.SUFFIXES)
    lemmas: DataFrame | None = None
    fields: DataFrame | None = None
    entities: DataFrame | None = None


def sentences(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, pos, sent): no shuffle, only the columns needed are read."""
    return docs.select("doc_id", "lang", "source", F.posexplode(T.sentences(F.col("text"), F.col("lang"))).alias("pos", "sent"))


def words(sents: DataFrame) -> DataFrame:
    """(doc_id, lang, pos, i, word): the words of each normalised sentence that are not skipped."""
    split = sents.select("doc_id", "lang", "pos", F.posexplode(T.words(T.normalize(F.col("sent")))).alias("i", "word"))
    return split.filter(~T.skipped(F.col("word")))


def distinct_words(sents: DataFrame) -> DataFrame:
    """(word) of each distinct word that is not skipped. Whatever is asked of them is asked once a word: through a generator,
    as a filter on what is worked out from a word would else be worked into the scan, for every token."""
    split = sents.select(F.explode(T.words(T.normalize(F.col("sent")))).alias("word")).distinct()
    return split.select(F.explode(F.array("word")).alias("word")).filter(~T.skipped(F.col("word")))


def by_frequency(counts: DataFrame, name: str = "rank") -> DataFrame:
    """counts (token, n) ranked by n descending, then token."""
    return shared.ranked(counts, [-F.col("n"), F.col("token")], name)


def lemma_table(spark: SparkSession) -> DataFrame:
    return table(spark, list(L.LEMMAS.items()), "word string, lemma string")


def field_table(spark: SparkSession) -> DataFrame:
    return table(spark, list(L.FIELDS.items()), "spelling string, field string")


def entity_table(spark: SparkSession) -> DataFrame:
    return table(spark, [(w,) for w in L.ENTITIES], "word string")


def _joined(df: DataFrame, key: str, table_: DataFrame | None, own: dict, value: str) -> DataFrame:
    """df with `value` of its key column: from a literal where the table (key, value) is small, else by a join."""
    if table_ is not None:
        rows = shared.few(table_)
        if rows is None:
            return df.join(table_.toDF(key, value), key, "left")
        own = {r[0]: r[1] for r in rows}
    return df.withColumn(value, T.hashed(own)(F.col(key)))


def lemmas(distinct: DataFrame, lexicon: Lexicon | None = None) -> DataFrame:
    """(word, lemma) for each distinct word: analyse without the rest, which costs far more."""
    lex = lexicon or Lexicon()
    own = _joined(distinct, "word", lex.lemmas, L.LEMMAS, "lemma")
    return own.select("word", F.coalesce("lemma", T.default_lemma(F.col("word"))).alias("lemma"))


def analyse(distinct: DataFrame, lexicon: Lexicon | None = None) -> DataFrame:
    """(word, lemma, root, role, field, entity) for each distinct word: look-ups run once a word, not once a token.

    Small tables are literals, so that nothing is shuffled; larger ones are joined.
    """
    lex = lexicon or Lexicon()
    entities = None if lex.entities is None else lex.entities.select("word", F.lit("x").alias("entity")).distinct()
    own = _joined(distinct, "word", lex.lemmas, L.LEMMAS, "lemma")
    own = _joined(own, "word", entities, {w: "x" for w in L.ENTITIES}, "entity")
    rows = list(L.FIELDS.items()) if lex.fields is None else shared.few(lex.fields.select("spelling", "field"))
    find = T.hashed({r[0]: r[1] for r in rows}) if rows is not None else lambda x: F.lit(None).cast("string")
    w = F.col("word")

    def parts(lemma: Column, affixes: Column) -> Column:
        def whole(root: Column) -> Column:
            return F.struct(lemma.alias("lemma"), root.alias("root"), F.coalesce(affixes["p"]["role"], affixes["s"]["role"]).alias("role"), T.resolve_field(root, lemma, find).alias("field"))

        return T.let(T.root_of(w, lemma, affixes["p"], affixes["s"]), whole)

    def affixed(lemma: Column) -> Column:
        return T.let(F.struct(T.prefix_role(w, lex.prefixes).alias("p"), T.suffix_role(w, lemma, lex.suffixes).alias("s")), lambda affixes: parts(lemma, affixes))

    made = own.select("word", F.col("entity").isNotNull().alias("entity"), T.let(F.coalesce("lemma", T.default_lemma(w)), affixed).alias("x")).select("word", "entity", "x.*")
    if rows is not None:
        return made
    spelled = made.select("word", F.posexplode(T.field_candidates(F.col("root"), F.col("lemma"))).alias("prio", "spelling")).filter("spelling is not null")
    found = spelled.join(lex.fields, "spelling").groupBy("word").agg(F.min_by(lex.fields["field"], "prio").alias("field"))
    return made.drop("field").join(found, "word", "left")


def emit(analysed: DataFrame, *, atomic: bool = False, lexicon: Lexicon | None = None) -> DataFrame:
    """analysed with type, tokens (array<string>) and confidence by the cascade of the emitter: names come first."""
    lex = lexicon or Lexicon()
    w, role, found, entity = F.col("word"), F.col("role"), F.col("field"), F.col("entity")
    if atomic:
        own = T.hashed(lex.overrides)
        role = F.coalesce(own(F.col("lemma")), own(w), role)
    relation = T.hashed(lex.relations)(w)
    number, function = w.rlike("^[0-9]+$"), w.isin(lex.functions)
    composed = F.array(F.concat(F.lit("ROOT:"), found), F.concat(F.lit("ROLE:"), role)) if atomic else F.array(F.concat(F.lit("CMP:"), found, F.lit(":"), role))
    literal = F.array(F.concat(F.lit("LIT:"), w))

    def cascade(name, num, rel, fun, cmp_, root, rest):
        return F.when(entity, name).when(number, num).when(relation.isNotNull(), rel).when(function, fun).when(found.isNotNull() & role.isNotNull(), cmp_).when(found.isNotNull(), root).otherwise(rest)

    lit = F.lit
    return analysed.withColumns(
        {
            "type": cascade(lit("LIT"), lit("ROOT"), lit("REL"), lit("LIT"), lit("ROOT" if atomic else "CMP"), lit("ROOT"), lit("LIT")),
            "tokens": cascade(literal, F.array(lit("ROOT:size")), F.array(relation), literal, composed, F.array(F.concat(lit("ROOT:"), found)), literal),
            "confidence": cascade(lit(1.0), lit(0.9), lit(1.0), lit(0.9), lit(0.9), lit(0.8), lit(0.5)),
        }
    )


def _own_tokens(w: Column) -> Column:
    """What a word gives that no table knows: a number's size or itself."""
    return F.when(w.rlike("^[0-9]+$"), F.array(F.lit("ROOT:size"))).otherwise(F.array(F.concat(F.lit("LIT:"), w)))


def _possible(word: Column, lexicon: Lexicon) -> Column:
    """Whether the lexicon may know a word; of others the whole analysis, some 70 expressions deep, finds nothing.

    It may by name, as a relation, by a lemma of its table, or if it has a field. The spellings that are looked up for one
    are parts of the word, some with an e behind them or with the y of a plural in -ies (or both); what is left of a word
    without an ending has three letters, so that shorter parts are the word itself.
    """
    listed = {*lexicon.relations, *L.LEMMAS, *L.ENTITIES}
    stems: dict[str, set[str]] = {}
    for x in L.FIELDS:
        parts = {x} | ({x[:-1]} if x.endswith("e") else set())
        listed |= {p for p in parts if len(p) < 3}
        plurals = {x.removesuffix("e")[:-1] + "ies"} if x.removesuffix("e").endswith("y") else set()
        for stem in {p for p in parts if len(p) >= 3} | plurals:
            stems.setdefault(stem[0], set()).add(re.escape(stem[1:]))
    # by first letter, so that a place is tried once for each letter and not for each field
    spelled = "|".join(f"{re.escape(a)}(?:{'|'.join(sorted(rest))})" for a, rest in sorted(stems.items()))
    return word.isin(sorted(listed)) | word.rlike(spelled)


def known_words(distinct: DataFrame, *, atomic: bool = False, lexicon: Lexicon | None = None) -> DataFrame:
    """(word, tokens) of the distinct words whose tokens are not their own: the lexicon bounds how many there can be.

    With the own tables only words that they may know are analysed; given ones are not looked into for that.
    """
    lex = lexicon or Lexicon()
    if lex.lemmas is None and lex.fields is None and lex.entities is None:
        # through a generator, else the filter would be worked into the scan, for every token
        distinct = distinct.select(F.explode(F.array("word")).alias("word")).filter(_possible(F.col("word"), lex))
    return _known(emit(analyse(distinct, lexicon), atomic=atomic, lexicon=lexicon))


def _known(made: DataFrame) -> DataFrame:
    # through a generator: a filter would be worked into all that stands below
    each = made.select(F.explode(F.array(F.struct("word", "tokens"))).alias("x")).select("x.word", "x.tokens")
    return each.filter(F.array_join("tokens", " ") != F.array_join(_own_tokens(F.col("word")), " "))


def _own_tokens_of(word: str) -> list[str]:
    """The same for one word."""
    return ["ROOT:size"] if _DIGITS.fullmatch(word) else ["LIT:" + word]


def pieces(norm: DataFrame) -> DataFrame:
    """(word) of each distinct word in norm that is not skipped: skipped ones are told once each, not once a token."""
    split = norm.select(F.explode(F.split("norm", T.BREAKS)).alias("word")).distinct()
    return split.select(F.explode(F.array("word")).alias("word")).filter((F.col("word") != "") & ~T.skipped(F.col("word")))


def _own_of_pieces(number: str, word: Callable[[pa.Array], pa.Array | str]) -> codec.AtOnce:
    """What stands between two breaks and no table knows gives one token, or none where words are skipped."""

    def of(pieces: pa.Array) -> pa.Array:
        kept = pc.invert(pc.match_substring_regex(pieces, _SKIPPED))
        own = pc.if_else(pc.match_substring_regex(pieces, "^[0-9]+$"), number, word(pieces)).filter(kept)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(kept)]), pa.int32()), own)

    return codec.AtOnce(of)


_OWN_TOKENS = _own_of_pieces("ROOT:size", lambda x: pc.binary_join_element_wise("LIT:", x, ""))
_OWN_LOGIC = _own_of_pieces(L.FIELD_CONCEPTS["size"], lambda x: pa.array(["[UNK]"]).take(pa.array(np.zeros(len(x), np.int64))))


def _parts(norm: DataFrame, atomic: bool, lexicon: Lexicon | None) -> DataFrame:
    """norm (with normalised sentences in norm) with words, marks and parts (the tokens of each word) in its place.

    The distinct words are analysed once, and the sentences' words are looked up in what the lexicon knows of them.
    """
    rest = [c for c in norm.columns if c != "norm"]
    own = F.filter(T.words(F.col("norm")), lambda w: ~T.skipped(w))
    # stored, so that texts are normalised and split once for the distinct words and for the sentences
    split = shared.stored(norm.select(*rest, T.structure(F.col("norm")).alias("marks"), own.alias("words")))
    known = shared.stored(known_words(split.select(F.explode("words").alias("word")).distinct(), atomic=atomic, lexicon=lexicon))
    return codec.mapped(split, "words", known, "parts", missing=_own_tokens_of)


def looked_up(norm: DataFrame, atomic: bool, lexicon: Lexicon | None) -> DataFrame:
    """norm, stored as it is read for the distinct words and for the sentences, with parts: the tokens of each piece between breaks."""
    known = shared.stored(known_words(pieces(norm), atomic=atomic, lexicon=lexicon))
    return codec.mapped(norm, "norm", known, "parts", missing=_OWN_TOKENS, split=T.BREAKS)


def _tokenized(norm: DataFrame, atomic: bool, lexicon: Lexicon | None) -> DataFrame:
    """norm with tokens in the place of norm: sentence marks, then the tokens of the words in order."""
    rest = [c for c in norm.columns if c != "norm"]
    made = looked_up(shared.stored(norm), atomic, lexicon)
    return made.select(*rest, F.concat(T.structure(F.col("norm")), F.flatten("parts")).alias("tokens"))


def _known_logic(norm: DataFrame, atomic: bool, lexicon: Lexicon | None) -> DataFrame:
    """(word, tokens) with logic tokens of the words that the lexicon knows: worked out once a word, not once a token."""
    known = shared.stored(known_words(pieces(norm), atomic=atomic, lexicon=lexicon))
    return known.select("word", K.logic_parts(F.col("tokens")).alias("tokens"))


def logic_sentences(docs: DataFrame, *, atomic: bool = False, lexicon: Lexicon | None = None) -> DataFrame:
    """(doc_id, pos, tokens): the logic tokens of the documents' sentences, equal neighbours not yet collapsed."""
    norm = shared.stored(sentences(docs).select("doc_id", "pos", T.normalize(F.col("sent")).alias("norm")))
    made = codec.mapped(norm, "norm", _known_logic(norm, atomic, lexicon), "parts", missing=_OWN_LOGIC, split=T.BREAKS)
    return made.select("doc_id", "pos", F.concat(K.logic_parts(T.structure(F.col("norm"))), F.flatten("parts")).alias("tokens"))


#: The logic tokens of sentence marks in their order, with the pattern that finds the mark; others give none.
_MARKS = [
    (L.LOGIC_TOKENS[mark], pattern)
    for mark, pattern in [
        ("STR:question", r"\?$"), *((name, "(^|[^A-Za-z0-9_])(" + "|".join(words_) + ")([^A-Za-z0-9_]|$)") for name, words_ in L.STRUCTURE_WORDS.items()),
    ]
]


def _count_logic(batch):
    """(token, n) of the logic tokens of a batch of sentences (norm, parts), collapsed: marks, then those of the words."""
    parts = batch.column("parts")
    if isinstance(parts, pa.ChunkedArray):
        parts = pa.concat_arrays(parts.chunks) if parts.num_chunks else pa.array([], parts.type)
    each = parts.flatten()
    flat = each.flatten().dictionary_encode()
    tokens = flat.dictionary.to_pylist()
    tokens += sorted({t for t, _ in _MARKS} - set(tokens))
    codes = flat.indices.to_numpy()
    collapses = np.isin(tokens, L.LOGIC_COLLAPSE)
    # where each sentence's tokens start and end: ends of words, at the ends of sentences
    words_ = np.concatenate([[0], np.cumsum(parts.value_lengths().to_numpy(zero_copy_only=False))])
    ends = np.concatenate([[0], np.cumsum(each.value_lengths().to_numpy(zero_copy_only=False))])[words_]
    filled = ends[:-1] < ends[1:]
    first = ends[:-1][filled]
    counts, last = np.zeros(len(tokens), np.int64), np.full(len(filled), -1)
    for token, pattern in _MARKS:
        code = tokens.index(token)
        there = np.asarray(pc.match_substring_regex(batch.column("norm"), pattern))
        counts[code] += np.count_nonzero(there & ~((last == code) & collapses[code]))
        last = np.where(there, code, last)
    again = np.zeros(len(codes), bool)
    again[1:] = codes[1:] == codes[:-1]
    again[first] = codes[first] == last[filled]  # a sentence's first token meets its last mark
    counts += np.bincount(codes[~(again & collapses[codes])], minlength=len(tokens))
    return type(batch).from_arrays([pa.array(tokens, pa.string()), pa.array(counts)], ["token", "n"])


def logic_counts(docs: DataFrame, *, atomic: bool = False, lexicon: Lexicon | None = None) -> DataFrame:
    """(token, n) of the logic tokens of the documents' sentences after equal neighbours collapse.

    Tokens are counted where their words are looked up: of a sentence only its text comes to the task, and only counts leave it.
    """
    norm = shared.stored(sentences(docs).select(T.normalize(F.col("sent")).alias("norm")))
    made = StructType([StructField("token", StringType()), StructField("n", LongType())])
    each = codec.mapped(norm, "norm", _known_logic(norm, atomic, lexicon), "parts", missing=_OWN_LOGIC, split=T.BREAKS, then=(_count_logic, made))
    return each.groupBy("token").agg(F.sum("n").alias("n")).filter("n > 0")


def tokenize_english(docs: DataFrame, *, atomic: bool = False, lexicon: Lexicon | None = None) -> DataFrame:
    """(doc_id, lang, pos, tokens) of the documents' sentences."""
    return _tokenized(sentences(docs).select("doc_id", "lang", "pos", T.normalize(F.col("sent")).alias("norm")), atomic, lexicon)


def tokenize_both(docs: DataFrame, *, lexicon: Lexicon | None = None) -> DataFrame:
    """(doc_id, lang, pos, fused, atomic): both forms of the documents' sentences, which are read and split once.

    What a word gives in the atomic form is worked out from the fused one's table beside it.
    """
    norm = sentences(docs).select("doc_id", "lang", "pos", T.normalize(F.col("sent")).alias("norm"))
    own = F.filter(T.words(F.col("norm")), lambda w: ~T.skipped(w))
    made = shared.stored(norm.select("doc_id", "lang", "pos", T.structure(F.col("norm")).alias("marks"), own.alias("words")))
    distinct = shared.stored(analyse(made.select(F.explode("words").alias("word")).distinct(), lexicon))
    for name, atomic in (("fused", False), ("atomic", True)):
        known = shared.stored(_known(emit(distinct, atomic=atomic, lexicon=lexicon)))
        made = codec.mapped(made, "words", known, name, missing=_own_tokens_of)
    return made.select("doc_id", "lang", "pos", *(F.concat("marks", F.flatten(n)).alias(n) for n in ("fused", "atomic")))


def tokenize_texts(df: DataFrame, *, atomic: bool = False, lexicon: Lexicon | None = None) -> DataFrame:
    """(id, tokens) of sentences (id, text), a row for each; ids may be shared."""
    return _tokenized(df.select("id", T.normalize(F.coalesce("text", F.lit(""))).alias("norm")), atomic, lexicon)


def aligned(docs: DataFrame, *, atomic: bool = False, lexicon: Lexicon | None = None) -> DataFrame:
    """(doc_id, lang, pos, tokens, words, counts, n_marks): tokens are n_marks marks and then counts[i] tokens of words[i]."""
    made = _parts(sentences(docs).select("doc_id", "lang", "pos", T.normalize(F.col("sent")).alias("norm")), atomic, lexicon)
    counts = F.transform("parts", lambda x: F.size(x)).alias("counts")
    return made.select("doc_id", "lang", "pos", F.concat("marks", F.flatten("parts")).alias("tokens"), "words", counts, F.size("marks").alias("n_marks"))


def token_weights(docs: DataFrame, *, keys: list[str] | None = None, atomic: bool = False, lexicon: Lexicon | None = None) -> DataFrame:
    """(keys, token, n) over all tokens of docs, where their order doesn't count.

    Words are counted first, each distinct word is analysed once, and its tokens have its count: tokens are never shuffled.
    """
    keys = keys or []
    norm = sentences(docs).select(*keys, T.normalize(F.col("sent")).alias("norm"))
    # words and sentence marks in one pass, told apart by their first letter
    found = F.concat(F.transform(T.words(F.col("norm")), lambda w: F.concat(F.lit("w"), w)), F.transform(T.structure(F.col("norm")), lambda m: F.concat(F.lit("m"), m)))
    each = norm.select(*keys, F.explode(found).alias("x")).select(*keys, F.col("x").startswith("m").alias("mark"), F.substr("x", F.lit(2)).alias("word"))
    counted = shared.stored(each.filter(F.col("mark") | ~T.skipped(F.col("word"))).groupBy(*keys, "mark", "word").agg(F.count("*").alias("n")))
    words_ = counted.filter(~F.col("mark")).drop("mark")
    known = shared.stored(known_words(words_.select("word").distinct(), atomic=atomic, lexicon=lexicon))
    tokens = words_.join(known, "word", "left").select(*keys, F.explode(F.coalesce("tokens", _own_tokens(F.col("word")))).alias("token"), "n")
    marks = counted.filter("mark").select(*keys, F.col("word").alias("token"), "n")
    return tokens.unionByName(marks).groupBy(*keys, "token").agg(F.sum("n").alias("n"))


def token_counts(tokens: DataFrame) -> DataFrame:
    """(token, n) over an array column named tokens."""
    return tokens.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def with_ids(df: DataFrame, vocab: DataFrame, *, unknown: int = 1) -> DataFrame:
    """df with ids of its tokens in vocab (token, id) of any size; unknown ones get `unknown`, null arrays stay null."""
    return codec.mapped(df, "tokens", vocab.select("token", F.col("id").cast("int").alias("id")), "ids", missing=unknown)


def encode(df: DataFrame, vocab: DataFrame, keys: list[str], *, unknown: int = 1) -> DataFrame:
    """(keys, ids): each token's id in vocab (token, id), in order. Keys are only carried: they may be shared or null."""
    return with_ids(df.select(*keys, "tokens"), vocab, unknown=unknown).drop("tokens")


def decode(df: DataFrame, vocab: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, tokens): each id's token in order, [UNK] for what the vocabulary lacks."""
    ids = F.transform("ids", lambda x: x.cast("long")).alias("ids")
    return codec.mapped(df.select(*keys, ids), "ids", vocab.select(F.col("id").cast("long").alias("id"), "token"), "tokens", missing="[UNK]").drop("ids")


def cap_vocabulary(counts: DataFrame, cap: int, *, policy: str = "core", registered: list[str] | None = None) -> DataFrame:
    """(token, id) of at most `cap` tokens, always by count descending and then token, so ties are settled.

    literal: pad and unknown first, all tokens but LIT:, then the most frequent LIT:. surface: the same with SURF:.
    structural: the five specials, structural tokens by name, then literals by count. core: the registered tokens in
    their order, other core tokens by name, then the rest by count; a cap below the core is an error.
    """
    spark = counts.sparkSession
    counts = shared.stored(counts)  # read for the core, its size and the rest
    token = F.col("token")
    dynamic_prefix = {"literal": ["LIT:"], "surface": ["SURF:"], "structural": ["LIT:", "FOREIGN:", "NE:"], "core": ["LIT:", "FOREIGN:", "NE:", "SURF:"]}.get(policy)
    if dynamic_prefix is None:
        raise ValueError(f"no policy {policy!r}")
    first = {"literal": ["<PAD>", "<UNK>"], "surface": ["<PAD>", "<UNK>"], "structural": L.SPECIALS, "core": registered or L.SPECIALS}[policy]
    rest = counts.filter(~token.isin(first))
    dynamic = token.substr(1, 0) != ""
    for p in dynamic_prefix:
        dynamic = dynamic | token.startswith(p)
    core = rest.filter(~dynamic)
    n_core = core.count()
    budget = cap - len(first) - n_core
    if budget < 0:
        raise ValueError(f"the cap {cap} is below the {len(first) + n_core} tokens that always stay")
    by_name = policy in ("structural", "core")
    core = shared.ranked(core, [token], "r") if by_name else by_frequency(core, "r")
    head = table(spark, [(t, i) for i, t in enumerate(first)], "token string, id long")
    tail = by_frequency(rest.filter(dynamic), "r").filter(F.col("r") <= budget)
    return (
        head.unionByName(core.select("token", (F.col("r") - 1 + len(first)).alias("id")))
        .unionByName(tail.select("token", (F.col("r") - 1 + len(first) + n_core).alias("id")))
    )


def cap_report(counts: DataFrame, vocab: DataFrame, dynamic: Column) -> DataFrame:
    """One row on a capped vocabulary (token, id): its size, kept and all tokens, the coverage of dynamic ones, and the rate
    of unknown tokens that it will give, all weighted by counts (token, n)."""
    known = counts.join(vocab.select("token", F.lit(True).alias("known")), "token", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    n = F.col("n")

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, n)), F.lit(0))

    every, lost = F.coalesce(F.sum("n"), F.lit(0)), total(~F.col("known"))
    made = known.agg(
        F.count("*").alias("kinds"), F.count_if("known").alias("kinds_kept"), F.count_if(dynamic & F.col("known")).alias("dynamic_kept"), every.alias("tokens"),
        (total(dynamic & F.col("known")) / F.greatest(total(dynamic), F.lit(1))).alias("dynamic_coverage"), (lost / F.greatest(every, F.lit(1))).alias("unknown_rate"),
    )
    return made.join(F.broadcast(vocab.agg(F.count("*").alias("size"))))  # a row each
