"""Parsed tokens: lemmas by their first context, entities of sentences, and tokens by dependency.

A parsed table has a row for each token: the keys of its sentence, its place i, text, lemma, upos, tag, dep, and iob and
label of the entity it is part of (B begins one, I goes on, O is none). It comes from any parser; `rule_parsed` derives one
from the text by a few rules of our own, so that everything here runs without a language model.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from tokenloom import lexicon as L
from tokenloom.functions import text as T
from tokenloom.functions import tokens as K
from tokenloom.operators import corpus, shared

KEYS = ["doc_id", "pos"]

#: Pieces of a sentence: a possessive ending, a run without spaces and marks, or a mark.
PIECE = "'s|[^ \\t\\r\\n.,!?;:'\"()]+|[.,!?;:'\"()]"

#: Forms of auxiliaries with their lemmas, for the rules of our own.
AUXILIARY_FORMS = {"is": "be", "are": "be", "was": "be", "were": "be", "has": "have", "had": "have", "does": "do", "did": "do", **{w: w for w in L.AUXILIARIES}}


def _upos(piece: Column, i: Column) -> Column:
    """No regular expressions: a piece is told by its characters at the ends wherever that is enough."""
    initial = F.substring(piece, 1, 1)

    def of(low: Column) -> Column:
        return T.any_of(
            [
                (piece == "'s", "PART"), (piece.isin(*".,!?;:'\"()"), "PUNCT"), (initial.between("0", "9") & piece.rlike("^[0-9]+\\z"), "NUM"), (low.isin(L.DETERMINERS), "DET"), (low.isin(list(AUXILIARY_FORMS)), "AUX"),
                (low.isin(L.PREPOSITIONS), "ADP"), (low.isin(list(L.CONNECTIVES)), "CCONJ"), (initial.between("A", "Z") & (i > 0), "PROPN"), (low.endswith("ly"), "ADV"), (low.endswith("ed") | low.endswith("ing"), "VERB"),
            ],
            F.lit("NOUN"),
        )

    return T.let(F.lower(piece), of)


#: What the rules give, by number.
UPOS = ["PART", "PUNCT", "NUM", "DET", "AUX", "ADP", "CCONJ", "PROPN", "ADV", "VERB", "NOUN"]
DEPS = ["", "neg", "advmod", "pobj", "nsubj", "dobj"]
IOB = ["O", "B", "I"]

#: Bytes of text whose tokens are in memory at once, and pieces that a task keeps what it knows of.
SLICE, KEPT = 2 << 20, 200_000

_FIELDS = [StructField(n, t) for n, t in (("i", IntegerType()), *((n, StringType()) for n in ("text", "lemma", "upos", "tag", "dep", "iob", "label")))]


def _plain_lemma(low: str) -> str:
    """T.default_lemma of one word."""
    if low.endswith("ies") and len(low) > 4:
        return low[:-3] + "y"
    if low.endswith(("sses", "shes", "ches", "xes")) and len(low) > 4:
        return low[:-2]
    return low[:-1] if low.endswith("s") and not low.endswith(("ss", "us", "is")) and len(low) > 3 else low


def _piece(text: str) -> tuple[int, int, str, str, bool]:
    """Of a piece: its part of speech and lemma inside a sentence and as its first token, and whether it is a `not`."""
    low = text.lower()

    def upos(capital: bool) -> str:
        if text == "'s":
            return "PART"
        if text in ".,!?;:'\"()":
            return "PUNCT"
        if text.isascii() and text.isdigit():
            return "NUM"
        for words, name in ((L.DETERMINERS, "DET"), (AUXILIARY_FORMS, "AUX"), (L.PREPOSITIONS, "ADP"), (L.CONNECTIVES, "CCONJ")):
            if low in words:
                return name
        if capital and "A" <= text[0] <= "Z":
            return "PROPN"
        return "ADV" if low.endswith("ly") else "VERB" if low.endswith(("ed", "ing")) else "NOUN"

    def lemma(upos: str) -> str:
        form = AUXILIARY_FORMS.get(low, low)
        return form if form != low or upos in ("PROPN", "AUX", "PUNCT", "PART") else _plain_lemma(low)

    inside, first = upos(True), upos(False)
    return UPOS.index(inside), UPOS.index(first), lemma(inside), lemma(first), low == "not"


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(first row, rows) of slices of about SLICE bytes; a longer text is one by itself."""
    part = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64) // SLICE
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
    return ((a, b - a) for a, b in zip(cuts, cuts[1:]) if a < b)


class _Tokens:
    """The tokens of some sentences, as numbers in flat arrays: what parsed_sentences gives, for all at once."""

    def __init__(self, texts: list[str | None], known: dict[str, tuple]):
        find, codes, index = re.compile(PIECE).findall, array("i"), _Numbers()
        sizes = np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            if text:
                found = find(text)
                sizes[k] = len(found)
                codes.extend(map(index.__getitem__, found))
        self.pieces = list(index)
        for x in self.pieces:
            if x not in known:
                if len(known) >= KEPT:
                    known.clear()
                known[x] = _piece(x)
        own = [known.get(x) or _piece(x) for x in self.pieces]
        self.codes = codes = np.frombuffer(codes, np.int32) if codes else np.zeros(0, np.int32)
        self.sizes, n = sizes, len(codes)
        self.ends = np.cumsum(sizes)
        starts = self.ends - sizes
        self.sentence = np.repeat(np.arange(len(sizes)), sizes)
        self.i = np.arange(n) - np.repeat(starts, sizes)
        initial = self.i == 0
        self.lemmas, self.lemma = [x[2] for x in own] + [x[3] for x in own], codes + np.where(initial, len(own), 0)
        self.upos = np.array([x[0] for x in own] + [x[1] for x in own], np.int8)[self.lemma]
        noun, name, adposition, determiner, adverb = (UPOS.index(x) for x in ("NOUN", "PROPN", "ADP", "DET", "ADV"))
        before = [np.where(self.i >= k, np.concatenate([np.full(min(k, n), -1, np.int8), self.upos[: max(n - k, 0)]]), -1) for k in (1, 2)]
        nominal = (self.upos == noun) | (self.upos == name)
        at = np.flatnonzero(nominal)
        head = np.zeros(n, bool)
        head[at[np.diff(self.sentence[at], prepend=-1) != 0]] = True
        under = (before[0] == adposition) | ((before[0] == determiner) & (before[1] == adposition))
        dep = np.where(nominal, np.where(under, 3, np.where(head, 4, 5)), np.where(self.upos == adverb, 2, 0))
        self.dep = np.where(np.array([x[4] for x in own], bool)[codes], 1, dep)
        self.iob = np.where(self.upos == name, np.where(before[0] == name, 2, 1), 0)

    def columns(self, at: np.ndarray | None = None) -> list[pa.Array]:
        """The fields of all tokens, or of those at some places."""

        def of(values: list, numbers: np.ndarray) -> pa.Array:
            return pa.array(values, pa.string()).take(pa.array(numbers if at is None else numbers[at]))

        tags = np.array([x == "'s" for x in self.pieces], np.int8)[self.codes]
        i = pa.array(self.i if at is None else self.i[at], pa.int32())
        return [i, of(self.pieces, self.codes), of(self.lemmas, self.lemma), of(UPOS, self.upos), of(["", "POS"], tags), of(DEPS, self.dep), of(IOB, self.iob), of([None, "ORG", "ORG"], self.iob)]

    def named(self) -> np.ndarray:
        """The places of tokens that are part of an entity."""
        return np.flatnonzero(self.iob)

    def firsts(self, order: np.ndarray) -> np.ndarray:
        """The places, ascending, of each piece's first token, where sentences stand in an order (their numbers, first to last)."""
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        of = rank[self.sentence]
        places = np.arange(len(of)) if np.all(np.diff(of) >= 0) else np.argsort(of, kind="stable")
        first = np.zeros(len(self.pieces), np.int64)
        first[self.codes[places[::-1]]] = places[::-1]  # the last one written stays
        return np.sort(first)


class _Seen:
    """Which first tokens of a slice are before those that a task has had of their texts: only they can be first of all."""

    def __init__(self) -> None:
        self.least: dict[str, tuple] = {}

    def firsts(self, tokens: _Tokens, part: pa.RecordBatch) -> np.ndarray:
        at = tokens.firsts(_order(part, KEYS))
        row = pa.array(tokens.sentence[at])
        own = [part.column(k).take(row).to_pylist() for k in KEYS]
        keys = ((*((x is not None, x) for x in key), i) for *key, i in zip(*own, tokens.i[at].tolist()))
        if len(self.least) >= KEPT:
            self.least.clear()
        kept = []
        for place, code, key in zip(at.tolist(), tokens.codes[at].tolist(), keys):
            text = tokens.pieces[code]
            before = self.least.get(text)
            if before is None or key < before:
                self.least[text] = key
                kept.append(place)
        return np.array(kept, np.int64)


class _Numbers(dict):
    """A number for each key, in the order in which they come."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def _order(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """The rows' numbers in the order of their keys, nulls first."""
    table = pa.Table.from_batches([batch.select(keys)])
    return pc.sort_indices(table, sort_keys=[(k, "ascending") for k in keys], null_placement="at_start").to_numpy()


def _by_rules(sents: DataFrame, which: Callable[[_Tokens, pa.RecordBatch, _Seen], np.ndarray | None]) -> DataFrame:
    """The parsed table of sentences, or of it the tokens at the places that `which` gives."""
    shared.importable(sents.sparkSession)
    own = sents.select(*KEYS, "sent")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple] = {}
        seen = _Seen()
        for batch in batches:
            for first, rows in _slices(batch.column("sent")):
                part = batch.slice(first, rows)
                tokens = _Tokens(part.column("sent").to_pylist(), known)
                at = which(tokens, part, seen)
                row = pa.array(tokens.sentence if at is None else tokens.sentence[at])
                yield pa.RecordBatch.from_arrays([*(part.column(k).take(row) for k in KEYS), *tokens.columns(at)], [*KEYS, *(f.name for f in _FIELDS)])

    return own.mapInArrow(run, StructType([*(own.schema[k] for k in KEYS), *_FIELDS]))


def rule_parsed(sents: DataFrame) -> DataFrame:
    """(doc_id, pos, i, text, lemma, upos, tag, dep, iob, label) of sentences (doc_id, pos, sent), made in one pass over each batch.

    What the rules say of a piece by itself is worked out once a piece. The rules are those of parsed_sentences.
    """
    return _by_rules(sents, lambda *_: None)


def rule_entities(sents: DataFrame) -> DataFrame:
    """The rows of rule_parsed that are part of an entity."""
    return _by_rules(sents, lambda tokens, *_: tokens.named())


def rule_contexts(sents: DataFrame) -> DataFrame:
    """The rows of rule_parsed that first_context needs: of each text a token of each task, where no earlier one had come."""
    return _by_rules(sents, lambda tokens, part, seen: seen.firsts(tokens, part))


def parsed_sentences(sents: DataFrame) -> DataFrame:
    """(doc_id, pos, tokens): the same with a sentence's tokens in one array, in order.

    Capitalised words behind the first are names, and runs of them one entity. A noun behind a preposition (and an article)
    is its object, the first other one the subject, all others objects.
    """
    pieces = sents.filter(F.col("sent").rlike("[^ \\t\\r\\n]")).select(*KEYS, F.regexp_extract_all("sent", F.lit(PIECE), F.lit(0)).alias("p"))
    tagged = pieces.withColumn("u", F.transform("p", _upos))
    nominal = F.transform("u", lambda u: u.isin("NOUN", "PROPN"))
    first = F.array_position(nominal, True) - 1

    def before(i: Column, k: int) -> Column:
        return F.when(i >= k, F.get("u", i - k)).otherwise("")

    forms = {k: v for k, v in AUXILIARY_FORMS.items() if k != v}

    def parsed(x: Column, i: Column, first: Column) -> Column:
        # what is used more than once is worked out once
        return T.let(F.struct(F.get("u", i).alias("u"), F.lower(x).alias("low"), before(i, 1).alias("u1")), lambda own: token(x, i, own["u"], own["low"], own["u1"], first))

    def token(x: Column, i: Column, u: Column, low: Column, u1: Column, first: Column) -> Column:
        plain = F.when(u.isin("PROPN", "AUX", "PUNCT", "PART"), low).otherwise(T.default_lemma(low))
        lemma = F.when(low.isin(list(forms)), T.lookup(forms, low, low)).otherwise(plain)
        under = (u1 == "ADP") | ((u1 == "DET") & (before(i, 2) == "ADP"))
        named = F.when(under, "pobj").when(i == first, "nsubj").otherwise("dobj")
        dep = F.when(low == "not", "neg").when(u == "ADV", "advmod").when(u.isin("NOUN", "PROPN"), named).otherwise("")
        name = u == "PROPN"
        return F.struct(
            i.alias("i"), x.alias("text"), lemma.alias("lemma"), u.alias("upos"), F.when(x == "'s", "POS").otherwise("").alias("tag"), dep.alias("dep"),
            F.when(~name, "O").when(u1 == "PROPN", "I").otherwise("B").alias("iob"), F.when(name, "ORG").alias("label"),
        )

    # the first noun by let: as a column that the lambda names once it would be put into it, and sought for each token
    return tagged.select(*KEYS, T.let(first, lambda at: F.transform("p", lambda x, i: parsed(x, i, at))).alias("tokens"))


def first_context(parsed: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """(word, lemma): of each lower-cased word the lemma of its first token, in the order of the sentences and places.

    The winner is for all sentences, whatever later ones say. It is one aggregation that needs no order of the input, and
    its result can be a Lexicon's lemmas.
    """
    low = F.lower("text")
    lemma = F.lower(F.when(F.coalesce("lemma", F.lit("")) == "", F.col("text")).otherwise(F.col("lemma")))
    return parsed.groupBy(low.alias("word")).agg(F.min_by(lemma, F.struct(*keys, "i")).alias("lemma"))


def entity_words(parsed: DataFrame, keys: list[str] = KEYS, labels: list[str] = L.ENTITY_LABELS) -> DataFrame:
    """(keys, entities): the lower-cased words of a sentence that are part of an entity with one of the labels."""
    inside = parsed.filter((F.col("iob") != "O") & F.col("label").isin(labels) & (F.col("text") != ""))
    return inside.groupBy(*keys).agg(F.array_sort(F.collect_set(F.lower("text"))).alias("entities"))


def tokenize(sents: DataFrame, parsed: DataFrame, *, atomic: bool = False, lexicon: corpus.Lexicon | None = None) -> DataFrame:
    """(doc_id, pos, tokens) of sentences (doc_id, pos, sent): lemmas by first context, entities by sentence.

    A word is an entity only in the sentences that say so; there it is a literal. parsed has each sentence's keys once.
    """
    named = sents.join(entity_words(parsed), KEYS, "left").select(*KEYS, "entities", T.normalize(F.col("sent")).alias("norm"))
    return _tokenized(shared.stored(named), first_context(parsed), atomic, lexicon)


def rule_tokenize(sents: DataFrame, *, atomic: bool = False, lexicon: corpus.Lexicon | None = None) -> DataFrame:
    """The same over what the rules give: sentences are parsed once, for their entities and first contexts, and stay in their rows."""
    shared.importable(sents.sparkSession)
    own = sents.select(*KEYS, "sent")
    first = StructType([f for f in _FIELDS if f.name in ("i", "text", "lemma")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple] = {}
        seen = _Seen()
        for batch in batches:
            for start, rows in _slices(batch.column("sent")):
                part = batch.slice(start, rows)
                tokens = _Tokens(part.column("sent").to_pylist(), known)

                def lists(at: np.ndarray, values: pa.Array) -> pa.Array:
                    sizes = np.bincount(tokens.sentence[at], minlength=rows)
                    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values)

                named, firsts = tokens.named(), seen.firsts(tokens, part)
                made = [lists(named, tokens.columns(named)[1]), lists(firsts, pa.StructArray.from_arrays(tokens.columns(firsts)[:3], first.names))]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], [*KEYS, "sent", "entities", "firsts"])

    made = own.mapInArrow(run, StructType([*own.schema.fields, StructField("entities", ArrayType(StringType())), StructField("firsts", ArrayType(first))]))
    made = shared.stored(made.select(*KEYS, F.transform("entities", F.lower).alias("entities"), T.normalize(F.col("sent")).alias("norm"), "firsts"))
    firsts = made.select(*KEYS, F.explode("firsts").alias("x")).select(*KEYS, "x.*")
    return _tokenized(made.drop("firsts"), first_context(firsts), atomic, lexicon)


def _tokenized(norm: DataFrame, cache: DataFrame, atomic: bool, lexicon: corpus.Lexicon | None) -> DataFrame:
    """(keys, tokens) of normalised sentences (keys, entities, norm), stored, with the lemmas of cache (word, lemma)."""
    given = lexicon or corpus.Lexicon()
    nobody = corpus.entity_table(norm.sparkSession).limit(0)
    cache = shared.stored(cache)  # counted before it is joined
    own = corpus.Lexicon(given.relations, given.functions, given.overrides, given.prefixes, given.suffixes, lemmas=cache, fields=given.fields, entities=nobody)
    made = corpus.looked_up(norm, atomic, own)
    # a skipped piece has no tokens, whatever it is part of
    literal = F.transform(F.split("norm", T.BREAKS), lambda w, i: F.when(F.array_contains("entities", w) & (F.size(F.get("parts", i)) > 0), F.array(F.concat(F.lit("LIT:"), w))).otherwise(F.get("parts", i)))
    parts = F.when(F.size("entities") > 0, literal).otherwise(F.col("parts"))
    return made.select(*KEYS, F.concat(T.structure(F.col("norm")), F.flatten(parts)).alias("tokens"))


def _by_rule(x: Column, atomic: bool) -> Column:
    """The tokens of a token that is in no entity, by the first rule that fits."""
    return T.let(F.struct(F.lower(x["lemma"]).alias("lemma"), F.lower(x["text"]).alias("low")), lambda own: _ruled(x, own["lemma"], own["low"], atomic))


def _ruled(x: Column, lemma: Column, low: Column, atomic: bool) -> Column:
    text, upos = x["text"], x["upos"]
    none = F.array().cast("array<string>")

    def one(t: Column | str) -> Column:
        return F.array(F.lit(t) if isinstance(t, str) else t)

    prepositions = {p: f"REL:{p}" for p in L.PREPOSITIONS}
    role = T.lookup(L.DEPENDENCY_ROLES, x["dep"], F.lit(None).cast("string"))
    composed = F.array(F.concat(F.lit("ROOT:"), lemma), F.concat(F.lit("ROLE:"), role)) if atomic else one(F.concat(F.lit("CMP:"), lemma, F.lit(":"), role))
    return T.any_of(
        [
            (F.trim(text) == "", none),
            ((upos == "PUNCT") & text.isin(".", ";"), one("STR:clause_end")), ((upos == "PUNCT") & text.isin(L.QUOTES), one("STR:quote")), (upos == "PUNCT", none),
            (lemma.isin(list(L.QUANTIFIERS)), one(T.lookup(L.QUANTIFIERS, lemma, lemma))),
            ((upos == "DET") | low.isin(L.DETERMINERS), one(F.concat(F.lit("DET:"), lemma))),
            ((upos == "AUX") | lemma.isin(L.AUXILIARIES), one(F.concat(F.lit("AUX:"), lemma))),
            (lemma.isin(L.NEGATIONS) | (x["dep"] == "neg"), one("REL:neg")),
            (lemma.isin(list(L.CONNECTIVES)), one(T.lookup(L.CONNECTIVES, lemma, lemma))),
            ((upos == "ADP") | lemma.isin(L.PREPOSITIONS), one(T.lookup(prepositions, lemma, F.concat(F.lit("REL:"), lemma)))),
            ((x["tag"] == "POS") | (low == "'s"), one("POSS:'s")),
            ((upos == "NUM") | text.rlike("^[0-9][0-9.,]*$"), one(F.concat(F.lit("LIT:"), text))),
            (upos.isin("NOUN", "VERB", "ADJ", "ADV", "PROPN", "PRON") & role.isNotNull(), composed),
            (upos.isin("NOUN", "VERB", "ADJ", "ADV", "PROPN", "PRON"), one(F.concat(F.lit("ROOT:"), lemma))),
        ],
        one(F.concat(F.lit("LIT:"), text)),
    )


def entity_spans(parsed: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """parsed with slot: the place of the first token of the entity's run, or the token's own place.

    A run goes on while tokens are inside and neither begin an entity nor change its label: gaps and islands within a
    sentence, by running maxima.
    """
    order = Window.partitionBy(*keys).orderBy("i")
    inside = F.col("iob") != "O"
    last = F.lag(F.when(inside, F.coalesce("label", F.lit("")))).over(order)
    begins = inside & ((F.col("iob") == "B") | last.isNull() | (last != F.coalesce("label", F.lit(""))))
    marked = parsed.withColumn("_at", F.when(begins, F.col("i")))
    return marked.withColumn("slot", F.when(inside, F.max("_at").over(order.rowsBetween(Window.unboundedPreceding, 0))).otherwise(F.col("i"))).drop("_at")


def dependency_tokens(parsed: DataFrame, keys: list[str] = KEYS, *, atomic: bool = True) -> DataFrame:
    """(keys, tokens) between [BOS] and [EOS]: marks of the sentence, then its entities as literals and its other tokens by rule.

    A sentence's tokens are one array, gathered by one shuffle. A token's trailing space can be given in a column `space`;
    without it words of an entity stand one space apart.
    """
    columns = ["i", "text", "lemma", "upos", "tag", "dep", "iob", "label", *(["space"] if "space" in parsed.columns else [])]
    gathered = parsed.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("tokens"))
    return dependency_of(gathered, keys, atomic=atomic, space="space" in columns)


def dependency_of(sentences: DataFrame, keys: list[str] = KEYS, *, atomic: bool = True, space: bool = False) -> DataFrame:
    """The same of sentences (keys, tokens) as parsed_sentences gives them: all inside the row.

    A token begins a part unless it goes on with an entity's run; a run goes on while tokens are inside and neither begin an
    entity nor change its label. Each token is looked at once, however long a sentence is.
    """

    def inside(x: Column) -> Column:
        return F.coalesce(x["iob"] != "O", F.lit(False))

    def label(x: Column) -> Column:
        return F.coalesce(x["label"], F.lit(""))

    def begins(x: Column, i: Column) -> Column:
        last = F.get("tokens", i - 1)
        return ~inside(x) | (x["iob"] == "B") | (i == 0) | ~inside(last) | (label(last) != label(x))

    def said(j: Column) -> Column:
        x = F.get("tokens", j)
        return F.concat(x["text"], F.coalesce(x["space"], F.lit("")) if space else F.lit(" "))

    starts = F.array_compact(F.transform("tokens", lambda x, i: F.when(begins(x, i), i)))
    marked = sentences.select(*keys, "tokens", starts.alias("starts"), F.exists("tokens", lambda x: F.coalesce(F.lower(x["lemma"]).isin(L.CONDITIONALS), F.lit(False))).alias("conditional"))

    def end(k: Column) -> Column:
        return F.coalesce(F.get("starts", k + 1), F.size("tokens")) - 1

    def part(at: Column, k: Column) -> Column:
        def of(x: Column) -> Column:
            text = F.array_join(F.transform(F.sequence(at, end(k)), said), "")
            return F.when(inside(x), F.array(F.concat(F.lit("LIT:"), F.trim(text)))).otherwise(_by_rule(x, atomic))

        return T.let(F.get("tokens", at), of)

    ends = F.filter(F.transform("starts", lambda at, k: F.get("tokens", end(k))["text"]), lambda t: F.trim(t) != "")
    whole = marked.select(*keys, "conditional", F.element_at(F.concat(F.array(F.lit("")), ends), -1).alias("last"), F.flatten(F.transform("starts", part)).alias("parts"))
    marks = F.array_compact(F.array(F.when(F.rtrim("last").endswith("?"), F.lit("STR:question")), F.when(F.col("conditional"), F.lit("STR:conditional"))))
    return whole.select(*keys, K.wrap(F.concat(marks, "parts")).alias("tokens"))
