"""Token streams as array columns: the rule lexer, projections, collapses, cuts and pads."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tokenloom import lexicon as L
from tokenloom.functions.text import any_of, lookup

LEXER = r"[A-Za-z][A-Za-z'\-]*|[0-9]+|[.?!;,]"


# every word of the closed classes with its token; of a word in two classes the later line here counts
_CLOSED = {
    **{w: f"AUX:{w}" for w in L.AUXILIARIES},
    **{w: f"REL:{w}" for w in L.PREPOSITIONS},
    **L.QUANTIFIERS,
    **{w: "REL:neg" for w in L.NEGATIONS},
    **L.CONNECTIVES,
    **{w: f"DET:{w}" for w in L.DETERMINERS},
    "?": "STR:question",
    ".": "STR:clause_end",
    ";": "STR:clause_end",
}


def lex_english(sentence: Column) -> Column:
    """Surface tokens by ordered rules, between [BOS] and [EOS]; needs no language model."""
    # only A-Z change: other letters are no part of tokens and must not become ASCII
    low = F.translate(sentence, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def one(word: Column) -> Column:
        kind = F.when(F.substring(word, 1, 1).between("0", "9"), F.lit("LIT:")).otherwise(F.lit("ROOT:"))
        return lookup(_CLOSED, word, F.concat(kind, word))

    return wrap(F.transform(F.regexp_extract_all(low, F.lit(LEXER), F.lit(0)), one))


def wrap(tokens: Column) -> Column:
    return F.concat(F.array(F.lit("[BOS]")), tokens, F.array(F.lit("[EOS]")))


def unwrap(tokens: Column) -> Column:
    """Without one outer pair of [BOS] and [EOS]; unchanged unless both are there."""
    both = (F.size(tokens) >= 2) & (F.get(tokens, F.lit(0)) == "[BOS]") & (F.element_at(tokens, -1) == "[EOS]")
    return F.when(both, F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 2, F.lit(0)))).otherwise(tokens)


def unmark(tokens: Column) -> Column:
    """Without any [BOS] and [EOS], inner ones too."""
    return F.filter(tokens, lambda t: ~t.isin("[BOS]", "[EOS]"))


def collapse(tokens: Column, collapsible) -> Column:
    """Without an element that equals the one before and may collapse."""
    return F.filter(tokens, lambda t, i: (i == 0) | ~(collapsible(t) & (t == F.get(tokens, i - 1))))


def reasoning_kept(tokens: Column, lang: str) -> Column:
    """The tokens that the reasoning level keeps or renames, before equal neighbours collapse."""
    changes = {"en": L.REASONING_EN, "ar": L.REASONING_AR}.get(lang)
    if changes is None:
        raise ValueError(f"no projection for language {lang!r}")
    drop = [t for t, to in changes.items() if to is None]
    kept = F.filter(tokens, lambda t: ~t.isin(drop) & ~t.startswith("FEAT:"))
    return F.transform(kept, lambda t: any_of([(t == a, b) for a, b in changes.items() if b], t))


def reasoning_collapse(tokens: Column) -> Column:
    return collapse(tokens, lambda t: t.startswith("REL:") | (t == "STR:clause_end"))


def project_reasoning(tokens: Column, lang: str) -> Column:
    return reasoning_collapse(reasoning_kept(tokens, lang))


def concept_of(field: Column) -> Column:
    return lookup(L.FIELD_CONCEPTS, field, F.lit("C:CONCEPT"))


def logic_parts(tokens: Column, roots: dict[str, str] | None = None) -> Column:
    """Logic tokens before equal neighbours collapse; roots names fields of raw roots."""
    known = sorted({t for b in L.LOGIC_BUCKETS.values() for t in b})

    def none() -> Column:
        return F.array().cast("array<string>")

    def one(t: Column) -> Column:
        rest = F.substring_index(t, ":", -1)
        root = F.regexp_replace(t, "^[A-Z]+:", "")
        role = F.when(rest.isin(list(L.ROLE_LOGIC)), F.array(lookup(L.ROLE_LOGIC, rest, F.lit(None).cast("string")))).otherwise(none())
        parts = F.split(t, ":")
        composed = F.when(F.size(parts) == 3, F.concat(F.array(concept_of(F.get(parts, F.lit(1)))), role)).otherwise(F.array(F.lit("C:CONCEPT")))
        field = lookup(roots, root, root) if roots else root
        return any_of(
            [
                (t.startswith("LIT:"), F.array(F.lit("[UNK]"))),  # most tokens of running text
                (t.isin("[BOS]", "[EOS]", "[PAD]", "[UNK]", "[SEP]"), F.array(t)),
                (t.isin(list(L.LOGIC_TOKENS)), F.array(lookup(L.LOGIC_TOKENS, t, t))),
                (t.isin(L.LOGIC_DROPPED) | t.startswith("FEAT:") | t.startswith("PAT:"), none()),
                (t.startswith("NUM:"), F.array(F.lit("N:INT"))),
                (t.startswith("ROLE:"), role),
                (t.startswith("TIME:"), F.array(F.lit("C:TIME_POINT"))),
                (t.startswith("CMP:"), composed),
                (t.startswith("ROOT:"), F.array(concept_of(field))),
                (t.startswith("NE:"), F.array(F.lit("C:PERSON"))),
                (t.startswith("FOREIGN:"), F.array(F.lit("C:CONCEPT"))),
            ],
            F.array(F.lit("[UNK]")),
        )

    flat = F.flatten(F.transform(tokens, one))
    return F.transform(flat, lambda t: F.when(t.isin(known), t).otherwise(F.lit("[UNK]")))


def logic_collapse(tokens: Column) -> Column:
    return collapse(tokens, lambda t: t.isin(L.LOGIC_COLLAPSE))


# the symbols that the patterns stand for: each is an alternative without its escapes
_SYMBOLS = {re.sub(r"\\(.)", r"\1", x): t for p, t in L.FORMAL_SYMBOLS for x in re.split(r"(?<!\\)\|", p)}
FORMAL = "|".join(p for p, _ in L.FORMAL_SYMBOLS) + r"|[0-9]+|[A-Za-z_][A-Za-z0-9_]*"


def integer_bucket(n: Column) -> Column:
    return F.when(n == 0, F.lit("N:ZERO")).when(n == 1, F.lit("N:ONE")).when(n < 0, F.lit("N:NEG")).when(n <= 100, F.lit("N:SMALL")).otherwise(F.lit("N:LARGE"))


def lex_formal(text: Column) -> Column:
    """Logic tokens of a formula; unmatched characters are skipped, equal neighbours not yet collapsed."""
    slots = [v[2:] for v in L.LOGIC_BUCKETS["variables"]]

    def one(raw: Column) -> Column:
        low, first = F.lower(raw), F.upper(F.substring(raw, 1, 1))
        digits = F.regexp_replace(raw, "^0+([0-9])", "$1")
        number = F.when(F.length(digits) > 9, F.lit("N:LARGE")).otherwise(integer_bucket(digits.cast("long")))
        variable = F.when(first.isin(slots), F.concat(F.lit("V:"), first)).otherwise(F.lit("C:CONCEPT"))
        word = F.when(raw.rlike("^[0-9]"), number).otherwise(lookup(L.FORMAL_KEYWORDS, low, variable))
        return lookup(_SYMBOLS, raw, word)

    return F.transform(F.regexp_extract_all(text, F.lit(FORMAL), F.lit(0)), one)


def head(ids: Column, most: int) -> Column:
    return F.slice(ids, 1, most)


def tail(ids: Column, most: int) -> Column:
    return F.when(F.size(ids) > most, F.slice(ids, -most, most)).otherwise(ids)


def head_tail(ids: Column, most: int) -> Column:
    half = most // 2
    return F.when(F.size(ids) > most, F.concat(F.slice(ids, 1, half), F.slice(ids, -(most - half), most - half))).otherwise(ids)


def pad(ids: Column, size: Column | int, value: int = 0) -> Column:
    size = F.lit(size) if isinstance(size, int) else size
    return F.concat(ids, F.array_repeat(F.lit(value), F.greatest(size - F.size(ids), F.lit(0))))


def mask(ids: Column, size: Column | int) -> Column:
    size = F.lit(size) if isinstance(size, int) else size
    return F.concat(F.array_repeat(F.lit(1), F.size(ids)), F.array_repeat(F.lit(0), F.greatest(size - F.size(ids), F.lit(0))))


def shifted_labels(ids: Column, ignore: int = -100) -> Column:
    """The next id at each place, `ignore` at the last."""
    return F.concat(F.slice(ids, F.lit(2), F.greatest(F.size(ids) - 1, F.lit(0))), F.when(F.size(ids) > 0, F.array(F.lit(ignore))).otherwise(F.array().cast("array<int>")))


def drop_literals(ids: Column, literal: list[int] | Column, subwords: Column, shift: int) -> Column:
    """ids without literal ones; if any was there, the subword ids follow, moved up by the vocabulary's size."""
    inside = (lambda x: x.isin(literal)) if isinstance(literal, list) else (lambda x: F.array_contains(literal, x))
    kept = F.filter(ids, lambda x: ~inside(x))
    return F.when(F.size(kept) < F.size(ids), F.concat(kept, F.transform(subwords, lambda x: x + shift))).otherwise(kept)


def segments(ids: Column, begin: int, end: int) -> Column:
    """The ids between each begin and the next end, as texts of numbers."""
    text = F.array_join(F.transform(ids, lambda x: F.when(x == begin, F.lit("<")).when(x == end, F.lit(">")).otherwise(x.cast("string"))), " ")
    return F.transform(F.regexp_extract_all(text, F.lit("<([^<>]*)>"), F.lit(1)), lambda s: F.trim(s))


def compose(question: Column, steps: Column, answer: Column) -> Column:
    return F.concat(question, F.flatten(steps), answer)
