"""Text scalars: normalisation, sentence marks, word splits, numbers, parsing of small grammars.

Character classes are spelled out, so that every engine means the same by them.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tokenloom import lexicon as L

#: What counts as white space.
SPACE = r"[ \t\r\n\x0B\f\x{00A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
PUNCTUATION = r".,!?;:'\"()\-"
_EDGE_A, _EDGE_Z = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"


def _literals(words: list[str]) -> Column:
    return F.array(*(F.lit(w) for w in words))


def any_of(pairs: list[tuple[Column, Column | str | None]], default: Column) -> Column:
    """The value of the first condition that holds."""
    made = default
    for condition, value in reversed(pairs):
        made = F.when(condition, value if isinstance(value, Column) else F.lit(value)).otherwise(made)
    return made


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once: as a lambda's variable it is never put in its places as a whole expression."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def hashed(mapping: dict, kind: str = "string") -> Callable[[Column], Column]:
    """A look-up of string keys in a bounded table: null where there is none.

    The table is one literal, an array of small maps by a checksum of the key, so a look-up takes a few steps whatever the
    table's size, needs no join and stays inside array expressions. kind is the type of the values.
    """
    n = 1
    while n < len(mapping) / 2:
        n *= 2
    buckets: list[dict] = [{} for _ in range(n)]
    for k, v in mapping.items():
        buckets[zlib.crc32(k.encode()) % n][k] = v
    table = F.from_json(F.lit(json.dumps(buckets, ensure_ascii=False)), f"array<map<string,{kind}>>")

    def find(key: Column) -> Column:
        return F.try_element_at(F.get(table, F.pmod(F.crc32(key.cast("binary")), F.lit(n)).cast("int")), key)

    return find


def lookup(mapping: dict[str, str], key: Column, default: Column) -> Column:
    """The value of a key in a closed table, or the default."""
    return F.coalesce(hashed(mapping)(key), default)


#: All that counts as white space, and quotes with the straight ones that stand for them.
_SPACES = "\t\r\n\x0b\x0c\u00a0\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
_SINGLE, _DOUBLE = "‘’‚‹›", "“”„«»"


def normalize(text: Column) -> Column:
    """Lower case, straight quotes, single spaces, none at the ends."""
    plain = F.translate(F.lower(text), _SINGLE + _DOUBLE + _SPACES, "'" * len(_SINGLE) + '"' * len(_DOUBLE) + " " * len(_SPACES))
    # one expression, so that the text is lowered and translated once
    return F.trim(F.regexp_replace(plain, "  +", " "))


def structure(normal: Column) -> Column:
    """The sentence's markers, each once, in fixed order. Words are sought plainly before their borders are looked at."""

    def marked(n: Column) -> Column:
        marks = [F.when(n.endswith("?"), F.lit("STR:question"))]
        for name, words in L.STRUCTURE_WORDS.items():
            there = F.lit(False)
            for w in words:
                there = there | n.contains(w)
            marks.append(F.when(there & n.rlike(_EDGE_A + "(?:" + "|".join(words) + ")" + _EDGE_Z), F.lit(name)))
        return F.array_compact(F.array(*marks, F.when(n.endswith("!"), F.lit("STR:emphasis"))))

    return F.coalesce(let(normal, marked), F.array().cast("array<string>"))


def words(normal: Column) -> Column:
    """Words and punctuation marks of a normalised sentence, in order."""
    return F.filter(F.split(F.regexp_replace(normal, f"([{PUNCTUATION}])", " $1 "), " +"), lambda w: w != "")


#: What stands between the words of a normalised sentence: split there, it leaves no punctuation marks of `words`, but empty ends.
BREAKS = f"[ {PUNCTUATION}]+"


def skipped(word: Column) -> Column:
    """Whether a word is only punctuation, a contraction piece or a stray letter."""
    return word.rlike("^[.,!?;:'\"()\\-–—…/]+$") | word.isin(L.FRAGMENTS)


def default_lemma(word: Column) -> Column:
    """A word without its plural or third-person ending, where no table knows better."""
    n = F.length(word)

    def but(k: int) -> Column:
        return F.substr(word, F.lit(1), n - k)

    return (
        F.when(word.endswith("ies") & (n > 4), F.concat(but(3), F.lit("y"))).when(word.endswith("es") & word.rlike("(ss|sh|ch|x)es$") & (n > 4), but(2))
        .when(word.endswith("s") & ~word.rlike("(ss|us|is)$") & (n > 3), but(1)).otherwise(word)
    )


def prefix_role(word: Column, prefixes: list[tuple[str, str]] = L.PREFIXES) -> Column:
    """struct(prefix, role, stem) of the first prefix that leaves three letters; null without one."""
    made = F.lit(None)
    for p, role in reversed(prefixes):
        hit = F.struct(F.lit(p).alias("affix"), F.lit(role).alias("role"), F.substr(word, F.lit(len(p) + 1)).alias("stem"))
        made = F.when(word.startswith(p) & (F.length(word) > len(p) + 2), hit).otherwise(made)
    return made


def suffix_role(word: Column, lemma: Column, suffixes: list[tuple[str, str]] = L.SUFFIXES) -> Column:
    """struct(suffix, role, stem) of the first suffix that leaves three letters; inflections only where the lemma differs."""
    made = F.lit(None)
    for s, role in [("es", "plural"), ("s", "plural")]:
        hit = F.struct(F.lit(s).alias("affix"), F.lit(role).alias("role"), F.substr(word, F.lit(1), F.length(word) - len(s)).alias("stem"))
        made = F.when((word != lemma) & (word == F.concat(lemma, F.lit(s))), hit).otherwise(made)
    for s, role in reversed(suffixes):
        hit = F.struct(F.lit(s).alias("affix"), F.lit(role).alias("role"), F.substr(word, F.lit(1), F.length(word) - len(s)).alias("stem"))
        fits = word.endswith(s) & (F.length(word) > len(s) + 2)
        made = F.when(fits & (word != lemma) if s in L.INFLECTIONS else fits, hit).otherwise(made)
    return made


def root_of(word: Column, lemma: Column, prefix: Column, suffix: Column) -> Column:
    """The stem behind a prefix; else, with a suffix, the lemma if it differs or the stem; else the lemma."""
    return F.when(prefix.isNotNull(), prefix["stem"]).when(suffix.isNotNull(), F.when(lemma != word, lemma).otherwise(suffix["stem"])).otherwise(lemma)


def decompose(word: Column, lemma: Column) -> Column:
    """struct(root, role): a prefix first, else a suffix, else the lemma alone."""
    p, s = prefix_role(word), suffix_role(word, lemma)
    return F.struct(root_of(word, lemma, p, s).alias("root"), F.coalesce(p["role"], s["role"]).alias("role"))


def field_candidates(root: Column, lemma: Column) -> Column:
    """Spellings to look up, best first: root and lemma with and without e, then the root without a suffix."""
    made = [root, F.concat(root, F.lit("e")), lemma, F.concat(lemma, F.lit("e"))]
    for s in L.FIELD_SUFFIXES:
        stem = F.substr(root, F.lit(1), F.length(root) - len(s))
        fits = root.endswith(s) & (F.length(root) > len(s) + 2)
        made += [F.when(fits, stem), F.when(fits, F.concat(stem, F.lit("e")))]
    return F.array(*made)


def resolve_field(root: Column, lemma: Column, find: Callable[[Column], Column]) -> Column:
    """The field of the first of the candidates that find knows; the stems are only looked at where a suffix fits."""
    made = [find(root), find(F.concat(root, F.lit("e"))), find(lemma), find(F.concat(lemma, F.lit("e")))]
    for s in L.FIELD_SUFFIXES:
        stem = F.substr(root, F.lit(1), F.length(root) - len(s))
        made.append(F.when(root.endswith(s) & (F.length(root) > len(s) + 2), F.coalesce(find(stem), find(F.concat(stem, F.lit("e"))))))
    return F.coalesce(*made)


#: Arabic articles are cut at marks and lines, which go; elsewhere behind marks that white space follows, and at lines.
ARABIC_END = "[.؟!\\n][ \\t\\r\\n]*"
SENTENCE_END = "([.!?؟]+[\"'”’»)\\]]*)[ \\t\\r\\n]+"


def sentences(text: Column, lang: Column) -> Column:
    """The sentences of a text, trimmed. Marks stay with their sentence, and one inside a number or a name ends none."""
    parts = F.when(lang == "ar", F.split(text, ARABIC_END)).otherwise(F.split(F.regexp_replace(text, SENTENCE_END, "$1\n"), "\n"))
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")


def share_in(text: Column, characters: str) -> Column:
    """The share of characters that a class holds; 0 for an empty text."""
    kept = F.length(F.regexp_replace(text, f"[^{characters}]", ""))
    return F.when(F.length(text) > 0, kept / F.length(text)).otherwise(0.0)


def number_class(raw: Column) -> Column:
    """NUM:percent, decimal, year, small or measure of a numeral with Latin or Arabic-Indic digits; else null."""
    digit = "0-9٠-٩۰-۹"
    folded = F.translate(raw, "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "01234567890123456789")
    value = F.regexp_replace(folded, "^0+([0-9])", "$1")
    number = F.when(F.length(value) <= 9, value.cast("long"))
    whole = F.when(number.between(1800, 2100), F.lit("NUM:year")).when(number < 1000, F.lit("NUM:small")).otherwise(F.lit("NUM:measure"))
    return (
        F.when(raw.rlike(f"^[{digit}]+[.,٫]?[{digit}]*[%٪]$"), F.lit("NUM:percent"))
        .when(raw.rlike(f"^[{digit}]+[.,٫][{digit}]+$"), F.lit("NUM:decimal"))
        .when(raw.rlike(f"^[{digit}]+$"), whole)
    )


#: Vowel marks and tatweel; with Arabic punctuation. The ranges are spelled by code points: marks may be reordered in source.
VOWEL_MARKS = r"\x{064B}-\x{065F}\x{0670}\x{0640}"
ARABIC_MARKS = VOWEL_MARKS + r"\x{060C}\x{060D}\x{061B}\x{061E}\x{061F}\x{066A}-\x{066D}\x{06D4}\x{06DD}\x{06DE}"


def strip_arabic(word: Column) -> Column:
    """Without diacritics, tatweel and Arabic punctuation."""
    return F.regexp_replace(word, f"[{ARABIC_MARKS}]", "")


def strip_vowels(pattern: Column) -> Column:
    """Without short vowels; the doubling mark stays."""
    return F.regexp_replace(pattern, r"[\x{064B}-\x{0650}\x{0652}\x{0670}]", "")


def literal_bucket(surface: Column) -> Column:
    """num, foreign, mixed_script, punct_only, single_char, short_arabic or arabic_4plus."""
    bare = F.regexp_replace(surface, f"[{VOWEL_MARKS}]", "")
    arabic, latin = bare.rlike("[ء-ي]"), bare.rlike("[A-Za-z]")
    return (
        F.when(bare.rlike("[0-9٠-٩۰-۹]"), F.lit("num"))
        .when(latin & ~arabic, F.lit("foreign"))
        .when(latin & arabic, F.lit("mixed_script"))
        .when(~bare.rlike("[A-Za-zء-يÀ-ɏ]"), F.lit("punct_only"))
        .when(F.length(bare) <= 1, F.lit("single_char"))
        .when(F.length(bare) <= 3, F.lit("short_arabic"))
        .otherwise(F.lit("arabic_4plus"))
    )


def gold_label(answer: Column) -> Column:
    low = F.lower(F.trim(answer))
    return F.when(low.isin("yes", "نعم", "valid", "true"), F.lit("yes")).when(low.isin("no", "لا", "invalid", "false"), F.lit("no"))


def nli(question: Column) -> Column:
    """struct(premise, hypothesis) between the English or Arabic markers; empty where they are missing."""
    pattern = "(?:Premise|المقدمة): *([^\\n]*)\\n(?:Hypothesis|الفرضية): *([^\\n]*)"
    return F.struct(F.regexp_extract(question, pattern, 1).alias("premise"), F.regexp_extract(question, pattern, 2).alias("hypothesis"))


STEP_END = "([.?!])[ \\t\\r\\n]+"


def answer_after_hashes(solution: Column) -> Column:
    """struct(steps, answer): the answer stands behind the last ####, the steps before end at sentence marks and lines."""
    body, answer = F.regexp_extract(solution, "(?s)^(.*)####(.*)$", 1), F.regexp_extract(solution, "(?s)^(.*)####(.*)$", 2)
    body = F.when(solution.contains("####"), body).otherwise(solution)
    steps = F.filter(F.transform(F.split(F.regexp_replace(body, STEP_END, "$1\n"), "\n"), lambda s: F.trim(s)), lambda s: s != "")
    return F.struct(steps.alias("steps"), F.trim(answer).alias("answer"))


def sum_of_terms(expression: Column, letter: str = "x") -> Column:
    """Sum of the coefficients of a single letter: 2x + x - 3x is 0."""
    bare = F.regexp_replace(expression, " ", "")
    found = F.regexp_extract_all(bare, F.lit(f"([+-]?[0-9]*){letter}"), F.lit(1))
    value = F.transform(found, lambda c: F.when(c.isin("", "+"), 1).when(c == "-", -1).otherwise(F.regexp_replace(c, "\\+", "").cast("int")))
    return F.aggregate(value, F.lit(0), lambda a, b: a + b)


CATEGORICAL = [("A", "^(?:therefore,? )?all (.+) are (.+)$"), ("E", "^(?:therefore,? )?no (.+) are (.+)$"), ("O", "^(?:therefore,? )?some (.+) are not (.+)$"), ("I", "^(?:therefore,? )?some (.+) are (.+)$")]


def categorical(sentence: Column) -> Column:
    """struct(form, subject, predicate) of All, No, Some ... not and Some sentences; nulls for others."""
    low = F.regexp_replace(F.lower(F.trim(sentence)), "[.]$", "")
    parts = [any_of([(low.rlike(p), form) for form, p in CATEGORICAL], F.lit(None).cast("string"))]
    for group in (1, 2):
        parts.append(any_of([(low.rlike(p), F.regexp_extract(low, p, group)) for _, p in CATEGORICAL], F.lit(None).cast("string")))
    return F.struct(*(x.alias(n) for x, n in zip(parts, ("form", "subject", "predicate"))))


def categorical_logic(form: Column) -> Column:
    """The proposition as logic tokens; the O form has a negation inside."""
    s, p = "C:CONCEPT", "C:CONCEPT"
    shape = {"A": ["Q:ALL", s, "R:IS", p], "E": ["Q:NO", s, "R:IS", p], "I": ["Q:SOME", s, "R:IS", p], "O": ["Q:SOME", s, "R:IS", "L:NOT", p]}
    return any_of([(form == k, _literals(v)) for k, v in shape.items()], F.lit(None).cast("array<string>"))


def assignments(text: Column) -> Column:
    """map(name, boolean) of name=true/false pairs; of a repeated name the last counts."""
    pattern = F.lit("([a-z][a-z0-9]*) *= *(true|false|t|f|1|0)")
    names, values = F.regexp_extract_all(text, pattern, F.lit(1)), F.regexp_extract_all(text, pattern, F.lit(2))
    last = F.filter(F.sequence(F.lit(0), F.size(names) - 1), lambda i: ~F.array_contains(F.slice(names, i + 2, F.greatest(F.size(names) - i - 1, F.lit(0))), F.get(names, i)))
    made = F.map_from_arrays(F.transform(last, lambda i: F.get(names, i)), F.transform(last, lambda i: F.get(values, i).isin("true", "t", "1")))
    return F.when(F.size(names) > 0, made).otherwise(F.create_map().cast("map<string,boolean>"))


def humanize(tokens: Column) -> Column:
    """Logic tokens as a short phrase."""
    atoms = {"L:AND": "and", "L:OR": "or", "L:NOT": "not", "L:IMPL": "implies", "L:IFF": "iff", "L:LPAREN": "(", "L:RPAREN": ")", "L:THEREFORE": "therefore", "Q:ALL": "all", "Q:SOME": "some", "Q:NO": "no", "R:IS": "is", "R:EQUALS": "="}
    spoken = F.transform(tokens, lambda t: any_of([(t == k, v) for k, v in atoms.items()], F.lower(F.regexp_replace(t, "^[A-Z]+:", ""))))
    return F.regexp_replace(F.regexp_replace(F.array_join(spoken, " "), "\\( ", "("), " \\)", ")")


def format_answer(tokens: Column) -> Column:
    """true or false, yes or no, as the answer's tokens say; else the tokens themselves."""
    return (
        F.when(F.array_contains(tokens, "L:TRUE"), F.lit("true")).when(F.array_contains(tokens, "L:FALSE"), F.lit("false"))
        .when(F.array_contains(tokens, "REL:yes") | F.array_contains(tokens, "V:Y"), F.lit("yes")).when(F.array_contains(tokens, "REL:no") | F.array_contains(tokens, "V:N"), F.lit("no"))
        .otherwise(F.array_join(tokens, " "))
    )


def edit_distance(a: Column, b: Column) -> Column:
    """Edit distance of two token arrays: each token of the pair is one character of its own, and strings are compared whole.

    Characters skip the surrogates, so a pair may have some 63,000 different tokens; with more the result is null.
    """

    def measured(both: Column) -> Column:
        def text(tokens: Column) -> Column:
            def char(t: Column) -> Column:
                place = F.array_position(both, t) + 255
                place = F.when(place >= 0xD800, place + 0x800).otherwise(place)
                return F.decode(F.unhex(F.lpad(F.hex(place), 4, "0")), "UTF-16BE")

            return F.array_join(F.transform(tokens, char), "")

        return F.when(F.size(both) < 63_000, F.levenshtein(text(a), text(b)))

    return let(F.array_distinct(F.concat(a, b)), measured)
