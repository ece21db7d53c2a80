"""Pieces of DuckDB SQL made from the closed tables."""

from __future__ import annotations

from tokenloom import lexicon as L
from tokenloom.functions import text as T
from tokenloom.functions import tokens as K


def quote(x: object) -> str:
    return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else "null" if x is None else str(x)


def items(xs) -> str:
    return "(" + ", ".join(quote(x) for x in xs) + ")"


def values(rows) -> str:
    return "values " + ", ".join(items(r) for r in rows)


def case(x: str, mapping: dict, default: str) -> str:
    if not mapping:
        return default
    return "case " + " ".join(f"when {x} = {quote(k)} then {v if isinstance(v, _Raw) else quote(v)}" for k, v in mapping.items()) + f" else {default} end"


class _Raw(str):
    """SQL, not a string to quote."""


def raw(x: str) -> _Raw:
    return _Raw(x)


SENT = f"""sent as (select doc_id, lang, source, (row_number() over (partition by doc_id order by p) - 1)::int as pos, sent from (
    select doc_id, lang, source, trim(unnest(parts)) as sent, generate_subscripts(parts, 1) as p from (
        select doc_id, lang, source, case when lang = 'ar' then string_split_regex(text, {quote(T.ARABIC_END)})
            else string_split(regexp_replace(text, {quote(T.SENTENCE_END)}, '\\1' || chr(10), 'g'), chr(10)) end as parts from documents)) where sent <> '')"""


def normalize(x: str) -> str:
    straight = f"regexp_replace(regexp_replace(lower({x}), '[‘’‚‹›]', '''', 'g'), '[“”„«»]', '\"', 'g')"
    return f"trim(regexp_replace({straight}, {quote(T.SPACE + '+')}, ' ', 'g'))"


def structure(x: str) -> str:
    marks = [f"case when {x} like '%?' then 'STR:question' end"]
    for name, words in L.STRUCTURE_WORDS.items():
        pattern = "(^|[^A-Za-z0-9_])(" + "|".join(words) + ")([^A-Za-z0-9_]|$)"
        marks.append(f"case when regexp_matches({x}, {quote(pattern)}) then {quote(name)} end")
    marks.append(f"case when {x} like '%!' then 'STR:emphasis' end")
    return f"list_filter([{', '.join(marks)}], lambda m: m is not null)"


def words(x: str) -> str:
    return f"list_filter(string_split_regex(regexp_replace({x}, {quote('([' + T.PUNCTUATION + '])')}, ' \\1 ', 'g'), ' +'), lambda w: w <> '')"


def skipped(w: str) -> str:
    return f"(regexp_full_match({w}, '[.,!?;:''\"()\\-–—…/]+') or {w} in {items(L.FRAGMENTS)})"


NORM = f"norm as (select doc_id, lang, pos, {normalize('sent')} as n from sent)"
WORD = f"""word as (select * from (select doc_id, lang, pos, unnest({words('n')}) as word, generate_subscripts({words('n')}, 1)::int - 1 as i from norm)
    where not {skipped('word')})"""
DISTINCT = "dw as materialized (select distinct word from word)"
_PLAIN = """case when word like '%ies' and length(word) > 4 then substr(word, 1, length(word) - 3) || 'y' when regexp_matches(word, '(ss|sh|ch|x)es$') and length(word) > 4 then substr(word, 1, length(word) - 2)
    when word like '%s' and not regexp_matches(word, '(ss|us|is)$') and length(word) > 3 then substr(word, 1, length(word) - 1) else word end"""
LEMMAS = f"({values(L.LEMMAS.items())}) t(w, lemma)"
LEMMA = f"lem as materialized (select word, coalesce(t.lemma, {_PLAIN}) as lemma from dw left join {LEMMAS} on t.w = word)"


def _prefix(part: str) -> str:
    out = {"affix": lambda p, r: quote(p), "role": lambda p, r: quote(r), "stem": lambda p, r: f"substr(word, {len(p) + 1})"}[part]
    return "case " + " ".join(f"when starts_with(word, {quote(p)}) and length(word) > {len(p) + 2} then {out(p, r)}" for p, r in L.PREFIXES) + " end"


def _suffix(part: str) -> str:
    out = {"affix": lambda s, r: quote(s), "role": lambda s, r: quote(r), "stem": lambda s, r: f"substr(word, 1, length(word) - {len(s)})"}[part]
    made = []
    for s, r in L.SUFFIXES:
        more = " and word <> lemma" if s in L.INFLECTIONS else ""
        made.append(f"when ends_with(word, {quote(s)}) and length(word) > {len(s) + 2}{more} then {out(s, r)}")
    for s in ("s", "es"):
        made.append(f"when word <> lemma and word = lemma || {quote(s)} then {out(s, 'plural')}")
    return "case " + " ".join(made) + " end"


AFFIX = "aff as materialized (select word, lemma, " + ", ".join(f"{f(part)} as {n}_{part}" for n, f in (("p", _prefix), ("s", _suffix)) for part in ("affix", "role", "stem")) + " from lem)"
DECOMPOSED = """dec as materialized (select word, lemma, case when p_affix is not null then p_stem when s_affix is not null then case when lemma <> word then lemma else s_stem end else lemma end as root,
    coalesce(p_role, s_role) as role from aff)"""


def _candidates() -> str:
    made = ["root", "root || 'e'", "lemma", "lemma || 'e'"]
    for s in L.FIELD_SUFFIXES:
        fits, stem = f"ends_with(root, {quote(s)}) and length(root) > {len(s) + 2}", f"substr(root, 1, length(root) - {len(s)})"
        made += [f"case when {fits} then {stem} end", f"case when {fits} then {stem} || 'e' end"]
    return "[" + ", ".join(made) + "]"


FIELD = f"""cand as materialized (select word, unnest({_candidates()}) as spelling, generate_subscripts({_candidates()}, 1) as prio from dec),
fld as materialized (select word, arg_min(field, prio) as field from cand join ({values(L.FIELDS.items())}) f(spelling, field) using (spelling) group by word),
ana as materialized (select dec.*, fld.field from dec left join fld using (word))"""


def emitted(atomic: bool = False) -> str:
    role = "role"
    if atomic:
        role = case("lemma", L.ROLE_OVERRIDES, case("word", L.ROLE_OVERRIDES, "role"))
    rel = case("word", L.RELATIONS, "null")
    cmp_ = f"['ROOT:' || field, 'ROLE:' || {role}]" if atomic else f"['CMP:' || field || ':' || {role}]"

    def cascade(name, num, r, fun, c, root, rest):
        return f"""case when word in {items(L.ENTITIES)} then {name} when regexp_full_match(word, '[0-9]+') then {num} when {rel} is not null then {r} when word in {items(L.FUNCTION_WORDS)} then {fun}
            when field is not null and {role} is not null then {c} when field is not null then {root} else {rest} end"""

    return f"""em as materialized (select word, {cascade("'LIT'", "'ROOT'", "'REL'", "'LIT'", quote("ROOT" if atomic else "CMP"), "'ROOT'", "'LIT'")} as type,
        {cascade("['LIT:' || word]", "['ROOT:size']", f"[{rel}]", "['LIT:' || word]", cmp_, "['ROOT:' || field]", "['LIT:' || word]")} as tokens,
        {cascade("1.0", "0.9", "1.0", "0.9", "0.9", "0.8", "0.5")}::double as confidence, lemma, root, role, field from ana)"""


EN = ", ".join([SENT, NORM, WORD, DISTINCT, LEMMA, AFFIX, DECOMPOSED, FIELD])


def token_parts(atomic: bool = False, suffix: str = "") -> str:
    em, tok = f"em{suffix}", f"tok{suffix}"
    return f"""{emitted(atomic).replace("em as", em + " as", 1)},
{tok} as (select n.doc_id, n.lang, n.pos, list_concat({structure('n.n')}, coalesce(w.tokens, [])) as tokens from norm n left join (
    select doc_id, pos, flatten(list({em}.tokens order by i)) as tokens from word join {em} using (word) group by doc_id, pos) w on w.doc_id = n.doc_id and w.pos = n.pos)"""


def tokenized(atomic: bool = False) -> str:
    return f"{EN}, {token_parts(atomic)}"


def lex_english(x: str) -> str:
    low = "lower(r)"
    rules = f"""case when {low} in {items(L.DETERMINERS)} then 'DET:' || {low}
        when {low} in {items(L.CONNECTIVES)} then {case(low, L.CONNECTIVES, 'null')}
        when {low} in {items(L.NEGATIONS)} then 'REL:neg'
        when {low} in {items(L.QUANTIFIERS)} then {case(low, L.QUANTIFIERS, 'null')}
        when {low} in {items(L.PREPOSITIONS)} then 'REL:' || {low}
        when {low} in {items(L.AUXILIARIES)} then 'AUX:' || {low}
        when r = '?' then 'STR:question' when r in ('.', ';') then 'STR:clause_end'
        when regexp_full_match(r, '[0-9]+') then 'LIT:' || r else 'ROOT:' || {low} end"""
    return f"list_concat(list_concat(['[BOS]'], list_transform(regexp_extract_all({x}, {quote(K.LEXER)}), lambda r: {rules})), ['[EOS]'])"


def reasoning_kept(x: str, changes: dict) -> str:
    drop = [t for t, to in changes.items() if to is None]
    to = {t: v for t, v in changes.items() if v}
    return f"list_transform(list_filter({x}, lambda t: t not in {items(drop)} and not starts_with(t, 'FEAT:')), lambda t: {case('t', to, 't')})"


def reasoning_collapse(x: str) -> str:
    return f"list_filter({x}, lambda t, i: i = 1 or not ((starts_with(t, 'REL:') or t = 'STR:clause_end') and t = {x}[i - 1]))"


REASON = f"""lexed as (select doc_id, lang, pos, {lex_english('sent')} as d from sent), kept as (select *, {reasoning_kept('d', L.REASONING_EN)} as k from lexed),
proj as (select doc_id, lang, pos, d as default_tokens, {reasoning_collapse('k')} as reasoning_tokens from kept)"""


def logic_parts(x: str) -> str:
    known = [t for b in L.LOGIC_BUCKETS.values() for t in b]
    concept = case("regexp_replace(t, '^[A-Z]+:', '')", L.FIELD_CONCEPTS, "'C:CONCEPT'")
    last = "string_split(t, ':')[-1]"
    role = f"case when {last} in {items(L.ROLE_LOGIC)} then [{case(last, L.ROLE_LOGIC, 'null')}] else [] end"
    field = case("string_split(t, ':')[2]", L.FIELD_CONCEPTS, "'C:CONCEPT'")
    rules = f"""case when starts_with(t, 'LIT:') then ['[UNK]'] when t in ('[BOS]', '[EOS]', '[PAD]', '[UNK]', '[SEP]') then [t]
        when t in {items(L.LOGIC_TOKENS)} then [{case('t', L.LOGIC_TOKENS, 'null')}]
        when t in {items(L.LOGIC_DROPPED)} or starts_with(t, 'FEAT:') or starts_with(t, 'PAT:') then []
        when starts_with(t, 'NUM:') then ['N:INT'] when starts_with(t, 'ROLE:') then {role} when starts_with(t, 'TIME:') then ['C:TIME_POINT']
        when starts_with(t, 'CMP:') then case when len(string_split(t, ':')) = 3 then list_concat([{field}], {role}) else ['C:CONCEPT'] end
        when starts_with(t, 'ROOT:') then [{concept}] when starts_with(t, 'NE:') then ['C:PERSON'] when starts_with(t, 'FOREIGN:') then ['C:CONCEPT']
        else ['[UNK]'] end"""
    return f"list_transform(flatten(list_transform({x}, lambda t: {rules})), lambda t: case when t in {items(known)} then t else '[UNK]' end)"


def logic_collapse(x: str) -> str:
    return f"list_filter({x}, lambda t, i: i = 1 or not (t in {items(L.LOGIC_COLLAPSE)} and t = {x}[i - 1]))"


def lex_formal(x: str) -> str:
    slots = [v[2:] for v in L.LOGIC_BUCKETS["variables"]]
    symbols = " ".join(f"when regexp_full_match(r, {quote(p)}) then {quote(t)}" for p, t in L.FORMAL_SYMBOLS)
    number = "case when length(ltrim(r, '0')) > 9 then 'N:LARGE' when r::bigint = 0 then 'N:ZERO' when r::bigint = 1 then 'N:ONE' when r::bigint <= 100 then 'N:SMALL' else 'N:LARGE' end"
    rules = f"""case {symbols} when regexp_full_match(r, '[0-9]+') then {number} when lower(r) in {items(L.FORMAL_KEYWORDS)} then {case('lower(r)', L.FORMAL_KEYWORDS, 'null')}
        when upper(r[1]) in {items(slots)} then 'V:' || upper(r[1]) else 'C:CONCEPT' end"""
    return f"list_transform(regexp_extract_all({x}, {quote(K.FORMAL)}), lambda r: {rules})"
