"""DuckDB SQL for the queries that SQL can express over whole tables."""

from tokenloom.llm import codes, licenses, partenum, resample

# A-Z alone are lower-cased: DuckDB's lower() would change other letters too
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LINE_KEY = _LOWER.format(r"regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')")



def _values(rows) -> str:
    return ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]::varchar[]"


_KNOWN = licenses.templates()
_WORDS = _values([(n, w) for n, t in enumerate(_KNOWN) for w in t.words])
_TEMPLATES = ", ".join(f"({n}, '{t.label}', {t.step}, {len(t.words)}, {t.least}, {_list(t.must)}, {_list(t.must_not)}, {_list(t.order)}, {_list(t.between)})" for n, t in enumerate(_KNOWN))
_STEPS = ", ".join(f"({s})" for s in licenses.STEPS)
_PHRASES = " union all ".join(
    f"select doc_id, '{label}' as label, i - 1 as place from placed where "
    + " and ".join(f"ws[i + {k}] = '{w}'" for k, w in enumerate(phrase.split()))
    for phrase, label in licenses.PHRASES.items()
)

def _assigned(n: int) -> str:
    """near{n}: each part with its distance to the nearest entry of the n-th codebooks, and that entry."""
    square = "list_sum(list_transform(range(1, len(part.v) + 1), lambda i: (part.v[i] - b.v[i]) * (part.v[i] - b.v[i])))::bigint"
    return f"""near{n} as materialized (select row, vec_id, label, p, v, min(struct_pack(d := d, e := e)) as best
    from (select row, vec_id, label, p, part.v, b.e, {square} as d from part join book{n} b using (p)) group by row, vec_id, label, p, v)"""


def _moved(n: int) -> str:
    """book{n + 1}: the n-th codebooks, their entries at the floors of the means."""
    return f"""component{n} as (select p, best.e as e, i, sum(x)::bigint as s, count(*) as c from (select p, best, unnest(v) as x, unnest(range(len(v))) as i from near{n}) group by all),
moved{n} as (select p, e, list((s - ((s % c) + c) % c) // c order by i) as v from component{n} group by p, e),
book{n + 1} as materialized (select b.p, b.e, coalesce(m.v, b.v) as v from book{n} b left join moved{n} m on m.p = b.p and m.e = b.e)"""


_ROUNDS = ",\n".join(f"{_assigned(n)},\n{_moved(n)}" for n in range(codes.ROUNDS))
_SHINGLE = " || ' ' || ".join(f"ws[i + {k}]" for k in range(partenum.SHINGLE))
_NUM, _DEN = partenum.LIKENESS
_FEATURE = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_FEATURES = f"regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_FEATURE}')"


ORACLE: dict[str, str] = {
    "op11_jaccard_join": f"""
with words as (select doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') as ws from documents),
run as (select doc_id, ws, unnest(range(1, greatest(len(ws) - {partenum.SHINGLE - 1}, 1) + 1)) as i from words where len(ws) > 0),
shingle as materialized (select distinct doc_id, case when len(ws) < {partenum.SHINGLE} then array_to_string(ws, ' ') else {_SHINGLE} end as s from run),
size as materialized (select doc_id, count(*) as n from shingle group by doc_id),
common as (select a.doc_id as a, b.doc_id as b, count(*) as n from shingle a join shingle b on a.s = b.s and a.doc_id < b.doc_id group by all),
link as materialized (select a, b from common join size x on x.doc_id = a join size y on y.doc_id = b where {_DEN} * common.n >= {_NUM} * (x.n + y.n - common.n)),
edge as materialized (select a, b from link union select b, a from link),
reach as (with recursive r(a, b) as (select a, b from edge union select r.a, edge.b from r join edge on r.b = edge.a) select a, min(b) as least from r group by a)
select d.doc_id, coalesce(size.n, 0) as n_shingles, least(d.doc_id, coalesce(reach.least, d.doc_id)) as component_id
from documents d left join size using (doc_id) left join reach on reach.a = d.doc_id
""",
    "op12_vector_codes": f"""
with kept as materialized (select row_number() over (order by vec_id nulls last, embedding) as row, vec_id, label, list_transform(embedding, lambda x: floor({codes.SCALE} * x::double)::bigint) as v
    from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
part as materialized (select row, vec_id, label, p, v[p * (len(v) // {codes.PARTS}) + 1 : (p + 1) * (len(v) // {codes.PARTS})] as v from kept, range({codes.PARTS}) t(p)),
book0 as materialized (select p, row - 1 as e, v from part where row <= {codes.ENTRIES}),
{_ROUNDS},
{_assigned(codes.ROUNDS)},
coded as (select vec_id, label, string_agg(format('{{:02x}}', best.e), '' order by p) as code, sum(best.d)::bigint as error from near{codes.ROUNDS} group by row, vec_id, label),
books as (select sha256(string_agg(array_to_string(v, ','), ',' order by p, e)) as h from book{codes.ROUNDS})
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, h as codebooks_sha256 from coded, books
""",
    "op13_resampling": f"""
with numbered as materialized (select row_number() over () as row, doc_id, {_FEATURES} as ws from documents),
word as materialized (select row, unnest(ws) as w from numbered),
wanted as materialized (select unnest({_FEATURES}) as w from benchmark),
step as (select list(list_reduce(list_prepend(b, list_transform(range(8), lambda k: 0::bigint)), lambda c, k: xor(c >> 1, (c & 1) * 3988292384)) order by b) as crcs from range(256) t(b)),
raw as (select w, list_prepend(4294967295::bigint, list_transform(range(0, strlen(w)), lambda i: ('0x' || substr(hex(w), 2 * i + 1, 2))::bigint)) as bytes from (select w from word union select w from wanted)),
crc as materialized (select w, xor(4294967295, list_reduce(bytes, lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1]))) % {resample.BUCKETS} as bucket from raw, step),
posting as materialized (select row, bucket, count(*) as n from word join crc using (w) group by all),
share as (select bucket, sum(n) as s from posting group by bucket),
target as (select bucket, count(*) as t from wanted join crc using (w) group by bucket),
total as (select (select coalesce(sum(s), 0) from share)::double as s, (select coalesce(sum(t), 0) from target)::double as t),
gain as (select bucket, floor(1000 * ln((coalesce(target.t, 0) + 1)::double * (total.s + {resample.BUCKETS}) / ((share.s + 1)::double * (total.t + {resample.BUCKETS}))))::bigint as gain
    from share left join target using (bucket), total),
weighed as (select row, sum(n * gain)::bigint as weight from posting join gain using (bucket) group by row),
scored as (select doc_id, len(ws)::bigint as n_features, coalesce(weight, 0) as weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{resample.SEED}:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint + 0.5) / 4294967296::double)))::bigint as score
    from numbered left join weighed using (row)),
placed as (select *, row_number() over (partition by n_features >= {resample.LEAST_WORDS} order by score desc, doc_id nulls last) as place, count(*) filter (where n_features >= {resample.LEAST_WORDS}) over () as able from scored)
select doc_id, n_features, weight, score, case when n_features >= {resample.LEAST_WORDS} and place <= able * {resample.PERCENT} // 100 then place end as rank from placed
""",
    "op3_license_scan": f"""
with low as (select doc_id, {_LOWER.format("coalesce(text, '')")} as t from documents),
words as (select doc_id, t, regexp_extract_all(t, '{licenses.WORD}') as ws from low),
placed as (select doc_id, ws, unnest(range(1, len(ws) + 1)) as i from words where list_contains(ws, 'license')),
base as ({_PHRASES}),
base_doc as (select doc_id, count(*) as n_base, min(place) as first_word, max(place) as last_word, list_sort(list(distinct label)) as labels from base group by doc_id),
template(template, label, step, n, least, must, must_not, seq, bars) as (values {_TEMPLATES}),
template_word(template, w) as (values {_WORDS}),
start as (select doc_id, ws, step, unnest(range(0, greatest(ceil(len(ws) / step) - 2, 0)::bigint + 1)) as k from words, (values {_STEPS}) s(step)),
block as materialized (select row_number() over () as b, doc_id, step, list_distinct(ws[k * step + 1 : k * step + 2 * step]) as own from start),
word as materialized (select b, doc_id, step, unnest(own) as w from block),
hit as (select doc_id, b, template, count(*) as c from word join template_word using (w) join template using (template, step) group by doc_id, b, template having count(*) >= any_value(least)),
held as materialized (select doc_id, template, label, max(c / n) as c, any_value(seq) as seq, any_value(bars) as bars from hit join template using (template) join block using (doc_id, b) where list_has_all(own, must) and not list_has_any(own, must_not) group by doc_id, template, label),
walked as (with recursive walk(doc_id, template, k, i) as (
    select doc_id, template, 1, i from (select doc_id, template, seq, ws, unnest(range(1, len(ws) + 1)) as i from held join words using (doc_id) where len(seq) > 0) where ws[i] = seq[1]
    union select w.doc_id, w.template, k + 1, j from (select w.*, h.seq, h.bars, d.ws, unnest(range(w.i + 1, w.i + {licenses.GAP} + 2)) as j from walk w join held h using (doc_id, template) join words d using (doc_id) where k < len(seq)) w
        where ws[j] = seq[k + 1] and not list_has_any(ws[w.i + 1 : j - 1], bars)) select doc_id, template, max(k) as k from walk group by doc_id, template),
found as (select doc_id, label, c * {licenses.SET_SCORE} as c from held where len(seq) = 0 union all select doc_id, label, 1.0 from held join walked using (doc_id, template) where k = len(seq)),
more as (select doc_id, list(distinct label) as labels, max(c) as score from found group by doc_id)
select w.doc_id, len(ws)::bigint as n_words, coalesce(n_base, 0) as n_base, first_word, last_word, coalesce(array_to_string(b.labels, ','), '') as base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(m.labels, [])))), ',') as labels,
       case when b.doc_id is not null then 1.0 else coalesce(m.score, 0.0) end as score
from words w left join base_doc b on b.doc_id = w.doc_id left join more m on m.doc_id = w.doc_id
""",
    "op6_suffix_dedup": """
with d as (select doc_id, encode(coalesce(text, '')) as b from documents),
w as (select doc_id, s, md5_number(b[s + 1 : s + 200]) as h from (select doc_id, b, unnest(range(0, octet_length(b) - 199)) as s from d where octet_length(b) >= 200)),
again as (select doc_id, s from w where h in (select h from w group by h having count(*) > 1)),
edge as (select *, coalesce(s - lag(s) over (partition by doc_id order by s) > 200, true) as new from again),
island as (select *, sum(new::int) over (partition by doc_id order by s) as k from edge),
span as (select doc_id, k, min(s) as lo, max(s) + 200 as hi from island group by doc_id, k),
piece as (select doc_id, lo, coalesce(lag(hi) over (partition by doc_id order by lo), 0) as after from span
          union all select d.doc_id, octet_length(b), coalesce(max(hi), 0) from d left join span on span.doc_id = d.doc_id group by d.doc_id, b),
kept as (select doc_id, string_agg(case when lo > after then hex(b[after + 1 : lo]) else '' end, '' order by lo, after) as x from piece join d using (doc_id) group by doc_id),
total as (select doc_id, sum(hi - lo)::bigint as n_removed, count(*) as n_spans from span group by doc_id)
select doc_id, octet_length(b)::bigint as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(x)) as kept_sha256
from d join kept using (doc_id) left join total using (doc_id)
""",
    "op4_line_dedup": f"""
with lines as (
    select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
           generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos
    from documents),
keyed as (select *, {_LINE_KEY} as key from lines),
heavy as (select key, max(doc_id) as last from keyed where length(key) >= 20 group by key having count(distinct doc_id) >= 3),
marked as (select k.*, coalesce(h.last <> k.doc_id, false) as gone from keyed k left join heavy h using (key))
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from marked group by doc_id
""",
}
