"""Scans, ingestion, limits, splits and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tokenloom import lexicon as L
from tokenloom.functions import text as T
from tokenloom.operators import corpus as C
from tokenloom.operators import shared
from tokenloom.operators import stats as S
from tokenloom.plans import dialect as D
from tokenloom.plans.registry import query, read
from tokenloom.sources import manifest, readers
from tokenloom.streaming import streams

LIMIT = 200


@query(f"select doc_id, trim(text) as text from documents where length(trim(text)) > 10 order by doc_id limit {LIMIT}")
def src_parquet_text(spark, sf):
    """First rows in id order of the texts over ten characters, for any number of rows."""
    texts = read(spark, sf, "documents").select("doc_id", F.trim("text").alias("text")).filter(F.length("text") > 10)
    return shared.prefix(texts, [F.col("doc_id")], LIMIT)


@query("select doc_id, trim(line) as text from (select doc_id, unnest(string_split(text, chr(10))) as line from documents) where trim(line) <> ''")
def src_lines(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).select("doc_id", F.trim("line").alias("text")).filter("text <> ''")


@query("select event_id, coalesce(case when json_valid(props) then json_extract_string(props, '$.k') end, case when not json_valid(props) then props end) as text from events where json_extract_string(case when json_valid(props) then props end, '$.k') is not null or not json_valid(props)")
def src_jsonl_field(spark, sf):
    """A field of JSON lines; rows without it go, lines that are no JSON stay as they are."""
    return readers.json_field(read(spark, sf, "events").select("event_id", "props"), "props", "k")


@query("select conv_id, (row_number() over (partition by conv_id order by turn) - 1)::int as i, text from conversations")
def src_json_array(spark, sf):
    """Sentences of a JSON array of strings or of objects with a text."""
    turns = read(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return readers.json_array(turns.select("conv_id", F.to_json(F.transform("t", lambda x: x["text"])).alias("json")), "json", ["conv_id"])


@query(f"""select doc_id, source, src_rank from (select doc_id, source, case source when 'src1' then 0 when 'src2' then 1 when 'src3' then 2 end as src_rank from documents)
    where src_rank is not null order by src_rank, doc_id limit {LIMIT}""")
def src_multi_priority(spark, sf):
    """Sources in a fixed order; the next one is used where the one before ends."""
    rank = F.when(F.col("source") == "src1", 0).when(F.col("source") == "src2", 1).when(F.col("source") == "src3", 2)
    ordered = read(spark, sf, "documents").select("doc_id", "source", rank.alias("src_rank")).filter("src_rank is not null")
    return shared.prefix(ordered, [F.col("src_rank"), F.col("doc_id")], LIMIT)


SCALES = (50, 100, 150)


@query("select scale, count(*) as n, max(doc_id) as last, sum(n_chars)::bigint as chars from (select doc_id, n_chars, row_number() over (order by doc_id) as r from documents) join (" + D.values([(s,) for s in SCALES]) + ") t(scale) on r <= scale group by scale")
def src_checkpoint_scales(spark, sf):
    """Nested first parts of one ordered corpus, cut by the counts of its ranges."""
    parts = shared.prefixes(read(spark, sf, "documents").select("doc_id", "n_chars"), [F.col("doc_id")], list(SCALES))
    return parts.groupBy(F.col("scale").cast("int").alias("scale")).agg(F.count("*").alias("n"), F.max("doc_id").alias("last"), F.sum("n_chars").alias("chars"))


@query(f"select doc_id, source, lang from documents order by doc_id limit {LIMIT}")
def limit_first_n(spark, sf):
    return shared.prefix(read(spark, sf, "documents").select("doc_id", "source", "lang"), [F.col("doc_id")], LIMIT)


@query("select count(*) as n, count(distinct kind) as kinds, sum(length(text))::bigint as chars from (select 'doc' as kind, text from documents union all select 'turn', text from conversations union all select 'item', text from benchmark)")
def union_stages(spark, sf):
    parts = [read(spark, sf, t).select(F.lit(k).alias("kind"), "text") for k, t in (("doc", "documents"), ("turn", "conversations"), ("item", "benchmark"))]
    made = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return made.agg(F.count("*").alias("n"), F.countDistinct("kind").alias("kinds"), F.sum(F.length("text")).alias("chars"))


@query("select text, min(doc_id) as doc_id, count(*) as copies from documents group by text")
def distinct_first(spark, sf):
    """Exact dedup that keeps the first: one row for each text with the smallest id, no row numbers needed."""
    return read(spark, sf, "documents").groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("select word from (select distinct unnest(string_split(lower(text), ' ')) as word from documents) intersect select distinct unnest(string_split(lower(text), ' ')) from benchmark")
def set_intersect(spark, sf):
    def words(t):
        return read(spark, sf, t).select(F.explode(F.split(F.lower("text"), " ")).alias("word"))

    return words("documents").intersect(words("benchmark"))


@query("select word from (select distinct unnest(string_split(lower(text), ' ')) as word from benchmark) except select distinct unnest(string_split(lower(text), ' ')) from documents")
def set_difference(spark, sf):
    def words(t):
        return read(spark, sf, t).select(F.explode(F.split(F.lower("text"), " ")).alias("word"))

    return words("benchmark").subtract(words("documents"))


@query("select distinct lang as key from documents union select distinct role from conversations")
def set_union_keys(spark, sf):
    return read(spark, sf, "documents").select(F.col("lang").alias("key")).union(read(spark, sf, "conversations").select("role")).distinct()


@query(f"""with {D.SENT}, {D.NORM}, {D.WORD}, gen as (select distinct word, token from word join ({D.values(L.RELATIONS.items())}) r(word, token) using (word)), src as (select * from ({D.values(L.RELATIONS.items())}) r(word, token))
    select 'generated' as side, word, token from (select * from gen except all select * from src) union all select 'source', word, token from (select * from src except all select * from gen)""")
def cat_table_drift(spark, sf):
    """Rows that only one of two tables has: the relation table against the one that the corpus's words give back from a file."""
    source = C.table(spark, list(L.RELATIONS.items()), "word string, token string")
    path = shared.folder(spark, "relations")
    C.words(C.sentences(read(spark, sf, "documents"))).select("word").distinct().join(F.broadcast(source), "word").select("word", "token").write.json(path)
    made = spark.read.schema("word string, token string").json(path)
    return made.exceptAll(source).select(F.lit("generated").alias("side"), "word", "token").unionByName(source.exceptAll(made).select(F.lit("source").alias("side"), "word", "token"))


@query(f"with {D.SENT} select doc_id, pos, sent from sent")
def sent_split(spark, sf):
    return C.sentences(read(spark, sf, "documents")).select("doc_id", "pos", "sent")


@query(f"with {D.SENT} select doc_id, pos, sent from sent where length(sent) between 20 and 300 and length(regexp_replace(sent, '[^A-Za-z]', '', 'g')) / length(sent) >= 0.5")
def sent_quality_filter(spark, sf):
    return C.sentences(read(spark, sf, "documents")).select("doc_id", "pos", "sent").filter(F.length("sent").between(20, 300) & (T.share_in(F.col("sent"), "A-Za-z") >= 0.5))


@query("""with t as (select doc_id, row_number() over (order by doc_id) as r, count(*) over () as n from documents) select doc_id, case when r <= floor(n * 0.9) then 'train' else 'val' end as split from t""")
def split_90_10(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id")
    n = docs.count()
    ranked = shared.ranked(docs, [F.col("doc_id")], "r")
    return ranked.select("doc_id", F.when(F.col("r") <= int(n * 0.9), "train").otherwise("val").alias("split"))


@query("""with t as (select doc_id, row_number() over (order by md5('7:' || doc_id), doc_id) as r, count(*) over () as n from documents) select doc_id, case when r <= greatest(1, floor(n * 0.1)) then 'val' else 'train' end as split from t""")
def split_shuffled(spark, sf, fraction=0.1, seed=7):
    """A seeded shuffle: hashes of ids order the rows, the first part validates."""
    docs = read(spark, sf, "documents").select("doc_id", F.md5(F.concat_ws(":", F.lit(seed), "doc_id")).alias("h"))
    n = max(1, int(docs.count() * fraction))
    ranked = shared.ranked(docs, [F.col("h"), F.col("doc_id")], "r")
    return ranked.select("doc_id", F.when(F.col("r") <= n, "val").otherwise("train").alias("split"))


@query("""with t as (select doc_id, quality, row_number() over (partition by quality order by doc_id) as r, count(*) over (partition by quality) as n from labels)
    select doc_id, quality, case when r <= floor(n * 0.1) then 'test' when r <= floor(n * 0.1) + floor(n * 0.1) then 'val' else 'train' end as split from t""")
def split_stratified(spark, sf):
    """Test, then validation, then training rows of each label: ranks over all labels, less those before the label's own."""
    each = _by_class(read(spark, sf, "labels").select("doc_id", "quality"))
    tenth = F.floor(F.col("n") * 0.1)
    return each.select("doc_id", "quality", F.when(F.col("r") <= tenth, "test").when(F.col("r") <= 2 * tenth, "val").otherwise("train").alias("split"))


def _by_class(labels):
    """labels with r, the rank within their class, and n, its rows: no class is in one task."""
    numbered = shared.ranked(labels, [F.col("quality"), F.col("doc_id")], "all")
    sizes = numbered.groupBy("quality").agg((F.min("all") - 1).alias("before"), F.count("*").alias("n"))  # a row for each class
    return numbered.join(F.broadcast(sizes), "quality").withColumn("r", F.col("all") - F.col("before"))


@query("""with t as (select doc_id, quality, row_number() over (partition by quality order by doc_id) as r from labels), m as (select min(n) as m from (select count(*) as n from labels group by quality))
    select doc_id, quality from t, m where r <= m""")
def balance_by_answer(spark, sf):
    """As many rows of each class as the smallest has, those with the smallest ids."""
    each = _by_class(read(spark, sf, "labels").select("doc_id", "quality"))
    least = each.agg(F.min("n").alias("least"))
    return each.join(F.broadcast(least)).filter("r <= least").select("doc_id", "quality")


@query("select source, lang, count(*) as n, sum(n_chars)::bigint as chars, grouping_id(source, lang) as level from documents group by grouping sets ((source, lang), (source), (lang), ())")
def agg_manifest(spark, sf):
    """Counts for each source, language and over all, in one pass; snk_manifest counts written files."""
    docs = read(spark, sf, "documents").select("source", "lang", "n_chars")
    return docs.groupingSets([["source", "lang"], ["source"], ["lang"], []], "source", "lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.grouping_id("source", "lang").alias("level"))


@query("""with r as (select 'stage-' || source as file, lang, (n_chars % 3 + 1)::varchar as category, case when doc_id % 4 = 0 then 'mit' else 'cc-by-4.0' end as license from documents),
    k as (select file, unnest([{'kind': 'total', 'key': ''}, {'kind': 'lang', 'key': lang}, {'kind': 'license', 'key': license}, {'kind': 'category', 'key': category}]) as x from r)
    select file, x.kind as kind, x.key as key, count(*) as n from k group by all""")
def snk_manifest(spark, sf):
    """Records written as JSON lines in two runs, each followed by a manifest that only reads the files it lacks."""
    none = F.lit(None).cast("string")
    meta = F.struct(F.col("source"), F.when(F.col("doc_id") % 4 == 0, "mit").otherwise("cc-by-4.0").alias("license"), none.alias("translated_from"), none.alias("difficulty"))
    docs = read(spark, sf, "documents")
    records = docs.select(
        F.concat(F.lit("stage-"), "source").alias("file"), F.col("doc_id").cast("string").alias("id"), "lang", (F.col("n_chars") % 3 + 1).cast("int").alias("category"), F.col("text").alias("question"),
        F.array().cast("array<string>").alias("cot"), F.lit("").alias("answer"), meta.alias("meta"),
    )
    folder, at = shared.folder(spark, "records"), shared.folder(spark, "manifest")
    for part in (F.col("id").cast("long") % 2 == 0, F.col("id").cast("long") % 2 != 0):
        manifest.write_records(records.filter(part), folder)
        manifest.update(spark, folder, at)
    return manifest.summary(spark, at)


@query("select role, conv_id, turn from (select role, conv_id, turn, row_number() over (partition by role order by conv_id, turn) as r from conversations) where r <= 25")
def topk_per_bucket(spark, sf):
    """The first 25 of each bucket; the window's rank limit is pushed below the shuffle."""
    turns = read(spark, sf, "conversations").select("role", "conv_id", "turn")
    return turns.withColumn("r", F.row_number().over(Window.partitionBy("role").orderBy("conv_id", "turn"))).filter("r <= 25").drop("r")


_SEEN = f"""w as (select word, count(*) as n, min((doc_id, pos, i)) as first from word group by word), b as (select word, n, first, least(length(word), 4) as bucket from w),
    s as (select *, row_number() over (partition by bucket order by first) as r from b), t as (select *, row_number() over (partition by bucket order by n desc, word) as k from s where r <= 200)"""


@query(f"with {D.SENT}, {D.NORM}, {D.WORD}, {_SEEN} select bucket::int as bucket, word, n, k::int as k from t where k <= 50")
def topk_first_seen(spark, sf):
    """Examples of each bucket: of the first 200 words seen the 50 most frequent; buckets are words of one to four and more letters.

    Windows only see a row for each word, and both rank limits are pushed below their shuffles.
    """
    words = C.words(C.sentences(read(spark, sf, "documents"))).groupBy("word").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "pos", "i")).alias("first"))
    return S.examples(words.withColumn("bucket", F.least(F.length("word"), F.lit(4))), "bucket", "first", ["word"], seen=200, most=50).drop("first")


@query("""with q as (select conv_id, turn, role, text from conversations where role = 'user'), a as (select conv_id, turn, text from conversations where role = 'assistant')
    select q.conv_id as id, q.turn, q.text as question, a.text as answer from q join a on a.conv_id = q.conv_id and a.turn = q.turn + 1""")
def src_records(spark, sf):
    """Question and answer records from conversations."""
    return readers.question_answers(read(spark, sf, "conversations"))


_WHOLE = f"""lexed as (select doc_id, {D.lex_english('text')} as d from documents), kept as (select *, {D.reasoning_kept('d', L.REASONING_EN)} as k from lexed), tokens as (select doc_id, d, {D.reasoning_collapse('k')} as r from kept)"""


@query(f"with {_WHOLE} select doc_id, len(d)::int as n_default, len(r)::int as n_reasoning from tokens")
def stream_tokenize(spark, sf):
    """A directory stream through the stateless lexer, as one run over what is there."""
    return streams.tokenize_once(spark, f"{sf}/documents.parquet")


@query(f"with {_WHOLE} select token, count(*) as n from (select unnest(d) as token from tokens) group by token")
def stream_token_counts(spark, sf):
    """Running token counts of a directory stream: the last complete result."""
    return streams.count_once(spark, f"{sf}/documents.parquet")


@query("select distinct user_id, event_type from events")
def stream_dedup(spark, sf):
    """Equal keys of a stream once, within a delay that covers the table."""
    return streams.dedup_once(spark, f"{sf}/events.parquet", "ts", ["user_id", "event_type"], "3650 days")


@query("select date_trunc('hour', ts) as hour, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def stream_windowed_counts(spark, sf):
    """An extension of this engine: events by hour and type with a watermark, as a stream."""
    return streams.windows_once(spark, f"{sf}/events.parquet", "ts")
