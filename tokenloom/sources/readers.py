"""Readers of sentence files and records, and writers of results. Schemas are given, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as t

from tokenloom.functions import text as T

RECORD = t.StructType(
    [
        t.StructField("id", t.StringType()), t.StructField("lang", t.StringType()), t.StructField("category", t.IntegerType()), t.StructField("question", t.StringType()),
        t.StructField("cot", t.ArrayType(t.StringType())), t.StructField("answer", t.StringType()),
        t.StructField("meta", t.StructType([t.StructField(n, t.StringType()) for n in ("source", "license", "translated_from", "difficulty")])),
    ]
)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(text) of each line that is not empty."""
    return spark.read.text(path).select(F.trim("value").alias("text")).filter("text <> ''")


def json_field(df: DataFrame, column: str, field: str) -> DataFrame:
    """df with text for column: the field of a JSON object; an object without it goes, what is no JSON stays whole."""
    parsed = F.try_parse_json(column) if hasattr(F, "try_parse_json") else F.get_json_object(column, "$")
    value = F.get_json_object(column, f"$.{field}")
    text = F.when(parsed.isNull(), F.col(column)).otherwise(value)
    return df.withColumn("text", text).filter("text is not null").drop(column)


def json_array(df: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """(keys, i, text) of a JSON array of strings, or of objects with a text field."""
    strings = F.from_json(column, t.ArrayType(t.StringType()))
    each = df.select(*keys, F.posexplode(strings).alias("i", "raw"))
    own = F.when(F.col("raw").startswith("{"), F.coalesce(F.get_json_object("raw", "$.text"), F.col("raw"))).otherwise(F.col("raw"))
    return each.select(*keys, "i", own.alias("text"))


def records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RECORD).json(path)


def question_answers(turns: DataFrame) -> DataFrame:
    """(id, turn, question, answer): a user's turn and the assistant's next one."""
    asked = turns.filter("role = 'user'").select(F.col("conv_id").alias("id"), "turn", F.col("text").alias("question"))
    given = turns.filter("role = 'assistant'").select(F.col("conv_id").alias("id"), (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return asked.join(given, ["id", "turn"])


def _record(id_, lang, category: int, question, answer, cot=None, **meta):
    """The columns of a reasoning record."""
    none = F.lit(None).cast("string")
    given = {n: meta.get(n, none) for n in ("source", "license", "translated_from", "difficulty")}
    return [
        id_.alias("id"), lang.alias("lang"), F.lit(category).alias("category"), question.alias("question"), (F.array().cast("array<string>") if cot is None else cot).alias("cot"), answer.alias("answer"),
        F.struct(*((F.lit(v) if isinstance(v, str) else v).alias(n) for n, v in given.items())).alias("meta"),
    ]


def nli_records(pairs: DataFrame) -> DataFrame:
    """Records of category 1 from pairs (idx, lang, premise, hypothesis, label 0 to 2); pairs with an empty part go, ids keep the index.

    English and Arabic have templates and labels of their own.
    """
    english = F.col("lang") == "en"
    premise, hypothesis = F.trim(F.coalesce("premise", F.lit(""))), F.trim(F.coalesce("hypothesis", F.lit("")))
    said = {lang: F.concat(F.lit(p), premise, F.lit(h), hypothesis, F.lit(q)) for lang, (p, h, q) in NLI_QUESTIONS.items()}
    asked = F.when(english, said["en"]).otherwise(said["ar"])
    label = F.when(english, F.element_at(F.array(*map(F.lit, NLI_LABELS["en"])), F.col("label") + 1)).otherwise(F.element_at(F.array(*map(F.lit, NLI_LABELS["ar"])), F.col("label") + 1))
    kept = pairs.filter((premise != "") & (hypothesis != ""))
    return kept.select(*_record(F.format_string("xnli-%s-%07d", "lang", "idx"), F.col("lang"), 1, asked, label, source="xnli", license="cc-by-nc-4.0"))


# What stands before the premise, between it and the hypothesis, and behind that.
NLI_QUESTIONS = {
    "en": ("Premise: ", "\nHypothesis: ", "\nDoes the premise entail, contradict, or stay neutral to the hypothesis?"),
    "ar": ("المقدمة: ", "\nالفرضية: ", "\nهل تستلزم المقدمة الفرضية أم تناقضها أم محايدة؟"),
}
# Answers by label.
NLI_LABELS = {"en": ["entails", "neutral", "contradicts"], "ar": ["يستلزم", "محايد", "يناقض"]}


def solution_records(rows: DataFrame) -> DataFrame:
    """Records of category 3 from worked solutions (idx, question, solution): the answer stands behind the last ####."""
    made = rows.withColumn("s", T.answer_after_hashes(F.trim("solution")))
    return made.select(*_record(F.format_string("gsm8k-en-%06d", "idx"), F.lit("en"), 3, F.trim("question"), F.col("s.answer"), F.col("s.steps"), source="gsm8k", license="mit", difficulty="medium"))


ENGINE = "id string, lang string, question string, cot array<string>, answer string, difficulty string, meta struct<question_cst: array<string>, cot_cst: array<array<string>>, answer_cst: array<string>>"


def engine_records(lines_: DataFrame) -> DataFrame:
    """Records of category 2 from an algebra engine's JSON lines (text), with the tokens it has made already; empty lines go."""
    each = lines_.filter(F.trim("text") != "").select(F.from_json("text", ENGINE).alias("x")).select("x.*")
    own = _record(F.concat(F.lit("algebra-"), F.col("id")), F.col("lang"), 2, F.col("question"), F.col("answer"), F.coalesce("cot", F.array().cast("array<string>")), source="algebra-engine", license="isc", difficulty=F.coalesce("difficulty", F.lit("medium")))
    return each.select(*own, F.col("meta.question_cst").alias("question_cst"), F.col("meta.cot_cst").alias("cot_cst"), F.col("meta.answer_cst").alias("answer_cst"))


def record_kind(json):
    """What a JSON record is, by which fields it has: encoded for logic, a reasoning record, a verifier's example, or a plain text."""
    keys = F.json_object_keys(json)

    def has(*names):
        made = F.array_contains(keys, names[0])
        for n in names[1:]:
            made = made & F.array_contains(keys, n)
        return made

    return F.when(has("q_ids"), "logic").when(has("input_tokens", "label"), "verifier").when(has("question", "answer"), "reasoning").when(has("text"), "text").otherwise("unknown")


def _document(spark: SparkSession, folder: str, name: str):
    """The JSON document of that name in a folder, or None where there is none."""
    import json

    path = f"{folder.rstrip('/')}/{name}.json"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return None
    return json.loads(spark.read.text(path, wholetext=True).first()["value"])


def read_lexicon(spark: SparkSession, folder: str):
    """A corpus.Lexicon from a folder of JSON tables; a table that isn't there is the own small one.

    relation_map {word: token}, function_words [word], role_overrides {word: role}, prefix_roles and suffix_roles
    ({affix: role} or [[affix, role]], in order), lemmas {word: lemma}, semantic_fields {spelling: field}, entities [word].
    Each closed table is one document and is read whole; lemmas, fields and entities become DataFrames.
    """
    from tokenloom.operators import corpus

    def pairs(table):
        return [tuple(x) for x in (table.items() if isinstance(table, dict) else table)]

    made = corpus.Lexicon()
    for field, name, kind in (("relations", "relation_map", dict), ("functions", "function_words", list), ("overrides", "role_overrides", dict), ("prefixes", "prefix_roles", pairs), ("suffixes", "suffix_roles", pairs)):
        if (found := _document(spark, folder, name)) is not None:
            setattr(made, field, kind(found))
    for field, name, schema in (("lemmas", "lemmas", "word string, lemma string"), ("fields", "semantic_fields", "spelling string, field string"), ("entities", "entities", "word string")):
        if (found := _document(spark, folder, name)) is not None:
            setattr(made, field, spark.createDataFrame([(w,) for w in found] if isinstance(found, list) else list(found.items()), schema))
    return made


def read_arabic_lexicon(spark: SparkSession, folder: str):
    """An arabic.Lexicon from a folder; a table that isn't there is the own one.

    JSON documents: marks, relations, months and patterns {word: value}, literals and numerals [word]. Roots are rows and may
    be many: roots.jsonl has {"root": dotted or plain, "field": ...} lines. Their weak spellings are derived by root_closure.
    """
    from tokenloom.operators import arabic

    made = arabic.Lexicon()
    for name, kind in (("marks", dict), ("relations", dict), ("months", dict), ("patterns", dict), ("literals", list), ("numerals", list)):
        if (found := _document(spark, folder, name)) is not None:
            setattr(made, name, kind(found))
    path = f"{folder.rstrip('/')}/roots.jsonl"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        made.roots = dotted_roots(spark.read.schema("root string, field string").json(path))
    return made


def dotted_roots(rows: DataFrame) -> DataFrame:
    """(root, field) with the letters of each root dotted; comments, blanks and roots of other than three to five letters go."""
    letters = F.regexp_extract_all(F.coalesce("root", F.lit("")), F.lit("[^. \\t]"), F.lit(0))
    kept = rows.filter(~F.coalesce("root", F.lit("")).startswith("#") & F.size(letters).between(3, 5))
    return kept.select(F.array_join(letters, ".").alias("root"), "field").distinct()


def write_examples(df: DataFrame, path: str) -> None:
    """(ids, tokens, text) as JSON lines; null fields are left out."""
    df.select("ids", "tokens", "text").write.mode("overwrite").json(path)


def write_vocabulary(vocab: DataFrame, path: str) -> None:
    vocab.select("token", "id").write.mode("overwrite").json(path)


def write_labels(top: DataFrame, path: str) -> None:
    """Surfaces by count with blank columns for labels by hand, as tab-separated values."""
    top.select("surface", "n", F.lit("").alias("root"), F.lit("").alias("field")).write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def markdown_row(*columns: str):
    """A line of a Markdown table from columns."""
    return F.concat(F.lit("| "), F.concat_ws(" | ", *(F.col(c).cast("string") for c in columns)), F.lit(" |"))


def cached(spark: SparkSession, path: str, make) -> DataFrame:
    """The table at path if it is there, else what make() gives, written there first."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        make().write.parquet(path)
    return spark.read.parquet(path)


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(lang, token, id) from any of the known layouts: {token: id}, {id: token}, {"token_to_id": ...}, [token, ...], [{token, id}, ...] or {lang: {token: id}}.

    A vocabulary is one document that has to be parsed whole, on one executor. Layouts by language are merged:
    specials first, then all tokens by name. [PAD] and [UNK] are added where they are missing.
    """
    import json

    def parse(rows):
        for row in rows:
            blob = json.loads(row.value)
            if isinstance(blob, dict) and isinstance(blob.get("token_to_id"), dict):
                blob = blob["token_to_id"]
            if isinstance(blob, list):
                pairs = [(x["token"], x["id"]) if isinstance(x, dict) else (x, i) for i, x in enumerate(blob)]
            elif all(isinstance(v, dict) for v in blob.values()):
                merged = {tok for part in blob.values() for tok in part}
                first = [s for s in ("[PAD]", "[UNK]", "[BOS]", "[EOS]", "[SEP]", "[Q]") if s in merged]
                pairs = [(tok, i) for i, tok in enumerate(first + sorted(merged - set(first)))]
            elif all(isinstance(v, str) for v in blob.values()):
                pairs = [(v, int(k)) for k, v in blob.items()]
            else:
                pairs = [(k, int(v)) for k, v in blob.items()]
            known = {tok for tok, _ in pairs}
            top = max((i for _, i in pairs), default=-1)
            for s in ("[PAD]", "[UNK]"):
                if s not in known:
                    top += 1
                    pairs.append((s, top))
            yield from pairs

    from collections.abc import Iterator

    import pandas as pd

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame(list(parse(frame.itertuples())), columns=["token", "id"])

    return spark.read.text(path, wholetext=True).mapInPandas(run, "token string, id long")
