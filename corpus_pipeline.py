"""A corpus pipeline: quality, line dedup, near-duplicates, repeated passages and packing, one stage after the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.llm import common, lines, packing, quality, simhash, suffixes

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

def _with_text(made: DataFrame) -> DataFrame:
    """The columns of documents with what was kept as text; a null text stays null."""
    kept = F.when(F.col("text").isNotNull(), F.col("kept").cast("string"))
    return made.withColumn("text", kept).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is below the threshold go."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs.select(*COLUMNS), model, carry=COLUMNS).filter(F.col("score") >= quality.THRESHOLD).drop("score")


def stage_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Long lines of three documents or more stay in the last one only."""
    return _with_text(lines.drop_repeated_lines(docs, carry=COLUMNS))


def stage_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of near texts connect (Jaccard likeness of five-word shingles 0.8 or more) one stays.

    That is the one with the smallest id, then text digest. Rows are told apart by id and text: rows that share an id,
    or have none, only go for their texts. Of a repeated row, one stays at most.
    """
    made = common.stored(simhash.alike_groups(docs))
    best = made.groupBy("root").agg(F.min(F.struct("id", "digest")).alias("row")).select("row.*")
    times = made.groupBy("id", "digest").count()
    again = best.join(times, ["id", "digest"]).filter("count > 1").select("id", "digest")
    # all that must not pass as it is: rows that are not the first of their group, and rows that occur more than once
    held = times.join(best, ["id", "digest"], "left_anti").select("id", "digest").union(again)
    id_, digest = common.key_columns()
    keyed = docs.select(*COLUMNS, id_.alias("_id"), digest.alias("_digest"))

    def on(other: DataFrame):
        return (keyed["_id"] == other["id"]) & (keyed["_digest"] == other["digest"])

    passed = keyed.join(held, on(held), "left_anti").select(*COLUMNS)
    one = keyed.join(again, on(again), "left_semi").groupBy("_id", "_digest").agg(F.min(F.struct(*COLUMNS)).alias("row")).select("row.*")
    return passed.unionByName(one)


def stage_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of 200-byte strings that also start elsewhere go."""
    return _with_text(suffixes.remove_repeats(docs, carry=COLUMNS, as_text=True))


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens with their places in sequences."""
    return packing.packed_digests(docs)


STAGES = [
    ("quality_classifier", stage_quality),
    ("line_dedup", stage_lines),
    ("simhash_near_dedup", stage_near),
    ("suffix_array_dedup", stage_repeats),
    ("best_fit_packing", stage_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's rows written and read again as the next one's. Folders that are no longer needed go."""
    docs, before = common.documents(spark, sf_dir), common.mark()
    for _, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir))
        common.sweep(spark, before, docs)
    return docs


#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None
