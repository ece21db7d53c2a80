"""Structured Streaming variants: stateless tokenizing, running counts and dedup.

windowed_counts is an extension of this engine: the corpora it was made for have no event times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.functions import tokens as K
from tokenloom.operators import shared


def source(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def tokenized(stream: DataFrame) -> DataFrame:
    """(doc_id, tokens, reasoning): narrow, so it runs in append mode without state."""
    lexed = stream.select("doc_id", K.lex_english(F.col("text")).alias("tokens"))
    return lexed.withColumn("kept", K.reasoning_kept(F.col("tokens"), "en")).select("doc_id", "tokens", K.reasoning_collapse(F.col("kept")).alias("reasoning"))


def token_counts(stream: DataFrame) -> DataFrame:
    """Running counts; the state has a row for each token, for complete or update mode."""
    return tokenized(stream).select(F.explode("tokens").alias("token")).groupBy("token").count()


def _timed(stream: DataFrame, time_col: str) -> DataFrame:
    """Watermarks want instants: times without a zone are read in the session's."""
    return stream.withColumn(time_col, F.col(time_col).cast("timestamp"))


def deduplicated(stream: DataFrame, time_col: str, delay: str, keys: list[str] | None = None) -> DataFrame:
    """Rows with equal keys (texts, if not said otherwise) within the delay once; the watermark bounds the state."""
    return _timed(stream, time_col).withWatermark(time_col, delay).dropDuplicatesWithinWatermark(keys or ["text"])


def windowed_counts(stream: DataFrame, time_col: str, width: str, delay: str) -> DataFrame:
    return _timed(stream, time_col).withWatermark(time_col, delay).groupBy(F.window(time_col, width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def windowed_coverage(texts: DataFrame, events: DataFrame, *, width: str, within: str, delay: str) -> DataFrame:
    """(window, event_type, n, tokens, structured): events that fall on texts, by window and type, and how much of the texts is structured.

    texts (key, ts, text) and events (key, ts, event_type) are streams with watermarks of their own. An event belongs to each
    text of its key that came within the interval before it; so state is kept for that long, behind the slower stream. Windows
    come out once they are closed, and rows that are later than the delay are dropped.

    Rows of a key and an instant are added up on both sides before they meet, and sums meet by key and slot of time: a slot
    is as long as the interval, so a text's events are in its own or in the next one.
    """
    tokens = K.unmark(K.lex_english(F.col("text")))
    shown = _timed(texts, "ts").select("key", F.col("ts").alias("at"), tokens.alias("t")).select(
        "key", "at", F.size("t").cast("long").alias("tokens"), F.size(F.filter("t", lambda t: ~t.startswith("ROOT:") & ~t.startswith("LIT:"))).cast("long").alias("structured")
    )
    left = _timed(events, "ts").select(F.col("key").alias("of"), "ts", "event_type").withWatermark("ts", delay)
    left = left.groupBy("of", "ts", "event_type").agg(F.count("*").alias("n_events"))
    right = shown.withWatermark("at", delay).groupBy("key", "at").agg(F.count("*").alias("n_texts"), F.sum("tokens").alias("tokens"), F.sum("structured").alias("structured"))

    def slot(ts: str) -> Column:
        return F.floor(F.unix_micros(ts) / F.expr(f"unix_micros(timestamp_seconds(0) + interval {within})"))

    left = left.withColumn("slot_of", slot("ts"))
    right = right.withColumn("slot", F.explode(F.array(slot("at"), slot("at") + 1)))
    on = (F.col("of") == F.col("key")) & (F.col("slot_of") == F.col("slot")) & (F.col("ts") >= F.col("at")) & (F.col("ts") <= F.col("at") + F.expr(f"interval {within}"))
    sums = {"n": F.col("n_events") * F.col("n_texts"), "tokens": F.col("n_events") * F.col("tokens"), "structured": F.col("n_events") * F.col("structured")}
    return left.join(right, on).groupBy(F.window("ts", width), "event_type").agg(*(F.sum(x).alias(c) for c, x in sums.items()))


def run_steps(spark: SparkSession, made: DataFrame, feeds) -> DataFrame:
    """Run a stream once after each of the feeds, functions that add to its sources, from one checkpoint; all rows it appended."""
    at = shared.folder(spark, "stream")
    for feed in feeds:
        feed()
        writer = made.writeStream.outputMode("append").option("checkpointLocation", f"{at}/state").trigger(availableNow=True)
        writer.format("parquet").option("path", f"{at}/out").start().awaitTermination()
    return spark.read.schema(made.schema).parquet(f"{at}/out")


def run_once(spark: SparkSession, made: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what is there into a table in the shared folder, and read that.

    Files have no updates: in complete mode each batch writes the whole result anew, and the last one stands.
    """
    at = shared.folder(spark, "stream")
    writer = made.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True)
    if mode == "append":
        writer = writer.format("parquet").option("path", f"{at}/out")
    else:
        writer = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{at}/out"))
    writer.start().awaitTermination()
    return spark.read.schema(made.schema).parquet(f"{at}/out")


def _table(spark: SparkSession, path: str) -> DataFrame:
    """A stream over the table at path, a folder of files or one file: of a file's folder nothing else is read."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    schema = spark.read.parquet(path).schema
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory():
        return source(spark, path, schema)
    return spark.readStream.schema(schema).option("pathGlobFilter", where.getName()).parquet(where.getParent().toString())


def tokenize_once(spark: SparkSession, path: str) -> DataFrame:
    made = run_once(spark, tokenized(_table(spark, path)))
    return made.select("doc_id", F.size("tokens").alias("n_default"), F.size("reasoning").alias("n_reasoning"))


def count_once(spark: SparkSession, path: str) -> DataFrame:
    return run_once(spark, token_counts(_table(spark, path)), "complete").select("token", F.col("count").alias("n"))


def dedup_once(spark: SparkSession, path: str, time_col: str, keys: list[str], delay: str) -> DataFrame:
    return run_once(spark, deduplicated(_table(spark, path), time_col, delay, keys).select(*keys))


def windows_once(spark: SparkSession, path: str, time_col: str) -> DataFrame:
    made = run_once(spark, windowed_counts(_table(spark, path), time_col, "1 hour", "2 hours"), "complete")
    return made.select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "event_type", "n", F.round("total", 4).alias("total"))


def coverage_in_steps(spark: SparkSession, texts: DataFrame, events: DataFrame, steps: int, *, width: str = "1 day", within: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """windowed_coverage of texts (step, key, ts, text) and events (step, key, ts, event_type) that arrive in so many steps."""
    at = shared.folder(spark, "feed")
    given = {"texts": texts, "events": events}

    def feed(n: int):
        for name, df in given.items():
            df.filter(F.col("step") == n).drop("step").write.mode("append").parquet(f"{at}/{name}")

    for name, df in given.items():  # the folders have to be there before the streams are
        df.limit(0).drop("step").write.parquet(f"{at}/{name}")
    left, right = (source(spark, f"{at}/{name}", df.drop("step").schema) for name, df in given.items())
    made = windowed_coverage(left, right, width=width, within=within, delay=delay)
    return run_steps(spark, made, [lambda n=n: feed(n) for n in range(steps)])
