"""Manifests of written record files: counts by file, language, license and category, which only read files they lack."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.sources import readers

SCHEMA = "path string, length long, modified timestamp, file string, kind string, key string, n long"


def write_records(records: DataFrame, folder: str) -> None:
    """records (file, and the columns of readers.RECORD) as JSON lines, a folder for each value of file; later runs add to it."""
    records.write.mode("append").partitionBy("file").json(folder)


def _plain(path: Column) -> Column:
    """A path without its scheme, as listings and scans write it in different ways."""
    return F.regexp_replace(path, "^[a-z]+:/+", "/")


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, modified) of the files below a folder; their contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(folder)
    return files.select("path", "length", F.col("modificationTime").alias("modified"))


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def known(spark: SparkSession, manifest: str) -> DataFrame:
    if not _exists(spark, f"{manifest.rstrip('/')}"):
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).parquet(manifest)


def update(spark: SparkSession, folder: str, manifest: str) -> int:
    """Add the counts of all files that the manifest lacks; the number of files that were read.

    A file is known by path, length and time of change. The driver gets the paths of new files, as it does to plan any
    scan. Each new file's records are counted over all, and by language, license and category, in one pass.
    """
    have = known(spark, manifest).select(_plain(F.col("path")).alias("path"), "length", "modified").distinct()
    files = listed(spark, folder).withColumn("at", F.col("path")).withColumn("path", _plain(F.col("path")))
    new = [r["at"] for r in files.join(have, ["path", "length", "modified"], "left_anti").select("at").collect()]
    if not new:
        return 0
    at = _plain(F.col("_metadata.file_path"))
    rows = spark.read.schema(readers.RECORD).json(new).select(
        at.alias("path"), F.col("_metadata.file_size").alias("length"), F.col("_metadata.file_modification_time").alias("modified"), F.regexp_extract(at, "/file=([^/]+)/", 1).alias("file"),
        "lang", F.col("meta.license").alias("license"), F.col("category").cast("string").alias("category"),
    )
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), (F.lit("") if k == "total" else F.col(k)).alias("key")) for k in ("total", "lang", "license", "category")))
    each = rows.select("path", "length", "modified", "file", F.explode(kinds).alias("x")).select("path", "length", "modified", "file", "x.kind", "x.key")
    counts = each.groupBy("path", "length", "modified", "file", "kind", "key").agg(F.count("*").alias("n"))
    counts.write.mode("append").parquet(manifest)
    return len(new)


def summary(spark: SparkSession, manifest: str) -> DataFrame:
    """(file, kind, key, n): kinds are total, lang, license and category."""
    return known(spark, manifest).groupBy("file", "kind", "key").agg(F.sum("n").alias("n"))
