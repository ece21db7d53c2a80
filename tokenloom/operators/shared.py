"""What operators share: tables in the folder that driver and executors have, ranks over any number of rows, checked broadcasts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows that a small table may have to be broadcast by hand, or held as a literal; larger ones are left to Spark.
BROADCAST_ROWS = 50_000

_own_dir: list[str] = []


def importable(spark: SparkSession) -> None:
    """Let Python workers of a local session import this package, wherever the driver was started."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def folder(spark: SparkSession, name: str = "table") -> str:
    """A new folder name below spark.checkpoint.dir.

    Where that is unset, a local session gets a temporary folder that goes with the process; on a cluster it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _own_dir:
            _own_dir.append(tempfile.mkdtemp(prefix="tokenloom-"))
            atexit.register(shutil.rmtree, _own_dir[0], ignore_errors=True)
        base = f"file://{_own_dir[0]}"
    return f"{base.rstrip('/')}/{name}-{os.urandom(8).hex()}"


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read from there: made once, and lost executors cost nothing."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows below which a table is not dealt out anew.
SPREAD_ROWS = 1_000


def spread(df: DataFrame, key: str) -> DataFrame:
    """df as it is read, or dealt out by a key where its files leave cores without work.

    A row group is read by one task, however large it is. Rows of each task are counted, for which footers are enough; if one
    has more than twice its share, the columns that are used go through one shuffle.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]  # a row for each task
    if sum(sizes) < SPREAD_ROWS or max(sizes) * slots <= 2 * sum(sizes):
        return df
    return df.repartition(2 * slots, key)


def few(df: DataFrame, rows: int = BROADCAST_ROWS) -> list | None:
    """The rows of df if there are at most so many, else None; the driver gets one row more at most."""
    found = df.limit(rows + 1).collect()
    return found if len(found) <= rows else None


def broadcastable(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if a count shows that it is small."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with ranks from 1 in the order given, rows dealt to ranges of it.

    Each range is sorted and numbered by itself and stored; of the ranges only their counts go through one window, so no
    task has more than its range, whatever keys are frequent. Rows that are equal in the order get ranks in any order.
    """
    spark = df.sparkSession
    keys = [f"_k{i}" for i in range(len(order))]
    dealt = df.withColumns(dict(zip(keys, order))).repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys)
    place = F.monotonically_increasing_id()
    own = dealt.sortWithinPartitions(*keys).drop(*keys).withColumns({"_part": F.shiftright(place, 33).cast("int"), "_place": place.bitwiseAND(F.lit((1 << 33) - 1))})
    own = stored(own)
    # a row for each range
    sizes = own.groupBy("_part").count().withColumn("_before", F.sum("count").over(Window.orderBy("_part")) - F.col("count")).drop("count")
    return own.join(F.broadcast(sizes), "_part").withColumn(name, F.col("_before") + F.col("_place") + 1).drop("_part", "_place", "_before")


def prefixes(df: DataFrame, order: list[Column], sizes: list[int], name: str = "scale") -> DataFrame:
    """The rows of each prefix of df in the order given, with its size as `name`: rows of small prefixes come once for each.

    Rows are dealt to ranges of the order and stored. Ranges that a prefix has whole stay as they are; only those where one
    ends are ranked, so no task has more than a range, whatever the sizes are. A size beyond the table takes all rows; rows
    that are equal in the order are cut anywhere.
    """
    spark = df.sparkSession
    keys = [f"_p{i}" for i in range(len(order))]
    dealt = df.withColumns(dict(zip(keys, order))).repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys)
    dealt = stored(dealt.withColumn("_range", F.spark_partition_id()))
    counts = sorted((r["_range"], r["count"]) for r in dealt.groupBy("_range").count().collect())  # a row for each range
    size = F.array(*(F.lit(s).cast("long") for s in sorted(sizes)))
    # ranges as (number, rows before, rows before and in it), and those in which a prefix ends
    ranges, at = [], 0
    for part, n in counts:
        ranges.append((part, at, at + n))
        at += n
    cut = [r for r in ranges if any(r[1] < s < r[2] for s in sizes)]

    def of(values: dict[int, int]) -> Column:
        made = F.lit(None).cast("long")
        for part, v in values.items():
            made = F.when(F.col("_range") == part, F.lit(v).cast("long")).otherwise(made)
        return made

    made = dealt.withColumn("_in", F.filter(size, lambda s: s >= of({p: b for p, _, b in ranges})))
    if cut:
        # a rank over all ranges that are cut, moved up by the rows before its own range that are not ranked
        missing, seen = {}, 0
        for part, first, last in cut:
            missing[part], seen = first - seen, seen + last - first
        place = ranked(dealt.filter(F.col("_range").isin([p for p, _, _ in cut])), [F.col(k) for k in keys], "_r")
        upto = F.filter(size, lambda s: (s >= F.col("_r") + of(missing)) & (s < of({p: b for p, _, b in cut})))
        made = made.unionByName(place.withColumn("_in", upto).drop("_r"))
    return made.withColumn(name, F.explode("_in")).drop("_in", "_range", *keys)


def prefix(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n rows of df in the order given, for any n."""
    return prefixes(df, order, [n], "_scale").drop("_scale")
