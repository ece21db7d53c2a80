"""Importance resampling towards a target: hashed word runs, bucket-partitioned postings, gains and Gumbel scores."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.llm import common
from tokenloom.operators import shared

BUCKETS, SHORTEST, LONGEST = 10_000, 1, 1
SEED, LEAST_WORDS, PERCENT = 2024, 20, 10

#: Postings that a task holds before it sends them on.
HELD = 1 << 20

#: Groups of buckets. A group's postings are dealt by slices of the rows, so a row's buckets meet in as many tasks at most,
#: and a frequent bucket is many keys.
GROUPS = 8

#: Features whose buckets a worker remembers.
KNOWN = 300_000

#: Digits, letters and all bytes beyond ASCII make words, A-Z as a-z; all else is space.
_WORD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


class _Buckets(dict):
    """Bucket of each feature that was asked for."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        found = zlib.crc32(feature) % self.buckets
        if len(self) < KNOWN:
            self[feature] = found
        return found


def words(text: bytes) -> list[bytes]:
    return text.translate(_WORD).split()


def features(text: bytes, shortest: int = SHORTEST, longest: int = LONGEST) -> Iterator[bytes]:
    """All runs of shortest to longest consecutive words, joined by one space."""
    own = words(text)
    for n in range(shortest, longest + 1):
        yield from own if n == 1 else (b" ".join(own[i : i + n]) for i in range(len(own) - n + 1))


def counted(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, shortest: int = SHORTEST, longest: int = LONGEST) -> DataFrame:
    """(row, id, n_words, n_features, buckets, counts) of each row of df, stored: so the numbers of rows stay.

    buckets and counts are unsigned 32-bit numbers, the buckets ascending. A null text has no words.
    """
    common.prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Buckets(buckets)
        for batch in batches:
            data, offsets = common.flat_text(batch.column(2))
            view = memoryview(np.ascontiguousarray(data))
            n_words, n, own, counts = [], [], [], []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                found = words(bytes(view[a:b]))
                n_words.append(len(found))
                if shortest != 1 or longest != 1:
                    found = list(features(bytes(view[a:b]), shortest, longest))
                n.append(len(found))
                at, times = np.unique(np.fromiter(map(known.__getitem__, found), np.uint32, len(found)), return_counts=True)
                own.append(at.tobytes())
                counts.append(times.astype(np.uint32).tobytes())
            made = [pa.array(n_words, pa.int64()), pa.array(n, pa.int64()), pa.array(own, pa.binary()), pa.array(counts, pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *made], ["row", "id", "n_words", "n_features", "buckets", "counts"])

    numbered = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return common.stored(numbered.mapInArrow(common.lean(run), "row long, id long, n_words long, n_features long, buckets binary, counts binary"))


def _cut(values: np.ndarray, at: np.ndarray) -> pa.Array:
    """Binary values that begin at the places `at` of an array of 32-bit numbers."""
    return common.large_binary(values.view(np.uint8), np.append(at, len(values)) * 4).cast(pa.binary())


def _inverted(rows: np.ndarray, buckets: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """Postings of some rows, one record for each bucket: its rows as distances from the first of all, and their counts."""
    order = np.argsort(buckets, kind="stable")
    buckets, counts = buckets[order], counts[order]
    far = (rows[order] - rows[0]).astype(np.uint32)
    at = np.flatnonzero(np.concatenate(([True], buckets[1:] != buckets[:-1])))
    sums = np.add.reduceat(counts.astype(np.int64), at)
    columns = [pa.array(buckets[at].astype(np.int32)), pa.array(np.full(len(at), rows[0])), _cut(far, at), _cut(counts, at), pa.array(sums)]
    return pa.RecordBatch.from_arrays(columns, ["bucket", "first", "far", "counts", "total"])


def postings(rows: DataFrame) -> DataFrame:
    """(bucket, first, far, counts, total), stored, dealt by bucket group and slice of rows: the inverted form of `counted`.

    A task inverts HELD postings at a time, so that a bucket is sent once for many rows.
    """
    spark = rows.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, own, counts, held = [], [], [], 0
        for batch in batches:
            numbers = batch.column(0).to_numpy()
            for n, a, b in zip(numbers.tolist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                # distances have 32 bits: rows of another partition are far away
                if held and (held >= HELD or not 0 <= n - row[0][0] < 1 << 32):
                    yield _inverted(np.concatenate(row), np.concatenate(own), np.concatenate(counts))
                    row, own, counts, held = [], [], [], 0
                if a:
                    own.append(np.frombuffer(a, np.uint32))
                    counts.append(np.frombuffer(b, np.uint32))
                    row.append(np.full(len(own[-1]), n))
                    held += len(own[-1])
        if held:
            yield _inverted(np.concatenate(row), np.concatenate(own), np.concatenate(counts))

    made = rows.select("row", "buckets", "counts").mapInArrow(common.lean(run), "bucket int, first long, far binary, counts binary, total long")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = made.select("*", (F.col("bucket") % GROUPS).alias("group"), F.pmod(F.xxhash64("first"), F.lit(parts)).alias("slice"))
    return common.stored(dealt.repartition(parts, "group", "slice").drop("group", "slice"))


def gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) from the postings of both corpora: floor(1000 ln) of the smoothed ratio of their shares of the bucket."""
    own = raw.groupBy("bucket").agg(F.sum("total").alias("s")).withColumn("t", F.lit(0).cast("long"))
    other = target.groupBy("bucket").agg(F.sum("total").alias("t")).select("bucket", F.lit(0).cast("long").alias("s"), "t")
    both = common.stored(own.unionByName(other).groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")))
    all_s, all_t = (float(x or 0) for x in both.agg(F.sum("s"), F.sum("t")).first())
    ratio = (F.col("t") + 1.0) * F.lit(all_s + buckets) / ((F.col("s") + 1.0) * F.lit(all_t + buckets))
    return both.select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))


def _contributions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings with gains to (row, weight), summed over what a task holds."""
    rows, weights, held = [], [], 0

    def out() -> pa.RecordBatch:
        row, weight = np.concatenate(rows), np.concatenate(weights)
        order = np.argsort(row, kind="stable")
        row, weight = row[order], weight[order]
        at = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
        return pa.RecordBatch.from_arrays([pa.array(row[at]), pa.array(np.add.reduceat(weight, at))], ["row", "weight"])

    for batch in batches:
        for first, far, counts, gain in zip(*(c.to_pylist() for c in batch.columns)):
            rows.append(first + np.frombuffer(far, np.uint32).astype(np.int64))
            weights.append(np.frombuffer(counts, np.uint32).astype(np.int64) * gain)
            held += len(rows[-1])
            if held >= HELD:
                yield out()
                rows, weights, held = [], [], 0
    if held:
        yield out()


def weighed(rows: DataFrame, raw: DataFrame, gain: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(id, n_words, n_features, weight) of each row of `counted`: the gains of its features, summed.

    Gains have a row for each bucket, a number that is a parameter; each part of the postings adds up its contributions
    by row before they are sent.
    """
    gain = F.broadcast(gain) if buckets <= shared.BROADCAST_ROWS else gain
    sent = raw.join(gain, "bucket").select("first", "far", "counts", "gain").mapInArrow(common.lean(_contributions), "row long, weight long")
    none = F.lit(None).cast("long")
    facts = rows.select("row", "id", "n_words", "n_features", F.lit(0).cast("long").alias("weight"))
    both = facts.unionByName(sent.select("row", none.alias("id"), none.alias("n_words"), none.alias("n_features"), "weight"))
    own = both.groupBy("row").agg(F.max("id").alias("id"), F.max("n_words").alias("n_words"), F.max("n_features").alias("n_features"), F.sum("weight").alias("weight"))
    return own.drop("row")


def noise(id_: Column, seed: int = SEED) -> Column:
    """Gumbel noise of an id, in thousandths; a null id counts as no text."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resampled(
    docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS,
    shortest: int = SHORTEST, longest: int = LONGEST, seed: int = SEED, least_words: int = LEAST_WORDS, percent: int = PERCENT,
) -> DataFrame:
    """(id_col, n_features, weight, score, rank) of each row of docs; rank from 1 for the rows drawn, null for others.

    Of the rows with least_words words or more, percent of a hundred are drawn, the highest scores first, ties to the
    smaller id; a null id comes after all others. Rows that share an id have the same noise; repeated rows are rows of
    their own. An empty target leaves gains that only depend on docs; an empty table gives an empty one.
    """
    rows = counted(docs, id_col=id_col, text_col=text_col, buckets=buckets, shortest=shortest, longest=longest)
    other = counted(target.select(F.lit(0).alias("id"), F.col(text_col).alias("text")), id_col="id", buckets=buckets, shortest=shortest, longest=longest)
    raw = postings(rows)
    made = weighed(rows, raw, gains(raw, postings(other), buckets), buckets)
    made = common.stored(made.withColumn("score", F.col("weight") + noise(F.col("id"), seed)))
    able = made.filter(F.col("n_words") >= least_words)
    drawn = able.count() * percent // 100
    places = shared.ranked(able, [-F.col("score"), F.col("id").isNull(), F.coalesce("id", F.lit(0)), F.col("n_features"), F.col("weight")], "rank")
    none = made.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    both = places.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")).cast("long")).unionByName(none)
    return both.select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
