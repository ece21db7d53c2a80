"""Vector codes: product quantisation with integer codebooks whose nearest entries a kd-tree finds."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.llm import common

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256

#: Entries of a leaf at most.
LEAF = 4

#: Scaled components must stay below this, so that squared distances and their sums are exact in 64 bits.
LIMIT = 1 << 24

#: Slices of a label's rows when they meet its total, so that a frequent label is many small groups.
SLICES = 32

#: Rows searched at once.
STEP = 8192


class Tree:
    """A kd-tree over the entries of one codebook; entries are cut at the median of the dimension in which they differ most.

    Each node has the box of its entries. `nearest` looks into each query's own leaf first, then walks the tree once with
    all queries, and goes into a node with those whose distance to its box is not larger than what they have: equal
    bounds are visited too, as a lower index may tie there.
    """

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        self.leaf: list[np.ndarray | None] = []
        #: dimension, first value of the right side, left and right child
        self.cut: list[tuple[int, int, int, int]] = []
        self._grow(np.arange(len(entries)))

    def _grow(self, members: np.ndarray) -> int:
        own, n = self.entries[members], len(self.low)
        self.low.append(own.min(axis=0))
        self.high.append(own.max(axis=0))
        self.leaf.append(members)
        self.cut.append((0, 0, 0, 0))
        wide = self.high[n] - self.low[n]
        if len(members) <= LEAF or not len(wide) or not wide.max():
            return n
        dim = int(wide.argmax())
        values = np.sort(own[:, dim])
        value = values[len(values) // 2]
        if value == values[0]:  # the lower half is one value
            value = values[np.searchsorted(values, value, side="right")]
        right = own[:, dim] >= value
        self.leaf[n] = None
        self.cut[n] = (dim, int(value), self._grow(members[~right]), self._grow(members[right]))
        return n

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the nearest entry of each query; of entries as near, the one with the lowest index."""
        best = np.full(len(queries), np.iinfo(np.int64).max)
        index = np.full(len(queries), len(self.entries))

        def look(n: int, at: np.ndarray) -> None:
            members = self.leaf[n]
            diff = queries[at, None, :] - self.entries[members]
            dist = (diff * diff).sum(axis=2)
            first = dist.argmin(axis=1)  # members ascend, so the first of equals has the lowest index
            found, which = dist[np.arange(len(at)), first], members[first]
            better = (found < best[at]) | ((found == best[at]) & (which < index[at]))
            best[at[better]], index[at[better]] = found[better], which[better]

        def descend(n: int, at: np.ndarray) -> None:
            if not len(at):
                return
            if self.leaf[n] is not None:
                return look(n, at)
            dim, value, left, right = self.cut[n]
            over = queries[at, dim] >= value
            descend(left, at[~over])
            descend(right, at[over])

        def walk(n: int, at: np.ndarray) -> None:
            own = queries[at]
            out = np.maximum(self.low[n] - own, 0) + np.maximum(own - self.high[n], 0)
            at = at[(out * out).sum(axis=1) <= best[at]]
            if not len(at):
                return
            if self.leaf[n] is not None:
                return look(n, at)
            walk(self.cut[n][2], at)
            walk(self.cut[n][3], at)

        every = np.arange(len(queries))
        descend(0, every)
        walk(0, every)
        return index, best


def _whole(vectors: pa.Array, parts: int) -> np.ndarray:
    """floor(SCALE * x) of vectors without nulls: (rows, parts, components of a part)."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = set(np.diff(vectors.offsets.to_numpy()).tolist())
    if len(sizes) > 1 or any(s % parts for s in sizes):
        raise ValueError(f"vectors have {sorted(sizes)} components; all need the same number, a multiple of {parts}")
    scaled = np.floor(flat * SCALE)
    if len(scaled) and np.abs(scaled).max() >= LIMIT:
        raise ValueError(f"a component is {LIMIT / SCALE:g} or more; scale the vectors")
    return scaled.astype(np.int64).reshape(len(vectors), parts, -1 if len(flat) else 0)


def kept(df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id_col, v, label_col) of the rows whose vector has no null, NaN or infinite component, and is not null."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return df.select(F.col(id_col), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col)).filter("v is not null").filter(finite)


def first_books(rows: DataFrame, *, id_col: str, parts: int, entries: int) -> list[np.ndarray]:
    """The parts of the vectors with the smallest ids, a codebook for each part. Null ids come last, equal ids by vector."""
    found = rows.select(id_col, "v").orderBy(F.col(id_col).asc_nulls_last(), "v").limit(entries).collect()
    if not found:
        return []
    made = _whole(pa.array([r["v"] for r in found], pa.list_(pa.float64())), parts)
    return [np.ascontiguousarray(made[:, p]) for p in range(parts)]


def _searched(column: pa.Array, trees: list[Tree]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, whole parts, indexes, squared distances) of some rows at a time."""
    for a in range(0, len(column), STEP):
        whole = _whole(column.slice(a, STEP), len(trees))
        found = [t.nearest(whole[:, p]) for p, t in enumerate(trees)]
        yield a, whole, np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


def better_books(rows: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """One round: each entry becomes the floor of the mean of the parts it is nearest to; an entry without parts stays.

    The trees go to the tasks, which send sums and counts of each (part, entry) they met; Spark adds them up, and the
    driver gets one row for each entry.
    """
    spark = rows.sparkSession
    trees = spark.sparkContext.broadcast([Tree(b) for b in books])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = trees.value
        n, size = len(own), own[0].entries.shape[1]
        most = len(own[0].entries)
        counts, sums = np.zeros((n, most), np.int64), np.zeros((n, most, size), np.int64)
        for batch in batches:
            for _, whole, index, _ in _searched(batch.column(0), own):
                for p in range(n):
                    counts[p] += np.bincount(index[:, p], minlength=most)
                    np.add.at(sums[p], index[:, p], whole[:, p])
        p, e = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(counts[p, e]), pa.array(list(sums[p, e]), pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])

    size = books[0].shape[1]
    sent = rows.select("v").mapInArrow(common.lean(run), "part int, entry int, n long, sums array<long>")
    totals = sent.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[k]) for k in range(size))).alias("sums"))
    made = [b.copy() for b in books]
    for r in totals.collect():
        made[r["part"]][r["entry"]] = [s // r["n"] for s in r["sums"]]
    trees.unpersist()
    return made


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components of the entries as decimal numbers, joined by commas."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def train(df: DataFrame, *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> list[np.ndarray]:
    """Codebooks, one (entries, components) table for each part; none if no vector is kept, fewer entries if few are."""
    common.prepare(df.sparkSession)
    rows = kept(df, id_col=id_col, vector_col=vector_col, label_col=label_col)
    books = first_books(rows, id_col=id_col, parts=parts, entries=entries)
    for _ in range(rounds if books else 0):
        books = better_books(rows, books)
    return books


def encode(df: DataFrame, books: list[np.ndarray], *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id_col, label_col, indexes array<int>, error long): the nearest entry of each part, and the squared distances' sum.

    Rows whose vector is null, or has a null or non-finite component, are left out. Vectors must have one length, a
    multiple of the number of parts, and components below LIMIT / SCALE: others are a ValueError.
    """
    spark = df.sparkSession
    common.prepare(spark)
    rows = kept(df, id_col=id_col, vector_col=vector_col, label_col=label_col)
    schema = "id {}, label {}, indexes array<int>, error long".format(*(rows.schema[c].dataType.simpleString() for c in (id_col, label_col)))
    if not books:
        return spark.createDataFrame([], schema).toDF(id_col, label_col, "indexes", "error")
    trees = spark.sparkContext.broadcast([Tree(b) for b in books])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, _, index, dist in _searched(batch.column(2), trees.value):
                own = batch.slice(a, len(index))
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(list(index.astype(np.int32)), pa.list_(pa.int32())), pa.array(dist.sum(axis=1))], ["id", "label", "indexes", "error"])

    return rows.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), "v").mapInArrow(common.lean(run), schema).toDF(id_col, label_col, "indexes", "error")


def decode(coded: DataFrame, books: list[np.ndarray], *, codes_col: str = "indexes") -> DataFrame:
    """coded with `vector`: the entries that the indexes name, one part after the other, divided by SCALE."""
    table = F.array(*(F.array(*(F.array(*(F.lit(x / SCALE) for x in e)) for e in b.tolist())) for b in books))
    return coded.withColumn("vector", F.flatten(F.transform(F.col(codes_col), lambda x, p: table[p][x])))


def label_errors(coded: DataFrame, *, label_col: str = "label") -> DataFrame:
    """coded (stored) with label_error, the error summed over the rows of the same label; null labels count as one.

    Sums are aggregated, stored, and meet the rows in slices: a label with very many rows is SLICES smaller keys.
    """
    totals = common.stored(coded.groupBy(F.col(label_col).alias("_label")).agg(F.sum("error").alias("label_error")))
    slices = totals.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))))
    rows = coded.withColumn("_slice", F.pmod(F.xxhash64("indexes", "error"), F.lit(SLICES)).cast("int"))
    return rows.join(slices, (rows["_slice"] == slices["_slice"]) & rows[label_col].eqNullSafe(slices["_label"])).drop("_slice", "_label")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of the embeddings: two hex digits a part, errors, and the digest of the codebooks.

    No rows for an empty table; null ids and labels stay; repeated rows stay rows; other columns are not looked at.
    """
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    books = train(df)
    coded = label_errors(common.stored(encode(df, books)))
    code = F.array_join(F.transform("indexes", lambda x: F.lower(F.lpad(F.hex(x), 2, "0"))), "")
    return coded.select("vec_id", code.alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
