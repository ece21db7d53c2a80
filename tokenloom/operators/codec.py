"""Arrays whose elements are looked up in a table of any size: encoding, decoding and lexicons.

A table of a checked size goes to the tasks whole. A larger one meets the rows by chunks: each chunk's different elements
are joined with the table once, and come back to the chunk as its own small table, so that frequent elements are neither
shuffled for each place nor meet in one task. Both ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DataType, LongType, StructField, StructType

from tokenloom.operators import shared

#: A chunk has 2 ** CHUNK rows at most.
CHUNK = 8


@dataclass(frozen=True)
class AtOnce:
    """What strings become that a table lacks, all of a batch at once: a function of an Arrow array."""

    of: Callable[[pa.Array], pa.Array]


def _all(elements: pa.Array, known: dict, missing: Any, kind: pa.DataType) -> pa.Array:
    """The value of each element."""
    if not isinstance(missing, AtOnce):
        other = missing if callable(missing) else lambda _: missing
        return pa.array([known[x] if x in known else other(x) for x in elements.to_pylist()], kind)
    keys, found = pa.array(known.keys(), elements.type), pa.array(known.values(), kind)
    own = missing.of(elements).cast(kind)
    place = pc.fill_null(pc.index_in(elements, keys, skip_nulls=True), -1).to_numpy(zero_copy_only=False)
    return pa.concat_arrays([found, own]).take(pa.array(np.where(place < 0, len(found) + np.arange(len(elements)), place)))


def _looked_up(column: pa.Array, known: dict, missing: Any, kind: pa.DataType) -> pa.Array:
    """An array column with each element's value in known, or `missing` (a value, a function of the element, or AtOnce).

    Only the different elements of the column are looked up. Null arrays stay null; a null element is missing.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):  # no rows
        column = pa.array([], column.type)
    flat = column.flatten().dictionary_encode(null_encoding="encode")
    values = _all(flat.dictionary, known, missing, kind)
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    offsets = [0, *sizes.cumsum().tolist()]
    mask = column.is_null() if column.null_count else None
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values.take(flat.indices), mask=mask)


def _extended(batch, column: str, out: str, known: dict, missing: Any, kind: pa.DataType, split: str | None):
    """A batch or table with the column out."""
    elements = batch.column(column)
    made = _looked_up(pc.split_pattern_regex(elements, split) if split else elements, known, missing, kind)
    names = [*batch.schema.names, out]
    return type(batch).from_arrays([*batch.columns, made.cast(pa.list_(kind))], names)


def running(df: DataFrame, column: str, out: str) -> DataFrame:
    """df with `out`: in the place of each element of the array `column` of numbers the sum of those before it, nulls as 0.

    One pass over the batch's numbers: sums of slices would take the square of an array's length.
    """
    shared.importable(df.sparkSession)
    made = StructField(out, ArrayType(LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(column)
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            offsets = np.concatenate([[0], np.cumsum(sizes)])
            sums = np.concatenate([[0], np.cumsum(lists.flatten().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)])
            before = sums[:-1] - np.repeat(sums[offsets[:-1]], sizes)
            mask = lists.is_null() if lists.null_count else None
            own = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(before, pa.int64()), mask=mask)
            yield pa.RecordBatch.from_arrays([*batch.columns, own], [*batch.schema.names, out])

    return df.mapInArrow(run, StructType([*df.schema.fields, made]))


def mapped(
    df: DataFrame, column: str, table: DataFrame, out: str, *, missing: Any | Callable[[Any], Any] | AtOnce, split: str | None = None, then: tuple[Callable[[Any], Any], StructType] | None = None
) -> DataFrame:
    """df with `out`: the array `column` with each element replaced by its value in table (key, value).

    Elements that the table lacks become `missing`, a value, a function of the element or AtOnce. Null arrays stay null, null
    elements and null keys never match; of a repeated key the least value counts. Rows need no key: equal rows stay apart.
    With `split`, a class of characters that every engine reads alike, column is a string whose elements stand between them.
    With `then`, a function of an Arrow batch or table and the schema of what it makes, only that leaves the tasks.
    """
    spark = df.sparkSession
    shared.importable(spark)
    key, value = table.columns
    table = table.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.min(value).alias("_value"))
    element: DataType = table.schema["_value"].dataType
    kind = to_arrow_type(element)
    made = StructField(out, ArrayType(element))
    finish, given = then or (lambda batch: batch, None)
    rows = shared.few(table)
    if rows is not None:
        known = spark.sparkContext.broadcast({r[0]: r[1] for r in rows})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield finish(_extended(batch, column, out, known.value, missing, kind, split))

        return df.mapInArrow(run, given or StructType([*df.schema.fields, made]))
    # stored, so that the numbers stay
    numbered = shared.stored(df.withColumn("_chunk", F.shiftright(F.monotonically_increasing_id(), CHUNK)))
    wanted = numbered.select("_chunk", F.explode(F.array_distinct(F.split(column, split) if split else column)).alias("_key")).distinct()
    found = wanted.join(table, "_key").select(F.col("_chunk").alias("_of"), "_key", "_value").alias("found")

    def own(left: pa.Table, right: pa.Table) -> pa.Table:
        known = dict(zip(right.column("_key").to_pylist(), right.column("_value").to_pylist()))
        return finish(_extended(left.drop_columns(["_chunk"]).combine_chunks(), column, out, known, missing, kind, split))

    # the stored table's own types: all may be null there
    schema = given or StructType([*(f for f in numbered.schema.fields if f.name != "_chunk"), made])
    return numbered.groupBy("_chunk").cogroup(found.groupBy("_of")).applyInArrow(own, schema)
