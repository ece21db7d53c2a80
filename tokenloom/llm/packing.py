"""Best-fit packing by minimum bin slack over the histogram of piece lengths."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tokenloom.llm import common

VOCABULARY = "word_bpe_49k.json"
CAPACITY = 4096
END_ID = 1
MARK = b"\x01"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_encoders: dict[str, tuple[common.UnitEncoder, re.Pattern]] = {}
common.CACHES.append(_encoders)


def _between_marks(made, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids and numbers of any units. Many go together, a control character that none of them has between them."""
    (mark,) = made.encode(MARK.decode(), add_special_tokens=False).ids
    groups = list(common.together(units, lambda u: MARK in u))
    texts = [(g[0] if len(g) == 1 else b" \x01 ".join(g)).decode() for g in groups]
    found, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
    for g, e in zip(groups, made.encode_batch_fast(texts, add_special_tokens=False)):
        ids = np.array(e.ids, np.uint32)
        if len(g) == 1:
            sizes.append(np.array([len(ids)]))
        else:
            between = ids == mark
            sizes.append(np.diff(np.flatnonzero(between), prepend=-1, append=len(ids)) - 1)
            ids = ids[~between]
        found.append(ids)
    return np.concatenate(found), np.concatenate(sizes)


def _by_word_ends(made, last: np.ndarray, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The same for words of ASCII letters: each is one word to the tokenizer, whose last token is marked as such."""
    texts = [b"\n".join(words[i : i + 4096]).decode() for i in range(0, len(words), 4096)]
    ids = np.concatenate([np.zeros(0, np.uint32), *(np.array(e.ids, np.uint32) for e in made.encode_batch_fast(texts, add_special_tokens=False))])
    return ids, np.diff(np.flatnonzero(last[ids]), prepend=-1)


def _encode_units(made, last: np.ndarray, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All ids and the number of each unit's; last says of each id whether it ends a word."""
    bare = [u.strip(b" \t\n\r\x0b\x0c") for u in units]
    plain = np.fromiter((u.isalpha() for u in bare), bool, len(bare))
    first, second = np.flatnonzero(plain), np.flatnonzero(~plain)
    one = _by_word_ends(made, last, [bare[i] for i in first.tolist()])
    two = _between_marks(made, [bare[i] for i in second.tolist()])
    flat, sizes, begin = np.concatenate([one[0], two[0]]), np.empty(len(units), np.int64), np.empty(len(units), np.int64)
    sizes[first], sizes[second] = one[1], two[1]
    begin[first], begin[second] = np.cumsum(one[1]) - one[1], len(one[0]) + np.cumsum(two[1]) - two[1]
    ends = np.cumsum(sizes)
    return flat[np.repeat(begin - (ends - sizes), sizes) + np.arange(ends[-1])], sizes


def _encoder(path: str) -> tuple[common.UnitEncoder, re.Pattern]:
    """The file's tokenizer over units, and what finds the added tokens, which it takes whole wherever a text has them."""
    if path not in _encoders:
        common.quiet_tokenizers()
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(path)
        last = np.zeros(made.get_vocab_size(), bool)
        last[[i for token, i in made.get_vocab().items() if token.endswith("</w>")]] = True
        added = made.get_added_tokens_decoder().values()
        if any(t.single_word or t.lstrip or t.rstrip or t.normalized for t in added):
            raise ValueError("added tokens that depend on what is around them aren't supported")
        names = sorted((t.content.encode() for t in added), key=len, reverse=True)
        found = re.compile(b"(?=(" + b"|".join(map(re.escape, names)) + b"))" if names else b"(?!)()")
        _encoders[path] = (common.UnitEncoder(lambda units: _encode_units(made, last, units)), found)
    return _encoders[path]


def _added(found: re.Pattern, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int]]:
    """Where the texts have added tokens: the leftmost first, none across two texts."""
    spans, end = [], 0
    for m in found.finditer(memoryview(np.ascontiguousarray(data))):
        a, b = m.span(1)
        if a >= end and offsets[np.searchsorted(offsets, a, side="right")] >= b:
            spans.append((a, b))
            end = b
    return spans


def _cut(path: str, capacity: int, end_id: int):
    """Batches (id, text) to batches (id, piece, start, length, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, added = _encoder(path)
        for batch in batches:
            data, offsets = common.flat_text(batch.column(1))
            for a, b in common.steps(offsets):
                part, off = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                whole = _added(added, part, off)
                # the tokenizer lower-cases anyway; this way fewer units differ. Added tokens stay as they are
                lowered = np.take(_LOWER, part)
                for x, y in whole:
                    lowered[x:y] = part[x:y]
                tokens, _, bounds = encoder(lowered, off, whole)
                ids = np.insert(tokens[:, 0], bounds[1:], np.uint32(end_id)).astype("<u4")
                bounds = bounds + np.arange(len(bounds))
                count = -(-np.diff(bounds) // capacity)
                row = np.repeat(np.arange(b - a), count)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                begin = bounds[:-1][row] + piece * capacity
                end = np.minimum(begin + capacity, bounds[1:][row])
                pieces_ = common.large_binary(ids.view(np.uint8), np.append(begin, bounds[-1]) * 4).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(piece * capacity), pa.array(end - begin), pieces_],
                    ["id", "piece", "start", "length", "ids"],
                )

    return run


def _narrow(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))


def pieces(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """(id, piece, start, length, ids binary): the tokens of each text and end_id, cut only where they exceed capacity.

    ids are little-endian unsigned 32-bit, those of the file's tokenizer for the whole text: the names of its added
    tokens are those tokens. A null or empty text is one piece of length 1. Ids may be null or shared: a repeated row
    gives its pieces again. Other columns of df are not looked at.
    """
    common.prepare(df.sparkSession)
    run = _cut(path or public_tokenizers.path(VOCABULARY), capacity, end_id)
    return _narrow(df, id_col, text_col).mapInArrow(common.lean(run), "id long, piece int, start long, length long, ids binary")


def minimum_bin_slack(counts: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Fill bins from a histogram: a list of (pattern, times), a pattern being (length, how many) pairs.

    For each bin the largest length left is set, and a subset-sum over the other lengths left, as a bitset of
    reachable sums, finds the fullest combination. As many equal bins as the counts allow are made at once, so
    the work follows the number of different lengths (at most `capacity`), not of pieces.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    if any(n > capacity or n < 1 for n in left):
        raise ValueError("a length is below 1 or over the capacity")
    made, mask = [], (1 << (capacity + 1)) - 1
    order = sorted(left, reverse=True)
    while left:
        order = [n for n in order if n in left]
        largest = order[0]
        room = capacity - largest
        left[largest] -= 1
        # reach[i]: sums of the first i parcels; a parcel is 1, 2, 4 ... pieces of a length
        reach, parcels, sums = [], [], 1
        full = 1 << room
        limit = mask >> (capacity - room)
        for n in order:
            if n > room:
                continue
            c, k = min(left[n], room // n), 1
            while c > 0 and not sums & full:
                k = min(k, c)
                reach.append(sums)
                parcels.append((n, k))
                sums = (sums | (sums << (n * k))) & limit
                c, k = c - k, k * 2
            if sums & full:
                break
        target = sums.bit_length() - 1
        pattern = {largest: 1}
        for (n, k), before in zip(reversed(parcels), reversed(reach)):
            if not before >> target & 1:
                pattern[n] = pattern.get(n, 0) + k
                target -= n * k
        left[largest] += 1
        times = min(left[n] // k for n, k in pattern.items())
        made.append((sorted(pattern.items(), reverse=True), times))
        for n, k in pattern.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
    return made


def _slots(plan: list, capacity: int) -> tuple[np.ndarray, ...]:
    """Runs of slots in order of (length, rank): key length * 2**44 + first rank, sequence, items per sequence, offset."""
    key, first, per, offset, seen, sequence = [], [], [], [], {}, 0
    for pattern, times in plan:
        at = 0
        for n, k in pattern:
            rank = seen.get(n, 0)
            key.append((n << 44) + rank)
            first.append(sequence)
            per.append(k)
            offset.append(at)
            seen[n] = rank + k * times
            at += n * k
        sequence += times
    order = np.argsort(np.array(key, np.int64), kind="stable")
    return tuple(np.array(x, np.int64)[order] for x in (key, first, per, offset))


def pack(made: DataFrame, *, capacity: int = CAPACITY) -> DataFrame:
    """made (with a length column) and for each row sequence_id and offset, gapless from 0 in each sequence.

    made must be stored: it is read twice and has to be the same both times. The driver gets one count for each
    length, at most `capacity` numbers whatever the input. Ranks within a length come from counts by
    (range of rows, length), so no length, however frequent, meets in one task. An empty table gives an empty one.
    Equal rows get places of their own. Columns of made pass through; one with the name of a result is an error.
    """
    spark = made.sparkSession
    common.prepare(spark)
    common.free_names(made.columns, ["sequence_id", "offset", "_part", "_rank", "_before"])
    numbered = common.stored(made.withColumn("_part", F.spark_partition_id()))
    each = numbered.groupBy("length", "_part").count()
    counts = {r["length"]: r["n"] for r in each.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    slots = spark.sparkContext.broadcast(_slots(minimum_bin_slack(counts, capacity), capacity))
    # a row for each part and length: small, and ordered by part within a length
    before = each.select("_part", "length", (F.sum("count").over(Window.partitionBy("length").orderBy("_part")) - F.col("count")).alias("_before"))
    inside = Window.partitionBy("_part", "length").orderBy(F.lit(0))
    ranked = (
        numbered.withColumn("_rank", F.row_number().over(inside) - 1)
        .join(before, ["_part", "length"])
        .withColumn("_rank", (F.col("_rank") + F.col("_before")).cast("long"))
        .drop("_before", "_part")
    )
    names = made.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, per, offset = slots.value
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("_rank").to_numpy(zero_copy_only=False)
            want = (length.astype(np.int64) << 44) + rank
            i = np.searchsorted(key, want, side="right") - 1
            nth = want - key[i]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array(first[i] + nth // per[i]), pa.array(offset[i] + nth % per[i] * length)],
                [*names, "sequence_id", "offset"],
            )

    return ranked.mapInArrow(place, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in made.schema.fields) + ", sequence_id long, offset long")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sums = [zlib.crc32(x.as_buffer()) for x in batch.column(4)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(sums, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])


def packed_digests(docs: DataFrame, *, capacity: int = CAPACITY) -> DataFrame:
    """docs packed, with a checksum of each piece's ids in the place of the ids."""
    common.prepare(docs.sparkSession)
    run = _cut(public_tokenizers.path(VOCABULARY), capacity, END_ID)
    # both steps in one worker: chained maps would hold two for each task
    light = _narrow(docs).mapInArrow(common.lean(lambda batches: _digests(run(batches))), "doc_id long, piece int, start long, length long, ids_crc32 long")
    return pack(light, capacity=capacity)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_digests(common.documents(spark, sf_dir))
