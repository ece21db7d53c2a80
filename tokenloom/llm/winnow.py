"""Document fingerprints by winnowing: rolling k-gram hashes, the rightmost least one of each window, with places."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.llm import common

#: Bytes of a k-gram, and k-grams of a window: a common string of GRAM + WINDOW - 1 bytes is always found.
GRAM, WINDOW = 24, 40


def rolling(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """64-bit polynomial hashes of all k-grams, mixed; a text shorter than k has one, of the whole."""
    if not len(data):
        return np.zeros(0, np.uint64)
    gram = min(gram, len(data))
    with np.errstate(over="ignore"):
        base = np.uint64(0x9E3779B97F4A7C15)
        # by binary parts of the length: hash(x + y) = hash(x) * base ** len(y) + hash(y)
        piece, size, power = data.astype(np.uint64) + np.uint64(1), 1, base
        made, made_size = None, 0
        while True:
            if gram & size:
                if made is None:
                    made, made_size = piece, size
                else:
                    n = len(data) - made_size - size + 1
                    made, made_size = made[:n] * power + piece[made_size : made_size + n], made_size + size
            if size * 2 > gram:
                break
            piece = piece[: len(piece) - size] * power + piece[size:]
            power, size = power * power, size * 2
        made = made ^ (made >> np.uint64(31))
        made = made * np.uint64(0xBF58476D1CE4E5B9)
        return made ^ (made >> np.uint64(29))


def winnow(text: bytes, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes): in each window of k-grams the least hash, the rightmost of equal ones, each place once."""
    h = rolling(np.frombuffer(text, np.uint8), gram)
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    window = min(window, len(h))
    least, at, size = h, np.arange(len(h)), 1

    def of_two(a, b, x, y):
        right = b <= a
        return np.where(right, b, a), np.where(right, y, x)

    while size * 2 <= window:
        least, at = of_two(least[:-size], least[size:], at[:-size], at[size:])
        size *= 2
    if rest := window - size:
        least, at = of_two(least[:-rest], least[rest:], at[:-rest], at[rest:])
    places = at[np.concatenate(([True], at[1:] != at[:-1]))]
    return places, h[places]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the distinct hashes of both that both have; two empty fingerprints are alike."""
    a, b = np.unique(a), np.unique(b)
    both = len(np.intersect1d(a, b, assume_unique=True))
    union = len(a) + len(b) - both
    return both / union if union else 1.0


def digest(hashes: np.ndarray) -> str:
    """A short name for a fingerprint: SHA-256 over its hashes in the order of their places."""
    return hashlib.sha256(hashes.astype("<u8").tobytes()).hexdigest()


def fingerprint(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """(id_col, places array<int>, hashes array<long>) for each row; null and empty texts have empty arrays.

    Texts of any length are read whole; repeated rows give repeated rows; ids may be null or shared. Other columns of df
    are not looked at; an id_col named like a result is an error.
    """
    common.prepare(df.sparkSession)
    common.free_names([id_col], ["places", "hashes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [winnow(x.as_py() or b"", gram, window) for x in batch.column(1)]
            places = pa.array([p.astype(np.int32) for p, _ in made], pa.list_(pa.int32()))
            hashes = pa.array([h.view(np.int64) for _, h in made], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), places, hashes], ["id", "places", "hashes"])

    narrow = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return narrow.mapInArrow(common.lean(run), "id long, places array<int>, hashes array<long>").withColumnRenamed("id", id_col)


def first_match(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[int | None, int | None]:
    """The first place in a of a hash that both have, and its first place in b: where a common string may start."""
    both = np.isin(a[1], b[1])
    if not both.any():
        return None, None
    i = int(both.argmax())
    return int(a[0][i]), int(b[0][(b[1] == a[1][i]).argmax()])


def _compare(gram: int, window: int):
    """Rows come by descending order within a part; each is compared with the one after it."""

    def row(id_, text: bytes, after: bytes, own, other):
        chars, more = text.decode(), after.decode()
        cut = len(chars) // 3
        edited = (chars[: len(chars) - cut] + more[:cut]).encode()
        edit = own if edited == text else winnow(edited, gram, window)
        match = first_match(own, other)
        return (id_, len(chars), hashlib.sha256(edited).hexdigest(), digest(own[1]), digest(edit[1]), likeness(own[1], edit[1]), likeness(own[1], other[1]), len(own[1]), *match)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            out = []
            for part, lent, id_, text in zip(*(c.to_pylist() for c in batch.columns)):
                own = winnow(text, gram, window)
                if before is not None and before[0] == part:
                    out.append(row(*before[1:3], text, before[3], own))
                before = None if lent else (part, id_, text, own)
            if out:
                yield pa.RecordBatch.from_pydict(dict(zip(_SCHEMA.names, zip(*out))), _SCHEMA)

    return run


_SCHEMA = pa.schema([
    ("id", pa.int64()), ("n_chars", pa.int64()), *((n, pa.string()) for n in ("edited_sha256", "fingerprint", "edited_fingerprint")), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("n_hashes", pa.int64()),
    ("match_place", pa.int64()), ("match_next_place", pa.int64()),
])
_ROW = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_hashes long, match_place long, match_next_place long"

#: Rows sampled for each part to find its borders.
SAMPLED = 64


class _Ranges:
    """Parts of the order of (id, order) by borders between them."""

    def __init__(self, cuts: list[tuple[int, int]]):
        self.ids = np.array([c[0] for c in cuts], np.int64)
        self.orders = np.array([c[1] for c in cuts], np.int64)

    def part(self, id_: np.ndarray, order: np.ndarray) -> np.ndarray:
        """How many borders lie below each row."""
        low, high = np.searchsorted(self.ids, id_, side="left"), np.searchsorted(self.ids, id_, side="right")
        part = low.copy()
        for a in np.unique(low[high > low]).tolist():  # rows whose id is a border's: the second key decides
            own = np.flatnonzero((low == a) & (high > low))
            part[own] += np.searchsorted(self.orders[a : high[own[0]]], order[own], side="left")
        return part


def edited_likeness(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """One row for each row of df: fingerprints of its text, of its edited text and of the next row's text, compared.

    The next row is the one with the next smaller (id, text digest); after the last comes the first. The edited
    text has its last third replaced by as many characters from the next text's start. A single row is its own
    next one. Null and empty texts have no hashes. match_place and match_next_place are the first place of a hash that
    the next text has too, in either. An id_col named like a result is an error; other columns of df are not looked at.

    Rows are dealt to ranges of (id, text digest) once; of each range's first row a copy goes to the range before it, so
    neighbours meet in one part without all rows in one, however many share an id. The driver gets SAMPLED pairs of
    numbers for each part, and one border of each.
    """
    spark = df.sparkSession
    common.prepare(spark)
    common.free_names([id_col], _SCHEMA.names[1:])
    id_, order = common.key_columns(id_col, text_col)
    rows = df.select(id_.alias("id"), order.alias("order"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = rows.select("id", "order")
    share = min(1.0, SAMPLED * parts / max(1, df.count()))
    seen = sorted({(r["id"], r["order"]) for r in ids.sample(share, seed=1).collect()})
    ranges = _Ranges(sorted({seen[len(seen) * i // parts] for i in range(1, parts)}) if seen else [])

    def tops_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[int, int]] = {}
        for batch in batches:
            id_, order = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            part = ranges.part(id_, order)
            by = np.lexsort((order, id_, part))
            last = by[np.flatnonzero(np.append(part[by][1:] != part[by][:-1], True))]
            for p, i, o in zip(part[last].tolist(), id_[last].tolist(), order[last].tolist()):
                best[p] = max(best.get(p, (i, o)), (i, o))
        yield pa.RecordBatch.from_pydict({"part": pa.array(best.keys(), pa.int32()), "id": pa.array([x[0] for x in best.values()], pa.int64()), "order": pa.array([x[1] for x in best.values()], pa.int64())})

    # the greatest row of each part is the next one for the part above it; the top part's for the lowest part
    found = ids.mapInArrow(tops_of, "part int, id long, order long").groupBy("part").agg(F.max(F.struct("id", "order")).alias("top")).collect()
    tops = sorted((r["part"], r["top"]["id"], r["top"]["order"]) for r in found)
    lends = {(i, o): tops[(n + 1) % len(tops)][0] for n, (_, i, o) in enumerate(tops)}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lenders = np.array(sorted(i for i, _ in lends), np.int64)
        for batch in batches:
            id_ = batch.column(0).to_numpy()
            names = ["part", "lent", "id", "order", "text"]
            yield pa.RecordBatch.from_arrays([pa.array(ranges.part(id_, batch.column(1).to_numpy()).astype(np.int32)), pa.array(np.zeros(len(id_), bool)), *batch.columns], names)
            for n in np.flatnonzero(np.isin(id_, lenders)).tolist():
                to = lends.get((int(id_[n]), batch.column(1)[n].as_py()))
                if to is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([to], pa.int32()), pa.array([True]), *batch.slice(n, 1).columns], names)

    dealt = rows.mapInArrow(deal, "part int, lent boolean, id long, order long, text binary")
    dealt = dealt.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "lent", F.desc("id"), F.desc("order"))
    made = dealt.select("part", "lent", "id", "text").mapInArrow(common.lean(_compare(gram, window)), _ROW)
    return made.withColumn("id", F.when(F.col("id") != common.NULL_ID, F.col("id"))).withColumnRenamed("id", id_col)


def op8_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_likeness(common.documents(spark, sf_dir))
