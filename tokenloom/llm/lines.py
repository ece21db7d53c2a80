"""Line dedup: exact reference counts of lines, with sharded cuckoo filters over the lines to drop.

The state is reversible: documents go in and out by their texts, counts follow, and a filter loses a line's
fingerprint when its count falls below the threshold. A filter only spares look-ups; what it lets through is
checked against the exact table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.llm import common

LEAST_CHARS, LEAST_DOCS = 20, 3

#: Lines in a filter on average, and parts that a shard's look-ups are dealt to, so that a frequent line meets in none.
SHARD_LINES, SALTS = 65_536, 16

_STRIP = b" \t\n\r\x0b\x0c"


class CuckooFilter:
    """16-bit fingerprints in buckets of four, each in one of two buckets; what finds no place is kept whole in a stash.

    Equal keys may be inserted more than once and are deleted once at a time.
    """

    SLOTS, KICKS = 4, 256

    def __init__(self, capacity: int):
        buckets = 1
        while buckets * self.SLOTS * 0.85 < capacity:
            buckets *= 2
        self.table = np.zeros((buckets, self.SLOTS), np.uint16)
        self.stash: list[int] = []

    @property
    def room(self) -> int:
        """Keys from which a larger filter is due."""
        return int(self.table.size * 0.85)

    @staticmethod
    def _mix(x):
        with np.errstate(over="ignore"):
            x = np.asarray(x, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            return x ^ (x >> np.uint64(32))

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mask = np.uint64(len(self.table) - 1)
        h = self._mix(keys)
        mark = ((h >> np.uint64(48)) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
        one = h & mask
        return mark, one.astype(np.int64), ((one ^ self._mix(mark)) & mask).astype(np.int64)

    def insert(self, keys: np.ndarray) -> None:
        keys = np.asarray(keys, np.uint64)
        table, slots = self.table.tolist(), self.SLOTS
        jump = (self._mix(np.arange(65536)) & np.uint64(len(self.table) - 1)).astype(np.int64).tolist()
        for key, mark, one, two in zip(keys.tolist(), *(x.tolist() for x in self._places(keys))):
            at = one if 0 in table[one] else two
            moves = []
            for kick in range(self.KICKS):
                if 0 in table[at]:
                    table[at][table[at].index(0)] = mark
                    break
                slot = (at + kick) % slots
                moves.append((at, slot, table[at][slot]))
                table[at][slot], mark = mark, table[at][slot]
                at ^= jump[mark]
            else:  # put all back as it was and keep the key by itself
                for place, slot, old in reversed(moves):
                    table[place][slot] = old
                self.stash.append(key)
        self.table = np.array(table, np.uint16).reshape(-1, slots)

    def delete(self, keys: np.ndarray) -> None:
        """Only keys that were inserted may be deleted."""
        keys = np.asarray(keys, np.uint64)
        for key, mark, one, two in zip(keys.tolist(), *(x.tolist() for x in self._places(keys))):
            if key in self.stash:
                self.stash.remove(key)
                continue
            for at in (one, two):
                found = np.flatnonzero(self.table[at] == mark)
                if len(found):
                    self.table[at, found[0]] = 0
                    break

    def contains(self, keys: np.ndarray) -> np.ndarray:
        keys = np.asarray(keys, np.uint64)
        mark, one, two = self._places(keys)
        found = (self.table[one] == mark[:, None]).any(axis=1) | (self.table[two] == mark[:, None]).any(axis=1)
        return found | np.isin(keys, np.array(self.stash, np.uint64)) if self.stash else found

    def to_bytes(self) -> bytes:
        return np.array([len(self.table), len(self.stash), *self.stash], np.uint64).tobytes() + self.table.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> CuckooFilter:
        made = cls(1)
        buckets, stash = np.frombuffer(raw, np.uint64, 2).tolist()
        made.stash = np.frombuffer(raw, np.uint64, stash, 16).tolist()
        made.table = np.frombuffer(raw, np.uint16, buckets * cls.SLOTS, 16 + 8 * stash).reshape(-1, cls.SLOTS).copy()
        return made


def line_key(line: bytes) -> bytes:
    return line.strip(_STRIP).lower()


def _long(key: bytes, least: int) -> bool:
    """Whether a key has that many code points."""
    return len(key) >= least and (len(key) >= 4 * least or len(key) - sum(0x80 <= b < 0xC0 for b in key) >= least)


def _hashes(text: bytes, least: int) -> list[bytes | None]:
    """The 128-bit digest of each line's key; None for lines that are too short."""
    return [xxhash.xxh3_128_digest(k) if _long(k := line_key(line), least) else None for line in text.split(b"\n")]


def line_references(docs: DataFrame, *, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(k1, k2, id, digest): each long line's key, once for each document (id, digest, text binary)."""
    common.prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, rows = [], []
            for i, text in enumerate(batch.column(2)):
                own = {h for h in _hashes(text.as_py(), least_chars) if h}
                found.extend(own)
                rows.extend([i] * len(own))
            pair = np.frombuffer(b"".join(found), "<i8").reshape(-1, 2)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(pair[:, 0].copy()), pa.array(pair[:, 1].copy()), batch.column(0).take(at), batch.column(1).take(at)], ["k1", "k2", "id", "digest"]
            )

    return docs.select("id", "digest", "text").mapInArrow(common.lean(run), "k1 long, k2 long, id long, digest long")


@dataclass
class LineState:
    """Stored tables: references (k1, k2, id, digest), counts (k1, k2, n, last) and filters (shard, room, filter)."""

    references: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int
    least_docs: int = LEAST_DOCS


def _shard(shards: int) -> Column:
    return F.pmod("k2", F.lit(shards)).cast("int")


_FILTER = "shard int, room long, filter binary"


def _filter_row(shard: int, made: CuckooFilter) -> pa.Table:
    return pa.table({"shard": pa.array([shard], pa.int32()), "room": pa.array([made.room], pa.int64()), "filter": pa.array([made.to_bytes()], pa.binary())})


def _heavy(counts: DataFrame, shards: int, least_docs: int) -> DataFrame:
    return counts.filter(F.col("n") >= least_docs).select(_shard(shards).alias("shard"), "k1")


def _filters(heavy: DataFrame) -> DataFrame:
    """A filter for each shard of heavy (shard, k1), with room for an eighth more."""

    def build(table: pa.Table) -> pa.Table:
        made = CuckooFilter(len(table) + len(table) // 8 + 64)
        made.insert(table.column("k1").to_numpy().view(np.uint64))
        return _filter_row(table.column("shard")[0].as_py(), made)

    return heavy.groupBy("shard").applyInArrow(build, _FILTER)


def build(docs: DataFrame, *, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> LineState:
    """The state after inserting docs (id, digest, text binary) into an empty one."""
    references = common.stored(line_references(docs, least_chars=least_chars))
    counts = common.stored(references.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.max("id").alias("last")))
    heavy = counts.filter(F.col("n") >= least_docs).count()
    shards = max(1, -(-heavy // SHARD_LINES))
    return LineState(references, counts, common.stored(_filters(_heavy(counts, shards, least_docs))), shards, least_docs)


def _changed(state: LineState, references: DataFrame, counts: DataFrame) -> LineState:
    """Filters follow the lines whose count crossed the threshold; those that would be too full are made anew from the counts."""
    least = state.least_docs
    before = state.counts.select("k1", "k2", F.col("n").alias("was"))
    crossed = counts.join(before, ["k1", "k2"], "full").select("k1", "k2", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("was", F.lit(0)).alias("was"))
    crossed = crossed.filter((F.col("n") >= least) != (F.col("was") >= least)).select(_shard(state.shards).alias("shard"), "k1", (F.col("n") >= least).alias("now"))
    heavy = _heavy(counts, state.shards, least)
    sizes = heavy.groupBy("shard").agg(F.count("*").alias("size"))
    full = common.stored(sizes.join(state.filters.select("shard", "room"), "shard", "left").filter("room is null or size > room").select("shard"))

    def change(old: pa.Table, new: pa.Table) -> pa.Table:
        made, keys, now = CuckooFilter.from_bytes(old.column("filter")[0].as_py()), new.column("k1").to_numpy().view(np.uint64), new.column("now").to_numpy()
        made.delete(keys[~now])
        made.insert(keys[now])
        return _filter_row(old.column("shard")[0].as_py(), made)

    kept = state.filters.join(full, "shard", "left_anti")
    changed = kept.groupBy("shard").cogroup(crossed.join(full, "shard", "left_anti").groupBy("shard")).applyInArrow(change, _FILTER)
    filters = changed.unionByName(_filters(heavy.join(full, "shard", "left_semi")))
    return LineState(references, counts, common.stored(filters), state.shards, least)


def insert(state: LineState, docs: DataFrame, *, least_chars: int = LEAST_CHARS) -> LineState:
    """The state with more documents in it."""
    new = common.stored(line_references(docs, least_chars=least_chars))
    more = new.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.max("id").alias("last"))
    counts = state.counts.unionByName(more).groupBy("k1", "k2").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
    return _changed(state, common.stored(state.references.unionByName(new)), common.stored(counts))


def delete(state: LineState, docs: DataFrame, *, least_chars: int = LEAST_CHARS) -> LineState:
    """The state without these documents, all rows of which were inserted before: as if they never had been."""
    gone = common.stored(line_references(docs, least_chars=least_chars))
    rows = ["k1", "k2", "id", "digest"]
    # only lines that the documents hold are looked at row by row, as often as each row goes
    touched = common.stored(gone.select("k1", "k2").distinct())
    among = state.references.join(touched, ["k1", "k2"], "left_semi").select(*rows)
    left = common.stored(among.exceptAll(gone.select(*rows)))
    references = common.stored(state.references.join(touched, ["k1", "k2"], "left_anti").select(*rows).unionByName(left))
    fresh = left.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.max("id").alias("last"))
    counts = state.counts.join(touched, ["k1", "k2"], "left_anti").unionByName(fresh)
    return _changed(state, references, common.stored(counts))


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by shard, its filter first; what the filter may hold goes on."""
    shard, filter_ = None, None
    for batch in batches:
        shards = batch.column(0).to_numpy()
        edges = np.flatnonzero(np.concatenate(([True], shards[1:] != shards[:-1], [True])))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if shards[a] != shard:
                shard, filter_ = shards[a], None
            raw = batch.column(1)[a].as_py()
            if raw is not None:
                filter_ = CuckooFilter.from_bytes(raw)
                a += 1
            if filter_ is None or a == b:
                continue
            part = batch.slice(a, b - a)
            yield pa.RecordBatch.from_arrays(part.columns[2:], part.schema.names[2:]).filter(pa.array(filter_.contains(part.column(2).to_numpy().view(np.uint64))))


def dropped_lines(state: LineState) -> DataFrame:
    """(id, digest, keys array<struct<k1,k2>>): for each document the lines it loses, being in a later one as well.

    Rows that are equal in id and digest have the same lines; the set has each once, however many rows there are.
    """
    parts = int(state.references.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = ["k1", "k2", "id", "digest"]
    salt = F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")
    probes = state.references.select((_shard(state.shards) * SALTS + salt).alias("shard"), F.lit(None).cast("binary").alias("filter"), *names)
    filters = state.filters.select(F.explode(F.sequence(F.col("shard") * SALTS, F.col("shard") * SALTS + SALTS - 1)).alias("shard"), "filter", *(F.lit(None).cast("long").alias(n) for n in names))
    rows = filters.unionByName(probes).repartition(parts, "shard").sortWithinPartitions("shard", F.col("filter").isNull())
    maybe = rows.mapInArrow(common.lean(_probe), "k1 long, k2 long, id long, digest long")
    heavy = state.counts.filter(F.col("n") >= state.least_docs).select("k1", "k2", "last")
    sure = maybe.join(heavy, ["k1", "k2"]).filter("id < last")
    return sure.groupBy("id", "digest").agg(F.collect_set(F.struct("k1", "k2")).alias("keys"))


def _drop(least_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, lines, dropped = [], [], []
            for text, keys in zip(batch.column(0), batch.column(1)):
                text, keys = text.as_py(), keys.as_py()
                if not keys:
                    n = text.count(b"\n") + 1
                    kept.append(text)
                    lines.append(n)
                    dropped.append(0)
                    continue
                gone = {np.array([k["k1"], k["k2"]], "<i8").tobytes() for k in keys}
                own = text.split(b"\n")
                stay = [line for line, h in zip(own, _hashes(text, least_chars)) if h not in gone]
                kept.append(b"\n".join(stay))
                lines.append(len(own))
                dropped.append(len(own) - len(stay))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[2:], pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.binary())], [*batch.schema.names[2:], "n_lines", "n_dropped", "kept"]
            )

    return run


def drop_repeated_lines(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(carry columns, n_lines, n_dropped, kept binary) for each row of df.

    A null or empty text is one empty line. Each row is a document: a repeated row counts again, and rows that
    share the largest id of a line all keep it. A null id is smaller than any other. Long texts are taken whole; an
    empty table gives an empty one. A carried column named like a result is an error.
    """
    common.prepare(df.sparkSession)
    carry = [id_col] if carry is None else carry
    common.free_names(carry, ["n_lines", "n_dropped", "kept"])
    id_, digest = common.key_columns(id_col, text_col)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    keyed = df.select(id_.alias("id"), digest.alias("digest"), text.alias("text"), F.struct(*(F.col(c) for c in carry)).alias("row"))
    state = build(keyed, least_chars=least_chars, least_docs=least_docs)
    gone = dropped_lines(state)
    joined = keyed.join(gone, ["id", "digest"], "left").select("text", "keys", "row")
    made = joined.mapInArrow(common.lean(_drop(least_chars)), f"row {joined.schema['row'].dataType.simpleString()}, n_lines long, n_dropped long, kept binary")
    return made.select("row.*", "n_lines", "n_dropped", "kept")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = drop_repeated_lines(common.documents(spark, sf_dir))
    return made.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))
