"""Jaccard join of word shingles: PartEnum signatures, candidate groups, exact likeness and connected components."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.llm import common, simhash

#: Words of a shingle, and the least likeness as a fraction of two whole numbers.
SHINGLE, LIKENESS = 3, (90, 100)

#: Second-level parts of a first-level part; all but one of them make a signature.
CELLS = 3

#: Signatures over fewer features than this also say what the part left out holds, up to one feature.
SPARSE = 4

#: Signatures that a task holds before it sends them on, and words whose hashes a worker remembers.
HELD, KNOWN = 1 << 20, 300_000

_EVEN, _ODD, _THIRD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_LOW = np.uint64(0xFFFFFFFF)


def _mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads each bit over all."""
    h = (h ^ (h >> np.uint64(30))) * _ODD
    h = (h ^ (h >> np.uint64(27))) * _THIRD
    return h ^ (h >> np.uint64(31))


class _Words(dict):
    """XXH64 of each word that was asked for."""

    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh64_intdigest(word, 7)
        if len(self) < KNOWN:
            self[word] = found
        return found


def shingle_set(text: bytes, size: int = SHINGLE, known: _Words | None = None) -> np.ndarray:
    """64-bit hashes of the distinct shingles, ascending; fewer words are one shingle, without words there is none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    known = _Words() if known is None else known
    w = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    run = min(size, len(w))
    n = len(w) - run + 1
    h = np.full(n, run, np.uint64)
    for j in range(run):
        h = _mix(h * _EVEN + w[j : j + n])
    return np.unique(h)


class Bands:
    """Bands of set sizes, and for each band the first-level parts that its signatures need.

    A band ends where the likeness times its end reaches its start, so two sets that are alike are in one band or in
    neighbouring ones. A set has the signatures of its own band and of the next; two alike sets share those of the
    larger one's band. There they differ in k features at most. k + 1 over two first-level parts, rounded up, leave one
    part with one difference at most, and so one way to leave a cell of it out after which both are equal.
    """

    def __init__(self, likeness: tuple[int, int] = LIKENESS):
        num, den = likeness
        if not 0 < num <= den:
            raise ValueError("likeness must be a fraction above 0 and up to 1")
        self.likeness, self.ends, self.parts = likeness, [], []
        start = 1
        while num < den and start < 1 << 40:  # sets that have to be equal need no bands
            end = start * den // num
            k = 2 * end * (den - num) // (den + num)
            self.ends.append(end)
            self.parts.append((k + 2) // 2 if k else 0)  # sets that must not differ are equal, and need no signature
            start = end + 1

    def of(self, size: int) -> tuple[int, int]:
        own = int(np.searchsorted(self.ends, size))
        return own, own + 1


@lru_cache
def _bands(likeness: tuple[int, int]) -> Bands:
    return Bands(likeness)


def signatures(features: np.ndarray, bands: Bands) -> np.ndarray:
    """All signatures of a set: for each band, first-level part and cell left out, one hash of the other cells' features.

    Where those cells hold fewer than SPARSE features, which says little, the cell left out is added: its features, and
    these without each one of them. The cell differs in one feature at most, so alike sets still share one.
    """
    made = []
    with np.errstate(over="ignore"):
        value = _mix(features + _EVEN)
        for band in bands.of(len(features)):
            n = bands.parts[band] if band < len(bands.parts) else 0
            if not n:
                continue
            part = (features >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)
            cell = part * np.uint64(CELLS) + ((features & _LOW) * np.uint64(CELLS) >> np.uint64(32))
            cell = cell.astype(np.int64)
            sums = np.zeros(n * CELLS, np.uint64)
            np.add.at(sums, cell, value)
            counts = np.bincount(cell, minlength=n * CELLS).reshape(n, CELLS)
            sums = sums.reshape(n, CELLS)
            place = _mix(np.arange(n * CELLS, dtype=np.uint64) + np.uint64(band << 40)).reshape(n, CELLS)
            keys = np.empty((n, CELLS), np.uint64)
            for left in range(CELLS):
                key = place[:, left]
                for c in range(CELLS):
                    if c != left:
                        key = _mix(key * _EVEN + sums[:, c])
                keys[:, left] = key
            thin = counts.sum(axis=1, keepdims=True) - counts < SPARSE
            made.append(keys[~thin])
            for p, left in zip(*np.nonzero(thin)):
                rest = sums[p, left] - np.append(value[cell == p * CELLS + left], np.uint64(0))
                made.append(_mix(keys[p, left] * _EVEN + rest))
    return np.concatenate(made) if made else np.zeros(0, np.uint64)


def _node(features: np.ndarray) -> int:
    """The number by which a set is known: equal sets have one."""
    return xxhash.xxh64_intdigest(features.tobytes(), 1)


def _each(batch: pa.RecordBatch, column: int) -> Iterator[bytes]:
    data, offsets = common.flat_text(batch.column(column))
    view = memoryview(np.ascontiguousarray(data))
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        yield bytes(view[a:b])


def sets(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """(id, digest, node, n) for each row: the keys of common.key_columns, the set's number and its size."""
    common.prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for batch in batches:
            found = [shingle_set(t, size, known) for t in _each(batch, 2)]
            node = np.array([_node(f) for f in found], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(node), pa.array([len(f) for f in found], pa.int64())], ["id", "digest", "node", "n"])

    id_, digest = common.key_columns(id_col, text_col)
    keyed = df.select(id_.alias("id"), digest.alias("digest"), F.col(text_col).cast("string").alias("text"))
    return keyed.mapInArrow(common.lean(run), "id long, digest long, node long, n long")


def _combined(sig: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
    """Rows (sig, a, b) of what a task holds: each signature once with one node (a = b), and the links to that node.

    Links need not meet anything, so they are dealt by their own hash.
    """
    order = np.lexsort((node, sig))
    sig, node = sig[order], node[order]
    new = np.concatenate(([True], sig[1:] != sig[:-1]))
    first = node[np.flatnonzero(new)]
    head = first[np.cumsum(new) - 1]
    far = node != head
    links = np.unique(np.stack([head[far], node[far]], axis=1), axis=0)
    with np.errstate(over="ignore"):
        own = _mix(links[:, 0].view(np.uint64) * _EVEN + links[:, 1].view(np.uint64))
    columns = [np.concatenate([sig[new], own]).view(np.int64), np.concatenate([first, links[:, 0]]), np.concatenate([first, links[:, 1]])]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["sig", "a", "b"])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) from rows (sig, a, b) that come sorted by sig: each node with the first one of its signature."""
    last_sig, last_node = None, 0
    for batch in batches:
        sig, a, b = (c.to_numpy() for c in batch.columns)
        own = a == b
        x, y = [a[~own]], [b[~own]]
        sig, node = sig[own], a[own]
        if len(sig):
            new = np.concatenate(([sig[0] != last_sig], sig[1:] != sig[:-1]))
            first = np.concatenate(([last_node], node[new]))
            head = first[np.cumsum(new)]
            last_sig, last_node = sig[-1], head[-1]
            far = head != node
            x.append(head[far])
            y.append(node[far])
        links = np.unique(np.stack([np.concatenate(x), np.concatenate(y)], axis=1), axis=0)
        if len(links):
            yield pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], ["a", "b"])


def candidate_links(df: DataFrame, *, text_col: str = "text", size: int = SHINGLE, likeness: tuple[int, int] = LIKENESS) -> DataFrame:
    """(a, b): links between the numbers of sets that connect all sets with a common signature.

    Signatures of a task are combined before they are dealt, so one that very many sets have is sent once a task.
    """
    spark = df.sparkSession
    common.prepare(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, bands = _Words(), _bands(likeness)
        sig, node, held = [], [], 0
        for batch in batches:
            for text in _each(batch, 0):
                found = shingle_set(text, size, known)
                if len(found):
                    sig.append(signatures(found, bands))
                    node.append(np.full(len(sig[-1]), _node(found), np.uint64))
                    held += len(sig[-1])
                    if held >= HELD:
                        yield _combined(np.concatenate(sig), np.concatenate(node).view(np.int64))
                        sig, node, held = [], [], 0
        if held:
            yield _combined(np.concatenate(sig), np.concatenate(node).view(np.int64))

    made = df.select(F.col(text_col).cast("string").alias("text")).mapInArrow(common.lean(run), "sig long, a long, b long")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return made.repartition(parts, "sig").sortWithinPartitions("sig").mapInArrow(common.lean(_linked), "a long, b long")


def _pairs(blocks: DataFrame, pairs) -> DataFrame:
    """blocks (root, block, node, hashes, ...) dealt to the pairs (i <= j) of blocks that a column of structs names."""
    spark = blocks.sparkSession
    dealt = blocks.select("root", "block", "node", "hashes", F.explode(pairs).alias("p")).select("root", "p.i", "p.j", "block", "node", "hashes")
    return dealt.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "root", "i", "j").sortWithinPartitions("root", "i", "j")


def _pair(a, b):
    return F.struct(F.least(a, b).alias("i"), F.greatest(a, b).alias("j"))


def exact_links(groups: DataFrame, likeness: tuple[int, int] = LIKENESS) -> DataFrame:
    """(a, b): links that connect just the sets of a group with that likeness; groups (root, node, n, hashes), stored.

    A group's sets are dealt to blocks, and its first block is held against all. Where that leaves parts apart, all sets
    outside of the group's largest part are held against each other and against that part: so a group of copies that
    are all near each other costs as much as it has sets, any other one the square of what stays apart.
    Every pair that may still join two parts is compared.
    """
    near = simhash._alike(likeness[0] / likeness[1])
    amount = F.greatest(F.ceil(F.count("*") / simhash.SETS), F.ceil(F.sum("n") * 8 / simhash.SET_BYTES)).cast("int")
    count = common.stored(groups.groupBy("root").agg(amount.alias("blocks")))
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = groups.join(count, "root").withColumn("block", block)
    others = F.sequence(F.lit(0), F.col("blocks") - 1)
    pivots = F.when(F.col("block") == 0, F.transform(others, lambda k: _pair(F.lit(0), k))).otherwise(F.array(_pair(F.lit(0), F.col("block"))))
    links = common.stored(_pairs(dealt, pivots).mapInArrow(common.lean(near), "a long, b long"))
    if not count.filter("blocks > 1").limit(1).count():
        return links
    parts = simhash.components(links).toDF("node", "part")
    placed = groups.join(count.filter("blocks > 1").select("root"), "root").join(parts, "node", "left").withColumn("part", F.coalesce("part", "node"))
    placed = common.stored(placed)
    sizes = common.stored(placed.groupBy("root", "part").agg(F.count("*").alias("sets"), F.sum("n").alias("n")))
    largest = sizes.groupBy("root").agg(F.max_by("part", F.struct("sets", "part")).alias("largest"))
    need = lambda n, s: F.greatest(F.ceil(n / simhash.SETS), F.ceil(s * 8 / simhash.SET_BYTES)).cast("int")
    apart = F.col("part") != F.col("largest")
    shape = sizes.join(largest, "root").groupBy("root", "largest").agg(
        need(F.sum(F.when(apart, F.col("sets"))), F.sum(F.when(apart, F.col("n")))).alias("outer"), need(F.sum(F.when(~apart, F.col("sets"))), F.sum(F.when(~apart, F.col("n")))).alias("inner")
    )
    shape = common.stored(shape.filter("outer > 0"))
    spread = F.xxhash64("node")
    place = F.when(apart, F.pmod(spread, F.col("outer"))).otherwise(F.col("outer") + F.pmod(spread, F.col("inner"))).cast("int")
    again = placed.join(shape, "root").withColumn("block", place)
    every = F.sequence(F.lit(0), F.col("outer") + F.col("inner") - 1)
    outer = F.sequence(F.lit(0), F.col("outer") - 1)
    wanted = F.when(apart, F.transform(every, lambda k: _pair(F.col("block"), k))).otherwise(F.transform(outer, lambda k: _pair(F.col("block"), k)))
    return links.union(_pairs(again, wanted).mapInArrow(common.lean(near), "a long, b long"))


def joined(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, likeness: tuple[int, int] = LIKENESS) -> DataFrame:
    """(id_col, n_shingles, component_id) of each row: the smallest id that links of alike texts reach, itself included.

    Two texts are linked if the Jaccard likeness of their shingle sets is that or more. Equal sets are one node, so copies
    are never paired. Texts without words are linked with nothing: each has its own id, also beside another such row. A
    null id counts as the smallest of all. Repeated rows give repeated rows; other columns are not looked at.
    """
    rows = common.stored(sets(df, id_col=id_col, text_col=text_col, size=size))
    some = rows.filter("n > 0")
    roots = simhash.components(candidate_links(df, text_col=text_col, size=size, likeness=likeness)).toDF("node", "root")
    members = common.stored(roots.union(roots.select(F.col("root").alias("node"), "root")).distinct())
    classes = common.stored(some.groupBy("node").agg(F.min(F.struct("id", "digest")).alias("row"), F.first("n").alias("n")))
    wanted = classes.join(members, "node").select("root", "node", "n", "row.id", "row.digest")
    id_, digest = common.key_columns(id_col, text_col)
    keyed = df.select(id_.alias("id"), digest.alias("digest"), F.col(text_col).cast("string").alias("text"))
    # a repeated row would bring its text more than once
    texts = keyed.join(wanted, ["id", "digest"]).groupBy("root", "node", "n").agg(F.first("text").alias("text"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for batch in batches:
            made = [shingle_set(t, size, known).tobytes() for t in _each(batch, 3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(made, pa.binary())], ["root", "node", "n", "hashes"])

    groups = common.stored(texts.select("root", "node", "n", "text").mapInArrow(common.lean(whole), "root long, node long, n long, hashes binary"))
    parts = simhash.components(exact_links(groups, likeness)).toDF("node", "part")
    placed = common.stored(classes.join(parts, "node", "left").select("node", F.coalesce("part", "node").alias("part"), F.col("row.id").alias("least")))
    best = placed.groupBy("part").agg(F.min("least").alias("best"))
    found = common.stored(placed.join(best, "part").select("node", "best"))
    made = some.join(found, "node").select("id", "n", "best").union(rows.filter("n = 0").select("id", "n", F.col("id").alias("best")))

    def real(c: str):
        return F.when(F.col(c) != common.NULL_ID, F.col(c))

    return made.select(real("id").alias(id_col), F.col("n").alias("n_shingles"), real("best").alias("component_id"))


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(common.documents(spark, sf_dir))
