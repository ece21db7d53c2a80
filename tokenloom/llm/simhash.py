"""SimHash near-duplicates: pigeonring candidates, an exact Hamming check and connected components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.llm import common

SHINGLE, MAX_BITS, SEED = 4, 4, 42

#: Segments of a fingerprint and the segments of a chain; a chain's agreeing segments make an index key.
SEGMENTS, CHAIN = 8, 5

#: Fingerprints that are compared with each other at once; a key or a group with more is dealt out as pairs of blocks.
BLOCK = 2048

#: Rows that are held before links come out, and pairs compared at once.
HELD, STRIPE = 1 << 17, 1 << 19

#: Near texts by the likeness of their shingle sets. Candidates come from wide fingerprints over short shingles, of which
#: an edit changes fewer: keys find all within KEY_BITS, and what meets there may differ in NEAR_BITS.
LIKE_SHINGLE, LIKENESS = 5, 0.8
WIDE_WORDS, WIDE_SHINGLE, WIDE_SEGMENTS, KEY_BITS, NEAR_BITS = 2, 2, 16, 9, 24

#: Sets, and bytes of sets, on average in a block that is compared as a whole.
SETS, SET_BYTES = 512, 4 << 20

_KEY_LOW = 127


class Ring:
    """The segments of fingerprints of some 64-bit words around a ring: index keys and budgets of chains.

    Pigeonring: of fingerprints within max_bits of each other, some start has a chain whose first n segments differ in
    floor(n * max_bits / segments) bits at most, for every n up to `chain`. So few of the chain's segments differ at
    all; each way to choose which ones gives a key of the others. Keys are made for key_bits, and are lossless so far.
    """

    def __init__(self, max_bits: int, *, key_bits: int | None = None, words: int = 1, segments: int = SEGMENTS, chain: int = CHAIN):
        width = 64 * words // segments
        key_bits = max_bits if key_bits is None else key_bits
        most = [(n + 1) * key_bits // segments for n in range(chain)]
        self.max_bits, self.words = max_bits, words
        self.budgets = [(n + 1) * max_bits // segments for n in range(chain)]
        #: of each key its mask over all bits, and the segment where its chain starts
        self.masks: list[int] = []
        starts = []
        for start in range(segments):
            for differ in combinations(range(chain), most[-1]):
                if all(sum(d <= n for d in differ) <= b for n, b in enumerate(most)):
                    self.masks.append(sum(((1 << width) - 1) << ((start + n) % segments * width) for n in range(chain) if n not in differ))
                    starts.append(start)
        if len(self.masks) > _KEY_LOW + 1:
            raise ValueError("too many keys for their numbers")
        self.starts = np.array(starts)
        chains = [[sum(((1 << width) - 1) << ((s + k) % segments * width) for k in range(n + 1)) for n in range(chain)] for s in range(segments)]
        #: (segments, chain, words): the bits of the first n segments from each start on
        self.prefixes = np.array([[self.split(m) for m in row] for row in chains], np.uint64)

    def split(self, mask: int) -> list[int]:
        return [mask >> (64 * w) & (1 << 64) - 1 for w in range(self.words)]

    def keys(self, columns: list[str]) -> Column:
        """All keys of a fingerprint; a key's lowest bits have its number."""

        def key(n: int, mask: int) -> Column:
            own = [F.col(c).bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)) for c, m in zip(columns, self.split(mask)) if m]
            return F.xxhash64(F.lit(n), *own).bitwiseAND(F.lit(~_KEY_LOW)).bitwiseOR(F.lit(n))

        return F.array(*(key(n, m) for n, m in enumerate(self.masks)))

    def near(self, a: np.ndarray, b: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Which rows of a and b (rows, words) keep to the budgets of their key's chain, longest first, and then to max_bits."""
        start = self.starts[key & _KEY_LOW]
        diff = a ^ b
        at = np.arange(len(diff))
        for n in range(len(self.budgets) - 1, -1, -1):
            own = diff[at] & self.prefixes[start[at], n]
            at = at[np.bitwise_count(own).sum(axis=1, dtype=np.int64) <= self.budgets[n]]
        return at[np.bitwise_count(diff[at]).sum(axis=1, dtype=np.int64) <= self.max_bits]

    def block_pairs(self, left: np.ndarray, right: np.ndarray, key: int) -> tuple[np.ndarray, np.ndarray]:
        """The same for all pairs of two blocks of one key, a stripe at a time: (rows of left, rows of right)."""
        whole, most = self.prefixes[self.starts[key & _KEY_LOW], -1], self.budgets[-1]
        xs, ys = [], []
        stripe = max(1, STRIPE // max(1, len(right)))
        for i in range(0, len(left), stripe):
            part = left[i : i + stripe]
            bits = sum(np.bitwise_count((part[:, None, w] ^ right[None, :, w]) & whole[w]) for w in range(self.words))
            x, y = np.nonzero(bits <= most)
            ok = self.near(part[x], right[y], np.full(len(x), key, np.int64))
            xs.append(i + x[ok])
            ys.append(y[ok])
        return np.concatenate(xs), np.concatenate(ys)


def _spans(text: bytes, size: int) -> tuple[bytes, list[int], list[int]]:
    """The words joined by spaces, and where each shingle begins and ends; fewer words than a shingle has are one."""
    words = text.lower().split()
    if not words:
        return b"", [], []
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - size + 1)
    return b" ".join(words), starts[:n].tolist(), ends[min(size, len(words)) - 1 :].tolist()


def _hashes(joined: bytes, starts: list[int], ends: list[int], seed: int = SEED) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[x:y], seed) for x, y in zip(starts, ends)), np.uint64, len(starts))


def _majority(hashes: np.ndarray) -> int:
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65536):
        counts += np.unpackbits(hashes[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes, size: int = SHINGLE, seed: int = SEED) -> int:
    """Majority bits of the XXH64 of all word shingles of a text, repeats included; without words 0."""
    joined, starts, ends = _spans(text, size)
    return _majority(_hashes(joined, starts, ends, seed)) if starts else 0


def wide_fingerprint(joined: bytes, starts: list[int], ends: list[int], words: int = WIDE_WORDS) -> list[int]:
    """Majority bits over the distinct shingles, 64 for each of some hashes derived from theirs."""
    h = np.unique(_hashes(joined, starts, ends))
    found = []
    for n in range(words):
        found.append(_majority(h) if len(h) else 0)
        with np.errstate(over="ignore"):
            h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return found


def shingle_set(text: bytes, size: int = LIKE_SHINGLE) -> np.ndarray:
    """The distinct XXH64 of all word shingles of a text, ascending."""
    return np.unique(_hashes(*_spans(text, size)))


def fingerprints(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """(id_col, fp long) for each row; fp has the 64 bits as a signed number. Null and empty texts have 0."""
    common.prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = common.flat_text(batch.column(1))
            view = memoryview(np.ascontiguousarray(data))
            found = [fingerprint(bytes(view[a:b]), size) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(found, np.uint64).view(np.int64))], ["id", "fp"])

    narrow = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(common.lean(run), "id long, fp long").withColumnRenamed("id", id_col)


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node that the pairs connect it with."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        open_ = ra != rb
        if not open_.any():
            break
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def _spanning(a: list[np.ndarray], b: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A forest with the same components as the pairs: (member, smallest member), fewer rows than members."""
    if not a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = np.concatenate(a), np.concatenate(b)
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = _forest(len(nodes), at[: len(a)], at[len(a) :])
    far = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[far], nodes[root[far]]


def _node(fp: np.ndarray) -> np.ndarray:
    """The number by which links name a fingerprint: itself, or a hash of a wider one."""
    if fp.shape[1] == 1:
        return fp[:, 0].view(np.int64)
    h = np.zeros(len(fp), np.uint64)
    with np.errstate(over="ignore"):
        for w in range(fp.shape[1]):
            h = (h ^ fp[:, w]) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(31)
            h *= np.uint64(0x94D049BB133111EB)
            h ^= h >> np.uint64(29)
    return h.view(np.int64)


def _near_in_runs(ring: Ring, key: np.ndarray, fp: np.ndarray):
    """Links among equal keys (sorted), and the blocks of keys that have more than BLOCK members.

    Short runs are compared at one distance after the other, all runs at once, longer ones run by run: the tests are the same.
    """
    short = 48
    edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
    size = np.diff(edge)
    node = _node(fp)
    a, b, hot = [], [], []
    per = np.repeat(size, size)
    few = (per > 1) & (per <= short)
    for lag in range(1, int(per[few].max()) if few.any() else 0):
        i = np.flatnonzero(few[:-lag] & (key[lag:] == key[:-lag]))
        ok = i[ring.near(fp[i], fp[i + lag], key[i])]
        a.append(node[ok])
        b.append(node[ok + lag])
    for k in np.flatnonzero(size > short):
        members = fp[edge[k] : edge[k + 1]]
        if len(members) > BLOCK:
            hot += [(int(key[edge[k]]), n, members[i : i + BLOCK].tobytes()) for n, i in enumerate(range(0, len(members), BLOCK))]
        else:
            x, y = ring.block_pairs(members, members, int(key[edge[k]]))
            a.append(node[edge[k] + x])
            b.append(node[edge[k] + y])
    return a, b, hot


_LINKS = "a long, b long, key long, block int, members binary"


def _candidates(ring: Ring):
    """Links from rows (key, words of the fingerprint) that come sorted by key; keys with very many members come out as blocks."""

    def out(a, b, hot):
        a, b = _spanning(a, b)
        n, m = len(a), len(hot)
        columns = [
            pa.array([*a.tolist(), *[None] * m], pa.int64()),
            pa.array([*b.tolist(), *[None] * m], pa.int64()),
            pa.array([*[None] * n, *(h[0] for h in hot)], pa.int64()),
            pa.array([*[None] * n, *(h[1] for h in hot)], pa.int32()),
            pa.array([*[None] * n, *(h[2] for h in hot)], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["a", "b", "key", "block", "members"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps, held = [], [], 0
        hot_key, hot_block = None, 0

        def flush(last: bool):
            nonlocal keys, fps, held, hot_key, hot_block
            key, fp = np.concatenate(keys), np.concatenate(fps)
            # the last key may go on in the next batch
            cut = len(key) if last else int(np.searchsorted(key, key[-1]))
            if not cut and len(key) > 16 * BLOCK:
                cut = len(key) // BLOCK * BLOCK  # one key fills all: pass its blocks on as they come
            keys, fps, held = [key[cut:]], [fp[cut:]], len(key) - cut
            if not cut:
                return None
            a, b, hot = _near_in_runs(ring, key[:cut], fp[:cut])
            if hot_key is not None and key[0] == hot_key:  # more of a key some blocks of which are out
                n = int(np.searchsorted(key[:cut], hot_key, side="right"))
                own = [(int(hot_key), 0, fp[i : min(i + BLOCK, n)].tobytes()) for i in range(0, n, BLOCK)]
                hot = own + [h for h in hot if h[0] != hot_key]
                hot = [(k, hot_block + i if k == hot_key else j, m) for i, (k, j, m) in enumerate(hot)]
                hot_block += len(own)
            # nothing is left over only after a cut inside one key, which may go on
            if not last and (not len(keys[0]) or keys[0][0] == key[cut - 1]):
                if hot_key != key[cut - 1]:
                    hot_key, hot_block = key[cut - 1], sum(h[0] == key[cut - 1] for h in hot)
            else:
                hot_key, hot_block = None, 0
            return out(a, b, hot)

        for batch in batches:
            keys.append(batch.column(0).to_numpy())
            fps.append(np.stack([c.to_numpy().view(np.uint64) for c in batch.columns[1:]], axis=1))
            held += batch.num_rows
            if held >= HELD and (made := flush(False)) is not None:
                yield made
        if held and (made := flush(True)) is not None:
            yield made

    return run


def _grouped(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[list[dict]]:
    """Rows in lists of equal first n columns, by which they come sorted."""
    held: list[dict] = []
    mark = None
    for batch in batches:
        names = batch.schema.names[:n]
        for row in batch.to_pylist():
            own = tuple(row[c] for c in names)
            if own != mark and held:
                yield held
                held = []
            mark = own
            held.append(row)
    if held:
        yield held


def _hot_pairs(ring: Ring):
    """Links of rows (key, i, j, members): the one or two blocks of each pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches, 3):
            blocks = [np.frombuffer(r["members"], np.uint64).reshape(-1, ring.words) for r in rows]
            x, y = ring.block_pairs(blocks[0], blocks[-1], rows[0]["key"])
            if len(x):
                a, b = _spanning([_node(blocks[0])[x]], [_node(blocks[-1])[y]])
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return run


def _block_pairs(blocks: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """blocks (keys, n, block, columns) dealt to all pairs (i <= j) of the n blocks of a key."""
    spark = blocks.sparkSession
    each = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    dealt = each.select(*keys, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), *columns)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(parts, *keys, "i", "j").sortWithinPartitions(*keys, "i", "j")


def near_links(distinct: DataFrame, ring: Ring, *, columns: list[str]) -> DataFrame:
    """(a, b): links that connect just the fingerprints (columns, each once) that the ring's keys and budgets find near.

    In each key group only a spanning forest comes out, never all pairs. A key with more than BLOCK members is dealt
    out as pairs of blocks, each pair to a task of its own choice. Keys have 24 bits by default; from some 10**9
    fingerprints on, a ring with a longer chain (chain=8: 32 bits) is due.
    """
    spark = distinct.sparkSession
    common.prepare(spark)
    keyed = distinct.select(F.explode(ring.keys(columns)).alias("key"), *columns)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = common.stored(keyed.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(common.lean(_candidates(ring)), _LINKS))
    blocks = found.filter("members is not null").select("key", "block", "members")
    count = common.stored(blocks.groupBy("key").agg((F.max("block") + 1).alias("n")))
    dealt = _block_pairs(blocks.join(count, "key"), ["key"], ["members"])
    return found.filter("a is not null").select("a", "b").union(dealt.mapInArrow(common.lean(_hot_pairs(ring)), "a long, b long"))


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of the links but the roots themselves: root is the smallest node connected.

    Large-star and small-star steps in turn until nothing changes; each round's edges go to the shared folder.
    No node's neighbours are gathered: minima are aggregated and joined back.
    """
    edges = common.stored(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        both = edges.union(edges.select("v", "u"))
        # stored, so that adaptive execution may split the edges of a node with very many
        least = common.stored(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        edges = common.stored(small.select("e.u", "e.v").filter("u <> v").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now


def groups(made: DataFrame, *, max_bits: int = MAX_BITS, segments: int = SEGMENTS, chain: int = CHAIN, id_col: str = "doc_id") -> DataFrame:
    """(id_col, fp, component_id): made (id_col, fp; stored) with the smallest id that links reach, itself included.

    Equal fingerprints are one node, so copies are never paired. A null id counts as the smallest of all. Repeated
    rows give repeated rows; other columns of made are not looked at. An empty table gives an empty one.
    """
    own = made.select(F.col(id_col).alias("own_id"), "fp", F.coalesce(F.col(id_col).cast("long"), F.lit(common.NULL_ID)).alias("rank_id"))
    classes = common.stored(own.groupBy("fp").agg(F.min("rank_id").alias("least")))
    roots = components(near_links(classes.select("fp"), Ring(max_bits, segments=segments, chain=chain), columns=["fp"]))
    rooted = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = common.stored(rooted)
    best = rooted.groupBy("root").agg(F.min("least").alias("best"))
    found = common.stored(rooted.join(best, "root").select("fp", "best"))
    out = own.join(found, "fp")
    return out.select(F.col("own_id").alias(id_col), "fp", F.when(F.col("best") != common.NULL_ID, F.col("best")).alias("component_id"))


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, digest, text) to (id, digest, node, n, mark, f0, f1): node names the words in order, mark the fingerprint."""
    for batch in batches:
        data, offsets = common.flat_text(batch.column(2))
        view = memoryview(np.ascontiguousarray(data))
        node, n, fps = [], [], []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            joined, starts, ends = _spans(bytes(view[a:b]), WIDE_SHINGLE)
            node.append(xxhash.xxh64_intdigest(joined, SEED))
            n.append(len(starts))
            fps.append(wide_fingerprint(joined, starts, ends))
        fp = np.array(fps, np.uint64).reshape(-1, WIDE_WORDS)
        columns = [np.array(node, np.uint64).view(np.int64), np.array(n, np.int64), _node(fp), *(np.ascontiguousarray(fp[:, w]).view(np.int64) for w in range(WIDE_WORDS))]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(c) for c in columns)], ["id", "digest", "node", "n", "mark", "f0", "f1"])


def alike_pairs(left: list[np.ndarray], right: list[np.ndarray] | None, likeness: float) -> tuple[np.ndarray, np.ndarray]:
    """(rows of left, rows of right): sets whose Jaccard likeness is that or more; without right, pairs within left.

    Overlaps are products of 0/1 tables over the elements that two sets have, some columns at a time.
    """
    sets = left if right is None else left + right
    size = np.array([len(s) for s in sets], np.int64)
    elements, code, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), size)
    shared = times[code] > 1
    code = (np.cumsum(times > 1) - 1)[code[shared]]
    owner = owner[shared]
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    m = len(left)
    overlap = np.zeros((m, m if right is None else len(right)), np.float64)
    n = int((times > 1).sum())
    step = min(max(64, (1 << 22) // max(1, len(sets))), n)
    for lo in range(0, n, max(1, step)):
        a, b = np.searchsorted(code, (lo, lo + step))
        table = np.zeros((len(sets), step), np.float32)
        table[owner[a:b], code[a:b] - lo] = 1
        overlap += table[:m] @ (table if right is None else table[m:]).T
    both = size[:m, None] + (size if right is None else size[m:])[None, :]
    x, y = np.nonzero(overlap >= np.ceil(likeness / (1 + likeness) * both - 1e-9))
    return (x[x < y], y[x < y]) if right is None else (x, y)


def _alike(likeness: float):
    """Links (a, b) of rows (root, i, j, block, node, hashes) of the one or two blocks of a pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches, 3):
            one, two = ([r for r in rows if r["block"] == k] for k in (rows[0]["i"], rows[0]["j"]))
            if not one or not two or len(rows) < 2:
                continue
            sets = [[np.frombuffer(r["hashes"], np.uint64) for r in side] for side in (one, two)]
            x, y = alike_pairs(sets[0], None if rows[0]["i"] == rows[0]["j"] else sets[1], likeness)
            if len(x):
                a, b = _spanning([np.array([r["node"] for r in one], np.int64)[x]], [np.array([r["node"] for r in two], np.int64)[y]])
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return run


def alike_groups(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = LIKE_SHINGLE, likeness: float = LIKENESS) -> DataFrame:
    """(id, digest, root) for each row of df (stored): rows have one root if links of alike texts connect them.

    id and digest are those of common.key_columns. Texts are linked if their sets of word shingles have that Jaccard
    likeness, equal texts always. Wide fingerprints near each other form groups first; within a group every pair of
    different texts is held to the exact likeness, in blocks whatever the group's size, so only a pair that no chain of
    near fingerprints connects is missed. Links come out as spanning forests, never as all pairs.
    Texts without words are alike. Null texts count as empty, ids may be null or shared.
    """
    spark = df.sparkSession
    common.prepare(spark)
    id_, digest = common.key_columns(id_col, text_col)
    keyed = df.select(id_.alias("id"), digest.alias("digest"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = common.stored(keyed.mapInArrow(common.lean(_marks), "id long, digest long, node long, n long, mark long, f0 long, f1 long"))
    ring = Ring(NEAR_BITS, key_bits=KEY_BITS, words=WIDE_WORDS, segments=WIDE_SEGMENTS)
    marks = rows.groupBy("mark").agg(F.first("f0").alias("f0"), F.first("f1").alias("f1"))
    roots = components(near_links(marks, ring, columns=["f0", "f1"])).withColumnRenamed("node", "mark")
    nodes = rows.groupBy("node").agg(F.first("mark").alias("mark"), F.first("n").alias("n"), F.min(F.struct("id", "digest")).alias("row"))
    nodes = common.stored(nodes.join(roots, "mark", "left").select(F.coalesce("root", "mark").alias("root"), "node", "n", "row.id", "row.digest"))
    blocks = F.greatest(F.ceil(F.count("*") / SETS), F.ceil(F.sum("n") * 8 / SET_BYTES)).cast("int")
    # stored, so that adaptive execution may split a large group's nodes
    some = common.stored(nodes.groupBy("root").agg(F.count("*").alias("nodes"), blocks.alias("blocks")).filter("nodes > 1").drop("nodes"))
    wanted = nodes.drop("n").join(some, "root").withColumnRenamed("blocks", "n")
    # a repeated row would bring its text more than once
    texts = keyed.join(wanted, ["id", "digest"]).groupBy("node").agg(F.first("root").alias("root"), F.first("n").alias("n"), F.first("text").alias("text"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([shingle_set((x.as_py() or "").encode(), size).tobytes() for x in batch.column(3)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], made], ["root", "node", "n", "hashes"])

    sets = texts.select("root", "node", "n", "text").mapInArrow(common.lean(whole), "root long, node long, n int, hashes binary")
    dealt = _block_pairs(sets.withColumn("block", F.pmod(F.xxhash64("node"), F.col("n")).cast("int")), ["root"], ["block", "node", "hashes"])
    same = components(dealt.mapInArrow(common.lean(_alike(likeness)), "a long, b long")).toDF("node", "same")
    return rows.select("id", "digest", "node").join(same, "node", "left").select("id", "digest", F.coalesce("same", "node").alias("root"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = common.stored(fingerprints(common.documents(spark, sf_dir)))
    return groups(made).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
