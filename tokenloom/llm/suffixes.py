"""Exact removal of repeated byte strings: anchored suffixes, front-coded sorted runs and common-prefix-aware merging.

Every 200-byte window has an anchor, the rightmost least 64-gram hash in it, so equal windows have equal anchors at
equal places. The windows of one anchor start in one run, and the bytes they cover are the anchor's context. An anchor
hash that occurs once proves its windows unique; one whose contexts are all equal proves them repeated. Only contexts
of the other anchors are sorted: forward from the anchor and backward from it, as front-coded runs that loser trees
merge. Two windows are equal where both orders' common prefixes reach far enough.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.llm import common

WINDOW, GRAM = 200, 64

#: Contexts in a bucket on average, and occurrences from which an anchor's windows are counted one by one instead.
BUCKET, HOT = 16_384, 100_000

_SPAN = WINDOW - GRAM + 1
_PLACE = 26
_LOW = np.uint64((1 << _PLACE) - 1)


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Hash of the `gram` bytes (a power of two) from each place on, by doubling."""
    with np.errstate(over="ignore"):
        h = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        power, step = np.uint64(0x9E3779B97F4A7C15), 1
        while step < gram:
            h = h[:-step] * power + h[step:]
            power, step = power * power, step * 2
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(29)
    return h


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, first window, windows, anchor, hash) of each anchor of the texts in data; places count from the data's start."""
    none = (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
    if len(data) < WINDOW:
        return none
    if len(data) > 1 << 22 and len(offsets) == 2:  # one long text: pieces that overlap, so runs may end at their borders
        parts = []
        for a in range(0, len(data) - WINDOW + 1, 1 << 22):
            piece = data[a : a + (1 << 22) + WINDOW - 1]
            row, s, n, p, h = anchors(piece, np.array([0, len(piece)]))
            parts.append((row, s + a, n, p + a, h))
        return tuple(np.concatenate(x) for x in zip(*parts))
    h = gram_hashes(data)
    least = (h & ~_LOW) | (_LOW - np.arange(len(h), dtype=np.uint64))
    step = 1
    while step * 2 <= _SPAN:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    rest = _SPAN - step
    least = np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
    row = np.searchsorted(offsets, np.arange(len(least)), side="right") - 1
    inside = np.arange(len(least)) + WINDOW <= offsets[row + 1]
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | (row[1:] != row[:-1]) | ~inside[:-1]
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(least)))
    keep = inside[first]
    first, count = first[keep], count[keep]
    # windows over a text's end are none
    count = np.minimum(count, offsets[row[first] + 1] - WINDOW + 1 - first)
    place = (_LOW - (least[first] & _LOW)).astype(np.int64)
    return row[first], first, count, place, h[place]


def context_hashes(data: np.ndarray, first: np.ndarray, count: np.ndarray, place: np.ndarray) -> np.ndarray:
    view, digest = data.tobytes(), xxhash.xxh3_64_intdigest
    found = np.fromiter((digest(view[a:b]) for a, b in zip(first.tolist(), (first + count - 1 + WINDOW).tolist())), np.uint64, len(first))
    with np.errstate(over="ignore"):
        return found ^ ((place - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _anchor_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, n, least and largest context hash) for some MB of text at a time."""
    for batch in batches:
        data, offsets = common.flat_text(batch.column(2))
        for a, b in common.steps(offsets, common.SMALL_STEP_BYTES):
            part, off = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            _, first, count, place, h = anchors(part, off)
            if not len(h):
                continue
            c = context_hashes(part, first, count, place).view(np.int64)
            order = np.lexsort((c, h))
            h, c = h[order], c[order]
            at = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            n = np.diff(np.append(at, len(h)))
            yield pa.RecordBatch.from_arrays([_signed(h[at]), pa.array(n), pa.array(c[at]), pa.array(c[at + n - 1])], ["anchor", "n", "low", "high"])


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The anchors of each text; of contexts that a text has twice, one row that counts and a known row for each place.

    Known rows are spans already. Touching ones are one row, and a key of their own spreads them over the tasks.
    """
    names = ["id", "digest", "anchor", "first", "count", "shift", "known"]
    for batch in batches:
        data, offsets = common.flat_text(batch.column(2))
        for a, b in common.steps(offsets, common.SMALL_STEP_BYTES):
            part, off = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            row, first, count, place, h = anchors(part, off)
            if not len(h):
                continue
            # equal anchors in one text are few but in periodic texts: only there contexts are looked at
            order = np.lexsort((h, row))
            same = (h[order[1:]] == h[order[:-1]]) & (row[order[1:]] == row[order[:-1]])
            again = np.zeros(len(h), bool)
            again[order[1:][same]] = True
            again[order[:-1][same]] = True
            keep, known = np.ones(len(h), bool), np.zeros(0, np.int64)
            if again.any():
                at = np.flatnonzero(again)
                c = context_hashes(part, first[at], count[at], place[at])
                _, rep, which, times = np.unique(np.stack([row[at].astype(np.uint64), h[at], c], 1), axis=0, return_index=True, return_inverse=True, return_counts=True)
                many = times[which.ravel()] > 1
                known = at[many]
                keep[known] = False
                keep[at[rep]] = True
            own = np.flatnonzero(keep)
            # known contexts of a text that touch: places are in order
            end = first[known] + count[known] - 1 + WINDOW
            cut = np.flatnonzero(np.concatenate((np.ones(min(1, len(known)), bool), (row[known][1:] != row[known][:-1]) | (first[known][1:] > end[:-1]))))
            lo, hi, lr = first[known][cut], np.append(end[cut[1:] - 1], end[-1:])[: len(cut)], row[known][cut]
            with np.errstate(over="ignore"):
                spread = (lo.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) ^ (h[known][cut] * np.uint64(0xBF58476D1CE4E5B9))
            at = pa.array(np.concatenate([row[own], lr]))
            columns = [
                np.concatenate([h[own], spread]).view(np.int64), np.concatenate([first[own] - off[row[own]], lo - off[lr]]), np.concatenate([count[own], hi - lo - WINDOW + 1]),
                np.concatenate([(place - first)[own], np.zeros(len(lo), np.int64)]), np.concatenate([np.zeros(len(own), bool), np.ones(len(lo), bool)]),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).take(at), batch.column(1).slice(a, b - a).take(at), *(pa.array(x) for x in columns)], names)


def common_prefix(x: bytes, y: bytes, known: int = 0) -> int:
    """Length of the common prefix; the first `known` bytes are known to agree and are not read."""
    n = min(len(x), len(y))
    while known < n:
        a, b = x[known : known + 64], y[known : known + 64]
        if a == b:
            known += 64
            continue
        m = min(len(a), len(b))
        odd = int.from_bytes(a[:m], "big") ^ int.from_bytes(b[:m], "big")
        return known + (m - (odd.bit_length() + 7) // 8 if odd else m)
    return n


class LoserTree:
    """Merge sorted runs of strings. Each run is a list of (string, prefix it shares with the one before).

    A player's prefix length is held against the string that went out last, so the player with the longer one is
    smaller without reading a byte; equal lengths compare from there on only.
    """

    def __init__(self, runs: list[tuple[list[bytes], list[int]]]):
        self.runs = runs
        self.size = 1
        while self.size < max(1, len(runs)):
            self.size *= 2

    def __iter__(self):
        """(run, place in the run, common prefix with the string before) in order; ties by run."""
        runs, size = self.runs, self.size
        at = [0] * size
        ends = [len(r[0]) for r in runs] + [0] * (size - len(runs))
        string = [r[0][0] if r[0] else None for r in runs] + [None] * (size - len(runs))
        shared = [0] * size
        losers = [0] * size

        def play(a: int, b: int) -> tuple[int, int]:
            x, y = string[a], string[b]
            if x is None or y is None:
                return (b, a) if x is None else (a, b)
            p, q = shared[a], shared[b]
            if p != q:
                return (a, b) if p > q else (b, a)
            k = common_prefix(x, y, p)
            # the loser now meets the winner as the string before it
            if k < len(x) and (k == len(y) or x[k] > y[k]):
                shared[a] = k
                return b, a
            if k == len(x) == len(y) and b < a:
                shared[a] = k
                return b, a
            shared[b] = k
            return a, b

        winners = [*[0] * size, *range(size)]
        for node in range(size - 1, 0, -1):
            winners[node], losers[node] = play(winners[2 * node], winners[2 * node + 1])
        best = winners[1] if size > 1 else 0
        while string[best] is not None:
            i = at[best]
            yield best, i, shared[best]
            i += 1
            at[best] = i
            if i < ends[best]:
                string[best] = runs[best][0][i]
                shared[best] = runs[best][1][i]
            else:
                string[best] = None
            node = (best + size) >> 1
            while node:
                best, losers[node] = play(best, losers[node])
                node >>= 1


def front_code(strings: list[bytes]) -> tuple[list[int], list[int], bytes]:
    """Of sorted strings: prefix shared with the one before, length of the rest, and the rests."""
    shared = [0] * len(strings)
    for i in range(1, len(strings)):
        shared[i] = common_prefix(strings[i - 1], strings[i])
    rests = [s[k:] for s, k in zip(strings, shared)]
    return shared, [len(r) for r in rests], b"".join(rests)


def front_decode(shared: list[int], lengths: list[int], rests: bytes) -> list[bytes]:
    found, before, at = [], b"", 0
    for k, n in zip(shared, lengths):
        before = before[:k] + rests[at : at + n]
        at += n
        found.append(before)
    return found


_ITEM = np.dtype([("id", "<i8"), ("digest", "<i8"), ("first", "<i8"), ("count", "<i4"), ("shift", "<i4")])


def pack_run(items: np.ndarray, heads: list[bytes], contexts: list[bytes]) -> bytes:
    """One front-coded run in both directions: strings are the anchor's hash and then the context from the anchor on, or backward."""
    forward = [h + c[s:] for h, c, s in zip(heads, contexts, items["shift"].tolist())]
    order = sorted(range(len(items)), key=forward.__getitem__)
    back = [h + c[:s][::-1] for h, c, s in zip(heads, contexts, items["shift"].tolist())]
    rank = {i: n for n, i in enumerate(order)}
    back_order = sorted(range(len(items)), key=back.__getitem__)
    parts = [items[order].tobytes(), np.array([rank[i] for i in back_order], "<i4").tobytes()]
    for strings in ([forward[i] for i in order], [back[i] for i in back_order]):
        shared, lengths, rests = front_code(strings)
        parts += [np.array(shared, "<u2").tobytes(), np.array(lengths, "<u2").tobytes(), rests]
    head = np.array([len(items), *map(len, parts)], "<i8").tobytes()
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(parts))


def unpack_run(run: bytes):
    """(items, forward strings and prefixes, backward order, backward strings and prefixes)"""
    raw = zstandard.ZstdDecompressor().decompress(run)
    sizes = np.frombuffer(raw, "<i8", 9)
    bounds = np.cumsum([72, *sizes[1:]])
    part = [raw[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
    sides = []
    for i in (2, 5):
        shared, lengths = np.frombuffer(part[i], "<u2").tolist(), np.frombuffer(part[i + 1], "<u2").tolist()
        sides.append((front_decode(shared, lengths, part[i + 2]), shared))
    return np.frombuffer(part[0], _ITEM), sides[0], np.frombuffer(part[1], "<i4"), sides[1]


def repeated_windows(runs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(items, from, to): spans, in the items' documents, of windows that occur at least twice in the runs."""
    opened = [unpack_run(r) for r in runs]
    base = np.cumsum([0, *(len(o[0]) for o in opened)])
    items = np.concatenate([o[0] for o in opened])
    n = len(items)
    forward = list(LoserTree([o[1] for o in opened]))
    at = base[[r for r, _, _ in forward]] + np.array([i for _, i, _ in forward])
    items = items[at]
    place = np.empty(n, np.int64)
    place[at] = np.arange(n)
    reach = np.array([k for _, _, k in forward])
    backward = list(LoserTree([o[3] for o in opened]))
    back_at = place[np.array([base[r] + opened[r][2][i] for r, i, _ in backward])]
    back_reach = np.array([k for _, _, k in backward])
    shift, count = items["shift"], items["count"]
    least, most = int((shift - count + 1).min()), int(shift.max())
    covered = np.zeros((n, most - least + 1), bool)
    ahead = np.empty(n, np.int64)
    for e in range(least, most + 1):  # windows that start e bytes before their anchor
        own = np.flatnonzero((shift >= e) & (shift - count < e))
        if len(own) < 2:
            continue
        right = np.cumsum(reach < 8 + WINDOW - e)
        ahead[back_at] = np.cumsum(back_reach < 8 + e)
        key = right[own] * (n + 1) + ahead[own]
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        twice = np.zeros(len(own), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        covered[own[twice], most - e] = True  # columns run with the windows' starts
    edge = np.diff(np.pad(covered, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    item, a = np.nonzero(edge == 1)
    _, b = np.nonzero(edge == -1)
    start = items["first"][item] + shift[item] - most
    return items[item], start + a, start + b - 1 + WINDOW


_RUN = "bucket int, run binary"
_SPANS = "id long, digest long, lo long, hi long"


def _runs(buckets: int, most: int = 40_000):
    """Rows (id, digest, text, hits) to front-coded runs, one for each bucket that some thousand contexts fall in."""

    def flush(held):
        by: dict[int, list] = {}
        for x in held:
            by.setdefault(int.from_bytes(x[1], "big") % buckets, []).append(x)
        rows = [(b, pack_run(np.array([x[0] for x in xs], _ITEM), [x[1] for x in xs], [x[2] for x in xs])) for b, xs in by.items()]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "run"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            for i in range(batch.num_rows):
                id_, digest = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                text = batch.column(2)[i].as_buffer()
                text = memoryview(text) if text else b""
                for hit in batch.column(3)[i].as_py():
                    a, n = hit["first"], hit["count"]
                    held.append(((id_, digest, a, n, hit["shift"]), hit["anchor"].to_bytes(8, "big", signed=True), bytes(text[a : a + n - 1 + WINDOW])))
                if len(held) >= most:
                    yield flush(held)
                    held = []
        if held:
            yield flush(held)

    return run


def _merge(table: pa.Table) -> pa.Table:
    items, lo, hi = repeated_windows([x.as_py() for x in table.column("run")])
    return pa.table({"id": items["id"], "digest": items["digest"], "lo": lo.astype(np.int64), "hi": hi.astype(np.int64)})


_WINDOWS = "id long, digest long, lo long, hi long, h1 long, h2 long, weight int"


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For anchors that occur very often: two hashes of each window, for Spark to count.

    Windows that a text has twice are spans already, joined where they touch, and only one row stands for them, with
    weight 2: periodic texts would give as many equal rows as they have bytes.
    """
    kinds = [pa.int64()] * 6 + [pa.int32()]
    for batch in batches:
        for i in range(batch.num_rows):
            text = bytes(memoryview(batch.column(2)[i].as_buffer()))
            at = np.unique(np.concatenate([np.arange(h["first"], h["first"] + h["count"]) for h in batch.column(3)[i].as_py()]))
            both = np.frombuffer(b"".join([xxhash.xxh3_128_digest(text[a : a + WINDOW]) for a in at.tolist()]), "<i8").reshape(-1, 2)
            _, first, which, times = np.unique(both, axis=0, return_index=True, return_inverse=True, return_counts=True)
            again = np.sort(at[times[which.ravel()] > 1])
            cut = np.flatnonzero(np.diff(again, prepend=-2 * WINDOW) > WINDOW)
            lo, hi = again[cut], np.append(again[cut[1:] - 1], again[-1:])[: len(cut)] + WINDOW
            n, m = len(lo), len(first)
            none = [None] * n
            columns = [
                [batch.column(0)[i].as_py()] * (n + m), [batch.column(1)[i].as_py()] * (n + m), [*lo.tolist(), *at[first].tolist()], [*hi.tolist(), *(at[first] + WINDOW).tolist()],
                [*none, *both[first, 0].tolist()], [*none, *both[first, 1].tolist()], [*[0] * n, *np.minimum(times, 2).tolist()],
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["id", "digest", "lo", "hi", "h1", "h2", "weight"])


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(id, digest, lo, hi), stored: byte spans of docs (id, digest, text) that repeated windows cover; they may overlap."""
    spark = docs.sparkSession
    common.prepare(spark)
    docs = docs.select("id", "digest", "text")
    counts = docs.mapInArrow(common.lean(_anchor_counts), "anchor long, n long, low long, high long")
    found = counts.groupBy("anchor").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).filter("n > 1")
    kind = F.when(F.col("low") == F.col("high"), 0).when(F.col("n") <= HOT, 1).otherwise(2)
    found = common.stored(found.select("anchor", kind.alias("kind")))  # so that adaptive execution may split a frequent anchor
    each = docs.mapInArrow(common.lean(_occurrences), "id long, digest long, anchor long, first long, count long, shift long, known boolean").join(found, "anchor", "left")
    hits = common.stored(each.withColumn("kind", F.when(F.col("known"), 0).otherwise(F.col("kind"))).filter("kind is not null").drop("known"))
    spans = hits.filter("kind = 0").select("id", "digest", F.col("first").alias("lo"), (F.col("first") + F.col("count") - 1 + WINDOW).alias("hi"))
    # a row that is there more than once repeats all its strings; below it stands for itself once
    copies = docs.select("id", "digest", F.octet_length("text").cast("long").alias("hi")).filter(F.col("hi") >= WINDOW).groupBy("id", "digest").agg(F.count("*").alias("n"), F.max("hi").alias("hi"))
    spans = spans.union(copies.filter("n > 1").select("id", "digest", F.lit(0).cast("long").alias("lo"), "hi"))
    sizes = {r["kind"]: r["count"] for r in hits.groupBy("kind").count().collect()}

    def contexts(k: int) -> DataFrame:
        # equal rows have equal hits, of which the set has one: one row's text serves all of them
        own = hits.filter(F.col("kind") == k).groupBy("id", "digest").agg(F.collect_set(F.struct("anchor", "first", "count", "shift")).alias("hits"))
        return docs.dropDuplicates(["id", "digest"]).join(own, ["id", "digest"]).select("id", "digest", F.col("text").cast("binary").alias("text"), "hits")

    if sizes.get(1):
        buckets = -(-sizes[1] // BUCKET)
        runs = contexts(1).mapInArrow(common.lean(_runs(buckets)), _RUN)
        spans = spans.union(runs.groupBy("bucket").applyInArrow(_merge, _SPANS))
    if sizes.get(2):
        each = common.stored(contexts(2).mapInArrow(common.lean(_window_rows), _WINDOWS))
        own = each.filter("h1 is not null")
        twice = common.stored(own.groupBy("h1", "h2").agg(F.sum("weight").alias("n")).filter("n > 1").select("h1", "h2"))
        met = own.filter("weight = 1").join(twice, ["h1", "h2"])
        spans = spans.union(each.filter("h1 is null").select("id", "digest", "lo", "hi")).union(met.select("id", "digest", "lo", "hi"))
    return common.stored(spans)


def _cut(batches: Iterator[pa.RecordBatch], as_text: bool = False) -> Iterator[pa.RecordBatch]:
    """The texts (column 0) without their spans (column 1); the other columns follow."""
    for batch in batches:
        kept, removed, n_spans = [], [], []
        for text, spans in zip(batch.column(0), batch.column(1).to_pylist()):
            raw = bytes(memoryview(text.as_buffer())) if text.is_valid else b""
            if not spans:
                kept.append(raw)
                removed.append(0)
                n_spans.append(0)
                continue
            spans.sort(key=lambda s: (s["lo"], s["hi"]))
            out, at, runs = [], 0, 0
            for s in spans:
                if s["lo"] > at or not runs:
                    out.append(raw[at : s["lo"]])
                    runs += 1
                    at = s["hi"]
                else:
                    at = max(at, s["hi"])
            out.append(raw[at:])
            rest = b"".join(out)
            kept.append(rest)
            removed.append(len(raw) - len(rest))
            n_spans.append(runs)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[2:], pa.array([len(k) + r for k, r in zip(kept, removed)], pa.int64()), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array([k.decode(errors="ignore") for k in kept], pa.string()) if as_text else pa.array(kept, pa.binary())],
            [*batch.schema.names[2:], "n_bytes", "n_removed", "n_spans", "kept"],
        )


def remove_repeats(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, as_text: bool = False) -> DataFrame:
    """(carry columns, n_bytes, n_removed, n_spans, kept) for each row of df.

    kept has the UTF-8 bytes that no repeated 200-byte string covers; it may begin or end inside a character.
    With as_text it is a string, and what is left of a character that lost bytes goes too.
    Null and empty texts stay empty. A repeated row repeats all its strings. Ids may be null or shared. An empty table
    gives an empty one. A carried column named like a result is an error.
    """
    carry = [id_col] if carry is None else carry
    common.free_names(carry, ["n_bytes", "n_removed", "n_spans", "kept"])
    id_, digest = common.key_columns(id_col, text_col)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = df.select(id_.alias("id"), digest.alias("digest"), text.alias("text"), F.struct(*(F.col(c) for c in carry)).alias("row"))
    spans = repeated_spans(keyed).groupBy("id", "digest").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    joined = keyed.join(spans, ["id", "digest"], "left").select(F.col("text").cast("binary").alias("text"), "spans", "row")
    fields = joined.schema["row"].dataType.simpleString()
    kind = "string" if as_text else "binary"
    made = joined.mapInArrow(common.lean(lambda batches: _cut(batches, as_text)), f"row {fields}, n_bytes long, n_removed long, n_spans long, kept {kind}")
    return made.select("row.*", "n_bytes", "n_removed", "n_spans", "kept")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = remove_repeats(common.documents(spark, sf_dir))
    return made.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: list[bytes], window: int = WINDOW) -> list[tuple[int, int, str]]:
    """(n_removed, n_spans, sha256 of the kept bytes) of each text, by counting every window."""
    seen: dict[bytes, int] = {}
    for t in texts:
        for i in range(len(t) - window + 1):
            w = t[i : i + window]
            seen[w] = seen.get(w, 0) + 1
    found = []
    for t in texts:
        gone = np.zeros(len(t) + 1, np.int32)
        for i in range(len(t) - window + 1):
            if seen[t[i : i + window]] > 1:
                gone[i] += 1
                gone[i + window] -= 1
        mask = np.cumsum(gone)[:-1] > 0
        runs = int((np.diff(np.concatenate(([0], mask.astype(np.int8)))) == 1).sum())
        kept = np.frombuffer(t, np.uint8)[~mask].tobytes()
        found.append((int(mask.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return found
