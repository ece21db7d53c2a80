"""Quality classifier: a generalised additive model with pairwise interactions from cyclic boosted shallow trees."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.llm import common

#: Labelled rows that a model is fitted on at most: those with the smallest hashes of their ids.
SAMPLE = 20_000
THRESHOLD = 0.3

NAMES = [
    "log_bytes", "letters", "upper", "digits", "spaces", "newlines", "punctuation", "symbols", "high", "pipes", "log_words", "word_length",
    "distinct_words", "repeated_next", "same_word_run", "top_word", "odd_word_ends", "line_length", "distinct_lines", "byte_entropy",
]

_CLASSES = np.zeros((8, 256), np.float32)
_CLASSES[0, [*range(65, 91), *range(97, 123)]] = 1
_CLASSES[1, 65:91] = 1
_CLASSES[2, 48:58] = 1
_CLASSES[3, [9, 11, 12, 13, 32]] = 1
_CLASSES[4, 10] = 1
_CLASSES[5, [ord(c) for c in ".,;:?'\"()-"]] = 1
_CLASSES[6, [ord(c) for c in "!#$%&*+/<=>@[\\]^_`{|}~"]] = 1
_CLASSES[7, 128:] = 1
_END = _CLASSES[6].astype(bool)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def text_features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, len(NAMES)) of UTF-8 texts in a row; only the text itself counts. Empty texts have zeros."""
    n = len(offsets) - 1
    out = np.zeros((n, len(NAMES)), np.float32)
    size = np.diff(offsets)
    if not len(data):
        return out
    row = np.repeat(np.arange(n), size)
    table = np.bincount(row * 256 + data, minlength=n * 256).reshape(n, 256).astype(np.float32)
    share = table / np.maximum(1, size)[:, None]
    out[:, 0] = np.log1p(size)
    out[:, 1:9] = share @ _CLASSES.T
    out[:, 9] = share[:, ord("|")]
    out[:, 19] = -(share * np.log2(np.where(share > 0, share, 1))).sum(axis=1)
    space = np.take(_SPACE, data)
    first = np.zeros(len(data) + 1, bool)
    first[0] = True
    first[offsets[:-1]] = True
    gap = space[:-1] | first[1:-1]
    begin = np.flatnonzero(~space & np.concatenate(([True], gap)))
    if len(begin):
        after = np.concatenate((space[1:] | first[1:-1], [True]))
        end = np.flatnonzero(~space & after) + 1
        word_row = row[begin]
        words = np.bincount(word_row, minlength=n)
        some = np.maximum(1, words)
        # words as numbers: the same bytes, the same number
        raw = common.large_binary(data[: end[-1]], np.ravel(np.column_stack((begin, end)))).take(pa.array(np.arange(len(begin)) * 2))
        code = raw.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        pair = np.sort(word_row.astype(np.int64) * (code.max() + 1) + code)
        new = np.concatenate(([True], pair[1:] != pair[:-1]))
        at = np.flatnonzero(new)
        times = np.diff(np.append(at, len(pair)))
        owner = pair[at] // (code.max() + 1)
        most = np.zeros(n)
        np.maximum.at(most, owner, times)
        same = (code[1:] == code[:-1]) & (word_row[1:] == word_row[:-1])
        out[:, 10] = np.log1p(words)
        out[:, 11] = np.bincount(word_row, end - begin, n) / some
        out[:, 12] = np.bincount(owner, minlength=n) / some
        out[:, 13] = np.bincount(word_row[1:], same, n) / some
        broken = np.flatnonzero(np.concatenate(([True], ~same, [True])))
        length = np.diff(broken)
        longest = np.zeros(n)
        np.maximum.at(longest, word_row[broken[:-1]], length)
        out[:, 14] = np.log1p(longest)
        out[:, 15] = most / some
        out[:, 16] = np.bincount(word_row, _END[data[end - 1]], n) / some
    lines = table[:, 10] + (size > 0)
    out[:, 17] = size / np.maximum(1, lines)
    cut = np.union1d(np.flatnonzero(data == 10) + 1, offsets[:-1][size > 0])
    cut = cut[cut < len(data)]
    line = common.large_binary(data, np.append(cut, len(data))).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    both = np.unique(row[cut].astype(np.int64) * (line.max() + 1) + line) // (line.max() + 1)
    out[:, 18] = np.bincount(both, minlength=n) / np.maximum(1, lines)
    return out


@dataclass
class Model:
    """bias, bin edges of each feature, a table of bins for each feature and a square table for each pair of features."""

    bias: float
    edges: list[np.ndarray]
    single: np.ndarray
    pairs: list[tuple[int, int]]
    double: np.ndarray

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        total = np.full(len(x), self.bias)
        for j in range(b.shape[1]):
            total += self.single[j][b[:, j]]
        for k, (i, j) in enumerate(self.pairs):
            total += self.double[k][b[:, i], b[:, j]]
        return 1 / (1 + np.exp(-total))


def _shallow(gradient: np.ndarray, weight: np.ndarray, leaves: int, least: float) -> np.ndarray:
    """A regression tree over ordered bins, grown by the best gain to some leaves: a value for each bin."""
    g, h = np.concatenate(([0], np.cumsum(gradient))), np.concatenate(([0], np.cumsum(weight)))
    parts = [(0, len(gradient))]

    def best(a: int, b: int) -> tuple[float, int]:
        if b - a < 2:
            return 0.0, a
        left_g, left_h = g[a + 1 : b] - g[a], h[a + 1 : b] - h[a]
        right_g, right_h = g[b] - g[a + 1 : b], h[b] - h[a + 1 : b]
        gain = left_g**2 / (left_h + 1) + right_g**2 / (right_h + 1) - (g[b] - g[a]) ** 2 / (h[b] - h[a] + 1)
        gain[(left_h < least) | (right_h < least)] = 0
        k = int(gain.argmax())
        return float(gain[k]), a + 1 + k

    while len(parts) < leaves:
        found = [(*best(a, b), n) for n, (a, b) in enumerate(parts)]
        gain, cut, n = max(found)
        if gain <= 1e-9:
            break
        a, b = parts.pop(n)
        parts += [(a, cut), (cut, b)]
    value = np.zeros(len(gradient))
    for a, b in parts:
        value[a:b] = (g[b] - g[a]) / (h[b] - h[a] + 1)
    return value


def fit(x: np.ndarray, y: np.ndarray, *, bins: int = 48, rounds: int = 150, pair_rounds: int = 60, rate: float = 0.1, leaves: int = 4, pairs: int = 8, pair_bins: int = 8) -> Model:
    """Boost one feature after the other in turn, then the pairs whose coarse tables explain most of what is left."""
    n, d = x.shape
    p = float(np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for j in range(d)]
    model = Model(float(np.log(p / (1 - p))), edges, np.zeros((d, bins + 1)), [], np.zeros((0, bins + 1, bins + 1)))
    if not n:
        return model
    b = model.bins(x)
    total = np.full(n, model.bias)

    def step(index: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        q = 1 / (1 + np.exp(-total))
        return np.bincount(index, y - q, size), np.bincount(index, q * (1 - q), size)

    for _ in range(rounds):
        for j in range(d):
            value = rate * _shallow(*step(b[:, j], bins + 1), leaves, 2.0)
            model.single[j] += value
            total += value[b[:, j]]
    coarse = np.array([[k * pair_bins // (len(e) + 1) for k in range(bins + 1)] for e in edges]).clip(0, pair_bins - 1)

    def cells(i: int, j: int) -> np.ndarray:
        return coarse[i][b[:, i]] * pair_bins + coarse[j][b[:, j]]

    gains = []
    for i in range(d):
        for j in range(i + 1, d):
            g, h = step(cells(i, j), pair_bins**2)
            gains.append((float((g**2 / (h + 5)).sum()), i, j))
    model.pairs = [(i, j) for _, i, j in sorted(gains, reverse=True)[:pairs]]
    model.double = np.zeros((len(model.pairs), bins + 1, bins + 1))
    for _ in range(pair_rounds):
        for k, (i, j) in enumerate(model.pairs):
            own = cells(i, j)
            g, h = (v.reshape(pair_bins, pair_bins) for v in step(own, pair_bins**2))
            # a tree of depth two: rows in two parts, then the columns of each
            rows = _shallow(g.sum(1), h.sum(1), 2, 2.0)
            cut = int(np.flatnonzero(np.diff(rows))[0]) + 1 if np.diff(rows).any() else pair_bins
            value = np.zeros((pair_bins, pair_bins))
            for part in (slice(0, cut), slice(cut, pair_bins)):
                if g[part].size:
                    value[part] = _shallow(g[part].sum(0), h[part].sum(0), 2, 2.0)[None, :]
            value *= rate
            model.double[k] += value[coarse[i]][:, coarse[j]]
            total += value.ravel()[own]
    return model


def held_out(id_: Column) -> Column:
    """Whether crc32 of the id as text is a multiple of 5; a null id's text is empty."""
    return F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def features(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """(carry columns, x array<float>) for each row of df; a carried column named x is an error."""
    return _map(df, text_col, [id_col] if carry is None else carry, "x array<float>", lambda x: pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(NAMES)).cast(pa.list_(pa.float32())))


def _map(df: DataFrame, text_col: str, carry: list[str], column: str, make) -> DataFrame:
    common.prepare(df.sparkSession)
    name = column.split()[0]
    common.free_names(carry, [name])
    narrow = df.select(F.col(text_col).cast("string").alias("text"), F.struct(*(F.col(c) for c in carry)).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = common.flat_text(batch.column(0))
            for a, b in common.steps(offsets, common.SMALL_STEP_BYTES):
                x = text_features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(a, b - a), make(x)], ["row", name])

    return narrow.mapInArrow(common.lean(run), f"row {narrow.schema['row'].dataType.simpleString()}, {column}").select("row.*", name)


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Model:
    """A model from at most `sample` labelled rows that are not held out, those with the smallest hashes of their ids.

    Rows without a label or a document don't count, nor labels but 0 and 1; of several labels of an id the least counts.
    Rows that share an id are examples each, as long as they are among the first `sample` rows by hash, id and features:
    the bound is one of rows, whatever ids they have. Without examples, the model gives one score to all.
    """
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).filter(F.col("_y").isin(0, 1) & F.col("_id").isNotNull() & ~held_out(F.col("_id")))
    known = known.groupBy("_id").agg(F.min("_y").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(sample)
    # `sample` rows of two numbers: the bound is what makes the broadcast safe
    found = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(known), "_id")
    # features are made where the texts are; only numbers are ordered and cut
    rows = features(found, carry=["_id", "_y"]).select("_id", "_y", "x").orderBy(F.xxhash64("_id"), "_id", "x").limit(sample).toPandas()
    x = np.array(rows["x"].tolist(), np.float32).reshape(-1, len(NAMES))
    # one order, also of rows that share an id: sums come out the same
    order = np.lexsort((*x.T, rows["_id"].to_numpy()))
    return fit(x[order], rows["_y"].to_numpy(float)[order])


def score(df: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """(carry columns, score) for each row of df, empty and null texts too; equal texts have equal scores.

    Texts of any length are read whole, by themselves in a step if they are long. Repeated rows give repeated rows; ids
    may be null or shared. A carried column named score is an error.
    """
    return _map(df, text_col, [id_col] if carry is None else carry, "score double", lambda x: pa.array(model.score(x)))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
