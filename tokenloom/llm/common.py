"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import shutil
import sys
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null doc_id where rows meet by id; smaller than any real id.
NULL_ID = -(2**63)

#: Rows and MB of an Arrow batch at most.
ARROW_ROWS, ARROW_MB = 1_000, 8

#: Bytes of text that one vectorised step handles; a longer text is a step of its own.
STEP_BYTES = 2 << 20

#: The same for steps that hold many numbers for each byte.
SMALL_STEP_BYTES = 1 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def prepare(spark: SparkSession) -> None:
    """Let Python workers of a local session import this package, and keep Arrow batches small enough for their memory."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{ARROW_MB}m")
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (root, env.get("PYTHONPATH", "")) if x)


_own_dir: list[str] = []
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """A new folder name below spark.checkpoint.dir, which driver and executors share.

    Where that is unset, a local session (a test) gets a temporary folder that goes with the process; on a cluster it is
    an error, as no machine's own folder would do.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _own_dir:
            _own_dir.append(tempfile.mkdtemp(prefix="tokenloom-"))
            atexit.register(shutil.rmtree, _own_dir[0], ignore_errors=True)
        base = f"file://{_own_dir[0]}"
    _made.append(f"{base.rstrip('/')}/tokenloom-{uuid.uuid4().hex}")
    return _made[-1]


def stored(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage ends there and lost executors cost nothing."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mark() -> set[str]:
    """The stored folders that there are now."""
    return set(_made)


def sweep(spark: SparkSession, before: set[str], keep: DataFrame) -> None:
    """Remove the folders made after the mark, but the one that keep is read from: nothing may read the others again."""
    own = {os.path.basename(os.path.dirname(f)) for f in keep.inputFiles()}
    if not own:  # it can't be told apart
        return
    for path in [p for p in _made if p not in before and os.path.basename(p) not in own]:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        _made.remove(path)


def key_columns(id_col: str = "doc_id", text_col: str = "text") -> tuple[Column, Column]:
    """(id, text digest): what tells rows apart; equal ids with equal texts are one document."""
    return (
        F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))),
    )


def free_names(given: list[str], made: list[str]) -> None:
    """Columns that pass through must not have a result's name: that is an error, whatever their values."""
    results = {m.lower() for m in made}
    if clash := sorted(g for g in given if g.lower() in results):
        raise ValueError(f"columns {clash} have the names of results; rename them first")


def flat_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow string column (null: empty) and the n + 1 offsets of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def steps(offsets: np.ndarray, most: int = STEP_BYTES):
    """Row ranges (a, b) of at most `most` bytes, or of one longer row."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1)
        yield a, min(b, n)
        a = b


#: What workers keep from task to task, such as tokenizers, and which module's tasks ran last.
CACHES: list[dict] = []
_last_user: list[str] = [""]


def _trim() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library has no such call
        pass


def _enter(user: str) -> None:
    if _last_user[0] != user:
        for cache in CACHES:
            cache.clear()
        _last_user[0] = user
        _trim()


def lean(run):
    """run, an iterator over batches, with memory given back: workers are used again by other operators.

    A worker that comes to another module's task drops its caches first; at each task's end free memory goes back.
    """
    user = run.__module__

    def wrapped(batches):
        # functions of this module, which workers import: the closure itself would carry copies of the caches
        _enter(user)
        yield from run(batches)
        _trim()

    return wrapped


def large_binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(
        pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))]
    )


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_OTHER = ~_LETTER
_OTHER[128:] = False


def unit_starts(data: np.ndarray, offsets: np.ndarray, whole: list[tuple[int, int]] = ()) -> np.ndarray:
    """Where the units of the texts start: at each text's start, at each ASCII white space after other characters
    and at each other ASCII character after an ASCII letter. Each range in whole is a unit of its own.

    No match of the tokenizers' split patterns goes on from a non-space into white space, or from a letter into
    another kind of character, so units can be tokenized one by one. Behind a byte that may end a Unicode space no unit starts; units only get longer by that.
    """
    if not len(data):
        return np.zeros(0, np.int64)
    space = np.take(_SPACE, data)
    begins = np.zeros(len(data), bool)
    np.greater(space[1:], space[:-1], out=begins[1:])
    begins[1:] |= np.take(_LETTER, data[:-1]) & np.take(_OTHER, data[1:])
    if (data >= 0x80).any():
        at = np.flatnonzero(begins[1:] & (data[:-1] >= 0x80)) + 1
        c1, c2, c3 = data[at - 1], data[np.maximum(at - 2, 0)], data[np.maximum(at - 3, 0)]
        odd = ((c2 == 0xC2) & ((c1 == 0x85) | (c1 == 0xA0))) | ((c3 == 0xE1) & (c2 == 0x9A))
        odd |= ((c3 == 0xE2) & ((c2 == 0x80) | (c2 == 0x81))) | ((c3 == 0xE3) & (c2 == 0x80))
        begins[at[odd]] = False
    begins[offsets[:-1][offsets[1:] > offsets[:-1]]] = True
    for a, b in whole:
        begins[a:b] = False
        begins[a] = True
        if b < len(data):
            begins[b] = True
    return np.flatnonzero(begins)


class UnitEncoder:
    """Tokens of many texts, by way of their distinct units; `encode` maps a list of units to all their tokens and each one's number.

    A token is a row of `width` numbers, its id first.
    """

    def __init__(self, encode, width: int = 1, most: int = 300_000):
        self.encode, self.width, self.most, self.known = encode, width, most, {}

    def __call__(self, data: np.ndarray, offsets: np.ndarray, whole: list[tuple[int, int]] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(tokens, unit's start of each, the n + 1 offsets of the texts in them) of all texts in a row; ranges in whole are units."""
        starts = unit_starts(data, offsets, whole)
        if not len(starts):
            return np.zeros((0, self.width), np.uint32), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
        coded = large_binary(data, np.append(starts, len(data))).dictionary_encode()
        units = coded.dictionary.to_pylist()
        if len(self.known) > self.most:
            self.known.clear()
        size = 4 * self.width
        if new := [u for u in units if u not in self.known]:
            tokens, sizes = self.encode(new)
            at = np.concatenate(([0], np.cumsum(sizes))) * size
            raw = tokens.astype(np.uint32).tobytes()
            self.known.update(zip(new, map(raw.__getitem__, map(slice, at[:-1].tolist(), at[1:].tolist()))))
        found = [self.known[u] for u in units]
        flat = np.frombuffer(b"".join(found), np.uint32).reshape(-1, self.width)
        size = np.fromiter(map(len, found), np.int32, len(found)) // size
        begin = np.cumsum(size, dtype=np.int32) - size
        which = coded.indices.to_numpy(zero_copy_only=False)
        n = size[which]
        ends = np.cumsum(n)
        tokens = flat[np.repeat(begin[which] - (ends - n), n) + np.arange(ends[-1])]
        before = np.concatenate(([0], ends))
        return tokens, np.repeat(starts, n), before[np.searchsorted(starts, offsets)]


def together(units: list[bytes], alone, most: int = 32_768):
    """Lists of units to encode as one text each: units that `alone` picks stay by themselves."""
    group, size = [], 0
    for u in units:
        if alone(u):
            if group:
                yield group
                group, size = [], 0
            yield [u]
            continue
        group.append(u)
        size += len(u)
        if size > most:
            yield group
            group, size = [], 0
    if group:
        yield group


def quiet_tokenizers() -> None:
    """One thread a worker: Spark's tasks are the parallelism."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ["RAYON_RS_NUM_CPUS"] = "1"


assert sys.byteorder == "little"
