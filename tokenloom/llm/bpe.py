"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.llm import common

RANKS = "byte_bpe_multi_50k.tiktoken"


def byte_table() -> list[str]:
    """The character that stands for each byte: printable Latin-1 characters stand for themselves, the others get 256 and up in order."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or (0xA1 <= b <= 0xFF and b != 0xAD)]
    spare = iter(range(256, 512))
    held = set(own)
    return [chr(b) if b in held else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def build_tokenizer(ranks: dict[bytes, int], pattern: str):
    """A tokenizers.Tokenizer that gives the ids of a rank file.

    Every way to make a token of two others is a merge, in the order of the made token's rank; a match that is
    a token as a whole is taken as it is.
    """
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    chars = byte_table()
    text = {t: "".join(chars[b] for b in t) for t in ranks}
    merges = []
    for token, _ in sorted(ranks.items(), key=lambda x: x[1]):
        for i in range(1, len(token)):
            if token[:i] in ranks and token[i:] in ranks:
                merges.append((text[token[:i]], text[token[i:]]))
    model = models.BPE(vocab={text[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True)
    made = Tokenizer(model)
    made.pre_tokenizer = pre_tokenizers.Sequence(
        [pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
    )
    return made


_encoders: dict[tuple[str, str], common.UnitEncoder] = {}
_tables: dict[str, pa.Array] = {}
common.CACHES += [_encoders, _tables]


def _encode_units(made, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens (id, twice the character where it begins in its unit, and 1 if it begins inside that) and the number of each unit's.

    Places are the library's offsets. Units with white space before and none behind stay apart in one text, so many go together.
    """

    def alone(u: bytes) -> bool:
        return u[0] > 32 or u[-1] <= 32 or (u[-1] >= 0x80 and u.decode()[-1].isspace())

    texts = [b"".join(g).decode() for g in common.together(units, alone)]
    found = made.encode_batch(texts, add_special_tokens=False)
    ids = np.concatenate([np.array(e.ids, np.uint32) for e in found])
    base = np.repeat(np.cumsum([0, *map(len, texts[:-1])]), [len(e.ids) for e in found])
    place = np.concatenate([np.array(e.offsets, np.int64).reshape(-1, 2) for e in found]) + base[:, None]
    # a token that begins before the end of the one before it begins inside a character
    inside = np.concatenate((np.zeros(min(1, len(ids)), bool), place[1:, 0] < place[:-1, 1]))
    data, offsets = common.flat_text(pa.array(units, pa.binary()))
    ends = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[offsets[1:]]
    unit = np.searchsorted(ends, place[:, 0], side="right")
    begin = place[:, 0] - np.concatenate(([0], ends))[unit]
    return np.stack([ids, (begin * 2 + inside).astype(np.uint32)], axis=1), np.bincount(unit, minlength=len(units))


def _encoder(path: str, pattern: str) -> common.UnitEncoder:
    if (path, pattern) not in _encoders:
        common.quiet_tokenizers()
        made = build_tokenizer(read_ranks(path), pattern)
        _encoders[path, pattern] = common.UnitEncoder(lambda units: _encode_units(made, units), width=2)
    return _encoders[path, pattern]


def _token_chars(path: str) -> pa.Array:
    """Each id's token in the characters of the byte table, as the library's vocabulary has it."""
    if path not in _tables:
        ranks, chars = read_ranks(path), byte_table()
        table: list[str | None] = [None] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            table[rank] = "".join(chars[b] for b in token)
        _tables[path] = pa.array(table, pa.large_string())
    return _tables[path]


#: The byte that each character of the byte table stands for.
_BYTE_OF = np.zeros(512, np.uint8)
_BYTE_OF[[ord(c) for c in byte_table()]] = np.arange(256)


def decode_ids(table: pa.Array, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the tokens in a row, and where each begins (with the end).

    Tokens are joined as characters of the byte table, and each character gives its byte back: a character of the text
    that several tokens share comes together again.
    """
    tokens = table.take(pa.array(ids))
    if tokens.null_count:
        raise ValueError("an id has no token")
    joined, _ = common.flat_text(tokens)
    chars = np.frombuffer(joined.tobytes().decode().encode("utf-32-le"), np.uint32)
    return _BYTE_OF[chars], np.concatenate(([0], np.cumsum(pc.utf8_length(tokens).to_numpy(zero_copy_only=False))))


def _encode_batches(path: str, pattern: str):
    """Batches (id, text) to batches (id, ids, starts, n_split)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, pattern)
        for batch in batches:
            data, offsets = common.flat_text(batch.column(1))
            for a, b in common.steps(offsets):
                part, off = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                tokens, unit, bounds = encoder(part, off)
                chars = np.concatenate(([0], np.cumsum((part & 0xC0) != 0x80, dtype=np.int32)))
                row = np.repeat(np.arange(b - a), np.diff(bounds))
                starts = chars[unit] - chars[off[:-1]][row] + (tokens[:, 1] >> 1).astype(np.int32)
                n_split = np.bincount(row, weights=tokens[:, 1] & 1, minlength=b - a)
                out = [batch.column(0).slice(a, b - a)]
                out += [pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(x.astype(np.int32))) for x in (tokens[:, 0], starts)]
                yield pa.RecordBatch.from_arrays([*out, pa.array(n_split.astype(np.int32))], ["id", "ids", "starts", "n_split"])

    return run


def _decode_batches(path: str, ids_col: str):
    """Batches with one more column, decoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _token_chars(path)
        for batch in batches:
            column = batch.column(ids_col)
            # some rows at a time: a batch of Spark's may hold many MB of ids
            for i in range(0, len(column), 500):
                part = column.slice(i, 500)
                flat, at = decode_ids(table, part.flatten().to_numpy(zero_copy_only=False))
                sizes = part.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                texts = common.large_binary(flat, at[np.concatenate(([0], np.cumsum(sizes)))]).cast(pa.binary())
                if part.null_count:
                    texts = pa.array([None if null else x for x, null in zip(texts.to_pylist(), part.is_null().to_pylist())], pa.binary())
                yield pa.RecordBatch.from_arrays([*(c.slice(i, 500) for c in batch.columns), texts], [*batch.schema.names, "decoded"])

    return run


_ENCODED = "id long, ids array<int>, starts array<int>, n_split int"


def _narrow(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))


def encode(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(id_col, ids array<int>, starts array<int>, n_split int) for each row of df.

    starts has the library's character offset of each token; a token that begins inside a character (a split
    character) has that character's offset, and n_split counts those. Null and empty texts have no tokens; repeated
    rows give repeated rows; other columns of df are not looked at. Texts of any length are encoded whole.
    An id_col named like a result is an error.
    """
    common.free_names([id_col], ["ids", "starts", "n_split"])
    common.prepare(df.sparkSession)
    run = _encode_batches(path or public_tokenizers.path(RANKS), pattern or public_tokenizers.PATTERN)
    return _narrow(df, id_col, text_col).mapInArrow(common.lean(run), _ENCODED).withColumnRenamed("id", id_col)


def decode(df: DataFrame, *, ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """df with one more column, `decoded` (binary): the bytes of the ids through the reversed byte table.

    Bytes, not text: a list of ids may begin or end inside a character. Null ids give null; an id that the
    table lacks is an error. Any columns pass through; one named decoded is an error.
    """
    common.prepare(df.sparkSession)
    common.free_names(df.columns, ["decoded"])
    run = _decode_batches(path or public_tokenizers.path(RANKS), ids_col)
    return df.mapInArrow(common.lean(run), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", decoded binary")


def round_trip(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(id_col, ids, starts, n_split, decoded): encode and then decode, both in one worker for each task."""
    common.free_names([id_col], ["ids", "starts", "n_split", "decoded"])
    common.prepare(df.sparkSession)
    path = path or public_tokenizers.path(RANKS)
    there, back = _encode_batches(path, pattern or public_tokenizers.PATTERN), _decode_batches(path, "ids")
    return _narrow(df, id_col, text_col).mapInArrow(common.lean(lambda batches: back(there(batches))), _ENCODED + ", decoded binary").withColumnRenamed("id", id_col)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = round_trip(common.documents(spark, sf_dir))
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.col("n_split").cast("long").alias("n_split"),
    )
