"""Media columns: HTML to interleaved text and media references, payloads joined by digest, and a lossless 8-bit image store."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.llm import common

ROW = 64

_ITEMS = "array<struct<position: int, kind: string, text: string, digest: string, caption: string>>"
_MEDIA = {"img", "video", "audio", "source", "embed"}
_SILENT = {"script", "style", "template", "head", "title"}
_HEAD = {"title", "meta", "link", "base", "style", "script", "noscript", "template", "head"}
_BLOCKS = {"p", "div", "br", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "table", "tr", "td", "th", "blockquote", "figure", "figcaption", "nav", "footer", "header"}


class _Sequence(HTMLParser):
    """Texts and media references in document order; a figure's caption belongs to the media in it, else the alt text does.

    A head without an end tag ends at the first tag or text that can't be in one. With inert=False templates are read too.
    """

    def __init__(self, inert: bool = True) -> None:
        super().__init__(convert_charrefs=True)
        self.quiet = _SILENT if inert else _SILENT - {"template"}
        self.items: list[dict] = []
        self.words: list[str] = []
        self.silent: list[str] = []
        self.figure: list[int] | None = None
        self.caption: list[str] | None = None

    def flush(self) -> None:
        text = " ".join("".join(self.words).split())
        self.words = []
        if text:
            self.items.append({"kind": "text", "text": text, "digest": None, "caption": None})

    def end_head(self) -> None:
        if self.silent == ["head"]:
            self.silent = []

    def handle_starttag(self, tag, attrs):
        if tag not in _HEAD:
            self.end_head()
        if tag in self.quiet:
            self.silent.append(tag)
        elif self.silent:
            return
        elif tag in _MEDIA:
            self.flush()
            found = dict(attrs)
            if self.figure is not None:
                self.figure.append(len(self.items))
            self.items.append({"kind": tag, "text": None, "digest": found.get("data-digest") or found.get("src"), "caption": found.get("alt") or None})
        elif tag == "figure":
            self.flush()
            self.figure = []
        elif tag == "figcaption":
            self.flush()
            self.caption = []
        elif tag in _BLOCKS:
            self.flush()

    def handle_startendtag(self, tag, attrs):
        if tag not in self.quiet:  # <script/> opens nothing
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in self.quiet:
            if tag in self.silent:
                self.silent.remove(tag)
        elif tag == "figcaption" and self.caption is not None:
            self.close_caption()
        elif tag == "figure":
            self.close_caption()
            self.flush()
            self.figure = None
        elif tag in _BLOCKS:
            self.flush()

    def close_caption(self) -> None:
        text = " ".join("".join(self.caption or []).split())
        self.caption = None
        if text and not self.figure:
            self.items.append({"kind": "text", "text": text, "digest": None, "caption": None})
        for i in self.figure or [] if text else []:
            self.items[i]["caption"] = text

    def handle_data(self, data):
        if data.strip():
            self.end_head()
        if not self.silent:
            (self.words if self.caption is None else self.caption).append(data)


def parse(html: str | None) -> list[dict]:
    """The items of a page with their positions from 0; broken markup gives what can be read, a null page nothing."""
    reader = _Sequence()
    reader.feed(html or "")
    reader.close()
    if "template" in reader.silent:  # it never ends: what follows is the page
        reader = _Sequence(inert=False)
        reader.feed(html or "")
        reader.close()
    if reader.caption is not None:
        reader.close_caption()
    reader.flush()
    return [{"position": i, **x} for i, x in enumerate(reader.items)]


def interleave(df: DataFrame, *, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id_col, items) for each page: ordered texts and media references with position, digest and caption.

    Null and empty pages have no items; repeated rows give repeated rows; ids may be null or shared; pages of any length
    are parsed whole. Other columns of df are not looked at; an id_col named items is an error.
    """
    common.prepare(df.sparkSession)
    common.free_names([id_col], ["items"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = [parse(x.as_py()) for x in batch.column(1)]
            kind = pa.list_(pa.struct([("position", pa.int32()), *((n, pa.string()) for n in ("kind", "text", "digest", "caption"))]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(items, kind)], ["id", "items"])

    narrow = df.select(F.col(id_col).cast("long").alias("id"), F.col(html_col).cast("string").alias("html"))
    return narrow.mapInArrow(common.lean(run), f"id long, items {_ITEMS}").withColumnRenamed("id", id_col)


def resolve(sequences: DataFrame, media: DataFrame, *, id_col: str = "page_id", media_only: bool = False) -> DataFrame:
    """(id_col, position, kind, text, digest, caption, columns of media) for each item of sequences (id_col, items).

    Media rows are found by digest, nulls stand where none fits. Each row has its position in its page: rows come in no
    order of their own. Of media rows with equal digests, which have equal payloads, one is used; they are stored once,
    so that a digest that very many items share may be split. A repeated page gives its items again. A column of media
    with the name of an item's is an error. With media_only texts are left out, positions stay.
    """
    names = ["position", "kind", "text", "digest", "caption"]
    common.free_names([id_col, *(c for c in media.columns if c != "digest")], names)
    common.free_names([c for c in media.columns if c != "digest"], [id_col])
    own = F.filter("items", lambda x: x["kind"] != "text") if media_only else F.col("items")
    items = sequences.select(F.col(id_col), F.explode(own).alias("_item")).select(id_col, *(F.col(f"_item.{n}").alias(n) for n in names))
    once = common.stored(media.dropDuplicates(["digest"]))
    return items.join(once, "digest", "left").select(id_col, *names, *(c for c in media.columns if c != "digest"))


def pad(raw: bytes) -> bytes:
    """raw with zero bytes up to a positive multiple of ROW."""
    return raw + bytes(max(ROW, -(-len(raw) // ROW) * ROW) - len(raw))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes) -> bytes:
    """An 8-bit grey image with ROW samples a row; payload's length is a positive multiple of ROW."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    raw = np.pad(rows, ((0, 0), (1, 0))).tobytes()  # each row starts with filter type 0
    head = struct.pack(">IIBBBBB", ROW, len(rows), 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(raw, 1)) + _chunk(b"IEND", b"")


def from_png(stored: bytes) -> np.ndarray:
    """The samples (rows, ROW) of a stored image, its checksums verified."""
    if stored[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, data, width, height = 8, [], 0, 0
    while at < len(stored):
        (n,) = struct.unpack_from(">I", stored, at)
        kind, body = stored[at + 4 : at + 8], stored[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", stored, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise ValueError("a chunk is damaged")
        if kind == b"IHDR":
            width, height, depth, colour = struct.unpack_from(">IIBB", body)
            if (depth, colour) != (8, 0):
                raise ValueError("not an 8-bit grey image")
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    if rows[:, 0].any():
        raise ValueError("a row is filtered")
    return rows[:, 1:]


def feature(samples: np.ndarray) -> str:
    """16 hex digits of a difference hash over 8 x 9 block means, mean and deviation, and the entropy of the samples."""
    edges = np.linspace(0, samples.size, 73).astype(np.int64)
    total = np.concatenate(([0], np.cumsum(samples.ravel(), dtype=np.int64)))
    means = ((total[edges[1:]] - total[edges[:-1]]) / np.maximum(1, np.diff(edges))).reshape(8, 9)
    bits = np.packbits((means[:, 1:] > means[:, :-1]).ravel())
    p = np.bincount(samples.ravel(), minlength=256) / samples.size
    entropy = -(p[p > 0] * np.log2(p[p > 0])).sum() + 0.0
    mean = p @ np.arange(256)
    spread = np.sqrt(max(0.0, p @ np.arange(256) ** 2 - mean**2))
    return f"{bits.tobytes().hex()}:{mean:.3f}:{spread:.3f}:{entropy:.4f}"


def store(df: DataFrame, *, id_col: str = "doc_id", raw_col: str = "raw") -> DataFrame:
    """(id_col, digest, n_bytes, media): each row's bytes (null: none) as a stored image, named by the SHA-256 of the bytes.

    Repeated rows give repeated rows, equal bytes equal images; ids may be null or shared. Other columns of df are not
    looked at; an id_col named like a result is an error.
    """
    common.prepare(df.sparkSession)
    common.free_names([id_col], ["digest", "n_bytes", "media"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, x in enumerate(batch.column(1)):
                raw = x.as_py() or b""
                out.append((hashlib.sha256(raw).hexdigest(), len(raw), to_png(pad(raw))))
                if sum(len(o[2]) for o in out[-64:]) > common.STEP_BYTES or i + 1 == batch.num_rows:
                    a = i + 1 - len(out)
                    columns = zip(*out)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, len(out)), *(pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.binary())))], ["id", "digest", "n_bytes", "media"])
                    out = []

    narrow = df.select(F.col(id_col).cast("long").alias("id"), F.col(raw_col).cast("binary").alias("raw"))
    return narrow.mapInArrow(common.lean(run), "id long, digest string, n_bytes long, media binary").withColumnRenamed("id", id_col)


def read_back(media: DataFrame) -> DataFrame:
    """(digest, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) of stored images.

    A digest that a task meets again is left out there: copies are read back once a task, and come out as often.
    """
    common.prepare(media.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for batch in batches:
            new = [i for i, d in enumerate(batch.column(0).to_pylist()) if not (d in seen or seen.add(d))]
            batch = batch.take(pa.array(new, pa.int64()))
            out = []
            for x in batch.column(2):
                stored = x.as_py()
                samples = from_png(stored)
                payload = samples.tobytes()
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ROW:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(samples)))
            if out:
                names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(c) for c in zip(*out))], ["digest", "n_bytes", *names])

    return media.select("digest", "n_bytes", "media").mapInArrow(
        common.lean(run), "digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    )


def page_of(text: Column, digest: Column, caption: Column) -> Column:
    """An HTML page of a text's lines as paragraphs, with a figure behind the first."""
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    lines = F.transform(F.split(text, "\n", -1), lambda x: F.concat(F.lit("<p>"), x, F.lit("</p>")))
    figure = F.concat(F.lit('<figure><img data-digest="'), digest, F.lit('"><figcaption>'), caption, F.lit("</figcaption></figure>"))
    return F.concat(F.lit("<article>"), F.get(lines, F.lit(0)), figure, F.array_join(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), ""), F.lit("</article>"))


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document is a page of its lines with one figure among them, whose payload is the document's text as a stored image."""
    docs = common.documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("own"))
    raw = F.col("own").cast("binary")
    media = common.stored(store(docs.select("doc_id", raw.alias("raw"))))
    pages = docs.select("doc_id", page_of(F.col("own"), F.sha2(raw, 256), F.concat(F.octet_length("own").cast("string"), F.lit(" bytes"))).alias("html"))
    found = resolve(interleave(pages, id_col="doc_id"), read_back(media), id_col="doc_id", media_only=True)
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption")


def media_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's HTML as an ordered sequence: how many texts and media references, the characters, and a digest of all texts in order."""
    items = interleave(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    texts = F.transform(F.filter("items", lambda x: x["kind"] == "text"), lambda x: x["text"])
    return items.select(
        "page_id", F.size(texts).cast("long").alias("n_texts"), (F.size("items") - F.size(texts)).cast("long").alias("n_media"), F.length(F.array_join(texts, "")).cast("long").alias("n_chars"),
        F.sha2(F.array_join(texts, "\n").cast("binary"), 256).alias("texts_sha256"),
    )
