"""URL filter: host and path rules, and a logistic regression on hashed character n-grams of host and path."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.llm import common

# Fixed values: (verdict, host, path), as the contract of op7 lists them.
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]

# The labelled URLs (1: to block) that the model is trained from.
LABELLED = [
    (1, "http://casino-royal.net/play"), (1, "https://www.best-casino-online.com/bonus"), (1, "http://free-casino-spins.biz/win/now"), (1, "https://win-big-casino.info/"),
    (1, "http://cheap-meds.example/pills/order"), (1, "https://pills-direct.net/viagra-cheap"), (1, "http://buy-cheap-pills.org/discount"), (1, "https://online-pharmacy-pills.biz/"),
    (1, "http://adult-video.net/xxx"), (1, "https://www.xxx-adult-cam.com/live"), (1, "http://adult-dating.info/hot"), (1, "https://sexy-adult-x.biz/gallery"),
    (1, "http://spam-links.net/out?id=3"), (1, "https://link-farm.biz/spam/list"), (1, "http://seo-spam-farm.com/backlinks"), (1, "https://farm-of-links.info/spam"),
    (1, "http://ads.tracker.net/click"), (1, "https://track-ads.example.com/pixel"), (1, "http://adserver-track.biz/banner"), (1, "https://click-ads-track.net/r"),
    (1, "http://free-bets-today.com/odds"), (1, "https://sports-bets-free.net/join"), (1, "http://bets-and-poker.info/"), (1, "https://free-money-bets.biz/signup"),
    (1, "http://payday-loans-fast.com/apply"), (1, "https://free-iphone-winner.net/claim"), (1, "http://warez-torrent-crack.org/keygen"), (1, "https://replica-watches-cheap.biz/sale"),
    (1, "https://blog.casino-lucky.example.com/en/51"), (1, "http://m.lucky-win.example.net/fr/9002#top"), (1, "https://www.cheap-meds.example.org/de/310/"), (1, "https://m.pills-online.example.net/en/7?page=2"),
    (1, "http://adult-pics.example.net/es/44.html"), (1, "https://blog.adult-zone.example.com/en/8120"), (1, "https://ads-click.example.net/en/6"), (1, "http://m.ad-track.example.org/fr/31?utm_source=feed"),
    (1, "https://spam-list.example.com/en/99/"), (1, "https://www.link-farm.example.net/de/2"), (1, "https://bets-live.example.org/en/3"), (1, "http://blog.free-poker.example.net/en/1207.html"),
    (1, "https://free-bonus.example.com/es/18"), (1, "https://casino-slots.example.net/fr/27"),
    (0, "https://blog.pottery.example.com/en/5179?page=2&ref=x"), (0, "https://m.station.example.com/fr/12"), (0, "https://nation.example.com/en/33822?utm_source=feed"), (0, "https://blog.thunder.example.com/es/9/"),
    (0, "http://www.meadow.example.com/en/4.html"), (0, "https://m.northern.example.org/de/8#top"), (0, "https://mention.example.net/en/3"), (0, "http://tradition.example.com/en/77?page=2"),
    (0, "https://blog.lighthouse.example.com/en/34/"), (0, "https://m.botany.example.com/es/6120.html"), (0, "http://blog.other-thoughts.example.com/en/871#top"), (0, "https://therapy.example.com/en/15/"),
    (0, "https://blog.museum.example.org/fr/31?utm_source=feed"), (0, "https://kitchen.example.net/fr/9"), (0, "http://m.harbour.example.net/fr/208.html"), (0, "https://www.stamps.example.com/es/44/"),
    (0, "https://www.university.edu/research/papers"), (0, "https://news.daily-press.com/en/2021/05/story.html"), (0, "https://blog.gardening.net/en/412"), (0, "https://m.recipes.org/fr/77"),
    (0, "https://en.encyclopedia.org/wiki/Water"), (0, "http://docs.library.net/manual/index.html"), (0, "https://museum.example.net/en/7809.html"), (0, "https://www.theatre.example.com/de/310/"),
    (0, "https://city-council.gov/services?page=2"), (0, "https://blog.astronomy.com/es/5179?page=2"), (0, "http://history.example.org/en/46808/"), (0, "https://m.weather.net/en/9001#top"),
    (0, "https://school.example.net/fr/22674/"), (0, "https://www.farmers-market.org/en/12"), (0, "https://adultlearning.edu/courses"), (0, "https://track-and-field.org/results/en/3"),
    (0, "https://health.example.net/en/medicine/4"), (0, "https://the-reader.example.net/en/48583?utm_source=feed"), (0, "http://mountain.example.net/en/31396.html"), (0, "https://railway.net/de/timetable"),
    (0, "https://forum.linux.net/en/34727#top"), (0, "https://winter-sports.org/en/news"), (0, "https://chess-club.net/games/88"), (0, "https://blog.knitting.example.net/en/5"),
    (0, "https://www.hospital.example.net/es/contact"), (0, "https://music-school.com/en/lessons"), (0, "https://m.bakery.net/en/bread/17"), (0, "https://open-data.gov/sets?ref=x"),
]

BITS, SIZES, ROUNDS, RATE, DECAY = 14, (3, 4, 5), 1500, 8.0, 1e-5


def host(url: Column) -> Column:
    """What follows the first :// up to /, ?, # or the end, A-Z lower-cased; empty without a ://."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty without a ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule(host_: Column, path_: Column, rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule whose host is the URL's or above it and whose path starts the URL's; else nulls.

    Of equally long rules the first in the list counts.
    """
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for decision, h, p in sorted(reversed(rules), key=lambda r: len(r[1] + r[2])):
        fits = ((host_ == h) | host_.endswith("." + h)) & path_.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, decision).otherwise(verdict)
    return name, verdict


def features(hosts: list[str], paths: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, slot) of every n-gram of ^host$ and of its path, digits as one sign; host and path have hashes of their own."""
    rows, slots = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    digit = np.arange(256, dtype=np.uint64)
    digit[48:58] = 48
    for seed, strings, frame in ((1, hosts, b"^%b$"), (2, paths, b"%b$")):
        raw = [frame % s.encode() for s in strings]
        data = digit[np.frombuffer(b"".join(raw), np.uint8)]
        row = np.repeat(np.arange(len(raw)), [len(x) for x in raw])
        for n in SIZES:
            if len(data) < n:
                continue
            with np.errstate(over="ignore"):
                h = np.full(len(data) - n + 1, seed * 31 + n, np.uint64)
                for k in range(n):
                    h = (h ^ data[k : len(data) - n + 1 + k]) * np.uint64(0x100000001B3)
                h ^= h >> np.uint64(29)
            whole = row[: len(h)] == row[n - 1 :]
            rows.append(row[: len(h)][whole])
            slots.append((h[whole] % np.uint64(1 << BITS)).astype(np.int64))
    return np.concatenate(rows), np.concatenate(slots)


def _design(rows: np.ndarray, slots: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each (row, slot) once, with weights that give each row length 1."""
    pair = np.unique(rows * (1 << BITS) + slots)
    rows, slots = pair >> BITS, pair & ((1 << BITS) - 1)
    return rows, slots, 1 / np.sqrt(np.maximum(1, np.bincount(rows, minlength=n)))[rows]


def _split(url: str) -> tuple[str, str]:
    rest = url.partition("://")[2]
    ends = [i for i in (rest.find(c) for c in "/?#") if i >= 0]
    at = min(ends, default=len(rest))
    tail = rest[at:]
    return rest[:at].lower(), tail[: min((i for i in (tail.find("?"), tail.find("#")) if i >= 0), default=len(tail))]


@lru_cache(maxsize=1)
def train() -> tuple[np.ndarray, float]:
    """Weights and bias from LABELLED, by full gradient steps from zero: the same every time."""
    y = np.array([label for label, _ in LABELLED], float)
    hosts, paths = zip(*(_split(u) for _, u in LABELLED))
    rows, slots, value = _design(*features(list(hosts), list(paths)), len(y))
    w, bias = np.zeros(1 << BITS), 0.0
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-(np.bincount(rows, w[slots] * value, len(y)) + bias)))
        w -= RATE * (np.bincount(slots, (p - y)[rows] * value, 1 << BITS) / len(y) + DECAY * w)
        bias -= RATE * (p - y).mean()
    return w, bias


def score(df: DataFrame, *, host_col: str = "host", path_col: str = "path") -> DataFrame:
    """df with one more column, `risk`: the model's probability that the URL is one to block. Nulls count as empty.

    Equal URLs have equal risks, up to the last place of a double. Columns of df pass through; one named risk is an error.
    """
    common.prepare(df.sparkSession)
    common.free_names(df.columns, ["risk"])
    weights, bias = train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, paths = ([x or "" for x in batch.column(c).to_pylist()] for c in (host_col, path_col))
            n = len(hosts)
            if n:
                rows, slots, value = _design(*features(hosts, paths), n)
                risk = 1 / (1 + np.exp(-(np.bincount(rows, weights[slots] * value, n) + bias)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(risk)], [*batch.schema.names, "risk"])

    return df.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", risk double")


def judge(df: DataFrame, *, id_col: str = "page_id", url_col: str = "url", threshold: float = 0.5) -> DataFrame:
    """(id_col, host, path, rule, verdict, risk) for each row: the longest rule's verdict, else the model's.

    A null URL or one without :// has empty host and path, which no rule fits: the model judges it. Repeated rows give
    repeated rows; ids may be null or shared; other columns of df are not looked at. An id_col named like a result is an error.
    """
    common.free_names([id_col], ["host", "path", "rule", "verdict", "risk"])
    parts = df.select(F.col(id_col), host(F.col(url_col).cast("string")).alias("host"), path(F.col(url_col).cast("string")).alias("path"))
    name, verdict = rule(F.col("host"), F.col("path"))
    ruled = score(parts).withColumns({"rule": name, "verdict": verdict})
    own = F.when(F.col("risk") >= threshold, "block").otherwise("allow")
    return ruled.select(id_col, "host", "path", "rule", F.coalesce("verdict", own).alias("verdict"), "risk")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))
