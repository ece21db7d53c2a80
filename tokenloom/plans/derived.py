"""Columns that queries derive from the tables where these have nothing of their own kind: words of a pool, chosen by hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tokenloom.plans import dialect as D


def hashed(word: Column, n: int) -> Column:
    """A number from 0 to n - 1 by the word's MD5."""
    return F.pmod(F.conv(F.substring(F.md5(word.cast("binary")), 1, 7), 16, 10).cast("long"), F.lit(n)).cast("int")


def hashed_sql(word: str, n: int) -> str:
    return f"('0x' || md5({word})[1:7])::bigint % {n}"


def pooled(words: Column, pool: list[str]) -> Column:
    """Each of the words as one of the pool's."""
    table = F.array(*map(F.lit, pool))
    return F.transform(words, lambda w: F.get(table, hashed(w, len(pool))))


def pooled_sql(words: str, pool: list[str]) -> str:
    return f"list_transform({words}, lambda w: [{', '.join(map(D.quote, pool))}][{hashed_sql('w', len(pool))} + 1])"


def chosen(number: Column, pool: list) -> Column:
    """One of a pool by a number."""
    return F.get(F.array(*map(F.lit, pool)), F.pmod(number, F.lit(len(pool))).cast("int"))


def chosen_sql(number: str, pool: list) -> str:
    return f"[{', '.join(map(D.quote, pool))}][{number} % {len(pool)} + 1]"
