"""Closed logic vocabulary, formula evaluation, syllogisms, linear equations."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tokenloom import lexicon as L


def closed_vocabulary(spark: SparkSession) -> DataFrame:
    """(token, bucket, id): 151 tokens; specials in list order, then each bucket by name. A repeated token is an error."""
    rows = [(b, i, t, j) for i, (b, ts) in enumerate(L.LOGIC_BUCKETS.items()) for j, t in enumerate(ts)]
    if len({r[2] for r in rows}) != len(rows):
        raise ValueError("a token is in two buckets")
    order = Window.orderBy("b", F.when(F.col("b") == 0, F.col("j")).otherwise(0), "token")
    table = spark.createDataFrame(rows, "bucket string, b int, token string, j int")
    return table.select("token", "bucket", (F.row_number().over(order) - 1).cast("long").alias("id"))


_LEXEME = re.compile(r"<->|<=>|->|=>|&&|\|\||[↔→∧∨¬~!&|()]|[A-Za-z_]\w*|[01]\b")
_SAME = {"<->": "↔", "<=>": "↔", "->": "→", "=>": "→", "&&": "∧", "&": "∧", "||": "∨", "|": "∨", "~": "¬", "!": "¬", "and": "∧", "or": "∨", "not": "¬", "iff": "↔", "implies": "→"}


def evaluate_text(text: str) -> bool | None:
    """The value of the expression behind the last ; or then, under the assignments in the text; None if a variable is unknown.

    and / or bind alike and from the left; arrows bind weaker and from the right; an unknown part makes all unknown.
    """
    env = {n.lower(): v.lower() in ("true", "t", "1") for n, v in re.findall(r"([A-Za-z_]\w*)\s*=\s*(true|false|t|f|1|0)\b", text, re.I)}
    parts = re.split(r";|\bthen\b", text)
    queue = [_SAME.get(x.lower(), x) for x in _LEXEME.findall(parts[-1])]
    queue.reverse()

    def unit() -> bool | None:
        t = queue.pop() if queue else ""
        if t == "(":
            v = whole()
            if queue and queue[-1] == ")":
                queue.pop()
            return v
        if t == "¬":
            v = unit()
            return None if v is None else not v
        if t.lower() in ("true", "false"):
            return t.lower() == "true"
        return env.get(t.lower())

    def joined() -> bool | None:
        v = unit()
        while queue and queue[-1] in "∧∨":
            op, w = queue.pop(), unit()
            v = None if v is None or w is None else (v and w if op == "∧" else v or w)
        return v

    def whole() -> bool | None:
        v = joined()
        if queue and queue[-1] in "→↔":
            op, w = queue.pop(), whole()
            return None if v is None or w is None else ((not v) or w if op == "→" else v == w)
        return v

    return whole()


def evaluate(df: DataFrame, column: str = "s") -> DataFrame:
    """df with answer: true, false or unknown."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = {True: "true", False: "false", None: "unknown"}
        for frame in frames:
            yield frame.assign(answer=[names[evaluate_text(x)] for x in frame[column]])

    return df.mapInPandas(run, df.select("*", F.lit("").alias("answer")).schema)


def solve(df: DataFrame, column: str = "s") -> DataFrame:
    """df with variable and solution of a x + b = c; nulls for what is no such equation or has a = 0."""
    low = F.lower(F.trim(column))
    pattern = r"solve +(-?[0-9]+) *\*? *([a-z]) *([+-]) *(-?[0-9]+) *= *(-?[0-9]+)"
    part = [F.regexp_extract(low, pattern, i) for i in range(6)]
    a, b, c = (F.when(x != "", x.cast("double")) for x in (part[1], part[4], part[5]))
    b = F.when(part[3] == "-", -b).otherwise(b)
    ok = (part[0] != "") & (a != 0)
    return df.withColumns({"variable": F.when(ok, part[2]), "solution": F.when(ok, (c - b) / a)})


def syllogism_table(spark: SparkSession) -> DataFrame:
    """(figure, major, minor, conclusion, valid): no population of the seven regions has true premises and a false conclusion."""
    forms = spark.createDataFrame([(f,) for f in "AEIO"], "f string")
    # 4 figures x 64 moods x 128 populations: fixed whatever the data are
    grid = spark.range(4).select((F.col("id") + 1).cast("int").alias("figure")).join(forms.withColumnRenamed("f", "major")).join(forms.withColumnRenamed("f", "minor")).join(forms.withColumnRenamed("f", "conclusion")).join(spark.range(128).select(F.col("id").alias("pop")))
    s, m, p = 1, 2, 4

    def holds(form, a: int, b: int):
        def some(regions):
            return F.col("pop").bitwiseAND(F.lit(sum(1 << (r - 1) for r in regions))) != 0

        inside = some([r for r in range(1, 8) if r & a and r & b])
        outside = some([r for r in range(1, 8) if r & a and not r & b])
        return F.when(form == "A", ~outside).when(form == "E", ~inside).when(form == "I", inside).otherwise(outside)

    major = F.when(F.col("figure").isin(1, 3), holds(F.col("major"), m, p)).otherwise(holds(F.col("major"), p, m))
    minor = F.when(F.col("figure").isin(1, 2), holds(F.col("minor"), s, m)).otherwise(holds(F.col("minor"), m, s))
    fine = ~(major & minor) | holds(F.col("conclusion"), s, p)
    return grid.groupBy("figure", "major", "minor", "conclusion").agg(F.bool_and(fine).alias("valid"))
