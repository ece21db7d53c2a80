"""Generated reasoning records: formulas by a parser-free tree walk, syllogisms and algebra as DataFrame expressions.

Picks come from md5 of (seed, row, draw), so that rows depend on neither partitions nor engines.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from fractions import Fraction
from math import lcm

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.operators import reasoning as G

MIX = (0.5, 0.3, 0.2)
LANGS = ("en", "ar")
#: subject, middle, predicate: each chain is true of its words, and no word occurs in two chains
TRIPLES = {
    "en": [
        ("kittens", "cats", "felines"), ("trout", "fish", "swimmers"), ("lutes", "guitars", "stringed things"), ("limericks", "verses", "texts"), ("pears", "orchard goods", "foods"),
        ("ferries", "boats", "vessels"), ("lilies", "blossoms", "flora"), ("judges", "jurists", "scholars"), ("cubes", "prisms", "solids"), ("daggers", "blades", "weapons"),
        ("ants", "insects", "arthropods"), ("copper wires", "conductors", "materials"), ("villas", "houses", "buildings"), ("nurses", "carers", "employees"), ("sandals", "shoes", "garments"),
        ("spruces", "conifers", "woody growths"), ("tablets", "computers", "devices"), ("waltzes", "dances", "performances"), ("ponds", "lakes", "waters"), ("rubies", "jewels", "stones"),
        ("tailors", "craftsmen", "makers"), ("geckos", "lizards", "crawlers"), ("weeklies", "magazines", "periodicals"), ("stools", "seats", "furniture"), ("comets", "sky bodies", "space matter"),
    ],
    "ar": [
        ("قطط", "سنوريات", "مفترسات"), ("أسماك", "سابحات", "كائنات"), ("أعواد", "معازف", "آلات"), ("قصائد", "أشعار", "نصوص"), ("تمور", "ثمار", "أغذية"),
        ("زوارق", "قوارب", "مراكب"), ("زنابق", "أزهار", "نباتات"), ("قضاة", "حقوقيون", "علماء"), ("مكعبات", "مناشير", "مجسمات"), ("خناجر", "سكاكين", "أسلحة"),
        ("نمل", "حشرات", "مفصليات"), ("أسلاك", "موصلات", "مواد"), ("قصور", "منازل", "مبان"), ("ممرضون", "معالجون", "موظفون"), ("نعال", "أحذية", "ملابس"),
        ("أرز", "صنوبريات", "أشجار"), ("لوحات", "حواسيب", "أجهزة"), ("دبكات", "رقصات", "عروض"), ("برك", "بحيرات", "مياه"), ("يواقيت", "جواهر", "أحجار"),
        ("خياطون", "حرفيون", "صناع"), ("وزغ", "سحال", "زواحف"), ("أسبوعيات", "مجلات", "دوريات"), ("كراسي", "مقاعد", "أثاث"), ("مذنبات", "أجرام", "فضائيات"),
    ],
}
#: Major, minor, conclusion and figure of the moods in use; what follows is in the first list.
SOUND = {"figure1": ["AAA-1", "EAE-1", "AII-1", "EIO-1"], "figure2": ["AEE-2", "AOO-2", "EAE-2", "EIO-2"]}
UNSOUND = {
    "figure1": ["AAE-1", "EAA-1", "AIO-1", "EII-1", "AAA-2", "III-1", "AAA-3", "AEE-1"],
    "figure2": ["AEA-2", "AOA-2", "EAA-2", "EII-2", "AOO-1", "EEE-1", "AAI-1", "AAO-2"],
}
#: how each form is said of {a} and {b}
SAID = {
    "en": {"A": "All {a} are {b}.", "E": "No {a} are {b}.", "I": "Some {a} are {b}.", "O": "Some {a} are not {b}."},
    "ar": {"A": "كل {a} هي {b}.", "E": "لا شيء من {a} هو {b}.", "I": "بعض {a} هي {b}.", "O": "بعض {a} ليست {b}."},
}
ASKS = {"en": " Does it follow that: ", "ar": " هل يلزم أن: "}
ANSWERS = {"en": ("no", "yes"), "ar": ("لا", "نعم")}
STEPS = {
    "en": ("Terms: S={s}, M={m}, P={p}.", "See how M links the premises.", "Hold the conclusion against them.", "It does not follow.", "It follows."),
    "ar": ("الحدود: S={s} ، M={m} ، P={p}.", "انظر كيف يربط M المقدمتين.", "قارن الاستنتاج بهما.", "لا يلزم.", "يلزم."),
}
CHAIN_STEPS = {
    "en": ("Links: {1}-{2}, {3}-{4}, {5}-{6}.", "See whether they make a chain.", "It does not follow.", "It follows."),
    "ar": ("الروابط: {1}-{2} ، {3}-{4} ، {5}-{6}.", "انظر هل تؤلف سلسلة.", "لا يلزم.", "يلزم."),
}


def numbered(spark: SparkSession, n: int | DataFrame) -> DataFrame:
    """(i): the numbers that rows are made for, 0 to n - 1 or those of a table (i)."""
    return n.select(F.col("i").cast("long").alias("i")) if isinstance(n, DataFrame) else spark.range(n).withColumnRenamed("id", "i")


def pick(seed: int, draw: int, n: int | Column, key: str = "i") -> Column:
    """A number from 0 to n - 1 of row `key` and draw."""
    hashed = F.md5(F.concat_ws(":", F.lit(seed), F.col(key), F.lit(draw)))
    return F.pmod(F.conv(F.substring(hashed, 1, 8), 16, 10).cast("long"), n if isinstance(n, Column) else F.lit(n)).cast("int")


def slots(kind: str) -> dict[bool, list[str]]:
    """Moods as often as they are to be drawn, by whether they follow.

    Four fifths of what doesn't follow have a conclusion of a form that sound moods have too, as often as those have it,
    so that the form gives nothing away; one fifth has another form, if there is one.
    """
    sound, unsound = SOUND[kind], UNSOUND[kind]
    by_form = {f: [m for m in unsound if m[2] == f] for f in "AEIO"}
    shared = {f: sum(m[2] == f for m in sound) for f in "AEIO" if by_form[f] and any(m[2] == f for m in sound)}
    other = [f for f in "AEIO" if by_form[f] and f not in shared]
    most = Fraction(4, 5) if other else Fraction(1)
    share = {f: most * n / sum(shared.values()) for f, n in shared.items()} | {f: (1 - most) / len(other) for f in other}
    each = {m: share[f] / len(by_form[f]) for f in share for m in by_form[f]}
    whole = lcm(*(x.denominator for x in each.values()))
    return {True: sound, False: [m for m in unsound for _ in range(int(each[m] * whole))]}


def said(form: Column, a: Column, b: Column, lang: str) -> Column:
    made = F.lit(None).cast("string")
    for f, template in SAID[lang].items():
        made = F.when(form == f, F.replace(F.replace(F.lit(template), F.lit("{a}"), a), F.lit("{b}"), b)).otherwise(made)
    return made


def _filled(template: str, names: dict[str, Column]) -> Column:
    made = F.lit(template)
    for name, value in names.items():
        made = F.replace(made, F.lit("{" + name + "}"), value)
    return made


def _terms(lang: str, at: Column) -> Column:
    return F.get(F.array(*(F.array(*map(F.lit, t)) for t in TRIPLES[lang])), at)


def _premises(figure: Column, major: Column, minor: Column, s: Column, m: Column, p: Column, lang: str) -> tuple[Column, Column]:
    first = F.when(figure.isin(1, 3), said(major, m, p, lang)).otherwise(said(major, p, m, lang))
    second = F.when(figure.isin(1, 2), said(minor, s, m, lang)).otherwise(said(minor, m, s, lang))
    return first, second


def syllogisms(spark: SparkSession, n: int | DataFrame, seed: int, *, as_published: bool = False) -> DataFrame:
    """(id, lang, kind, mood, difficulty, question, cot, answer): n syllogisms in both languages.

    70 of 100 have figure1 moods and controls, 20 figure2 ones, 10 are chains of three premises; half of each follow.
    A chain that must not follow has its middle link turned. With as_published two terms change places in all
    premises instead, which leaves a chain that follows, still labelled as if it didn't.
    """
    u = pick(seed, 0, 10_000)
    base = numbered(spark, n)
    kind = F.when(u < 7_000, "figure1").when(u < 9_000, "figure2").otherwise("chain")
    drawn = base.select("i", kind.alias("kind"), (pick(seed, 1, 2) == 1).alias("follows"), pick(seed, 3, len(TRIPLES["en"])).alias("t"), F.pmod(pick(seed, 3, 25) + 1 + pick(seed, 4, 24), F.lit(25)).alias("t2"))
    mood = F.lit(None).cast("string")
    for k in SOUND:
        for follows, moods in slots(k).items():
            mood = F.when((F.col("kind") == k) & (F.col("follows") == follows), F.get(F.array(*map(F.lit, moods)), pick(seed, 2, len(moods)))).otherwise(mood)
    drawn = drawn.withColumn("mood", mood)
    difficulty = F.when(F.col("kind") != "figure1", "hard").when(F.col("follows"), "easy").otherwise("medium")
    made = None
    for lang in LANGS:
        s, m, p = (F.get(_terms(lang, F.col("t")), F.lit(k)) for k in range(3))
        last = F.get(_terms(lang, F.col("t2")), F.lit(2))
        no, yes = (F.lit(x) for x in ANSWERS[lang])
        first, second = _premises(F.substr("mood", F.lit(5), F.lit(1)).cast("int"), F.substr("mood", F.lit(1), F.lit(1)), F.substr("mood", F.lit(2), F.lit(1)), s, m, p, lang)
        two = F.concat(first, F.lit(" "), second, F.lit(ASKS[lang]), said(F.substr("mood", F.lit(3), F.lit(1)), s, p, lang))
        steps = F.array(*(_filled(x, {"s": s, "m": m, "p": p}) for x in STEPS[lang][:3]), F.when(F.col("follows"), STEPS[lang][4]).otherwise(STEPS[lang][3]))
        holds = F.col("follows")
        if as_published:
            b, c = F.when(holds, m).otherwise(p), F.when(holds, p).otherwise(m)
            links = [(s, b), (b, c), (c, last)]
        else:
            links = [(s, m), (F.when(holds, m).otherwise(p), F.when(holds, p).otherwise(m)), (p, last)]
        all_ = F.lit("A")
        chained = F.concat(F.concat_ws(" ", *(said(all_, a, b, lang) for a, b in links)), F.lit(ASKS[lang]), said(all_, s, last, lang))
        names = {str(k + 1): x for k, x in enumerate(x for link in links for x in link)}
        chain_steps = F.array(_filled(CHAIN_STEPS[lang][0], names), F.lit(CHAIN_STEPS[lang][1]), F.when(holds, CHAIN_STEPS[lang][3]).otherwise(CHAIN_STEPS[lang][2]))
        chain = F.col("kind") == "chain"
        rows = drawn.select(
            F.format_string(f"syllog-%s{lang}-%06d", F.when(chain, "sorites-").otherwise(""), "i").alias("id"), F.lit(lang).alias("lang"), "kind", "mood", difficulty.alias("difficulty"),
            F.when(chain, chained).otherwise(two).alias("question"), F.when(chain, chain_steps).otherwise(steps).alias("cot"), F.when(holds, yes).otherwise(no).alias("answer"),
        )
        made = rows if made is None else made.unionByName(rows)
    return made


def holdout_syllogisms(spark: SparkSession, n: int | DataFrame, seed: int) -> DataFrame:
    """(id, mood, question, cot, answer): figure 1, any of the 64 moods alike, labelled by the table of all moods."""
    forms = F.array(*map(F.lit, "AEIO"))
    rows = numbered(spark, n)
    rows = rows.select("i", *(F.get(forms, pick(seed, k, 4)).alias(c) for k, c in enumerate(("major", "minor", "conclusion"))), _terms("en", pick(seed, 3, 25)).alias("t"))
    table = G.syllogism_table(spark).filter("figure = 1").select("major", "minor", "conclusion", "valid")
    s, m, p = (F.get("t", F.lit(k)) for k in range(3))
    first, second, last = said(F.col("major"), m, p, "en"), said(F.col("minor"), s, m, "en"), said(F.col("conclusion"), s, p, "en")
    answer = F.when(F.col("valid"), "valid").otherwise("invalid")
    return rows.join(F.broadcast(table), ["major", "minor", "conclusion"]).select(  # 64 rows
        F.format_string("syllogism-holdout-%06d", "i").alias("id"), F.concat("major", "minor", "conclusion").alias("mood"),
        F.concat(F.lit("Premise 1: "), first, F.lit(" Premise 2: "), second, F.lit(" Conclusion: "), last, F.lit(" Is that valid?")).alias("question"),
        F.array(first, second, F.concat(F.lit("therefore: "), last), answer).alias("cot"), answer.alias("answer"),
    )


def _signed(x: Column) -> Column:
    """"+ 3" or "- 3"."""
    return F.concat(F.when(x >= 0, "+ ").otherwise("- "), F.abs(x).cast("string"))


def holdout_algebra(spark: SparkSession, n: int | DataFrame, seed: int) -> DataFrame:
    """(id, kind, question, cot, answer): equations to solve, sums to simplify and terms to evaluate, in whole numbers."""

    def between(draw: int, low: int, high: int) -> Column:
        return pick(seed, draw, high - low + 1) + low

    rows = numbered(spark, n).select("i", F.get(F.array(*map(F.lit, ("solve", "simplify", "evaluate"))), pick(seed, 0, 3)).alias("kind"))
    a, b, x = between(1, 2, 9), between(2, -20, 20), between(3, -10, 10)
    solve = F.struct(
        F.format_string("solve: %dx %s = %d", a, _signed(b), a * x + b).alias("question"), F.array(F.format_string("%dx = %d", a, a * x), F.format_string("x = %d", x)).alias("cot"), x.cast("string").alias("answer"),
    )
    a, b, c, d = between(4, 1, 5), between(5, 1, 5), between(6, -10, 10), between(7, -10, 10)
    short = F.when(c + d == 0, F.format_string("%dx", a + b)).otherwise(F.format_string("%dx%s", a + b, F.replace(_signed(c + d), F.lit(" "), F.lit(""))))
    simplify = F.struct(
        F.format_string("simplify: (%dx %s) + (%dx %s)", a, _signed(c), b, _signed(d)).alias("question"),
        F.array(F.format_string("of x: %d+%d=%d", a, b, a + b), F.format_string("others: %d+%d=%d", c, d, c + d), short).alias("cot"), short.alias("answer"),
    )
    a, b, op = between(8, 2, 20), between(9, 2, 20), F.get(F.array(*map(F.lit, "+-*")), pick(seed, 10, 3))
    value = F.when(op == "+", a + b).when(op == "-", a - b).otherwise(a * b)
    evaluate = F.struct(F.format_string("evaluate: %d %s %d", a, op, b).alias("question"), F.array(F.format_string("%d %s %d = %d", a, op, b, value)).alias("cot"), value.cast("string").alias("answer"))
    made = F.when(F.col("kind") == "solve", solve).when(F.col("kind") == "simplify", simplify).otherwise(evaluate)
    return rows.select("i", "kind", made.alias("x")).select(F.format_string("algebra-holdout-%06d", "i").alias("id"), "kind", "x.*")


#: how formulas are written: operators, values, question
WORDS = {
    "en": ({"and": "and", "or": "or", "implies": "implies", "not": "not "}, ("false", "true"), "Given {given}, what is the value of {formula}?"),
    "ar": ({"and": "و", "or": "أو", "implies": "يستلزم", "not": "ليس "}, ("خطأ", "صحيح"), "بفرض {given}، ما قيمة {formula}؟"),
    "symbols": ({"and": "&", "or": "|", "implies": "->", "not": "~"}, ("F", "T"), "Given {given}; evaluate: {formula}"),
}


def _tree(rng: random.Random, names: list[str], depth: int, leaves: float) -> tuple:
    """("var", name), ("not", tree) or (operator, left, right); above depth 0 a leaf has the chance `leaves`."""
    if depth == 0 or rng.random() < leaves:
        return ("var", rng.choice(names))
    op = rng.choice(["and", "or", "implies", "not"])
    return (op, *(_tree(rng, names, depth - 1, leaves) for _ in range(1 if op == "not" else 2)))


def _written(tree: tuple, ops: dict[str, str]) -> str:
    if tree[0] == "var":
        return tree[1]
    parts = [_written(t, ops) for t in tree[1:]]
    return ops["not"] + parts[0] if tree[0] == "not" else f"({parts[0]} {ops[tree[0]]} {parts[1]})"


def _traced(tree: tuple, env: dict[str, bool], ops: dict[str, str], values: tuple[str, str], steps: list[str]) -> bool:
    """The value of a tree; each node adds a step, those below it first."""
    if tree[0] == "var":
        value = env[tree[1]]
        steps.append(f"{tree[1]} = {values[value]}")
        return value
    of = [_traced(t, env, ops, values, steps) for t in tree[1:]]
    if tree[0] == "not":
        value, told = not of[0], f"{ops['not']}{values[of[0]]}"
    else:
        value = {"and": of[0] and of[1], "or": of[0] or of[1], "implies": not of[0] or of[1]}[tree[0]]
        told = f"{values[of[0]]} {ops[tree[0]]} {values[of[1]]}"
    steps.append(f"{told} = {values[value]}")
    return value


_PROPOSITION = "id string, lang string, difficulty string, depth int, question string, cot array<string>, answer string, gold boolean"


def _row(id_: str, lang: str, style: str, level: str, depth: int, tree: tuple, env: dict[str, bool]) -> tuple:
    ops, values, asked = WORDS[style]
    steps: list[str] = []
    gold = _traced(tree, env, ops, values, steps)
    given = ", ".join(f"{k}={values[v]}" for k, v in env.items())
    question = asked.replace("{given}", given).replace("{formula}", _written(tree, ops))
    return id_, lang, level, depth, question, steps, ("true" if gold else "false") if style == "symbols" else values[gold], gold


def _mapped(spark: SparkSession, n: int | DataFrame, rows_of) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in _PROPOSITION.split(", ")]
        for frame in frames:
            yield pd.DataFrame([row for i in frame["i"] for row in rows_of(int(i))], columns=names)

    return numbered(spark, n).mapInPandas(run, _PROPOSITION)


def prop_logic(spark: SparkSession, n: int | DataFrame, seed: int, mix: tuple[float, float, float] = MIX) -> DataFrame:
    """n formulas in both languages, with the steps of their evaluation: two to four variables, depth one to three.

    A quarter of the nodes above the ground are leaves, and a quarter of the deeper formulas are negated as a whole.
    Each row has a random state of its own.
    """

    def rows_of(i: int) -> list[tuple]:
        rng = random.Random(seed * 1_000_003 + i)
        level = rng.choices(range(3), weights=mix)[0]
        names, depth = ["p", "q", "r", "s"][: level + 2], level + 1
        tree = ("not", _tree(rng, names, depth - 1, 0.25)) if depth >= 2 and rng.random() < 0.25 else _tree(rng, names, depth, 0.25)
        env = {v: rng.random() < 0.5 for v in names}
        return [_row(f"prop-{lang}-{i:06d}", lang, lang, ["easy", "medium", "hard"][level], depth, tree, env) for lang in LANGS]

    return _mapped(spark, n, rows_of)


def holdout_prop(spark: SparkSession, n: int | DataFrame, seed: int) -> DataFrame:
    """n formulas in symbols only, five to seven deep on every branch, over two to four of eight variables."""

    def rows_of(i: int) -> list[tuple]:
        rng = random.Random(seed * 1_000_003 + i)
        names, depth = rng.sample(["a", "b", "c", "x", "y", "z", "m", "n"], rng.randint(2, 4)), rng.randint(5, 7)
        env = {v: rng.random() < 0.5 for v in names}
        return [_row(f"prop-holdout-{i:06d}", "en", "symbols", "hard", depth, _tree(rng, names, depth, 0.0), env)]

    return _mapped(spark, n, rows_of)
