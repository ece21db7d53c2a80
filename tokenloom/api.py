"""The facade: tokenize, project, encode and decode tables of sentences (id, text)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.functions import tokens as K
from tokenloom.operators import arabic, corpus

LANGS, LEVELS = ("ar", "en"), ("standard", "reasoning", "logic")


def _checked(lang: str, level: str) -> None:
    if lang not in LANGS:
        raise ValueError(f"language must be one of {LANGS}, not {lang!r}")
    if level not in LEVELS:
        raise ValueError(f"level must be one of {LEVELS}, not {level!r}")


def _standard(df: DataFrame, lang: str, level: str, analyses: DataFrame | None, roots: DataFrame | None, lexicon: corpus.Lexicon | arabic.Lexicon | None) -> DataFrame:
    """(id, tokens) between [BOS] and [EOS]. The reasoning level of English has a lexer of its own; all else starts from the tokenizer."""
    if lang == "ar":
        if analyses is None:
            raise ValueError("Arabic needs a table of analyses")
        own = lexicon if isinstance(lexicon, arabic.Lexicon) else None
        return arabic.tokenize(df.select("id", "text"), analyses, roots, lexicon=own).select("id", "tokens")
    if level == "reasoning":
        return df.select("id", K.lex_english(F.col("text")).alias("tokens"))
    return corpus.tokenize_texts(df, atomic=True, lexicon=lexicon).select("id", K.wrap(F.col("tokens")).alias("tokens"))


def project(df: DataFrame, level: str, lang: str = "en") -> DataFrame:
    """df (id, tokens) at another level; [BOS] and [EOS] are left out by the logic level."""
    _checked(lang, level)
    rest = [c for c in df.columns if c != "tokens"]
    if level == "reasoning":
        return df.withColumn("_k", K.reasoning_kept(F.col("tokens"), lang)).select(*rest, K.reasoning_collapse(F.col("_k")).alias("tokens"))
    if level == "logic":
        return df.withColumn("_p", K.logic_parts(K.unmark(F.col("tokens")))).select(*rest, K.logic_collapse(F.col("_p")).alias("tokens"))
    return df


def tokenize(
    df: DataFrame, lang: str, level: str = "standard", *, add_bos_eos: bool = True, analyses: DataFrame | None = None, roots: DataFrame | None = None, lexicon: corpus.Lexicon | arabic.Lexicon | None = None, vocab: DataFrame | None = None
) -> DataFrame:
    """(id, lang, level, tokens, ids, meta) of sentences (id, text), a row for each; ids are null without a vocabulary (token, id).

    meta has the numbers of tokens before and after projection. Rows may share ids.
    """
    _checked(lang, level)
    standard = _standard(df, lang, level, analyses, roots, lexicon).withColumn("n_standard", F.size("tokens"))
    made = project(standard, level, lang).withColumn("tokens", K.unmark(F.col("tokens")))
    if add_bos_eos:
        made = made.withColumn("tokens", K.wrap(F.col("tokens")))
    if vocab is None:
        made = made.withColumn("ids", F.lit(None).cast("array<int>"))
    else:
        made = corpus.with_ids(made, vocab, unknown=_unknown(vocab))
    meta = F.struct("n_standard", F.size("tokens").alias("n_tokens")).alias("meta")
    return made.select("id", F.lit(lang).alias("lang"), F.lit(level).alias("level"), "tokens", "ids", meta)


def tokenize_formal(df: DataFrame, *, add_bos_eos: bool = False) -> DataFrame:
    made = df.withColumn("_t", K.lex_formal(F.col("text"))).select("id", K.logic_collapse(F.col("_t")).alias("tokens"))
    return made.withColumn("tokens", K.wrap(F.col("tokens"))) if add_bos_eos else made


def _unknown(vocab: DataFrame) -> int:
    unknown = vocab.filter("token = '[UNK]'").select("id").first()
    if unknown is None:
        raise ValueError("the vocabulary has no [UNK]")
    return unknown["id"]


def encode(df: DataFrame, vocab: DataFrame) -> DataFrame:
    """(id, ids); a vocabulary without [UNK] is an error."""
    return corpus.encode(df.withColumnRenamed("id", "row"), vocab, ["row"], unknown=_unknown(vocab)).withColumnRenamed("row", "id")


def decode(df: DataFrame, vocab: DataFrame) -> DataFrame:
    return corpus.decode(df.withColumnRenamed("id", "row"), vocab, ["row"]).withColumnRenamed("row", "id")
