"""Text features of a string column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalar import ratio

SMILIES = (":-)", ":)", ";-)", ";)")


def _count(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def basic_features(c: Column) -> dict[str, Column]:
    """Eleven counts and ratios of a text; null reads as empty."""
    t = F.coalesce(c, F.lit(""))
    words = F.filter(F.split(F.trim(t), r"\s+"), lambda w: w != "")
    chars, capitals = F.length(t), _count(t, r"[^\p{Lu}]")
    capitals = chars - capitals
    n, unique = F.size(words), F.size(F.array_distinct(words))
    smilies = sum(((F.length(t) - F.length(F.replace(t, F.lit(s), F.lit("")))) / len(s) for s in SMILIES), F.lit(0))
    out = {
        "num_chars": chars,
        "num_capitals": capitals,
        "num_exclamation_marks": _count(t, "!"),
        "num_question_marks": _count(t, r"\?"),
        "num_punctuation": _count(t, "[.,;:]"),
        "num_symbols": _count(t, r"[*&$%]"),
        "num_words": n,
        "num_unique_words": unique,
        "num_smilies": smilies,
    }
    return {k: v.cast("long") for k, v in out.items()} | {"caps_vs_length": ratio(chars, capitals), "words_vs_unique": ratio(unique, n)}


def with_basic_features(df: DataFrame, columns: list[str]) -> DataFrame:
    """All features of all text columns, named ``{column}_{feature}``."""
    return df.withColumns({f"{c}_{k}": v for c in columns for k, v in basic_features(F.col(c)).items()})
