"""Statistics of a text as Spark columns, in one form that Spark and DuckDB share.

All are shares of the characters but for ``variety`` (distinct words among the words, cut at single blanks) and
``word_length`` (characters a word). Null and empty texts have shares of 0, ``variety`` 1 and ``word_length`` 0.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Statistic: characters counted.
CLASSES = {
    "symbols": r"[#$%&*+<=>@^_`{}~\\\[\]/]",
    "bars": r"[|]",
    "shouts": r"[!?]",
    "capitals": r"[A-ZÀ-ÖØ-Þ]",
    "digits": r"[0-9]",
    "breaks": r"[\n]",
    "stops": r"[.,;:]",
}
NAMES = (*CLASSES, "variety", "word_length", "length")


def statistics(text: Column) -> dict[str, Column]:
    """By name; doubles, never null."""
    size = F.greatest(F.length(text), F.lit(1)).cast("double")
    out = {name: F.coalesce(F.regexp_count(text, F.lit(chars)) / size, F.lit(0.0)) for name, chars in CLASSES.items()}
    words = F.split(text, " ")
    out["variety"] = F.coalesce(F.size(F.array_distinct(words)) / F.size(words).cast("double"), F.lit(1.0))
    out["word_length"] = F.coalesce(F.length(text) / F.size(words).cast("double"), F.lit(0.0))
    out["length"] = F.coalesce(F.length(text), F.lit(0)).cast("double")
    return out


def statistics_sql(text: str = "text") -> dict[str, str]:
    """The same as DuckDB SQL."""
    size = f"greatest(length({text}), 1)::DOUBLE"
    out = {name: f"coalesce(len(regexp_extract_all({text}, '{chars}')) / {size}, 0)" for name, chars in CLASSES.items()}
    words = f"string_split({text}, ' ')"
    out["variety"] = f"coalesce(len(list_distinct({words})) / len({words})::DOUBLE, 1)"
    out["word_length"] = f"coalesce(length({text}) / len({words})::DOUBLE, 0)"
    out["length"] = f"coalesce(length({text}), 0)::DOUBLE"
    return out
