"""String functions over columns. Null is as empty throughout."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkwright.functions.tables import COUNTRIES, DEVANAGARI, GUJARATI, INDIC


def _fold(text: str) -> str:
    return text if text.isascii() else "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


@F.pandas_udf(T.StringType())
def strip_accents(text: pd.Series) -> pd.Series:
    """NFKD without combining marks; the one thing here that Spark has no function for."""
    return pd.Series([_fold(t or "") for t in text])


def _filled(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def clean(text: Column) -> Column:
    """Without accents, in lower case, everything but letters, digits and underscores as single spaces."""
    return squeeze(F.regexp_replace(F.lower(strip_accents(_filled(text))), r"[^\p{L}\p{N}_\s]", " "))


def alphanumeric(text: Column) -> Column:
    return F.regexp_replace(F.lower(strip_accents(_filled(text))), "[^a-z0-9]", "")


def words(cleaned: Column) -> Column:
    return F.filter(F.split(cleaned, " "), lambda w: w != "")


def sorted_distinct(tokens: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(tokens)), " ")


def char_ngrams(cleaned: Column, n: int = 3) -> Column:
    """Windows of a cleaned text between two spaces, repeats included; the whole if it is shorter than n."""
    padded = F.concat(F.lit(" "), cleaned, F.lit(" "))
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - (n - 1), F.lit(1))), lambda i: F.substring(padded, i, F.lit(n)))


def numbers(text: Column) -> Column:
    return F.regexp_extract_all(_filled(text), F.lit(r"\b\d+\b"), F.lit(0))


def has_indic(text: Column) -> Column:
    return _filled(text).rlike(INDIC)


def transliterate(text: Column) -> Column:
    """Words and conjuncts first, each set off by spaces, then letter by letter; texts without Indic letters stay as they are."""
    maps = [*DEVANAGARI.items(), *GUJARATI.items()]
    out = reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(f" {kv[1]} ")), [kv for kv in maps if len(kv[0]) > 1], _filled(text))
    out = reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), [kv for kv in maps if len(kv[0]) == 1 and len(kv[1]) > 1], out)
    single = {k: v for k, v in reversed(maps) if len(k) == 1 and len(v) == 1}
    gone = "".join(k for k, v in maps if len(k) == 1 and not v)
    out = F.translate(out, "".join(single) + gone, "".join(single.values()))
    return F.when(has_indic(text), squeeze(out)).otherwise(_filled(text))


def lookup(table: dict[str, str], key: Column) -> Column:
    """Value of a fixed mapping, null if it has none."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def title(text: Column) -> Column:
    """Every letter after a character that is no letter in upper case, all others in lower case."""
    return F.array_join(F.transform(F.split(text, r"(?<=[^\p{L}])|(?=[^\p{L}])"), F.initcap), "")


def country(label: Column) -> Column:
    raw = F.trim(label)
    return F.when(_filled(label) == "", F.lit("UNKNOWN")).otherwise(F.coalesce(lookup(COUNTRIES, F.lower(raw)), title(raw)))
