"""Names, tags, ids, digests: Column functions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Apostrophes that names are written with.
APOSTROPHES = "'’‘ʻʼ`´"


def normalised_name(c: Column) -> Column:
    """White space collapsed and trimmed; null where nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit(""))


def name_key(c: Column) -> Column:
    """Lower case, apostrophes dropped, all but latin letters, digits and cyrillic as one space; null as empty."""
    low = F.translate(F.lower(F.coalesce(c, F.lit(""))), APOSTROPHES, "")
    return F.trim(F.regexp_replace(low, r"[^a-z0-9Ѐ-ӿ]+", " "))


@F.pandas_udf(StringType())
def match_key(c: pd.Series) -> pd.Series:
    """Compatibility-decomposed, case-folded, only a-z and 0-9 (Spark has no Unicode normalisation)."""
    def one(s):
        if s is None:
            return ""
        folded = unicodedata.normalize("NFKD", s).casefold()
        return "".join(x for x in folded if x in "abcdefghijklmnopqrstuvwxyz0123456789")

    return c.map(one, na_action=None)


def is_latin(c: Column) -> Column:
    """At least half of the letters, and one, are latin."""
    letters = F.length(F.regexp_replace(c, r"\P{L}", ""))
    latin = F.length(F.regexp_replace(c, "[^A-Za-z]", ""))
    return F.coalesce((letters > 0) & (latin * 2 >= letters), F.lit(False))


def category(tags: list[Column], precedence: list[str]) -> Column:
    """The first value of the precedence list that any tag has; null if none."""
    have = F.array(*[F.lower(F.trim(t)) for t in tags])
    return F.get(F.array_intersect(F.array(*map(F.lit, precedence)), have), F.lit(0))


def cell_id(row: Column, col: Column) -> Column:
    return F.format_string("r%05dc%05d", row, col)


def ids_digest(ids: Column) -> Column:
    """SHA-256 of the ids, each with a newline behind it."""
    return F.sha2(F.concat(F.array_join(ids.cast("array<string>"), "\n"), F.lit("\n")), 256)


def date_fits(value: Column, precision: Column) -> Column:
    """Whether a partial date has the form of its precision (year, month, day)."""
    forms = {"year": r"^\d{4}$", "month": r"^\d{4}-(0[1-9]|1[0-2])$", "day": r"^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])$"}
    out = F.lit(False)
    for p, form in forms.items():
        out = F.when(precision == p, value.rlike(form)).otherwise(out)
    return F.coalesce(out, F.lit(False))


def without_suffix(c: Column, suffix: str) -> Column:
    return F.when(c.endswith(suffix), F.substring(c, 1, F.length(c) - len(suffix))).otherwise(c)
