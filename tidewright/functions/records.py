"""Scalar functions over record columns that reports and readers share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that a CSV of records uses for a missing value. Fixed values of the source contract.
NULL_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


def null_tokens(c: Column) -> Column:
    """A text, or null where it is one of the tokens for a missing value."""
    return F.when(~c.isin(*NULL_TOKENS), c)


def number(c: Column) -> Column:
    """A text as a double; null where it isn't a finite number."""
    d = c.try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)


def slug(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), F.lit("-"))


def canonical_json(**columns: Column) -> Column:
    """Compact JSON with keys in order; nulls are kept out."""
    return F.to_json(F.struct(*(columns[k].alias(k) for k in sorted(columns))))


def redacted(details: Column, words=("password", "secret", "token", "key")) -> Column:
    """A map with the values of secret-looking keys replaced."""
    return F.transform_values(details, lambda k, v: F.when(F.lower(k).rlike("|".join(words)), F.lit("[redacted]")).otherwise(v))
