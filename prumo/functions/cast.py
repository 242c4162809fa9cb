"""Casts that give null instead of an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from prumo.functions.text import strip_all


def safe_float(c: Column) -> Column:
    """A number; null for what is none, NaN included."""
    v = c.try_cast("double")
    return F.when(~F.isnan(v), v)


def safe_int(c: Column) -> Column:
    """A whole number, cut towards zero by way of a float."""
    return safe_float(c).try_cast("int")


def safe_str(c: Column) -> Column:
    """Text without white space around it; null if nothing is left."""
    return F.nullif(strip_all(c.cast("string")), F.lit(""))


def zero_if_missing(c: Column) -> Column:
    """A whole number, 0 where it is none."""
    return F.coalesce(safe_int(c), F.lit(0))


def falsy_or(a: Column, b: Column) -> Column:
    """a unless it is null or 0, else b."""
    return F.when(a.isNotNull() & (a != 0), a).otherwise(b)


def timestamp_or(c: Column, default: Column) -> Column:
    """An ISO time; default where it can't be read."""
    return F.coalesce(c.try_cast("timestamp"), default)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return a / F.nullif(b, F.lit(0).cast("double"))


def clip(c: Column, low: Column, high: Column) -> Column:
    """c within bounds; null stays null."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, low), high))
