"""String expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def key_of(value: Column | str) -> Column:
    """Case-insensitive comparison key."""
    return F.lower(F.trim(_col(value)))


def is_blank(value: Column | str) -> Column:
    column = _col(value)
    return column.isNull() | (F.trim(column) == "")


def clean(value: Column | str) -> Column:
    """Trimmed text, or null when nothing is left."""
    column = F.trim(_col(value))
    return F.when(column != "", column)


def normalize_path(value: Column | str) -> Column:
    """Forward slashes, and a slash after a drive letter."""
    path = F.replace(F.trim(_col(value)), F.lit("\\"), F.lit("/"))
    return F.regexp_replace(path, r"^([\p{L}]:)(?!/)", "$1/")


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)
