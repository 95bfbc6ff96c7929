"""Typed views of attributes that are stored as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def json_view(text: Column | str) -> Column:
    """A Json attribute as a variant; null for text that is no JSON (the attribute itself keeps it)."""
    return F.try_parse_json(_col(text))


def json_value(text: Column | str, path: str, kind: str = "string") -> Column:
    """A value within a Json attribute; null where it is missing or of another kind."""
    return F.try_variant_get(json_view(text), path, kind)


def time_view(text: Column | str) -> Column:
    """A DateTime attribute (ISO 8601) as a timestamp; null for text that is none."""
    return F.try_to_timestamp(_col(text))


def time_text(time: Column | str) -> Column:
    """A timestamp as ISO 8601 text in the session's zone, microseconds and offset included."""
    return F.date_format(_col(time), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
