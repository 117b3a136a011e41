"""Paths, names and other text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: what separates schema and table in a file's table segment.
TABLE_SEPARATOR = r"\.|__"


def path_segments(key: Column) -> Column:
    return F.split(key, "/")


def segment(key: Column, index: int) -> Column:
    """Segment ``index`` (from 0) of a path, NULL when the path is shorter."""
    return F.get(path_segments(key), F.lit(index))


def regex_part(text: Column, index: int, pattern: str = TABLE_SEPARATOR) -> Column:
    """Part ``index`` (from 0) of ``text`` split on a regular expression, NULL when absent."""
    return F.get(F.split(text, pattern), F.lit(index))


def dot_part(text: Column, index: int) -> Column:
    """Part ``index`` (from 0) of ``text`` split on full stops, NULL when absent."""
    return F.get(F.split(text, r"\."), F.lit(index))


def uri_bucket(uri: Column) -> Column:
    """Authority of ``scheme://bucket/prefix``."""
    return segment(uri, 2)


def uri_prefix(uri: Column) -> Column:
    """Everything after the authority; empty when there is nothing."""
    parts = path_segments(uri)
    return F.array_join(F.slice(parts, 4, F.greatest(F.size(parts) - 3, F.lit(0))), "/")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def object_uri(bucket: Column, key: Column, scheme: str = "s3") -> Column:
    """``scheme://bucket/key``; a NULL part is left out, not turned into a NULL result."""
    return F.concat(F.lit(f"{scheme}://"), F.concat_ws("/", bucket, key))


def char_count(text: Column, char: str) -> Column:
    """How often the one-character string ``char`` occurs in ``text``."""
    if len(char) != 1:
        raise ValueError("char must be one character")
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def blank_to_default(text: Column, default: str = "0") -> Column:
    """``default`` for NULL, the empty string and a single space."""
    return F.when(text.isNull() | text.isin("", " "), F.lit(default)).otherwise(text)
