"""Deterministic keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def short_hash(value: Column) -> Column:
    return F.substring(F.sha2(value, 256), 1, 16)


def doc_key(name: Column, n_bytes: Column) -> Column:
    """Of name and byte length, not of content: see ``content_sha`` for changes."""
    return short_hash(F.concat(name, n_bytes.cast("string")))


def content_sha(text: Column) -> Column:
    return F.sha2(text, 256)


def chunk_id(doc: Column, number: Column) -> Column:
    return F.concat_ws(":", doc, number.cast("string"))


def point_id(chunk: Column) -> Column:
    """60-bit integer key of a vector point."""
    return F.conv(F.substring(F.sha2(chunk, 256), 1, 15), 16, 10).cast("long")
