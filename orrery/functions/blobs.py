"""Semi-structured results kept as JSON text and read as VARIANT: nested fields by path, and bad JSON as null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def written(value: Column) -> Column:
    """A struct, array or map as JSON text, whole; fields that are null are left out."""
    return F.to_json(value)


def read(blob: Column) -> Column:
    """A VARIANT of JSON text; null for a null blob and for text that is no JSON."""
    return F.try_parse_json(blob)


def bad(blob: Column) -> Column:
    """Whether there is a blob that is no JSON."""
    return blob.isNotNull() & F.try_parse_json(blob).isNull()


def value(variant: Column, path: str, kind: str) -> Column:
    """The field at a path as a type; null where it is absent, of another type or the variant is null."""
    return F.try_variant_get(variant, path, kind)
