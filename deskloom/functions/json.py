"""Tolerant access to JSON text."""

from pyspark.sql import Column, functions as F


def parse(text: Column) -> Column:
    return F.try_parse_json(text)


def is_array(variant: Column) -> Column:
    return F.coalesce(F.schema_of_variant(variant).startswith("ARRAY"), F.lit(False))


def is_object(variant: Column) -> Column:
    return F.coalesce(F.schema_of_variant(variant).startswith("OBJECT"), F.lit(False))


def elements(variant: Column) -> Column:
    """Array elements; null when the value is not an array."""
    return F.when(is_array(variant), F.try_variant_get(variant, "$", "array<variant>"))


def text_field(variant: Column, name: str) -> Column:
    """A field as text; null when missing, null or not a scalar."""
    return F.try_variant_get(variant, f"$.{name}", "string")
