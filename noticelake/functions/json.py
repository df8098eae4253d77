"""Paths into JSON texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dig(json: Column, path: str, kind: str = "string") -> Column:
    """The value at a dotted path, with ``[k]`` for items; null where it is missing, of another kind, or the text is no JSON."""
    return F.try_variant_get(F.try_parse_json(json), f"$.{path}", kind)


def dig_all(json: Column, path: str) -> Column:
    """The values at a path as texts: all items of an array, a scalar alone, none where it is missing or null."""
    v = F.try_parse_json(json)
    many, one = F.try_variant_get(v, f"$.{path}", "array<string>"), F.try_variant_get(v, f"$.{path}", "string")
    return F.coalesce(many, F.when(one.isNotNull(), F.array(one)))
