"""Column functions over JSON texts."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F


def has_key(text: Column, key: str) -> Column:
    """Whether an object has a key, whatever its value but null."""
    return F.coalesce(F.get_json_object(text, f"$['{key}']").isNotNull(), F.lit(False))


def contains(text: Column, part: dict) -> Column:
    """Whether an object has all keys of a flat one with equal values; values compare as their JSON texts."""
    found = F.lit(True)
    for key, value in part.items():
        wanted = value if isinstance(value, str) else json.dumps(value)
        found = found & F.coalesce(F.get_json_object(text, f"$['{key}']") == wanted, F.lit(False))
    return found


def with_key(text: Column, key: str, value: Column) -> Column:
    """An object's text with a key set to a value; other values stay as they are written, keys keep their order, a new one comes last."""
    own = F.from_json(text, "map<string,string>")
    body = F.regexp_replace(F.trim(text), r"^\{|\}$", "")
    added = F.concat(F.lit(json.dumps(key)), F.lit(":"), F.get_json_object(F.to_json(F.struct(value.alias("v"))), "$.v"))
    # a key that is there is written anew by Spark's own map, where all values are texts
    replaced = F.to_json(F.map_from_entries(F.transform(F.map_entries(own), lambda e: F.struct(e["key"], F.when(e["key"] == key, value.cast("string")).otherwise(e["value"])))))
    return F.when(F.map_contains_key(own, key), replaced).otherwise(F.concat(F.lit("{"), body, F.when(F.trim(body) != "", ",").otherwise(""), added, F.lit("}")))
