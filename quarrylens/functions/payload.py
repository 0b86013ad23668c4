"""Typed accessors over VARIANT payloads.

``try_variant_get`` converts between JSON types (``10`` reads as the string
``'10'``).  The trace rules depend on the JSON type that was written, so every
accessor here checks the type first and yields NULL for any other type.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMERIC = r"^(BIGINT|DECIMAL|DOUBLE|FLOAT)"


def _get(v: Column, path: str, as_type: str) -> Column:
    return F.try_variant_get(v, path, as_type)


def json_type_at(v: Column, path: str = "$") -> Column:
    return F.schema_of_variant(_get(v, path, "variant"))


def v_str(v: Column, path: str) -> Column:
    """JSON string at ``path``."""
    return F.when(json_type_at(v, path) == "STRING", _get(v, path, "string"))


def v_text(v: Column, path: str) -> Column:
    """Non-empty JSON string at ``path``."""
    value = v_str(v, path)
    return F.when(value != "", value)


def v_num(v: Column, path: str) -> Column:
    """JSON number at ``path`` as DOUBLE."""
    return F.when(json_type_at(v, path).rlike(_NUMERIC), _get(v, path, "double"))


def v_num_text(v: Column, path: str) -> Column:
    """JSON number at ``path`` printed without a trailing ``.0``."""
    return F.when(
        json_type_at(v, path).rlike(_NUMERIC),
        F.regexp_replace(_get(v, path, "string"), r"\.0+$", ""),
    )


def number_text(number: Column) -> Column:
    """A number column as it is written: no exponent, no trailing zeros."""
    return F.regexp_replace(number.cast("decimal(38,6)").cast("string"), r"\.?0+$", "")


def v_long(v: Column, path: str) -> Column:
    return F.when(json_type_at(v, path).rlike(_NUMERIC), _get(v, path, "double").cast("bigint"))


def v_bool(v: Column, path: str) -> Column:
    return F.when(json_type_at(v, path) == "BOOLEAN", _get(v, path, "boolean"))


def v_truthy(v: Column, path: str) -> Column:
    """Loose truth test: false for missing, null, false, zero and empty string."""
    kind = json_type_at(v, path)
    return F.coalesce(
        F.when(kind == "BOOLEAN", _get(v, path, "boolean"))
        .when(kind == "STRING", _get(v, path, "string") != "")
        .when(kind.rlike(_NUMERIC), _get(v, path, "double") != 0)
        .when(kind == "VOID", F.lit(False))
        .when(kind.isNotNull(), F.lit(True)),
        F.lit(False),
    )


def v_array(v: Column, path: str) -> Column:
    return _get(v, path, "array<variant>")


def v_object(v: Column, path: str) -> Column:
    """JSON object at ``path`` as MAP<STRING, VARIANT>."""
    return _get(v, path, "map<string,variant>")


def _id_text(v: Column) -> Column:
    kind = F.schema_of_variant(v)
    text = v.cast("string")
    return F.when(kind == "STRING", F.nullif(text, F.lit(""))).when(
        kind.rlike(_NUMERIC), F.regexp_replace(text, r"\.0+$", "")
    )


def v_id(v: Column, *paths: str) -> Column:
    """Identifier at the first path holding any non-null value: text or number."""
    values = [_get(v, p, "variant") for p in paths]
    present = [F.when(~F.is_variant_null(x), x) for x in values]
    return _id_text(F.coalesce(*present) if len(present) > 1 else values[0])


def first_text(v: Column, *paths: str) -> Column:
    """First non-empty string among ``paths``."""
    return F.coalesce(*[v_text(v, p) for p in paths])


def first_num_text(v: Column, *paths: str) -> Column:
    return F.coalesce(*[v_num_text(v, p) for p in paths])


def json_kind(v: Column) -> Column:
    """JSON type name: null, array, object, string, number or boolean."""
    kind = F.schema_of_variant(v)
    return (
        F.when(kind.startswith("ARRAY"), "array")
        .when(kind.startswith("OBJECT"), "object")
        .when(kind == "STRING", "string")
        .when(kind == "BOOLEAN", "boolean")
        .when(kind == "VOID", "null")
        .when(kind.isNotNull(), "number")
    )


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
