"""JSON containment: does a document hold a given pattern?

The pattern is a Python value, so it compiles to a tree of built-in expressions. Objects: every key of the
pattern is there and contains its value. Arrays: every pattern element is contained in some element, in any
order and number. Scalars: same JSON type and equal, numbers by value. Only at the top may an array contain
a bare scalar.

A stored document holds integers of more than 38 digits as 64-bit floats. Two such integers that round to the same
float are equal here, and no pattern tells them apart; up to 38 digits every digit counts.
"""

from __future__ import annotations

from decimal import Context, Decimal
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from batchloom.functions.fields import ARRAY, OBJECT

#: Normalizing must not round; decimals have 38 digits, and 64-bit floats 309 before the point.
_EXACT = Context(prec=400)
_INT64 = range(-(2**63), 2**63)


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def _as_object(value: Column) -> Column:
    return F.try_variant_get(value, "$", OBJECT)


def _as_array(value: Column) -> Column:
    return F.try_variant_get(value, "$", ARRAY)


def _at(document: Column, path: str) -> Column:
    return document if path == "$" else F.try_variant_get(document, path, "variant")


def _scalar_equals(value: Column, scalar) -> Column:
    kind = F.schema_of_variant(value)
    if scalar is None:
        return F.is_variant_null(value)
    if isinstance(scalar, bool):
        return (kind == "BOOLEAN") & (F.try_variant_get(value, "$", "boolean") == F.lit(scalar))
    if isinstance(scalar, str):
        return (kind == "STRING") & (F.try_variant_get(value, "$", "string") == F.lit(scalar))
    # A decimal has digits that a float cannot hold: it is compared as text, which variants spell one way only.
    as_double = (kind == "DOUBLE") & (F.try_variant_get(value, "$", "double") == F.lit(float(scalar)))
    spelled = format(Decimal(repr(scalar)).normalize(_EXACT), "f")
    by_value = as_double | (kind.startswith("DECIMAL") & (F.try_variant_get(value, "$", "string") == F.lit(spelled)))
    if scalar == int(scalar) and int(scalar) in _INT64:
        exact = (kind == "BIGINT") & (F.try_variant_get(value, "$", "bigint") == F.lit(int(scalar)).cast("bigint"))
        return exact | by_value
    return by_value


def _contains(document: Column, path: str, pattern) -> Column:
    if isinstance(pattern, dict):
        if not pattern:
            return F.try_variant_get(_at(document, path), "$", "struct<>").isNotNull()
        return _all([_contains_key(document, path, key, value) for key, value in pattern.items()])
    if isinstance(pattern, list):
        elements = _as_array(_at(document, path))
        return _all([elements.isNotNull(), *[_some_element(elements, part) for part in pattern]])
    return _scalar_equals(_at(document, path), pattern)


def _some_element(elements: Column, pattern) -> Column:
    return F.exists(elements, lambda e: F.coalesce(_contains(e, "$", pattern), F.lit(False)))


def _contains_key(document: Column, path: str, key: str, pattern) -> Column:
    if "'" in key or "]" in key or "\\" in key:
        # No path can spell this key: look it up in the object's fields.
        return _contains(F.try_element_at(_as_object(_at(document, path)), F.lit(key)), "$", pattern)
    return _contains(document, f"{path}['{key}']", pattern)


def json_contains(document: Column, pattern) -> Column:
    found = _contains(document, "$", pattern)
    if not isinstance(pattern, (dict, list)):
        found = F.coalesce(found, F.lit(False)) | F.exists(_as_array(document), lambda e: _scalar_equals(e, pattern))
    return F.coalesce(found, F.lit(False))
