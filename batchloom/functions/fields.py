"""Strict JSON fields: a value of the wrong JSON type is a failure, never a silent cast.

Rules: keys match in any letter case and the last spelling wins; an absent or ``null`` value is "no value";
text must be a JSON string, integers must be JSON integers in the 64-bit range, objects must be objects.

The functions take and give SQL expression text, so that a whole event is one expression and not hundreds of
calls between Python and the JVM; wrap the result in ``F.expr``.
"""

from __future__ import annotations

from batchloom.schemas import EVENT_FIELDS

# The wire decoder takes neither single-quoted text nor NaN / Infinity.
STRICT_JSON = "map('allowSingleQuotes', 'false', 'allowNonNumericNumbers', 'false')"
OBJECT = "map<string,variant>"
ARRAY = "array<variant>"
JSON_NULL = "parse_json('null')"

_SQL_TYPE = {"text": "string", "nullable text": "string", "integer": "bigint"}
_JSON_TYPE = {"text": "STRING", "nullable text": "STRING", "integer": "BIGINT"}
_ZERO = {"text": "''", "integer": "0L", "object": JSON_NULL}


def json_fields(text: str) -> str:
    """Raw values of a JSON object by lower-case key; NULL when the text is not an object.

    Keys are taken in text order, so of several spellings the last one wins. Bytes after the first JSON
    value are ignored.
    """
    return fold_keys(f"from_json({text}, '{OBJECT}', {STRICT_JSON})")


def is_null_text(text: str) -> str:
    """The text ``null`` decodes to an empty record; other non-objects do not decode."""
    return f"coalesce(is_variant_null(try_parse_json({text})), false)"


def _mark(text: str) -> str:
    return f"xxhash64({text})"


def marked_values(text: str) -> str:
    """The objects of a JSON text, and behind them one that marks the end of the text by its own hash.

    The text is put into an array: whatever follows its first value breaks the array, adds to it or ends it early, so
    the mark is not the second element then. NULL where the text does not parse or holds other values than objects
    and nulls.
    """
    return f"from_json(concat('[', {text}, ',{{\"\":', {_mark(text)}, '}}]'), 'array<{OBJECT}>', {STRICT_JSON})"


def _is_marked(values: str, text: str) -> str:
    mark = f"try_variant_get(try_element_at({values}[1], ''), '$', 'bigint')"
    return f"coalesce(size({values}) = 2 AND {mark} = {_mark(text)}, false)"


def one_object(values: str, text: str) -> str:
    """As ``json_fields``, for a text that is one JSON object and nothing more."""
    return f"CASE WHEN {_is_marked(values, text)} THEN {fold_keys(f'{values}[0]')} END"


def is_one_null(values: str, text: str) -> str:
    """True where the text is the word ``null`` and nothing more."""
    return f"({_is_marked(values, text)} AND {values}[0] IS NULL)"


# Strings and what lies between them, and the numbers in the latter.
JSON_PARTS = r'''"(?:[^"\\\\]|\\\\.)*+"|[^"]++'''
_NUMBER = r"-?[0-9]++(?:\\.[0-9]++)?+(?:[eE][+-]?[0-9]++)?+"


def may_hold_infinite_number(text: str) -> str:
    """True when the text holds a digit with a long exponent, or a very long number; nearly no text does.

    Without the digit, each id of a letter and a number would be taken for an exponent.
    """
    return f"({text} RLIKE '[0-9][eE][+]?[0-9]{{3}}' OR {text} RLIKE '[0-9]{{300}}')"


def has_infinite_number(text: str) -> str:
    """True when a number of the JSON text is beyond the range of 64-bit floats."""
    parts = f"filter(regexp_extract_all({text}, '{JSON_PARTS}', 0), p -> NOT startswith(p, '\"'))"
    numbers = f"flatten(transform({parts}, p -> regexp_extract_all(p, '{_NUMBER}', 0)))"
    return f"({may_hold_infinite_number(text)} AND exists({numbers}, n -> abs(try_cast(n AS double)) = double('Infinity')))"


def may_need_folding(text: str) -> str:
    """True when the text may hold a known key in other letters; without one, keys can be taken as they are.

    Such a key has a capital and letters up to its closing quote, or an escape; the first test is quick and rarely true.
    """
    keys = "|".join(["batch_id", "events", *[key for key, _, _ in EVENT_FIELDS]])
    capital = f"{text} RLIKE '[A-Z][A-Za-z_]*+\"\\\\s*+:' AND {text} RLIKE '\"(?=[a-z_]*[A-Z])(?i:{keys})\"'"
    return f"(({capital}) OR contains({text}, '\\\\u00'))"


def plain_events(value: str) -> str:
    """The raw values of the known keys of all events of an array, spelled as they are known.

    NULL where it is no array, or one with other elements than objects.
    """
    kinds = ",".join(f"{key}:variant" for key, _, _ in EVENT_FIELDS)
    events = f"try_variant_get({value}, '$', 'array<struct<{kinds}>>')"
    return f"CASE WHEN NOT exists({events}, e -> e IS NULL) THEN {events} END"


def fold_keys(fields: str) -> str:
    return f"transform_keys({fields}, (key, value) -> lower(key))"


def as_object(value: str) -> str:
    """The fields of a JSON object as a map, NULL for anything else."""
    return f"try_variant_get({value}, '$', '{OBJECT}')"


def is_object(value: str) -> str:
    """True for a JSON object, however large: an empty struct takes no field from it."""
    return f"try_variant_get({value}, '$', 'struct<>') IS NOT NULL"


def as_array(value: str) -> str:
    """The elements of a JSON array, NULL for anything else."""
    return f"try_variant_get({value}, '$', '{ARRAY}')"


def has_value(value: str) -> str:
    return f"({value} IS NOT NULL AND NOT is_variant_null({value}))"


def wrong_type(value: str, kind: str) -> str:
    """True where a present, non-null value has the wrong JSON type for its field."""
    if kind == "object":
        fits = is_object(value)
    else:
        fits = f"schema_of_variant({value}) = '{_JSON_TYPE[kind]}'"
    return f"({has_value(value)} AND NOT {fits})"


def typed_field(value: str, kind: str) -> str:
    """The value in its SQL type.

    Required fields are never NULL: absent text is ``''`` and an absent integer ``0``. An absent object is
    the JSON literal ``null``, not SQL NULL; ``{}`` stays ``{}``.
    """
    typed = value if kind == "object" else f"try_variant_get({value}, '$', '{_SQL_TYPE[kind]}')"
    return f"coalesce({typed}, {_ZERO[kind]})" if kind in _ZERO else typed


def pick_event_fields(fields: str) -> str:
    """Struct of the raw values of all known event keys; unknown keys are ignored."""
    return _struct([(key, f"try_element_at({fields}, '{key}')") for key, _, _ in EVENT_FIELDS])


def event_has_wrong_type(raw: str) -> str:
    return "(" + " OR ".join(wrong_type(f"{raw}.{key}", kind) for key, _, kind in EVENT_FIELDS) + ")"


def typed_event(raw: str) -> str:
    """Stored column names and defaults for one event's raw values."""
    return _struct([(column, typed_field(f"{raw}.{key}", kind)) for key, column, kind in EVENT_FIELDS])


def _struct(fields: list[tuple[str, str]]) -> str:
    return "named_struct(" + ", ".join(f"'{name}', {value}" for name, value in fields) + ")"
