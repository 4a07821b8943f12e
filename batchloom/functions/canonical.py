"""Canonical batch text and its hash: equal contents give equal hashes however they were spelled."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from batchloom.functions.fields import JSON_NULL, JSON_PARTS
from batchloom.schemas import EVENT_FIELDS

# Left out of the text when empty; every other key is always written.
_OMITTED = {"id": "nullif(e.event_id, '')", "received_at": "nullif(e.received_at_ms, 0L)"}


def _canonical_value(key: str, column: str, kind: str) -> str:
    if key in _OMITTED:
        return _OMITTED[key]
    if kind == "nullable text":
        # Written as null when absent, where a plain NULL field would be left out.
        return f"coalesce(CAST(e.{column} AS variant), {JSON_NULL})"
    return f"e.{column}"


def _numbers_by_value(text: str) -> str:
    """One spelling per number: whole numbers without point or exponent, all others as 64-bit floats.

    Whole numbers of the 64-bit range stay exact. Strings are left as they are.
    """
    value = "CAST(n AS double)"
    whole = f"{value} = floor({value}) AND abs({value}) < 9.2e18"
    one = f"CASE WHEN n RLIKE '^-?[0-9]{{1,18}}$' THEN n WHEN n RLIKE '^-?[0-9]+$' AND try_cast(n AS bigint) IS NOT NULL THEN n"
    one += f" WHEN {whole} THEN CAST(CAST({value} AS bigint) AS string) ELSE CAST({value} AS string) END"
    pieces = f"regexp_extract_all(p, '-?[0-9][-+.eE0-9]*+|[^-0-9]++|-', 0)"
    spelled = f"array_join(transform({pieces}, n -> CASE WHEN n RLIKE '^-?[0-9]' THEN {one} ELSE n END), '')"
    parts = f"regexp_extract_all(t, '{JSON_PARTS}', 0)"
    joined = f"array_join(transform({parts}, p -> CASE WHEN startswith(p, '\"') THEN p ELSE {spelled} END), '')"
    odd = "(t RLIKE '[0-9][.eE]' OR t RLIKE '[0-9]{19}')"
    # ``transform`` over one element names the text, so that it is not worked out again at each use.
    return f"transform(array({text}), t -> CASE WHEN {odd} THEN {joined} ELSE t END)[0]"


_EVENT = "named_struct(" + ", ".join(f"'{key}', {_canonical_value(key, column, kind)}" for key, column, kind in EVENT_FIELDS) + ")"


def canonical_batch_json(batch_id: str, events: str) -> Column:
    """Text of a batch: fixed field order, object keys sorted at every depth, array order kept, numbers by value."""
    text = f"to_json(named_struct('batch_id', {batch_id}, 'events', transform({events}, e -> {_EVENT})))"
    return F.expr(_numbers_by_value(text))


def event_digests(events: str) -> Column:
    """A digest of each event's part of the canonical text, in order: equal where the hash of the batch would be."""
    return F.expr(f"transform({events}, e -> xxhash64({_numbers_by_value(f'to_json({_EVENT})')}))")


def payload_hash(canonical_text: Column) -> Column:
    return F.sha2(canonical_text, 256)
