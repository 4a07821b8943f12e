"""Containment postings: which parts of the stored events may hold a document that contains a pattern.

A document is taken apart into terms: a hash of each path with the value there, or with the kind of a container. Array
elements share the path of their array, and numbers of equal value share a hash. Everything a pattern asks for is a
term that a containing document must have, so the parts that have all terms of a pattern hold all its matches. They may
hold others too, because terms of one part may come from several documents; the pattern itself is checked afterwards.

Paths are followed ``DEPTH`` levels down. What lies deeper has no terms and narrows nothing, and is still checked.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchloom.functions.fields import as_array, as_object

DEPTH = 4
#: A part: where an event lies, as columns of the stored events.
PART = ["stream", "epoch", "event_day", "part"]
#: Terms of one pattern that are looked up; more would narrow little.
MOST_TERMS = 16
#: Runs of parts named in a filter; beyond that, neighbours are joined.
MOST_RUNS = 32

_NUMBER, _TEXT, _TRUTH, _NULL, _OBJECT, _ARRAY = "n", "s", "b", "z", "o", "a"


def _hash(path: str, kind: str, value: str = "0") -> str:
    return f"xxhash64({path}, '{kind}', {value})"


def _term(path: str, v: str) -> str:
    """Hash of one node; NULL for kinds that JSON does not have."""
    kind = f"schema_of_variant({v})"
    number = f"try_variant_get({v}, '$', 'double') + 0.0D"  # 0.0 and -0.0 are equal numbers
    return f"""
        CASE WHEN is_variant_null({v}) THEN {_hash(path, _NULL)}
             WHEN {kind} = 'STRING' THEN {_hash(path, _TEXT, f"try_variant_get({v}, '$', 'string')")}
             WHEN {kind} = 'BOOLEAN' THEN {_hash(path, _TRUTH, f"try_variant_get({v}, '$', 'boolean')")}
             WHEN {kind} IN ('BIGINT', 'DOUBLE') OR {kind} LIKE 'DECIMAL%' THEN {_hash(path, _NUMBER, number)}
             WHEN {kind} LIKE 'ARRAY%' THEN {_hash(path, _ARRAY)}
             WHEN {kind} LIKE 'OBJECT%' OR {kind} LIKE 'STRUCT%' THEN {_hash(path, _OBJECT)} END
    """


_NO_NODES = "CAST(array() AS array<struct<p:string,v:variant>>)"


def _children(node: str) -> str:
    """Nodes one level below a node ``struct(p, v)``. A key is spelled with its length, so that no two paths are equal."""
    pairs = f"map_entries({as_object(f'{node}.v')})"
    keyed = f"concat({node}.p, '.', length(e.key), ':', e.key)"
    inside = f"coalesce(transform({pairs}, e -> named_struct('p', {keyed}, 'v', e.value)), {_NO_NODES})"
    listed = f"transform({as_array(f'{node}.v')}, x -> named_struct('p', concat({node}.p, '[]'), 'v', x))"
    return f"concat({inside}, coalesce({listed}, {_NO_NODES}))"


def document_terms(document: str, depth: int = DEPTH) -> Column:
    """Distinct terms of a variant, as an array; of SQL NULL none."""
    level = f"array(named_struct('p', '', 'v', {document}))"
    levels = [level]
    for _ in range(depth):
        level = f"flatten(transform({level}, n -> {_children('n')}))"
        levels.append(level)
    terms = f"array_compact(transform(concat({', '.join(levels)}), n -> {_term('n.p', 'n.v')}))"
    return F.expr(f"CASE WHEN {document} IS NOT NULL THEN array_distinct({terms}) END")


def _literal_term(path: str, kind: str, value: Column | None = None) -> Column:
    return F.xxhash64(F.lit(path), F.lit(kind), F.lit(0) if value is None else value)


def pattern_terms(pattern, depth: int = DEPTH) -> list[Column]:
    """Terms that every document containing ``pattern`` has, as constant columns.

    A bare scalar has none: it may be the document or an element of it.
    """
    return _wanted("", pattern, depth) if isinstance(pattern, (dict, list)) else []


def _wanted(path: str, pattern, depth: int) -> list[Column]:
    if isinstance(pattern, dict):
        found = [_literal_term(path, _OBJECT)]
        below = [(f"{path}.{len(key)}:{key}", value) for key, value in pattern.items()]
    elif isinstance(pattern, list):
        found = [_literal_term(path, _ARRAY)]
        below = [(f"{path}[]", value) for value in pattern]
    else:
        return [_scalar_term(path, pattern)]
    if depth:
        leaves = [term for where, value in below for term in _wanted(where, value, depth - 1)]
        found = leaves + found if leaves else found
    return found


def _scalar_term(path: str, scalar) -> Column:
    if scalar is None:
        return _literal_term(path, _NULL)
    if isinstance(scalar, bool):
        return _literal_term(path, _TRUTH, F.lit(scalar))
    if isinstance(scalar, str):
        return _literal_term(path, _TEXT, F.lit(scalar))
    return _literal_term(path, _NUMBER, F.lit(float(scalar) + 0.0))


def postings(events: DataFrame, document: str = "properties") -> DataFrame:
    """``(term, stream, epoch, event_day, part)``, one row per term of a part.

    Rows of a part are read by one task, so equal terms are put together before they are shuffled.
    """
    terms = events.select(*PART, F.explode(document_terms(document)).alias("term"))
    return terms.distinct()


def matching_parts(index: DataFrame, pattern) -> DataFrame | None:
    """Parts that have all terms of a pattern; ``None`` where a pattern has no terms."""
    terms = pattern_terms(pattern)[:MOST_TERMS]
    if not terms:
        return None
    asked = reduce(lambda a, b: a | b, [F.col("term") == t for t in terms])
    number = F.array_distinct(F.array(*terms))
    rows = index.filter(asked).groupBy(*PART).agg(F.count_distinct("term").alias("n"))
    return rows.filter(F.col("n") == F.size(number)).select(*PART)


def in_parts(parts: list) -> Column:
    """Predicate over stored events for listed parts: folders by name, and row groups by runs of part numbers."""
    if not parts:
        return F.lit(False)
    folders = {}
    for row in parts:
        folders.setdefault((row.stream, row.epoch), set()).add(row.event_day)
    named = [
        (F.col("stream") == stream) & (F.col("epoch") == epoch) & F.col("event_day").isin(sorted(days))
        for (stream, epoch), days in folders.items()
    ]
    runs = [
        F.col("part").between(low, high) for low, high in merged_runs({row.part for row in parts})
    ]
    return reduce(lambda a, b: a | b, named) & reduce(lambda a, b: a | b, runs)


def merged_runs(numbers: set[int], most: int = MOST_RUNS) -> list[tuple[int, int]]:
    """Runs that cover ``numbers``: consecutive ones together, and over the smallest gaps where there are too many."""
    ordered = sorted(numbers)
    gaps = sorted(((b - a, i) for i, (a, b) in enumerate(zip(ordered, ordered[1:])) if b - a > 1), reverse=True)
    cuts = sorted(i for _, i in gaps[: most - 1])
    starts, ends = [0, *[i + 1 for i in cuts]], [*cuts, len(ordered) - 1]
    return [(ordered[a], ordered[b]) for a, b in zip(starts, ends)]
