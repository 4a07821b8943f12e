import pytest
from pyspark.sql import functions as F

from batchloom.functions.contains import json_contains

CASES = [
    ('{"a":[1,2,3]}', {"a": [3, 1, 1]}, True),
    ('{"a":[1,2,3]}', {"a": [4]}, False),
    ('{"a":1}', {"a": 1.0}, True),
    ('{"a":1.0}', {"a": 1}, True),
    ('{"a":1e0}', {"a": 1}, True),
    ('{"a":"1"}', {"a": 1}, False),
    ('{"a":1}', {"a": "1"}, False),
    ('{"a":9007199254740993}', {"a": 9007199254740992}, False),
    ('{"a":1.00000000001}', {"a": 1}, False),
    ("null", {}, False),
    ("{}", {}, True),
    ("[]", {}, False),
    ('{"a":{"b":{"c":true}}}', {"a": {"b": {}}}, True),
    ('{"a":{"b":{"c":true}}}', {"a": {"b": {"c": True}}}, True),
    ('{"a":{"b":{"c":true}}}', {"a": {"b": {"c": 1}}}, False),
    ('{"a":null}', {"a": None}, True),
    ('{"b":null}', {"a": None}, False),
    ('{"a.b":1,"c d":2}', {"a.b": 1, "c d": 2}, True),
    ('{"it\'s":1}', {"it's": 1}, True),
    ('{"a]":1}', {"a]": 1}, True),
    ('[1,{"a":2,"b":3}]', [{"a": 2}], True),
    ("[[1,2],3]", [[1]], True),
    ("[[1,2],3]", [1], False),
    ("[1,2]", 1, True),
    ("[[1]]", 1, False),
    ('"x"', "x", True),
    ("[]", [], True),
    ("{}", [], False),
    ('{"a":%d}' % (10**37 + 1), {"a": 10**37 + 1}, True),
    ('{"a":%d}' % (10**37 + 1), {"a": 10**37 + 2}, False),
    ('{"a":%d}' % (10**40 + 12), {"a": 10**40 + 13}, True),  # the stored document does not hold these digits
    ('{"a":%d}' % (10**40 + 12), {"a": 2 * 10**40}, False),
]


@pytest.fixture(scope="module")
def results(spark):
    docs = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, text string")
    doc = F.parse_json("text")
    tests = [F.when(F.col("i") == i, json_contains(doc, c[1])) for i, c in enumerate(CASES)]
    return {r.i: r.found for r in docs.select("i", F.coalesce(*tests).alias("found")).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_contains(results, i):
    assert results[i] is CASES[i][2], CASES[i]
