import base64
import hashlib
import random
import re

import pytest
from samples import prose

from batchloom.llm import secrets as S

_KEY = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
KINDS = {
    "assign": (rf"""(?:{_KEY})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[1]) >= 12),
    "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18),
    "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 16),
}


def brute(text):
    found = []
    for rank, (kind, (pattern, keep)) in enumerate(KINDS.items()):
        found += [(m.start(), rank, kind, m.end()) for m in re.finditer(pattern, text or "") if keep(m)]
    return [(kind, a, b) for a, _, kind, b in sorted(found)]


def random_texts():
    draw = random.Random(6)
    parts = [" ", "\n", "é", "😀", "password", "PassWD", "token", "secret", "api_key", "APIKEY", '"', "'", " : ", "=", "abcdefghijkl",
             "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "beef", "x.y/z+", "Token=", "short", prose(9, 3), "--", "\x00"]
    return ["".join(draw.choice(parts) for _ in range(draw.randint(0, 40))) for _ in range(300)]


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.createDataFrame([(i, prose(i) + f" anotherLongIdentifier_{i % 9} quiteCommonFunctionName") for i in range(60)], "doc_id int, text string")
    return S.train(S.labelled_samples(docs, "doc_id", "text"))


def test_base_spans(spark, docs_of, model):
    texts = [*random_texts(), None, "", " ".join(["0123456789abcdef0"] * 700), "password" * 3000]
    docs = docs_of([(i, t, "en", "a", 1) for i, t in enumerate(texts)])
    name = [c for c in S.scan(docs, model).columns if c not in docs.columns]
    assert name == ["secrets_"]
    for row in S.scan(docs, model).select("doc_id", "secrets_").collect():
        spans = [(s.kind, s.start, s.end) for s in row["secrets_"]]
        assert [s for s in spans if s[0] != "markov"] == brute(texts[row.doc_id])
        assert spans == sorted(spans, key=lambda s: (s[1], S.KINDS.index(s[0])))


def test_models_tell_random_strings_from_identifiers(spark, docs_of, model):
    draw = random.Random(8)
    keys = [base64.b64encode(draw.randbytes(24)).decode() for _ in range(100)]
    names = ["getElementByIdentifier", "anotherLongIdentifier_3", "quiteCommonFunctionNames", "commonLongFunctionName"] * 25
    docs = docs_of([(i, f"see {t} there", "en", "a", 1) for i, t in enumerate(keys + names)])
    found = {r.doc_id: r["secrets_"] for r in S.scan(docs, model).select("doc_id", "secrets_").collect()}
    hits = [any(s.kind == "markov" and s.start == 4 for s in found[i]) for i in range(200)]
    assert sum(hits[:100]) >= 90 and sum(hits[100:]) == 0


def test_no_python_in_the_plan(spark, docs_of, model):
    plan = S.scan(docs_of([]), model)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_digest(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for r in S.op7_markov_secrets(spark, folder).collect():
        spans = brute(texts[r.doc_id])
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s[0] == k for s in spans) for k in KINDS]


def test_models_count_every_document(spark):
    rows = [(i, f"identifier_{i} AKIAABCDEFGH{i:08d}") for i in range(2100)]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    found = S.labelled_samples(docs, "doc_id", "text")
    assert found.filter("token LIKE 'identifier\\_%' AND label = 0").count() == 2100
    assert found.filter("token LIKE 'AKIAABCDEFGH%' AND label = 1").count() == 2100
