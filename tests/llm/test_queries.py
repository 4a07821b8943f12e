"""Every query over empty tables, over awkward ones, and against its SQL."""

import pathlib
from collections import Counter

import corpus_pipeline
import duckdb
import pytest
from samples import EDGE_ROWS

import __spark_entry__ as entry_module
from batchloom.llm.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def _views(folder):
    connection = duckdb.connect()
    for path in pathlib.Path(folder).glob("*.parquet"):
        files = f"{path}/*.parquet" if path.is_dir() else path
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{files}')")
    return connection


def _same(frame, relation):
    columns = sorted(frame.columns)
    assert sorted(relation.columns) == columns
    found = Counter(map(tuple, frame.select(*columns).collect()))
    assert found == Counter(relation.project(", ".join(f'"{c}"' for c in columns)).fetchall())
    return found.total()


def test_one_query_per_operator():
    numbers = sorted(int(name[2:].split("_")[0]) for name in QUERIES)
    assert numbers == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(entry_module.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty_dir, name):
    rows = QUERIES[name](spark, empty_dir).collect()
    assert [r.conv_id for r in rows] == [-1] if name.startswith("op4_") else rows == []


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_awkward_tables(spark, edge_dir, name):
    rows = QUERIES[name](spark, edge_dir).collect()
    if name.startswith("op4_"):
        assert Counter(r.conv_id for r in rows) == Counter([-1, 1, 2, 3, None])
    elif name.startswith("op11_"):
        assert Counter(r.vec_id for r in rows) == Counter([0, 1, 2, 2, 6, None, *range(10, 300)])
    else:
        assert Counter(r.doc_id for r in rows) == Counter(r[0] for r in EDGE_ROWS)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    assert _same(QUERIES[name](spark, SF), _views(SF).sql(ORACLES[name])) > 1


@pytest.mark.parametrize("name", sorted(set(ORACLES) - {"op10_rule_cascade"}))
def test_sql_on_awkward_tables(spark, edge_dir, name):
    _same(QUERIES[name](spark, edge_dir), _views(edge_dir).sql(ORACLES[name]))


@pytest.mark.parametrize("which", ["edge_dir", "empty_dir"])
def test_stages_keep_the_columns(spark, which, request):
    folder = request.getfixturevalue(which)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == columns, name
        docs.write.parquet(f"{folder}/after-{name.replace(' ', '-')}-{which}")
        docs = spark.read.parquet(f"{folder}/after-{name.replace(' ', '-')}-{which}")
    last = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert last.count() == docs.count()


def test_pipeline_against_its_parts(spark):
    """The kept documents, worked out one stage at a time by plain Python."""
    import numpy as np
    from test_simhash import brute_components

    from batchloom.llm import decontaminate, quality
    from batchloom.llm.common import table

    docs = table(spark, SF, "documents")
    model = quality.train(docs, table(spark, SF, "labels"))
    texts = {r.doc_id: r for r in docs.collect()}
    content, meta = quality._features({c: [getattr(r, c) for r in texts.values()] for c in quality._COLUMNS})
    good = [d for d, s in zip(texts, model.score(content, meta)[0]) if s >= quality.THRESHOLD]
    roots = brute_components({d: texts[d].text for d in good})
    kept = [d for d in good if roots[d] == d]
    test = decontaminate.Fingerprints([(str(r.item_id), r.text) for r in table(spark, SF, "benchmark").collect()])
    kept = [d for d in kept if not test.find(texts[d].text)[1]]
    found = corpus_pipeline.run(spark, SF).orderBy("start").collect()
    ids = [r.doc_id for r in found]
    assert set(ids) <= set(kept) and ids == sorted(ids) and len(ids) > 50
    assert max(Counter(ids).values()) <= 3
    assert [r.start for r in found] == [0, *np.cumsum([r.n_tokens for r in found])[:-1].tolist()]
    words = Counter()
    for d in ids:
        words[texts[d].source] += len(texts[d].text.encode().split())
    size = Counter()
    for d in kept:
        size[texts[d].source] += len(texts[d].text.encode().split())
    # Every source is there, and none more than three times.
    assert all(0 < words[s] <= 3 * size[s] for s in size)
