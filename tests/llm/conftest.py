import pytest
from pyspark.sql import types as T
from samples import CLASH, EDGE_ROWS, LONG, prose


@pytest.fixture(scope="session")
def doc_schema():
    fields = [T.StructField("doc_id", T.LongType())]
    fields += [T.StructField(c, T.StringType()) for c in ("text", "lang", "source")] + [T.StructField("n_chars", T.LongType())]
    return T.StructType(fields + [T.StructField(c, T.StringType()) for c in CLASH])


@pytest.fixture(scope="session")
def docs_of(spark, doc_schema):
    def make(rows):
        return spark.createDataFrame([(*r, *CLASH) for r in rows], doc_schema)

    return make


def _write(spark, folder, docs, benchmark, labels, turns, vectors):
    docs.write.parquet(f"{folder}/documents.parquet")
    for name, rows, schema in (
        ("benchmark", benchmark, "item_id long, text string, n string"),
        ("labels", labels, "doc_id long, quality int, toxic int, text string"),
        ("conversations", turns, "conv_id long, turn long, role string, text string, size string"),
        ("embeddings", vectors, "vec_id long, embedding array<float>, label int, error string"),
    ):
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="session")
def edge_dir(spark, docs_of, tmp_path_factory):
    """Tables with nulls, empty and long texts, repeated rows and clashing names."""
    benchmark = [(1, " ".join(prose(2).split()[5:30]), "x"), (2, None, None), (3, "", "x"), (None, "zzz yyy", "x"), (1, "one", "x"), (4, "one", None)]
    labels = [(i, int(i % 3 > 0), int(i == 9), "x") for i in range(1, 11)] + [(None, 1, 1, "x"), (1, None, None, None), (2, 1, 0, "x")]
    turns = [
        (1, 0, "user", "hi", "s"), (1, 1, "assistant", None, "s"), (1, 1, None, "tie", "s"), (1, None, "assistant", "</s>\\", "s"),
        (None, 0, "user", "null id", None), (2, 0, "user", LONG, "s"), (2, 1, "assistant", LONG, "s"), (3, 0, "system", "", "s"),
        (1, 0, "user", "hi", "s"),
    ]
    vectors = [
        (0, [0.0] * 8, 1, "x"), (1, [-0.5, 0.25] * 4, None, "x"), (2, [1.0] * 8, 1, "x"), (2, [1.0] * 8, 1, "x"),
        (3, None, 1, "x"), (4, [0.0, None] * 4, 1, "x"), (5, [float("nan")] * 8, 2, "x"), (5, [float("-inf")] * 8, 2, "x"),
        (6, [0.0001] * 8, None, None), (7, [], 1, "x"), (None, [0.5] * 8, 2, "x"),
    ]
    vectors += [(i, [((i * 37 + j * 101) % 17 - 8) / 8 for j in range(8)], i % 3, None) for i in range(10, 300)]
    return _write(spark, tmp_path_factory.mktemp("edge"), docs_of(EDGE_ROWS), benchmark, labels, turns, vectors)


@pytest.fixture(scope="session")
def empty_dir(spark, docs_of, tmp_path_factory):
    return _write(spark, tmp_path_factory.mktemp("empty"), docs_of([]), [], [], [], [])
