import itertools
import random
import re

import numpy as np
import pytest
import xxhash
from samples import prose
from hypothesis import given, settings
from hypothesis import strategies as st

from batchloom.llm import simhash as S


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(texts, radius=4):
    prints, parent = {d: brute_print(t) for d, t in texts.items()}, {d: d for d in texts}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a, b in itertools.combinations(sorted(texts), 2):
        if (prints[a] ^ prints[b]).bit_count() <= radius:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {d: root(d) for d in texts}


@given(st.text(alphabet="aA éÉ\n\t\x1c\xa0", max_size=60))
def test_fingerprint(text):
    assert S.simhash(text) % (1 << 64) == brute_print(text)


def test_masks_find_every_pair():
    draw = random.Random(1)
    for parts in range(5, 10):
        masks = S.agreement_masks(4, parts)
        for _ in range(200):
            x = sum(1 << b for b in draw.sample(range(64), 4))
            assert any(x & m == 0 for m in masks)


@pytest.mark.parametrize("tile", [4096, 8])
def test_edges_connect_as_all_pairs(spark, tile):
    draw = random.Random(3)
    values = [draw.getrandbits(64) for _ in range(40)] + [0]
    for v in values[:20]:
        for _ in range(12):
            for b in draw.sample(range(64), draw.randint(1, 3)):
                v ^= 1 << b
            values.append(v)
    values = sorted(set(values))
    parent = list(range(len(values)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(values)), 2):
        if (values[i] ^ values[j]).bit_count() <= 4:
            parent[max(root(i), root(j))] = min(root(i), root(j))
    rows = spark.createDataFrame([(i, S._signed(v)) for i, v in enumerate(values)], "id long, fp long")
    found = {r.id: r.component_id for r in S.simhash_groups(rows, "id", tile=tile).collect()}
    assert found == {i: root(i) for i in range(len(values))}


def test_query_against_all_pairs(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = S.op3_simhash(spark, folder).collect()
    assert {r.doc_id: r.component_id for r in rows} == brute_components(texts)
    assert all(r.fingerprint == f"{brute_print(texts[r.doc_id]):016x}" for r in rows)


def test_one_row_of_each_group_stays(spark, docs_of):
    texts = [prose(1), prose(1), prose(2), None, "", prose(2)]
    ids = [5, 3, 7, 9, 8, None]
    kept = S.keep_first(docs_of([(i, t, "en", "a", 1) for i, t in zip(ids, texts)]), order=("doc_id",))
    assert sorted(r.doc_id for r in kept.collect()) == [3, 7, 8]


def test_blocks_beyond_the_radius_are_skipped():
    points = np.array([0, 1, (1 << 40) - 1, (1 << 41) - 1], np.uint64)
    a, b = S.compare_tiles(points, None, 0, np.empty(0, np.uint64), 4)
    assert {frozenset(x) for x in zip(a.tolist(), b.tolist())} == {frozenset((0, 1)), frozenset(((1 << 40) - 1, (1 << 41) - 1))}


@settings(max_examples=30)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_labels(pairs):
    i, j = (np.array(x, np.int64) for x in (zip(*pairs) if pairs else ((), ())))
    labels = S._labels(31, i, j)
    assert all(labels[a] == labels[b] for a, b in pairs)
    assert all(labels[labels[k]] == labels[k] <= k for k in range(31))
