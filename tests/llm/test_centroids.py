import hashlib
import math

import numpy as np
import pytest

from mlwatch.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, id string, x int, cluster int, distance int"


def some_rows(dimensions=6):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((7, dimensions))
    rows = [(i, [float(np.float32(v)) for v in base[i % 7] + rng.standard_normal(dimensions) * 0.2]) for i in range(150)]
    good = [1.0] * dimensions
    return rows + [
        (3, rows[3][1]), (500, rows[3][1]), (501, None), (502, []), (503, good[1:]), (504, [None, *good[1:]]),
        (505, [float("nan"), *good[1:]]), (506, [float("inf"), *good[1:]]), (None, good), (507, [0.0] * dimensions),
    ]


def plain(rows, k, rounds, dimensions):
    kept = [
        (i, tuple(math.floor(64 * c) for c in v))
        for i, v in rows
        if v is not None and len(v) == dimensions and all(c is not None and math.isfinite(c) for c in v)
    ]
    digest = lambda i: hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    centres = [v for _, v in sorted((digest(i), v) for i, v in kept)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centres))
    for _ in range(rounds):
        found = [near(v)[1] for _, v in kept]
        for c in range(len(centres)):
            members = [v for (_, v), m in zip(kept, found) if m == c]
            if members:
                centres[c] = tuple(sum(column) // len(members) for column in zip(*members))
    last = [near(v) for _, v in kept]
    per = {c: sum(d for d, m in last if m == c) for c in range(len(centres))}
    return [(i, c, d, per[c], sum(per.values())) for (i, _), (d, c) in zip(kept, last)]


def by_id(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: (r[0] is None, r))


@pytest.mark.parametrize("k, width", [(5, 2), (5, 4), (1, 6), (400, 2)])
def test_clusters_equal_brute_force(spark, k, width):
    rows = some_rows()
    df = spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], SCHEMA).repartition(3)
    found, _ = centroids.clustered(df, k=k, rounds=3, dimensions=6, width=width)
    assert by_id(found.collect()) == by_id(plain(rows, k, 3, 6))


def test_shards_lose_nothing(spark, monkeypatch):
    df = spark.createDataFrame([(*r, "x", 1, 2, 3) for r in some_rows()], SCHEMA)
    vectors = centroids.whole_vectors(df, "vec_id", "embedding", 6, 64)
    encoded = centroids.shards(vectors, 6, 4)
    back = []
    for batch in encoded.toArrow().to_batches():
        for ids, blocks in centroids.unpacked(batch, 4, 6):
            whole = np.concatenate([entries[codes] for entries, codes in blocks], axis=1)
            back += list(zip(ids.to_pylist(), map(tuple, whole.tolist())))
            assert all(len(np.unique(entries, axis=0)) == len(entries) for entries, _ in blocks)
    assert by_id(back) == by_id((r.id, tuple(r.x)) for r in vectors.collect())


def test_dictionaries_of_wide_values():
    block = np.array([[1 << 26, -(1 << 26), 5], [0, 0, 0], [1 << 26, -(1 << 26), 5], [-(1 << 26), 1 << 26, 0]], np.int32)
    found, codes = centroids.dictionary(block)
    assert (found[codes] == block).all() and len(found) == 3


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    found, centres = centroids.clustered(empty)
    assert found.count() == 0 and len(centres) == 0
    assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia"]
