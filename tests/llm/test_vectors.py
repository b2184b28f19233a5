import math

import numpy as np
import pytest

from mlwatch.llm import neighbours, vector_dedup

SCHEMA = "vec_id long, embedding array<float>, label int, id string, n_links int, v int"


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)


def some_vectors():
    rng = np.random.default_rng(3)
    rows = []
    for label in (1, 2):
        base = rng.standard_normal((6, 16))
        for i in range(60):
            v = base[i % 6] + rng.standard_normal(16) * (0.02 if i % 2 else 0.6)
            rows.append((len(rows), [float(np.float32(x)) for x in v], label))
    rows += [(200, rows[0][1], 1), (201, rows[0][1], 1), (202, rows[0][1], 2), (203, rows[0][1], None), (204, None, 1),
             (205, [0.0] * 16, 1), (206, [float("nan")] * 16, 1), (207, [None] + [1.0] * 15, 1), (208, [float("inf")] * 16, 1),
             (209, [], 1), (210, [2 * x for x in rows[0][1]], 1), (211, rows[0][1][:8], 1), (None, rows[0][1], 1)]
    return rows


def plain(rows):
    ids = [r[0] for r in rows]
    good = [usable(v) and label is not None and i is not None for i, v, label in rows]
    link = lambda a, b: (
        good[a] and good[b] and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1])
        and np.dot(rows[a][1], rows[b][1]) / math.sqrt(np.dot(rows[a][1], rows[a][1]) * np.dot(rows[b][1], rows[b][1])) >= 0.98
    )
    near = [[b for b in range(len(rows)) if b != a and link(a, b)] for a in range(len(rows))]
    label = list(ids)
    for _ in rows:
        label = [min([label[a], *(label[b] for b in near[a])]) if near[a] else label[a] for a in range(len(rows))]
    return sorted(
        ((i, len(n), c, i is None or i == c) for i, n, c in zip(ids, near, label)), key=lambda x: (x[0] is None, x[0] or 0)
    )


@pytest.mark.parametrize("block", [1024, 5])
def test_links_and_groups_equal_brute_force(spark, block):
    rows = some_vectors()
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)
    found = vector_dedup.near_vectors(df, block=block).collect()
    assert sorted((tuple(r) for r in found), key=lambda x: (x[0] is None, x[0] or 0)) == plain(rows)


def test_tables_follow_the_wanted_recall():
    for rows in (10, 10_000, 10**9):
        bits, tables = vector_dedup.tables_for(rows)
        meet = (1 - math.acos(0.98) / math.pi) ** bits
        assert (1 - meet) ** tables <= 1e-6


def test_nearest_equal_brute_force_where_shards_are_small(spark):
    rows = [(i, v, label) for i, v, label in some_vectors()]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)
    index = neighbours.build_index(df, shard_rows=40)
    queries = df.filter("vec_id % 3 = 0")
    found = neighbours.nearest(index, queries, k=7, block=16).collect()
    good = [(i, np.array(v, float)) for i, v, _ in rows if usable(v) and i is not None]
    expected = []
    for q, v in good:
        if q % 3 == 0:
            scores = sorted((-float((x * v).sum()), i) for i, x in good if i != q and len(x) == len(v))
            expected += [(q, k + 1, i, pytest.approx(-s)) for k, (s, i) in enumerate(scores[:7])]
    assert sorted(tuple(r) for r in found) == expected


def test_recall_over_vectors_of_many_lengths(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((1500, 32)) * rng.uniform(0.5, 2, (1500, 1))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(base)], "vec_id long, embedding array<double>")
    found = neighbours.nearest(neighbours.build_index(df, shard_rows=500), df.filter("vec_id % 20 = 0")).collect()
    hits = 0
    for q in range(0, 1500, 20):
        best = [i for i in np.argsort(-(base @ base[q]), kind="stable") if i != q][:20]
        hits += len({*best} & {r.vec_id for r in found if r.query_id == q})
    assert hits >= 0.95 * 75 * 20 and len(found) == 75 * 20


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert vector_dedup.near_vectors(empty).count() == 0
    assert neighbours.nearest(neighbours.build_index(empty), empty).count() == 0
