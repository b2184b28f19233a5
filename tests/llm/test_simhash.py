import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from mlwatch.llm import simhash
from mlwatch.llm.components import connected_components

SCHEMA = "doc_id long, text string, fingerprint string, component_id long, fp int"


def plain_fingerprint(text):
    words = (text or "").translate({i: i + 32 for i in range(65, 91)})
    for blank in "\t\n\x0b\x0c\r":
        words = words.replace(blank, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, prints):
    prints = np.array(prints, np.uint64)
    near = [np.flatnonzero(np.bitwise_count(prints ^ p) <= 4) for p in prints]
    label = np.array([np.inf if i is None else i for i in ids], float)
    while True:
        after = np.array([label[n].min() for n in near])
        if (after == label).all():
            return [None if np.isinf(x) else int(x) for x in label]
        label = after


@pytest.mark.parametrize("text", [None, "", " \n", "One", "a b c", "A  b\tC d", "x " * 300, "ÄÖ é x y z w", "a b c d e f g" * 50])
def test_fingerprint_is_the_majority_of_hash_bits(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_long_texts_in_pieces(monkeypatch):
    text = " ".join(f"w{i * i % 97}" for i in range(1000))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "PIECE", 7)
    assert simhash.fingerprint(text) == whole == plain_fingerprint(text)


def test_every_pair_in_the_radius_shares_a_table():
    rng = np.random.default_rng(1)
    masks = np.array(simhash.covering_masks(), np.int64).view(np.uint64)
    for _ in range(3000):
        bits = rng.choice(64, rng.integers(0, 5), replace=False)
        apart = np.uint64(sum(1 << int(b) for b in bits))
        assert ((apart & masks) == 0).any()


@pytest.mark.parametrize("bucket", [4096, 2])
def test_groups_equal_brute_force(spark, sf, bucket):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    odd = [(1000, None), (1001, ""), (None, " "), (None, "no id at all here"), (1002, "short"), (1002, "short"), (None, texts[3][1])]
    rows = [(i, t, "x", 7, 1) for i, t in texts + odd]
    found = simhash.simhash_groups(spark.createDataFrame(rows, SCHEMA), bucket=bucket).collect()
    prints = [plain_fingerprint(t) for _, t, *_ in rows]
    expected = zip([r[0] for r in rows], [f"{p:016x}" for p in prints], plain_components([r[0] for r in rows], prints))
    order = lambda x: tuple(str(v) for v in x)
    assert sorted((tuple(r) for r in found), key=order) == sorted(expected, key=order)


def test_midpoints_link_a_dense_bucket(spark):
    rng = np.random.default_rng(2)
    centre = np.uint64(0x123456789ABCDEF0)
    values = {int((centre ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, 3, replace=False)))).view(np.int64)) for _ in range(60)}
    rows = spark.createDataFrame([(v,) for v in values], "fp long")
    both = [
        connected_components(simhash.close_links(rows, bucket=b)).agg({"component": "min", "node": "count"}).first()
        for b in (4096, 3)
    ]
    assert both[0] == both[1]


def test_one_row_of_each_group_stays(spark):
    long = " ".join(f"word{i}" for i in range(200))
    rows = [(5, long, "a", 1, 1), (2, long, "b", 1, 1), (9, "something else entirely, yes", "c", 1, 1), (9, "something else entirely, yes", "c", 1, 1),
            (None, long, "d", 1, 1), (None, long, "d", 1, 1)]
    kept = simhash.one_of_each_group(spark.createDataFrame(rows, SCHEMA))
    assert kept.columns == ["doc_id", "text", "fingerprint", "component_id", "fp"]
    assert sorted((r.doc_id or 0, r.fingerprint) for r in kept.collect()) == [(0, "d"), (2, "b"), (9, "c")]


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert simhash.simhash_groups(empty).count() == 0
    assert simhash.one_of_each_group(empty).count() == 0


def test_components_of_chains_loops_and_nulls(spark):
    chain = [(i, i + 1) for i in range(1, 40)] + [(100, 100), (None, 3), (7, None), (60, 50), (60, 50), (50, 70)]
    found = connected_components(spark.createDataFrame(chain, "a long, b long"))
    expected = {i: 1 for i in range(1, 41)} | {50: 50, 60: 50, 70: 50}
    assert {r.node: r.component for r in found.collect()} == expected and found.count() == len(expected)


def test_exploded_tables_are_not_broadcast(spark, monkeypatch):
    plans = []
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(simhash, "written", lambda df, label: plans.append(plan(df)) or df)
    few = spark.range(1000).select((F.col("id") * 7919).alias("fp"))
    simhash.close_links(few)
    plans.append(plan(simhash._links_by_midpoints(few, 4)))
    assert len(plans) == 2 and all("SortMergeJoin" in p and "Broadcast" not in p for p in plans)
