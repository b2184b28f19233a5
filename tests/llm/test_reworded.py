import numpy as np
import pytest

from mlwatch.llm import reworded


def plain_set(text, words=5):
    tokens = (text or "").lower().split()
    return {tuple(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))} if tokens else set()


def similarity(a, b):
    a, b = plain_set(a), plain_set(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def planted(copies, seed=5):
    """Texts of 400 words, each with copies of which a few words are changed."""
    rng, out = np.random.default_rng(seed), []
    for k in range(copies):
        words = [f"w{x}" for x in rng.integers(0, 5000, 400)]
        out.append(" ".join(words))
        for changes in (1, 4, 8, 20):
            other = list(words)
            for at in rng.choice(400, changes, replace=False):
                other[at] = f"new{rng.integers(1 << 30)}"
            out.append(" ".join(other))
    return out


def plain_firsts(texts):
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if similarity(texts[i], texts[j]) >= 0.8:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return sorted(set(root))


def test_copies_from_eight_tenths_go_and_others_stay(spark):
    texts = [*planted(12), "short text", "Short  TEXT", "", None, " \n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = sorted(r.doc_id for r in reworded.without_copies(docs).collect())
    assert found == plain_firsts(texts)
    assert len(found) < 12 * 5 - 12 * 2


def test_a_chain_of_copies_is_one_group_over_several_rounds(spark, monkeypatch):
    rng = np.random.default_rng(1)
    words = [f"w{x}" for x in range(300)]
    texts = []
    for _ in range(30):
        texts.append(" ".join(words))
        for at in rng.choice(300, 3, replace=False):
            words[at] = f"new{rng.integers(1 << 30)}"
    monkeypatch.setattr(reworded, "BLOCK", 4)
    docs = spark.createDataFrame([*enumerate(texts), (None, "no id"), (None, "no id")], "doc_id long, text string")
    kept = [r.doc_id for r in reworded.without_copies(docs).collect()]
    assert sorted(map(str, kept)) == sorted(["None", *map(str, plain_firsts(texts))]) and kept.count(None) == 1


@pytest.mark.parametrize("shared, expected", [(80, True), (79, False)])
def test_the_threshold_is_exact(shared, expected):
    a = np.arange(90, dtype=np.uint64)
    b = np.concatenate([a[:shared], np.arange(1000, 1010, dtype=np.uint64)])
    assert reworded.alike(a, b) is expected


def test_empty_table(spark):
    assert reworded.without_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_exploded_bands_are_not_broadcast(spark, monkeypatch):
    plans, kept = {}, reworded.written

    def noted(df, label):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return kept(df, label)

    monkeypatch.setattr(reworded, "written", noted)
    docs = spark.createDataFrame([(i, f"one two three four five {i // 2}") for i in range(6)], "doc_id long, text string")
    assert reworded.without_copies(docs).count() == 3
    assert "SortMergeJoin" in plans["reworded-buckets"] and "Broadcast" not in plans["reworded-buckets"]
