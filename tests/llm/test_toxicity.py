import random
import zlib
from collections import Counter

import numpy as np
import pytest

from mlwatch.llm import toxicity
from mlwatch.llm.rows import table

IS_WORD = toxicity.word_characters()
SCHEMA = "doc_id long, text string, score int, predicted string"


def plain_grams(text):
    words = "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()
    return sorted(f" {w} "[i : i + n] for w in words for n in range(3, 7) for i in range(len(w) + 3 - n))


@pytest.mark.parametrize("piece", [1 << 18, 7, 1])
def test_grams_are_those_of_the_words(piece, monkeypatch):
    monkeypatch.setattr(toxicity, "PIECE", piece)
    for text in (None, "", " ", "a", "Ab c", "  ein--Wörtchen,\n\nnoch EINES 12345678 x", "ß" * 20, "a" * 30 + " \t" * 9 + "bc"):
        found = np.concatenate([np.array([], np.int32), *toxicity.grams(text, IS_WORD)])
        # equal n-grams have one number, different ones different numbers
        assert sorted(Counter(found.tolist()).values()) == sorted(Counter(plain_grams(text)).values())


def test_pieces_change_no_gram(monkeypatch):
    text = "Some words, of ümläuts and 12345 digits;" * 40 + "x" * 500 + "   end"
    whole = np.sort(np.concatenate(list(toxicity.grams(text, IS_WORD))))
    for piece in (1, 5, 6, 64, 1000):
        monkeypatch.setattr(toxicity, "PIECE", piece)
        assert (np.sort(np.concatenate(list(toxicity.grams(text, IS_WORD)))) == whole).all()


def texts(rng, marks, n):
    words = ["".join(rng.choice("aeioubdfgklmnrst") for _ in range(rng.randint(3, 8))) for _ in range(300)]
    out = []
    for i in range(n):
        body = [rng.choice(words) for _ in range(60)]
        if i % 3 == 0:
            for mark in rng.sample(marks, 2):
                body.insert(rng.randrange(60), mark)
        out.append((i, " ".join(body), int(i % 3 == 0)))
    return out


def test_unseen_misspellings_share_vectors(spark):
    rng = random.Random(1)
    rows = texts(rng, ["vexquizzle", "zyppwhomp", "jaxxwyvern"], 900)
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t, _ in rows], SCHEMA)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs.filter("doc_id >= 150"), labels)
    unseen = texts(random.Random(1), ["vexquizle", "zyppwhompp", "jaxwyvern", "vexquizzled"], 150)
    known = [toxicity.probability(t, IS_WORD, *model) >= 0.5 for _, t, _ in rows[:150]]
    found = [toxicity.probability(t, IS_WORD, *model) >= 0.5 for _, t, _ in unseen]
    assert np.mean([k == bool(r[2]) for k, r in zip(known, rows)]) >= 0.97
    assert np.mean([k == bool(r[2]) for k, r in zip(found, unseen)]) >= 0.9


def test_scores_of_odd_rows(spark):
    rows = [(i, t) for i, t, _ in texts(random.Random(2), ["vexquizzle", "zyppwhomp"], 200)]
    long = "calm words here " * 100_000
    odd = [(900, None), (901, ""), (902, " \n"), (903, "..."), (904, long), (904, long), (None, "fine")]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows + odd], SCHEMA)
    labels = spark.createDataFrame(
        [(i, int(i % 3 == 0)) for i, _ in rows] + [(0, 0), (1, None), (None, 1), (7777, 1)], "doc_id long, toxic int"
    )
    found = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert len(found) == len(rows) + len(odd)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found)
    assert len({r.score for r in found if r.doc_id in (900, 901, 902, 903)}) == 1
    again = toxicity.score(docs.repartition(3), toxicity.fit(docs.repartition(5), labels)).collect()
    order = lambda rows: sorted((r.doc_id is None, r.doc_id or 0, r.score) for r in rows)
    assert order(again) == order(found)


def test_tables_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "text", 1, "x"), (2, None, 1, "x")], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score(docs, toxicity.fit(docs, none)).collect()} == {0.5}
    one = spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int")
    assert {r.predicted for r in toxicity.score(docs, toxicity.fit(docs, one)).collect()} == {0}
    empty = spark.createDataFrame([], SCHEMA)
    assert toxicity.score(empty, toxicity.fit(empty, none)).count() == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    found = {r.doc_id: r for r in toxicity.op11_toxicity(spark, sf).collect()}
    assert len(found) == table(spark, sf, "documents").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in found.items())
    marked = [(found[r.doc_id].predicted, r.toxic) for r in table(spark, sf, "labels").collect() if found[r.doc_id].held_out]
    assert np.mean([p == t for p, t in marked]) >= 0.94
    assert np.mean([p for p, t in marked if t]) >= 0.75 and np.mean([p for p, t in marked if not t]) <= 0.04
