"""Every stage against a brute-force version, each on its own input."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from mlwatch.llm import mixing, quality, secret_scan
from mlwatch.llm.rows import held_out, table
from tests.llm.test_reworded import plain_firsts
from tests.llm.test_simhash import plain_components, plain_fingerprint

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Input and output of each stage, as lists of rows."""
    docs, out = table(spark, SF, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, SF).write.parquet(path)
        after = spark.read.parquet(path)
        out[name] = (docs.collect(), after.collect(), after.columns)
        docs = after
    return out


def test_all_but_the_last_keep_the_columns(stages):
    assert all(stages[n][2] == ["doc_id", "text", "lang", "source", "n_chars"] for n in list(stages)[:-1])


def test_quality_keeps_what_the_classifier_accepts(spark, stages):
    before, after, _ = stages["quality"]
    scorer, _ = quality.fit(table(spark, SF, "documents").filter(~held_out()), quality.trusted_ids(table(spark, SF, "labels")))
    classes = quality.character_classes()
    good = {r.doc_id for r in before if scorer.probability(quality.features(r.text, classes)[None, :])[0] >= 0.5}
    assert {r.doc_id for r in after} == good
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    lost = [i for i, q in labels.items() if q == 1 and i not in good]
    assert len(lost) <= 0.05 * sum(labels.values())  # learned from some forty positives here
    assert len([i for i, q in labels.items() if q == 0 and i in good]) <= 0.15 * (len(labels) - sum(labels.values()))


def test_one_of_each_near_duplicate_group_stays(stages):
    before, after, _ = stages["near_duplicates"]
    prints = [plain_fingerprint(r.text) for r in before]
    firsts = set(plain_components([r.doc_id for r in before], prints))
    left = sorted((r for r in before if r.doc_id in firsts), key=lambda r: r.doc_id)
    kept = [left[i].doc_id for i in plain_firsts([r.text for r in left])]
    assert sorted(r.doc_id for r in after) == kept


def test_stages_are_those_of_the_contract():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "secrets", "mixing", "tokens"]


def test_secrets_give_way(stages):
    before, after, _ = stages["secrets"]
    texts = {r.doc_id: r.text for r in before}
    assert sorted(texts) == sorted(r.doc_id for r in after)
    for r in after:
        assert r.text == secret_scan.redacted_text(texts[r.doc_id], secret_scan.spans_of(texts[r.doc_id]))
        assert not secret_scan.base_spans(r.text)


def test_mixing_keeps_every_row(stages):
    before, after, _ = stages["mixing"]
    assert sorted(map(tuple, before)) == sorted(map(tuple, after))


def test_tokens_are_of_the_whole_text(stages):
    import base64

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    before, after, _ = stages["tokens"]
    texts = {r.doc_id: r.text for r in before}
    for r in after:
        ids = np.array(encoding.encode_ordinary(texts.pop(r.doc_id)), "<u4").tobytes()
        assert hashlib.sha256(r.ids).digest() == hashlib.sha256(ids).digest() and r.n_tokens == len(ids) // 4
    assert not texts


def test_places_of_the_tokens_follow_the_schedule(spark, stages):
    before, after, _ = stages["tokens"]
    due = mixing.mix(spark.createDataFrame([(r.doc_id, r.source) for r in stages["mixing"][0]], "doc_id long, source string"))
    schedule = [r.doc_id for r in due.orderBy("__position").collect()]
    assert [r.doc_id for r in sorted(after, key=lambda r: r.place)] == schedule
    assert len({r.place for r in after}) == len(after)


def test_places_outlast_packed_and_split_files(spark, tmp_path):
    rows = [(i, "word " * (i % 90 * 40), f"s{i % 5}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    schedule = [r.doc_id for r in mixing.mix(docs).orderBy("__position").collect()]
    mixing.in_mixed_order(docs).write.option("maxRecordsPerFile", 200).parquet(str(tmp_path / "mixed"))
    out = corpus_pipeline.tokens(spark, spark.read.parquet(str(tmp_path / "mixed")), "").collect()
    assert [r.doc_id for r in sorted(out, key=lambda r: r.place)] == schedule


def test_tokens_decode_to_the_text(spark, stages, tmp_path, monkeypatch):
    assert all(r.whole for r in stages["tokens"][1])
    spark.createDataFrame([(1, "é 日本 text"), (2, ""), (3, None)], "doc_id long, text string").write.parquet(str(tmp_path / "t"))
    docs = spark.read.parquet(str(tmp_path / "t"))
    assert all(r.whole for r in corpus_pipeline.tokens(spark, docs, "").collect())
    encode = corpus_pipeline.bpe.encode
    cut = lambda docs, **kw: encode(docs, **kw).withColumn("decoded", F.expr("substr(decoded, 2)"))
    monkeypatch.setattr(corpus_pipeline.bpe, "encode", cut)
    assert {r.doc_id: r.whole for r in corpus_pipeline.tokens(spark, docs, "").collect()} == {1: False, 2: True, 3: True}
