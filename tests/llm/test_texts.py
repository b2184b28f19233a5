import base64
import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from mlwatch.llm import bpe, language, quality, secret_scan
from mlwatch.llm.rows import held_out, table

ODD = [
    None, "", " ", "\n\n  \n", "a", "The cat's 12 hats,  don't!", "naïve café — 東京タワー 🙂👩‍👩‍👧", "\x00\x1c\x1d \xa0x　y",
    "<|endoftext|> is text", "=" * 300, "a" * 1000, " " * 500 + "x", "٣٤ ½ Ⅷ", "́á", "x" * 30 + "é" * 30, "ſtoken K",
]


@pytest.fixture(scope="module")
def encoding():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_are_those_of_the_rank_file(encoding):
    rng, pieces = random.Random(4), bpe.Vocabulary(public_tokenizers.path(bpe.VOCABULARY)).encoder()
    texts = [t or "" for t in ODD]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xA0, 0x2FF), rng.randrange(0x3000, 0xD7FF), 0x1F600 + rng.randrange(80)])) for _ in range(60)) for _ in range(300)]
    texts += ["".join(rng.choice(" =-_a\n.é") for _ in range(80)) for _ in range(300)]
    for text in texts:
        packed = pieces.encode(text)
        assert np.frombuffer(packed, "<u4").tolist() == encoding.encode_ordinary(text), repr(text)
        assert pieces.decode(packed) == text.encode()


def test_encode_and_decode_tables(spark, encoding, monkeypatch):
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(0, None, "again"), (None, "no id", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    tokens = bpe.encode(docs, offsets=True, decoded=True).collect()
    assert len(tokens) == len(rows)
    for row, (_, text, _) in zip(tokens, rows):
        text, ids = text or "", np.frombuffer(row.ids, "<u4").tolist()
        assert row.n_tokens == len(ids) and bytes(row.decoded) == text.encode()
        for i, start, end in zip(ids, row.starts, row.ends):
            assert encoding.decode_single_token_bytes(i) in text[start:end].encode()
    back = bpe.decode(bpe.encode(docs)).collect()
    assert [r.text for r in back] == [t or "" for _, t, _ in rows]
    empty = spark.createDataFrame([], docs.schema)
    assert bpe.encode(empty).count() == 0 and bpe.decode(bpe.encode(empty)).count() == 0


def test_long_texts_and_streams_with_split_characters(encoding, monkeypatch):
    pieces = bpe.Vocabulary(public_tokenizers.path(bpe.VOCABULARY)).encoder()
    text = "naïve 東京 🙂 " * 50
    monkeypatch.setattr(bpe, "LONG_CHARS", 10)
    packed = pieces.encode(text)
    assert np.frombuffer(packed, "<u4").tolist() == encoding.encode_ordinary(text)
    parts = (pieces.decode(packed[i : i + 4]) for i in range(0, len(packed), 4))
    assert "".join(bpe.streamed_text(parts)) == text


def test_query_over_documents(spark, sf, encoding):
    texts = {r.doc_id: r.text or "" for r in table(spark, sf, "documents").collect()}
    for r in bpe.op4_byte_bpe(spark, sf).collect():
        ids = np.array(encoding.encode_ordinary(texts[r.doc_id]), "<u4").tobytes()
        assert (r.n_tokens, r.ids_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_language_of_held_out_rows(spark):
    sf_dir = "/root/testdata/sf0.01"
    found = language.op3_language_id(spark, sf_dir).join(table(spark, sf_dir, "documents"), "doc_id")
    right, rows = found.filter("held_out").agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).first()
    assert right >= 0.97 * rows and rows > 300
    assert found.filter("score < 0 OR score > 1 OR lang_pred IS NULL").count() == 0


def test_language_of_odd_rows(spark):
    rows = [(1, "the cat and the dog sat there", "en"), (2, "le chat et le chien sont la", "fr"), (3, None, "en"), (4, "12 !", "fr"), (5, "the dog", None)]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double")
    odd = spark.createDataFrame([(1, "THE CAT"), (2, None), (3, ""), (4, "12 34 !"), (None, "le chien"), (1, "the " * 200_000)], "doc_id long, text string")
    model = language.fit(docs)
    assert [r.lang_pred for r in language.predict(odd, model).collect()] == ["en", "und", "und", "und", "fr", "en"]
    none = language.fit(spark.createDataFrame([], docs.schema))
    assert {r.lang_pred for r in language.predict(odd, none).collect()} == {"und"}
    assert language.predict(odd.limit(0), model).count() == 0


def test_gram_counts_do_not_depend_on_pieces(monkeypatch):
    is_letter, text = language.letters(), "Ab cd, éf gh!! i " * 30
    whole = language.gram_counts(text, is_letter)
    monkeypatch.setattr(language, "PIECE", 1 << 30)
    assert (language.gram_counts(text, is_letter) == whole).all()
    assert language.gram_counts("7 ?", is_letter) is None


def test_quality_of_held_out_rows(spark):
    sf_dir = "/root/testdata/sf0.01"
    found = quality.op6_quality_classifier(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id").filter("held_out").toPandas()
    assert (found.predicted == found.quality).mean() >= 0.97
    assert found[found.quality == 1].predicted.mean() >= 0.98


def test_prior_and_risk_on_known_mixtures():
    rng = np.random.default_rng(6)
    for share in (0.3, 0.8):
        p = rng.normal(1.5, 1, (1500, 3))
        positive = rng.random(3000) < share
        u = np.where(positive[:, None], rng.normal(1.5, 1, (3000, 3)), rng.normal(-1.5, 1, (3000, 3)))
        scorer, prior = quality.learn(p, u)
        assert abs(prior - share) < 0.08
        assert ((scorer.probability(u) >= 0.5) == positive).mean() > 0.97


def test_quality_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 3.0), (2, "", 1.0), (None, "x " * 100_000, 1.0), (2, "", 1.0)], "doc_id long, text string, score double")
    scorer, prior = quality.fit(docs, docs.filter("doc_id = 2").select("doc_id"))
    rows = quality.score(docs, scorer).collect()
    assert len(rows) == 4 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    empty = spark.createDataFrame([], docs.schema)
    scorer, prior = quality.fit(empty, empty)
    assert (prior, quality.score(empty, scorer).count()) == (0.5, 0)
    assert quality.score(docs, scorer).filter("score <> 0.5").count() == 0


def plain_spans(text):
    """The fixed patterns as they are stated."""
    out = []
    assign = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    for m in re.finditer(assign, text, re.I | re.A):
        out += [("assign", *m.span())] * (len(m[2]) >= 6)
    out += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda x: (x[1], ("assign", "access", "hex").index(x[0])))


def test_base_spans_of_documents(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text or "" for r in table(spark, sf, "documents").collect()}
    seen = 0
    for r in secret_scan.op7_secret_scan(spark, sf).collect():
        base = plain_spans(texts[r.doc_id])
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(x[0] == k for x in base) for k in ("assign", "access", "hex")]
        assert {*listed.split(",")} - {""} <= {*r.spans.split(",")}
        seen += len(base)
    assert seen


def test_odd_texts_have_defined_spans(spark):
    texts = [None, "", "é TOKEN : 'abcdef' x", "password=short", "token=abc secret=abcdefg", "AKIA" + "A" * 15, "AKIA" + "A" * 16,
             "f" * 23, "f" * 24, "ſecret=abcdef", "x" * 300_000 + " api_key=Zz9Zz9"]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, spans int")
    for row, text in zip(secret_scan.scan(docs).collect(), texts):
        base = [(s.kind, s.start, s.end) for s in row.spans if s.kind != "guess"]
        assert base == plain_spans(text or "")
    assert secret_scan.scan(docs.limit(0)).count() == 0


def test_costly_values_in_credential_contexts():
    found = secret_scan.spans_of("my passphrase is gT7#kq9Zx!vB2m. pwd: aaaaaaaaaaaa, auth = password2019")
    assert [k for k, *_ in found] == ["guess"]
    assert "my passphrase is gT7#kq9Zx!vB2m"[found[0][1] : found[0][2]] == "gT7#kq9Zx!vB2m"


def test_guess_cost_takes_the_cheapest_segmentation():
    bits = secret_scan.guess_bits
    assert bits("") == 0 and bits("password") <= 1 < bits("Password") < bits("p@ssw0rd1999") < bits("xq7Rt9Lm2KpZ")
    assert bits("aaaaaaaaaaaa") < 15 and bits("qwertyuiop") < 25 and bits("abcabcabc") < bits("abcxyzmno")
    assert bits("19991231") < 20 and bits("monkeydragon") < 12
    assert bits("k" * 20_000) < 40  # long values in time


def test_texts_without_their_secrets(spark):
    rows = [(1, "a token=abcdefgh b", 18), (2, None, None), (3, "clean", 99)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    out = secret_scan.without_secrets(docs)
    assert out.schema == docs.schema
    assert [tuple(r) for r in out.collect()] == [(1, "a [assign removed] b", 20), (2, None, None), (3, "clean", 99)]


def test_nothing_is_learned_from_the_held_out_third(spark):
    import zlib

    docs = spark.range(200).withColumnRenamed("id", "doc_id").withColumn("held", held_out())
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in docs.collect())


def plain_guess_bits(value, ranks):
    """Every segmentation: words, walks, repeats and single characters (no dates, no blocks said twice)."""
    import math

    brute, best = math.log2(26), [0.0]
    adjacent = secret_scan.ADJACENT
    for end in range(1, len(value) + 1):
        costs = [best[end - 1] + brute]
        for start in range(end - 1):
            part, n = value[start:end], end - start
            if part in ranks:
                costs.append(best[start] + math.log2(ranks[part] + 1))
            if n >= 3 and len(set(part)) == 1:
                costs.append(best[start] + brute + math.log2(n))
            if n >= 4 and all(b in adjacent[a] for a, b in zip(part, part[1:])):
                costs.append(best[start] + math.log2(47) + math.log2(n) + n)
        best.append(min(costs))
    return best[-1]


def test_walks_and_repeats_begin_anywhere():
    rng = np.random.default_rng(8)
    ranks = {"was": 1, "poi": 2, "aaa": 3, "edc": 700, "wertgf": 5}
    values = ["wasdfghjk", "poiuytrewq", "trewasdf", "wertgfdsa", "aaaaaaaaab", "edcvfr"]
    for _ in range(300):
        value = "q"
        while len(value) < 11:
            near = [c for c in secret_scan.ADJACENT[value[-1]] if c.isalpha()]
            value += value[-1] if rng.random() < 0.2 else rng.choice(near) if rng.random() < 0.8 else rng.choice(list("aqpw"))
        values.append(value)
    for value in values:
        if not any(value[i : i + k] == value[i + k : i + 2 * k] for k in (3, 4, 5) for i in range(len(value)) if len(value) >= i + 2 * k):
            assert secret_scan.guess_bits(value, ranks) == pytest.approx(plain_guess_bits(value, ranks))
    assert secret_scan.guess_bits("a" * 200_000) < 30


def test_clean_prose_has_no_guesses(spark):
    prose = ["The password is mandatory here.", "A token is generated, at random.", "Our secret is consistency."]
    prose += ["Mandatory checks were generated with consistency."] * 3
    leaked = ["the password is xkqvjwzhfyp"] * 4 + ["the passphrase is gT7#kq9Zx!vB2m"]
    docs = spark.createDataFrame(list(enumerate(prose + leaked)), "doc_id long, text string")
    words = secret_scan.corpus_words(docs)
    out = [r.text for r in secret_scan.without_secrets(docs, words=words).orderBy("doc_id").collect()]
    assert out[: len(prose)] == prose and all("[guess removed]" in x for x in out[len(prose) :])
    assert len(secret_scan.corpus_words(docs, bound=2)) <= len(secret_scan.WORDS) + 2
    found = secret_scan.scan(docs, words=words).orderBy("doc_id").collect()
    assert [len(r.spans) for r in found] == [0] * len(prose) + [1] * len(leaked)


def gathered(monkeypatch):
    """The bytes of each row that the driver collects from now on."""
    sizes, collect = [], DataFrame.collect

    def counted(frame):
        rows = collect(frame)
        sizes.extend(sum(len(v) for v in r if isinstance(v, (bytes, bytearray, str))) for r in rows)
        return rows

    monkeypatch.setattr(DataFrame, "collect", counted)
    return sizes


def test_quality_is_learned_without_features_on_the_driver(spark, monkeypatch):
    texts = [(i, ("good words in a row %d. " if i % 2 else "BUY$$$ %d!! ") % i * (i + 1)) for i in range(40)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    classes = quality.character_classes()
    rows = sorted((quality.features(t, classes).tobytes(), i % 2) for i, t in texts)
    x, good = (np.array([np.frombuffer(r[0], np.float32) for r in rows]), np.array([r[1] for r in rows], bool))
    expected, prior = quality.learn(x[good], x)
    sizes = gathered(monkeypatch)
    scorer, found = quality.fit(docs, docs.filter("doc_id % 2 = 1").select("doc_id"))
    assert (scorer.weights == expected.weights).all() and (scorer.bias, found) == (expected.bias, prior)
    assert (scorer.probability(x) == expected.probability(x)).all()
    assert sum(sizes) < 10 * quality.FEATURES * 4  # the scorer, not the 60 rows that it learns from


def test_corpus_words_are_merged_off_the_driver(spark, monkeypatch):
    """Most documents first, ties by name; the last merge is a task's, so that the driver gets the words alone."""
    docs = spark.createDataFrame([(i, " ".join(w for k, w in enumerate(("zeta", "beta", "alfa", "rho")) if i >= k // 2 * 3)) for i in range(9)], "doc_id long, text string")
    found = secret_scan.corpus_words(docs.repartition(4), bound=3)
    assert found == [*secret_scan.WORDS, *(w for w in ("beta", "zeta", "alfa") if w not in secret_scan.WORDS)]
    plans, collect = [], DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda x: plans.append(x._jdf.queryExecution().toString()) or collect(x))
    assert secret_scan.corpus_words(docs.repartition(4), bound=3) == found
    assert len(plans) == 1 and "TakeOrderedAndProject" not in plans[0]
