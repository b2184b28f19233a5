"""Language identification: cosines of TF-IDF n-gram vectors with several centroids per language.

A text's letters, lower-cased and with everything else as one blank, give its hashed character pairs and
triples. Document frequencies come from every learnable row; the centroids of a language are clustered from a
bounded sample of its rows. A prediction takes the nearest centroid and is rejected beyond that cluster's reach.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mlwatch.llm.rows import hashed_below, held_out, received, sent, table

SIZE_BITS = 12
SIZE = 1 << SIZE_BITS
CENTROIDS = 4
# Rows of each language that its centroids are clustered from, about: a bound on fitting alone.
SAMPLE_ROWS = 400
# Members of a cluster beyond its reach: the part of them that would be rejected.
REJECTED = 0.01
UNKNOWN = "und"
# Texts are counted in pieces of so many characters, so that memory doesn't follow the longest.
PIECE = 1 << 18


def letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def gram_counts(text: str | None, is_letter: np.ndarray) -> np.ndarray | None:
    """Counts of hashed pairs and triples of characters; None for a null text or one without letters."""
    counts, seen = np.zeros(SIZE, np.int64), False
    text = (text or "").lower()
    for at in range(0, len(text), PIECE):
        part = text[max(0, at - 2) : at + PIECE]
        codes = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
        mask = is_letter[codes]
        seen |= bool(mask.any())
        kept = mask.copy()
        kept[0] |= at == 0
        kept[1:] |= mask[:-1]  # of other characters the first after a letter
        codes = np.where(mask, codes, np.uint32(32))[kept]
        first = codes * np.uint32(0x9E3779B1)
        pairs = first[:-1] ^ (codes[1:] * np.uint32(0x85EBCA6B))
        triples = (pairs[:-1] * np.uint32(5)) ^ (codes[2:] * np.uint32(0xC2B2AE35))
        for grams in (pairs, triples):
            mixed = (grams ^ (grams >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            counts += np.bincount(mixed >> np.uint32(32 - SIZE_BITS), minlength=SIZE)
    return counts if seen else None


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of unit length: 1 + log(count), times the inverse document frequency."""
    out = np.zeros(counts.shape, np.float32)
    np.log(counts, out=out, where=counts > 0)
    out[counts > 0] += 1
    out *= idf
    norms = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return out / np.where(norms > 0, norms, 1)


def document_frequencies(docs: DataFrame, text_col: str) -> tuple[np.ndarray, int]:
    """In how many texts of ``docs`` each hashed gram occurs, and how many texts have letters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_letter, found, rows = letters(), np.zeros(SIZE, np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if (counts := gram_counts(text, is_letter)) is not None:
                    found += counts > 0
                    rows += 1
        grams, seen = np.append(np.arange(SIZE), -1), np.append(found, rows)
        yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(seen)], ["gram", "n"])

    sums = docs.select(text_col).mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    known = {r.gram: r.n for r in sums.collect()}  # one row per hashed gram
    return np.array([known.get(i, 0) for i in range(SIZE)]), known.get(-1, 0)


def clustered(vectors: np.ndarray, k: int, rounds: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """(centroids, member of each row) by spherical k-means, started from rows far apart."""
    mean = vectors.mean(axis=0)
    starts = [int(np.argmax(vectors @ mean))]
    nearest = vectors @ vectors[starts[0]]
    for _ in range(1, min(k, len(vectors))):
        starts.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, vectors @ vectors[starts[-1]])
    centroids = vectors[starts]
    for _ in range(rounds):
        member = np.argmax(vectors @ centroids.T, axis=1)
        sums = np.stack([vectors[member == c].sum(axis=0) for c in range(len(centroids))])
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norms > 0, sums / np.where(norms > 0, norms, 1), centroids).astype(np.float32)
    return centroids, np.argmax(vectors @ centroids.T, axis=1)


class Model:
    """Languages, unit centroids and reaches, by language; idf by gram."""

    def __init__(self, idf: np.ndarray, parts: list[tuple[str, np.ndarray, float]]):
        self.idf, self.langs = idf.astype(np.float32), [p[0] for p in parts]
        self.centroids = np.array([p[1] for p in parts], np.float32).reshape(-1, SIZE)
        self.reach = np.array([p[2] for p in parts])


def _sampled(docs: DataFrame, lang_col: str, key: Column, per_language: int) -> DataFrame:
    """About ``per_language`` rows of each language by a hash of the key; one count per language meets the driver."""
    sizes = {r[0]: r[1] for r in docs.groupBy(lang_col).count().collect()}
    if not sizes:
        return docs
    drawn = F.lit(False)
    for lang, n in sorted(sizes.items()):
        drawn = F.when(F.col(lang_col) == lang, hashed_below(F.xxhash64(key), per_language, n)).otherwise(drawn)
    return docs.filter(drawn)


def fit(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id",
    sample_rows: int = SAMPLE_ROWS, k: int = CENTROIDS,
) -> Model:
    """Learn from the rows of ``docs`` with a language. Rows without letters teach nothing; no rows, no centroids."""
    known = docs.filter(F.col(lang_col).isNotNull()).select(
        F.col(key_col).alias("key"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")
    )
    frequencies, rows = document_frequencies(known, "text")
    idf = np.where(frequencies > 0, np.log((1 + rows) / (1 + frequencies)) + 1, 0)
    sample = _sampled(known, "lang", F.col("key"), sample_rows)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_letter = letters()
        for batch in batches:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                if (counts := gram_counts(text, is_letter)) is not None:
                    unit = weighted(counts[None, :], idf)[0].astype(np.float32).tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([unit])], ["lang", "v"])

    def centres(group: pd.DataFrame) -> pd.DataFrame:
        rows = np.stack([np.frombuffer(v, np.float32) for v in sorted(group["v"])])
        centroids, member = clustered(rows, k)
        out = []
        for c, centroid in enumerate(centroids):
            near = rows[member == c] @ centroid
            if len(near):
                out.append((group["lang"].iloc[0], centroid.tobytes(), float(np.quantile(near, REJECTED))))
        return pd.DataFrame(out, columns=["lang", "v", "reach"])

    drawn = sample.select("text", "lang").mapInArrow(vectors, "lang string, v binary")
    found = drawn.groupBy("lang").applyInPandas(centres, "lang string, v binary, reach double").collect()
    parts = sorted((r.lang, bytes(r.v), r.reach) for r in found)  # a few rows per language
    return Model(idf, [(lang, np.frombuffer(v, np.float32), reach) for lang, v, reach in parts])


def predict(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, lang_pred, score, rejected) of every whole text.

    score is the cosine with the nearest centroid (0 to 1), lang_pred its language, ties to the first in order of
    name; rejected says that the text is farther than nearly all texts the cluster was made of. A null text, one
    without letters, or a model without centroids gives ``und``, 0 and true. Every row gives a row; extra columns
    are ignored.
    """
    held = sent(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_letter, model = letters(), received(held)
        for batch in batches:
            langs, scores, far = [], [], []
            texts = batch.column(1)
            for at in range(0, len(texts), 256):
                counted = [gram_counts(t, is_letter) for t in texts[at : at + 256].to_pylist()]
                some = [c for c in counted if c is not None] if len(model.langs) else []
                if some:
                    cosines = weighted(np.stack(some), model.idf) @ model.centroids.T
                    best = iter(zip(cosines.argmax(axis=1).tolist(), cosines.max(axis=1).tolist()))
                for counts in counted:
                    which, cosine = next(best) if counts is not None and some else (None, 0.0)
                    langs.append(UNKNOWN if which is None else model.langs[which])
                    scores.append(min(1.0, max(0.0, float(cosine))))
                    far.append(which is None or cosine < model.reach[which])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(far, pa.bool_())],
                [id_col, "lang_pred", "score", "rejected"],
            )

    schema = f"{id_col} {dict(docs.dtypes)[id_col]}, lang_pred string, score double, rejected boolean"
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.filter(~held_out()))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
