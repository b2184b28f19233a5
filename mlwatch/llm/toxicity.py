"""Toxicity of texts: embeddings of subwords, averaged over a text, into a linear softmax.

A text's words (letters and digits, lower-cased, between blanks) give their character n-grams, the blanks at both
ends of a word included. Every hashed n-gram has a vector; the vectors of all n-grams of a text are averaged, each
weighted by the logarithm of its count, and go through one softmax layer. Vectors and layer are trained jointly, so a misspelling that no training text holds
still shares most of its n-grams, and their vectors, with the word it comes from.

As the layer is linear, the logits of an average are the average of the n-grams' logits: scoring looks up one
number per distinct n-gram.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mlwatch.llm.rows import some_of, table

SHORTEST, LONGEST = 3, 6
BITS = 18
DIMENSIONS = 4
# Labelled rows of each class that a fit learns from, about: a bound on fitting alone.
SAMPLE_ROWS = 3000
# An n-gram is trained if this share of the sample's texts hold it, two texts at least.
LEAST_SHARE = 0.005
EPOCHS = 4
BATCH = 64
RATE = 0.5
DECAY = 1e-5
# Texts are read in stretches of so many characters, so that memory doesn't follow the longest.
PIECE = 1 << 18

# The split of the query: rows whose checksum leaves this remainder are never learned from.
SPLIT, HELD_OUT = 5, 0

BLANK = 32


def word_characters() -> np.ndarray:
    return np.array([chr(i).isalnum() for i in range(0x110000)])


def grams(text: str | None, is_word: np.ndarray) -> Iterator[np.ndarray]:
    """The hashed n-grams of a whole text, stretch by stretch, repeats included; nothing where it has no words.

    A stretch goes on with the last characters of the one before, so its length changes no n-gram.
    """
    text = (text or "").lower()
    tail = np.array([BLANK], np.uint32)
    for at in range(0, len(text) + 1, PIECE):
        codes = np.frombuffer(text[at : at + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = np.where(is_word[codes], codes, np.uint32(BLANK))
        if at + PIECE > len(text):
            codes = np.append(codes, np.uint32(BLANK))  # the text's end
        held = len(tail)
        joined = np.concatenate([tail, codes])
        keep = np.ones(len(joined), bool)
        keep[1:] = (joined[1:] != BLANK) | (joined[:-1] != BLANK)  # of blanks in a row the first
        held = int(keep[:held].sum())
        joined = joined[keep]
        blanks = np.concatenate([[0], np.cumsum(joined == BLANK)])
        mixed = joined.astype(np.uint64)
        for n in range(2, LONGEST + 1):
            if len(joined) < n:
                break
            mixed = mixed[: len(joined) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + joined[n - 1 :]
            first = max(0, held - n + 1)  # those that end in this stretch
            if n < SHORTEST or len(mixed) <= first:
                continue
            starts = np.arange(first, len(mixed))
            inside = blanks[starts + n - 1] == blanks[starts + 1]
            hashed = (mixed[first:] ^ (mixed[first:] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            yield (hashed[inside] >> np.uint64(64 - BITS)).astype(np.int32)
        tail = joined[-(LONGEST - 1) :]


def bag(text: str | None, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct n-grams, their counts) of a whole text; a long one is added up stretch by stretch."""
    if text is None or len(text) < PIECE:
        return np.unique(np.concatenate([np.zeros(0, np.int32), *grams(text, is_word)]), return_counts=True)
    counts = np.zeros(1 << BITS, np.int64)
    for some in grams(text, is_word):
        counts += np.bincount(some, minlength=len(counts))
    found = np.flatnonzero(counts).astype(np.int32)
    return found, counts[found]


def weights(counts: np.ndarray) -> np.ndarray:
    """Share of each n-gram in the average of a text that holds it so often."""
    damped = np.log1p(counts)
    return (damped / max(1e-9, damped.sum())).astype(np.float32)


def train(
    bags: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray, dimensions: int = DIMENSIONS, epochs: int = EPOCHS,
    seed: int = 7,
) -> tuple[np.ndarray, float]:
    """(logit of each n-gram, bias): how much more the softmax speaks for toxic than against it.

    Vectors and softmax layer are trained together on minibatches (per-coordinate step sizes), classes weighted to
    equal shares. N-grams of fewer texts than ``LEAST_SHARE`` says keep a zero vector. With one class only, every
    logit is zero and the bias speaks for that class; with no rows every score is one half.
    """
    logits = np.zeros(1 << BITS, np.float32)
    if not len(bags) or len(set(toxic.tolist())) < 2:
        return logits, 0.0 if not len(bags) else (20.0 if toxic[0] else -20.0)
    texts = np.zeros(1 << BITS, np.int32)
    for found, _ in bags:
        texts[found] += 1
    known = np.flatnonzero(texts >= max(2, LEAST_SHARE * len(bags)))
    place = np.full(1 << BITS, -1, np.int32)
    place[known] = np.arange(len(known), dtype=np.int32)
    rows = []
    for found, counts in bags:
        at, shares = place[found], weights(counts)  # n-grams without a vector count as zeros
        rows.append((at[at >= 0], shares[at >= 0]))
    draw = np.random.default_rng(seed)
    vectors = draw.uniform(-1, 1, (len(known), dimensions)) / dimensions
    layer, bias = draw.uniform(-1, 1, (dimensions, 2)), np.zeros(2)
    seen = [np.full_like(vectors, 1e-10), np.full_like(layer, 1e-10), np.full_like(bias, 1e-10)]
    weight = np.where(toxic == 1, 0.5 / (toxic == 1).mean(), 0.5 / (toxic != 1).mean())
    order = np.arange(len(rows))
    for epoch in range(epochs):
        draw.shuffle(order)
        rate = RATE * (1 - epoch / epochs)
        for start in range(0, len(order), BATCH):
            some = order[start : start + BATCH]
            at = np.concatenate([rows[i][0] for i in some])
            share = np.concatenate([rows[i][1] for i in some])
            row = np.repeat(np.arange(len(some)), [len(rows[i][0]) for i in some])
            held = vectors[at] * share[:, None]
            mean = np.stack([np.bincount(row, held[:, d], len(some)) for d in range(dimensions)], axis=1)
            out = mean @ layer + bias
            out = np.exp(out - out.max(axis=1, keepdims=True))
            wrong = out / out.sum(axis=1, keepdims=True)
            wrong[np.arange(len(some)), toxic[some]] -= 1
            wrong *= weight[some, None] / len(some)
            back = (wrong @ layer.T)[row] * share[:, None]
            slopes = (
                np.stack([np.bincount(at, back[:, d], len(known)) for d in range(dimensions)], axis=1) + DECAY * vectors,
                mean.T @ wrong + DECAY * layer,
                wrong.sum(axis=0),
            )
            for value, slope, squares in zip((vectors, layer, bias), slopes, seen):
                squares += slope * slope
                value -= rate * slope / np.sqrt(squares)
    logits[known] = vectors @ (layer[:, 1] - layer[:, 0])
    return logits, float(bias[1] - bias[0])


def probability(text: str | None, is_word: np.ndarray, logits: np.ndarray, bias: float) -> float:
    """The softmax's share of toxic for one whole text; one without n-grams has its bias alone."""
    found, counts = bag(text, is_word)
    logit = float(logits[found] @ weights(counts)) + bias
    return float(1 / (1 + np.exp(-np.clip(logit, -30, 30))))


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    sample_rows: int = SAMPLE_ROWS,
) -> tuple[np.ndarray, float]:
    """Learn from the rows of ``docs`` that ``labels`` (id, 0 or 1) marks; see :func:`train`.

    About ``sample_rows`` ids of each class are used, chosen by a hash of the id. Null ids and labels teach nothing;
    an id marked both ways, toxic; of several texts of one id the least teaches. A bag has at most ``1 << BITS``
    n-grams however long its text, so what the one task that learns holds is bounded by the sample.
    """
    marked = labels.select(F.col(id_col).alias("__key"), F.col(label_col).cast("int").alias("__toxic"))
    marked = marked.filter("__key IS NOT NULL AND __toxic IN (0, 1)").groupBy("__key").agg(F.max("__toxic").alias("__toxic"))
    drawn = [some_of(marked.filter(F.col("__toxic") == c), "__key", sample_rows, 13) for c in (0, 1)]
    some = F.broadcast(drawn[0].unionByName(drawn[1]))  # about twice sample_rows ids
    keyed = docs.select(F.col(id_col).alias("__key"), F.col(text_col).alias("__text"))
    texts = keyed.join(some, "__key").groupBy("__key", "__toxic").agg(F.min("__text").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_word = word_characters()
        for batch in batches:
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found, counts = bag(text, is_word)
                columns = [pa.array([toxic], pa.int32()), pa.array([found.tobytes()]), pa.array([counts.astype(np.int32).tobytes()])]
                yield pa.RecordBatch.from_arrays(columns, ["toxic", "found", "counts"])

    schema = "toxic int, found binary, counts binary"
    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn = pa.Table.from_batches(list(batches), pa.schema([("toxic", pa.int32()), ("found", pa.binary()), ("counts", pa.binary())]))
        drawn = drawn.sort_by([("toxic", "ascending"), ("found", "ascending"), ("counts", "ascending")])
        found, counts = ([np.frombuffer(v.as_buffer(), np.int32) for v in drawn[name]] for name in ("found", "counts"))
        logits, bias = train(list(zip(found, counts)), drawn["toxic"].to_numpy().astype(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([logits.tobytes()], pa.binary()), pa.array([bias])], ["logits", "bias"])

    bags = texts.select("__toxic", "__text").mapInArrow(run, schema)
    # one task learns from the bounded sample; only its logits meet the driver
    logits, bias = bags.repartition(1).mapInArrow(learn, "logits binary, bias double").first()
    return np.frombuffer(logits, np.float32), bias


def score(
    docs: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, score, predicted) of every whole text: how likely it is toxic, and 1 where that is 0.5 or more.

    Null texts, empty ones and those without letters or digits are scored by the bias, which is the same for all.
    Very long texts are read in stretches that change no n-gram. Every row gives a row, repeated ones too; ids may be
    null; an empty table gives none; extra columns are ignored.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # one number per hashed n-gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_word, (logits, bias) = word_characters(), held.value
        for batch in batches:
            scores = np.array([probability(text.as_py(), is_word, logits, bias) for text in batch.column(1)], np.float64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))],
                [id_col, "score", "predicted"],
            )

    schema = f"{id_col} {dict(docs.dtypes)[id_col]}, score double, predicted int"
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def held_out(key: str = "doc_id") -> Column:
    """True where crc32 of the key's text leaves the remainder; a null key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % SPLIT == HELD_OUT


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels").filter(~held_out()))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
