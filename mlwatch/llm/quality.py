"""Quality classifier learned from trusted positives and unlabelled text alone.

The risk of a linear scorer g with logistic loss l is  pi E_p[l(g)] + max(0, E_u[l(-g)] - pi E_p[l(-g)]):
the unlabelled rows stand for negatives once the positives among them, a share pi, are taken off, and the
difference is kept from going below zero. The class prior pi is estimated from how the scores of positives and
of unlabelled rows differ at the top. Labels of negatives are never used.
"""

from __future__ import annotations

import math
import pickle
import re
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mlwatch.llm.rows import by_batch, held_out, received, sent, some_of, table

# Rows that a fit learns from, about: so many trusted positives and so many unlabelled ones.
SAMPLE_ROWS = 4000
# Features are counted over pieces of so many characters.
PIECE = 1 << 18
BLANKS = re.compile(r"\s")

# Character classes of the shape features: every ASCII sign has its own, letters and digits share.
_LOWER, _UPPER, _DIGIT, _BLANK, _LINE, _OTHER = range(6)
_SIGNS = [c for c in map(chr, range(33, 127)) if not c.isalnum()]
CLASSES = 6 + len(_SIGNS)


def character_classes() -> np.ndarray:
    classes = np.full(0x110000, _OTHER, np.uint8)
    for i in range(0x3000):
        c = chr(i)
        if c.isalpha():
            classes[i] = _UPPER if c.isupper() else _LOWER
        elif c.isdigit():
            classes[i] = _DIGIT
        elif c.isspace():
            classes[i] = _LINE if c == "\n" else _BLANK
    classes[0x3000:] = [_LOWER if chr(i).isalpha() else _OTHER for i in range(0x3000, 0x110000)]
    for k, c in enumerate(_SIGNS):
        classes[ord(c)] = 6 + k
    return classes


WORD_FEATURES = 9
FEATURES = CLASSES * CLASSES + CLASSES + WORD_FEATURES


def word_lists(text: str) -> Iterator[list[str]]:
    """The words of a text, in lists of about ``PIECE`` characters that end at white space."""
    at = 0
    while at < len(text):
        gap = BLANKS.search(text, at + PIECE)
        end = gap.end() if gap else len(text)
        if tokens := text[at:end].split():
            yield tokens
        at = end


def features(text: str | None, classes: np.ndarray) -> np.ndarray:
    """Square roots of the shares of character classes and of neighbouring pairs of them, and word statistics.

    All zero but for the length features where the text is null or empty. Distinct words are those of the whole text,
    counted by their 64-bit hashes; pieces bound the memory and change no feature.
    """
    text = text or ""
    pairs = np.zeros(CLASSES * CLASSES, np.int64)
    single = np.zeros(CLASSES, np.int64)
    words = repeated = letters = 0
    seen = np.zeros(0, np.uint64)
    last, longest, run = None, 0, 0
    for tokens in word_lists(text):
        same = np.array([*map(eq, [last, *tokens[:-1]], tokens)], bool)
        repeated += int(same.sum())
        breaks = np.flatnonzero(~same)  # words that differ from the one before
        if len(breaks):
            longest = max(longest, run + int(breaks[0]), int(np.diff(breaks).max(initial=1)) - 1)
            run = len(tokens) - 1 - int(breaks[-1])
        else:
            run += len(tokens)
        longest = max(longest, run)
        last, words = tokens[-1], words + len(tokens)
        letters += sum(map(len, tokens))
        hashed = np.fromiter((xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")) for t in set(tokens)), np.uint64)
        seen = np.union1d(seen, hashed)
    for at in range(0, len(text), PIECE):
        part = text[max(0, at - 1) : at + PIECE]
        shape = classes[np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)]
        pairs += np.bincount(shape[:-1].astype(np.int64) * CLASSES + shape[1:], minlength=len(pairs))
        single += np.bincount(shape[min(at, 1) :], minlength=CLASSES)
    share = lambda x, n: math.sqrt(x / n) if n else 0.0
    out = np.zeros(FEATURES, np.float32)
    out[: len(pairs)] = np.sqrt(pairs / max(1, pairs.sum()))
    out[len(pairs) : len(pairs) + CLASSES] = np.sqrt(single / max(1, len(text)))
    out[-WORD_FEATURES:] = (
        math.log1p(words) / 10,
        math.log1p(len(text)) / 10,
        share(repeated, words),
        share(min(longest, 50), 50),
        len(seen) / max(1, words),
        len(seen) / max(1.0, math.sqrt(words)) / 20,
        letters / max(1, words) / 10,
        share(single[_LINE], words),
        float(words == 0),
    )
    return out


class Scorer:
    """Standardised features, weights and bias."""

    def __init__(self, x: np.ndarray):
        self.mean, self.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 0.01)
        self.weights, self.bias = np.zeros(x.shape[1]), 0.0

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.standard(x) @ self.weights + self.bias

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def minimise(p: np.ndarray, u: np.ndarray, prior: float, rounds: int = 250, l2: float = 1e-3) -> Scorer:
    """Full-batch Adam on the non-negative unbiased risk. Where the negatives' part falls below zero, the step
    undoes that part alone, as its minimiser prescribes."""
    scorer = Scorer(u)
    xp, xu = scorer.standard(p).astype(np.float32), scorer.standard(u).astype(np.float32)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    w, b = np.zeros(p.shape[1], np.float32), np.float32(0)
    m, v = np.zeros(len(w) + 1, np.float32), np.zeros(len(w) + 1, np.float32)
    for t in range(1, rounds + 1):
        gp, gu = xp @ w + b, xu @ w + b
        negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        du, dp = sigmoid(gu) / np.float32(len(gu)), sigmoid(gp) / np.float32(len(gp))
        slope = np.append(xu.T @ du - prior * (xp.T @ dp), du.sum() - prior * dp.sum())
        if negative < 0:
            slope = -slope
        else:
            ep = -prior * sigmoid(-gp) / np.float32(len(gp))
            slope = slope + np.append(xp.T @ ep, ep.sum())
        slope[:-1] += l2 * w
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope * slope
        step = 0.03 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    scorer.weights, scorer.bias = w, float(b)
    return scorer


def class_prior(p_scores: np.ndarray, u_scores: np.ndarray, delta: float = 0.1) -> float:
    """Share of positives among the unlabelled: the smallest ratio of the parts of both that score above a bound,
    where the bound is the one with the least upper confidence limit."""
    bounds = np.quantile(p_scores, np.linspace(0, 0.95, 96))
    above_p = 1 - np.searchsorted(np.sort(p_scores), bounds, "left") / len(p_scores)
    above_u = 1 - np.searchsorted(np.sort(u_scores), bounds, "left") / len(u_scores)
    slack = math.sqrt(math.log(4 / delta) / 2 / len(u_scores)) + math.sqrt(math.log(4 / delta) / 2 / len(p_scores))
    limits = (above_u + slack) / above_p
    best = int(np.argmin(limits))
    return float(min(0.99, max(0.01, above_u[best] / above_p[best])))


def learn(p: np.ndarray, u: np.ndarray) -> tuple[Scorer, float]:
    """(scorer, class prior) from features of positives and unlabelled rows. The prior comes from rows that the
    scorer it is read from has not seen; fewer than four rows of either kind can't be halved for that, and take a prior of
    one half. Without positives or unlabelled rows every score is one half."""
    if not len(p) or not len(u):
        return Scorer(u if len(u) else np.zeros((1, FEATURES))), 0.5
    if min(len(p), len(u)) < 4:
        return minimise(p, u, 0.5), 0.5
    first = minimise(p[::2], u[::2], 0.5, 120)
    prior = class_prior(first.margin(p[1::2]), first.margin(u[1::2]))
    again = minimise(p[::2], u[::2], prior, 120)
    prior = class_prior(again.margin(p[1::2]), again.margin(u[1::2]))
    return minimise(p, u, prior), prior


def _featured(docs: DataFrame, text_col: str) -> DataFrame:
    def run(batch: pa.RecordBatch) -> dict:
        classes = character_classes()
        return {"x": pa.array([features(t, classes).tobytes() for t in batch.column(1).to_pylist()], pa.binary())}

    return by_batch(docs.select("__key", text_col), run, "x binary")


def _table(rows: list[bytes]) -> np.ndarray:
    """Rows of features, in an order that doesn't depend on partitions."""
    return np.frombuffer(b"".join(sorted(rows)), np.float32).reshape(-1, FEATURES)


def fit(
    docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS,
) -> tuple[Scorer, float]:
    """Learn from ``docs``: positives are the rows whose id is in ``trusted`` (a column of ids), unlabelled rows are
    any. About ``sample_rows`` of each are used, chosen by a hash of the id. Null ids are never trusted.

    One task learns from the features of the bounded sample; only the scorer meets the driver."""
    keyed = docs.select(F.col(id_col).alias("__key"), F.col(text_col))
    ids = trusted.select(F.col(id_col).alias("__key")).filter("__key IS NOT NULL").distinct()
    some = F.broadcast(some_of(ids, "__key", sample_rows, 11))  # about sample_rows ids
    positive = _featured(keyed.join(some, "__key", "left_semi"), text_col)
    unlabelled = _featured(some_of(keyed, "__key", sample_rows, 12), text_col)
    rows = positive.withColumn("trusted", F.lit(True)).unionByName(unlabelled.withColumn("trusted", F.lit(False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn: dict[bool, list[bytes]] = {True: [], False: []}
        for batch in batches:
            for x, good in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                drawn[good].append(x)
        scorer, prior = learn(_table(drawn.pop(True)), _table(drawn.pop(False)))
        state = pickle.dumps((scorer.mean, scorer.scale, scorer.weights, scorer.bias))
        yield pa.RecordBatch.from_arrays([pa.array([state], pa.binary()), pa.array([prior])], ["state", "prior"])

    found = rows.repartition(1).mapInArrow(run, "state binary, prior double").first()
    scorer = Scorer(np.zeros((1, FEATURES)))
    scorer.mean, scorer.scale, scorer.weights, scorer.bias = pickle.loads(found["state"])
    return scorer, found["prior"]


def score(docs: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) of every whole text: the probability of good quality, and 1 where it is 0.5 or more.

    Null and empty texts are scored by their (empty) features. Every row gives a row, repeated ones too; extra
    columns are ignored.
    """
    held = sent(docs.sparkSession, scorer)

    def run(batches):
        classes, scorer = character_classes(), received(held)
        for batch in batches:
            scores, texts = [], batch.column(1)
            for at in range(0, len(texts), 256):
                x = np.stack([features(t, classes) for t in texts[at : at + 256].to_pylist()])
                scores.append(scorer.probability(x))
            all_scores = np.concatenate(scores).astype(np.float64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(all_scores), pa.array((all_scores >= 0.5).astype(np.int32))],
                [id_col, "score", "predicted"],
            )

    schema = f"{id_col} {dict(docs.dtypes)[id_col]}, score double, predicted int"
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids labelled as of good quality, outside the held-out third."""
    return labels.filter((F.col("quality") == 1) & ~held_out()).select("doc_id")


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier, learned from ``docs`` and ``labels``, doesn't reject; all columns.

    Rows are judged one by one in place, so repeated and null ids are no special case.
    """
    scorer, _ = fit(docs.filter(~held_out()), trusted_ids(labels))
    held = sent(docs.sparkSession, scorer)
    text_at = docs.columns.index("text")

    def run(batches):
        classes, scorer = character_classes(), received(held)
        for batch in batches:
            texts = batch.column(text_at)
            for at in range(0, batch.num_rows, 256):
                x = np.stack([features(t, classes) for t in texts[at : at + 256].to_pylist()])
                yield batch.slice(at, 256).filter(pa.array(scorer.probability(x) >= 0.5))

    return docs.mapInArrow(run, docs.schema)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scorer, _ = fit(docs.filter(~held_out()), trusted_ids(table(spark, sf_dir, "labels")))
    return score(docs, scorer).select("doc_id", held_out().alias("held_out"), "score", "predicted")
