"""Near-duplicate documents by SimHash fingerprints and covering locality-sensitive hashing.

A fingerprint takes the majority of 64 hash bits over a document's word shingles. Two fingerprints link when
they differ in at most ``radius`` bits. Candidates come from 2^(radius+1) - 1 structured masks: bit i has a
vector phi(i) in GF(2)^(radius+1), and mask v keeps the bits with <phi(i), v> = 1. The phi of any ``radius``
differing bits leave some v orthogonal to all of them, whose mask keeps none of these bits: every pair within
the radius agrees under that mask, so no link is missed.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mlwatch.llm.components import connected_components
from mlwatch.llm.rows import by_batch, table
from mlwatch.sources.shared import written

BITS = 64
RADIUS = 4
WORDS = 4
SEED = 42
# Shingles are hashed in pieces of so many words, so that memory doesn't follow the longest text.
PIECE = 1 << 16
# A bucket of up to so many fingerprints is linked inside one task; the fingerprints of larger ones go through
# midpoints, which need no pairs. Both ways are exact.
BUCKET = 4096


def _lane_counts(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each of the 64 bits set, by eight byte-wide counters per machine word."""
    lanes = (hashes[:, None] >> np.arange(8, dtype=np.uint64)) & np.uint64(0x0101010101010101)
    sums = np.add.reduceat(lanes, np.arange(0, len(hashes), 255), axis=0)
    counts = np.ascontiguousarray(sums).view(np.uint8).reshape(len(sums), 8, 8).sum(axis=0, dtype=np.int64)
    return counts.T.reshape(-1)  # by byte, then by bit in the byte


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """The 64-bit fingerprint; 0 for a null text or one without words."""
    tokens = (text or "").encode().lower().split()  # of bytes: A-Z only, split at the six ASCII blanks
    if not tokens:
        return 0
    total, counts = 0, np.zeros(BITS, np.int64)
    for at in range(0, max(1, len(tokens) - words + 1), PIECE):
        part = tokens[at : at + PIECE + words - 1]
        line = b" ".join(part)
        lengths = np.fromiter(map(len, part), np.int64, len(part))
        ends = np.cumsum(lengths + 1) - 1
        n = max(1, len(part) - words + 1)
        starts, ends = (ends - lengths)[:n].tolist(), ends[min(words, len(part)) - 1 :].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(line[a:b], seed) for a, b in zip(starts, ends)), np.uint64, n)
        counts += _lane_counts(hashes)
        total += n
    return int.from_bytes(np.packbits(2 * counts > total, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(id, fp): the fingerprint of every whole text as a signed long. Other columns are not read."""

    def run(batch: pa.RecordBatch) -> dict:
        values = np.array([fingerprint(t, words) for t in batch.column(1).to_pylist()], np.uint64)
        return {"id": batch.column(0), "fp": pa.array(values.view(np.int64))}

    return by_batch(docs.select(F.col(id_col).cast("long").alias("id"), text_col), run, "id long, fp long")


def covering_masks(radius: int = RADIUS) -> list[int]:
    """Signed 64-bit masks, one for each non-zero v in GF(2)^(radius+1)."""
    vectors = (1 << radius + 1) - 1
    phi = [1 + i % vectors for i in range(BITS)]
    masks = [sum(1 << i for i in range(BITS) if (phi[i] & v).bit_count() & 1) for v in range(1, vectors + 1)]
    return [int(np.uint64(m).view(np.int64)) for m in masks]


def bucket_links(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that join the fingerprints of one bucket as all its close pairs would: a tree per component."""
    left, links = np.unique(values).view(np.uint64), []  # in the order of signed longs: trees hang on the least
    while len(left) > 1:
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            at = frontier.pop()
            near = np.bitwise_count(left ^ at) <= radius
            if near.any():
                found, left = left[near], left[~near]
                links += [(at, x) for x in found]
                frontier += list(found)
    return [(int(np.uint64(a).view(np.int64)), int(np.uint64(b).view(np.int64))) for a, b in links]


def _links_in_buckets(buckets: DataFrame, radius: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            ends, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
            found = [x for a, b in zip(ends[:-1], ends[1:]) for x in bucket_links(values[a:b], radius)]
            sides = np.array(found, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(sides[:, 0]), pa.array(sides[:, 1])], ["a", "b"])

    return buckets.select("fps").mapInArrow(run, "a long, b long")


def _links_by_midpoints(fps: DataFrame, radius: int) -> DataFrame:
    """Links among fingerprints without pairs: two are within the radius exactly when balls of half of it meet."""
    ball = [
        int(np.uint64(sum(1 << i for i in bits)).view(np.int64))
        for k in range(radius // 2 + 1)
        for bits in combinations(range(BITS), k)
    ]
    steps = F.array(*[F.lit(x) for x in ball])
    points = fps.select("fp", F.explode(F.transform(steps, lambda x: F.col("fp").bitwiseXOR(x))).alias("point"))
    least = points.groupBy("point").agg(F.min("fp").alias("least"))
    # merged: Spark takes points for as large as the fingerprints they are exploded from, and would broadcast them
    met = points.hint("merge").join(least, "point").filter("fp <> least")
    return met.select(F.col("fp").alias("a"), F.col("least").alias("b")).distinct()


def close_links(distinct: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """(a, b) links between distinct fingerprints (column fp) whose components are those of all close pairs.

    Bucket sizes are counted first (with partial counts before the shuffle), so that only fingerprints that
    share a bucket are kept, and a bucket is gathered only up to ``bucket`` fingerprints of eight bytes. Sizes are
    merged with the banded fingerprints, which Spark takes for as few as those they are exploded from and would broadcast.
    """
    if radius % 2:
        raise ValueError("radius must be even: midpoints halve it")
    masked = [
        F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("key"))
        for i, m in enumerate(covering_masks(radius))
    ]
    banded = distinct.select("fp", F.explode(F.array(*masked)).alias("band")).select("fp", "band.mask", "band.key")
    shared = banded.groupBy("mask", "key").agg(F.count("*").alias("n")).filter("n > 1")
    members = written(banded.hint("merge").join(shared, ["mask", "key"]), "simhash-buckets")
    small = members.filter(F.col("n") <= bucket).groupBy("mask", "key").agg(F.collect_list("fp").alias("fps"))
    large = members.filter(F.col("n") > bucket).select("fp").distinct()
    return _links_in_buckets(small, radius).unionByName(_links_by_midpoints(large, radius)).distinct()


def simhash_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, radius: int = RADIUS,
    bucket: int = BUCKET,
) -> DataFrame:
    """(id, fingerprint, component_id) of every row of ``docs``.

    component_id is the smallest id that links reach. Null and empty texts, and texts without words, have
    fingerprint zero and link like any other; texts under ``words`` words are one shingle. Rows without an id
    connect others and get their component's id, null if nobody in it has one. Repeated ids and rows each
    give a row. Extra columns are ignored; an empty table gives no rows.
    """
    prints = written(fingerprints(docs, id_col, text_col, words), "simhash-prints")
    classes = written(prints.groupBy("fp").agg(F.min("id").alias("least")), "simhash-classes")
    found = connected_components(close_links(classes.select("fp"), radius, bucket))
    rooted = classes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("root")
    )
    rooted = written(rooted, "simhash-roots")
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root")
    return prints.join(named.select("fp", "component_id"), "fp").select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def first_of_groups(docs: DataFrame, groups: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each group of ``groups`` (id, component_id): the smallest id's.

    Rows without an id can't be named as copies and stay, exact repeats of them once.
    """
    copies = groups.filter(F.col(id_col) != F.col("component_id")).select(id_col).distinct()
    rest = docs.join(copies, id_col, "left_anti").select(docs.columns)
    nameless = F.when(F.col(id_col).isNull(), F.xxhash64(*docs.columns))
    return rest.withColumn("__nameless", nameless).dropDuplicates([id_col, "__nameless"]).drop("__nameless")


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each near-duplicate group: the smallest id's.

    Rows without an id can't be named as copies and stay, exact repeats of them once.
    """
    return first_of_groups(docs, simhash_groups(docs, id_col, text_col), id_col)


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))
