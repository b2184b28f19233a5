"""Reworded copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Candidates share a band of minimum hashes: of 24 bands of five, a pair at 0.8 misses all with chance 7e-5, a closer
pair with less. Candidate pairs that could join two groups are judged by the exact similarity of their whole sets, the
likeliest first, in rounds: a pair inside a group that is joined already can change nothing. Left out are pairs whose
estimate, the share of equal minimum hashes, lies five standard deviations under the threshold: one that belongs
together has that with a chance of at most 3e-6.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mlwatch.llm.components import connected_components
from mlwatch.llm.rows import by_batch
from mlwatch.llm.simhash import first_of_groups
from mlwatch.sources.shared import discard, written

WORDS = 5
# Least similarity of copies, as a whole ratio.
ALIKE, OF = 4, 5
BANDS, HASHES = 24, 5
SEED = 42
# A pair whose share of equal minimum hashes is five standard deviations below the threshold is not judged.
FLOOR = ALIKE / OF - 5 * (ALIKE * (OF - ALIKE) / OF**2 / (BANDS * HASHES)) ** 0.5
# Members of a bucket are compared in pairs of blocks of about so many.
BLOCK = 1024
# Shingles are hashed in pieces of so many.
PIECE = 1024
_FACTORS = np.random.default_rng(SEED).integers(1 << 62, 1 << 63, BANDS * HASHES, np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The distinct hashes of the text's shingles, sorted; a text under ``words`` words is one, one without words none."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    line, n = b" ".join(tokens), max(1, len(tokens) - words + 1)
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(lengths + 1) - 1
    starts, ends = (ends - lengths)[:n].tolist(), ends[min(words, len(tokens)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts, ends)), np.uint64, n))


def least_hashes(found: np.ndarray) -> np.ndarray:
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), PIECE):
        least = np.minimum(least, np.multiply.outer(_FACTORS, found[at : at + PIECE]).min(axis=1))
    return least


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets have the similarity of copies, in whole numbers."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return OF * shared >= ALIKE * (len(a) + len(b) - shared)


def _prints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def run(batch: pa.RecordBatch) -> dict:
        found = [shingles(t) for t in batch.column(1).to_pylist()]
        least = [least_hashes(x) if len(x) else None for x in found]
        bands = [
            None if x is None else [
                xxhash.xxh64_intdigest(part.tobytes(), i) - (1 << 63) for i, part in enumerate(x.reshape(BANDS, HASHES))
            ]
            for x in least
        ]
        return {
            "id": batch.column(0),
            "key": pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in found], pa.binary()),
            "bands": pa.array(bands, pa.list_(pa.int64())),
            "sample": pa.array([x if x is None else x.astype(np.uint16).tobytes() for x in least], pa.binary()),
            "at": batch.column(2),
        }

    schema = "id long, key binary, bands array<long>, sample binary, at long"
    id = F.col(id_col).cast("long")
    return by_batch(docs.select(id.alias("id"), text_col, _at(id, text_col).alias("at")), run, schema)


def _at(id: Column, text_col: str) -> Column:
    """What a row is found by again: its id, or a hash of its text. Others may have the same."""
    return F.coalesce(id, F.xxhash64(text_col))


def _sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, found): the whole set of each wanted (key, at), made from the texts again, as texts move in less room."""

    def run(batch: pa.RecordBatch) -> dict:
        found = [shingles(t).tobytes() for t in batch.column(1).to_pylist()]
        good = [xxhash.xxh3_128_digest(x) == k for x, k in zip(found, batch.column(0).to_pylist())]
        return {
            "key": batch.column(0).filter(pa.array(good)), "found": pa.array([x for x, g in zip(found, good) if g], pa.binary())
        }

    texts = docs.select(_at(F.col(id_col).cast("long"), text_col).alias("at"), text_col)
    found = by_batch(texts.join(wanted, "at").select("key", text_col), run, "key binary, found binary")
    return found.dropDuplicates(["key"])


def bucket_pairs(
    keys: list[bytes], groups: list[bytes], samples: np.ndarray, start: int, stop: int
) -> tuple[list[tuple[bytes, bytes]], bool]:
    """Pairs of different groups at places ``start`` to ``stop`` of a member's likeliest copies, and whether more follow."""
    _, group = np.unique(np.array(groups, object), return_inverse=True)
    if not group.any():
        return [], False
    pairs, more, n = [], False, len(keys)
    for i in range(n):
        share = (samples == samples[i]).mean(axis=1)
        near = np.flatnonzero(share >= FLOOR)
        near = near[near != i]
        near = near[np.lexsort(((near - i) % n, -share[near]))]  # equal ones go round, so that no member is in all pairs
        other = group[near] != group[i]
        pairs += [tuple(sorted((keys[i], keys[j]))) for j in near[start:stop][other[start:stop]]]
        more = more or bool(other[stop:].any())
    return pairs, more


def _candidates(
    members: DataFrame, groups: DataFrame | None, start: int, stop: int, within: bool = False
) -> DataFrame:
    """(a, b) pairs of this round, ``within`` blocks or across them; a row of nulls says that more follow."""
    if groups is None:
        named = members.withColumn("component", F.col("key"))
    else:
        named = members.join(groups.withColumnRenamed("node", "key"), "key", "left")
        named = named.withColumn("component", F.coalesce("component", "key"))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("key"), blocks).cast("int")
    others = F.array(own) if within else F.sequence(F.lit(0), blocks - 1)
    dealt = named.withColumn("own", own).withColumn("other", F.explode(others))
    at = ["band", "value", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q")]
    gathered = dealt.groupBy(*at).agg(F.array_sort(F.collect_list(F.struct("key", "component", "sample"))).alias("m"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: set = set()
            for rows in batch.column(0):
                rows = rows.as_py()
                samples = np.frombuffer(b"".join(r["sample"] for r in rows), np.uint16).reshape(len(rows), -1)
                pairs, more = bucket_pairs([r["key"] for r in rows], [r["component"] for r in rows], samples, start, stop)
                out.update(pairs)
                if more:
                    out.add((None, None))
            sides = list(zip(*out)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(s, pa.binary()) for s in sides], ["a", "b"])

    return gathered.select("m").mapInArrow(run, "a binary, b binary").distinct()


def _judged(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    side = lambda x: sets.select(F.col("key").alias(x), F.col("found").alias(f"found_{x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = zip(batch.column(2), batch.column(3))
            good = [alike(*(np.frombuffer(x.as_buffer(), np.uint64) for x in both)) for both in whole]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    joined = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "found_a", "found_b")
    return joined.mapInArrow(run, "a binary, b binary")


def copy_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, component_id) of every row: the smallest id that links between copies reach.

    Null and empty texts, and texts without words, are copies of each other. Rows without an id connect others.
    """
    prints = written(_prints(docs, id_col, text_col), "reworded-prints")
    classes = prints.filter("bands IS NOT NULL").groupBy("key").agg(F.min("at").alias("at"), F.first("sample").alias("sample"))
    banded = prints.filter("bands IS NOT NULL").select("key", "bands").dropDuplicates(["key"])
    banded = banded.select("key", F.posexplode("bands").alias("band", "value"))
    shared = banded.groupBy("band", "value").agg(F.count("*").alias("n")).filter("n > 1")
    # merged: Spark takes the bands for as many as the texts they are exploded from, and would broadcast them
    buckets = written(banded.hint("merge").join(shared, ["band", "value"]), "reworded-buckets")
    named = written(classes.join(buckets.select("key").distinct(), "key"), "reworded-classes")
    members = written(buckets.join(named.select("key", "sample"), "key"), "reworded-members")
    sets = written(_sets(docs, named.select("key", "at"), id_col, text_col), "reworded-sets")
    discard(buckets)
    discard(named)
    # Large groups are joined by one band of each member first, within blocks, then across them: what the rounds over
    # all bands still have to compare are pairs of different groups.
    leading = members.join(members.groupBy("key").agg(F.min("band").alias("band")), ["key", "band"])
    links, groups, start, stop = None, None, 0, 2
    for some, within in chain([(leading, True), (leading, False)], repeat((members, False))):
        pairs = written(_candidates(some, groups, start, stop, within), "reworded-pairs")
        found = written(_judged(pairs.filter("a IS NOT NULL"), sets), "reworded-links")
        links = found if links is None else links.unionByName(found)
        more = not pairs.filter("a IS NULL").isEmpty()
        groups = written(connected_components(links), "reworded-groups")
        discard(pairs)
        if some is members:
            if not more:
                break
            start, stop = stop, 3 * stop
    discard(members)
    discard(sets)
    rooted = prints.select("id", "key").join(groups.withColumnRenamed("node", "key"), "key", "left")
    rooted = rooted.select("id", F.coalesce("component", "key").alias("root"))
    least = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    return rooted.join(least, "root").select(F.col("id").alias(id_col), "component_id")


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of reworded copies: the smallest id's. Rows without an id stay."""
    return first_of_groups(docs, copy_groups(docs, id_col, text_col), id_col)
