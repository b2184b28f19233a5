"""Near-duplicate embeddings: random-hyperplane signs in several tables, exact cosines, connected components.

Equal vectors of a label are one class first. A class's key in a table is the sign pattern of its products with
that table's hyperplanes. Classes that share a key are compared exactly, in blocks of bounded size, and a pair
that meets in several tables is counted in the first. A block returns one count per class and a tree of links,
never its pairs, so that large groups of copies stay linear in memory and output.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mlwatch.llm.components import connected_components
from mlwatch.llm.rows import by_batch, table
from mlwatch.sources.shared import written

THRESHOLD = 0.98
# Chance that a pair right at the threshold meets in no table.
MISS = 1e-6
# Classes compared at once; a fuller bucket is dealt out as pairs of blocks of about this size.
BLOCK = 1024
SEED = 7


def tables_for(rows: int, threshold: float = THRESHOLD, miss: float = MISS) -> tuple[int, int]:
    """(bits, tables): bits follow the logarithm of the largest label, so that unrelated vectors seldom share a
    key at any size; tables then follow from the wanted chance to miss a pair at the threshold."""
    bits = min(48, max(8, math.ceil(math.log2(max(2, rows)))))
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log(1 - meet))


def planes(dimension: int, bits: int, tables: int, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed + dimension).standard_normal((dimension, bits * tables))


def _keys(vectors: np.ndarray, bits: int, tables: int) -> np.ndarray:
    signs = (vectors @ planes(vectors.shape[1], bits, tables) > 0).reshape(len(vectors), tables, bits)
    return (signs.astype(np.int64) << np.arange(bits)).sum(axis=2)


def usable(vector: str = "embedding"):
    """Vectors that can have a cosine: not null, of some length, all components finite, not all zero."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))


def _signed(classes: DataFrame, bits: int, tables: int) -> DataFrame:
    """Adds ``keys``, the key of each table."""

    def run(batch: pa.RecordBatch) -> dict:
        column, keys = batch.column("v"), np.zeros((batch.num_rows, tables), np.int64)
        ends, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False).astype(np.float64)
        sizes = np.diff(ends)
        for size in np.unique(sizes):
            rows = np.flatnonzero(sizes == size)
            block = flat[ends[:-1][rows][:, None] + np.arange(size)]
            scale = np.abs(block).max(axis=1, keepdims=True)
            keys[rows] = _keys(block / scale, bits, tables)
        offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * tables)
        return {n: batch.column(n) for n in ("label", "id", "size", "v")} | {
            "keys": pa.ListArray.from_arrays(offsets, pa.array(keys.reshape(-1)))
        }

    kinds = dict(classes.dtypes)
    schema = f"label {kinds['label']}, id long, size long, v {kinds['v']}, keys array<long>"
    return by_batch(classes.select("label", "id", "size", "v"), run, schema)


def _tree(rows: np.ndarray, cols: np.ndarray, n: int) -> list[tuple[int, int]]:
    """The links (rows, cols) that first join two components."""
    up = list(range(n))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    kept = []
    for a, b in zip(rows.tolist(), cols.tolist()):
        x, y = root(a), root(b)
        if x != y:
            up[max(x, y)] = min(x, y)
            kept.append((a, b))
    return kept


def _compare(ids, sizes, vectors, keys, blocks, mask: int, threshold: float) -> tuple[np.ndarray, list]:
    """Per class the rows it links to, and a tree of links, for pairs that meet here first."""
    unit = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
    close = unit @ unit.T >= threshold
    if blocks.min() != blocks.max():  # a pair within one block is another comparison's
        close &= blocks[:, None] != blocks[None, :]
    a, b = np.nonzero(np.triu(close, 1))
    if mask and len(a):
        first = np.ones(len(a), bool)
        for t in range(mask):
            first &= keys[a, t] != keys[b, t]
        a, b = a[first], b[first]
    links = np.bincount(a, sizes[b], len(ids)) + np.bincount(b, sizes[a], len(ids))
    return links.astype(np.int64), [(int(ids[x]), int(ids[y])) for x, y in _tree(a, b, len(ids))]


def _linked(groups: DataFrame, threshold: float) -> DataFrame:
    """(a, b, n): b null for a count of rows that class a links to, otherwise a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masks = batch.column("mask").to_pylist()
            lists, out = batch.column("members"), ([], [], [])
            ends, flat = lists.offsets.to_numpy(), lists.values
            for mask, start, stop in zip(masks, ends[:-1].tolist(), ends[1:].tolist()):
                ids, sizes, v, keys, blocks = (flat.slice(start, stop - start).field(i) for i in range(5))
                ids, sizes, blocks = ids.to_numpy(), sizes.to_numpy(), blocks.to_numpy()
                n, lengths = len(ids), np.diff(v.offsets.to_numpy())
                keys = keys.flatten().to_numpy().reshape(n, -1)
                v_ends, v_flat = v.offsets.to_numpy() - v.offsets.to_numpy()[0], v.flatten().to_numpy()
                for size in np.unique(lengths):
                    rows = np.flatnonzero(lengths == size)
                    if len(rows) < 2:
                        continue
                    rows = rows[np.argsort(ids[rows])]  # trees then hang on small ids
                    block = v_flat[v_ends[:-1][rows][:, None] + np.arange(size)].astype(np.float64)
                    counts, tree = _compare(
                        ids[rows], sizes[rows], block, keys[rows], blocks[rows], mask, threshold
                    )
                    some = np.flatnonzero(counts)
                    out[0].extend(ids[rows][some].tolist() + [x for x, _ in tree])
                    out[1].extend([None] * len(some) + [y for _, y in tree])
                    out[2].extend(counts[some].tolist() + [0] * len(tree))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["a", "b", "n"])

    return groups.select("mask", "members").mapInArrow(run, "a long, b long, n long")


def near_vectors(
    rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label",
    threshold: float = THRESHOLD, miss: float = MISS, block: int = BLOCK,
) -> DataFrame:
    """(id, n_links, component_id, kept) of every row.

    Vectors of one label link at a cosine (in double precision) of ``threshold`` or more. n_links counts the
    other rows linked directly, component_id is the smallest id that links reach, kept is id = component_id.
    Rows whose vector is null, empty, zero or has null or non-finite components, or whose label or id is null,
    link with nothing: their component is their own id, and a row without id has a null component and is kept.
    Vectors of different lengths never link. Repeated ids are rows like others: equal ones link, and each
    counts. Extra columns are ignored; an empty table gives no rows.
    """
    plain = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector).alias("v"))
    plain = plain.withColumn("ok", usable("v") & F.col("label").isNotNull() & F.col("id").isNotNull())
    classes = plain.filter("ok").groupBy("label", "v").agg(F.min("id").alias("id"), F.count("*").alias("size"))
    # A repeated id with unequal vectors would name two classes: such a class goes by the id all the same, as the
    # rows of an id are one document.
    classes = written(classes, "vector-classes")
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    bits, tables = tables_for(largest, threshold, miss)
    signed = written(_signed(classes, bits, tables), "vector-keys")
    bands = signed.select("label", "id", F.posexplode("keys").alias("mask", "key"))
    full = bands.groupBy("label", "mask", "key").agg(F.count("*").alias("n")).filter("n > 1")
    members = bands.join(full, ["label", "mask", "key"]).withColumn("blocks", F.ceil(F.col("n") / block))
    own = F.pmod(F.xxhash64("id"), F.col("blocks"))
    dealt = members.withColumn("own", own).select(
        "label", "mask", "key", "id", "own", F.explode(F.expr("sequence(0L, blocks - 1)")).alias("other")
    )
    pair = (F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    dealt = dealt.select("label", "mask", "key", "id", "own", *pair)
    carried = dealt.join(signed.drop("label"), "id")
    groups = carried.groupBy("label", "mask", "key", "low", "high").agg(
        F.collect_list(F.struct("id", "size", "v", "keys", "own")).alias("members")
    )
    found = written(_linked(groups, threshold), "vector-links")
    counts = found.filter("b IS NULL").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    parts = connected_components(found.filter("b IS NOT NULL")).withColumnRenamed("node", "id")
    known = classes.join(counts, "id", "left").join(parts, "id", "left").select(
        "label", "v",
        (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links"),
        F.coalesce("component", "id").alias("component_id"),
    )
    linked = plain.filter("ok").join(known, ["label", "v"]).select("id", "n_links", "component_id")
    alone = plain.filter(~F.col("ok")).select("id", F.lit(0).cast("long"), "id")
    return linked.union(alone).select(
        F.col("id").alias(id_col), "n_links", "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"),
    )


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


OP8_SQL = """
WITH RECURSIVE ok AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND list_aggregate(list_transform(embedding, lambda x: abs(x::DOUBLE)), 'max') > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98
),
reach(a, b) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, r.c AS component_id, e.vec_id = r.c AS kept
FROM embeddings e
JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) r ON r.a = e.vec_id
LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) n ON n.a = e.vec_id
"""
