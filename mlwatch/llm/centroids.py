"""Centroid clustering in whole numbers over subvector dictionaries.

Vectors become integers and are cut into blocks of dimensions. A shard of rows keeps, for every block, its
distinct subvectors and one code per row: nothing is lost, and the shard's dictionaries never exceed its rows. A
round works out the squared distance of each distinct subvector to each centroid's block once; a row's distances are
sums of these by code, and the sums of a cluster are its code counts times the dictionary. Rows don't move
between rounds: only sums per centroid are shuffled.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mlwatch.llm.rows import table
from mlwatch.sources.shared import written

CENTROIDS = 16
ROUNDS = 3
DIMENSIONS = 64
SCALE = 64
# Dimensions of a block: with two, a few hundred subvectors stand for the rows of a shard.
WIDTH = 2
SHARD_ROWS = 8192
# Largest size of a scaled component: squared distances of up to 64 dimensions then fit a long.
LIMIT = 1 << 27


def whole_vectors(rows: DataFrame, id_col: str, vector: str, dimensions: int, scale: int) -> DataFrame:
    """(id, x): vectors of ``dimensions`` finite components, scaled and rounded down to whole numbers.

    Null vectors, other lengths, null or non-finite components take no part; nor do components of more than
    ``LIMIT`` after scaling, whose distances would not fit a long.
    """
    x = F.col(vector).cast("array<double>")
    fits = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * scale) <= LIMIT))
    good = F.col(vector).isNotNull() & (F.size(x) == dimensions) & fits
    scaled = F.transform(x, lambda c: F.floor(c * scale).cast("int"))
    return rows.filter(good).select(F.col(id_col).alias("id"), scaled.alias("x"))


def first_centroids(vectors: DataFrame, k: int, seed: str = "1") -> np.ndarray:
    """The ``k`` vectors (all, if fewer) with the smallest SHA-256 of ``seed:id``, ties by their components.

    A top-k: each partition keeps its ``k`` smallest before they meet. A null id is hashed as an empty text.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    return np.array([r.x for r in vectors.select(digest.alias("digest"), "x").orderBy("digest", "x").limit(k).collect()], np.int64)


def dictionary(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct rows, code of each row) of a block of dimensions."""
    low = block.min(axis=0).astype(np.int64)
    spans = [int(s) for s in block.max(axis=0) - low + 1]
    cells = 1
    for span in spans:
        cells *= span
    if cells >= 1 << 62:  # too wide to number the cells
        found, codes = np.unique(block, axis=0, return_inverse=True)
        return found, codes.reshape(-1)
    number = np.zeros(len(block), np.int64)
    for d, span in enumerate(spans):
        number = number * span + (block[:, d] - low[d])
    _, first, codes = np.unique(number, return_index=True, return_inverse=True)
    return block[first], codes.reshape(-1)


def shards(vectors: DataFrame, dimensions: int, width: int = WIDTH) -> DataFrame:
    """(ids, sizes, entries, codes): shards of up to ``SHARD_ROWS`` rows as dictionaries and codes.

    ``sizes`` counts the dictionary entries of each block, ``entries`` holds them one after another and ``codes``
    the rows' codes, block by block (32-bit integers).
    """
    kind = dict(vectors.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SHARD_ROWS):
                part = batch.slice(start, SHARD_ROWS)
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)
                found = [dictionary(x[:, at : at + width]) for at in range(0, dimensions, width)]
                ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0))
                sizes = pa.array([[len(entries) for entries, _ in found]], pa.list_(pa.int32()))
                entries = b"".join(np.ascontiguousarray(e, np.int32).tobytes() for e, _ in found)
                codes = b"".join(c.astype(np.int32).tobytes() for _, c in found)
                yield pa.RecordBatch.from_arrays(
                    [ids, sizes, pa.array([entries], pa.binary()), pa.array([codes], pa.binary())],
                    ["ids", "sizes", "entries", "codes"],
                )

    return vectors.select("id", "x").mapInArrow(run, f"ids array<{kind}>, sizes array<int>, entries binary, codes binary")


def unpacked(batch: pa.RecordBatch, width: int, dimensions: int) -> Iterator[tuple[pa.Array, list]]:
    """(ids, [(dictionary, codes) of each block]) of each shard of a batch."""
    names = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
    for i in range(batch.num_rows):
        ids = names["ids"][i].values
        flat = np.frombuffer(names["entries"][i].as_py(), np.int32)
        codes = np.frombuffer(names["codes"][i].as_py(), np.int32).reshape(-1, len(ids))
        blocks, at = [], 0
        for b, size in enumerate(names["sizes"][i].as_py()):
            wide = min(width, dimensions - b * width)
            blocks.append((flat[at : at + size * wide].reshape(size, wide).astype(np.int64), codes[b]))
            at += size * wide
        yield ids, blocks


def nearest(blocks: list, centroids: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(nearest centroid, squared distance) of each row of a shard; ties go to the smaller number."""
    distances, at = np.zeros((rows, len(centroids)), np.int64), 0
    for entries, codes in blocks:
        apart = entries[:, None, :] - centroids[None, :, at : at + entries.shape[1]]
        distances += (apart * apart).sum(axis=2)[codes]
        at += entries.shape[1]
    cluster = distances.argmin(axis=1)
    return cluster, distances[np.arange(rows), cluster]


def _moved(encoded: DataFrame, centroids: np.ndarray, width: int) -> np.ndarray:
    """The centroids after one round: rounded-down means of the vectors nearest to them; empty ones stay."""
    k, dimensions = centroids.shape
    held = encoded.sparkSession.sparkContext.broadcast(centroids)  # k vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, sums = held.value, defaultdict(int)
        for batch in batches:
            for ids, blocks in unpacked(batch, width, dimensions):
                cluster, _ = nearest(blocks, centroids, len(ids))
                for c, n in enumerate(np.bincount(cluster, minlength=k).tolist()):
                    sums[c, -1] += n
                at = 0
                for entries, codes in blocks:
                    counts = np.bincount(cluster * len(entries) + codes, minlength=k * len(entries))
                    parts = counts.reshape(k, -1).astype(np.int64) @ entries
                    for c in range(k):
                        for d in range(entries.shape[1]):
                            sums[c, at + d] += int(parts[c, d])
                    at += entries.shape[1]
        keys = sorted(sums)
        columns = [
            pa.array([c for c, _ in keys], pa.int32()),
            pa.array([d for _, d in keys], pa.int32()),
            pa.array([Decimal(sums[key]) for key in keys], pa.decimal128(38, 0)),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["cluster", "part", "total"])

    sums = encoded.select("ids", "sizes", "entries", "codes").mapInArrow(run, "cluster int, part int, total decimal(38,0)")
    totals = {(r[0], r[1]): int(r[2]) for r in sums.groupBy("cluster", "part").agg(F.sum("total")).collect()}
    moved = centroids.copy()
    for c in range(k):
        if n := totals.get((c, -1), 0):
            moved[c] = [totals[c, d] // n for d in range(dimensions)]
    return moved


def _assigned(encoded: DataFrame, centroids: np.ndarray, width: int) -> DataFrame:
    """(id, cluster, distance) of every vector."""
    dimensions = centroids.shape[1]
    held = encoded.sparkSession.sparkContext.broadcast(centroids)
    kind = dict(encoded.dtypes)["ids"].removeprefix("array<").removesuffix(">")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, blocks in unpacked(batch, width, dimensions):
                cluster, distance = nearest(blocks, held.value, len(ids))
                columns = [ids, pa.array(cluster.astype(np.int32)), pa.array(distance)]
                yield pa.RecordBatch.from_arrays(columns, ["id", "cluster", "distance"])

    return encoded.mapInArrow(run, f"id {kind}, cluster int, distance long")


def _by_cluster(values: list, cluster: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), cluster)


def clustered(
    rows: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, id_col: str = "vec_id", vector: str = "embedding",
    dimensions: int = DIMENSIONS, scale: int = SCALE, width: int = WIDTH,
) -> tuple[DataFrame, np.ndarray]:
    """((id, cluster, distance, cluster_inertia, inertia), final centroids).

    One row per kept vector (:func:`whole_vectors`), repeated rows and null ids too; with fewer vectors than ``k``
    there are as many centroids as vectors, and no vectors give no rows. Extra columns are ignored. What is
    broadcast, or meets the driver, are ``k`` vectors and sums per centroid, whatever the rows.
    """
    vectors = whole_vectors(rows, id_col, vector, dimensions, scale)
    encoded = written(shards(vectors, dimensions, width), "centroid-shards")
    centroids = first_centroids(vectors, k)
    if not len(centroids):
        kind = dict(vectors.dtypes)["id"]
        schema = f"{id_col} {kind}, cluster int, distance long, cluster_inertia long, inertia long"
        return rows.sparkSession.createDataFrame([], schema), centroids.reshape(0, dimensions)
    for _ in range(rounds):
        centroids = _moved(encoded, centroids, width)
    found = written(_assigned(encoded, centroids, width), "centroid-members")
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()
    inertia = {r[0]: int(r[1]) for r in sums}  # k sums
    of_cluster = _by_cluster([inertia.get(c, 0) for c in range(len(centroids))], F.col("cluster"))
    total = F.lit(sum(inertia.values()))
    out = found.select(
        F.col("id").alias(id_col), "cluster", "distance", of_cluster.cast("long").alias("cluster_inertia"),
        total.cast("long").alias("inertia"),
    )
    return out, centroids


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = clustered(table(spark, sf_dir, "embeddings"))
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    return found.withColumn("centroid_sha256", _by_cluster(digests or [""], F.col("cluster")))


def _round(before: str, now: str) -> str:
    """SQL of one round: means of the members of the centroids ``before``; exact division rounding down."""
    return f"""
      {now}_parts as (select cluster, p, sum(v[p]) as s, count(*) as n
        from (select a.cluster, r.v from {before}_near a join kept r using (row_id)) m, range(1, 65) t(p) group by all),
      {now} as (select c.cluster, coalesce(m.v, c.v) as v from {before} c left join (
        select cluster, list(cast((s - ((s % n) + n) % n) // n as bigint) order by p) as v from {now}_parts group by cluster
        ) m using (cluster)),
      {_near(now)}"""


def _near(of: str) -> str:
    return f"""{of}_near as (select row_id, arg_min(cluster, (d, cluster)) as cluster, min(d) as d from (
        select r.row_id, c.cluster,
          list_sum(list_transform(list_zip(r.v, c.v), lambda z: cast((z[1] - z[2]) * (z[1] - z[2]) as bigint))) as d
        from kept r cross join {of} c) e group by row_id)"""


OP12_SQL = f"""
    with kept as materialized (
      select row_number() over () as row_id, vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as v
      from embeddings where len(embedding) = 64
        and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
      c0 as (select cast(row_number() over (order by sha256('1:' || vec_id)) - 1 as int) as cluster, v from kept
        order by sha256('1:' || vec_id) limit 16),
      {_near("c0")}, {_round("c0", "c1")}, {_round("c1", "c2")}, {_round("c2", "c3")}
    select vec_id, cast(n.cluster as int) as cluster, cast(n.d as bigint) as distance,
      cast(sum(n.d) over (partition by n.cluster) as bigint) as cluster_inertia, cast(sum(n.d) over () as bigint) as inertia,
      sha256(array_to_string(c3.v, ',')) as centroid_sha256
    from kept join c3_near n using (row_id) join c3 on c3.cluster = n.cluster"""
