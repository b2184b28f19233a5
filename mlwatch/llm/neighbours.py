"""Approximate nearest neighbours by inner product: a navigable small-world graph per shard, shard results merged.

Every row goes to the cell of its nearest coarse centroid; a cell is one shard, or several of bounded size where it
is full. A shard's graph is built in one task and stored as flat arrays: vectors, ids, and per level one padded
matrix of neighbours. Inner products become cosines by one more component that lifts each vector to the largest
length. Equal vectors of a shard are one node that lists its ids. A query visits the shards of its few nearest cells
and the results are merged, so a query's work doesn't grow with the number of cells.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mlwatch.llm.matrices import by_length
from mlwatch.llm.rows import hashed_below, table
from mlwatch.llm.vector_dedup import usable
from mlwatch.sources.shared import written

SHARD_ROWS = 4096
QUERY_BLOCK = 2048
# Cells that a query visits (all, if there are fewer).
PROBES = 32
# Coarse centroids, at most: beyond MOST_CELLS x SHARD_ROWS rows of a dimension cells have several shards each.
MOST_CELLS = 16_384
# Rows that the centroids are fitted on, about: a bound on fitting alone; every row is indexed.
SAMPLE_ROWS = 65_536
DEGREE = 16
EF_BUILD = 80
# Candidates that the searches of one query keep, together and, at least, in each shard.
EF_SEARCH = 320
EF_LEAST = 40
# Nodes that a search opens at once.
STEP = 4


class Graph:
    """A small-world graph over unit vectors; level 0 holds twice the degree."""

    def __init__(self, vectors: np.ndarray, degree: int = DEGREE, ef: int = EF_BUILD, seed: int = 1):
        self.vectors, n = vectors, len(vectors)
        draws = np.random.default_rng(seed).random(n)
        self.levels = np.minimum(8, (-np.log(np.maximum(draws, 1e-12)) / math.log(degree)).astype(np.int32))
        self.links = [
            np.full((n, degree * (2 if level == 0 else 1)), -1, np.int32) for level in range(self.levels.max() + 1)
        ]
        self.filled = [np.zeros(n, np.int32) for _ in self.links]
        self.start = 0
        for node in range(1, n):
            self._insert(node, degree, ef)

    def _insert(self, node: int, degree: int, ef: int) -> None:
        q, top, at = self.vectors[node], int(self.levels[self.start]), [self.start]
        for level in range(top, -1, -1):
            if level > self.levels[node]:
                at = [x for _, x in self.search_level(q, at, 1, level)]
                continue
            near = self.search_level(q, at, ef, level)
            at = [x for _, x in near]
            chosen = self._spread(q, np.array(at), degree)
            self.links[level][node, : len(chosen)] = chosen
            self.filled[level][node] = len(chosen)
            for other in chosen.tolist():
                self._link(other, node, level)
        if self.levels[node] > top:
            self.start = node

    def _link(self, at: int, to: int, level: int) -> None:
        links, n = self.links[level], int(self.filled[level][at])
        if n < links.shape[1]:
            links[at, n], self.filled[level][at] = to, n + 1
            return
        pool = np.append(links[at], to)
        pool = pool[np.argsort(-(self.vectors[pool] @ self.vectors[at]), kind="stable")]
        kept = self._spread(self.vectors[at], pool, links.shape[1])
        links[at, : len(kept)], links[at, len(kept) :] = kept, -1
        self.filled[level][at] = len(kept)

    def _spread(self, q: np.ndarray, pool: np.ndarray, most: int) -> np.ndarray:
        """Up to ``most`` of ``pool`` (nearest first): those nearer to q than to any taken before, then the nearest."""
        if len(pool) <= most // 2:
            return pool
        own = self.vectors[pool]
        to_q, among = own @ q, own @ own.T
        taken, blocked = [], np.zeros(len(pool), bool)
        for i in range(len(pool)):
            if not blocked[i]:
                taken.append(i)
                if len(taken) == most:
                    break
                blocked |= among[i] > to_q
        rest = [i for i in range(len(pool)) if i not in set(taken)]
        return pool[taken + rest[: most - len(taken)]]

    def search_level(self, q: np.ndarray, start: list[int], ef: int, level: int) -> list[tuple[float, int]]:
        """Up to ``ef`` (similarity, node) pairs found near q from ``start``, nearest first."""
        vectors, links = self.vectors, self.links[level]
        seen = np.zeros(len(vectors), bool)
        seen[start] = True
        best = [(float(s), x) for s, x in zip(vectors[start] @ q, start)]
        todo = [(-s, x) for s, x in best]
        heapq.heapify(best)
        heapq.heapify(todo)
        while len(best) > ef:
            heapq.heappop(best)
        while todo:
            nodes: list[int] = []
            while todo and len(nodes) < STEP and (len(best) < ef or -todo[0][0] >= best[0][0]):
                nodes.append(heapq.heappop(todo)[1])
            if not nodes:
                break
            near = links[nodes].ravel()
            near = near[near >= 0]
            near = np.unique(near[~seen[near]])
            if not len(near):
                continue
            seen[near] = True
            sims = vectors[near] @ q
            if len(best) >= ef:
                good = sims > best[0][0]
                near, sims = near[good], sims[good]
            for s, x in zip(sims.tolist(), near.tolist()):
                if len(best) < ef:
                    heapq.heappush(best, (s, x))
                elif s > best[0][0]:
                    heapq.heapreplace(best, (s, x))
                else:
                    continue
                heapq.heappush(todo, (-s, x))
        return sorted(best, reverse=True)

    def search(self, q: np.ndarray, ef: int) -> list[tuple[float, int]]:
        at = [self.start]
        for level in range(int(self.levels[self.start]), 0, -1):
            at = [x for _, x in self.search_level(q, at, 1, level)]
        return self.search_level(q, at, ef, 0)

    def arrays(self) -> dict:
        flat = {"start": np.int64(self.start), "levels": self.levels}
        for i, (links, filled) in enumerate(zip(self.links, self.filled)):
            nodes = np.flatnonzero(self.levels >= i).astype(np.int32)
            flat |= {f"nodes{i}": nodes, f"links{i}": links[nodes], f"filled{i}": filled[nodes]}
        return flat

    @classmethod
    def of(cls, vectors: np.ndarray, flat: dict) -> Graph:
        self = cls.__new__(cls)
        self.vectors, self.start, self.levels, self.links, self.filled = (
            vectors, int(flat["start"]), flat["levels"], [], [],
        )
        for i in range(int(self.levels.max(initial=0)) + 1):
            nodes, some = flat[f"nodes{i}"], flat[f"links{i}"]
            links, filled = np.full((len(vectors), some.shape[1]), -1, np.int32), np.zeros(len(vectors), np.int32)
            links[nodes], filled[nodes] = some, flat[f"filled{i}"]
            self.links.append(links)
            self.filled.append(filled)
        return self


def lifted(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors whose cosines with (q, 0) order as the inner products of ``vectors`` with q."""
    squares = (vectors * vectors).sum(axis=1)
    most = squares.max()
    out = np.concatenate([vectors, np.sqrt(np.maximum(0, most - squares))[:, None]], axis=1)
    return (out / math.sqrt(most)).astype(np.float32)


def _packed(arrays: dict) -> bytes:
    import io

    buffer = io.BytesIO()
    np.savez(buffer, **arrays)
    return buffer.getvalue()


def _unpacked(data: bytes) -> dict:
    import io

    with np.load(io.BytesIO(data)) as found:
        return {k: found[k] for k in found.files}


def _tasks(shards: int) -> int:
    """Partitions for so many shards: small ones are not merged, as a graph takes long for its bytes."""
    return max(1, shards, min(4 * shards, 256))


@dataclass(frozen=True)
class Index:
    """(dimension, cell, part, graph) rows, and the coarse centroids of each dimension."""

    graphs: DataFrame
    centroids: dict[int, np.ndarray]


def coarse_centroids(sample: np.ndarray, cells: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """Unit centroids of unit vectors by spherical k-means; a centroid without members keeps its place."""
    sample = sample[np.lexsort(sample.T[::-1])]
    start = np.random.default_rng(seed).permutation(len(sample))[:cells]
    centroids = sample[np.sort(start)]
    for _ in range(rounds):
        member = _nearest_cells(sample, centroids, 1)[:, 0]
        sums = np.zeros_like(centroids, dtype=np.float64)
        np.add.at(sums, member, sample)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norms > 0, sums / np.where(norms > 0, norms, 1), centroids).astype(np.float32)
    return centroids


def _nearest_cells(vectors: np.ndarray, centroids: np.ndarray, most: int) -> np.ndarray:
    """The ``most`` cells of each vector (all, if fewer) by inner product, in blocks of bounded size."""
    out, step = [], max(1, (1 << 22) // max(1, len(centroids)))
    for at in range(0, len(vectors), step):
        sims = vectors[at : at + step] @ centroids.T
        if most == 1:
            out.append(sims.argmax(axis=1)[:, None])
        elif most >= len(centroids):
            out.append(np.tile(np.arange(len(centroids)), (len(sims), 1)))
        else:
            out.append(np.argpartition(-sims, most - 1, axis=1)[:, :most])
    return np.concatenate(out) if out else np.zeros((0, most), np.int64)


def _routed(rows: DataFrame, centroids: dict[int, np.ndarray], longest: dict[int, float] | None, most: int) -> DataFrame:
    """(id, v, dimension, cell), once for each of a vector's ``most`` nearest cells.

    Rows to be stored are lifted to the ``longest`` square length of their dimension; queries (no ``longest``) are not.
    Rows of a dimension without centroids have nowhere to go.
    """
    held = rows.sparkSession.sparkContext.broadcast((centroids, longest))  # MOST_CELLS vectors a dimension

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, longest = held.value
        for batch in batches:
            for d, at, v in by_length(batch.column(1)):
                if d not in centroids:
                    continue
                squares = (v * v).sum(axis=1)
                top = squares if longest is None else np.full(len(v), longest[d])
                lift = np.concatenate([v, np.sqrt(np.maximum(0, top - squares))[:, None]], axis=1)
                cells = _nearest_cells((lift / np.sqrt(top)[:, None]).astype(np.float32), centroids[d], most)
                again = pa.array(np.repeat(at, cells.shape[1]))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(again), batch.column(1).take(again),
                        pa.array(np.full(len(again), d, np.int32)), pa.array(cells.ravel().astype(np.int32)),
                    ],
                    ["id", "v", "dimension", "cell"],
                )

    return rows.select("id", "v").mapInArrow(run, "id long, v array<double>, dimension int, cell int")


def _usable_rows(rows: DataFrame, id_col: str, vector: str) -> DataFrame:
    return rows.filter(usable(vector) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")
    )


def build_index(
    rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding", shard_rows: int = SHARD_ROWS,
    degree: int = DEGREE, ef: int = EF_BUILD, sample_rows: int = SAMPLE_ROWS, most_cells: int = MOST_CELLS,
) -> Index:
    """One stored graph per shard of about ``shard_rows`` rows; every usable row is in one.

    Null, zero, empty and non-finite vectors and rows without an id take no part. Vectors of different lengths
    have graphs of their own. The coarse centroids come from about ``sample_rows`` rows of each dimension.
    """
    good = _usable_rows(rows, id_col, vector).withColumn("dimension", F.size("v"))
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    sizes = good.groupBy("dimension").agg(F.count("*").alias("n"), F.max(square).alias("longest")).collect()
    centroids, longest = {}, {r.dimension: r.longest for r in sizes}  # one row per dimension
    for d, n, top in sorted(sizes):
        drawn = hashed_below(F.xxhash64(F.lit(17), F.col("id")), sample_rows, n)
        sample = good.filter((F.col("dimension") == d) & drawn).select("v").toArrow().column(0).combine_chunks()
        v = np.concatenate([x for _, _, x in by_length(sample)] or [np.zeros((0, d))])
        lift = np.sqrt(np.maximum(0, top - (v * v).sum(axis=1)))
        unit = (np.concatenate([v, lift[:, None]], axis=1) / math.sqrt(top)).astype(np.float32)
        centroids[d] = coarse_centroids(unit, min(most_cells, math.ceil(n / shard_rows)))
    placed = written(_routed(good, centroids, longest, 1), "ann-cells")
    share = F.greatest(F.lit(1), F.round(F.count("*") / shard_rows))
    full = placed.groupBy("dimension", "cell").agg(share.cast("long").alias("parts"))
    dealt = placed.join(full, ["dimension", "cell"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))

    def build(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id")
        vectors, ids = np.stack(group["v"].to_numpy()), group["id"].to_numpy()
        distinct, node = np.unique(vectors, axis=0, return_inverse=True)
        node = node.reshape(-1)
        order = np.argsort(node, kind="stable")  # ids of a node in ascending order
        ends = np.searchsorted(node[order], np.arange(len(distinct) + 1)).astype(np.int64)
        graph = Graph(lifted(distinct), degree, ef)
        arrays = graph.arrays() | {"vectors": distinct, "ids": ids[order], "ends": ends}
        key = {k: [group[k].iloc[0]] for k in ("dimension", "cell", "part")}
        return pd.DataFrame(key | {"graph": [_packed(arrays)]})

    shards = sum(math.ceil(r.n / shard_rows) for r in sizes)
    apart = dealt.repartition(_tasks(shards), "dimension", "cell", "part")
    graphs = apart.groupBy("dimension", "cell", "part").applyInPandas(
        build, "dimension int, cell int, part int, graph binary"
    )
    return Index(written(graphs, "ann-index"), centroids)


def _searched(pairs: DataFrame, k: int, ef: dict[int, int]) -> DataFrame:
    """Best k of each (graph, block of queries); ``ef`` has the candidates to keep, by dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, graph = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                key = tuple(batch.column(c)[i].as_py() for c in range(3))
                if key != shard:  # blocks of one shard come one after another and share its graph
                    flat = _unpacked(batch.column(3)[i].as_py())
                    vectors, ids, ends = flat["vectors"], flat["ids"], flat["ends"]
                    shard, graph = key, Graph.of(lifted(vectors), flat)
                out = ([], [], [])
                for query in batch.column(4)[i].as_py():
                    q = np.array(query["v"], np.float64)
                    unit = np.append(q / math.sqrt(float(q @ q)), 0).astype(np.float32)
                    nodes = np.array([x for _, x in graph.search(unit, max(ef[key[0]], k + 1))])
                    scores = (vectors[nodes] * q).sum(axis=1)
                    found = []
                    for at in np.argsort(-scores, kind="stable"):
                        # of a node's equal vectors the smallest ids come first; one may be the query's own
                        if len(found) > k and scores[at] < found[k][0]:
                            break
                        node = nodes[at]
                        some = ids[ends[node] : min(ends[node + 1], ends[node] + k + 1)]
                        found += [(float(scores[at]), int(x)) for x in some if x != query["id"]]
                    found = sorted(found, key=lambda x: (-x[0], x[1]))[:k]
                    out[0].extend([query["id"]] * len(found))
                    out[1].extend(x for _, x in found)
                    out[2].extend(s for s, _ in found)
                kinds = (pa.int64(), pa.int64(), pa.float64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, kind) for x, kind in zip(out, kinds)], ["query_id", "vec_id", "score"]
                )

    keys = ["dimension", "cell", "part"]
    return pairs.sortWithinPartitions(*keys).select(*keys, "graph", "queries").mapInArrow(run, "query_id long, vec_id long, score double")


def nearest(
    index: Index, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector: str = "embedding",
    ef: int = EF_SEARCH, block: int = QUERY_BLOCK, probes: int = PROBES,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each query, its own id left out.

    score is the inner product in double precision, ties go to the smaller id, and there are fewer ranks where
    there are fewer candidates in the visited cells. The searches of a query share ``ef`` candidates, as the results
    are spread over its shards. Queries that aren't usable vectors or have no id give no rows;
    queries with the same id and vector count once. The queries of a shard, however many, are searched in blocks.
    """
    good = _usable_rows(queries, id_col, vector).distinct()
    routed = written(_routed(good, index.centroids, None, probes), "ann-queries")
    shards = index.graphs.select("dimension", "cell", "part")
    cell, shard = ["dimension", "cell"], ["dimension", "cell", "part"]
    blocks = routed.groupBy(*cell).agg(F.ceil(F.count("*") / block).alias("blocks"))
    packed = (
        routed.join(blocks, cell)
        .groupBy(*cell, F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block"))
        .agg(F.collect_list(F.struct("id", "v")).alias("queries"))  # about ``block`` of them
    )
    tasks = _tasks(shards.count())
    sent = packed.join(shards, cell).repartition(tasks, *shard)
    pairs = index.graphs.repartition(tasks, *shard).join(sent, shard)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    kept = {d: max(EF_LEAST, math.ceil(ef / min(probes, len(c)))) for d, c in index.centroids.items()}
    ranked = _searched(pairs, k, kept).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return nearest(build_index(rows), rows.filter(F.col("vec_id") % 20 == 0))
