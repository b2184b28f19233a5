"""Sources mixed to target weights by Pfair scheduling of their blocks.

The rows of a source, in the order of a hash, are cut into blocks. Block j of a source with weight w (a share of
the whole) is released at floor(j / w) and due at ceil((j + 1) / w); in every slot the released block that is due
first is taken, so that after any number of slots each source is less than one block from its share. Weights are
exact ratios. When a source is used up, the others go on in proportion to their weights: no row is dropped or
repeated.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator
from fractions import Fraction
from itertools import batched

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mlwatch.llm.rows import table
from mlwatch.sources.shared import written

BLOCK_ROWS = 64
# Exponent that flattens source sizes to target weights where none are given.
FLATTEN = 0.5
# Rows of a source are ranked in so many stretches of the hash, each by a task of its own.
STRETCHES = 1 << 12
LONGEST = (1 << 63) - 1
COLUMNS = ("__block", "__release", "__deadline", "__slot", "__position")


def period(parts: dict[str, int]) -> list[str]:
    """The source of each slot of one period, by earliest deadline first; ties go to the heavier, then by name."""
    total, slots = sum(parts.values()), []
    waiting = [(0, name, 0) for name in parts]  # release, source, block
    heapq.heapify(waiting)
    due: list[tuple[int, int, str, int]] = []
    for slot in range(total):
        while waiting and waiting[0][0] <= slot:
            _, name, j = heapq.heappop(waiting)
            heapq.heappush(due, (-(-(j + 1) * total // parts[name]), -parts[name], name, j))
        _, _, name, j = heapq.heappop(due)
        slots.append(name)
        if j + 1 < parts[name]:
            heapq.heappush(waiting, ((j + 1) * total // parts[name], name, j + 1))
    return slots


def exact_parts(weights: dict[str, float]) -> dict[str, int]:
    """Weights as whole parts in exactly their ratios, whatever the number of parts."""
    if any(not 0 <= w < math.inf for w in weights.values()):
        raise ValueError("weights must be finite and not negative")
    ratios = {name: Fraction(w) for name, w in weights.items()}
    whole = math.lcm(*(r.denominator for r in ratios.values()))
    return {name: int(r * whole) for name, r in ratios.items()}


def slots(blocks: dict[str, int], parts: dict[str, int]) -> Iterator[tuple[str, int, int, int, int]]:
    """(source, block, release, deadline, slot) slot by slot, in memory that follows the number of sources.

    A phase ends when a source is used up; release and deadline count from its start. Sources without weight
    come after all others, in equal parts.
    """
    done, at = dict.fromkeys(blocks, 0), 0
    while left := [name for name, n in blocks.items() if n > done[name]]:
        share = {name: parts[name] for name in left if parts[name]} or dict.fromkeys(left, 1)
        total, slot, began = sum(share.values()), 0, dict(done)
        waiting = [(0, name) for name in share]
        heapq.heapify(waiting)
        due: list[tuple[int, int, str, int]] = []
        while True:
            while waiting and waiting[0][0] <= slot:
                release, name = heapq.heappop(waiting)
                end = -(-(done[name] - began[name] + 1) * total // share[name])
                heapq.heappush(due, (end, -share[name], name, release))
            end, _, name, release = heapq.heappop(due)
            yield name, done[name], release, min(end, LONGEST), at + slot
            done[name], slot = done[name] + 1, slot + 1
            if done[name] == blocks[name]:
                break
            heapq.heappush(waiting, ((done[name] - began[name]) * total // share[name], name))
        at += slot


def _slot_table(spark: SparkSession, blocks: dict[str, int], parts: dict[str, int]) -> DataFrame:
    """The rows of :func:`slots`, written by one task: a row for each block, none of them on the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["__source", "__block", "__release", "__deadline", "__slot"]
        if sum(batch.num_rows for batch in batches):
            for some in batched(slots(blocks, parts), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*some)], names)

    kinds = "__source string, __block long, __release long, __deadline long, __slot long"
    return written(spark.range(0, 1, 1, 1).mapInArrow(run, kinds), "mix-slots")


def schedule(blocks: dict[str, int], parts: dict[str, int]) -> list[tuple]:
    """The same for weights of few parts, by periods: rows (source, phase, parts, period, first block, end block, first slot, places): in a phase, block
    first + j of a source takes slot first slot + (j // parts) * period + places[j % parts].

    A phase ends when a source is used up. There are at most as many phases as sources, and one period of slots is
    worked out for each, whatever the number of blocks.
    """
    left, done, out, at = dict(blocks), dict.fromkeys(blocks, 0), [], 0
    left = {name: n for name, n in left.items() if n > 0}
    phase = 0
    while left:
        share = {name: parts[name] for name in left}
        places: dict[str, list[int]] = {name: [] for name in left}
        slots = period(share)
        for slot, name in enumerate(slots):
            places[name].append(slot)
        last = {name: (n - 1) // share[name] * len(slots) + places[name][(n - 1) % share[name]] for name, n in left.items()}
        length = min(last.values()) + 1
        whole, rest = divmod(length, len(slots))
        for name in left:
            used = whole * share[name] + bisect_left(places[name], rest)
            out.append((name, phase, share[name], len(slots), done[name], done[name] + used, at, places[name]))
            done[name] += used
        left = {name: blocks[name] - done[name] for name in left if blocks[name] > done[name]}
        at, phase = at + length, phase + 1
    return out


def _source(column: str) -> Column:
    """A source's name; rows without a source are a source of their own."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))


def mix(
    docs: DataFrame, weights: dict[str | None, float] | None = None, id_col: str = "doc_id", source_col: str = "source",
    block_rows: int = BLOCK_ROWS, stretches: int = STRETCHES, seed: int = 3,
) -> DataFrame:
    """``docs`` with __block, __release, __deadline, __slot and __position (each row's place in the mixture).

    ``weights`` gives a target weight to each source (None: rows without one); by default a source's weight is the
    square root of its rows. Sources it doesn't name get the least weight named, all the same if none is. Release and deadline count slots
    from the start of the block's phase. Positions are unique and ascend with the slot; they have gaps
    only where a source's last block is short. Rows are ordered within a source by a hash of the id, ties by id;
    rows equal in both share no position, in any order. Every row stays, with all its columns; null sources are a
    source; an empty table stays empty. Columns of the added names are replaced.

    One count per source meets the driver: sources are the bounded list that weights are given for. One task lays
    out the blocks, in a time that follows their number and memory that follows the number of sources.
    """
    docs = docs.drop(*COLUMNS)
    named = docs.select(
        F.struct("*").alias("__row"),
        F.col(id_col).alias("__id"),
        _source(source_col).alias("__source"),
        F.xxhash64(F.lit(seed), F.col(id_col)).alias("__hash"),
    )
    shift = 64 - (stretches.bit_length() - 1)
    named = named.withColumn("__stretch", F.shiftrightunsigned("__hash", shift))
    sizes = written(named.groupBy("__source", "__stretch").agg(F.count("*").alias("__n")), "mix-sizes")
    rows = {r[0]: r[1] for r in sizes.groupBy("__source").agg(F.sum("__n")).collect()}
    if weights is None:
        target = {name: n**FLATTEN for name, n in rows.items()}
    else:
        given = {"" if name is None else f"={name}": float(w) for name, w in weights.items()}
        least = min(given.values(), default=1.0)
        target = {name: given.get(name, least) for name in rows}
    blocks = {name: -(-n // block_rows) for name, n in rows.items()}
    taken = _slot_table(docs.sparkSession, blocks, exact_parts(target))

    before = Window.partitionBy("__source").orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    block_of = lambda index: F.floor(index / block_rows)
    held = F.sequence(block_of(F.col("__start")), block_of(F.col("__start") + F.col("__n") - 1))
    held = starts.withColumn("__block", F.explode(held)).join(taken, ["__source", "__block"])
    place = F.struct("__block", "__release", "__deadline", "__slot")
    held = held.groupBy("__source", "__stretch", "__start").agg(F.array_sort(F.collect_list(place)).alias("__places"))
    own = Window.partitionBy("__source", "__stretch").orderBy("__hash", "__id")
    ranked = named.withColumn("__rank", F.row_number().over(own) - 1).join(held, ["__source", "__stretch"])
    ranked = ranked.withColumn("__index", F.col("__start") + F.col("__rank"))
    nth = (block_of(F.col("__index")) - block_of(F.col("__start"))).cast("int")
    return ranked.withColumn("__p", F.get("__places", nth)).select(
        "__row.*",
        "__p.__block",
        "__p.__release",
        "__p.__deadline",
        "__p.__slot",
        (F.col("__p.__slot") * block_rows + F.col("__index") % block_rows).alias("__position"),
    )


def in_mixed_order(docs: DataFrame) -> DataFrame:
    """``docs`` itself, rows in the order of the mixture: partitions are ranges of it, sorted."""
    return mix(docs).repartitionByRange("__position").sortWithinPartitions("__position").select(docs.columns)


def written_place() -> Column:
    """The place of a row of the table that :func:`in_mixed_order` gives, written as Parquet and read again.

    Reading packs and splits files, so that rows come in any order: the number of the range in the file's name, the
    number of the file in it, and the row's index in the file say where each was, as 20, 11 and 32 bits.
    """
    name = F.col("_metadata.file_name")
    part = F.regexp_extract(name, r"^part-(\d+)", 1).cast("long")
    file = F.coalesce(F.regexp_extract(name, r"-c(\d+)\.", 1).try_cast("long"), F.lit(0))
    return F.shiftleft(part, 43) + F.shiftleft(file, 32) + F.col("_metadata.row_index")


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mix(docs).select(
        "doc_id",
        "source",
        F.col("__block").alias("block"),
        F.col("__release").alias("release"),
        F.col("__deadline").alias("deadline"),
        F.col("__slot").alias("slot"),
        F.col("__position").alias("position"),
    )
