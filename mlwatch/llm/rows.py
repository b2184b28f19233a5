"""Small helpers that the operators share: table reads, the held-out split, Arrow batches, bounded samples."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The split of the queries: rows whose checksum leaves this remainder are never learned from.
SPLIT, HELD_OUT = 3, 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(key: str = "doc_id") -> Column:
    """True where crc32 of the key's text leaves the held-out remainder; a null key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % SPLIT == HELD_OUT


def by_batch(df: DataFrame, function: Callable[[pa.RecordBatch], dict], schema: str) -> DataFrame:
    """Apply ``function``, which turns one Arrow batch into columns, to every batch of ``df``."""
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                columns = function(batch)
                yield pa.RecordBatch.from_arrays([columns[n] for n in names], names)

    return df.mapInArrow(run, schema)


def sent(spark: SparkSession, value):
    """A broadcast of ``value`` for :func:`received`, with what its classes are made of: workers need not import them."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def received(held):
    """The value of :func:`sent`, unpacked once in each worker process."""
    if not hasattr(held, "unpacked"):
        held.unpacked = pickle.loads(held.value)
    return held.unpacked


def some_of(df: DataFrame, key: str, bound: int, seed: int) -> DataFrame:
    """About ``bound`` rows of ``df`` (all of them where there are fewer), chosen by a hash of the key.

    For fitting only: the bound is a documented parameter of the operators that learn.
    """
    return df.filter(hashed_below(F.xxhash64(F.lit(seed), F.col(key)), bound, df.count()))


def hashed_below(hashed: Column, bound: int, rows: int) -> Column:
    """True for about ``bound`` of ``rows`` rows by their 64-bit hashes, for all where there are no more than that.

    The whole hash is compared with a whole-number threshold, so that the share is right for any number of rows.
    """
    if rows <= bound:
        return F.lit(True)
    return hashed < F.lit(-(1 << 63) + (bound << 64) // rows)
