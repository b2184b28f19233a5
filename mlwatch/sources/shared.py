"""Tables written to the folder all executors share, used where a plan needs an exact small input."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_named: dict[str, str] = {}
_scopes: list[list[DataFrame]] = []


def name_folder(spark: SparkSession, path: str) -> None:
    """Name a folder for a local session without ``spark.checkpoint.dir``; a cluster has to set that."""
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    _named[spark.sparkContext.applicationId] = path


def has_folder(spark: SparkSession) -> bool:
    return bool(spark.conf.get("spark.checkpoint.dir", None)) or spark.sparkContext.applicationId in _named


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, or by :func:`name_folder`; without one an error."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or _named.get(spark.sparkContext.applicationId)
    if not configured:
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    return configured.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/mlwatch/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, session: SparkSession | None = None) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back, in ``session`` if one is given.

    Later passes read the pruned files instead of repeating the lineage, a lost executor costs no
    recomputation, and the optimizer sees the true size, so it broadcasts the table only when it
    really is under ``spark.sql.autoBroadcastJoinThreshold``.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    out = (session or spark).read.schema(df.schema).parquet(path)
    out._scratch_path = path
    if _scopes:
        _scopes[-1].append(out)
    return out


@contextmanager
def scratch_scope() -> Iterator[None]:
    """Remove the tables that are ``written`` inside when it ends: for steps that store their results."""
    _scopes.append([])
    try:
        yield
    finally:
        for df in _scopes.pop():
            discard(df)


def discard(df: DataFrame) -> None:
    """Remove the files of a ``written`` table that no later plan reads."""
    spark, path = df.sparkSession, getattr(df, "_scratch_path", None)
    if path:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
