"""What several operators share: the shared folder, tables written once, text clean-up."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts name it, for Java regular expressions.
WHITE = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Where it is unset, a local session gets a temporary folder; on a cluster
    that would be one that executors can't see, so it is an error there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir must name a folder that driver and executors share; it is unset and the master is {master}")
        base = tempfile.mkdtemp(prefix="blkscope-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


_written: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df, computed once into a Parquet table in the shared folder; what reads it needs no earlier stage again."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Deletes at its end the intermediate tables that were written inside it, but for the paths put into the list."""
    first, keep = len(_written), []
    yield keep
    path_of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for p in _written[first:]:
        if p not in keep:
            path = path_of(p)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    _written[first:] = keep


def sealed(df: DataFrame, name: str, keep: list[str]) -> DataFrame:
    """written, and kept by the scratch whose list this is."""
    out = written(df, name)
    keep.append(_written[-1])
    return out


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores behind as it takes to differ from all columns of df."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


def text_of(column: str) -> Column:
    """The column as a string, null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def squeezed(column: str) -> Column:
    return F.regexp_replace(text_of(column), WHITE, " ")


def _give_back() -> None:
    """Hands memory that is free in this process back to the system, where the C library can: workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy_map(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, a function for mapInArrow, whose worker gives its memory back after each task."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        _give_back()

    return tidied


def tidy_pair(run: Callable[[pa.Table, pa.Table], pa.Table]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """run, a function for applyInArrow of two grouped tables, whose worker gives its memory back after each group."""

    def tidied(left: pa.Table, right: pa.Table) -> pa.Table:
        out = run(left, right)
        _give_back()
        return out

    return tidied


def blocks_for(total_bytes: int | None, block_bytes: int) -> int:
    return max(1, -(-(total_bytes or 0) // block_bytes))
