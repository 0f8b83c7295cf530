"""Intermediate results that are written once, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Starts the names of what is only needed for a while; sources.store.clean_up deletes what is old.
PREFIX = "trace_temp_"

#: A table of up to so many rows is sent whole to every task of a join.
FEW_ROWS = 10_000


def shared_folder(df: DataFrame) -> str | None:
    """spark.checkpoint.dir; a temporary folder where it is unset in a local session, None where it is on a cluster."""
    context = df.sparkSession.sparkContext
    base = df.sparkSession.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base and (context.master == "local" or context.master.startswith("local[")):
        base = tempfile.mkdtemp(prefix="blkscope-")
        context.setCheckpointDir(base)
    return base.rstrip("/") if base else None


def materialised(df: DataFrame) -> DataFrame:
    """df, computed now and read from a table; df itself where there is no folder for it, and then what reads it computes it again."""
    base = shared_folder(df)
    if base is None:
        return df
    path = f"{base}/{PREFIX}{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def beside(few: DataFrame) -> DataFrame:
    """few, computed now, as the side of a join that goes to the many rows: sent to each task, or merged with them if it has over FEW_ROWS rows.

    Without that Spark compares the sizes of files and sends what has the smaller one. Compressed, millions of rows can
    be in a file of a few MB, and then these would go through the driver.
    """
    few = materialised(few)
    return F.broadcast(few) if few.count() <= FEW_ROWS else few.hint("merge")


def is_derived(df: DataFrame) -> bool:
    """Whether df is computed by windows, joins or aggregates: then reading it twice is dearer than writing it."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return any(x in plan for x in ("Window [", "Join ", "Aggregate ["))
