"""What a viewer asks of a trace table: a preview, a filtered preview, and the session's caches and jobs."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.filters import Range, apply_range, view_range
from ..operators.sample import sample_exact
from ..schema import PREVIEW_ROWS
from ..sources.patterns import Registry
from ..sources.store import Catalog
from .ingest import ingest


def with_counts(df: DataFrame, max_rows: int) -> tuple[DataFrame, DataFrame]:
    """A sample and one row (total_count, sampled_count, sampling_ratio)."""
    total = df.agg(F.count("*").alias("total_count"))
    taken = F.least("total_count", F.lit(max_rows).cast("long"))
    ratio = F.when(F.col("total_count") <= max_rows, 100.0).otherwise(taken * 100.0 / F.col("total_count"))
    return sample_exact(df, max_rows), total.select("total_count", taken.alias("sampled_count"), ratio.alias("sampling_ratio"))


def filter_trace(df: DataFrame, kind: str, r: Range | None = None, max_rows: int = PREVIEW_ROWS, hidden: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """A sample of the rows within r whose legends are not hidden, and its counts."""
    return with_counts(apply_range(df, kind, view_range(kind, r) if r else None, hidden), max_rows)


def to_arrow(df: DataFrame) -> pa.Table:
    """A preview for a client: bounded by its max_rows."""
    return df.toArrow()


def save_arrow(df: DataFrame, path: str) -> str:
    """A preview as an Arrow file for a client beside the driver."""
    table = df.toArrow()
    with pa.OSFile(path, "wb") as sink, pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return path


class Session:
    """Trace tables kept by name, and jobs that can be cancelled, each apart or all together."""

    def __init__(self, spark: SparkSession, group: str = "blkscope") -> None:
        self.spark, self.group, self.cancelled = spark, f"{group}-{uuid.uuid4().hex}", False
        self.kept: dict[str, DataFrame] = {}
        self.running: set[str] = set()

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        if name not in self.kept:
            self.kept[name] = df.persist(StorageLevel.MEMORY_AND_DISK)
        return self.kept[name]

    def clear(self) -> None:
        for df in self.kept.values():
            df.unpersist()
        self.kept.clear()

    @contextmanager
    def job(self, name: str = "") -> Iterator[str]:
        """What this thread starts inside is one job, by the name that this gives; jobs of other threads are others."""
        tag = f"{self.group}-{name or 'job'}-{uuid.uuid4().hex}"
        self.spark.sparkContext.addJobTag(tag)
        self.running.add(tag)
        try:
            yield tag
        finally:
            self.running.discard(tag)
            self.spark.sparkContext.removeJobTag(tag)

    def start(self) -> None:
        """What this thread starts from now on is cancelled with all; the next start allows jobs again."""
        self.cancelled = False
        self.spark.sparkContext.addJobTag(self.group)

    def cancel(self, job: str | None = None) -> None:
        """Cancels one job, or all of this session; those of other sessions go on."""
        if job is not None:
            self.spark.sparkContext.cancelJobsWithTag(job)
            return
        self.cancelled = True
        for tag in (self.group, *sorted(self.running)):
            self.spark.sparkContext.cancelJobsWithTag(tag)


def reparse(session: Session, catalog: Catalog, log_id: int, registry: Registry | None = None, **more) -> DataFrame:
    """Reads a catalogued log again, replaces its traces and drops what the session kept of them; ingest's counts by kind. more goes to ingest."""
    (row,) = catalog.table().filter(F.col("id") == log_id).collect()
    counts = ingest(session.spark, row["path"], row["folder"], registry, overwrite=True, **more)
    session.clear()
    catalog.update(log_id, kinds=",".join(sorted(r["kind"] for r in counts.collect() if r["kind"] != "missing")))
    return counts
