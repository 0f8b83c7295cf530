"""From logs to trace tables at rest."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from ..operators.derive import derive
from ..schema import KINDS
from ..sources import parse, store
from ..sources.patterns import Registry
from ..sources.text import read_encoded, read_log


def ingest(spark: SparkSession, path: str | list[str], folder: str, registry: Registry | None = None, encoding: str | None = None, overwrite: bool = False, strict: bool = False, strict_order: bool = False) -> DataFrame:
    """Parses logs, derives each kind and saves it under folder; returns (trace, kind, n) with lines of no kind as missing.

    overwrite replaces the traces that the logs have. Kinds without rows are
    left as they are. Lines are parsed once; they spill to disk where memory
    does not hold them. Encodings are told by the logs unless one is named.
    strict: see read_log; strict_order: see derive.
    """
    lines = read_encoded(spark, path, encoding) if encoding else read_log(spark, path, strict)
    found = parse.parsed(lines, registry).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        counts = parse.kind_counts(found)
        rows = counts.collect()
        for kind in KINDS:
            if any(r["kind"] == kind for r in rows):
                store.save(derive(parse.events(found, kind), kind, strict_order=strict_order), folder, kind, "overwrite" if overwrite else "append")
        return spark.createDataFrame(rows, counts.schema)
    finally:
        found.unpersist()
