"""Summary trees over time, so that zooming in and out again and again does not read a trace again and again.

Time is cut into steps; a level has cells twice as wide as the one below. A
cell holds counts and sums, which add up. Of a range, the whole steps inside
are a few cells of each level, at most two; only the two steps in which the range begins and
ends are read from the rows themselves, so what is told is exact for any range.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.units import bucket_number, first_char
from ..schema import COMPLETE, SEND, TIME
from ..sources.store import Versions
from .filters import Range, apply_range, given
from .stats import LATENCIES, continuity_of, continuity_rows, continuity_told, group_of, latency_histogram, value_rows, zeros_between


def cells_of(low: int, high: int) -> list[tuple[int, int]]:
    """(level, cell) that cover the steps from low to high, high not included, without overlap; at most two of a level."""
    out, level = [], 0
    while low < high:
        if low % 2:
            out.append((level, low))
            low += 1
        if high % 2:
            high -= 1
            out.append((level, high))
        low, high, level = low // 2, high // 2, level + 1
    return out


def step_of(kind: str, step: float) -> Column:
    return F.floor(F.col(TIME[kind]) / step).cast("long")


class Pyramid:
    """The summary tree of a kind's table, at rest under a folder."""

    def __init__(self, spark: SparkSession, folder: str, kind: str) -> None:
        self.spark, self.folder, self.kind = spark, folder.rstrip("/"), kind
        self.versions = Versions(spark, f"{self.folder}/{kind}")
        self.told = json.loads(told) if (told := self.versions.last()[1]) else None

    def build(self, df: DataFrame, step: float, thresholds: list[str]) -> Pyramid:
        """Summaries of all rows of df by steps of so much time. The rows are read once for latencies and once for continuity; a level is made of the one below."""
        number, name = self.versions.last()[0] + 1, f"v{self.versions.last()[0] + 1}"
        spot = f"{self.folder}/{self.kind}/{name}"
        cell = step_of(self.kind, step).alias("cell")
        done, sent = (F.lit(True), F.lit(True)) if self.kind == "cus" else (F.col("action") == COMPLETE[self.kind], F.col("action") == SEND[self.kind])
        latencies = F.array(*[F.when(sent if c == "ctod" else done, F.struct(F.lit(c).alias("latency"), F.col(c).cast("double").alias("value"))) for c in LATENCIES])
        rows = df.select("trace", cell, group_of(self.kind).alias("key"), F.explode(F.array_compact(latencies)).alias("v")).select("trace", "cell", "key", "v.latency", "v.value")
        low = rows.groupBy("trace", "cell", "key", "latency", bucket_number(F.col("value"), thresholds).alias("bucket_ord")).agg(F.count("*").alias("n"), F.count("value").alias("values"), F.sum("value").alias("sum"), F.min("value").alias("low"), F.max("value").alias("high"))
        sums = {"n": F.sum, "values": F.sum, "sum": F.sum, "low": F.min, "high": F.max}
        top = self._levels(low, ["trace", "key", "latency", "bucket_ord"], sums, f"{spot}/latency")
        seq = continuity_rows(df, self.kind, ("trace", cell))
        low = seq.groupBy("trace", "cell", "key").agg(*continuity_of())
        self._levels(low, ["trace", "key"], dict.fromkeys(("continuous", "non_continuous", "total_bytes", "continuous_bytes"), F.sum), f"{spot}/continuity")
        if not self.versions.claim(number, json.dumps({"at": name, "step": step, "thresholds": thresholds, "top": top})):
            raise RuntimeError("another tree was built meanwhile")
        self.told = json.loads(self.versions.last()[1])
        return self

    def _levels(self, low: DataFrame, keys: list[str], sums: dict, path: str) -> int:
        """Writes a level after the other until all steps are in one cell of each sign; returns the highest."""
        level = 0
        low.select("cell", *keys, *sums).sortWithinPartitions("trace", "cell").write.mode("overwrite").parquet(f"{path}/level=0")
        while True:
            df = self.spark.read.schema(low.schema).parquet(f"{path}/level={level}")
            least, most = df.agg(F.min("cell"), F.max("cell")).first()
            if least is None or (least >= -1 and most <= 0):
                return level
            up = df.groupBy(F.shiftright("cell", 1).alias("cell"), *keys).agg(*[f(c).alias(c) for c, f in sums.items()])
            level += 1
            up.sortWithinPartitions("trace", "cell").write.mode("overwrite").parquet(f"{path}/level={level}")

    def _inner(self, part: str, cells: list[tuple[int, int]], traces: list[str] | None) -> DataFrame:
        """The rows of those cells; other levels' files are not opened, and a level is in order of trace and cell."""
        path = f"{self.folder}/{self.kind}/{self.told['at']}/{part}"
        df = self.spark.read.parquet(path)
        wanted = F.lit(False)
        for level in sorted({x for x, _ in cells}):
            wanted = wanted | ((F.col("level") == level) & F.col("cell").isin([c for x, c in cells if x == level]))
        df = df.filter(F.col("level").isin(sorted({x for x, _ in cells}))).filter(wanted)
        return df.filter(F.col("trace").isin(traces)) if traces is not None else df

    def _split(self, r: Range | None) -> tuple[list[tuple[int, int]], tuple[int, int] | None]:
        """Cells inside a range, and the steps of its ends; no range on time: the top cells."""
        if r is None or not given(r.time_from, r.time_to):
            return [(self.told["top"], -1), (self.told["top"], 0)], None
        ends = math.floor(r.time_from / self.told["step"]), math.floor(r.time_to / self.told["step"])
        return cells_of(ends[0] + 1, ends[1]), ends

    def edges(self, df: DataFrame, r: Range | None) -> DataFrame:
        """The rows of df in a range that are in no whole step of it: those of two steps at most. The bounds reach the scan."""
        _, ends = self._split(r)
        if ends is None:
            return df.limit(0)
        step, time = self.told["step"], F.col(TIME[self.kind])
        near = (time <= (ends[0] + 2) * step) | (time >= (ends[1] - 1) * step)  # a step more than need be, whatever division rounds
        return apply_range(df, self.kind, r).filter(near).filter(step_of(self.kind, step).isin(list(ends)))

    def histogram(self, df: DataFrame, column: str, r: Range | None = None, hidden: list[str] | None = None, group: bool = False, traces: list[str] | None = None) -> DataFrame:
        """What latency_histogram tells of df, the table that the tree was built from. Ranges on other columns and hidden legends are answered from the rows."""
        thresholds = self.told["thresholds"]
        if hidden or column not in LATENCIES or (r is not None and given(r.col_from, r.col_to)):
            return latency_histogram(df, self.kind, column, thresholds, r, hidden, group)
        key = first_char(F.col("key")) if self.kind == "block" and group else F.col("key")
        inner = self._inner("latency", self._split(r)[0], traces).filter(F.col("latency") == column).select("trace", key.alias("key"), "bucket_ord", "n")
        raw = value_rows(self.edges(df, r), self.kind, column, None, None, group).select("trace", "key", bucket_number(F.col("value"), thresholds).alias("bucket_ord"), F.lit(1).cast("long").alias("n"))
        return zeros_between(inner.unionByName(raw).groupBy("trace", "key", "bucket_ord").agg(F.sum("n").alias("n")), thresholds)

    def moments(self, df: DataFrame, column: str, r: Range | None = None, group: bool = False, traces: list[str] | None = None) -> DataFrame:
        """(trace, key, n, sum, min, max, avg) of a latency, as latency_summary has them."""
        key = first_char(F.col("key")) if self.kind == "block" and group else F.col("key")
        inner = self._inner("latency", self._split(r)[0], traces).filter(F.col("latency") == column).select("trace", key.alias("key"), F.col("values").alias("n"), "sum", "low", "high")
        value = F.col("value")
        raw = value_rows(self.edges(df, r), self.kind, column, None, None, group).select("trace", "key", value.isNotNull().cast("long").alias("n"), value.alias("sum"), value.alias("low"), value.alias("high"))
        sums = inner.unionByName(raw).groupBy("trace", "key").agg(F.sum("n").alias("n"), *[F.coalesce(f(c), F.lit(0.0)).alias(o) for f, c, o in ((F.sum, "sum", "sum"), (F.min, "low", "min"), (F.max, "high", "max"))])
        return sums.withColumn("avg", F.when(F.col("n") > 0, F.col("sum") / F.col("n")).otherwise(0.0))

    def continuity(self, df: DataFrame, r: Range | None = None, traces: list[str] | None = None) -> DataFrame:
        """What continuity_stats tells of df."""
        inner = self._inner("continuity", self._split(r)[0], traces).select("trace", "key", "continuous", "non_continuous", "total_bytes", "continuous_bytes")
        raw = continuity_rows(self.edges(df, r), self.kind, ("trace",)).groupBy("trace", "key").agg(*continuity_of())
        both = inner.unionByName(raw).groupBy("trace", "key").agg(*[F.sum(c).alias(c) for c in ("continuous", "non_continuous", "total_bytes", "continuous_bytes")])
        return continuity_told(both, self.kind)
