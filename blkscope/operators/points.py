"""Scatter plot points, their bounds and legends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .filters import Range, chart_rows

LATENCY_AXES = ("dtoc", "ctoc", "ctod")


def axis(kind: str, name: str, hover: bool = False) -> str:
    """The stored column of an axis: requests have a queue depth at start (axes) and at end (hover)."""
    return ("end_qd" if hover else "start_qd") if kind == "cus" and name == "qd" else name


def latency_x(kind: str, y: str) -> str:
    """The time that a chart of y runs over."""
    return ("end_time" if y == "ctoc" else "start_time") if kind == "cus" else "time"


def points(df: DataFrame, kind: str, x: str, y: str, legend: str, action: str | None = None, hover: tuple[str, ...] = ()) -> DataFrame:
    """(trace, seq, x, y, legend, hover...): rows of the chart with numbers on both axes, and positive ones for latencies."""
    rows = chart_rows(df, kind, y, action)
    more = [F.col(axis(kind, h, True)).alias(f"hover_{h}") for h in hover]
    out = rows.select("trace", "seq", F.col(axis(kind, x)).cast("double").alias("x"), F.col(axis(kind, y)).cast("double").alias("y"), F.col(legend).cast("string").alias("legend"), *more)
    out = out.filter(F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y"))
    return out.filter("y > 0") if y in LATENCY_AXES else out


def bounds(pts: DataFrame, y: str) -> DataFrame:
    """One row: extents of x and y and the number of points. CPUs have -1 to 8, latencies and depths start at 0; no points: 0 to 100."""
    row = pts.agg(F.min("x").alias("xmin"), F.max("x").alias("xmax"), F.min("y").alias("ymin"), F.max("y").alias("ymax"), F.count("*").alias("points"))
    none = F.col("points") == 0
    low, high = F.col("ymin"), F.col("ymax")
    if y == "cpu":
        low, high = F.lit(-1.0), F.lit(8.0)
    elif y in (*LATENCY_AXES, "qd"):
        low = F.lit(0.0)

    def shown(c: Column, default: float) -> Column:
        return F.when(none, default).otherwise(c)

    return row.select(shown(F.col("xmin"), 0.0).alias("xmin"), shown(F.col("xmax"), 100.0).alias("xmax"), shown(low, 0.0).alias("ymin"), shown(high, 100.0).alias("ymax"), "points")


def legend_rank(legend: Column) -> Column:
    """Reads, writes, discards and flushes first, then opcodes, then others."""
    return F.when(legend == "R", 0).when(legend == "W", 1).when(legend == "D", 2).when(legend == "F", 3).when(legend.startswith("0x"), 4).otherwise(5)


def legends(df: DataFrame, column: str) -> DataFrame:
    """(legend, position): the different legends in the order shown; CPUs by number. As many rows as there are legends."""
    rows = df.select(F.col(column).cast("string").alias("legend")).distinct()
    by = [F.col("legend").try_cast("long"), F.col("legend")] if column == "cpu" else [legend_rank(F.col("legend")), F.col("legend")]
    return rows.withColumn("position", F.row_number().over(Window.orderBy(*by)).cast("long"))


def legend_index(pts: DataFrame) -> DataFrame:
    """pts with legend_index: legends counted from 0 as they are first seen. The numbering is of one row per legend."""
    first = pts.groupBy("legend").agg(F.min(F.struct("trace", "seq")).alias("at"))
    numbered = first.select(F.col("legend").alias("__l"), (F.row_number().over(Window.orderBy("at")) - 1).alias("legend_index"))
    return pts.join(numbered, F.col("legend").eqNullSafe(F.col("__l"))).drop("__l")


def typed(pts: DataFrame) -> DataFrame:
    """Positions as 32-bit floats with legend numbers, as a plot takes them."""
    return legend_index(pts).select("trace", "seq", F.col("x").cast("float").alias("x"), F.col("y").cast("float").alias("y"), F.col("legend_index").cast("int").alias("legend_index"))


def series(pts: DataFrame) -> DataFrame:
    """pts with each legend's points in order of x: sorted over partitions by range, so no legend has to fit a task."""
    return pts.orderBy("legend", "x", "trace", "seq")


def zoomed(y: str, x_from: float, x_to: float, y_from: float, y_to: float) -> Range:
    """The range that a box drawn in a chart asks for; its corners in any order."""
    return Range(y, min(x_from, x_to), max(x_from, x_to), min(y_from, y_to), max(y_from, y_to))
