"""Range, legend and action filters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import COMPLETE, SEND, TIME

#: Columns that a range may be on.
RANGE_COLUMNS = {
    "ufs": ("lba", "dtoc", "ctoc", "ctod", "qd", "cpu"),
    "block": ("sector", "dtoc", "ctoc", "ctod", "qd", "cpu"),
    "cus": ("lba", "size", "dtoc", "ctoc", "ctod", "start_qd", "end_qd"),
}
LEGENDS = {"ufs": ("opcode", "cpu"), "block": ("io_type", "cpu"), "cus": ("opcode",)}


@dataclass(frozen=True)
class Range:
    """Bounds on time and on one column. A pair counts if both are given and not both 0; both ends belong to it."""

    column: str = ""
    time_from: float | None = None
    time_to: float | None = None
    col_from: float | None = None
    col_to: float | None = None


def given(low: float | None, high: float | None) -> bool:
    return low is not None and high is not None and not (low == 0 and high == 0)


def in_range(kind: str, r: Range) -> Column | None:
    """The condition, or None if nothing is asked. A column that a range can't be on fits no row."""
    out = None
    if given(r.time_from, r.time_to):
        out = F.col(TIME[kind]).between(float(r.time_from), float(r.time_to))
    if given(r.col_from, r.col_to):
        fits = F.col(r.column).cast("double").between(float(r.col_from), float(r.col_to)) if r.column in RANGE_COLUMNS[kind] else F.lit(False)
        out = fits if out is None else out & fits
    return out


def apply_range(df: DataFrame, kind: str, r: Range | None = None, hidden: list[str] | None = None) -> DataFrame:
    """Rows within r whose legends (operation, cpu) are not hidden. Conditions on stored columns reach the Parquet scan."""
    condition = in_range(kind, r) if r else None
    if condition is not None:
        df = df.filter(condition)
    for legend in LEGENDS[kind] if hidden else ():
        df = df.filter(~F.col(legend).cast("string").isin(hidden))
    return df


def hide_many(df: DataFrame, kind: str, hidden: DataFrame) -> DataFrame:
    """The same for hidden legends in a table (legend): an anti-join each."""
    for legend in LEGENDS[kind]:
        df = df.join(hidden.select(F.col("legend").alias(f"__{legend}")), F.col(legend).cast("string") == F.col(f"__{legend}"), "left_anti")
    return df


def view_range(kind: str, r: Range) -> Range:
    """A chart's range: the queue depth of requests is that at their start."""
    return Range("start_qd", r.time_from, r.time_to, r.col_from, r.col_to) if kind == "cus" and r.column == "qd" else r


def stats_rows(df: DataFrame, kind: str, column: str) -> DataFrame:
    """Rows that a statistic of column is over: completes for dtoc and ctoc, sends for ctod and addresses, all requests."""
    if kind == "cus":
        return df
    return df.filter(F.col("action") == (COMPLETE if column in ("dtoc", "ctoc") else SEND)[kind])


def chart_rows(df: DataFrame, kind: str, y: str, action: str | None = None) -> DataFrame:
    """Rows of a chart: action d sends, c completes, none completes for dtoc and ctoc and else sends; any other name all rows."""
    if kind == "cus" or action not in (None, "", "c", "d"):
        return df
    done = action == "c" or not action and y in ("dtoc", "ctoc")
    return df.filter(F.col("action") == (COMPLETE if done else SEND)[kind])


def export_range(kind: str, r: Range) -> Column | None:
    """The condition of an export: a pair of bounds counts if both are given and one is over 0; column bounds are cut to whole numbers."""

    def asked(low: float | None, high: float | None) -> bool:
        return low is not None and high is not None and (low > 0 or high > 0)

    out = None
    if asked(r.time_from, r.time_to):
        out = F.col(TIME[kind]).between(float(r.time_from), float(r.time_to))
    if r.column and asked(r.col_from, r.col_to):
        fits = F.col(r.column).between(int(r.col_from), int(r.col_to))
        out = fits if out is None else out & fits
    return out
