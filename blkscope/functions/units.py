"""Units, buckets and labels."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The thresholds of the latency histogram and the label without any.
THRESHOLDS = ["0.1ms", "0.5ms", "1ms", "5ms", "10ms", "50ms", "100ms", "500ms", "1s", "5s", "10s", "50s", "100s", "500s", "1000s"]
ALL = "전체"
TO_MS = {"ms": lambda x: x, "s": lambda x: x * 1000.0, "us": lambda x: x / 1000.0, "ns": lambda x: x / 1_000_000.0}
SIZES = ["Bytes", "KB", "MB", "GB", "TB"]


def time_to_ms(text: str) -> float:
    """A number with unit ms, s, us or ns in milliseconds. Digits and dots, wherever they stand, are the number; the rest is the unit."""
    number, unit = "".join(re.findall(r"[0-9.]", text)), re.sub(r"[0-9.]", "", text)
    if unit not in TO_MS:
        raise ValueError(f"{text!r}: unit {unit!r} is none of {', '.join(TO_MS)}")
    return TO_MS[unit](float(number))


def time_to_ms_column(text: Column) -> Column:
    """The same for a column; null where time_to_ms raises."""
    number = F.regexp_replace(text, "[^0-9.]", "").try_cast("double")
    unit = F.regexp_replace(text, "[0-9.]", "")
    return F.when(unit == "ms", number).when(unit == "s", number * 1000.0).when(unit == "us", number / 1000.0).when(unit == "ns", number / 1000000.0)


def bucket_labels(thresholds: list[str]) -> list[str]:
    """The labels of the histogram in order."""
    if not thresholds:
        return [ALL]
    middle = [f"{i + 2:02d}_{a} < v ≤ {b}" for i, (a, b) in enumerate(zip(thresholds, thresholds[1:]))]
    return [f"01_≤ {thresholds[0]}", *middle, f"99_> {thresholds[-1]}"]


def bucket_number(value: Column, thresholds: list[str]) -> Column:
    """The place in bucket_labels of a value in ms; null if it fits none (thresholds that don't rise). Only plan-time work in Python."""
    limits = [time_to_ms(t) for t in thresholds]
    if not limits:
        return F.lit(0)
    out = F.when(value <= limits[0], 0).when(value > limits[-1], len(limits))
    for i, (a, b) in enumerate(zip(limits, limits[1:])):
        out = out.when((value > a) & (value <= b), i + 1)
    return out


def bucket_label(value: Column, thresholds: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in bucket_labels(thresholds)]), bucket_number(value, thresholds) + 1)


def bucket_table(spark: SparkSession, thresholds: list[str]) -> DataFrame:
    """(bucket_ord, bucket): as many rows as there are labels."""
    return spark.createDataFrame(list(enumerate(bucket_labels(thresholds))), "bucket_ord int, bucket string")


def first_char(text: Column) -> Column:
    return F.substring(text, 1, 1)


def io_class(io_type: Column) -> Column:
    first = first_char(io_type)
    return F.when(first == "R", "read").when(first == "W", "write").when(first == "D", "discard").otherwise("other")


def format_bytes(n: Column) -> Column:
    """1536 as 1.5 KB: base 1024 up to TB, at most two decimals, zero and null as 0 Bytes."""
    power = F.lit(0)
    for k in range(1, len(SIZES)):
        power = F.when(n >= 1024**k, k).otherwise(power)
    value = F.round(n.cast("double") / F.pow(F.lit(1024.0), power), 2)
    shown = F.regexp_replace(F.regexp_replace(F.format_string("%.2f", value), r"0+$", ""), r"\.$", "")
    return F.when(n.isNull() | (n <= 0), "0 Bytes").otherwise(F.concat_ws(" ", shown, F.element_at(F.array(*[F.lit(s) for s in SIZES]), power + 1)))


def from_hex(text: Column) -> Column:
    """Hexadecimal digits, with or without 0x, as a long; null if they are none or too many."""
    digits = F.regexp_extract(text, r"^(?:0[xX])?0*([0-9a-fA-F]{0,15})$", 1)
    return F.when(text.rlike(r"^(?:0[xX])?[0-9a-fA-F]+$") & ((digits != "") | text.rlike(r"^(?:0[xX])?0+$")), F.conv(F.concat(F.lit("0"), digits), 16, 10).cast("long"))
