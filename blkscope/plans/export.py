"""Export to CSV in files of at most so many rows, in order of time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.filters import Range, export_range
from ..operators.order import limits_of, slice_of
from ..schema import TIME

#: Data rows of a file: what a spreadsheet holds under a header.
MAX_ROWS = 1_048_575


def numbered(df: DataFrame, kind: str, r: Range | None = None, max_rows: int = MAX_ROWS) -> DataFrame:
    """The rows of an export with n (from 0, in order of time, then trace and line) and chunk.

    Rows are dealt by ranges of time that hold about as many rows each; a row's number is its place in its slice
    and the sizes of the slices before, of which there is one row each.
    """
    condition = export_range(kind, r) if r else None
    rows = df.filter(condition) if condition is not None else df
    time = TIME[kind]
    slices = max(1, -(-rows.count() // max_rows))
    limits = rows.agg(limits_of(time, slices).alias("limits")).first()["limits"] if slices > 1 else None
    ends = F.array(*[F.lit(float(x)) for x in sorted(set(limits or []))]).cast("array<double>")
    cut = F.when(F.col(time).isNull(), F.lit(slices).cast("long")).otherwise(slice_of(F.col(time), ends))
    cut_rows = rows.withColumn("__slice", cut)
    order = [F.col(time).asc_nulls_last(), F.col("trace"), F.col("seq")]
    sizes = cut_rows.groupBy("__slice").agg(F.count("*").alias("__n"))
    before = sizes.select(F.col("__slice").alias("__s"), F.coalesce(F.sum("__n").over(Window.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    placed = cut_rows.withColumn("__r", F.row_number().over(Window.partitionBy("__slice").orderBy(*order))).join(before, F.col("__slice") == F.col("__s"))
    number = F.col("__r") + F.col("__before") - 1
    return placed.select(*df.columns, number.alias("n"), F.floor(number / max_rows).cast("long").alias("chunk"))


def chunks(df: DataFrame, kind: str, base: str, r: Range | None = None, max_rows: int = MAX_ROWS) -> DataFrame:
    """(chunk, rows, tmin, tmax, file): the files of an export. No rows: no files."""
    time = F.col(TIME[kind])
    rows = numbered(df, kind, r, max_rows).groupBy("chunk").agg(F.count("*").alias("rows"), F.min(time).alias("tmin"), F.max(time).alias("tmax"))
    low, high = (F.coalesce(F.format_string("%.3f", F.col(c)), F.lit("0.000")) for c in ("tmin", "tmax"))
    return rows.withColumn("file", F.concat(F.lit(base + "_"), low, F.lit("_"), high, F.lit(".csv")))


def export_csv(df: DataFrame, kind: str, folder: str, base: str, r: Range | None = None, max_rows: int = MAX_ROWS) -> list[str]:
    """Writes the files and returns their paths in order. Spark writes a file per chunk; the driver renames them by the table of chunks."""
    spark = df.sparkSession
    rows = numbered(df, kind, r, max_rows)
    names = {r["chunk"]: r["file"] for r in chunks(df, kind, base, r, max_rows).collect()}
    if not names:
        return []
    staged = f"{folder}/.{base}-parts"
    rows.repartition(min(len(names), 1000), "chunk").sortWithinPartitions("chunk", "n").drop("n").write.mode("overwrite").partitionBy("chunk").option("header", True).csv(staged)
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(staged).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = []
    for chunk in sorted(names):
        (part,) = fs.globStatus(path(f"{staged}/chunk={chunk}/part-*.csv"))
        target = f"{folder}/{names[chunk]}"
        if fs.exists(path(target)):
            target = f"{folder}/{names[chunk].removesuffix('.csv')}_{chunk}.csv"
        fs.rename(part.getPath(), path(target))
        out.append(target)
    fs.delete(path(staged), True)
    return out


def report_csv(report: DataFrame, path: str) -> None:
    """A table of statistics as shown: numbers to three decimals, maps left out, one file. For reports of a few rows per operation, not for traces."""
    shown = [F.round(c, 3).alias(c) if t == "double" else F.col(c) for c, t in report.dtypes if not t.startswith(("map", "array", "struct"))]
    report.select(*shown).coalesce(1).write.mode("overwrite").option("header", True).csv(path)
