"""The order of a trace's rows, and the buckets that let a trace be derived by many tasks.

Rows stay in line order unless a time runs backwards among a trace's first
HEAD rows; then the trace is sorted by time, ties by line. A bucket holds
neighbouring rows of one trace: slices of line numbers, or of time, that hold
about as many rows each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.temp import materialised

HEAD = 1000

#: Traces of up to so many rows are one bucket; longer ones are cut into buckets of about so many.
BUCKET_ROWS = 500_000

TRACE, BUCKET, KEY = "trace", "__bucket", "__key"


def needs_sort(df: DataFrame, time: str = "time", head: int | None = HEAD) -> DataFrame:
    """(trace, sorted): whether a trace is put in order of time. Only each trace's first rows are ordered for this; head None: all are sorted, which changes no trace that is in order."""
    if head is None:
        return df.select(TRACE, F.lit(True).alias("sorted")).distinct()
    first = Window.partitionBy(TRACE).orderBy("seq")
    top = df.select(TRACE, "seq", F.col(time).alias("t")).withColumn("n", F.row_number().over(first)).filter(F.col("n") <= head)
    back = F.col("t") < F.lag("t").over(first)
    return top.select(TRACE, F.coalesce(back, F.lit(False)).alias("back")).groupBy(TRACE).agg(F.max("back").alias("sorted"))


def slice_of(key: Column, limits: Column) -> Column:
    """How many of the limits, which are in order, are not above key; by halving, so that thousands of limits cost a dozen steps. No limits: 0."""
    size = F.coalesce(F.size(limits), F.lit(0))

    def step(at: Column, width: Column) -> Column:
        return F.when((at + width <= size) & (F.get(limits, at + width - 1) <= key), at + width).otherwise(at)

    return F.when(size > 0, F.aggregate(F.array(*[F.lit(1 << k) for k in range(20, -1, -1)]), F.lit(0), step)).otherwise(0).cast("long")


def limits_of(key: str, slices: int) -> Column:
    """An aggregate: slices - 1 keys between which about as many rows lie, a row more or less in twenty."""
    return F.percentile_approx(key, [k / slices for k in range(1, slices)], max(10000, 20 * slices))


def sliced(keyed: DataFrame, bucket_rows: int | None) -> tuple[DataFrame, bool]:
    """keyed with __bucket by its __key, and whether every trace is one bucket.

    Buckets are cut where the keys lie, so a burst or a stray time makes none
    longer; rows of the same key are in one. What is computed on buckets does
    not depend on where they end, but all readers must see the same ends: the
    driver takes them, one number for about bucket_rows rows, and those of the
    longest trace set how many there are. Rows that are cut are written once, as
    they are read for what buckets hand over and for the rows themselves. bucket_rows None: one bucket per trace.
    """
    one = keyed.withColumn(BUCKET, F.lit(0).cast("long"))
    if bucket_rows is None:
        return one, True
    rows = keyed.groupBy(TRACE).agg(F.count("*").alias("n"))
    longest = rows.agg(F.max("n")).first()[0]
    if longest is None or longest <= bucket_rows:
        return one, True
    spans = keyed.groupBy(TRACE).agg(F.count("*").alias("n"), limits_of(KEY, -(-longest // bucket_rows)).alias("limits"))
    ends = [(r[TRACE], sorted({float(x) for x in r["limits"]})) for r in spans.filter(F.col("n") > bucket_rows).collect()]
    cuts = keyed.sparkSession.createDataFrame(ends, "__t string, __limits array<double>")
    found = keyed.join(F.broadcast(cuts), F.col(TRACE) == F.col("__t"), "left")
    return materialised(found.withColumn(BUCKET, slice_of(F.col(KEY), F.col("__limits"))).drop("__t", "__limits")), False


def ordered(df: DataFrame, time: str = "time", head: int | None = HEAD, bucket_rows: int | None = BUCKET_ROWS, flags: DataFrame | None = None) -> tuple[DataFrame, bool]:
    """df with __key and __bucket: rows of a trace are in order by (__bucket, __key, seq); and whether every trace is one bucket. flags: what needs_sort would tell, where it is known."""
    # one row per trace, read by each of the passes that follow
    flags = (materialised(needs_sort(df, time, head)) if flags is None else flags).select(F.col(TRACE).alias("__t"), "sorted")
    keyed = df.join(flags, F.col(TRACE) == F.col("__t")).withColumn(KEY, F.when(F.col("sorted"), F.col(time)).otherwise(F.col("seq").cast("double"))).drop("__t", "sorted")
    return sliced(keyed, bucket_rows)


def by_order(*more: str) -> list[Column]:
    return [F.col(KEY), F.col("seq"), *[F.col(c) for c in more]]


def local(*keys: str, more: tuple[str, ...] = ()) -> Window:
    """The rows of a bucket (and of keys within it) in order."""
    return Window.partitionBy(TRACE, BUCKET, *keys).orderBy(*by_order(*more))


def conditional_sort(df: DataFrame, time: str = "time", head: int | None = HEAD, bucket_rows: int | None = BUCKET_ROWS) -> DataFrame:
    """df in its order: sorted by trace and order, with ord counting rows of a trace from 1.

    ord comes from the rows before in a bucket and the sizes of the buckets before it.
    """
    rows, _ = ordered(df, time, head, bucket_rows)
    sizes = rows.groupBy(TRACE, BUCKET).agg(F.count("*").alias("n"))
    before = sizes.select(F.col(TRACE).alias("t"), F.col(BUCKET).alias("b"), F.coalesce(F.sum("n").over(Window.partitionBy(TRACE).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    ranked = rows.withColumn("n", F.row_number().over(local()))
    out = ranked.join(before, (F.col(TRACE) == F.col("t")) & (F.col(BUCKET) == F.col("b"))).withColumn("ord", F.col("n") + F.col("before"))
    return out.drop("n", "t", "b", "before", KEY, BUCKET)
