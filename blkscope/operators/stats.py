"""Latency, size and continuity statistics, each one aggregation over a filtered table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.units import bucket_label, bucket_labels, bucket_number, first_char, format_bytes
from ..schema import COMPLETE, GROUP, READ, SEND, UNIT_BYTES, UNMAP, WRITE
from ..sources.temp import beside, is_derived, materialised
from .filters import Range, apply_range, stats_rows

PERCENTILES = [0.99, 0.999, 0.9999, 0.99999, 0.999999]
PERCENTILE_NAMES = ["99th", "99.9th", "99.99th", "99.999th", "99.9999th"]
LATENCIES = ("dtoc", "ctoc", "ctod")
OPERATIONS = {"ufs": [READ, WRITE, UNMAP], "block": ["R", "W", "D"], "cus": [READ, WRITE, UNMAP]}


def group_of(kind: str, group: bool = False) -> Column:
    """What statistics are grouped by: opcode or io_type; with group the io_type's first character."""
    column = F.col(GROUP[kind])
    return first_char(column) if kind == "block" and group else column


def _check(kind: str, column: str) -> None:
    if column not in (*LATENCIES, *(("sector",) if kind == "block" else ())):
        raise ValueError(f"no statistics of {column} for {kind}")


def value_rows(df: DataFrame, kind: str, column: str, r: Range | None, hidden: list[str] | None, group: bool, more: tuple[str, ...] = ()) -> DataFrame:
    """(trace, key, value, more...) of the rows that a statistic is over; placeholders of 0.0 are among them."""
    _check(kind, column)
    rows = stats_rows(apply_range(df, kind, r, hidden), kind, column)
    return rows.select("trace", group_of(kind, group).alias("key"), F.col(column).cast("double").alias("value"), *more)


def latency_histogram(df: DataFrame, kind: str, column: str, thresholds: list[str], r: Range | None = None, hidden: list[str] | None = None, group: bool = False) -> DataFrame:
    """(trace, key, bucket_ord, bucket, n): every key of a trace has every bucket, empty ones with 0.

    Counting is one shuffle of (trace, key, bucket) sums; the zeros are added
    to these, by exploding the fixed list of buckets.
    """
    rows = value_rows(df, kind, column, r, hidden, group)
    return zero_filled(rows.select("trace", "key", bucket_number(F.col("value"), thresholds).alias("bucket_ord")), thresholds)


def zero_filled(rows: DataFrame, thresholds: list[str]) -> DataFrame:
    return zeros_between(rows.groupBy("trace", "key", "bucket_ord").agg(F.count("*").alias("n")), thresholds)


def zeros_between(counts: DataFrame, thresholds: list[str]) -> DataFrame:
    """(trace, key, bucket_ord, bucket, n) from the counts (trace, key, bucket_ord, n) of buckets that have rows; a null bucket tells of a key only."""
    per_key = counts.groupBy("trace", "key").agg(F.map_from_entries(F.collect_list(F.when(F.col("bucket_ord").isNotNull(), F.struct("bucket_ord", "n")))).alias("have"))
    labels = bucket_labels(thresholds)
    filled = per_key.select("trace", "key", "have", F.posexplode(F.array(*[F.lit(x) for x in labels])).alias("bucket_ord", "bucket"))
    return filled.select("trace", "key", "bucket_ord", "bucket", F.coalesce(F.try_element_at("have", F.col("bucket_ord")), F.lit(0)).alias("n"))


#: Of up to so many values all are looked at for a percentile; of more only those that a sketch places within
#: MARGIN of it, where the sketch is right to a rank in SKETCH.
FEW, SKETCH, MARGIN = 100_000, 10_000, 3e-4

#: Slices of the span near a percentile, of which one or two are put in order.
SLICES = 4096

RANKS = [0.5, *PERCENTILES]


def summarised(rows: DataFrame, *by: str) -> DataFrame:
    """One row per group of rows (by..., value): n, sum, average, population deviation and extremes of value, and p: the exact
    median and percentiles with linear interpolation; nulls don't count, and p is null without values.

    The first pass finds between which two values each percentile lies, the
    second counts what is below these and each value between them. Rows that
    windows or joins make are computed once and written as (by..., value) for both passes, and the sums and spans of
    groups are written too: these go to the rows, never the rows to them.
    So a group of any size is shared by all tasks, and only the few values near a
    percentile are put in order, see _at_ranks.
    """
    rows = rows.select(*by, "value")
    if is_derived(rows):
        rows = materialised(rows)
    value = F.col("value")
    nearby = [max(0.0, min(1.0, q + d)) for q in RANKS for d in (-MARGIN, MARGIN)]
    sums = materialised(rows.groupBy(*by).agg(*_moments(), F.percentile_approx(value, nearby, SKETCH).alias("near")))

    def end(k: int, whole: str) -> Column:
        return F.when((F.col("n") <= FEW) | F.lit(nearby[k] in (0.0, 1.0)), F.col(whole)).otherwise(F.col("near")[k])

    spans = F.array(*[F.struct(F.lit(k).alias("k"), end(2 * k, "low").alias("from"), end(2 * k + 1, "high").alias("to")) for k in range(len(RANKS))])
    groups = [F.col(c).alias(f"__{c}") for c in by]
    told = beside(sums.filter("n > 0").select(*groups, F.col("n").alias("__n"), spans.alias("spans")))
    seen = rows.filter(value.isNotNull()).select(*by, "value").join(told, _same(by)).select(*[f"__{c}" for c in by], "__n", "value", F.explode("spans").alias("s")).filter(value <= F.col("s.to"))
    counts = seen.groupBy(*[f"__{c}" for c in by], "__n", F.col("s.k").alias("k"), F.col("s.from").alias("from"), F.col("s.to").alias("to"), F.when(value >= F.col("s.from"), value).alias("v")).agg(F.count("*").alias("c"))
    return _told(sums, _at_ranks(materialised(counts), by), by)


def _same(by: tuple[str, ...]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by])


def _moments() -> list[Column]:
    value = F.col("value")
    return [
        F.count(value).alias("n"),
        F.coalesce(F.sum(value), F.lit(0.0)).alias("sum"),
        F.min(value).alias("low"),
        F.max(value).alias("high"),
        F.coalesce(F.avg(value), F.lit(0.0)).alias("avg"),
        F.coalesce(F.stddev_pop(value), F.lit(0.0)).alias("std_dev"),
    ]


def _at_ranks(counts: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """(__by..., p) from counts (__by..., __n, k, from, to, v, c): how often each value v between from and to is there, and with v null how many are below.

    The span of a percentile is cut into SLICES; the slices' sums tell which
    one or two of them hold its rank, and only these slices' values are put in order. p is null where a rank is not between from and to.
    """
    names = [f"__{c}" for c in by]
    at = [*names, "__n", "k"]
    width = F.col("to") - F.col("from")
    part = F.when(F.col("v").isNull(), -1).when(width > 0, F.least(F.floor((F.col("v") - F.col("from")) / width * SLICES), F.lit(SLICES - 1))).otherwise(0).cast("long")
    counts = counts.withColumn("slice", part)
    place = (F.col("__n") - 1) * F.element_at(F.array(*[F.lit(q) for q in RANKS]), F.col("k") + 1)
    upto = Window.partitionBy(*names, "k").orderBy("slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    slices = counts.groupBy(*at, "slice").agg(F.sum("c").alias("s")).withColumn("upto", F.sum("s").over(upto)).withColumn("before", F.col("upto") - F.col("s"))
    slices = slices.filter((F.col("before") <= F.ceil(place)) & (F.col("upto") > F.floor(place))).select(*[F.col(c).alias(f"s_{c}") for c in (*names, "k")], F.col("slice").alias("s_slice"), "before")
    found = counts.join(beside(slices), reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"s_{c}")) for c in (*names, "k", "slice")]))
    so_far = Window.partitionBy(*names, "k", "slice").orderBy(F.col("v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = found.select(*at, "v", (F.sum("c").over(so_far) + F.col("before")).alias("upto"), place.alias("place"))
    found = placed.groupBy(*names, "k", "place").agg(F.min(F.when(F.col("upto") > F.floor("place"), F.col("v"))).alias("a"), F.min(F.when(F.col("upto") > F.ceil("place"), F.col("v"))).alias("b"), F.max(F.when(F.col("v").isNull(), F.col("upto"))).alias("below"))
    inside = F.coalesce(F.col("below"), F.lit(0)) <= F.floor("place")
    between = (F.ceil("place") - F.col("place")) * F.col("a") + (F.col("place") - F.floor("place")) * F.col("b")
    exact = found.select(*names, "k", F.when(inside, F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(between)).alias("x"))
    p = exact.groupBy(*names).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("p"))
    return p.withColumn("p", F.when((F.size("p") == len(RANKS)) & ~F.exists("p", lambda x: x.isNull()), F.col("p")))


def _told(sums: DataFrame, p: DataFrame, by: tuple[str, ...]) -> DataFrame:
    extremes = [F.coalesce(a, F.lit(0.0)).alias(b) for a, b in (("low", "min"), ("high", "max"))]
    return sums.join(p, _same(by), "left").select(*by, "n", "sum", *extremes, "avg", "std_dev", "p")


def _with_percentiles(df: DataFrame) -> DataFrame:
    """median, a column for each percentile, and all of them as a map that is empty if there was nothing."""
    cols = [F.coalesce(F.col("p")[i + 1], F.lit(0.0)).alias(f"p{n.removesuffix('th').replace('.', '_')}") for i, n in enumerate(PERCENTILE_NAMES)]
    pairs = F.map_from_arrays(F.array(*[F.lit(n) for n in PERCENTILE_NAMES]), F.slice("p", 2, len(PERCENTILES)))
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))
    return df.select("*", F.coalesce(F.col("p")[0], F.lit(0.0)).alias("median"), *cols, F.when(F.col("n") > 0, pairs).otherwise(none).alias("percentiles")).drop("p")


def latency_summary(df: DataFrame, kind: str, column: str, r: Range | None = None, hidden: list[str] | None = None, group: bool = False) -> DataFrame:
    """One row per trace and key: n, sum, min, max, avg, std_dev, median and percentiles, all exact."""
    rows = value_rows(df, kind, column, r, hidden, group)
    return _with_percentiles(summarised(rows, "trace", "key"))


def size_stats(df: DataFrame, kind: str, column: str, r: Range | None = None, group: bool = False) -> DataFrame:
    """(trace, key, size, n), and with size null the key's total: one aggregation over grouping sets."""
    if kind != "cus":
        _check(kind, column)
        df = stats_rows(apply_range(df, kind, r), kind, column)
    else:
        df = apply_range(df, kind, r)
    return _sizes(df.select("trace", group_of(kind, group).alias("key"), "size"))


def _sizes(rows: DataFrame) -> DataFrame:
    sums = rows.groupBy("trace", "key", "size").agg(F.count("*").alias("n"))
    return sums.unionByName(sums.groupBy("trace", "key").agg(F.sum("n").alias("n")).withColumn("size", F.lit(None).cast("long")))


def continuity_stats(df: DataFrame, kind: str, r: Range | None = None) -> DataFrame:
    """One row per trace and key, and with key null the trace's total: counts, ratio, bytes and their ratio in per cent.

    ufs and block: sends of reads, writes and unmaps. The ratio of bytes of a
    key without any is null for these and 0 for requests.
    """
    return continuity_told(continuity_rows(apply_range(df, kind, r), kind, ("trace",)).groupBy("trace", "key").agg(*continuity_of()), kind)


def continuity_rows(rows: DataFrame, kind: str, more: tuple[str | Column, ...]) -> DataFrame:
    """(more..., key, continuous, bytes) of the rows that continuity is over."""
    key = F.col("opcode") if kind != "block" else first_char(F.col("io_type"))
    if kind != "cus":
        rows = rows.filter((F.col("action") == SEND[kind]) & key.isin(OPERATIONS[kind]))
    return rows.select(*more, key.alias("key"), "continuous", (F.col("size") * UNIT_BYTES[kind]).alias("bytes"))


def continuity_of() -> list[Column]:
    """The aggregates over continuity_rows; they add up."""
    return [
        F.count_if("continuous").alias("continuous"),
        F.count_if(~F.col("continuous")).alias("non_continuous"),
        F.sum("bytes").alias("total_bytes"),
        F.sum(F.when(F.col("continuous"), F.col("bytes")).otherwise(0)).alias("continuous_bytes"),
    ]


def continuity_told(sums: DataFrame, kind: str) -> DataFrame:
    """continuity_stats from the sums of each trace and key."""
    numbers = ["continuous", "non_continuous", "total_bytes", "continuous_bytes"]
    total = sums.groupBy("trace").agg(*[F.sum(c).alias(c) for c in numbers]).withColumn("key", F.lit(None).cast("string"))
    both = sums.unionByName(total)
    all_rows = F.col("continuous") + F.col("non_continuous")
    by_bytes = F.try_divide(F.col("continuous_bytes") * 100.0, F.col("total_bytes"))
    return both.select(
        "trace", "key", "continuous", "non_continuous", (F.col("continuous") * 100.0 / all_rows).alias("ratio"), "total_bytes", "continuous_bytes",
        (F.coalesce(by_bytes, F.lit(0.0)) if kind == "cus" else F.when(F.col("key").isNull(), F.coalesce(by_bytes, F.lit(0.0))).otherwise(by_bytes)).alias("bytes_ratio"),
    )


def qd_summary(df: DataFrame, kind: str = "ufs", r: Range | None = None) -> DataFrame:
    """Queue depth per trace and key over all rows."""
    depth = "start_qd" if kind == "cus" else "qd"
    rows = apply_range(df, kind, r).select("trace", group_of(kind).alias("key"), F.col(depth).cast("double").alias("value"))
    return _with_percentiles(summarised(rows, "trace", "key"))


def all_sizes(df: DataFrame, kind: str, r: Range | None = None, group: bool = False) -> DataFrame:
    """The sizes of all_stats: ufs over all actions in KB, block over completes, requests as size_stats."""
    rows = apply_range(df, kind, r)
    if kind == "block":
        rows = rows.filter(F.col("action") == COMPLETE[kind])
    return _sizes(rows.select("trace", group_of(kind, group).alias("key"), (F.col("size") * 4 if kind == "ufs" else F.col("size")).alias("size")))


def _all_values(df: DataFrame, kind: str, r: Range | None, group: bool) -> DataFrame:
    """(trace, key, latency, value): each row counted for the latencies it belongs to, with a null value for the others; one scan for all three."""
    rows = apply_range(df, kind, r)
    done = F.lit(True) if kind == "cus" else F.col("action") == COMPLETE[kind]
    sent = F.lit(True) if kind == "cus" else F.col("action") == SEND[kind]
    values = F.array(*[F.struct(F.lit(c).alias("latency"), F.when(sent if c == "ctod" else done, F.col(c)).alias("value")) for c in LATENCIES])
    return rows.select("trace", group_of(kind, group).alias("key"), F.explode(values).alias("v")).select("trace", "key", "v.latency", "v.value")


def all_histogram(df: DataFrame, kind: str, thresholds: list[str], r: Range | None = None, group: bool = False) -> DataFrame:
    """The histograms of all_stats."""
    named = F.concat_ws("\n", "latency", "key")
    long = _all_values(df, kind, r, group)
    filled = zero_filled(long.select("trace", named.alias("key"), F.when(F.col("value").isNotNull(), bucket_number(F.col("value"), thresholds)).alias("bucket_ord")), thresholds)
    return filled.select("trace", F.substring_index("key", "\n", 1).alias("latency"), F.regexp_extract("key", r"(?s)^[^\n]*\n(.*)$", 1).alias("key"), "bucket_ord", "bucket", "n")


def all_summary(df: DataFrame, kind: str, r: Range | None = None, group: bool = False) -> DataFrame:
    """The summaries of all_stats."""
    return _with_percentiles(summarised(_all_values(df, kind, r, group), "trace", "latency", "key"))


def all_stats(df: DataFrame, kind: str, thresholds: list[str], r: Range | None = None, group: bool = False) -> dict[str, DataFrame]:
    """Histograms and summaries of all latencies, sizes and continuity.

    histogram and summary have a column latency. For ufs and block every key of
    the filtered rows has them, with zeros where the latency has no rows. The
    summaries take passes of their own over the values; who wants one part alone asks for that.
    """
    return {"histogram": all_histogram(df, kind, thresholds, r, group), "summary": all_summary(df, kind, r, group), "sizes": all_sizes(df, kind, r, group), "continuity": continuity_stats(df, kind, r)}


def all_stats_json(df: DataFrame, kind: str, thresholds: list[str], r: Range | None = None, group: bool = False) -> DataFrame:
    """(trace, part, json): all_stats as one JSON object for each trace and part. Keys per trace are bounded by its operations."""
    parts = all_stats(df, kind, thresholds, r, group)
    rows = [p.select("trace", F.lit(name).alias("part"), F.struct(*[c for c in p.columns if c != "trace"]).alias("row")).groupBy("trace", "part").agg(F.to_json(F.sort_array(F.collect_list(F.to_json("row")))).alias("json")) for name, p in parts.items()]
    return reduce(DataFrame.unionByName, rows)


def rwd_dashboard(df: DataFrame, kind: str, r: Range | None = None) -> DataFrame:
    """Reads, writes and unmaps of continuity_stats as shown: total, ratios to two decimals, bytes in words."""
    rows = continuity_stats(df, kind, r).filter(F.col("key").isin(OPERATIONS[kind]))
    return rows.select(
        "trace", "key", (F.col("continuous") + F.col("non_continuous")).alias("total"), F.round("ratio", 2).alias("ratio"),
        format_bytes(F.col("total_bytes")).alias("bytes"), F.round(F.coalesce("bytes_ratio", F.lit(0.0)), 2).alias("bytes_ratio"),
    )


def bucketed(df: DataFrame, column: str, thresholds: list[str]) -> DataFrame:
    """df with the label of its row's bucket."""
    return df.withColumn("bucket", bucket_label(F.col(column), thresholds))
