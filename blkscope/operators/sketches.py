"""Rank sketches at rest beside a stored table: merged, they tell near which values its percentiles lie, so that one scan gives these exactly.

Every file has a sketch (KLL) of each key's latencies. Files that come later
are sketched alone. A merged sketch is wrong by a small share of the ranks with high
probability, not for certain; where an exact count shows that a rank lies outside of what it told, that group is computed without it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import store
from ..sources.temp import materialised
from .stats import LATENCIES, RANKS, _at_ranks, _moments, _same, _told, _with_percentiles, summarised, value_rows

#: Size of a sketch, and the share of ranks to either side of a percentile within which it is looked for.
K, SPAN = 8192, 2e-3
SCHEMA = "file string, trace string, key string, latency string, n long, sketch binary"


def _folder(folder: str, kind: str) -> str:
    return f"{folder}/_sketches/{kind}"


def sketch_files(spark: SparkSession, folder: str, kind: str) -> list[str]:
    """Sketches the files of a stored table that have none yet; returns these."""
    df = store.load(spark, folder, kind)
    path, fs = store.file_system(spark, _folder(folder, kind))
    known = {r["file"] for r in spark.read.schema(SCHEMA).parquet(_folder(folder, kind)).select("file").distinct().collect()} if fs.exists(path) else set()
    fresh = sorted(set(df.inputFiles()) - known)
    if not fresh:
        return []
    own = df if not known else spark.read.option("basePath", f"{folder}/{kind}").schema(df.schema).parquet(*fresh)
    parts = None
    for latency in LATENCIES:
        rows = value_rows(own.withColumn("__file", F.input_file_name()), kind, latency, None, None, False, more=("__file",))
        part = rows.groupBy(F.col("__file").alias("file"), "trace", "key").agg(F.count("value").alias("n"), F.kll_sketch_agg_double("value", K).alias("sketch")).select("file", "trace", "key", F.lit(latency).alias("latency"), "n", "sketch")
        parts = part if parts is None else parts.unionByName(part)
    parts.write.mode("append").parquet(_folder(folder, kind))
    return fresh


def summary_at_rest(spark: SparkSession, folder: str, kind: str, column: str, traces: list[str] | None = None) -> DataFrame:
    """latency_summary of a stored table without a range: its events are scanned once.

    Sketches of all files are merged by trace and key; the scan counts, for each
    percentile, what is below its span and each value within it, beside the sums.
    """
    sketch_files(spark, folder, kind)
    by = ("trace", "key")
    near = spark.read.schema(SCHEMA).parquet(_folder(folder, kind)).filter((F.col("latency") == column) & (F.col("n") > 0))
    near = near if traces is None else near.filter(F.col("trace").isin(traces))
    ranks = F.array(*[F.lit(max(0.0, min(1.0, q + d))) for q in RANKS for d in (-SPAN, SPAN)])
    ends = near.groupBy(*by).agg(F.kll_sketch_get_quantile_double(F.kll_merge_agg_double("sketch"), ranks).alias("ends"))
    everything = float("inf")
    spans = F.array(*[
        F.struct(F.lit(k).alias("k"), (F.lit(-everything) if q - SPAN <= 0 else F.col("ends")[2 * k]).alias("from"), (F.lit(everything) if q + SPAN >= 1 else F.col("ends")[2 * k + 1]).alias("to"))
        for k, q in enumerate(RANKS)
    ])
    told = ends.select(*[F.col(c).alias(f"__{c}") for c in by], spans.alias("spans"))

    rows = value_rows(store.load(spark, folder, kind, traces), kind, column, None, None, False)
    value = F.col("value")
    whole = F.struct(F.lit(-1).alias("k"), F.lit(None).cast("double").alias("from"), F.lit(None).cast("double").alias("to"))
    wide = rows.join(told, _same(by), "left").select(*by, "value", F.explode(F.concat(F.array(whole), F.filter(F.coalesce("spans", F.array().cast("array<struct<k:int,from:double,to:double>>")), lambda s: value <= s["to"]))).alias("s"))
    seen = wide.groupBy(*by, F.col("s.k").alias("k"), F.col("s.from").alias("from"), F.col("s.to").alias("to"), F.when(value >= F.col("s.from"), value).alias("v")).agg(F.count("*").alias("c"), *_moments())
    seen = materialised(seen)
    sums = seen.filter("k = -1").drop("k", "from", "to", "v", "c")
    n = sums.select(*[F.col(c).alias(f"__{c}") for c in by], F.col("n").alias("__n"))
    counts = seen.filter("k >= 0").select(*by, "k", "from", "to", "v", "c").join(n, _same(by)).drop(*by)
    inner = F.col("v").isNotNull()
    limits = counts.groupBy("__trace", "__key", "k").agg(F.min(F.when(inner, F.col("v"))).alias("low"), F.max(F.when(inner, F.col("v"))).alias("high")).select(F.col("__trace").alias("l_trace"), F.col("__key").alias("l_key"), F.col("k").alias("l_k"), "low", "high")
    same = F.col("__trace").eqNullSafe(F.col("l_trace")) & F.col("__key").eqNullSafe(F.col("l_key")) & (F.col("k") == F.col("l_k"))
    counts = counts.drop("from", "to").join(limits, same).select("__trace", "__key", "__n", "k", F.col("low").alias("from"), F.col("high").alias("to"), "v", "c")
    out = _told(sums, materialised(_at_ranks(counts, by)), by)
    missed = materialised(out.filter("n > 0 AND p IS NULL").select(*[F.col(c).alias(f"__{c}") for c in by]))
    if missed.isEmpty():
        return _with_percentiles(out)
    again = summarised(rows.join(missed, _same(by), "left_semi"), *by)
    return _with_percentiles(out.filter("n = 0 OR p IS NOT NULL").unionByName(again))
