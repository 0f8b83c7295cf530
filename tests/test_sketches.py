"""Percentiles from sketches at rest, in one scan, against the ones without."""

import random

import pytest
from pyspark.sql import functions as F

from blkscope.operators import order, sketches, stats
from blkscope.schema import TABLES
from blkscope.sources import store, temp


def table(spark, seed, n):
    rnd = random.Random(seed)
    rows = [(t, i, "0x28" if rnd.random() < 0.7 else "0x2a", i, 1, float(i), float(i + 1), 1, 0, rnd.choice([0.0, rnd.expovariate(1), 3.5]), rnd.random(), 1.0, False) for t in "ab" for i in range(n)]
    return spark.createDataFrame(rows, TABLES["cus"])


def plain(df):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.drop("percentiles").collect()), key=str)


def test_equal_to_the_summary_and_one_scan(spark, tmp_path):
    folder = str(tmp_path)
    store.save(table(spark, 1, 4000), folder, "cus")
    for column in ("dtoc", "ctod"):
        got = sketches.summary_at_rest(spark, folder, "cus", column)
        want = stats.latency_summary(store.load(spark, folder, "cus"), "cus", column).select(got.columns)
        assert plain(got) == plain(want)


def test_only_new_files_are_sketched(spark, tmp_path):
    folder = str(tmp_path)
    store.save(table(spark, 1, 300), folder, "cus")
    first = sketches.sketch_files(spark, folder, "cus")
    assert first and sketches.sketch_files(spark, folder, "cus") == []
    store.save(table(spark, 2, 200).withColumn("trace", F.concat("trace", F.lit("2"))), folder, "cus")
    second = sketches.sketch_files(spark, folder, "cus")
    assert second and not set(first) & set(second)
    want = stats.latency_summary(store.load(spark, folder, "cus"), "cus", "dtoc")
    assert plain(sketches.summary_at_rest(spark, folder, "cus", "dtoc").select(want.columns)) == plain(want)


def test_a_sketch_that_is_wrong_changes_nothing(spark, tmp_path, monkeypatch):
    folder = str(tmp_path)
    store.save(table(spark, 3, 500), folder, "cus")
    wrong = spark.createDataFrame([(f, t, k) for f in store.load(spark, folder, "cus").inputFiles() for t in "ab" for k in ("0x28", "0x2a")], "file string, trace string, key string")
    bad = spark.range(100).select((F.col("id") + 50.0).alias("x")).agg(F.kll_sketch_agg_double("x").alias("sketch")).first()["sketch"]
    wrong.select("file", "trace", "key", F.lit("dtoc").alias("latency"), F.lit(100).cast("long").alias("n"), F.lit(bad).alias("sketch")).write.parquet(f"{folder}/_sketches/cus")
    want = stats.latency_summary(store.load(spark, folder, "cus"), "cus", "dtoc")
    assert plain(sketches.summary_at_rest(spark, folder, "cus", "dtoc").select(want.columns)) == plain(want)


def test_a_span_of_very_many_values_is_cut_into_slices(spark):
    """What is put in order for a percentile is a slice of the values near it."""
    rnd = random.Random(5)
    df = spark.createDataFrame([("t", "k", rnd.gauss(0, 1)) for _ in range(20000)], "trace string, key string, value double")
    (row,) = stats.summarised(df, "trace", "key").collect()
    want = df.agg(F.percentile("value", stats.RANKS)).first()[0]
    assert row["p"] == pytest.approx(want, rel=1e-12)
    hot = spark.createDataFrame([("t", "k", 7.0)] * 500 + [("t", None, None)], "trace string, key string, value double")
    rows = {r["key"]: r["p"] for r in stats.summarised(hot, "trace", "key").collect()}
    assert rows == {"k": [7.0] * 6, None: None}


def test_derived_rows_are_written_once(spark, monkeypatch):
    from pyspark.sql import Window

    seen = []
    monkeypatch.setattr(stats, "materialised", lambda df, plain=stats.materialised: (seen.append(df.columns), plain(df))[1])
    df = spark.range(50).select(F.lit("t").alias("trace"), F.lit("k").alias("key"), F.sum("id").over(Window.orderBy("id")).cast("double").alias("value"))
    stats.summarised(df, "trace", "key").collect()
    assert seen[0] == ["trace", "key", "value"]


def joined(monkeypatch, module):
    """The physical plans of what a module writes from now on."""
    plans = []
    monkeypatch.setattr(module, "materialised", lambda df, plain=module.materialised: (plans.append(df._jdf.queryExecution().executedPlan().toString()), plain(df))[1])
    return plans


def test_rows_are_never_sent_to_the_spans(spark, monkeypatch):
    """Millions of rows can be a file of a few MB, which Spark would send through the driver to the spans and slices of a few groups."""
    plans = joined(monkeypatch, stats)
    df = spark.range(200_000).select(F.lit("t").alias("trace"), (F.col("id") % 3).cast("string").alias("key"), (F.col("id") % 7).cast("double").alias("value")).distinct().crossJoin(spark.range(10_000).select("id")).drop("id")
    summary = stats.summarised(df, "trace", "key")
    plans.append(summary._jdf.queryExecution().executedPlan().toString())
    assert sum("BuildRight" in p for p in plans) >= 2 and not any("BuildLeft" in p for p in plans), plans
    assert {(r["key"], r["n"], r["p"][0]) for r in summary.collect()} == {("0", 70_000, 3.0), ("1", 70_000, 3.0), ("2", 70_000, 3.0)}


@pytest.mark.parametrize("few", [0, 2, 10_000])
def test_many_groups_are_merged_with_the_rows(spark, monkeypatch, few):
    monkeypatch.setattr(temp, "FEW_ROWS", few)
    plans = joined(monkeypatch, stats)
    rnd = random.Random(6)
    df = spark.createDataFrame([("t", rnd.choice(["a", "b", None]), rnd.choice([None, 0.0, rnd.gauss(0, 1)])) for _ in range(3000)], "trace string, key string, value double")
    got = {r["key"]: (r["n"], r["p"]) for r in stats.summarised(df, "trace", "key").collect()}
    assert got == {r["key"]: (r["n"], r["p"]) for r in df.groupBy("key").agg(F.count("value").alias("n"), F.percentile("value", stats.RANKS).alias("p")).collect()}
    assert any("SortMergeJoin" in p for p in plans) == (few < 10_000) and any("BroadcastHashJoin" in p for p in plans) == (few == 10_000)


def test_rows_are_never_sent_to_the_ends_of_slices(spark, monkeypatch):
    """Traces of one name meet the ends without a key, and Spark would send what is small on disk."""
    plans = joined(monkeypatch, order)
    keyed = spark.range(1000).select(F.lit("t").alias("trace"), F.col("id").alias("seq"), F.col("id").cast("double").alias("__key"))
    rows, single = order.sliced(keyed, 100)
    assert not single and rows.count() == 1000 and 10 <= rows.select("__bucket").distinct().count() <= 11
    assert "BuildRight" in plans[0] and "BuildLeft" not in plans[0], plans[0]
