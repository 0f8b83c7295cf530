"""Jobs that are cancelled apart, counts from footers, and patterns tried as a table function."""

import threading
import time

from pyspark import InheritableThread
from pyspark.sql import functions as F

from blkscope.plans.view import Session
from blkscope.schema import TABLES
from blkscope.sources import patterns, store


def test_one_of_two_jobs_is_cancelled(spark):
    session, told, ready = Session(spark), {}, {}

    def work(name, seconds):
        with session.job(name) as tag:
            ready[name] = tag
            try:
                spark.range(4, numPartitions=4).select(F.expr(f"reflect('java.lang.Thread', 'sleep', bigint({seconds * 1000}))")).write.format("noop").mode("overwrite").save()
                told[name] = "ended"
            except Exception as e:  # noqa: BLE001
                told[name] = "cancelled" if "cancel" in str(e).lower() else repr(e)

    started = [InheritableThread(target=work, args=a) for a in (("long", 40), ("short", 4))]
    for t in started:
        t.start()
    while len(ready) < 2:
        time.sleep(0.1)
    until = time.time() + 50
    while started[0].is_alive() and time.time() < until:  # its job may not have begun yet
        time.sleep(1)
        session.cancel(ready["long"])
    for t in started:
        t.join(50)
    assert told == {"long": "cancelled", "short": "ended"}
    assert session.running == set() and isinstance(started[0], threading.Thread)
    spark.range(3).count()  # this thread was never touched


def test_counts_from_footers_read_no_column(spark, tmp_path):
    rows = spark.range(1000).select(*[(F.when(F.col("id") % 10 == 0, "b").otherwise("a") if c == "trace" else F.col("id").cast(t)).alias(c) for c, t in (x.split() for x in TABLES["cus"].split(", "))])
    store.save(rows, str(tmp_path), "cus")
    got = store.footer_lengths(spark, str(tmp_path), ["cus"])
    assert [tuple(r) for r in got.collect()] == [("cus", 1000)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [COUNT(*)]" in plan
    by = store.footer_lengths(spark, str(tmp_path), ["cus"], traces=True)
    assert sorted(map(tuple, by.collect())) == [("cus", "a", 900), ("cus", "b", 100)]
    assert spark.conf.get("spark.sql.sources.useV1SourceList") != ""


def test_a_pattern_gives_columns_of_its_names(spark):
    df = spark.createDataFrame([("ab12",), ("zz",), (" ",), ("b",)], "line string")
    pattern = r"(?P<word>[a-b]+)(?P<whole>\d+)?"
    got = patterns.matched_lines(df, pattern)
    assert got.columns == ["line", "matched", "whole", "captures", "word", "whole_"]
    rows = {r["line"]: tuple(r)[1:] for r in got.collect()}
    want = {r["line"]: (r["matched"], r["whole"], r["captures"], r["named"].get("word"), r["named"].get("whole")) for r in patterns.test_pattern(df, pattern).collect()}
    assert rows == want and len(rows) == 3


def test_a_pattern_that_is_none_gives_an_error_row(spark):
    got = patterns.matched_lines(spark.createDataFrame([("a'b",)], "line string"), "(?P<x>[")
    assert got.columns == ["line", "error"]
    assert "unterminated" in got.first()["error"]


def test_match_line_in_sql(spark):
    patterns.register_match_line(spark)
    spark.createDataFrame([("x=1",), ("y=22",)], "line string").createOrReplaceTempView("own_lines")
    got = spark.sql("SELECT t.name, t.value FROM own_lines l, LATERAL match_line('(?P<name>[a-z])=(?P<value>[0-9]+)', l.line) t WHERE t.matched")
    assert sorted(map(tuple, got.collect())) == [("x", "1"), ("y", "22")]
