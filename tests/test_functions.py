import math

import pytest
from pyspark.sql import functions as F

from blkscope.functions import units as U
from blkscope.operators import points as P
from blkscope.operators import stats as S
from blkscope.operators.filters import Range, apply_range, chart_rows, view_range
from blkscope.operators.sample import sample_exact, sampling_info
from blkscope.plans.export import report_csv
from blkscope.plans.view import Session, save_arrow, to_arrow, with_counts
from blkscope.queries import QUERIES
from blkscope.schema import TABLES


def test_times():
    assert [U.time_to_ms(x) for x in ("0.1ms", "1s", "5us", "7ns", "1000s")] == [0.1, 1000.0, 0.005, 7e-06, 1e6]
    for bad in ("1min", "ms", "1", "-1ms", "1e3ms", "1.2.3s"):
        with pytest.raises(ValueError):
            U.time_to_ms(bad)


def test_columns(spark):
    df = spark.createDataFrame([("0.1ms", 0), ("3s", 1), ("5min", 1023), ("x", 1536), ("", 1048576), ("2us", 5 * 1024**4), ("1ms", 2048 * 1024**4)], "t string, n long")
    rows = df.select(U.time_to_ms_column(F.col("t")).alias("ms"), U.format_bytes(F.col("n")).alias("b")).collect()
    assert [r.ms for r in rows] == [0.1, 3000.0, None, None, None, 0.002, 1.0]
    assert [r.b for r in rows] == ["0 Bytes", "1 Bytes", "1023 Bytes", "1.5 KB", "1 MB", "5 TB", "2048 TB"]
    hexes = spark.createDataFrame([("0x1A",), ("ff",), ("0",), ("g",), ("",), ("123456789012345678",)], "x string")
    assert [r.v for r in hexes.select(U.from_hex(F.col("x")).alias("v")).collect()] == [26, 255, 0, None, None, None]


def test_bucket_edges(spark):
    values = [0.0, 0.1, 0.1000001, 0.5, 1.0, 1e6, 1e6 + 1, -5.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r.b for r in df.select(U.bucket_label(F.col("v"), U.THRESHOLDS).alias("b")).collect()]
    assert got == ["01_≤ 0.1ms", "01_≤ 0.1ms", "02_0.1ms < v ≤ 0.5ms", "02_0.1ms < v ≤ 0.5ms", "03_0.5ms < v ≤ 1ms", "15_500s < v ≤ 1000s", "99_> 1000s", "01_≤ 0.1ms"]
    assert U.bucket_labels([]) == ["전체"] and len(U.bucket_labels(U.THRESHOLDS)) == 16


def ufs(spark, rows):
    full = [("t", k, float(k), "p", cpu, action, 0, op, lba, size, 0, 0, qd, d, c, t, cont) for k, (cpu, action, op, lba, size, qd, d, c, t, cont) in enumerate(rows)]
    return spark.createDataFrame(full, TABLES["ufs"])


ROWS = [
    (0, "send_req", "0x28", 1, 0, 1, 0.0, 0.0, 0.0, False),
    (1, "complete_rsp", "0x28", 1, 0, 0, 1000.0, 1000.0, 0.0, False),
    (9, "send_req", "0x2a", 5, 3, 1, 0.0, 0.0, 1000.0, True),
    (9, "complete_rsp", "0x28", 5, 3, 0, 0.0, 0.05, 0.0, False),
    (2, "query_req", "0x35", 0, 9, 0, 0.0, 0.0, 0.0, False),
]


def test_statistics(spark):
    df = ufs(spark, ROWS)
    hist = S.latency_histogram(df, "ufs", "dtoc", ["1ms", "1s"]).collect()
    assert sorted((r.key, r.bucket_ord, r.n) for r in hist) == [("0x28", 0, 1), ("0x28", 1, 1), ("0x28", 2, 0)]
    (s,) = S.latency_summary(df, "ufs", "dtoc").collect()
    assert (s.n, s.sum, s.min, s.max, s.avg, s.median, s.std_dev) == (2, 1000.0, 0.0, 1000.0, 500.0, 500.0, 500.0)
    assert math.isclose(s.p99, 990.0) and set(s.percentiles) == set(S.PERCENTILE_NAMES)
    everything = S.all_stats(df, "ufs", ["1ms"])
    empty = [r for r in everything["summary"].collect() if r.key == "0x35"]
    assert len(empty) == 3 and all(r.n == 0 and r.sum == r.p99 == r.median == 0.0 and r.percentiles == {} for r in empty)
    assert sum(r.n for r in everything["histogram"].collect()) == 2 + 2 + 2
    rows = {r.key: r for r in S.continuity_stats(df, "ufs").collect()}
    assert rows["0x28"].bytes_ratio is None and rows["0x2a"].bytes_ratio == 100.0 and rows[None].ratio == 50.0 and rows[None].total_bytes == 3 * 4096
    assert {(r.key, r["size"]): r.n for r in S.size_stats(df, "ufs", "ctod").collect()} == {("0x28", 0): 1, ("0x28", None): 1, ("0x2a", 3): 1, ("0x2a", None): 1}
    assert S.all_stats_json(df, "ufs", ["1ms"]).count() == 4
    with pytest.raises(ValueError):
        S.latency_summary(df, "ufs", "sector")
    for made in (S.latency_histogram(df.limit(0), "ufs", "dtoc", ["1ms"]), S.latency_summary(df.limit(0), "ufs", "dtoc"), S.continuity_stats(df.limit(0), "ufs")):
        assert made.count() == 0


def test_report(spark, tmp_path):
    report_csv(S.latency_summary(ufs(spark, ROWS), "ufs", "ctoc"), str(tmp_path / "r"))
    (row,) = spark.read.option("header", True).csv(str(tmp_path / "r")).collect()
    assert (row.key, row.n, row["avg"], "percentiles" in row) == ("0x28", "2", "500.025", False)


def test_filters(spark):
    df = ufs(spark, ROWS)

    def seqs(r=None, hidden=None):
        return sorted(x.seq for x in apply_range(df, "ufs", r, hidden).collect())

    assert seqs(Range(time_from=1.0, time_to=2.0)) == [1, 2]
    assert seqs(Range(time_from=0, time_to=0)) == seqs(Range(time_from=3.0)) == [0, 1, 2, 3, 4]
    assert seqs(Range("lba", col_from=1, col_to=1)) == [0, 1] and seqs(Range("tag", col_from=0, col_to=1)) == []
    assert seqs(hidden=["0x28", "2"]) == [2]
    assert view_range("cus", Range("qd", 1, 2, 3, 4)).column == "start_qd"
    counts = [chart_rows(df, "ufs", y, a).count() for y, a in (("lba", None), ("dtoc", None), ("lba", "c"), ("dtoc", "d"), ("lba", "send_req"))]
    assert counts == [2, 2, 2, 2, 5]


def test_pushdown(spark, tmp_path):
    ufs(spark, ROWS).write.parquet(str(tmp_path / "u"))
    df = apply_range(spark.read.parquet(str(tmp_path / "u")), "ufs", Range("lba", 1.0, 3.0, 0, 4))
    plan = S.latency_summary(df, "ufs", "dtoc")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(time,1.0)" in plan
    schema = plan.split("ReadSchema: struct<")[1].split(">")[0]
    assert {c.split(":")[0] for c in schema.split(",")} == {"trace", "time", "action", "opcode", "lba", "dtoc"}


def test_samples(spark):
    df = ufs(spark, ROWS * 40).repartition(5)
    got = [r.seq for r in sample_exact(df, 30).collect()]
    assert len(got) == 30 and got == sorted(got) and got == [r.seq for r in sample_exact(df.repartition(2), 30).collect()]
    assert sampling_info(10, 5)["sampling_ratio"] == 50.0 and sampling_info(4, 5)["sampling_ratio"] == 100.0
    rows, info = with_counts(df, 1000)
    assert rows.count() == 200 and tuple(info.first()) == (200, 200, 100.0)


def test_points(spark, tmp_path):
    df = ufs(spark, ROWS)
    pts = P.points(df, "ufs", "time", "dtoc", "opcode", hover=("qd",))
    assert [(r.x, r.y, r.legend, r.hover_qd) for r in pts.collect()] == [(1.0, 1000.0, "0x28", 0)]
    assert tuple(P.bounds(pts, "dtoc").first()) == (1.0, 1.0, 0.0, 1000.0, 1)
    assert tuple(P.bounds(P.points(df, "ufs", "time", "cpu", "cpu", "d"), "cpu").first())[2:4] == (-1.0, 8.0)
    assert [r.legend for r in P.legends(df, "opcode").orderBy("position").collect()] == ["0x28", "0x2a", "0x35"]
    assert {r.legend_index for r in P.typed(P.points(df, "ufs", "time", "lba", "opcode")).collect()} == {0, 1}
    assert P.zoomed("lba", 5, 1, 9, 2) == Range("lba", 1, 5, 2, 9)
    assert to_arrow(pts).num_rows == 1 and save_arrow(pts, str(tmp_path / "p.arrow")).endswith("p.arrow")


def test_session(spark):
    s = Session(spark)
    df = s.keep("a", ufs(spark, ROWS))
    assert s.keep("a", ufs(spark, [])) is df and df.count() == 5
    s.start()
    s.cancel()
    assert s.cancelled
    s.clear()
    assert not s.kept


def test_bytes_at_the_edges_and_beyond_a_long(spark):
    near = [1024**k + d for k in range(1, 5) for d in (-1, 0)]
    df = spark.createDataFrame([(n,) for n in near], "n long")
    assert [r.b for r in df.select(U.format_bytes(F.col("n")).alias("b")).collect()] == ["1023 Bytes", "1 KB", "1024 KB", "1 MB", "1024 MB", "1 GB", "1024 GB", "1 TB"]
    wide = spark.sql("SELECT CAST('1000000000000000000000' AS DECIMAL(38,0)) AS n")
    assert wide.select(U.format_bytes(F.col("n")).alias("b")).first().b == "909494701.77 TB"


def test_format_bytes_of_large_keys(spark, tmp_path):
    """Keys as 60 copies of sf0.1 have them: their product is beyond a long."""
    rows = [(8_999_999, 899_999), (3_000, 7), (None, 1), (5, 0)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
    got = {r.o_orderkey: r.shown for r in QUERIES["format_bytes"](spark, str(tmp_path)).collect()}
    assert got == {8_999_999: f"{round(8_999_999**2 * 899_999 / 1024**4, 2)} TB", 3_000: "60.08 MB", None: "0 Bytes", 5: "0 Bytes"}
