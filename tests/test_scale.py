"""Plans and slices that must hold at any size: one match a line, percentiles by rank, even slices, told encodings."""

import random

import pytest
from pyspark.sql import functions as F

from blkscope import testbed
from blkscope.operators import derive as D
from blkscope.operators import order as O
from blkscope.operators import stats as S
from blkscope.plans import export
from blkscope.plans.ingest import ingest
from blkscope.plans.view import Session, reparse
from blkscope.queries import QUERIES
from blkscope.sources import parse, store, text

CUS = "0x28,{},8,{},{}"


@pytest.mark.parametrize("kind", ["ufs", "block", "cus"])
def test_one_match_for_each_kind_of_a_line(spark, kind):
    lines = spark.createDataFrame([("t", 1, "x")], "trace string, line_no long, line string")
    plan = parse.events(parse.parsed(lines), kind)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") == 3, plan.count("regexp_replace(")


def test_a_delimiter_in_a_line_is_replaced(spark):
    lines = spark.createDataFrame([("t", 1, "a\x01b [0] d..1. 123.456: block_rq_issue: 8,0 R 0 () 2048 + 8 [x]"), ("t", 2, "\x01" * 5)], "trace string, line_no long, line string")
    rows = parse.parsed(lines).orderBy("line_no").collect()
    assert rows[0].block.process == "a\ufffdb" and rows[1].kind is None


def values(spark):
    rnd = random.Random(4)
    rows = [("a", "r", rnd.expovariate(1)) for _ in range(6000)] + [("a", "w", float(rnd.randrange(3))) for _ in range(3000)] + [("b", None, x) for x in (1.0, 2.0, None, 4.5)] + [("b", "n", None)]
    return spark.createDataFrame(rows, "trace string, key string, value double")


@pytest.mark.parametrize("few", [0, 1000, 100_000])
def test_percentiles_by_rank_are_exact(spark, monkeypatch, few):
    monkeypatch.setattr(S, "FEW", few)
    df = values(spark)
    got = {(r.trace, r.key): r for r in S.summarised(df, "trace", "key").collect()}
    want = df.groupBy("trace", "key").agg(F.count("value").alias("n"), F.max("value").alias("max"), F.percentile("value", S.RANKS).alias("p")).collect()
    assert len(got) == len(want)
    for r in want:
        if few < 6000 and r.n < 1000 and few < r.n:
            continue  # the margin of ranks is for more values than FEW has in earnest
        mine = got[r.trace, r.key]
        assert mine.n == r.n and mine.max == (r.max or 0.0) and (mine.p or None) == (r.p or None), (r, mine)


def test_no_percentile_holds_all_values(spark):
    plan = S.summarised(values(spark), "trace", "key")._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile(" not in plan.replace("percentile_approx(", "")


def burst(spark, n=4000):
    """Nine tenths of the rows within a thousandth of the time, and one stray row far behind."""
    rnd = random.Random(2)
    times = [rnd.random() for _ in range(n // 10)] + [0.5 + rnd.random() / 1000 for _ in range(n * 9 // 10)] + [1e9]
    rnd.shuffle(times)
    return spark.createDataFrame([("t", k, t) for k, t in enumerate(times)] + [("short", k, float(k)) for k in range(50)], "trace string, seq long, time double")


def test_slices_of_a_burst_are_even(spark):
    rows, single = O.ordered(burst(spark), bucket_rows=400)
    sizes = [r["count"] for r in rows.groupBy("trace", O.BUCKET).count().filter("trace = 't'").collect()]
    assert not single and len(sizes) == 11 and max(sizes) <= 500
    assert {r.trace: r["count(DISTINCT __bucket)"] for r in rows.groupBy("trace").agg(F.countDistinct(O.BUCKET)).collect()}["short"] == 1
    got = [(r.ord, r.time) for r in O.conditional_sort(burst(spark), bucket_rows=400).filter("trace = 't'").collect()]
    assert [t for _, t in sorted(got)] == sorted(t for _, t in got) and sorted(o for o, _ in got) == list(range(1, len(got) + 1))


def test_chunks_of_a_burst(spark):
    df = burst(spark).selectExpr("trace", "seq", "time AS start_time", "0L AS lba")
    rows = export.numbered(df, "cus", max_rows=500).collect()
    assert sorted(r.n for r in rows) == list(range(len(rows)))
    ordered = sorted(rows, key=lambda r: r.n)
    assert [(r.start_time, r.trace, r.seq) for r in ordered] == sorted((r.start_time, r.trace, r.seq) for r in rows)


def test_strict_order(spark):
    rows = [("t", k, float(k)) for k in range(1500)] + [("t", 1500, 3.5)]
    df = spark.createDataFrame(rows, "trace string, seq long, time double")
    late = {r.seq: r.ord for r in O.conditional_sort(df).collect()}
    strict = {r.seq: r.ord for r in O.conditional_sort(df, head=None).collect()}
    assert late[1500] == 1501 and strict[1500] == 5
    requests = spark.createDataFrame([("t", k, "0x28", k * 8, 8, t, t + 0.5) for k, (_, _, t) in enumerate(rows)], "trace string, seq long, opcode string, lba long, size long, start_time double, end_time double")
    assert D.derive(requests, "cus", strict_order=True).filter("seq = 1500").first().ctoc == 500.0
    assert D.derive(requests, "cus").filter("seq = 1500").first().ctoc == 0.0


def test_encodings_are_told(spark, tmp_path):
    korean = "프로세스-{} [0] d..1. 1.{}: block_rq_issue: 8,0 R 0 () 2048 + 8 [x]"
    lines = [korean.format(k, k) for k in range(3000)]
    for name, encoding in (("a.log", "cp949"), ("b.log", "utf-8"), ("c.log", "utf-16"), ("d.log", "utf-8-sig")):
        (tmp_path / name).write_bytes("\r\n".join(lines).encode(encoding))
    assert {k: len(v) for k, v in text.encodings(spark, str(tmp_path)).items()} == {"cp949": 1, "utf-8": 2, "utf-16-le": 1}
    spark.conf.set("spark.sql.files.maxPartitionBytes", 50_000)
    try:
        got = text.read_log(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    for name in "abcd":
        mine = sorted((r.line_no, r.line) for r in got if r.trace == f"{name}.log")
        assert mine == [(k + 1, x) for k, x in enumerate(lines)], name
    assert text.encoding_of("가나다".encode()[:7]) == "utf-8"


def test_later_bytes_that_are_no_utf8(spark, tmp_path):
    (tmp_path / "x.log").write_bytes(b"plain line\n" * 1000 + b"\xb0\xa1 end\n")
    assert text.read_log(spark, str(tmp_path / "x.log")).filter("line LIKE '% end'").first().line.startswith("\ufffd")
    with pytest.raises(Exception, match="UTF-?8|UTF8"):
        text.read_log(spark, str(tmp_path / "x.log"), strict=True).collect()


def test_order_of_a_folder_of_files(spark, tmp_path):
    for k in range(3):
        spark.range(k * 100, k * 100 + 100, 1, 1).selectExpr("'0x28' AS opcode", "id AS lba", "8L AS size", "double(id) AS start_time", "double(id) AS end_time", "0L AS start_qd", "0L AS end_qd", "0d AS dtoc", "0d AS ctoc", "0d AS ctod", "false AS continuous").write.mode("append").parquet(str(tmp_path / f"part{k}"))
    spark.read.parquet(*[str(tmp_path / f"part{k}") for k in range(3)]).repartition(4, "lba").sortWithinPartitions("lba").write.parquet(str(tmp_path / "ufscustom.parquet"))
    rows = store.load_files(spark, [str(tmp_path / "ufscustom.parquet")], "cus").orderBy("seq").collect()
    assert [r.seq for r in rows] == list(range(300))


def test_a_log_is_read_again(spark, tmp_path):
    log, folder = tmp_path / "l.log", str(tmp_path / "tables")
    log.write_text("\n".join(CUS.format(k, k, k + 1) for k in range(10)))
    catalog, session = store.Catalog(spark, str(tmp_path / "catalog")), Session(spark)
    ingest(spark, str(log), folder)
    number = catalog.add("l", str(log), "cus", folder)
    assert session.keep("l", store.load(spark, folder, "cus")).count() == 10
    log.write_text("\n".join(CUS.format(k, k, k + 1) for k in range(7)))
    counts = {r.kind: r.n for r in reparse(session, catalog, number).collect()}
    assert counts == {"cus": 7} and not session.kept and store.load(spark, folder, "cus").count() == 7
    (tmp_path / "tables" / "trace_temp_x.arrow").write_text("x")
    assert store.clean_catalog(catalog, -1) == 1


def test_a_part_of_all_stats_runs_no_other(spark, monkeypatch):
    """A histogram or the sizes alone take no passes for percentiles."""
    monkeypatch.setattr(S, "summarised", lambda *a: pytest.fail("percentiles were not asked for"))
    for name in ("block_allstats_histogram", "cus_allstats_histogram", "ufs_allstats_size_kb", "block_allstats_size"):
        assert QUERIES[name](spark, "/root/testdata/sf0.001").count()


@pytest.mark.parametrize("kind", ["ufs", "block", "cus"])
def test_steps_over_slices_start_from_written_rows(spark, kind):
    """The plan of a sliced trace holds each step's windows once, not again for each step behind it."""
    df = testbed.RAW[kind](spark, "/root/testdata/sf0.001")
    cut = D.derive(df, kind, bucket_rows=100)
    plan = cut._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") <= 4 and plan.count("Relation [") <= 6, plan
    assert sorted(map(str, cut.collect())) == sorted(map(str, D.derive(df, kind, bucket_rows=None).collect()))
