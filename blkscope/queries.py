"""The registered queries over the tables of testbed, and the same in DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import testbed
from .functions.units import THRESHOLDS, bucket_label, bucket_labels, format_bytes, time_to_ms, time_to_ms_column
from .operators import points as P
from .operators import stats as S
from .operators.derive import Carried, dedup_block, derive
from .operators.filters import Range, apply_range, hide_many
from .operators.order import conditional_sort
from .operators.pyramid import Pyramid
from .operators.resume import at_rest, resume
from .operators.sample import sample_exact
from .operators.sketches import summary_at_rest
from .plans.export import chunks
from .plans.view import filter_trace
from .schema import COMPLETE, SEND
from .sources import parse, store
from .sources.patterns import DEFAULTS, test_pattern
from .sources.temp import PREFIX, materialised, shared_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

WITH = f"WITH {testbed.SQL}"
TIMES = {"ufs": "time", "block": "time", "cus": "start_time"}


def register(name: str, query: Query, sql: str | None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLE_SQL[name] = f"{WITH} {sql}"


def table(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    return derive(testbed.RAW[kind](spark, folder), kind)


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 4) for c in columns})


# Derivation

DERIVED = {
    "ufs": {"qd": "qd", "dtoc": "dtoc", "ctod": "ctod", "ctoc": "ctoc", "continuous": "continuous"},
    "block": {"qd": "qd", "dtoc": "dtoc", "ctod": "ctod", "ctoc": "ctoc", "continuous": "continuous"},
}
for _kind, _columns in DERIVED.items():
    for _name, _column in _columns.items():
        _shown = f"round({_column}, 4) AS {_column}" if _column in S.LATENCIES else _column
        register(f"{_kind}_{_name}", lambda s, d, k=_kind, e=_shown: table(s, d, k).selectExpr("seq", "action", e), f"SELECT seq, action, {_shown} FROM d_{_kind}")
register("block_dedup", lambda s, d: dedup_block(testbed.block(s, d)).select("seq", "action", "io_type", "sector", "size"), "SELECT seq, action, io_type, sector, size FROM dedup_block")
register("cus_qd", lambda s, d: table(s, d, "cus").select("seq", "start_qd", "end_qd"), "SELECT seq, start_qd, end_qd FROM d_cus")
_LAT = ", ".join(f"round({c}, 4) AS {c}" for c in S.LATENCIES)
register("cus_latency", lambda s, d: table(s, d, "cus").selectExpr("seq", *[f"round({c}, 4) AS {c}" for c in S.LATENCIES]), f"SELECT seq, {_LAT} FROM d_cus")
register("cus_continuous", lambda s, d: table(s, d, "cus").select("seq", "continuous"), "SELECT seq, continuous FROM d_cus")


def shuffled(spark: SparkSession, folder: str) -> DataFrame:
    """The ufs events with their first lines out of order, so that they are sorted by time."""
    return testbed.ufs(spark, folder).withColumn("seq", F.when(F.col("seq") < 100, 99 - F.col("seq")).otherwise(F.col("seq")))


register(
    "conditional_sort",
    lambda s, d: conditional_sort(shuffled(s, d)).select("ord", "seq", F.round("time", 6).alias("time")),
    "SELECT row_number() OVER (ORDER BY time, q) AS ord, q AS seq, round(time, 6) AS time FROM (SELECT *, CASE WHEN seq < 100 THEN 99 - seq ELSE seq END AS q FROM tb_ufs)",
)

# Filters

T0 = 1704067200.0
_HOUR = Range(time_from=T0 + 3600.0, time_to=T0 + 90000.0)
register("filter_time", lambda s, d: apply_range(table(s, d, "ufs"), "ufs", _HOUR).select("seq", "qd"), f"SELECT seq, qd FROM d_ufs WHERE time BETWEEN {T0 + 3600.0} AND {T0 + 90000.0}")
register("filter_column", lambda s, d: apply_range(table(s, d, "block"), "block", Range("sector", col_from=2, col_to=4)).select("seq", "sector"), "SELECT seq, sector FROM d_block WHERE sector BETWEEN 2 AND 4")
register("filter_column_latency", lambda s, d: apply_range(table(s, d, "cus"), "cus", Range("ctoc", col_from=0.5, col_to=50000)).select("seq", F.round("ctoc", 4).alias("ctoc")), "SELECT seq, round(ctoc, 4) AS ctoc FROM d_cus WHERE ctoc BETWEEN 0.5 AND 50000")
register("filter_unknown_column", lambda s, d: apply_range(table(s, d, "cus"), "cus", Range("qd", col_from=1, col_to=4)).select("seq"), "SELECT seq FROM d_cus WHERE false")
register("filter_one_sided", lambda s, d: apply_range(table(s, d, "ufs"), "ufs", Range("qd", time_from=5.0, col_from=0, col_to=0)).select("seq"), "SELECT seq FROM d_ufs")
register("filter_legend", lambda s, d: apply_range(table(s, d, "ufs"), "ufs", None, ["0x28", "3"]).select("seq", "opcode", "cpu"), "SELECT seq, opcode, cpu FROM d_ufs WHERE opcode NOT IN ('0x28', '3') AND CAST(cpu AS VARCHAR) NOT IN ('0x28', '3')")
register(
    "filter_legend_table",
    lambda s, d: hide_many(table(s, d, "block"), "block", s.createDataFrame([("WS",), ("5",)], "legend string")).select("seq", "io_type", "cpu"),
    "SELECT seq, io_type, cpu FROM d_block WHERE io_type NOT IN ('WS', '5') AND CAST(cpu AS VARCHAR) NOT IN ('WS', '5')",
)
_SAMPLE = "ORDER BY md5('12345:t:' || seq), seq LIMIT {n}"
register("sample_exact", lambda s, d: sample_exact(table(s, d, "ufs"), 777).select("seq", "qd"), f"SELECT seq, qd FROM d_ufs {_SAMPLE.format(n=777)}")
register(
    "filter_trace",
    lambda s, d: filter_trace(table(s, d, "cus"), "cus", Range("qd", col_from=1, col_to=3), 500, ["0x42"])[0].select("seq", "start_qd"),
    f"SELECT seq, start_qd FROM d_cus WHERE start_qd BETWEEN 1 AND 3 AND opcode <> '0x42' {_SAMPLE.format(n=500)}",
)
register(
    "filter_trace_counts",
    lambda s, d: filter_trace(table(s, d, "cus"), "cus", Range("qd", col_from=1, col_to=3), 500, ["0x42"])[1].select("total_count", "sampled_count", F.round("sampling_ratio", 4).alias("sampling_ratio")),
    "SELECT n AS total_count, least(n, 500) AS sampled_count, round(CASE WHEN n <= 500 THEN 100.0 ELSE 500 * 100.0 / n END, 4) AS sampling_ratio FROM (SELECT count(*) AS n FROM d_cus WHERE start_qd BETWEEN 1 AND 3 AND opcode <> '0x42')",
)

# Statistics

NUMBERS = ["sum", "min", "max", "avg", "std_dev", "median", "p99", "p99_9", "p99_99", "p99_999", "p99_9999"]


def _values_sql(kind: str, column: str, group: bool) -> str:
    key = "opcode" if kind != "block" else "left(io_type, 1)" if group else "io_type"
    where = "true" if kind == "cus" else f"action = '{(COMPLETE if column in ('dtoc', 'ctoc') else SEND)[kind]}'"
    return f"(SELECT {key} AS key, CAST({column} AS DOUBLE) AS value FROM d_{kind} WHERE {where})"


def _bucket_sql(thresholds: list[str]) -> str:
    ms = [time_to_ms(t) for t in thresholds]
    middle = " ".join(f"WHEN value > CAST({a!r} AS DOUBLE) AND value <= CAST({b!r} AS DOUBLE) THEN {i + 1}" for i, (a, b) in enumerate(zip(ms, ms[1:])))
    return f"CASE WHEN value <= CAST({ms[0]!r} AS DOUBLE) THEN 0 WHEN value > CAST({ms[-1]!r} AS DOUBLE) THEN {len(ms)} {middle} END" if ms else "0"


def _labels_sql(thresholds: list[str]) -> str:
    rows = ", ".join("({}, '{}')".format(i, x) for i, x in enumerate(bucket_labels(thresholds)))
    return f"(VALUES {rows}) AS labels(bucket_ord, bucket)"


def histogram_sql(kind: str, column: str, thresholds: list[str], group: bool = False) -> str:
    values = _values_sql(kind, column, group)
    return f"""SELECT k.key, CAST(labels.bucket_ord AS INTEGER) AS bucket_ord, labels.bucket, count(v.value) AS n FROM (SELECT DISTINCT key FROM {values}) k CROSS JOIN {_labels_sql(thresholds)}
        LEFT JOIN {values} v ON v.key = k.key AND {_bucket_sql(thresholds)} = labels.bucket_ord GROUP BY ALL"""


_QUANTILES = ", ".join(f"round(quantile_cont(value, {q}), 4) AS {n}" for n, q in zip(NUMBERS[5:], [0.5, *S.PERCENTILES]))
_SUMMARY = f"count(*) AS n, round(sum(value), 4) AS sum, round(min(value), 4) AS min, round(max(value), 4) AS max, round(avg(value), 4) AS avg, round(stddev_pop(value), 4) AS std_dev, {_QUANTILES}"


def summary_sql(kind: str, column: str, group: bool = False) -> str:
    return f"SELECT key, {_SUMMARY} FROM {_values_sql(kind, column, group)} GROUP BY key"


def _statistics(name: str, kind: str, column: str, group: bool = False) -> None:
    register(name, lambda s, d: S.latency_histogram(table(s, d, kind), kind, column, THRESHOLDS, group=group).drop("trace"), histogram_sql(kind, column, THRESHOLDS, group))
    register(f"{name}_summary", lambda s, d: _rounded(S.latency_summary(table(s, d, kind), kind, column, group=group), *NUMBERS).select("key", "n", *NUMBERS), summary_sql(kind, column, group))


for _column in S.LATENCIES:
    _statistics(f"ufs_latency_{_column}", "ufs", _column)
    _statistics(f"cus_latency_{_column}", "cus", _column)
for _column in (*S.LATENCIES, "sector"):
    _statistics(f"block_latency_{_column}_raw", "block", _column)
    _statistics(f"block_latency_{_column}_grouped", "block", _column, True)
register("latency_histogram_no_threshold", lambda s, d: S.latency_histogram(table(s, d, "ufs"), "ufs", "dtoc", []).drop("trace"), histogram_sql("ufs", "dtoc", []))
_FEW = ["5us", "1ms", "250000000ns", "1000s"]
register("latency_histogram_zero_filled", lambda s, d: S.latency_histogram(table(s, d, "ufs"), "ufs", "ctoc", _FEW).drop("trace"), histogram_sql("ufs", "ctoc", _FEW))
register("latency_percentiles_map", lambda s, d: S.latency_summary(table(s, d, "ufs"), "ufs", "dtoc").select("key", F.explode("percentiles").alias("name", "value")).withColumn("value", F.round("value", 4)),
    " UNION ALL ".join(f"SELECT key, '{n}' AS name, round(quantile_cont(value, {q}), 4) AS value FROM {_values_sql('ufs', 'dtoc', False)} GROUP BY key" for n, q in zip(S.PERCENTILE_NAMES, S.PERCENTILES)))


def sizes_sql(source: str) -> str:
    return f"SELECT key, size, count(*) AS n FROM ({source}) GROUP BY GROUPING SETS ((key, size), (key))"


register("ufs_size", lambda s, d: S.size_stats(table(s, d, "ufs"), "ufs", "dtoc").drop("trace"), sizes_sql("SELECT opcode AS key, size FROM d_ufs WHERE action = 'complete_rsp'"))
register("block_size", lambda s, d: S.size_stats(table(s, d, "block"), "block", "ctod", group=True).drop("trace"), sizes_sql("SELECT left(io_type, 1) AS key, size FROM d_block WHERE action = 'block_rq_issue'"))
register("cus_size", lambda s, d: S.size_stats(table(s, d, "cus"), "cus", "dtoc").drop("trace"), sizes_sql("SELECT opcode AS key, size FROM d_cus"))
register("ufs_allstats_size_kb", lambda s, d: S.all_sizes(table(s, d, "ufs"), "ufs").drop("trace"), sizes_sql("SELECT opcode AS key, size * 4 AS size FROM d_ufs"))
register("block_allstats_size", lambda s, d: S.all_sizes(table(s, d, "block"), "block").drop("trace"), sizes_sql("SELECT io_type AS key, size FROM d_block WHERE action = 'block_rq_complete'"))
register("cus_allstats_size", lambda s, d: S.all_sizes(table(s, d, "cus"), "cus").drop("trace"), sizes_sql("SELECT opcode AS key, size FROM d_cus"))


def continuity_sql(kind: str) -> str:
    key = "left(io_type, 1)" if kind == "block" else "opcode"
    where = {"ufs": "action = 'send_req' AND opcode IN ('0x28', '0x2a', '0x42')", "block": "action = 'block_rq_issue' AND left(io_type, 1) IN ('R', 'W', 'D')", "cus": "true"}[kind]
    unit = 4096 if kind == "ufs" else 512
    ratio = "CASE WHEN total_bytes > 0 THEN round(continuous_bytes * 100.0 / total_bytes, 4) " + ("ELSE 0 END" if kind == "cus" else "WHEN key IS NULL THEN 0 END")
    return f"""SELECT key, continuous, non_continuous, round(continuous * 100.0 / (continuous + non_continuous), 4) AS ratio, total_bytes, continuous_bytes, {ratio} AS bytes_ratio FROM (
        SELECT key, CAST(count(*) FILTER (continuous) AS BIGINT) AS continuous, CAST(count(*) FILTER (NOT continuous) AS BIGINT) AS non_continuous, CAST(sum(size * {unit}) AS BIGINT) AS total_bytes,
        CAST(sum(CASE WHEN continuous THEN size * {unit} ELSE 0 END) AS BIGINT) AS continuous_bytes FROM (SELECT {key} AS key, continuous, size FROM d_{kind} WHERE {where}) GROUP BY GROUPING SETS ((key), ()))"""


for _kind in ("ufs", "block", "cus"):
    register(f"{_kind}_continuity", lambda s, d, k=_kind: _rounded(S.continuity_stats(table(s, d, k), k), "ratio", "bytes_ratio").drop("trace"), continuity_sql(_kind))


def _allstats_sql(kind: str, sql: Callable[[str], str]) -> str:
    """All latencies; for ufs and block keys come from all rows, so a key may have no values."""
    return " UNION ALL ".join(f"SELECT '{c}' AS latency, * FROM ({sql(c)})" for c in S.LATENCIES)


def _all_values_sql(kind: str, column: str, group: bool) -> str:
    key = "opcode" if kind != "block" else "left(io_type, 1)" if group else "io_type"
    where = "true" if kind == "cus" else f"action = '{(COMPLETE if column in ('dtoc', 'ctoc') else SEND)[kind]}'"
    return f"(SELECT {key} AS key, CASE WHEN {where} THEN CAST({column} AS DOUBLE) END AS value FROM d_{kind})"


_ALL_SUMMARY = "count(value) AS n, " + ", ".join(f"coalesce({e}, 0) AS {n}" for n, e in zip(NUMBERS, ["round(sum(value), 4)", "round(min(value), 4)", "round(max(value), 4)", "round(avg(value), 4)", "round(stddev_pop(value), 4)", *[f"round(quantile_cont(value, {q}), 4)" for q in [0.5, *S.PERCENTILES]]]))
for _kind in ("ufs", "block", "cus"):
    _g = _kind == "block"
    register(
        f"{_kind}_allstats_histogram",
        lambda s, d, k=_kind, g=_g: S.all_histogram(table(s, d, k), k, THRESHOLDS, group=g).drop("trace"),
        _allstats_sql(_kind, lambda c, k=_kind, g=_g: f"""SELECT k.key, CAST(labels.bucket_ord AS INTEGER) AS bucket_ord, labels.bucket, count(v.value) AS n FROM (SELECT DISTINCT key FROM {_all_values_sql(k, c, g)}) k
            CROSS JOIN {_labels_sql(THRESHOLDS)} LEFT JOIN {_all_values_sql(k, c, g)} v ON v.key = k.key AND {_bucket_sql(THRESHOLDS)} = labels.bucket_ord GROUP BY ALL"""),
    )
    register(
        f"{_kind}_allstats_summary",
        lambda s, d, k=_kind, g=_g: _rounded(S.all_summary(table(s, d, k), k, group=g), *NUMBERS).select("latency", "key", "n", *NUMBERS),
        _allstats_sql(_kind, lambda c, k=_kind, g=_g: f"SELECT key, {_ALL_SUMMARY} FROM {_all_values_sql(k, c, g)} GROUP BY key"),
    )
register("ufs_allstats_ranged", lambda s, d: S.latency_histogram(table(s, d, "ufs"), "ufs", "dtoc", THRESHOLDS, Range("lba", T0 + 3600.0, T0 + 90000.0, 2, 9)).drop("trace"),
    histogram_sql("ufs", "dtoc", THRESHOLDS).replace("FROM d_ufs WHERE", f"FROM d_ufs WHERE time BETWEEN {T0 + 3600.0} AND {T0 + 90000.0} AND lba BETWEEN 2 AND 9 AND"))
register("ufs_qd_summary", lambda s, d: _rounded(S.qd_summary(table(s, d, "ufs")), *NUMBERS).select("key", "n", *NUMBERS), f"SELECT key, {_SUMMARY} FROM (SELECT opcode AS key, CAST(qd AS DOUBLE) AS value FROM d_ufs) GROUP BY key")

_BYTES_SQL = """CASE WHEN {n} IS NULL OR {n} <= 0 THEN '0 Bytes' ELSE regexp_replace(regexp_replace(printf('%.2f', round({n} / pow(1024.0, i), 2)), '0+$', ''), '\\.$', '') || ' ' || list_extract(['Bytes', 'KB', 'MB', 'GB', 'TB'], CAST(i + 1 AS BIGINT)) END"""
_POWER_SQL = "least(CASE WHEN {n} < 1024 THEN 0 WHEN {n} < 1048576 THEN 1 WHEN {n} < 1073741824 THEN 2 WHEN {n} < 1099511627776 THEN 3 ELSE 4 END, 4)"
register("rwd_dashboard", lambda s, d: S.rwd_dashboard(table(s, d, "block"), "block").drop("trace"),
    f"SELECT key, continuous + non_continuous AS total, round(ratio, 2) AS ratio, {_BYTES_SQL.format(n='total_bytes')} AS bytes, round(coalesce(bytes_ratio, 0), 2) AS bytes_ratio FROM (SELECT *, {_POWER_SQL.format(n='total_bytes')} AS i FROM ({continuity_sql('block').replace(', 4)', ', 12)')})) WHERE key IN ('R', 'W', 'D')")


def _volumes(spark: SparkSession, folder: str) -> DataFrame:
    """(o_orderkey, n): n goes beyond a long from some 2 million orders on, and is exact up to 38 digits."""
    key, customer = F.col("o_orderkey"), F.col("o_custkey").cast("decimal(19,0)")
    square = (key.cast("decimal(19,0)") * key.cast("decimal(19,0)")).cast("decimal(38,0)")
    return spark.read.parquet(f"{folder}/orders.parquet").select("o_orderkey", (square * customer).cast("decimal(38,0)").alias("n"))


register("format_bytes", lambda s, d: _volumes(s, d).select("o_orderkey", format_bytes(F.col("n")).alias("shown")),
    f"SELECT o_orderkey, {_BYTES_SQL.format(n='n')} AS shown FROM (SELECT *, {_POWER_SQL.format(n='n')} AS i FROM (SELECT o_orderkey, o_orderkey * o_orderkey * o_custkey AS n FROM orders))")
_UNIT = "CASE event_id % 5 WHEN 0 THEN 'ms' WHEN 1 THEN 's' WHEN 2 THEN 'us' WHEN 3 THEN 'ns' ELSE 'min' END"
register("parse_time_units", lambda s, d: s.read.parquet(f"{d}/events.parquet").selectExpr("event_id", f"concat(cast(event_id % 1000 as string), {_UNIT}) AS x").select("event_id", F.round(time_to_ms_column(F.col("x")), 9).alias("ms")),
    f"SELECT event_id, round(CASE event_id % 5 WHEN 0 THEN n WHEN 1 THEN n * 1000.0 WHEN 2 THEN n / 1000.0 WHEN 3 THEN n / 1000000.0 END, 9) AS ms FROM (SELECT event_id, CAST(event_id % 1000 AS DOUBLE) AS n FROM events)")
register("bucket_labels", lambda s, d: table(s, d, "cus").select("seq", bucket_label(F.col("dtoc"), THRESHOLDS).alias("bucket")),
    f"SELECT seq, bucket FROM (SELECT seq, {_bucket_sql(THRESHOLDS)} AS b FROM (SELECT seq, dtoc AS value FROM d_cus)) JOIN {_labels_sql(THRESHOLDS)} ON b = bucket_ord")

# Sources

register("trace_lengths", lambda s, d: store.lengths({k: table(s, d, k) for k in ("ufs", "block", "cus")}), " UNION ALL ".join(f"SELECT '{k}' AS kind, count(*) AS n FROM d_{k}" for k in ("ufs", "block", "cus")))
register("shown_kinds", lambda s, d: store.shown_kinds(store.lengths({"ufs": testbed.ufs(s, d), "block": testbed.block(s, d).limit(0)})), "SELECT 'ufs' AS kind")
register("union_files", lambda s, d: store.union([testbed.ufs(s, d).filter("cpu < 4"), testbed.ufs(s, d).filter("cpu >= 2")]).groupBy("cpu").agg(F.count("*").alias("n")), "SELECT cpu, count(*) * CASE WHEN cpu IN (2, 3) THEN 2 ELSE 1 END AS n FROM tb_ufs GROUP BY cpu")


def _parsed(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    return parse.events(parse.parsed(testbed.lines(spark, folder)), kind)


_MICROS = "CAST(round({c} * 1000000) AS BIGINT) AS {c}_us"
register("parse_ufs", lambda s, d: _parsed(s, d, "ufs").selectExpr("trace", "seq", _MICROS.format(c="time"), "process", "cpu", "action", "tag", "opcode", "lba", "size", "groupid", "hwqid"),
    f"SELECT 'ufs.log' AS trace, seq, {_MICROS.format(c='time')}, process, cpu, action, tag, opcode, lba, size, user_id % 7 AS groupid, user_id % 2 AS hwqid FROM tb_ufs JOIN events ON event_id = seq WHERE action <> 'query_req'")
register("parse_block", lambda s, d: _parsed(s, d, "block").selectExpr("seq", _MICROS.format(c="time"), "process", "cpu", "flags", "action", "devmajor", "devminor", "io_type", "extra", "sector", "size", "comm"),
    f"SELECT seq, {_MICROS.format(c='time')}, 'kworker-1' AS process, cpu, 'd..1.' AS flags, action, CAST(8 AS BIGINT) AS devmajor, CAST(0 AS BIGINT) AS devminor, io_type, CAST(4096 AS BIGINT) AS extra, sector, size, 'kworker' AS comm FROM tb_block")
register("parse_cus", lambda s, d: _parsed(s, d, "cus").selectExpr("seq", "opcode", "lba", "size", _MICROS.format(c="start_time"), _MICROS.format(c="end_time")), f"SELECT seq, opcode, lba, size, {_MICROS.format(c='start_time')}, {_MICROS.format(c='end_time')} FROM tb_cus")
_KINDS = """SELECT 'ufs.log' AS trace, CASE WHEN action = 'query_req' THEN 'missing' ELSE 'ufs' END AS kind, count(*) AS n FROM tb_ufs GROUP BY ALL
    UNION ALL SELECT 'block.log', 'block', count(*) FROM tb_block UNION ALL SELECT 'cus.log', 'cus', count(*) FROM tb_cus UNION ALL SELECT 'junk.log', 'missing', count(*) FROM tb_cus"""
register("parse_dispatch_counts", lambda s, d: parse.kind_counts(parse.parsed(testbed.lines(s, d))), _KINDS)
_MISSING = "SELECT trace, line_no, row_number() OVER (PARTITION BY trace ORDER BY line_no) AS n FROM (SELECT 'ufs.log' AS trace, seq AS line_no FROM tb_ufs WHERE action = 'query_req' UNION ALL SELECT 'junk.log', seq FROM tb_cus)"
register("missing_lines", lambda s, d: parse.missing_lines(parse.parsed(testbed.lines(s, d))), f"SELECT trace, CASE WHEN n <= 1000 THEN line_no ELSE 0 END AS line_no FROM ({_MISSING}) WHERE n <= 1001")
register("regex_tester", lambda s, d: test_pattern(testbed.lines(s, d).filter("trace = 'cus.log'"), DEFAULTS["cus"][1]).select("matched", "whole", F.size("captures").alias("captures"), F.col("named")["lba"].cast("long").alias("lba")),
    "SELECT true AS matched, opcode || ',' || lba || ',' || size || ',' || printf('%.6f', start_time) || ',' || printf('%.6f', end_time) AS whole, 5 AS captures, lba FROM tb_cus")

# Points and export

register("distinct_legends", lambda s, d: P.legends(table(s, d, "block"), "io_type"), "SELECT io_type AS legend, row_number() OVER (ORDER BY CASE io_type WHEN 'R' THEN 0 WHEN 'W' THEN 1 WHEN 'D' THEN 2 WHEN 'F' THEN 3 ELSE 5 END, io_type) AS position FROM (SELECT DISTINCT io_type FROM d_block)")
register("distinct_cpus", lambda s, d: P.legends(table(s, d, "ufs"), "cpu"), "SELECT CAST(cpu AS VARCHAR) AS legend, row_number() OVER (ORDER BY cpu) AS position FROM (SELECT DISTINCT cpu FROM d_ufs)")


def _points(s: SparkSession, d: str, kind: str, y: str, legend: str, action: str | None = None) -> DataFrame:
    return P.points(table(s, d, kind), kind, P.latency_x(kind, y), y, legend, action)


_XY = "round(x, 6) AS x, round(y, 4) AS y"
for _name, _kind, _y, _legend, _action, _where in (
    ("points_address", "ufs", "lba", "opcode", None, "action = 'send_req'"),
    ("points_qd", "block", "qd", "io_type", None, "action = 'block_rq_issue'"),
    ("points_cpu_complete", "ufs", "cpu", "cpu", "c", "action = 'complete_rsp'"),
    ("points_cpu_dispatch", "block", "cpu", "cpu", "d", "action = 'block_rq_issue'"),
    ("points_all_actions", "ufs", "lba", "opcode", "send_req", "true"),
    ("points_latency", "ufs", "dtoc", "opcode", None, "action = 'complete_rsp' AND dtoc > 0"),
    ("points_latency_requests", "cus", "ctoc", "opcode", None, "ctoc > 0"),
):
    _x = "end_time" if _kind == "cus" else "time"
    register(_name, lambda s, d, a=(_kind, _y, _legend, _action): _points(s, d, *a).selectExpr("seq", "round(x, 6) AS x", "round(y, 4) AS y", "legend"), f"SELECT seq, round({_x}, 6) AS x, round(CAST({_y} AS DOUBLE), 4) AS y, CAST({_legend} AS VARCHAR) AS legend FROM d_{_kind} WHERE {_where}")
register("point_bounds", lambda s, d: P.bounds(_points(s, d, "ufs", "dtoc", "opcode"), "dtoc").selectExpr("round(xmin, 6) AS xmin", "round(xmax, 6) AS xmax", "ymin", "round(ymax, 4) AS ymax", "points"),
    "SELECT round(min(time), 6) AS xmin, round(max(time), 6) AS xmax, CAST(0 AS DOUBLE) AS ymin, round(max(dtoc), 4) AS ymax, count(*) AS points FROM d_ufs WHERE action = 'complete_rsp' AND dtoc > 0")
register("point_bounds_empty", lambda s, d: P.bounds(_points(s, d, "ufs", "lba", "opcode").filter("x < 0"), "lba"), "SELECT CAST(0 AS DOUBLE) AS xmin, CAST(100 AS DOUBLE) AS xmax, CAST(0 AS DOUBLE) AS ymin, CAST(100 AS DOUBLE) AS ymax, CAST(0 AS BIGINT) AS points")
register("legend_index", lambda s, d: P.legend_index(_points(s, d, "ufs", "lba", "opcode")).select("seq", "legend", F.col("legend_index").cast("long").alias("legend_index")),
    "SELECT seq, opcode AS legend, l.i AS legend_index FROM d_ufs JOIN (SELECT opcode AS o, row_number() OVER (ORDER BY min(seq)) - 1 AS i FROM d_ufs WHERE action = 'send_req' GROUP BY opcode) l ON o = opcode WHERE action = 'send_req'")
register("point_series", lambda s, d: P.series(_points(s, d, "cus", "lba", "opcode")).select("legend", F.round("x", 6).alias("x"), "y"), "SELECT opcode AS legend, round(start_time, 6) AS x, CAST(lba AS DOUBLE) AS y FROM d_cus")
_CHUNK = 3000
register("export_chunks", lambda s, d: chunks(table(s, d, "ufs"), "ufs", "trace", max_rows=_CHUNK).selectExpr("chunk", "rows", "round(tmin, 6) AS tmin", "round(tmax, 6) AS tmax", "file"),
    f"SELECT chunk, count(*) AS rows, round(min(time), 6) AS tmin, round(max(time), 6) AS tmax, 'trace_' || printf('%.3f', min(time)) || '_' || printf('%.3f', max(time)) || '.csv' AS file FROM (SELECT time, CAST((row_number() OVER (ORDER BY time, seq) - 1) // {_CHUNK} AS BIGINT) AS chunk FROM d_ufs) GROUP BY chunk")


def entry(spark: SparkSession, folder: str) -> DataFrame:
    """From log lines to statistics: parse, derive, and the histograms of all latencies of the ufs log."""
    events = _parsed(spark, folder, "ufs")
    return S.all_histogram(derive(events, "ufs"), "ufs", THRESHOLDS).orderBy("trace", "latency", "key", "bucket_ord")


# Tables at rest, traces in parts, and repeated zooms

def _stored(spark: SparkSession, folder: str, kind: str, layout: str = "time") -> str:
    """The folder of a new stored table of a kind."""
    df = table(spark, folder, kind)
    place = f"{shared_folder(df) or folder}/{PREFIX}{uuid.uuid4().hex}"
    store.save(df, place, kind, layout=layout)
    return place


def _in_parts(spark: SparkSession, folder: str, parts: int = 3) -> DataFrame:
    """Block events in parts by their lines, each derived from the state that the one before left."""
    rows, state, out = testbed.block(spark, folder), at_rest(spark, "block"), []
    last = rows.agg(F.max("seq")).first()[0] or 0
    for n in range(parts):
        part = rows.filter((F.col("seq") > (last * n // parts if n else -1)) & (F.col("seq") <= last * (n + 1) // parts))
        made, after = resume(part, "block", state, keep=materialised)
        out.append(made)
        state = Carried(materialised(after.marks), materialised(after.open), materialised(after.listed))
    return store.union(out)


def _tree(spark: SparkSession, folder: str, r: Range) -> DataFrame:
    place = _stored(spark, folder, "ufs")
    df = store.load(spark, place, "ufs")
    return Pyramid(spark, f"{place}/tree", "ufs").build(df, 600.0, THRESHOLDS).histogram(df, "dtoc", r)


register("block_in_parts", lambda s, d: _in_parts(s, d).selectExpr("seq", "action", "qd", *[f"round({c}, 4) AS {c}" for c in S.LATENCIES], "continuous"), f"SELECT seq, action, qd, {_LAT}, continuous FROM d_block")
register("zoom_layout", lambda s, d: apply_range(store.load(s, _stored(s, d, "ufs", "zoom"), "ufs"), "ufs", Range("lba", T0 + 3600.0, T0 + 90000.0, 2, 9)).select("seq", "lba", "qd"),
    f"SELECT seq, lba, qd FROM d_ufs WHERE time BETWEEN {T0 + 3600.0} AND {T0 + 90000.0} AND lba BETWEEN 2 AND 9")
register("summary_tree_histogram", lambda s, d: _tree(s, d, Range("", T0 + 3600.0, T0 + 90000.0)).drop("trace"),
    histogram_sql("ufs", "dtoc", THRESHOLDS).replace("FROM d_ufs WHERE", f"FROM d_ufs WHERE time BETWEEN {T0 + 3600.0} AND {T0 + 90000.0} AND"))
register("latency_summary_at_rest", lambda s, d: _rounded(summary_at_rest(s, _stored(s, d, "cus"), "cus", "dtoc"), *NUMBERS).select("key", "n", *NUMBERS), summary_sql("cus", "dtoc"))
register("footer_counts", lambda s, d: store.footer_lengths(s, _stored(s, d, "block"), ["block"]), "SELECT 'block' AS kind, count(*) AS n FROM d_block")
