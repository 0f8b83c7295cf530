"""Trace tables made of the test tables events and orders, the same in Spark and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _events(spark: SparkSession, folder: str) -> DataFrame:
    e = spark.read.parquet(f"{folder}/events.parquet")
    return e.withColumn("time", F.unix_micros(F.col("ts").cast("timestamp")).cast("double") / 1000000.0)


def ufs(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("event_type")
    return _events(spark, folder).select(
        F.lit("t").alias("trace"),
        F.col("event_id").alias("seq"),
        "time",
        F.concat(F.lit("proc"), (F.col("user_id") % 5).cast("string")).alias("process"),
        (F.col("user_id") % 8).alias("cpu"),
        F.when(kind.isin("view", "click"), "send_req").when(kind.isin("purchase", "signup"), "complete_rsp").otherwise("query_req").alias("action"),
        (F.col("user_id") % 4).alias("tag"),
        F.when(F.col("user_id") % 3 == 0, "0x28").when(F.col("user_id") % 3 == 1, "0x2a").otherwise("0x42").alias("opcode"),
        (F.floor(F.col("event_id") / 2).cast("long") % 16).alias("lba"),
        (F.col("event_id") % 3).alias("size"),
        (F.col("user_id") % 7).alias("groupid"),
        (F.col("user_id") % 2).alias("hwqid"),
    )


def block(spark: SparkSession, folder: str) -> DataFrame:
    h = (F.col("o_orderkey") * 7 + F.col("o_custkey")) % 11
    first = F.substring("o_orderpriority", 1, 1)
    return spark.read.parquet(f"{folder}/orders.parquet").select(
        F.lit("t").alias("trace"),
        F.col("o_orderkey").alias("seq"),
        (F.col("o_orderkey") * 0.0005).alias("time"),
        F.lit("kworker").alias("process"),
        (F.col("o_custkey") % 8).alias("cpu"),
        F.lit("d..1.").alias("flags"),
        F.when(h < 5, "block_rq_issue").when(h < 10, "block_rq_complete").otherwise("block_getrq").alias("action"),
        F.lit(8).cast("long").alias("devmajor"),
        F.lit(0).cast("long").alias("devminor"),
        F.when(first == "1", "R").when(first == "2", "W").when(first == "3", "WS").when(first == "4", "D").otherwise("FF").alias("io_type"),
        F.lit(0).cast("long").alias("extra"),
        (F.col("o_custkey") % 6).alias("sector"),
        (F.col("o_orderkey") % 3).alias("size"),
        F.lit("kworker").alias("comm"),
    )


def cus(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("event_type")
    return _events(spark, folder).select(
        F.lit("t").alias("trace"),
        F.col("event_id").alias("seq"),
        F.when(kind == "view", "0x28").when(kind == "click", "0x2a").otherwise("0x42").alias("opcode"),
        (F.col("user_id") % 16).alias("lba"),
        (F.col("event_id") % 4).alias("size"),
        F.col("time").alias("start_time"),
        (F.col("time") + F.col("value") * 10).alias("end_time"),
    )


RAW = {"ufs": ufs, "block": block, "cus": cus}

#: The same in DuckDB SQL, and the derived tables d_ufs, d_block and d_cus by windows over the whole trace.
SQL = """
tb_ufs AS (SELECT event_id AS seq, CAST(epoch_us(ts) AS DOUBLE) / 1000000.0 AS time, 'proc' || (user_id % 5) AS process, user_id % 8 AS cpu,
    CASE WHEN event_type IN ('view', 'click') THEN 'send_req' WHEN event_type IN ('purchase', 'signup') THEN 'complete_rsp' ELSE 'query_req' END AS action,
    user_id % 4 AS tag, CASE user_id % 3 WHEN 0 THEN '0x28' WHEN 1 THEN '0x2a' ELSE '0x42' END AS opcode,
    (event_id // 2) % 16 AS lba, event_id % 3 AS size FROM events),
tb_block AS (SELECT o_orderkey AS seq, o_orderkey * CAST(0.0005 AS DOUBLE) AS time, o_custkey % 8 AS cpu,
    CASE WHEN (o_orderkey * 7 + o_custkey) % 11 < 5 THEN 'block_rq_issue' WHEN (o_orderkey * 7 + o_custkey) % 11 < 10 THEN 'block_rq_complete' ELSE 'block_getrq' END AS action,
    CASE left(o_orderpriority, 1) WHEN '1' THEN 'R' WHEN '2' THEN 'W' WHEN '3' THEN 'WS' WHEN '4' THEN 'D' ELSE 'FF' END AS io_type,
    o_custkey % 6 AS sector, o_orderkey % 3 AS size FROM orders),
tb_cus AS (SELECT event_id AS seq, CASE event_type WHEN 'view' THEN '0x28' WHEN 'click' THEN '0x2a' ELSE '0x42' END AS opcode,
    user_id % 16 AS lba, event_id % 4 AS size, CAST(epoch_us(ts) AS DOUBLE) / 1000000.0 AS start_time,
    CAST(epoch_us(ts) AS DOUBLE) / 1000000.0 + value * 10 AS end_time FROM events),

u0 AS (SELECT *, action = 'send_req' AS snd, action = 'complete_rsp' AS cmp FROM tb_ufs),
u1 AS (SELECT *, sum(CASE WHEN snd THEN 1 WHEN cmp THEN -1 ELSE 0 END) OVER (ORDER BY seq) AS s FROM u0),
u2 AS (SELECT *, CAST(s - least(0, min(s) OVER (ORDER BY seq)) AS BIGINT) AS qd FROM u1),
u3 AS (SELECT *, lag(action) OVER k AS pa, lag(time) OVER k AS pt, lag(lba + size) OVER n AS pe, lag(opcode) OVER n AS po,
    max(CASE WHEN snd AND qd = 1 THEN seq END) OVER b AS busy, max(CASE WHEN cmp THEN seq END) OVER b AS done,
    max(CASE WHEN cmp AND qd = 0 THEN seq END) OVER b AS idle FROM u2
    WINDOW k AS (PARTITION BY tag, opcode, snd OR cmp ORDER BY seq), n AS (PARTITION BY snd ORDER BY seq), b AS (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
d_ufs AS (SELECT u3.seq, u3.time, u3.process, u3.cpu, u3.action, u3.tag, u3.opcode, u3.lba, u3.size, u3.qd,
    CASE WHEN cmp AND pa = 'send_req' THEN (u3.time - pt) * 1000.0 ELSE 0.0 END AS dtoc,
    CASE WHEN cmp THEN coalesce((u3.time - CASE WHEN busy IS NOT NULL AND (done IS NULL OR busy > done) THEN tb.time ELSE td.time END) * 1000.0, 0.0) ELSE 0.0 END AS ctoc,
    CASE WHEN snd AND u3.qd = 1 THEN coalesce((u3.time - ti.time) * 1000.0, 0.0) ELSE 0.0 END AS ctod,
    coalesce(snd AND u3.lba = pe AND u3.opcode = po, false) AS continuous
    FROM u3 LEFT JOIN tb_ufs tb ON tb.seq = busy LEFT JOIN tb_ufs td ON td.seq = done LEFT JOIN tb_ufs ti ON ti.seq = idle),

b_0 AS (SELECT *, CASE left(io_type, 1) WHEN 'R' THEN 'read' WHEN 'W' THEN 'write' WHEN 'D' THEN 'discard' ELSE 'other' END AS op FROM tb_block
    WHERE NOT (action = 'block_rq_complete' AND io_type LIKE 'W%' AND size = 0)),
b_1 AS (SELECT *, lag(action) OVER (PARTITION BY sector, op, size, action IN ('block_rq_issue', 'block_rq_complete') ORDER BY seq) AS pv FROM b_0),
dedup_block AS (SELECT *, action = 'block_rq_issue' AS snd, action = 'block_rq_complete' AS cmp FROM b_1
    WHERE NOT (action = 'block_rq_issue' AND coalesce(pv = 'block_rq_issue', false))),
b_2 AS (SELECT *, sum(CASE WHEN snd THEN 1 WHEN cmp THEN -1 ELSE 0 END) OVER (ORDER BY seq) AS s FROM dedup_block),
b_3 AS (SELECT *, CAST(s - least(0, min(s) OVER (ORDER BY seq)) AS BIGINT) AS qd FROM b_2),
b_4 AS (SELECT *, lag(action) OVER k AS pa, lag(time) OVER k AS pt, lag(sector + size) OVER n AS pe, lag(op) OVER n AS po,
    max(CASE WHEN snd AND qd = 1 THEN seq END) OVER b AS busy, max(CASE WHEN cmp THEN seq END) OVER b AS done,
    max(CASE WHEN cmp AND qd = 0 THEN seq END) OVER b AS idle FROM b_3
    WINDOW k AS (PARTITION BY sector, op, snd OR cmp ORDER BY seq), n AS (PARTITION BY snd AND op <> 'other' ORDER BY seq), b AS (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
d_block AS (SELECT b_4.seq, b_4.time, b_4.cpu, b_4.action, b_4.io_type, b_4.sector, b_4.size, b_4.qd,
    CASE WHEN cmp AND pa = 'block_rq_issue' THEN (b_4.time - pt) * 1000.0 ELSE 0.0 END AS dtoc,
    CASE WHEN cmp THEN coalesce((b_4.time - CASE WHEN busy IS NOT NULL AND (done IS NULL OR busy > done) THEN tb.time ELSE td.time END) * 1000.0, 0.0) ELSE 0.0 END AS ctoc,
    CASE WHEN snd AND b_4.qd = 1 THEN coalesce((b_4.time - ti.time) * 1000.0, 0.0) ELSE 0.0 END AS ctod,
    coalesce(snd AND op <> 'other' AND b_4.sector = pe AND op = po, false) AS continuous
    FROM b_4 LEFT JOIN tb_block tb ON tb.seq = busy LEFT JOIN tb_block td ON td.seq = done LEFT JOIN tb_block ti ON ti.seq = idle),

c_0 AS (SELECT seq, start_time AS t, 0 AS e, 1 AS d FROM tb_cus UNION ALL SELECT seq, end_time, 1, -1 FROM tb_cus),
c_1 AS (SELECT *, sum(d) OVER (ORDER BY t, seq, e ROWS UNBOUNDED PRECEDING) AS s FROM c_0),
c_2 AS (SELECT *, CAST(s - least(0, min(s) OVER (ORDER BY t, seq, e ROWS UNBOUNDED PRECEDING)) AS BIGINT) AS q FROM c_1),
c_3 AS (SELECT r.*, a.q AS start_qd, b.q AS end_qd FROM tb_cus r JOIN c_2 a ON a.seq = r.seq AND a.e = 0 JOIN c_2 b ON b.seq = r.seq AND b.e = 1),
c_4 AS (SELECT *, lag(end_time) OVER w AS pend, lag(lba + size) OVER w AS pe, lag(opcode) OVER w AS po,
    max(CASE WHEN end_qd = 0 THEN seq END) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS idle FROM c_3 WINDOW w AS (ORDER BY seq)),
d_cus AS (SELECT c_4.seq, c_4.opcode, c_4.lba, c_4.size, c_4.start_time, c_4.end_time, start_qd, end_qd, (c_4.end_time - c_4.start_time) * 1000.0 AS dtoc,
    CASE WHEN pend IS NULL THEN 0.0 ELSE greatest(0.0, (c_4.end_time - pend) * 1000.0) END AS ctoc,
    CASE WHEN start_qd = 1 THEN CASE WHEN i.end_time IS NULL THEN 0.0 ELSE greatest(0.0, (c_4.start_time - i.end_time) * 1000.0) END
         WHEN pend IS NULL THEN 0.0 ELSE greatest(0.0, (c_4.start_time - pend) * 1000.0) END AS ctod,
    coalesce(c_4.lba = pe AND c_4.opcode = po, false) AS continuous
    FROM c_4 LEFT JOIN tb_cus i ON i.seq = idle)
"""


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """(trace, line_no, line): the tables as log lines, each kind as a log of its own, and one of lines that fit nothing."""
    u = ufs(spark, folder)
    ufs_line = F.format_string(
        "%s [%d] %.6f: ufshcd_command: %s: 1d84000.ufshc: tag: %d, DB: 0x0, size: %d, IS: 0, LBA: %d, opcode: %s, group_id: 0x%x, hwq_id: %d",
        "process", "cpu", "time", "action", "tag", F.col("size") * 4096, "lba", "opcode", "groupid", "hwqid",
    )
    b = block(spark, folder)
    block_line = F.format_string("%s-1 [%d] %s %.4f: %s: %d,%d %s %d () %d + %d [%s]", "process", "cpu", "flags", "time", "action", "devmajor", "devminor", "io_type", F.lit(4096), "sector", "size", "comm")
    c = cus(spark, folder)
    cus_line = F.format_string("%s,%d,%d,%.6f,%.6f", "opcode", "lba", "size", "start_time", "end_time")
    junk = F.when(F.col("seq") % 3 == 0, "").when(F.col("seq") % 3 == 1, F.concat(F.lit("# note "), F.col("seq").cast("string"))).otherwise("0x28,1,2,3")
    logs = [("ufs.log", u, ufs_line), ("block.log", b, block_line), ("cus.log", c, cus_line), ("junk.log", c, junk)]
    out = None
    for name, df, line in logs:
        rows = df.select(F.lit(name).alias("trace"), F.col("seq").alias("line_no"), line.alias("line"))
        out = rows if out is None else out.unionByName(rows)
    return out
