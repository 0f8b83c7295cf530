import os
import time

import pytest

from blkscope.operators.derive import derive
from blkscope.operators.filters import Range
from blkscope.plans.export import export_csv
from blkscope.plans.ingest import ingest
from blkscope.sources import parse, patterns, store
from blkscope.sources.text import read_encoded, read_log
from blkscope.streaming import live

UFS = "kworker/u16:3 [7] d..1. 123.456789: ufshcd_command: send_req: 1d84000.ufshc: tag: 5, DB: 0x0, size: 32768, IS: 0, LBA: 1048576, opcode: 0x28, group_id: 0x1a, hwq_id: 0"
DONE = UFS.replace("send_req", "complete_rsp").replace("123.456789", "123.457789")
BLOCK = "kworker/u16:0 [0] d..1. 123.456: block_rq_issue: 8,0 R 0 () 2048 + 8 [kworker/u16:0]"
CUS = "0x28,1048576,8,123.456,123.789"


def parse_lines(spark, lines, registry=None):
    df = spark.createDataFrame([("t", k + 1, x) for k, x in enumerate(lines)], "trace string, line_no long, line string")
    return parse.parsed(df, registry)


def test_sample_lines(spark):
    found = parse_lines(spark, [UFS, BLOCK, CUS, "0x2a,1887,2,141036.565121,141036.565317"])
    (u,) = parse.events(found, "ufs").collect()
    assert (u.process, u.cpu, u.time, u.action, u.tag, u.size, u.lba, u.opcode, u.groupid, u.hwqid) == ("kworker/u16:3", 7, 123.456789, "send_req", 5, 8, 1048576, "0x28", 26, 0)
    (b,) = parse.events(found, "block").collect()
    assert (b.process, b.flags, b.devmajor, b.devminor, b.io_type, b.extra, b.sector, b.size, b.comm) == ("kworker/u16:0", "d..1.", 8, 0, "R", 0, 2048, 8, "kworker/u16:0")
    rows = derive(parse.events(found, "cus"), "cus").orderBy("seq").collect()
    assert (rows[0].opcode, rows[0].lba, rows[0].size) == ("0x28", 1048576, 8) and abs(rows[0].dtoc - 333.0) < 1e-6


def test_rejected_and_odd_lines(spark):
    lines = [
        "", "  ", "no trace", UFS.replace("hwq_id: 0", "hwq_id: -1"), UFS.replace("LBA: 1048576", "LBA: 2305843009213693951"), UFS.replace("LBA: 1048576", "LBA: 281474976710657"),
        UFS.replace("size: 32768", "size: -8192"), UFS.replace("size: 32768", "size: 99999999999"), UFS.replace("LBA: 1048576", "LBA: 99999999999999999999"),
        BLOCK.replace("2048", "18446744073709551615"), BLOCK.replace("2048", "99999999999999999999999"), BLOCK.replace("R 0 ()", "R ()"), BLOCK + "\r", CUS + "\n", CUS.replace("0x28", "0xZZ"), "0x28,1,2,3,4",
        BLOCK.replace("+ 8", "+ 99999999999"), UFS.replace("0x1a", "0x1ffffffff"),
    ]
    rows = {r.line_no: r for r in parse_lines(spark, lines).collect()}
    kinds = [rows[k + 1].kind for k in range(len(lines))]
    assert kinds == [None, None, None, None, "ufs", "ufs", "ufs", None, "ufs", "block", "block", "block", None, None, None, "cus", None, None]
    assert (rows[5].ufs.lba, rows[6].ufs.lba, rows[7].ufs.size, rows[9].ufs.lba) == (0, 0, 2, 0)
    assert (rows[10].block.sector, rows[11].block.sector, rows[12].block.extra) == (0, 0, 0)
    missing = [r.line_no for r in parse.missing_lines(parse_lines(spark, lines)).collect()]
    assert sorted(missing) == [k + 1 for k, x in enumerate(kinds) if x is None]


def test_missing_lines_end_with_a_zero(spark):
    for n, want in ((999, 999), (1000, 1000), (1001, 1001)):
        rows = [r.line_no for r in parse.missing_lines(parse_lines(spark, ["x"] * n)).collect()]
        assert len(rows) == want and (0 in rows) == (n > 1000)


def test_log_is_numbered_over_splits(spark, tmp_path):
    lines = [f"line {k}" + "x" * (k % 50) + ("\r" if k % 3 == 0 else "") for k in range(5000)]
    (tmp_path / "a.log").write_text("\n".join(lines), newline="")
    (tmp_path / "b.log").write_text("one\ntwo\n", newline="")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = read_log(spark, [str(tmp_path / "a.log"), str(tmp_path / "b.log")]).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r.line_no, r.line) for r in rows if r.trace == "a.log") == [(k + 1, x.rstrip("\r")) for k, x in enumerate(lines)]
    assert sorted((r.line_no, r.line) for r in rows if r.trace == "b.log") == [(1, "one"), (2, "two")]


def test_other_encodings(spark, tmp_path):
    (tmp_path / "k.log").write_bytes("커널 [1]\r\nabc\n".encode("cp949"))
    (tmp_path / "u.log").write_bytes("커널\nx".encode())
    rows = {(r.trace, r.line_no): r.line for r in read_encoded(spark, str(tmp_path)).collect()}
    assert rows == {("k.log", 1): "커널 [1]", ("k.log", 2): "abc", ("u.log", 1): "커널", ("u.log", 2): "x"}


def test_registry(spark):
    r = patterns.Registry()
    with pytest.raises(Exception):
        r.add("bad", "ufs", "(")
    with pytest.raises(ValueError):
        r.add("no groups", "ufs", "(.*)")
    with pytest.raises(ValueError):
        r.add("x", "other", "a")
    r.add("mine", "cus", r"^REQ (?P<opcode>0x[0-9a-f]+) (?P<lba>\d+) (?P<size>\d+) (?P<start_time>[\d.]+) (?P<end_time>[\d.]+)$")
    r.activate("mine", "cus")
    with pytest.raises(ValueError):
        r.delete("mine", "cus")
    with pytest.raises(KeyError):
        r.activate("none", "cus")
    again = patterns.Registry.from_table(r.to_table(spark))
    assert again.list() == r.list() and again.active == r.active
    rows = parse_lines(spark, ["REQ 0x28 1 2 3.5 4", CUS], again).collect()
    assert sorted((x.line_no, x.kind) for x in rows if x.kind) == [(1, "cus")]
    again.activate("Default UFS Custom Pattern", "cus")
    again.delete("mine", "cus")
    assert "mine" not in again.list("cus")["cus"]


def test_translation_of_groups():
    plain, numbers = patterns.for_spark(r"^(a)(?:b)(?P<x_y>[(]\()(?<z>\$)$")
    assert plain == r"(?d)^(a)(?:b)([(]\()(\$)\z" and numbers == {"x_y": 2, "z": 3}


def test_pattern_tester(spark):
    df = spark.createDataFrame([("ab12",), ("",), ("zz",)], "line string")
    rows = {r.line: r for r in patterns.test_pattern(df, r"(?P<word>[a-b]+)(\d+)?").collect()}
    assert set(rows) == {"ab12", "zz"} and rows["ab12"].named == {"word": "ab"} and rows["ab12"].captures == ["ab", "12"] and not rows["zz"].matched


def test_ingest_store_and_catalog(spark, tmp_path):
    log = tmp_path / "run.log"
    log.write_text("\n".join([UFS, DONE, BLOCK, CUS, "junk"]))
    folder = str(tmp_path / "tables")
    for overwrite in (False, True):
        counts = {r.kind: r.n for r in ingest(spark, str(log), folder, overwrite=overwrite).collect()}
        assert counts == {"ufs": 2, "block": 1, "cus": 1, "missing": 1}
    rows = store.load(spark, folder, "ufs", ["run.log"]).orderBy("seq").collect()
    assert [r.qd for r in rows] == [1, 0] and abs(rows[1].dtoc - 1.0) < 1e-6
    assert {r.kind: r.n for r in store.lengths({k: store.load(spark, folder, k) for k in ("ufs", "block", "cus")}).collect()} == {"ufs": 2, "block": 1, "cus": 1}
    with pytest.raises(ValueError):
        store.save(store.load(spark, folder, "ufs").limit(0), folder, "ufs")
    foreign = str(tmp_path / "x_ufs.parquet")
    store.load(spark, folder, "ufs").drop("trace", "seq").coalesce(1).write.parquet(foreign)
    assert store.paths_by_kind(f" {foreign}, ,a_ufscustom.parquet,b.txt,c_block.parquet") == {"ufs": [foreign], "cus": ["a_ufscustom.parquet"], "block": ["c_block.parquet"]}
    assert store.load_files(spark, [foreign, foreign], "ufs").count() == 4
    with pytest.raises(ValueError):
        store.load_files(spark, [foreign], "block")

    catalog = store.Catalog(spark, str(tmp_path / "catalog"))
    assert catalog.add("one", "p", "ufs", "f") == 1 and catalog.add("two", "q", "ufs,block", "f") == 2
    catalog.update(1, name="first")
    assert [(r.id, r["name"]) for r in catalog.table().collect()] == [(2, "two"), (1, "first")]
    catalog.delete([2])
    assert [r.id for r in catalog.table().collect()] == [1]

    old = tmp_path / "d" / "trace_temp_x.arrow"
    old.parent.mkdir()
    old.write_text("x")
    os.utime(old, (time.time() - 7200,) * 2)
    (tmp_path / "trace_temp_new.arrow").write_text("y")
    assert store.clean_up(spark, [str(tmp_path)], 1) == 1 and not old.exists()
    assert store.delete_paths(spark, ["", str(tmp_path / "nothing"), foreign]) == [] and not os.path.exists(foreign)


def test_export(spark, tmp_path):
    rows = [("t", k, "0x28", k, 1, 10.0 + (k * 7 % 100) / 10, 30.0, 0, 0, 0.0, 0.0, 0.0, False) for k in range(100)]
    from blkscope.schema import TABLES

    df = spark.createDataFrame(rows, TABLES["cus"])
    files = export_csv(df, "cus", str(tmp_path), "log", Range("lba", 10.0, 15.0, 3.9, 80.2), max_rows=20)
    kept = sorted((r[5], r[1]) for r in rows if 10.0 <= r[5] <= 15.0 and 3 <= r[3] <= 80)
    assert len(files) == -(-len(kept) // 20)
    got = []
    for f in files:
        with open(f) as h:
            lines = h.read().splitlines()
        got += [float(x.split(",")[5]) for x in lines[1:]]
        assert f.endswith(f"log_{float(lines[1].split(',')[5]):.3f}_{float(lines[-1].split(',')[5]):.3f}.csv") and lines[0].startswith("trace,seq,opcode")
    assert got == [t for t, _ in kept]
    assert export_csv(df, "cus", str(tmp_path), "none", Range(time_from=1.0, time_to=2.0)) == []


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("\n".join([UFS, DONE, UFS.replace("123.456789", "125.0")]))
    stream = live.throughput(live.stream_events(live.stream_lines(spark, str(tmp_path / "in")), "ufs"), "ufs")
    query = stream.writeStream.outputMode("complete").format("memory").queryName("live").start()
    query.processAllAvailable()
    query.stop()
    assert sorted((r.start.second, r.requests, r.bytes) for r in spark.table("live").collect()) == [(3, 1, 32768), (5, 1, 32768)]
