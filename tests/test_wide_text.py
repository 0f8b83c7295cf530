"""UTF-16 logs from splits of any size: every line once, with its number."""

import random

import pytest

from blkscope.sources import text


def written(path, lines, encoding, end="\n", last=True):
    mark = {"utf-16-le": b"\xff\xfe", "utf-16-be": b"\xfe\xff"}[encoding]
    path.write_bytes(mark + (end.join(lines) + (end if last else "")).encode(encoding))


def lines_of(seed, n=400):
    rnd = random.Random(seed)
    # units whose bytes beside each other look like a line end: U+0Axx before U+xx00, U+xx0A, U+000A's halves
    odd = ["ਅ", "Ā", "ਊ", "Ċ", "਀", "Ȁ", "가", "x", "1", " ", "😀"]
    return ["".join(rnd.choice(odd if rnd.random() < 0.3 else "abc 123") for _ in range(rnd.choice([0, 1, 7, 30]))) for _ in range(n)]


@pytest.mark.parametrize("encoding", ["utf-16-le", "utf-16-be"])
@pytest.mark.parametrize("split", [7, 64, 1000, 1 << 20])
def test_every_line_once_for_any_split(spark, tmp_path, encoding, split):
    lines = lines_of(split, 60 if split == 7 else 400)
    written(tmp_path / "a.log", lines, encoding, last=split != 64)
    written(tmp_path / "b.log", ["plain", "lines", "only"], encoding, end="\r\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = text.read_log(spark, str(tmp_path)).collect()
        parts = text.read_log(spark, f"{tmp_path}/a.log").select("line").rdd.getNumPartitions() if split == 1000 else None
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])
    got = {name: [r.line for r in sorted(rows, key=lambda r: r.line_no) if r.trace == name] for name in ("a.log", "b.log")}
    want = lines[:-1] if split == 64 and not lines[-1] else lines
    assert got["a.log"] == want
    assert got["b.log"] == ["plain", "lines", "only"]
    assert sorted(r.line_no for r in rows if r.trace == "a.log") == list(range(1, len(want) + 1))
    assert parts is None or parts >= 1


def test_a_log_is_shared_by_tasks(spark, tmp_path):
    written(tmp_path / "a.log", [f"line {i}" for i in range(5000)], "utf-16-le")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        raw = spark.read.option("encoding", "UTF-16LE").option("lineSep", "\n").text(f"{tmp_path}/a.log")
        assert raw.rdd.getNumPartitions() >= 8
        assert text.read_log(spark, f"{tmp_path}/a.log").count() == 5000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_an_odd_byte_at_the_end_is_replaced(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"\xff\xfe" + "one\ntwo".encode("utf-16-le") + b"x")
    rows = text.read_log(spark, str(tmp_path)).orderBy("line_no").collect()
    assert [r.line_no for r in rows] == [1, 2] and rows[0].line == "one" and rows[1].line.startswith("two")
