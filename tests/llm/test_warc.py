import gzip
import random
from collections import defaultdict

import pyarrow.fs
import pytest

from blkscope.llm import warc as W


def brute(rows, least=0):
    last = defaultdict(list)
    for i, p in rows:
        if i is not None:
            last[p].append(i)
    out = []
    for i, p in rows:
        refers = max(last[p]) if i is not None and len(p) >= least and max(last[p]) != i else None
        out.append((i, len(p), W.payload_digest(p), "revisit" if refers is not None else "response", refers))
    return sorted(out, key=str)


ROWS = [(1, "http://a/", "same"), (2, "http://b/", "same"), (3, None, None), (4, "http://c/ d", ""), (5, "x", "ü" * 100_000), (5, "x", "ü" * 100_000), (None, "n", "same"), (9, "\r\ny: z", "WARC/1.1\r\n\r\n")]


def test_round_trip(spark, pages):
    rows = ROWS + [(100 + r.page_id, r.url, r.html) for r in pages.collect()]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string")
    got = W.warc_round_trip(df).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted(map(tuple, got.collect()), key=str) == brute([(i, (h or "").encode()) for i, _, h in rows])
    least = W.warc_round_trip(df, least_bytes=5).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted(map(tuple, least.collect()), key=str) == brute([(i, (h or "").encode()) for i, _, h in rows], 5)


def test_any_split_gives_each_record_once(tmp_path):
    rnd = random.Random(3)
    payloads = [rnd.randbytes(rnd.randrange(0, 4000)) + W.MAGIC * rnd.randrange(3) for _ in range(60)]
    members = [W.record(k, "u", p, None) for k, p in enumerate(payloads)]
    other = gzip.compress(b"not a record")
    path = tmp_path / "a.warc.gz"
    path.write_bytes(b"".join(m + (other if k % 7 == 0 else b"") for k, m in enumerate(members)))
    fs = pyarrow.fs.LocalFileSystem()
    size = path.stat().st_size
    for step in (1 << 30, 5000, 997, 64):
        found = [c for a in range(0, size, step) for _, c in W.records_in(fs, str(path), a, min(size, a + step))]
        assert [W.parsed(c)[1] for c in found] == payloads


def test_reader_splits_and_empty(spark, tmp_path):
    df = spark.createDataFrame([(k, "u", str(k) * 50) for k in range(200)], "page_id long, url string, html string")
    files = W.write_warc(W.with_revisits(df), f"file://{tmp_path}/w", file_bytes=4000)
    assert files.count() > 4
    listed = W.list_archives(spark, f"file://{tmp_path}/w/*.warc.gz")
    for split in (100, 1 << 20):
        rows = W.read_warc(listed, split_bytes=split, payloads=True).collect()
        assert sorted((r.row_id, bytes(r.payload).decode()) for r in rows) == [(k, str(k) * 50) for k in range(200)]
    assert W.warc_round_trip(df.limit(0)).count() == 0


def packed(*records):
    """Records in one gzip member."""
    return gzip.compress(b"".join(gzip.decompress(r) for r in records))


def read(spark, tmp_path, raw, split=1000):
    path = tmp_path / "x.warc.gz"
    path.write_bytes(raw)
    files = spark.createDataFrame([(f"file://{path}", len(raw))], "path string, bytes long")
    return sorted((r.row_id, r.payload_bytes) for r in W.read_warc(files, split_bytes=split).collect())


def test_a_record_within_a_payload_is_no_record(spark, tmp_path):
    rnd = random.Random(1)
    inner = W.record(7, "u", b"inner", None)
    outer = [rnd.randbytes(60_000) + inner + rnd.randbytes(60_000), rnd.randbytes(5000) + inner[:-9] + rnd.randbytes(5000)]
    raw = b"".join(W.record(k, "u", p, None) for k, p in enumerate(outer))
    assert inner in raw
    for split in (1000, 1 << 20):
        assert read(spark, tmp_path, raw, split) == [(0, len(outer[0])), (1, len(outer[1]))]


def test_several_records_in_a_member(spark, tmp_path):
    raw = packed(*[W.record(k, "u", b"p" * k, None) for k in range(5)]) + W.record(9, "u", b"x", None)
    assert read(spark, tmp_path, raw, 50) == [(k, k) for k in range(5)] + [(9, 1)]


@pytest.mark.parametrize("split", [300, 1 << 20])
def test_damage_is_an_error(spark, tmp_path, split):
    rnd = random.Random(2)
    one, two = (W.record(k, "u", rnd.randbytes(3000), None) for k in (1, 2))
    body = bytearray(one)
    body[1500:1520] = bytes(20)
    start = b"\x00\x00" + one[2:]
    for raw in (one + two[:-200], bytes(body) + two, start + two, one + two + b"trailing", one + b"between" + two):
        with pytest.raises(Exception, match="damaged|no whole gzip member"):
            read(spark, tmp_path, raw, split)
    assert [i for i, _ in read(spark, tmp_path, one + gzip.compress(b"other content") + two, split)] == [1, 2]
