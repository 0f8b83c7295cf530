"""A layout for zooms on time and address: the same rows, fewer row groups."""

import random

import pyarrow.parquet as pq
import pytest

from blkscope.operators.derive import derive
from blkscope.operators.filters import Range, apply_range
from blkscope.schema import ADDRESS, EVENTS, TIME
from blkscope.sources import store


def trace(spark, n=30000):
    rnd = random.Random(1)
    rows = [("a", i + 1, i * 0.001, "p", 1, rnd.choice(["send_req", "complete_rsp"]), i % 8, "0x28", rnd.choice([7, rnd.randrange(1 << 20), rnd.randrange(1 << 12)]), 1, 0, 0) for i in range(n)]
    rows += [("b", i + 1, i * 0.5, "p", 1, "send_req", i % 8, "0x2a", rnd.randrange(100), 1, 0, 0) for i in range(500)]
    return derive(spark.createDataFrame(rows, EVENTS["ufs"]), "ufs").persist()


def touched(folder, column, low, high):
    """Row groups of trace a whose statistics a range meets, and all of them."""
    hit = every = 0
    for file in folder.glob("ufs/trace=a/*.parquet"):
        meta = pq.ParquetFile(file).metadata
        at = meta.schema.names.index(column)
        for g in range(meta.num_row_groups):
            s = meta.row_group(g).column(at).statistics
            every += 1
            hit += s.min <= high and s.max >= low
    return hit, every


def test_a_zoom_on_the_address_reads_few_row_groups(spark, tmp_path):
    df = trace(spark)
    for layout in ("time", "zoom"):
        store.save(df, f"{tmp_path}/{layout}", "ufs", layout=layout, group_rows=250)
    for column, low, high in (("lba", 1 << 18, 1 << 19), ("time", 10.0, 12.0), ("lba", 1000, 1500)):
        hit, every = touched(tmp_path / "zoom", column, low, high)
        assert every >= 100 and hit < every / 4, (column, hit, every)
    hit, every = touched(tmp_path / "time", "lba", 1 << 18, 1 << 19)
    assert hit > every * 0.9
    r = Range("lba", 3.0, 20.0, 1000, 200000)
    got = [sorted(map(tuple, apply_range(store.load(spark, f"{tmp_path}/{x}", "ufs"), "ufs", r).select(*df.columns).collect())) for x in ("time", "zoom")]
    assert got[0] == got[1] and got[0]
    assert sorted(map(tuple, store.load(spark, f"{tmp_path}/zoom", "ufs").select(*df.columns).collect())) == sorted(map(tuple, df.collect()))


def test_cells_hold_about_as_many_rows_each(spark):
    cells = store.on_curve(trace(spark).filter("trace = 'a'"), "ufs", bits=3).groupBy("__curve").count().collect()
    assert 0 <= min(r["__curve"] for r in cells) and max(r["__curve"] for r in cells) < 64
    assert max(r["count"] for r in cells) < 30000 * 0.1


@pytest.mark.parametrize("kind", ["block", "cus"])
def test_every_kind_has_a_time_and_an_address(spark, kind):
    rows = spark.createDataFrame([("t", 1.0, 5), ("t", 2.0, 900), ("u", 3.0, None)], f"trace string, {TIME[kind]} double, {ADDRESS[kind]} long")
    assert store.on_curve(rows, kind).count() == 3


def test_an_unknown_layout_is_an_error(spark, tmp_path):
    with pytest.raises(ValueError, match="layout"):
        store.save(trace(spark), str(tmp_path), "ufs", layout="space")
