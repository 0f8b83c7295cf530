"""Parts from a state at rest, and streams with a state store, against one derivation of all rows."""

import os
import random
import uuid

import pytest
from pyspark.sql import functions as F

from blkscope.operators.derive import derive
from blkscope.operators.resume import at_rest, resume
from blkscope.plans.grow import GrowingLog
from blkscope.plans.ingest import ingest
from blkscope.schema import EVENTS, TABLES
from blkscope.sources import store
from blkscope.streaming.live import stream_derive, stream_numbered_events, stream_parts


def ufs(rnd, trace, n, start=0):
    out, t = [], 100.0
    for i in range(n):
        t += rnd.choice([0.0, 0.001, 0.25])
        out.append((trace, start + i + 1, t, "p", 1, rnd.choice(["send_req"] * 3 + ["complete_rsp"] * 3 + ["query_req"]), rnd.randrange(3), rnd.choice(["0x28", "0x2a"]), rnd.randrange(4), rnd.randrange(1, 3), 0, 0))
    return out


def block(rnd, trace, n, start=0):
    out, t = [], 100.0
    for i in range(n):
        t += rnd.choice([0.0, 0.001, 0.25])
        out.append((trace, start + i + 1, t, "p", 1, "d", rnd.choice(["block_rq_issue", "block_rq_complete", "block_getrq"]), 8, 0, rnd.choice(["R", "W", "WS", "FF", "D"]), 0, rnd.randrange(3), rnd.randrange(3), "c"))
    return out


MADE = {"ufs": ufs, "block": block}


def table(spark, kind, rows):
    return spark.createDataFrame(rows, EVENTS[kind])


def names(kind):
    return [c.split()[0] for c in TABLES[kind].split(", ")]


def plain(df, kind):
    return sorted(map(tuple, df.select(*names(kind)).collect()), key=str)


def at_once(spark, kind, rows, **more):
    return plain(derive(table(spark, kind, rows), kind, **more), kind)


@pytest.mark.parametrize("kind", ["ufs", "block"])
@pytest.mark.parametrize("bucket_rows", [None, 40])
def test_parts_equal_all_at_once(spark, tmp_path, kind, bucket_rows):
    rnd = random.Random(f"{kind}{bucket_rows}")
    rows = MADE[kind](rnd, "a", 260) + MADE[kind](rnd, "b", 90)
    later = MADE[kind](rnd, "new", 50)
    cuts = [0, *sorted(rnd.sample(range(1, 260), 2)), 400]
    state, got = at_rest(spark, kind), []
    for n, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
        part = [r for r in rows if lo < r[1] <= hi] + (later if n == 1 else [])
        made, after = resume(table(spark, kind, part), kind, state, bucket_rows=bucket_rows)
        got += plain(made, kind)
        for name in ("marks", "open", "listed"):  # at rest between parts
            if getattr(after, name) is not None:
                getattr(after, name).write.parquet(f"{tmp_path}/{n}/{name}")
        state = type(after)(*[spark.read.parquet(f"{tmp_path}/{n}/{x}") if getattr(after, x) is not None else None for x in ("marks", "open", "listed")])
    assert sorted(got, key=str) == at_once(spark, kind, rows + later)


def test_a_part_does_not_read_rows_before(spark, tmp_path):
    rows = ufs(random.Random(1), "a", 100)
    table(spark, "ufs", rows[:60]).write.parquet(f"{tmp_path}/first")
    _, after = resume(spark.read.parquet(f"{tmp_path}/first"), "ufs", at_rest(spark, "ufs"))
    for name in ("marks", "open"):
        getattr(after, name).write.parquet(f"{tmp_path}/{name}")
    state = type(after)(spark.read.parquet(f"{tmp_path}/marks"), spark.read.parquet(f"{tmp_path}/open"))
    made, _ = resume(table(spark, "ufs", rows[60:]), "ufs", state)
    assert "/first" not in " ".join(made.inputFiles())
    assert any("/marks" in f for f in made.inputFiles())


def test_a_sorted_trace_goes_on_by_time(spark):
    rows = ufs(random.Random(2), "a", 120)
    mixed = [r[:2] + ((r[2] - 0.0005),) + r[3:] if i in (5, 80) else r for i, r in enumerate(rows)]
    mixed[6], mixed[7] = mixed[6][:2] + (mixed[7][2] + 1e-4,) + mixed[6][3:], mixed[7]
    first, after = resume(table(spark, "ufs", mixed[:60]), "ufs", at_rest(spark, "ufs"))
    second = [r for r in mixed[60:] if r[2] >= max(x[2] for x in mixed[:60])]
    rest, _ = resume(table(spark, "ufs", second), "ufs", after)
    assert sorted(plain(first, "ufs") + plain(rest, "ufs"), key=str) == at_once(spark, "ufs", mixed[:60] + second)


def test_parts_that_would_change_earlier_rows_are_errors(spark):
    rows = ufs(random.Random(3), "a", 50)
    _, after = resume(table(spark, "ufs", rows[:30]), "ufs", at_rest(spark, "ufs"))
    with pytest.raises(ValueError, match="does not follow"):  # lines again
        resume(table(spark, "ufs", rows[29:]), "ufs", after)
    back = [rows[30][:2] + (1.0,) + rows[30][3:]]
    with pytest.raises(ValueError, match="does not follow"):  # time runs backwards among the first rows
        resume(table(spark, "ufs", back), "ufs", after)
    _, by_time = resume(table(spark, "ufs", rows[:30]), "ufs", at_rest(spark, "ufs"), strict_order=True)
    with pytest.raises(ValueError, match="does not follow"):
        resume(table(spark, "ufs", back), "ufs", by_time, strict_order=True)
    with pytest.raises(ValueError, match="at once"):
        resume(table(spark, "ufs", rows), "cus", after)


def test_rows_without_order_after_the_head_stay_in_line_order(spark):
    rows = ufs(random.Random(4), "a", 1010)
    late = [("a", 1011, 1.0, "p", 1, "send_req", 0, "0x28", 0, 1, 0, 0)] + ufs(random.Random(5), "a", 20, 1011)
    first, after = resume(table(spark, "ufs", rows), "ufs", at_rest(spark, "ufs"))
    rest, _ = resume(table(spark, "ufs", late), "ufs", after)
    assert sorted(plain(first, "ufs") + plain(rest, "ufs"), key=str) == at_once(spark, "ufs", rows + late)


def line_of(r):
    return f"kworker/u16:3 [{r[4]}] d..1. {r[2]:.6f}: ufshcd_command: {r[5]}: 1d84000.ufshc: tag: {r[6]}, DB: 0x0, size: {r[9] * 4096}, IS: 0, LBA: {r[8]}, opcode: {r[7]}, group_id: 0x0, hwq_id: 0"


def block_line_of(r):
    return f"kworker/u16:0 [{r[4]}] d..1. {r[2]:.6f}: {r[6]}: 8,0 {r[9]} 0 () {r[11]} + {r[12]} [c]"


def log_lines(n=90):
    rnd = random.Random(6)
    u, b = ufs(rnd, "x", n), block(rnd, "x", n)
    lines = [x for pair in zip(map(block_line_of, b), map(line_of, u)) for x in pair]
    return [x for i, x in enumerate(lines) for x in ([x, "no kind"] if i % 20 == 0 else [x])]


def test_a_log_in_parts_is_the_log_at_once(spark, tmp_path):
    lines = log_lines()
    (tmp_path / "whole").mkdir()
    (tmp_path / "whole" / "dev.log").write_text("\n".join(lines) + "\n")
    ingest(spark, f"{tmp_path}/whole/dev.log", f"{tmp_path}/once")
    kinds = [k for k in ("ufs", "block") if (tmp_path / "once" / k).exists()]
    assert kinds
    log, cuts = GrowingLog(spark, f"{tmp_path}/parts", "dev.log"), [0, 70, 71, len(lines)]
    for n, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
        (tmp_path / f"dev.log.{n}").write_text("".join(f"{x}\n" for x in lines[lo:hi]))
        log.add(f"{tmp_path}/dev.log.{n}")
    for kind in kinds:
        assert plain(store.load(spark, f"{tmp_path}/parts", kind), kind) == plain(store.load(spark, f"{tmp_path}/once", kind), kind)


def test_a_part_that_broke_off_leaves_nothing_and_one_that_was_claimed_is_moved(spark, tmp_path, monkeypatch):
    lines = log_lines(60)
    for n in range(2):
        (tmp_path / f"l.{n}").write_text("".join(f"{x}\n" for x in lines[n * 60 : n * 60 + 60]))
    log = GrowingLog(spark, f"{tmp_path}/t", "l")
    log.add(f"{tmp_path}/l.0")
    before = plain(store.load(spark, f"{tmp_path}/t", "block"), "block")
    with monkeypatch.context() as m:
        m.setattr(store.Versions, "claim", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            log.add(f"{tmp_path}/l.1")
    assert plain(store.load(spark, f"{tmp_path}/t", "block"), "block") == before
    with monkeypatch.context() as m:
        m.setattr(GrowingLog, "publish", lambda self: None)
        log.add(f"{tmp_path}/l.1")
    GrowingLog(spark, f"{tmp_path}/t", "l").publish()
    GrowingLog(spark, f"{tmp_path}/t", "l").publish()
    (tmp_path / "both").write_text("".join(f"{x}\n" for x in lines[:120]))
    ingest(spark, f"{tmp_path}/both", f"{tmp_path}/o")
    got = store.load(spark, f"{tmp_path}/t", "block").withColumn("trace", F.lit("both"))
    assert plain(got, "block") == plain(store.load(spark, f"{tmp_path}/o", "block"), "block") and before


def run_stream(spark, tmp_path, kind, batches, delay=None, stops=()):
    """The rows that a query gives of batches, stopped and started again from its checkpoint before some of them."""
    source, check, name = tmp_path / uuid.uuid4().hex, tmp_path / uuid.uuid4().hex, tmp_path / uuid.uuid4().hex
    source.mkdir()

    def go():
        df = spark.readStream.schema(EVENTS[kind]).option("maxFilesPerTrigger", 1).parquet(str(source))
        q = stream_derive(df, kind, delay).writeStream.format("parquet").option("path", str(name)).option("checkpointLocation", str(check)).trigger(availableNow=True).start()
        assert q.awaitTermination(240)

    for n, rows in enumerate(batches):
        if n in stops:
            go()
        table(spark, kind, rows).coalesce(1).write.mode("append").parquet(str(source))
    go()
    return plain(spark.read.schema(TABLES[kind]).parquet(str(name)), kind)


def cut(rnd, rows, n):
    at = [0, *sorted(rnd.sample(range(1, len(rows)), n - 1)), len(rows)]
    parts = [rows[a:b] for a, b in zip(at, at[1:])]
    for p in parts:
        rnd.shuffle(p)
    return parts


@pytest.mark.parametrize("kind", ["ufs", "block"])
def test_a_stream_gives_the_rows_of_derive(spark, tmp_path, kind):
    rnd = random.Random(kind)
    rows = MADE[kind](rnd, "a", 160)
    other = MADE[kind](rnd, "b", 40)
    parts = [p + q for p, q in zip(cut(rnd, rows, 4), cut(rnd, other, 4))]
    assert run_stream(spark, tmp_path, kind, parts, stops=(2,)) == at_once(spark, kind, rows + other)


def test_a_stream_by_time_waits_and_tells_late_rows(spark, tmp_path):
    rnd = random.Random(9)
    rows = [r[:2] + (100 + i * 0.01,) + r[3:] for i, r in enumerate(ufs(rnd, "a", 150))]
    mixed = [rows[j] for j in sorted(range(150), key=lambda j: j + rnd.random() * 6)]  # up to six places, or 0.06 s
    last = [("a", 1000, 900.0, "p", 1, "query_req", 0, "0x28", 0, 1, 0, 0)]
    late = [("a", 1001, 100.5, "p", 1, "send_req", 0, "0x28", 0, 1, 0, 0)]
    got = run_stream(spark, tmp_path, "ufs", [mixed[:50], mixed[50:90], mixed[90:], last, late], delay=0.1, stops=(1, 3))
    assert [r for r in got if r[1] < 1000] == at_once(spark, "ufs", rows, strict_order=True)
    assert [(r[1], r[-5:]) for r in got if r[1] >= 1000] == [(1001, (None,) * 5)]  # the newest row still waits


def test_a_late_line_changes_nothing(spark, tmp_path):
    rows = ufs(random.Random(11), "a", 60)
    got = run_stream(spark, tmp_path, "ufs", [rows[:30], rows[29:30] + rows[30:]], stops=(1,))
    assert [r for r in got if r[-1] is not None] == at_once(spark, "ufs", rows)
    assert sum(r[-1] is None for r in got) == 1


def test_parts_of_a_log_stream_in_order(spark, tmp_path):
    lines = log_lines(80)
    folder = tmp_path / "in"
    folder.mkdir()
    for n, lo in enumerate(range(0, len(lines), 40)):
        (folder / f"dev.log.{n}").write_text("".join(f"{x}\n" for x in lines[lo : lo + 40]))
        os.utime(folder / f"dev.log.{n}", (1_700_000_000 + n, 1_700_000_000 + n))
    events = stream_numbered_events(stream_parts(spark, str(folder), "dev.log", 2), "block")
    q = stream_derive(events, "block").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    assert q.awaitTermination(240)
    (tmp_path / "dev.log").write_text("\n".join(lines) + "\n")
    ingest(spark, f"{tmp_path}/dev.log", f"{tmp_path}/t")
    got = [r[:1] + r[2:] for r in spark.read.schema(TABLES["block"]).parquet(f"{tmp_path}/out").orderBy("seq").select(*names("block")).collect()]
    want = [r[:1] + r[2:] for r in store.load(spark, f"{tmp_path}/t", "block").orderBy("seq").select(*names("block")).collect()]
    assert got == want
