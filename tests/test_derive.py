"""Window plans against plain state machines, over random traces with ties, unmatched, repeated and foreign events."""

import random

import pytest

from blkscope.operators.derive import dedup_block, derive
from blkscope.operators.order import conditional_sort
from blkscope.schema import COMPLETE, EVENTS, SEND


def in_order(rows, time, head=1000):
    rows = sorted(rows, key=lambda r: r["seq"])
    first = rows[:head]
    if any(a[time] > b[time] for a, b in zip(first, first[1:])):
        rows = sorted(rows, key=lambda r: (r[time], r["seq"]))
    return rows


def op_class(io):
    return {"R": "read", "W": "write", "D": "discard"}.get(io[:1], "other")


def machine_dedup(rows):
    out, outstanding = [], set()
    for r in in_order(rows, "time"):
        key = (r["sector"], op_class(r["io_type"]), r["size"])
        if r["action"] == SEND["block"]:
            if key in outstanding:
                continue
            outstanding.add(key)
        elif r["action"] == COMPLETE["block"]:
            if r["io_type"].startswith("W") and r["size"] == 0:
                continue
            outstanding.discard(key)
        out.append(r)
    return out


def machine_events(rows, kind):
    rows = machine_dedup(rows) if kind == "block" else in_order(rows, "time")
    qd, sent, idle, busy, done, nxt = 0, {}, None, None, None, None
    out = []
    for r in rows:
        op = r["opcode"] if kind == "ufs" else op_class(r["io_type"])
        key = (r["tag"], op) if kind == "ufs" else (r["sector"], op)
        address = r["lba"] if kind == "ufs" else r["sector"]
        dtoc = ctoc = ctod = 0.0
        cont = False
        if r["action"] == SEND[kind]:
            if kind == "ufs" or op != "other":
                cont = nxt == (address, op)
                nxt = (address + r["size"], op)
            sent[key] = r["time"]
            qd += 1
            if qd == 1:
                if idle is not None:
                    ctod = (r["time"] - idle) * 1000.0
                busy = r["time"]
        elif r["action"] == COMPLETE[kind]:
            qd = max(0, qd - 1)
            if key in sent:
                dtoc = (r["time"] - sent.pop(key)) * 1000.0
            if busy is not None:
                ctoc = (r["time"] - busy) * 1000.0
            elif done is not None:
                ctoc = (r["time"] - done) * 1000.0
            busy = None
            if qd == 0:
                idle = r["time"]
            done = r["time"]
        out.append((r["trace"], r["seq"], qd, dtoc, ctoc, ctod, cont))
    return out


def machine_requests(rows):
    rows = in_order(rows, "start_time")
    ends = sorted([(r["start_time"], r["seq"], 0) for r in rows] + [(r["end_time"], r["seq"], 1) for r in rows])
    qd, depth = 0, {}
    for _, seq, kind in ends:
        qd = qd + 1 if kind == 0 else max(0, qd - 1)
        depth[seq, kind] = qd
    out, last, idle = [], None, None
    for r in rows:
        start, end = depth[r["seq"], 0], depth[r["seq"], 1]
        ctoc = 0.0 if last is None else max(0.0, (r["end_time"] - last["end_time"]) * 1000.0)
        since = idle if start == 1 else None if last is None else last["end_time"]
        ctod = 0.0 if since is None else max(0.0, (r["start_time"] - since) * 1000.0)
        cont = last is not None and r["lba"] == last["lba"] + last["size"] and r["opcode"] == last["opcode"]
        out.append((r["trace"], r["seq"], start, end, (r["end_time"] - r["start_time"]) * 1000.0, ctoc, ctod, cont))
        if end == 0:
            idle = r["end_time"]
        last = r
    return out


def random_rows(kind, seed, n=400):
    rnd = random.Random(seed)
    rows = []
    for trace in ("a", "b"):
        t = 0.0
        for seq in range(n):
            t += rnd.choice([0, 0, 0.001, 0.002, 0.5])
            time = t - (rnd.random() if seed % 2 and seq == (150 if trace == "a" else 1150) else 0)
            if kind == "ufs":
                rows.append(dict(trace=trace, seq=seq, time=time, process="p", cpu=seq % 3, action=rnd.choice(["send_req", "complete_rsp", "complete_rsp", "send_req", "query_req"]), tag=rnd.randrange(3), opcode=rnd.choice(["0x28", "0x2a"]), lba=rnd.randrange(6), size=rnd.randrange(3), groupid=0, hwqid=0))
            elif kind == "block":
                rows.append(dict(trace=trace, seq=seq, time=time, process="p", cpu=0, flags="", action=rnd.choice([SEND["block"], COMPLETE["block"], "block_getrq"]), devmajor=8, devminor=0, io_type=rnd.choice(["R", "W", "WS", "D", "FF"]), extra=0, sector=rnd.randrange(4), size=rnd.randrange(3), comm="c"))
            else:
                rows.append(dict(trace=trace, seq=seq, opcode=rnd.choice(["0x28", "0x2a"]), lba=rnd.randrange(6), size=rnd.randrange(3), start_time=time, end_time=time + rnd.choice([0, 0.001, 0.3, 2.0])))
    return rows


COLUMNS = {
    "ufs": ["trace", "seq", "qd", "dtoc", "ctoc", "ctod", "continuous"],
    "block": ["trace", "seq", "qd", "dtoc", "ctoc", "ctod", "continuous"],
    "cus": ["trace", "seq", "start_qd", "end_qd", "dtoc", "ctoc", "ctod", "continuous"],
}


def frame(spark, kind, rows):
    names = [c.split()[0] for c in EVENTS[kind].split(", ")]
    return spark.createDataFrame([tuple(r[c] for c in names) for r in rows], EVENTS[kind])


@pytest.mark.parametrize("kind", ["ufs", "block", "cus"])
@pytest.mark.parametrize("seed", [0, 1, 2])
def test_derive(spark, kind, seed):
    rows = random_rows(kind, seed)
    want = []
    for trace in ("a", "b"):
        own = [r for r in rows if r["trace"] == trace]
        want += machine_requests(own) if kind == "cus" else machine_events(own, kind)
    df = frame(spark, kind, rows).repartition(3)
    for bucket_rows in (None, 60) if seed else (None, 60, 7):
        got = derive(df, kind, bucket_rows).select(*COLUMNS[kind]).collect()
        assert sorted(map(tuple, got)) == sorted(want)


def test_dedup(spark):
    rows = [r for r in random_rows("block", 5) if r["trace"] == "a"]
    want = sorted(r["seq"] for r in machine_dedup(rows))
    for bucket_rows in (None, 50):
        assert sorted(r.seq for r in dedup_block(frame(spark, "block", rows), bucket_rows).collect()) == want


@pytest.mark.parametrize("bucket_rows", [None, 300])
def test_order_looks_at_the_first_rows_only(spark, bucket_rows):
    def rows(back):
        return [dict(trace="t", seq=k, opcode="x", lba=0, size=0, start_time=float(k if k != back else k - 1.5), end_time=0.0) for k in range(1600)]

    late = conditional_sort(frame(spark, "cus", rows(1500)), "start_time", bucket_rows=bucket_rows).collect()
    assert [r.seq for r in sorted(late, key=lambda r: r.ord)] == list(range(1600))
    early = conditional_sort(frame(spark, "cus", rows(500)), "start_time", bucket_rows=bucket_rows).collect()
    assert [r.seq for r in sorted(early, key=lambda r: r.ord)][497:502] == [497, 498, 500, 499, 501]


def test_empty(spark):
    for kind in ("ufs", "block", "cus"):
        assert derive(frame(spark, kind, []), kind).count() == 0
