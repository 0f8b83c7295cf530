import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from blkscope.llm import prefix_trie as P
from blkscope.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string"


def sequences(rows):
    """Conversation to its rebuilt turns (role, text)."""
    found = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            found[c].append(((t is not None, t or 0), hashlib.sha256(f"{len(r)}:{r}{x}".encode()).digest()[:16], (r, x)))
    turns = {c: [x[2] for x in sorted(v, key=lambda z: z[:2])] for c, v in found.items()}
    out = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        out[c] = tuple(turns.get(base, [])[:h] + own[h:])
    return out


def brute(rows):
    seqs = sequences(rows)
    members, kids, leaves, saved = defaultdict(list), defaultdict(set), defaultdict(int), defaultdict(int)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
            if d:
                kids[s[: d - 1]].add(s[:d])
    for p in sorted(members, key=len, reverse=True):
        leaves[p] += not kids[p]
        if p:
            saved[p] += (len(members[p]) - 1) * len(p[-1][1])
            leaves[p[:-1]] += leaves[p]
            saved[p[:-1]] += saved[p]
    out = []
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(seqs[c]) == len(p))))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def made(spark, rows, **more):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return sorted(map(tuple, P.prefix_trie(P.rebuilt(P.ordered_turns(df)), **more).collect()), key=str)


def conversations(seed, n=120):
    rnd = random.Random(seed)
    rows = []
    for c in rnd.sample(range(-150, 450), n):
        base = rnd.choice("ab")
        for t in range(rnd.choice([1, 2, 4, 6, 10, 15])):
            rows.append((c if rnd.random() > 0.01 else None, t if rnd.random() > 0.05 else None, rnd.choice(["u", None, "a"]) if rnd.random() < 0.1 else "u", (base + str(t) * rnd.choice([1, 1, 1, 2])) if rnd.random() > 0.04 else rnd.choice(["", None])))
    return rows


@pytest.mark.parametrize(("slab", "range_bytes"), [(2, 300), (3, 1 << 20), (256, 300)])
def test_against_brute_force_in_slabs_and_ranges_of_any_size(spark, slab, range_bytes):
    rows = conversations(slab)
    assert made(spark, rows, slab=slab, range_bytes=range_bytes) == brute(rows)


def test_copies_repeats_ties_and_turnless(spark):
    rows = [(c, t, "u", f"turn {t}") for c in range(300, 360) for t in range(7)]  # copies
    rows += [(400, 1, "u", "x"), (400, 1, "u", "x"), (400, 1, "a", "y"), (500, None, None, None)]
    rows += [(601, 0, "u", "only turn of a conversation without a first"), (None, 1, "u", "no conversation")]
    got = made(spark, rows, slab=4)
    assert got == brute(rows)
    assert any(r[1] == 0 and r[7] != hashlib.sha256(b"").hexdigest() for r in got) == any(not s for s in sequences(rows).values())


def test_no_rows_and_clashing_columns(spark):
    assert made(spark, []) == []
    assert made(spark, [(None, 1, "u", "x")]) == []
    df = spark.createDataFrame([(1, 0, "u", "x", 5, "y")], SCHEMA + ", conv int, sym string")
    assert P.prefix_trie(P.rebuilt(P.ordered_turns(df))).count() >= 1


def test_long_conversations_share_slabs(spark):
    rows = [(c, t, "u", f"t{t}" if t < 40 + c % 3 else f"{c} {t}") for c in (100, 101, 102, 103) for t in range(50)]
    assert made(spark, rows, slab=8, range_bytes=500) == brute(rows)


def test_a_position_does_not_depend_on_how_rows_are_dealt_out(spark):
    rows = [(7, t, "u", f"t{t}") for t in range(200)] + [(8, 0, "u", "x")]
    got = P.ordered_turns(spark.createDataFrame(rows, SCHEMA).repartition(5)).filter("conv = 7").orderBy("pos").collect()
    assert [r["pos"] for r in got] == list(range(200))
    assert [bytes(r["sym"]) for r in got] == [hashlib.sha256(f"1:ut{t}".encode()).digest()[:16] for t in range(200)]


def test_merge_compares_shared_turns_once(monkeypatch):
    """From the first comparison on, the loser tree starts where rows are known to be equal: turns compared don't grow with the shared prefix."""
    looked = []
    plain = P.shared

    def counted(x, y, start):
        n = plain(x, y, start)
        looked.append(n - start + 1)
        return n

    def keys(run, length):
        head = b"".join(bytes([0] * 15 + [i % 250]) for i in range(length))
        return [(head + bytes([1] * 14 + divmod_bytes(run + 8 * i)), [0] * (length + 1), (0, 1, run, False)) for i in range(60)]

    def divmod_bytes(v):
        return list(v.to_bytes(2, "big"))

    def work(length):
        runs = [P.run_of(keys(r, length)) for r in range(8)]
        monkeypatch.setattr(P, "shared", counted)
        looked.clear()
        rows = list(P.merged(runs))
        monkeypatch.setattr(P, "shared", plain)
        assert [r[1] for r in rows] == sorted(r[1] for r in rows)
        assert [r[0] for r in rows] == [0] + [plain(a[1], b[1], 0) for a, b in zip(rows, rows[1:])]
        return sum(looked)

    assert work(200) <= work(20) + 8 * 181


def test_registered_query(spark):
    got = QUERIES["op11_prefix_trie"](spark, "/root/testdata/sf0.001")
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)
    assert dict(got.dtypes) == {c: "string" if c == "ends_sha256" else "bigint" for c in got.columns}
