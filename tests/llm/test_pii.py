import hashlib
import random
import re

from pyspark.sql import functions as F

from blkscope.llm import pii
from blkscope.llm.queries import QUERIES

# the contract's patterns, plainly
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def counts(kind, s):
    d = re.sub("[^0-9]", "", s)
    return {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in s.split(".")), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]


def brute(text):
    return sorted((m.start(), n, m.end()) for n, (k, p) in enumerate(PLAIN.items()) for m in re.finditer(p, text or "") if counts(k, m.group()))


def base_of(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    return {(r["doc_id"], r["text"]): [tuple(s) for s in r["base"]] for r in pii.with_base(df.select("doc_id", pii.text_of("text").alias("text"))).collect()}


def test_base_spans_against_plain_patterns(spark):
    rnd = random.Random(3)
    pieces = ["4111 1111 1111 1111", "4111-1111-1111-1112", "+49 (30) 1234-5678", "a.b@c.d", "1.2.3.4", "300.1.2.3", "001.2.3.0255", "x", "@", ".", "b@c", "9", "-", " ", "😀", "é", "12", "+", "_"]
    rows = [(i, "".join(rnd.choice(pieces) for _ in range(rnd.choice([3, 12, 30])))) for i in range(600)]
    rows += [(i, "".join(rnd.choice("a1. @+-)(😀1é2.-@0 9_%") for _ in range(rnd.choice([5, 40, 200])))) for i in range(600, 1200)]
    rows += [(2000, ""), (2001, "a@b.c"), (2001, "a@b.c"), (2002, "1.2.3.4 " * 700), (2003, "a@b" + ".c" * 20000), (2004, "a@b.c" * 300)]
    got = base_of(spark, rows)
    for i, t in rows:
        assert got[(i, t)] == brute(t), t[:80]


def test_long_runs_stay_linear(spark):
    rows = [(1, "x" * 400000), (2, "1" * 400000), (3, "+1" + "(" * 400000), (4, "1 " * 200000)]
    assert all(v == [] for v in base_of(spark, rows).values())


def corpus():
    """Seeds in two contexts, other values in one of them, and numbers in plain prose."""
    rnd = random.Random(5)
    rows = []
    for i in range(60):
        rows.append((i, f"our office is open, telefon: +49 (30) {rnd.randrange(1000, 9999)}-{rnd.randrange(1000, 9999)} during the day"))
        rows.append((100 + i, f"write to mail: user{i}@mail{i % 7}.example.com if you like"))
        rows.append((200 + i, f"in the year {rnd.randrange(1000, 9999)} they counted {rnd.randrange(10**7, 10**8)} of the birds"))
        rows.append((300 + i, f"they counted +44 20 {rnd.randrange(1000, 9999)} {rnd.randrange(1000, 9999)} and the sum"))
    return rows


NEW = [
    (900, "the new branch, telefon: (030) 5512-3344 from tuesday on"),
    (901, "or mail: info [at] shop-berlin [dot] de whenever"),
    (902, "they counted 55123344 of the birds"),
    (903, "nothing here"),
    (904, None),
    (None, "the new branch, telefon: (030) 5512-3344 from tuesday on"),
]


def found(spark, rows, **more):
    out = pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string"), **more).collect()
    return {r["doc_id"]: ([tuple(s) for s in r["base"]], [tuple(s) for s in r["added"]]) for r in out}, len(out)


def test_contexts_tell_unseen_identifiers(spark):
    rows = corpus() + NEW
    got, n = found(spark, rows)
    assert n == len(rows)
    text = dict(NEW)[900]
    assert [text[a:b] for a, _, b in got[900][1]] == ["(030) 5512-3344"]
    assert got[900][1][0][1] == pii.KINDS.index("phone")
    assert got[None][1] == got[900][1]
    text = dict(NEW)[901]
    assert [text[a:b] for a, _, b in got[901][1]] == ["info [at] shop-berlin [dot] de"]
    assert all(got[i] == ([], []) for i in (902, 903, 904))
    for i, t in rows:
        assert got[i][0] == brute(t)
        assert i in (900, 901, None) or got[i][1] == []


def test_without_seeds_nothing_is_added(spark):
    got, _ = found(spark, NEW)
    assert all(v == ([], []) for v in got.values())


def test_a_value_told_by_one_context_speaks_for_another(spark):
    """The second context has no seed: its values stand in the first one too."""
    rows = [(i, f"telefon: +49 30 {i:04d} {7 * i:04d} today") for i in range(1000, 1200)]
    both = [f"(030) {i:04d}-{3 * i:04d}" for i in range(1000, 1030)]
    rows += [(i, f"telefon: {v} today") for i, v in enumerate(both)]
    rows += [(100 + i, f"reach us under {v} tomorrow") for i, v in enumerate(both)]
    rows += [(500, "reach us under (030) 9999-1234 tomorrow")]
    once, _ = found(spark, rows, rounds=1)
    more, _ = found(spark, rows, rounds=3)
    assert once[500][1] == []
    assert [a for a, _, _ in more[500][1]] == [15]


def test_masked_keeps_all_else(spark, hard):
    rows = [(1, "write to a@b.com or +49 30 1234 5678!", 3), (2, None, 4), (3, "nothing", 5), (1, "write to a@b.com or +49 30 1234 5678!", 3)]
    out = pii.masked(spark.createDataFrame(rows, "doc_id long, text string, spans int")).collect()
    assert sorted(map(tuple, out), key=str) == sorted([(1, "write to <email> or <phone>!", 3), (2, None, 4), (3, "nothing", 5), (1, "write to <email> or <phone>!", 3)], key=str)
    assert pii.masked(hard).count() == hard.count()


def test_hard_rows_and_none(spark, hard):
    assert pii.personal_data(hard).count() == hard.count()
    assert pii.personal_data(hard.limit(0)).count() == 0


def test_registered_query(spark, documents):
    got = {r["doc_id"]: r for r in QUERIES["op12_pii"](spark, "/root/testdata/sf0.001").collect()}
    for r in documents.collect():
        spans, row = brute(r["text"]), got[r["doc_id"]]
        assert [row[f"n_{k}"] for k in PLAIN] == [sum(s[1] == n for s in spans) for n in range(4)]
        digest = ",".join(f"{list(PLAIN)[n]}:{a}:{b}" for a, n, b in spans)
        assert row["base_sha256"] == hashlib.sha256(digest.encode()).hexdigest()
        assert row["n_added"] or row["spans"] == digest


def test_no_python_in_the_plan(spark, documents):
    plan = pii.with_matches(pii.with_base(documents.select(pii.text_of("text").alias("text"))), "like", pii.LOOSE, F.lit(True))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
