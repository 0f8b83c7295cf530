import random
import re

from blkscope.llm import substring as S


def brute(rows):
    """The contract word for word."""
    docs = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, w in docs:
        if i is not None:
            for k in range(len(w) - 49):
                window = tuple(w[k : k + 50])
                first[window] = min(first.get(window, i), i)
    out = []
    for i, w in docs:
        gone = set()
        if i is not None:
            for k in range(len(w) - 49):
                if first[tuple(w[k : k + 50])] < i:
                    gone.update(range(k, k + 50))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


def result(df, **more):
    return sorted((tuple(r) for r in S.substring_dedup(df, **more).collect()), key=str)


def planted(seed):
    """Documents that share passages of around 50 words, at edges, overlapping, nested, in several copies, and runs of one word."""
    rnd = random.Random(seed)
    word = lambda: rnd.choice("aé bb ccc dd e ff".split()) + str(rnd.randrange(400))
    passages = [[word() for _ in range(n)] for n in (49, 50, 51, 60, 120, 200, 50)]
    rows = []
    for i in range(60):
        own = [word() for _ in range(rnd.randrange(0, 120))]
        for p in rnd.sample(passages, rnd.randrange(0, 4)):
            a = rnd.randrange(0, 3)
            at = rnd.randrange(len(own) + 1)
            own[at:at] = p[a : len(p) - rnd.randrange(0, 3)]
        if i % 9 == 0:
            own += ["same"] * rnd.randrange(45, 160)
        rows.append((rnd.randrange(1000), rnd.choice([" ", "\n", "\t \r"]).join(own)))
    near = [word() for _ in range(300)]
    for i in range(12):
        copy = list(near)
        for _ in range(i):
            copy[rnd.randrange(len(copy))] = word()
        rows.append((2000 - i, " ".join(copy)))
    return rows + [rows[3], (rows[4][0] + 1, rows[4][1]), (None, rows[5][1])]


def test_planted_passages(spark):
    for seed in range(4):
        rows = planted(seed)
        df = spark.createDataFrame([(i, t, "n", 1) for i, t in rows], "doc_id long, text string, name string, block int")
        for block_bytes in (1 << 10, 1 << 14, 1 << 24):
            assert result(df, block_bytes=block_bytes) == brute(rows)


def test_hard_rows_and_documents(hard, documents):
    for df in (hard, documents):
        assert result(df, block_bytes=100_000) == brute([(r.doc_id, r.text) for r in df.collect()])
    assert result(hard.limit(0)) == []


def test_word_hashes_do_not_depend_on_the_place(monkeypatch):
    text = "the cat  ünd\tthe\ncat " * 500
    whole = S.word_hashes(text.encode())
    monkeypatch.setattr(S, "PIECE", 64)
    assert (S.word_hashes(text.encode()) == whole).all()
    assert len(whole) == len(text.split()) and len(set(whole.tolist())) == 3
    assert S.word_hashes(b"") .size == S.word_hashes(b" \n").size == 0


def thue_morse(n):
    """Two words of 2 to the n letters whose weighed sums agree for any odd weight."""
    bits = [bin(k).count("1") % 2 for k in range(1 << n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_words_of_equal_quick_hashes_are_not_equal(spark):
    a, b = thue_morse(10)
    assert len(set(S.word_hashes(f"{a} {b}".encode()).tolist())) == 1
    head, tail = " ".join(f"w{k}" for k in range(49)), " ".join(f"v{k}" for k in range(49))
    rows = [(1, f"{head} {a}"), (2, f"{head} {b}"), (3, f"{a} {tail}"), (4, f"{b} {tail}"), (5, f"{a} {tail}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(df) == brute(rows) and [r[2] for r in result(df)] == [0, 0, 0, 0, 50]


def test_only_the_automaton_locates(spark, monkeypatch):
    import ahocorasick

    rows = planted(1)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(df) == brute(rows)

    def run(confirmed):
        return ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)

    monkeypatch.setattr(S, "automaton_of", run)
    short = [(i, n) for i, _, n, _ in result(df)]
    assert short != [(i, n) for i, _, n, _ in brute(rows)]


def test_keys_must_be_whole_numbers(spark):
    import pytest

    with pytest.raises(ValueError, match="whole numbers"):
        S.substring_dedup(spark.createDataFrame([("a", "x")], "doc_id string, text string"))


def test_windows_are_found_once(spark, documents):
    """Each step over the blocks stands once in the plan: anchors, windows and what is removed."""
    out = S.substring_dedup(documents)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("FlatMapCoGroupsInArrow") == 3
