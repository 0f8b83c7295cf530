import random
import re

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from blkscope.llm import simhash as S
from blkscope.llm.components import components


def plain(text, shingle=4):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + shingle]) for k in range(max(1, len(words) - shingle + 1))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows, shingle=4, k=4):
    fps = [(i, plain(t, shingle)) for i, t in rows]
    root = list(range(len(fps)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a][1] ^ fps[b][1]).bit_count() <= k:
                root[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(fps):
        if i is not None:
            least[find(a)] = min(least.get(find(a), i), i)
    return sorted(((i, f"{fp:016x}", least.get(find(a))) for a, (i, fp) in enumerate(fps)), key=str)


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.collect()]


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=200), st.integers(1, 6))
def test_fingerprint(text, shingle):
    text = text.encode("utf-8", "ignore").decode()
    assert S.fingerprint(text, shingle) == plain(text, shingle)


def test_hard_rows_and_documents(hard, documents):
    for df in (hard, documents):
        got = S.simhash_components(df).select("doc_id", "fingerprint", "component_id")
        assert sorted(map(tuple, got.collect()), key=str) == brute(rows_of(df))


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def near(x, y):
    return ((x ^ y) & ((1 << 64) - 1)).bit_count()


def groups_of(fps, k):
    root = {x: x for x in fps}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in fps:
        for b in fps:
            if a < b and near(a, b) <= k:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {x: find(x) for x in fps}


def clusters(seed, groups, members, bits):
    rnd = random.Random(seed)
    fps = {0, signed((1 << 64) - 1)}
    for _ in range(groups):
        base, some = rnd.getrandbits(64), rnd.sample(range(64), bits)
        for _ in range(members):
            x = base
            for b in rnd.sample(some, rnd.randrange(0, bits)):
                x ^= 1 << b
            fps.add(signed(x))
    return sorted(fps)


@pytest.mark.parametrize("k", [0, 1, 2, 3, 4, 6, 7])
def test_groups_of_fingerprints(spark, k):
    for fps in (clusters(k, 30, 8, 7), clusters(k + 50, 4, 90, 9)):
        got = {r.fp: r.root for r in S.grouped(spark.createDataFrame([(x,) for x in fps], "fp long"), k).collect()}
        assert got == groups_of(fps, k)


@pytest.mark.parametrize("k", [2, 4])
def test_links_are_all_pairs_of_different_groups(spark, k):
    fps = clusters(k, 20, 12, 7)
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    pairs = {(r.a, r.b) for r in S.links(df.selectExpr("fp", "fp AS root"), k).collect()}
    assert pairs == {(a, b) for a in fps for b in fps if a < b and near(a, b) <= k}
    assert S.links(df.selectExpr("fp", "0L AS root"), k).count() == 0


def test_components(spark):
    rnd = random.Random(1)
    edges = [(k, k + 1) for k in range(100, 160)] + [(7, x) for x in range(200, 260)] + [(5, 5)] + [(rnd.randrange(1000, 1100), rnd.randrange(1000, 1100)) for _ in range(70)]
    root = {}

    def find(a):
        root.setdefault(a, a)
        while root[a] != a:
            a = root[a]
        return a

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = sorted(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == sorted((n, find(n)) for n in root)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert S.simhash_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
