import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from blkscope.llm import lexical as X
from blkscope.llm.queries import QUERIES


def terms(text):
    return re.findall(X.TERM, (text or "").translate(str.maketrans(X.UPPER, X.LOWER)))


def brute(docs, items, k=50):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    size = [sum(c.values()) for _, c in counts]
    n, total = sum(1 for x in size if x), sum(size)
    lists, asked = defaultdict(list), defaultdict(set)
    for j, (_, c) in enumerate(counts):
        for t, f in c.items():
            lists[t].append((j, f))
    for i, t in items:
        if i is not None:
            asked[i] |= set(terms(t))
    out = []
    for i, ts in asked.items():
        score = Counter()
        for t in ts & set(lists):
            w = math.floor(1000 * math.log((2 * n + 2) / (2 * len(lists[t]) + 1)))
            for j, f in lists[t]:
                score[j] += w * ((1000000000 * f) // (1000 * f + 20 * (50 + (50 * size[j] * n) // total)))
        best = sorted((-s, counts[j][0] is None, counts[j][0] or 0) for j, s in score.items() if s > 0)[:k]
        out += [(i, r + 1, None if none else d, -s) for r, (s, none, d) in enumerate(best)]
    return sorted(out, key=str)


def found(spark, docs, items, k=50, **more):
    index = X.build(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), **more)
    return sorted(map(tuple, X.search(index, spark.createDataFrame(items, "item_id long, text string"), k).collect()), key=str)


def corpus(seed, n=400):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["Été", "ÄB", "x_y", "don't", "가나"]
    topic = [rnd.sample(words, 40) for _ in range(6)]
    docs = [(i, " ".join(rnd.choice(rnd.choice(topic) if rnd.random() < 0.2 else topic[i % 6]) for _ in range(rnd.choice([1, 8, 30, 120])))) for i in range(n)]
    docs += [(1000 + i, "the same copy of a text W1 w2") for i in range(120)]
    docs += [(2000, None), (2001, ""), (2002, " -- "), (None, "w1 w2 w3"), (5, "w1 w2 w3"), (5, "w1 w2 w3"), (3000, "w7 " * 20000)]
    items = [(i, " ".join(rnd.choice(words).upper() for _ in range(rnd.choice([1, 5, 20])))) for i in range(25)]
    items += [(100, None), (101, "unheard"), (None, "w1"), (102, "w1"), (102, "copy"), (103, "copy of the same text"), (103, "copy of the same text")]
    return docs, items


@pytest.mark.parametrize("shard_docs", [7, 60, 5000])
def test_against_brute_force(spark, shard_docs):
    docs, items = corpus(shard_docs)
    assert found(spark, docs, items, shard_docs=shard_docs, sample=300) == brute(docs, items)


def test_ties_go_by_document_over_shards(spark):
    docs = [(i, "copy w1") for i in range(200, 0, -1)]
    got = found(spark, docs, [(1, "copy"), (2, "w1 copy")], k=10, shard_docs=9)
    assert got == brute(docs, [(1, "copy"), (2, "w1 copy")], 10)


def test_no_documents_or_items(spark):
    assert found(spark, [], [(1, "x")]) == []
    assert found(spark, [(1, "x")], []) == []
    assert found(spark, [(1, None)], [(1, "x")]) == []


def test_hard_rows_with_clashing_names(spark, hard):
    items = spark.createDataFrame([(1, "one two three the same"), (2, "ünï é the")], "item_id long, text string")
    got = sorted(map(tuple, X.search(X.build(hard), items).collect()), key=str)
    assert got == brute([(r["doc_id"], r["text"]) for r in hard.collect()], [tuple(r) for r in items.collect()])


def test_every_row_is_indexed_once_and_order_maps_back(spark):
    docs, _ = corpus(1)
    index = X.build(spark.createDataFrame(docs, "doc_id long, text string"), shard_docs=50)
    own = index.lists.filter("term IS NULL").collect()
    assert sorted((i for r in own for i in r["ids"]), key=str) == sorted((d[0] for d in docs), key=str)
    assert max(len(r["ids"]) for r in own) < 130
    pairs = [(i, n) for r in own for i, n in zip(r["ids"], r["places"])]
    assert sorted(pairs, key=str) == sorted(((i, len(terms(t))) for i, t in docs), key=str)


def test_bisection_puts_like_documents_together():
    rnd = random.Random(2)
    lists = [[(40 if i % 2 else 0) + rnd.randrange(40) for _ in range(12)] for i in range(256)]
    starts = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    order = X.bisected(starts, np.array([t for x in lists for t in x]), least=16)
    assert sorted(order) == list(range(256))
    halves = [sum(int(d) % 2 for d in order[a : a + 128]) for a in (0, 128)]
    assert min(halves) <= 8 and max(halves) >= 120


def test_bounds_leave_shards_out(spark, monkeypatch):
    """A query on one topic does not visit the shards of others once it has enough."""
    rnd = random.Random(4)
    docs = [(i, " ".join([f"t{i % 8}x{rnd.randrange(30)}" for _ in range(20)] + ["common"] * (i % 3))) for i in range(1600)]
    items = [(i, f"t{i}x1 t{i}x2 t{i}x3 common") for i in range(8)]
    index = X.build(spark.createDataFrame(docs, "doc_id long, text string"), shard_docs=40, sample=1600)
    visited = []
    plain = X.written

    def seen(df, name):
        out = plain(df, name)
        if name == "visits":
            visited.append([tuple(r) for r in out.select("item", "shard", "turn").collect()])
        return out

    monkeypatch.setattr(X, "written", seen)
    got = sorted(map(tuple, X.search(index, spark.createDataFrame(items, "item_id long, text string"), 5, first=4, growth=2).collect()), key=str)
    assert got == brute(docs, items, 5)
    done = {(i, s) for turn, rows in enumerate(visited) for i, s, t in rows if t == turn}
    shards = index.lists.select("shard").distinct().count()
    assert shards >= 40
    assert len(done) < 0.5 * shards * len(items)


def test_registered_query_types(spark):
    got = QUERIES["op13_lexical"](spark, "/root/testdata/sf0.001")
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
