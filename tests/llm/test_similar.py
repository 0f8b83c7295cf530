import random
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline as C
from blkscope.llm import simhash as S
from test_simhash import brute


def sets_of(rows):
    return [(i, set(S.shingles(t or "", C.SHINGLE).tolist())) for i, t in rows]


def similar(rows):
    """Pairs of rows of exact Jaccard similarity 0.8 or more, by comparing all."""
    s = sets_of(rows)
    for x, (i, a) in enumerate(s):
        for j, b in s[:x]:
            if min(len(a), len(b)) >= 0.8 * max(len(a), len(b), 1) and 10 * len(a & b) >= 8 * len(a | b):
                yield i, j


def expected(rows):
    """key to component over fingerprints of at most BITS bits and all similar pairs."""
    root = {i: c for i, _, c in brute(rows, C.SHINGLE, C.BITS)}
    for i, j in similar(rows):
        lo, hi = sorted((root[i], root[j]), key=lambda x: (x is None, x))
        root = {k: lo if c == hi else c for k, c in root.items()}
    return root


def got(df):
    return {r.doc_id: r.component_id for r in S.near_groups(df, k=C.BITS, jaccard=C.JACCARD).collect()}


def edited(seed, groups, copies, most):
    """Texts of which some are copies with words changed, in groups of different density, and lines that many share."""
    rnd = random.Random(seed)
    line = [f"line{k}" for k in range(40)]
    rows = []
    for g in range(groups):
        words = [f"w{rnd.randrange(3000)}" for _ in range(rnd.choice([3, 9, 60, 200, 400]))] + line * (g % 3 == 0)
        for _ in range(copies):
            w = list(words)
            for _ in range(rnd.randrange(0, max(1, len(w) // most))):
                w[rnd.randrange(len(w))] = f"x{rnd.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    rnd.shuffle(rows)
    return rows


def recall(rows, found):
    pairs = list(similar(rows))
    return sum(found[i] == found[j] for i, j in pairs), len(pairs)


def test_similar_pairs_are_found(spark):
    """All fingerprint links, at least 0.95 of the similar pairs, and no others."""
    texts = [t for case in [(1, 40, 3, 20), (2, 3, 40, 30), (3, 20, 4, 60), (4, 60, 2, 25)] for _, t in edited(*case)]
    rows = list(enumerate(texts))
    found, before, most = got(spark.createDataFrame(rows, "doc_id long, text string")), {i: c for i, _, c in brute(rows, C.SHINGLE, C.BITS)}, expected(rows)
    n, of = recall(rows, found)
    alone, _ = recall(rows, before)
    print("similar pairs", of, "found", n, "by fingerprints alone", alone)
    assert n >= 0.95 * of and n > alone
    assert all(found[i] == found[before[i]] and most[i] == most[found[i]] for i, _ in rows)


def test_similar_documents_are_found(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    found = got(spark.createDataFrame(rows, "doc_id long, text string"))
    n, of = recall(rows, found)
    print("similar pairs", of, "found", n)
    assert n >= 0.95 * of


def test_hard_rows(spark, hard):
    found = got(hard)
    assert set(found) == {r.doc_id for r in hard.collect()} and found == expected([(r.doc_id, r.text) for r in hard.collect()])
    assert S.near_groups(hard.limit(0), jaccard=C.JACCARD).count() == 0


def test_no_similar_pair_is_lost(spark):
    """Exactly the components of all pairs, also where many texts share their least hashes and a text between two is their only link."""
    rows = list(enumerate(t for case in [(11, 6, 30, 12), (12, 30, 4, 9), (13, 40, 2, 5)] for _, t in edited(*case)))
    rnd, shared = random.Random(3), [f"c{k}" for k in range(60)]
    for _ in range(60):  # far apart, with a large common part
        rows.append((len(rows), " ".join(shared + [f"y{rnd.randrange(10**6)}" for _ in range(40)])))
    want = expected(rows)
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == want


def test_hubs_before_pairs_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(S, "PAIRS", 0)
    rows = edited(21, 3, 40, 9)
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == expected(rows)


def apart(seed, n):
    """Near copies of one text, most of which are less similar than 0.8 to each other."""
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    rows = []
    for k in range(n):
        w = list(words)
        for at in rnd.sample(range(300), 4 if k % 10 == 0 else 12):
            w[at] = f"x{rnd.randrange(10**6)}"
        rows.append((k, " ".join(w)))
    return rows


def test_pairs_apart_stay_within_the_join(spark, monkeypatch):
    """A group of texts apart that all share hashes: the right components, and few pairs go on to be compared."""
    asked, similar_of = [], S._similar

    def counted(docs, pairs, *a):
        asked.append(pairs.count())
        return similar_of(docs, pairs, *a)

    monkeypatch.setattr(S, "_similar", counted)
    rows = apart(5, 120)
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == expected(rows)
    assert asked[-1] < 20 * len(rows) < len(rows) * (len(rows) - 1) / 2 - len(list(similar(rows)))


def test_sketches_never_part_similar_sets():
    import numpy as np

    rnd = np.random.default_rng(1)
    for n in (0, 1, 5, 300, 5000):
        a = rnd.integers(-(2**63), 2**63, n)
        for change in (0, 1, n // 10, n // 3, n):
            b = np.unique(np.concatenate([a[change:], rnd.integers(-(2**63), 2**63, change)]))
            differ = len(np.setxor1d(a, b))
            assert sum(int(x).bit_count() for x in (S.parities(np.unique(a)) ^ S.parities(b)).view(np.uint64)) <= differ


def test_a_pair_leaves_the_join_a_few_times(spark):
    """Texts that share most of their hashes: every similar pair comes out, not once for each hash."""
    rnd, words = random.Random(8), [f"w{k}" for k in range(300)]
    rows = [(k, " ".join(w if rnd.random() > 0.01 else f"x{k}" for w in words)) for k in range(30)]
    sets = S.shingle_sets(spark.createDataFrame(rows, "doc_id long, text string"), shingle=C.SHINGLE, jaccard=C.JACCARD).cache()
    key = {r.doc: r.key for r in sets.collect()}
    many = S.sharing(sets).select("gram", "doc", "n", F.col("doc").alias("root"))
    shares = Counter(r.gram for r in many.collect())
    met = Counter(frozenset((key[r.doc], key[r.rdoc])) for r in S._pairs_of_many(many, sets.select("doc", "sketch"), C.JACCARD).collect())
    assert {frozenset(p) for p in similar(rows)} <= met.keys()
    assert sum(met.values()) < 2 * S.COMMON * len(met) < sum(n * (n - 1) / 2 for n in shares.values()) / 4


def test_few_stages(spark):
    """Each stage costs tasks, log and small files on many partitions, so a run has a bounded number of them."""
    spark.sparkContext.setJobGroup("near", "near")
    got(spark.createDataFrame(apart(6, 60), "doc_id long, text string"))
    tracker = spark.sparkContext.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup("near") for s in tracker.getJobInfo(j).stageIds if (i := tracker.getStageInfo(s)) and i.numCompletedTasks}
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    print("stages", len(stages))
    assert 0 < len(stages) <= 125
