import math
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from blkscope.llm import quality as Q


def brute_model(texts):
    """Interpolated modified Kneser-Ney in plain dictionaries: n-gram to probability."""
    level = Counter()
    for t in texts:
        level.update(Q.grams(t))
    levels = []
    for _ in range(Q.ORDER):
        levels.append(level)
        level = Counter(g[1:] for g in level)
    even = 1 / (len(levels[-1]) + 1)

    def discounts(c):
        n = Counter(c.values())
        if not n[1] or not n[2]:
            return 0.5, 1.0, 1.5
        y = n[1] / (n[1] + 2 * n[2])
        raw = (1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3] if n[3] else 1.5)
        return [min(max(d, 0.05), k + 0.95) for k, d in enumerate(raw)]

    ds = [discounts(c) for c in levels]
    contexts = []
    for c, d in zip(levels, ds):
        at = defaultdict(lambda: [0, 0.0])
        for g, n in c.items():
            at[g[:-1]][0] += n
            at[g[:-1]][1] += d[min(n, 3) - 1]
        contexts.append(at)

    def p(g, k=0):
        lower = p(g[1:], k + 1) if k < Q.ORDER - 1 else even
        if g[:-1] not in contexts[k]:
            return lower
        total, rest = contexts[k][g[:-1]]
        n = levels[k].get(g, 0)
        return max(n - ds[k][min(n, 3) - 1], 0) / total + rest / total * lower if n else rest / total * lower

    return p


def labels_for(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_probabilities_and_perplexities(spark, documents):
    docs = documents.filter("doc_id < 60")
    labels = labels_for(spark, [(k, int(k % 3 > 0), 0) for k in range(50)])
    rows = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r for r in Q.perplexities(docs, labels, block_bytes=20_000).collect()}
    p = brute_model([rows[k] for k, r in got.items() if r.role == "train"])
    assert {r.role for r in got.values()} == {"train", "hold", None}
    assert set(got) == set(rows)
    for k, t in rows.items():
        own = Q.grams(t)
        nll = -sum(math.log(p(g)) for g in own)
        assert got[k].n_units == len(own) and (got[k].role is not None) == (k < 50 and k % 3 > 0)
        assert math.isclose(got[k].nll, nll, rel_tol=1e-8)


def test_a_context_sums_to_one(spark):
    texts = ["the cat sat on the mat.", "the dog sat.", "a cat, a dog"] * 3
    rows = [(g, n) for g, n in Counter(g for t in texts for g in Q.grams(t)).items()]
    counts = Q.all_counts(spark.createDataFrame(rows, "gram string, n long"))
    letters = [r.gram for r in counts.filter("length(gram) = 1").collect()]
    every = spark.createDataFrame([("the" + x,) for x in [*letters, "\U0001f600"]], "gram string")
    total = Q.log_probabilities(counts, every).agg(F.sum(F.exp("logp"))).first()[0]
    assert math.isclose(total, 1.0, rel_tol=1e-9)


def test_numbers_tell_all_ngrams_apart(monkeypatch):
    import random

    rnd = random.Random(3)
    few = ["".join(rnd.choice("ab c") for _ in range(n)) for n in (0, 1, 2, 50, 3000)]
    many = ["".join(chr(rnd.randrange(0x20000, 0x2FFFF)) for _ in range(n)) for n in (50000, 90000, 100000)]
    astral = ["".join(chr(rnd.choice((0x41, 0x1F600, 0x10FFFF)) - rnd.randrange(9)) for _ in range(3000))]
    for piece in (1 << 20, 3000):
        monkeypatch.setattr(Q, "PIECE", piece)
        for texts in (few, many + few, astral, [], [""]):
            made = Q.Numbered([Q.units(t) for t in texts])
            distinct = made.distinct()
            want = [g for t in texts for g in Q.grams(t)]
            strings = made.strings(distinct)
            assert sorted(strings) == sorted(set(want)) and (len(many + few) != len(texts) or made._front is not None)
            if want:
                at = np.concatenate(list(made.places(distinct)))[~made.spans()]
                assert [strings[k] for k in at] == want
                n, total = made.sums(distinct, np.ones(len(distinct)))
                flags = np.arange(len(texts)) % 2 == 0
                some = Counter(g for t, f in zip(texts, flags) if f for g in Q.grams(t))
                assert {g: c for g, c in zip(strings, made.counts(distinct, flags).tolist()) if c} == some
                assert n.tolist() == total.tolist() == [len(Q.grams(t)) for t in texts]


def test_scrambled_spelling_in_another_script(spark):
    """Trained on clean Russian-like words; the same letters in random order are rejected, held out clean texts are not."""
    import random

    rnd = random.Random(5)
    parts = "ста про на ре мен ция ость во до ли ко ра ди те ный ска по го ло ве".split()
    words = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 4))) for _ in range(400)]
    clean = [" ".join(rnd.choice(words) for _ in range(120)) + "." for _ in range(560)]
    letters = sorted({c for w in words for c in w})
    junk = [" ".join("".join(rnd.choice(letters) for _ in w) for w in t.split()) for t in clean[:40]]
    docs = spark.createDataFrame([(k, t, "ru") for k, t in enumerate(clean + junk)], "doc_id long, text string, lang string")
    keep = {r.doc_id: r.keep for r in Q.quality(docs, labels_for(spark, [(k, 1, 0) for k in range(500)])).collect()}
    assert sum(keep[k] for k in range(560, 600)) == 0
    assert sum(keep[k] for k in range(500, 560)) >= 57


def test_held_out_documents(spark):
    """Trained on the labels of even documents, held against those of the odd ones."""
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    judged = Q.quality(docs, labels.filter("doc_id % 2 = 0"))
    found = {(r["quality"], r["keep"]): r["n"] for r in judged.join(labels.filter("doc_id % 2 = 1"), "doc_id").groupBy("quality", "keep").agg(F.count("*").alias("n")).collect()}
    clean, junk = sum(n for (q, _), n in found.items() if q == 1), sum(n for (q, _), n in found.items() if q == 0)
    assert found.get((1, False), 0) <= 0.02 * clean
    assert found.get((0, False), 0) >= 0.8 * junk


def test_hard_rows(spark, hard, documents):
    labels = labels_for(spark, [(1, 1, 0), (5, 1, 0), (5, 1, 0), (6, None, 1), (None, 1, 0), (8, 0, 0)])
    got = sorted(((r.doc_id, r.n_units > 0, r.keep) for r in Q.quality(hard.withColumn("lang", F.when(F.col("doc_id") != 10, F.col("lang"))), labels).collect()), key=str)
    assert len(got) == hard.count()
    assert [(i, k) for i, _, k in got if i in (2, 3, 4)] == [(2, False), (3, False), (4, False)]
    assert all(k for i, _, k in got if i in (1, 5))
    none = Q.quality(hard, labels.limit(0)).collect()
    assert sum(r.keep for r in none) == sum(r.n_units > 0 for r in none) and len(none) == hard.count()
    assert Q.quality(hard.limit(0), labels).count() == 0
