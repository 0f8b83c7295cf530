import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from blkscope.llm import exact_dedup as E


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    out = []
    for x, ids in groups.items():
        keys = [i for i in ids if i is not None]
        keep = min(keys) if keys else None
        seen = set()
        for i in ids:
            out.append((i, keep, len(ids), i == keep and i not in seen, hashlib.sha256(x.encode()).hexdigest()))
            seen.add(i)
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_hard_rows(spark, hard):
    rows = [(r.doc_id, r.text) for r in hard.collect()]
    assert result(E.exact_dedup(hard)) == brute(rows)


def test_documents(documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    assert result(E.exact_dedup(documents)) == brute(rows)


def test_colliding_digests_are_told_apart(hard):
    rows = [(r.doc_id, r.text) for r in hard.collect()]
    weak = lambda c: F.substring(F.unhex(F.sha2(c, 256)), 1, 0)
    assert E.colliding(hard, digest=weak).count() == 1
    assert result(E.exact_dedup(hard, digest=weak)) == brute(rows)


def test_chunks_join_to_the_text(documents):
    bad = documents.select("text", F.array_join(E.chunks_of(F.col("text")), "").alias("again")).filter("text != again")
    assert bad.count() == 0


def test_keep_first_and_empty(hard):
    kept = E.keep_first(hard)
    assert sorted(kept.columns) == sorted(hard.columns)
    want = sorted((i for i, _, _, k, _ in brute([(r.doc_id, r.text) for r in hard.collect()]) if k), key=str)
    assert sorted((r.doc_id for r in kept.collect()), key=str) == want
    assert E.exact_dedup(hard.limit(0)).count() == 0
