"""Near copies of a whole test table: exact similar pairs by prefix filtering, which loses none."""

import math
from collections import defaultdict

import corpus_pipeline as C
from blkscope.llm import simhash as S


def similar_pairs(rows):
    """Pairs of exact Jaccard similarity 0.8 or more: two such sets share one of their least hashes, of which each has a fifth and one more."""
    sets = [(i, sorted(set(S.shingles(t, C.SHINGLE).tolist()))) for i, t in rows]
    seen, met = defaultdict(list), set()
    for x, (_, g) in enumerate(sets):
        for h in g[: len(g) - math.ceil(0.8 * len(g)) + 1]:
            met.update((y, x) for y in seen[h])
            seen[h].append(x)
    for y, x in met:
        a, b = set(sets[y][1]), set(sets[x][1])
        if 10 * len(a & b) >= 8 * len(a | b):
            yield sets[y][0], sets[x][0]


def test_no_similar_pair_of_sf01_is_lost(spark):
    first = {}
    for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").collect():
        first.setdefault(" ".join((r["text"] or "").split()), r["doc_id"])
    rows = [(i, t) for t, i in first.items()]
    pairs = list(similar_pairs(rows))
    found = {r.doc_id: r.component_id for r in S.near_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), k=C.BITS, jaccard=C.JACCARD).collect()}
    assert len(pairs) > 40
    assert sum(found[a] == found[b] for a, b in pairs) >= 0.95 * len(pairs)
