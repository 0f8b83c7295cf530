"""Ranked lexical search: documents put in order by recursive graph bisection, and shards visited by bound until none can matter.

A bounded sample of documents is bisected recursively (Dhulipala et al., 2016:
pairs of documents swap halves while that makes their terms' lists cheaper to
write), which gives a tree whose nodes tell by a document's terms to which half
it belongs. Every document goes down the tree to its cluster; clusters are cut into
shards, and each shard's task bisects its own documents on to their final order. For
every shard and term the index holds the places in that order, the occurrences
and the best that a document there gets from the term. A query adds these up to a
bound for every shard, visits the shards from the highest bound down, some more
at each round, and stops where bounds fall below its k-th score so far.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks_for, text_of, tidy_map, tidy_pair, written

#: The tree is fitted on about so many documents, on so many terms of each (those of least hash), and knows so many terms, the most frequent ones.
SAMPLE_DOCS, SAMPLE_TERMS, VOCABULARY = 4096, 256, 8192
#: Clusters at most, documents of a shard, documents below which a list is not bisected, rounds of swaps.
CLUSTERS, SHARD_DOCS, LEAST, ROUNDS = 64, 2048, 32, 6
#: Shards that a query visits in its first round, and how many times more have been visited after each next one; queries that one task scores at a time.
FIRST, GROWTH, QUERY_BLOCK = 8, 8, 1024

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PLAIN = bytes((c if c > 127 or chr(c).isalnum() else 32) + (32 if 65 <= c <= 90 else 0) for c in range(256))


def terms_of(text: str) -> list[bytes]:
    """The terms of a text in order: letters and digits of ASCII, A-Z as a-z, and all characters beyond it."""
    return text.encode().translate(_PLAIN).split()


def query_terms(text: Column) -> Column:
    """The different terms of a text, as an expression."""
    return F.array_distinct(F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(TERM), F.lit(0)))


def _lists(starts: np.ndarray, terms: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The terms of some documents one after the other, and for each the place of its document among them."""
    sizes = starts[docs + 1] - starts[docs]
    owner = np.repeat(np.arange(len(docs)), sizes)
    return terms[np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts[docs], sizes)], owner


def _cost(n: int, d: np.ndarray) -> np.ndarray:
    return d * np.log2(n / (d + 1.0))


def halved(starts: np.ndarray, terms: np.ndarray, docs: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents in two halves: which are in the second; the terms, and for each what a document that has it costs more in the first half than in the second."""
    flat, owner = _lists(starts, terms, docs)
    names, flat = np.unique(flat, return_inverse=True)
    total = np.bincount(flat, minlength=len(names))
    second = np.arange(len(docs)) >= len(docs) // 2
    n = len(docs) - len(docs) // 2, len(docs) // 2
    n = n[1], n[0]
    for _ in range(rounds):
        in_b = second[owner]
        b = np.bincount(flat, weights=in_b, minlength=len(names))
        a = total - b
        now = _cost(n[0], a) + _cost(n[1], b)
        to_b = np.where(a > 0, now - _cost(n[0], np.maximum(a - 1, 0)) - _cost(n[1], b + 1), 0)
        to_a = np.where(b > 0, now - _cost(n[0], a + 1) - _cost(n[1], np.maximum(b - 1, 0)), 0)
        gain = np.bincount(owner, weights=np.where(in_b, to_a[flat], to_b[flat]), minlength=len(docs))
        one, two = np.flatnonzero(~second), np.flatnonzero(second)
        one, two = one[np.argsort(-gain[one], kind="stable")], two[np.argsort(-gain[two], kind="stable")]
        k = min(len(one), len(two))
        swaps = int((gain[one[:k]] + gain[two[:k]] > 1e-9).sum())
        if not swaps:
            break
        second[one[:swaps]], second[two[:swaps]] = True, False
    b = np.bincount(flat, weights=second[owner], minlength=len(names))
    a = total - b
    return second, names, (_cost(n[0], a + 1) - _cost(n[0], a)) - (_cost(n[1], b + 1) - _cost(n[1], b))


def bisected(starts: np.ndarray, terms: np.ndarray, least: int = LEAST, rounds: int = ROUNDS) -> np.ndarray:
    """The documents in their new order."""
    order, todo = np.arange(len(starts) - 1), [(0, len(starts) - 1)]
    while todo:
        lo, hi = todo.pop()
        if hi - lo <= least:
            continue
        docs = order[lo:hi]
        second, _, _ = halved(starts, terms, docs, rounds)
        order[lo:hi] = np.concatenate([docs[~second], docs[second]])
        mid = lo + int((~second).sum())
        todo += [(lo, mid), (mid, hi)]
    return order


@dataclass
class Tree:
    """Where a document belongs: at each node, a weight for each term known and the sum from which on it goes to the second half. levels 0: one cluster."""

    levels: int
    known: dict[bytes, int]
    weights: np.ndarray
    limits: np.ndarray

    def cluster(self, terms: Counter[bytes]) -> int:
        ids = [i for i in map(self.known.get, terms) if i is not None]
        node = 1
        for _ in range(self.levels):
            node = 2 * node + int(self.weights[node, ids].sum() > self.limits[node])
        return node - (1 << self.levels)


def fit_tree(docs: DataFrame, clusters: int, text: str = "text", sample: int = SAMPLE_DOCS) -> Tree:
    """A tree of so many clusters at most, from a sample that the driver holds: sample documents, SAMPLE_TERMS terms of each."""
    levels = max(0, int(clusters).bit_length() - 1)
    n = docs.count() if levels else 0
    if not n:
        return Tree(0, {}, np.zeros((1, 0), np.float32), np.zeros(1))
    share = min(1.0, 1.2 * sample / n)
    some = docs.filter(F.pmod(F.xxhash64(*docs.columns), F.lit(1 << 30)) < int(share * (1 << 30))).limit(sample).select(text_of(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [sorted(set(terms_of(x.as_py())), key=lambda t: (zlib.crc32(t), t))[:SAMPLE_TERMS] for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array((b" ".join(s) for s in sets), pa.binary())], names=["terms"])

    sets = [bytes(r["terms"]).split() for r in some.mapInArrow(tidy_map(run), "terms binary").collect()]
    levels = min(levels, max(0, (len(sets) // LEAST).bit_length() - 1))
    counts = Counter(t for s in sets for t in s)
    known = {t: i for i, (t, c) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:VOCABULARY]) if c > 1}
    lists = [[known[t] for t in s if t in known] for s in sets]
    starts = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
    terms = np.array([i for x in lists for i in x], np.int64)
    tree = Tree(levels, known, np.zeros((1 << levels, len(known)), np.float32), np.zeros(1 << levels))
    groups = {1: np.arange(len(lists))}
    for node in range(1, 1 << levels):
        group = groups.pop(node)
        if len(group) > 1:
            _, names, cost = halved(starts, terms, group)
            tree.weights[node, names] = cost
            flat, owner = _lists(starts, terms, group)
            sums = np.bincount(owner, weights=tree.weights[node, flat], minlength=len(group))
            tree.limits[node] = np.median(sums)
            second = sums > tree.limits[node]
        else:
            second = np.zeros(len(group), bool)
        groups[2 * node], groups[2 * node + 1] = group[~second], group[second]
    return tree


@dataclass
class Index:
    """lists: a row for each shard and term (term, df, best, places, tfs) and one for each shard (term null: places hold the documents' lengths, ids their keys)."""

    lists: DataFrame
    docs: int
    occurrences: int


def impact(tf: np.ndarray, n: np.ndarray, docs: int, occurrences: int) -> np.ndarray:
    """What a term adds to a score for each unit of its weight."""
    m = 50 + (50 * n * docs) // max(1, occurrences)
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


_LISTS = pa.schema([("shard", pa.int64()), ("term", pa.string()), ("df", pa.int64()), ("best", pa.int64()), ("places", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int32())), ("ids", pa.list_(pa.int64()))])
_LISTS_SQL = "shard long, term string, df long, best long, places array<int>, tfs array<int>, ids array<long>"


def _indexed(docs: int, occurrences: int) -> Callable[[pa.Table], pa.Table]:
    """The index rows of a shard."""

    def run(shard: pa.Table) -> pa.Table:
        expand = zstandard.ZstdDecompressor().decompress
        known: dict[bytes, int] = {}
        flat: list[int] = []
        counts: list[int] = []
        sizes = []
        for x in shard.column("packed"):
            terms, tfs = expand(x.as_py()).split(b"\n")
            words = terms.split()
            flat += [known.setdefault(t, len(known)) for t in words]
            counts += map(int, tfs.split())
            sizes.append(len(words))
        terms, tf = np.array(flat, np.int64), np.array(counts, np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        df = np.bincount(terms, minlength=len(known))
        # terms of one document, or of all, make no order better than another
        some = (df[terms] > 1) & (df[terms] < len(sizes))
        owner = np.repeat(np.arange(len(sizes)), sizes)
        order = bisected(np.concatenate([[0], np.cumsum(np.bincount(owner[some], minlength=len(sizes)))]).astype(np.int64), terms[some])
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        lengths = shard.column("n").to_numpy()
        best = np.zeros(len(known), np.int64)
        np.maximum.at(best, terms, impact(tf, lengths[owner], docs, occurrences))
        by = np.lexsort((place[owner], terms))
        ends = pa.array(np.concatenate([[0], np.cumsum(df)]), pa.int32())
        name = shard.column("shard")[0].as_py()
        k = len(known)
        rows = pa.table([
            pa.array(np.full(k, name), pa.int64()), pa.array([t.decode() for t in known], pa.string()), pa.array(df, pa.int64()), pa.array(best),
            pa.ListArray.from_arrays(ends, pa.array(place[owner][by], pa.int32())), pa.ListArray.from_arrays(ends, pa.array(tf[by], pa.int32())), pa.nulls(k, pa.list_(pa.int64())),
        ], schema=_LISTS)
        ids = shard.column("key").combine_chunks().take(pa.array(order)).to_pylist()
        own = pa.table([pa.array([name], pa.int64()), pa.nulls(1, pa.string()), pa.array([len(ids)], pa.int64()), pa.array([0], pa.int64()), pa.array([lengths[order].tolist()], pa.list_(pa.int32())), pa.nulls(1, pa.list_(pa.int32())), pa.array([ids], pa.list_(pa.int64()))], schema=_LISTS)
        return pa.concat_tables([rows.sort_by("term"), own])

    return run


def build(docs: DataFrame, key: str = "doc_id", text: str = "text", shard_docs: int = SHARD_DOCS, clusters: int = CLUSTERS, sample: int = SAMPLE_DOCS) -> Index:
    """The index of all documents; every row is a document of its own, null texts and those without a term have none. Keys are whole numbers or null.

    Texts are read twice, for the sample and for all; then only their different
    terms move. A cluster of any size, such as one of many copies, is cut into shards by row.
    """
    spark = docs.sparkSession
    tree = fit_tree(docs, min(clusters, 2 * blocks_for(docs.count(), shard_docs)), text, sample)
    rows = docs.select(F.col(key).cast("long").alias("key"), F.monotonically_increasing_id().alias("row"), text_of(text).alias("text"))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            found, sizes, packed = [], [], []
            for x in batch.column(2):
                words = terms_of(x.as_py())
                counts = Counter(words)
                found.append(tree.cluster(counts))
                sizes.append(len(words))
                packed.append(compress(b" ".join(counts) + b"\n" + b" ".join(b"%d" % c for c in counts.values())))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.int32()), pa.array(sizes, pa.int64()), pa.array(packed, pa.binary())], names=["key", "row", "cluster", "n", "packed"])

    routed = written(rows.mapInArrow(tidy_map(route), "key long, row long, cluster int, n long, packed binary"), "routed")
    sums = routed.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    parts = {r["cluster"]: blocks_for(r["rows"], shard_docs) for r in routed.groupBy("cluster").agg(F.count("*").alias("rows")).collect()}
    cut = F.create_map(*[F.lit(x) for pair in sorted(parts.items()) for x in pair])[F.col("cluster")] if parts else F.lit(1)
    rows = routed.withColumn("shard", F.col("cluster").cast("long") * (1 << 40) + F.pmod(F.xxhash64("row"), cut))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), sum(parts.values()))
    lists = rows.select("shard", "key", "n", "packed").repartition(tasks, "shard").groupBy("shard").applyInArrow(_indexed(sums[0], sums[1] or 0), _LISTS_SQL)
    return Index(written(lists, "index"), sums[0], sums[1] or 0)


def _scored(docs: int, occurrences: int, k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The k best documents of a shard for each query that visits it, less those below the query's k-th score so far."""

    def run(asked: pa.Table, lists: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if asked.num_rows and lists.num_rows:
            names = lists.column("term").to_pylist()
            own = names.index(None)
            n = lists.column("places")[own].values.to_numpy().astype(np.int64)
            ids = lists.column("ids")[own].values
            rank = ids.fill_null(np.iinfo(np.int64).max).to_numpy()  # documents without a key come last
            table: dict[str, tuple[np.ndarray, np.ndarray]] = {}
            queries: dict[int, list[tuple[str, int]]] = {}
            least: dict[int, int] = {}
            at = {t: i for i, t in enumerate(names)}
            for item, term, w, floor in zip(*(asked.column(c).to_pylist() for c in ("item", "term", "w", "floor"))):
                if term in at:
                    queries.setdefault(item, []).append((term, w))
                    least[item] = floor
            for item, terms in queries.items():
                score = np.zeros(len(n), np.int64)
                for term, w in terms:
                    if term not in table:
                        places = lists.column("places")[at[term]].values.to_numpy()
                        table[term] = places, impact(lists.column("tfs")[at[term]].values.to_numpy().astype(np.int64), n[places], docs, occurrences)
                    places, worth = table[term]
                    score[places] += w * worth
                good = np.flatnonzero(score >= max(1, least[item]))
                if len(good) > k:
                    good = good[score[good] >= np.partition(score[good], len(good) - k)[len(good) - k]]
                good = good[np.lexsort((rank[good], -score[good]))][:k]
                out[0].extend([item] * len(good))
                out[1].extend(ids.take(pa.array(good)).to_pylist())
                out[2].extend(score[good].tolist())
        return pa.table([pa.array(c, pa.int64()) for c in out], names=["item", "doc", "score"])

    return tidy_pair(run)


def search(index: Index, queries: DataFrame, k: int = 50, key: str = "item_id", text: str = "text", first: int = FIRST, growth: int = GROWTH) -> DataFrame:
    """(key, rank, doc_id, score): the k best documents of every query, scores above 0 only, equal ones by document, without a key last.

    Rows of one query key are one query, which has the terms of all of them once each; those without a key
    are left out. Whole keys only. An empty index or no queries: no rows.
    """
    spark = queries.sparkSession
    asked = written(queries.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("item"), F.explode(query_terms(text_of(text))).alias("term")).distinct(), "queries")
    wanted = written(asked.select("term").distinct(), "terms")
    hits = written(index.lists.filter("term IS NOT NULL").join(wanted, "term"), "hits")
    ratio = (F.lit(2.0 * index.docs + 2.0)) / (F.col("df") * 2.0 + 1.0)
    weights = hits.groupBy("term").agg(F.sum("df").alias("df")).select("term", F.floor(F.log(ratio) * 1000.0).cast("long").alias("w"))
    asked = written(asked.join(weights, "term"), "weighted")
    bounds = asked.join(hits.select("shard", "term", "best"), "term").groupBy("item", "shard").agg(F.sum(F.col("w") * F.col("best")).alias("bound"))
    bounds = written(bounds.filter("bound > 0"), "bounds")
    shards, items = bounds.agg(F.count_distinct("shard"), F.count_distinct("item")).first()
    visited, ends = first, []
    while visited < shards:
        ends.append(1 - visited / shards)
        visited *= growth
    cuts = bounds.groupBy(F.col("item").alias("i")).agg((F.percentile_approx("bound", ends, 10000) if ends else F.array().cast("array<bigint>")).alias("cuts"))
    plan = written(bounds.join(cuts, F.col("item") == F.col("i")).withColumn("turn", F.size(F.filter("cuts", lambda c: c > F.col("bound")))).select("item", "shard", "bound", "turn"), "plan")
    blocks = blocks_for(items, QUERY_BLOCK)
    lists = hits.unionByName(index.lists.filter("term IS NULL")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    top = spark.createDataFrame([], "item long, doc long, score long")
    place = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    for turn in range(len(ends) + 1):
        floor = top.groupBy(F.col("item").alias("i")).agg(F.when(F.count("*") >= k, F.min("score")).otherwise(1).alias("floor"))
        left = plan.filter(F.col("turn") >= turn).join(floor, F.col("item") == F.col("i"), "left").withColumn("floor", F.coalesce("floor", F.lit(1).cast("long"))).filter("bound >= floor")
        now = written(left.select("item", "shard", "floor", "turn"), "visits")
        if now.isEmpty():
            break
        now = now.filter(F.col("turn") == turn)
        pairs = now.join(asked, "item").withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int")).select("shard", "block", "item", "term", "w", "floor")
        there = lists.join(now.select("shard").distinct(), "shard", "left_semi")
        found = pairs.groupBy("shard", "block").cogroup(there.groupBy("shard", "block")).applyInArrow(_scored(index.docs, index.occurrences, k), "item long, doc long, score long")
        best = top.unionByName(found).withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)
        top = written(best.select("item", "doc", "score"), "top")
    ranked = top.withColumn("rank", F.row_number().over(place))
    return ranked.select(F.col("item").alias(key), "rank", F.col("doc").alias("doc_id"), "score")
