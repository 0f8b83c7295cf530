"""SimHash near-duplicates through one-wildcard segment variants.

Fingerprints that differ in at most k bits are cut into k // 2 + 1 segments, of
which one then differs in at most one bit. Every fingerprint is indexed under
each segment with each of its bits in turn wild; an equality join on these
variants finds all links, and the exact distance confirms them.

Texts of a high Jaccard similarity often differ in more bits than that. near_groups
links all of those too, by prefixes of their sets of shingles: see shingle_sets and similar_groups.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scratch, sealed, text_of, tidy_map, written
from .components import roots

BITS, SEED = 64, 42


def shingles(text: str, shingle: int) -> np.ndarray:
    """The XXH64 of each run of shingle words, or of all words if they are fewer; no words: none."""
    joined = b" ".join(text.encode("utf-8", "replace").lower().split())
    if not joined:
        return np.zeros(0, dtype="<u8")
    ends = np.append(np.flatnonzero(np.frombuffer(joined, dtype=np.uint8) == 32), len(joined))
    n = max(1, len(ends) - shingle + 1)
    starts, stops = np.concatenate(([0], ends[: n - 1] + 1)), ends[-n:]
    out = np.empty(n, dtype="<u8")
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, 65536):
        places = zip(starts[at : at + 65536].tolist(), stops[at : at + 65536].tolist())
        out[at : at + 65536] = [digest(joined[a:b], SEED) for a, b in places]
    return out


def majority(hashes: np.ndarray) -> int:
    """Bit set if it is set in over half of the hashes; without any: zero."""
    n = len(hashes)
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, 65536):
        part = hashes[at : at + 65536].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > n, bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprint(text: str, shingle: int) -> int:
    """The majority of the shingles' hashes; no words: zero."""
    return majority(shingles(text, shingle))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4) -> DataFrame:
    """(key, fp): the fingerprint as a signed long. Null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.fromiter((fingerprint(x.as_py(), shingle) for x in batch.column(1)), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], names=["key", "fp"])

    pairs = docs.select(F.col(key).alias("key"), text_of(text).alias("text"))
    return pairs.mapInArrow(tidy_map(run), f"key {dict(pairs.dtypes)['key']}, fp long")


def _segments(k: int) -> list[tuple[int, int]]:
    """(first bit, bits) of each segment."""
    m = k // 2 + 1
    edges = [BITS * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def variants_of(fps: DataFrame, k: int) -> DataFrame:
    """fps with a row for each one-wildcard variant of each segment: seg, wild (the bit that is wild) and value (the segment's other bits)."""
    variants = []
    for s, (a, n) in enumerate(_segments(k)):
        for i in range(a, a + n):
            value = F.col("fp").bitwiseAND(F.lit(_signed(((1 << n) - 1) << a & ~(1 << i))))
            variants.append(F.struct(F.lit(s).cast("byte").alias("seg"), F.lit(i).cast("byte").alias("wild"), value.alias("value")))
    return fps.select("*", F.explode(F.array(*variants)).alias("v")).select(*fps.columns, "v.seg", "v.wild", "v.value")


def _distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _once(a: str, b: str, wild: str, k: int) -> Column:
    """Of the variants that two fingerprints share: whether this is the one of the first segment that differs in at most one bit, with that bit wild (the segment's first if none differs)."""
    x, ways, before = f"({a} ^ {b})", [], ""
    for first, n in _segments(k):
        part = f"{x} & {_signed(((1 << n) - 1) << first)}L"
        ways.append(f"({wild} BETWEEN {first} AND {first + n - 1}{before} AND (bit_get({x}, {wild}) = 1 OR ({wild} = {first} AND ({part}) = 0)))")
        before += f" AND bit_count({part}) > 1"
    return F.expr(" OR ".join(ways))


def links(groups: DataFrame, k: int) -> DataFrame:
    """(a, b), a < b: different roots of (fp, root) that fingerprints at no more than k differing bits connect.

    Each two fingerprints give at most one row, those of two roots may give
    several. Candidates are compared inside the join, and only links leave it.
    """
    # dealt out once: both sides of the join read one exchange, as long as no condition is on one side's wild alone
    index = variants_of(groups, k).drop("seg").repartition(int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions")), "wild", "value")
    other = index.select(F.col("wild").alias("w"), F.col("value").alias("v"), F.col("fp").alias("other"), F.col("root").alias("rroot"))
    met = (F.col("wild") == F.col("w")) & (F.col("value") == F.col("v")) & (F.col("root") < F.col("rroot")) & (_distance("fp", "other") <= k) & _once("fp", "other", "greatest(wild, w)", k)
    # the variants are many times what Spark takes their size for, so it must not choose to broadcast them
    return index.hint("merge").join(other, met).select(F.col("root").alias("a"), F.col("rroot").alias("b"))


def star_links(fps: DataFrame, k: int) -> DataFrame:
    """(a, b): each fingerprint with the hub of those that share a whole segment with it, where they differ in at most k bits.

    The hub is the one that is nearest to the majority of each of their bits:
    copies of one text with some words changed lie around that text.
    """
    parts = F.array(*[F.struct(F.lit(s).cast("byte").alias("seg"), F.col("fp").bitwiseAND(F.lit(_signed(((1 << n) - 1) << a))).alias("value")) for s, (a, n) in enumerate(_segments(k))])
    index = fps.select("fp", F.explode(parts).alias("p")).select("fp", "p.seg", "p.value")
    bits = [F.sum(F.expr(f"CAST(bit_get(fp, {i}) AS LONG)")).alias(f"bit{i}") for i in range(BITS)]
    # the 64 sums of a segment only where several have it
    several = index.groupBy("seg", "value").agg(F.count("*").alias("c")).filter("c > 1").select("seg", "value")
    index = written(index.join(several.hint("merge"), ["seg", "value"], "left_semi"), "several")
    sums = index.groupBy("seg", "value").agg(F.count("*").alias("n"), *bits)
    centre = F.expr(" | ".join(f"IF(bit{i} * 2 > n, {_signed(1 << i)}L, 0L)" for i in range(BITS)))
    centres = written(sums.select("seg", "value", centre.alias("centre")), "centres")
    # apart, so that the join can split a large segment and the least are taken before they move
    members = written(index.join(centres.hint("merge"), ["seg", "value"]).select("seg", "value", "fp", _distance("fp", "centre").alias("far")), "members")
    hubs = members.groupBy("seg", "value").agg(F.min(F.struct("far", "fp")).alias("hub")).select("seg", "value", F.col("hub.fp").alias("hub"))
    met = members.join(hubs.hint("merge"), ["seg", "value"])
    return met.filter((F.col("fp") != F.col("hub")) & (_distance("fp", "hub") <= k)).select(F.col("fp").alias("a"), F.col("hub").alias("b"))


def _merged(now: DataFrame, edges: DataFrame, keep: list[str]) -> DataFrame:
    """(fp, root) of now once edges (a, b) between its roots are followed; kept by the scratch whose list this is."""
    found = roots(edges).select(F.col("node").alias("old"), F.col("root").alias("new"))
    return sealed(now.join(found, F.col("root") == F.col("old"), "left").select("fp", F.coalesce("new", "root").alias("root")), "groups", keep)


def grouped(fps: DataFrame, k: int) -> DataFrame:
    """(fp, root): equal roots for fingerprints that links of at most k differing bits connect, directly or over others.

    First each fingerprint is linked to the hub of each of its segments, which
    puts most of a dense group together by a few rows for each of its members;
    then all pairs whose groups still differ are found by
    the variants. The pairs within a group, which grow with its square, never
    leave the join.
    """
    with scratch(fps.sparkSession) as keep:
        now = _merged(fps.select("fp", F.col("fp").alias("root")), star_links(fps, k), keep)
        return _merged(now, links(now, k), keep)


#: Texts looked at for shingles that many share, and in how many of these one must be for it.
SAMPLE, OFTEN = 4096, 3
#: Hashes that prefixes of similar sets have in common at least (or all that they share, if fewer).
COMMON = 4
#: Longs of a set's parity sketch.
SKETCH = 16
#: Rows of a hash that more than FEW texts have carry sketches, so that only texts that may be similar leave their join.
FEW = 8
#: Rows meet hubs in one round at least, and in so many at most while there are more pairs over such hashes than PAIRS for each row.
PAIRS, ROUNDS = 1, 4
#: Hubs of a hash are dealt anew by so many classes of hashes: a text meets that many of its group, by one row for each of its hashes.
HUBS = 8
#: Least hashes of a text by which its pairs leave a join COMMON times, not for each hash that they share.
FIRST = 12


def parities(grams: np.ndarray) -> np.ndarray:
    """SKETCH longs whose bit b is set if an odd number of the hashes end in b: two sets differ in as many hashes as their sketches in bits, or more."""
    odd = np.bincount(grams.view(np.uint64) % np.uint64(64 * SKETCH), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def common_shingles(docs: DataFrame, text: str, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of shingles that many texts have, in order, and in how many of some SAMPLE texts each is: what sets put last. Only speed depends on it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                own = [np.unique(shingles(x.as_py(), shingle).view(np.int64)) for x in batch.column(0).slice(at, 1000)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own))], names=["gram"])

    every = max(1, docs.count() // SAMPLE)
    some = docs.select(text_of(text).alias("text")).filter(F.pmod(F.xxhash64("text"), F.lit(every)) == 0)
    often = some.mapInArrow(tidy_map(run), "gram long").groupBy("gram").agg(F.count("*").alias("c")).filter(F.col("c") >= OFTEN).toArrow().sort_by("gram")
    return often["gram"].to_numpy(), often["c"].to_numpy()


def shingle_sets(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, jaccard: float = 0.8) -> DataFrame:
    """(key, sha, doc, fp, n, prefix, sketch): the SHA-256 of the text, a hash of it, the fingerprint, the number of different shingles, so many of their hashes that two sets of similarity jaccard share COMMON of them, and the parities of all.

    Sets of similarity jaccard share at least jaccard * n hashes of either, so
    in any order that all sets keep COMMON of the first n - jaccard * n + COMMON are common (all, where they share fewer).
    Here shingles that many texts have come last, else the order is that of the hashes.
    """
    often, counts = common_shingles(docs, text, shingle)

    def first(grams: np.ndarray) -> np.ndarray:
        if not len(grams):
            return grams
        most = len(grams) - math.ceil(jaccard * len(grams) - 1e-9) + COMMON
        if not len(often):
            return grams[:most]
        at = np.minimum(np.searchsorted(often, grams), len(often) - 1)
        return grams[np.argsort(np.where(often[at] == grams, counts[at], 0), kind="stable")[:most]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                hashes = [shingles(x.as_py(), shingle) for x in part.column(3)]
                fps = np.fromiter((majority(h) for h in hashes), dtype=np.uint64, count=len(hashes))
                sets = [np.unique(h.view(np.int64)) for h in hashes]
                prefixes = [first(x) for x in sets]
                ends = np.cumsum([0, *map(len, prefixes)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(prefixes).astype(np.int64)))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(fps.view(np.int64)), pa.array([len(x) for x in sets], pa.int32()), lists, pa.array([parities(x) for x in sets], pa.list_(pa.int64()))], names=["key", "sha", "doc", "fp", "n", "prefix", "sketch"])

    pairs = docs.select(F.col(key).alias("key"), F.sha2(text_of(text), 256).alias("sha"), F.xxhash64(text_of(text)).alias("doc"), text_of(text).alias("text"))
    return pairs.mapInArrow(tidy_map(run), f"key {dict(pairs.dtypes)['key']}, sha string, doc long, fp long, n int, prefix array<long>, sketch array<long>")


def sharing(sets: DataFrame) -> DataFrame:
    """(gram, doc, fp, n): the hashes of prefixes that different texts have, once for each text."""
    partitions = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # two numbers a row move; both sides read one exchange
    rows = sets.select(F.explode("prefix").alias("gram"), "doc").repartition(partitions, "gram")
    many = rows.groupBy("gram").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).filter("low < high").select("gram")
    some = written(rows.join(many.hint("merge"), "gram").distinct(), "many")
    return some.join(sets.select("doc", "fp", "n").distinct(), "doc").select("gram", "doc", "fp", "n")


def _other(rows: DataFrame) -> DataFrame:
    return rows.select(*[F.col(c).alias(f"r{c}") for c in rows.columns])


def _lengths(jaccard: float) -> Column:
    """Whether sets of n and rn hashes may have the similarity."""
    return F.least("n", "rn") >= F.greatest("n", "rn") * jaccard - 1e-9


def _near(jaccard: float) -> Column:
    """Whether sets of n and rn hashes may have it by their sketches s0, s1, ... and rs0, rs1, ...: they differ in no more hashes than it allows."""
    apart = " + ".join(f"bit_count(s{i} ^ rs{i})" for i in range(SKETCH))
    return F.expr(apart) <= (F.col("n") + F.col("rn")) * ((1 - jaccard) / (1 + jaccard)) + 1e-9


def _sketched(rows: DataFrame, sketches: DataFrame, *more: str) -> DataFrame:
    """rows with the sketch of doc in columns s0, s1, ..., and more of sketches."""
    return rows.join(sketches, "doc").select(*rows.columns, *more, *[F.col("sketch")[i].alias(f"s{i}") for i in range(SKETCH)])


def _pairs_of_many(many: DataFrame, sketches: DataFrame, jaccard: float) -> DataFrame:
    """(doc, root, n, rdoc, rroot, rn): pairs of texts of many (gram, doc, n, root) that share a gram, are of different roots and may be similar by their sketches.

    A pair gives a row for each of the COMMON least grams that both have, and for
    another one only where fewer than COMMON below it are among the FIRST of both texts.
    """
    first = many.groupBy("doc").agg(F.slice(F.sort_array(F.collect_list("gram")), 1, FIRST).alias("first"))
    own = written(sketches.join(first, "doc").select("doc", "sketch", "first"), "first")
    rows = _sketched(many, own, "first")
    before = F.coalesce(F.get(F.sort_array(F.array_intersect("first", "rfirst")), F.lit(COMMON - 1)) < F.col("gram"), F.lit(False))
    met = (F.col("gram") == F.col("rgram")) & (F.col("root") < F.col("rroot")) & _lengths(jaccard) & _near(jaccard) & ~before
    return rows.hint("merge").join(_other(rows), met).select("doc", "root", "n", "rdoc", "rroot", "rn")


def _pairs_with_hubs(many: DataFrame, k: int, jaccard: float) -> DataFrame:
    """(doc, root, n, rdoc, rroot, rn): texts of many (gram, doc, n, root) with hubs that share a gram, in round k.

    The text with the fewest hashes of its own lies in the middle of its group:
    texts that are similar to another of it mostly are to this one. The other
    hub is any of those with the gram, the same one for grams of a class.
    """
    own = many.groupBy("doc").agg((-F.count("*") / F.max("n")).alias("own"))
    kind = F.pmod("gram", F.lit(HUBS))
    middle, any_one = (F.struct(*first, F.xxhash64("doc", F.lit(k), of).alias("h"), "doc", "n", "root") for first, of in (([F.col("own")], F.lit(0)), ([], kind)))
    ends = many.join(own, "doc").groupBy("gram").agg(F.min(middle).alias("x"), F.min(any_one).alias("y"))
    both = F.array_distinct(F.array(*[F.struct(*[F.col(f"{e}.{c}").alias(c) for c in ("doc", "n", "root")]) for e in ("x", "y")]))
    ends = ends.select("gram", F.explode(both).alias("e")).select("gram", "e.doc", "e.n", "e.root")
    met = (F.col("gram") == F.col("rgram")) & (F.col("root") != F.col("rroot")) & _lengths(jaccard)
    return many.hint("merge").join(_other(ends), met).select("doc", "root", "n", "rdoc", "rroot", "rn")


def similar_groups(docs: DataFrame, shared: DataFrame, fps: DataFrame, sketches: DataFrame, bits: int, jaccard: float, text: str = "text", shingle: int = 5) -> DataFrame:
    """(fp, root): grouped by fingerprints (see there), and with all sets of exact Jaccard similarity jaccard or more connected; shared is sharing of their sets, sketches their (doc, sketch).

    Every two texts of different groups that share COMMON hashes of their prefixes are
    compared. Pairs over hashes that few texts have grow with these rows. Over
    others they grow with the square of a group's size, so they are told apart inside the
    join, by sketches that never part similar sets. Before, texts are
    compared with hubs that share a hash, which brings most of a group of similar
    texts together by a few rows for each text; pairs within a group never come up.
    """
    now, last = fps.select("fp", F.col("fp").alias("root")), math.inf
    of = ["doc", "root", "n", "rdoc", "rroot", "rn"]
    for k in range(ROUNDS + 1):
        with scratch(fps.sparkSession) as keep:
            rows = written(shared.join(now, "fp").select("gram", "doc", "n", "root"), "sharing")
            mixed = rows.groupBy("gram").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("c")).filter("low < high").select("gram", "c")
            rows = written(rows.join(mixed, "gram"), "mixed")
            n, pairs = rows.agg(F.count("*"), F.sum(F.when(F.col("c") > FEW, F.col("c") - 1).otherwise(0)) / 2).first()
            # hubs are of no more use once most pairs are of texts apart
            exact = k > 0 and (not n or k == ROUNDS or pairs <= PAIRS * n or pairs > last / 2)
            last = pairs
            few, many = (rows.filter(f"c {than} {FEW}").drop("c") for than in ("<=", ">"))
            if exact:
                edges = links(now, bits)
                if n:
                    met = few.hint("merge").join(_other(few), (F.col("gram") == F.col("rgram")) & (F.col("root") < F.col("rroot")) & _lengths(jaccard))
                    least = F.least(F.lit(COMMON), F.ceil(F.max(F.greatest("n", "rn")) * jaccard - 1e-9))
                    met = met.select(*of).union(_pairs_of_many(many, sketches, jaccard))
                    found = met.groupBy(*of).agg(F.count("*").alias("c"), least.alias("least")).filter("c >= least").select(*of)
                    edges = edges.union(_similar(docs, found, sketches, jaccard, text, shingle))
            else:
                edges = star_links(fps, bits) if k == 0 else None
                if n:
                    similar = _similar(docs, _pairs_with_hubs(many, k, jaccard).distinct(), sketches, jaccard, text, shingle)
                    edges = edges.union(similar) if edges is not None else similar
            now = _merged(now, edges, keep)
        if exact:
            return now
    return now


def _similar(docs: DataFrame, pairs: DataFrame, sketches: DataFrame, jaccard: float, text: str, shingle: int) -> DataFrame:
    """(a, b): the roots of pairs (doc, root, n, rdoc, rroot, rn) whose sets of shingles have that similarity. Only texts of pairs that their sketches leave move."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                one, two = (np.unique(shingles(t.as_py(), shingle)) for t in (x, y))
                inter = len(np.intersect1d(one, two, assume_unique=True))
                keep.append(inter >= jaccard * (len(one) + len(two) - inter) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    others = sketches.select(F.col("doc").alias("rdoc"), *[F.col("sketch")[i].alias(f"rs{i}") for i in range(SKETCH)])
    pairs = written(_sketched(pairs, sketches).join(others, "rdoc").filter(_near(jaccard)).select("doc", "root", "rdoc", "rroot"), "pairs")
    asked = written(pairs.select("doc").union(pairs.select("rdoc")).distinct(), "asked")
    texts = docs.select(F.xxhash64(text_of(text)).alias("doc"), text_of(text).alias("text")).join(asked, "doc", "left_semi")
    texts = written(texts.groupBy("doc", F.sha2("text", 256).alias("sha")).agg(F.first("text").alias("text")), "texts").select("doc", "text")
    both = pairs.join(texts, "doc").join(texts.select(F.col("doc").alias("rdoc"), F.col("text").alias("rtext")), "rdoc").select("root", "rroot", "text", "rtext")
    return written(both.mapInArrow(tidy_map(run), "a long, b long"), "similar")


def _answers(made: DataFrame, nodes: DataFrame, groups: DataFrame, key: str, *more: str) -> DataFrame:
    """key, fingerprint, component_id and more for the rows (key, fp) of made; group names a component."""
    placed = groups.join(nodes, "fp")
    ids = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    per_fp = written(placed.join(ids, "root").select("fp", "component_id", F.col("root").alias("group")), "components")  # apart, so that the join can split a large group
    return made.join(per_fp, "fp").select(F.col("key").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", *more)


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, k: int = 4, jaccard: float = 0.8) -> DataFrame:
    """One row per row of docs: key, fingerprint, component_id as simhash_components has them, group (a number of the component) and sha (of the text).

    Texts whose sets of shingles have an exact Jaccard similarity of jaccard or
    more are linked too, however far apart their fingerprints are.
    """
    sets = written(shingle_sets(docs, key, text, shingle, jaccard), "sets")
    made = sets.select("key", "sha", "fp")
    nodes = written(made.groupBy("fp").agg(F.min("key").alias("least")), "nodes")
    shared = written(sharing(sets), "shared")
    sketches = written(sets.join(shared.select("doc").distinct(), "doc", "left_semi").select("doc", "sketch").distinct(), "sketches")
    now = similar_groups(docs, shared, nodes.select("fp"), sketches, k, jaccard, text, shingle)
    return _answers(made, nodes, now, key, "group", "sha")


def simhash_components(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4, k: int = 4) -> DataFrame:
    """One row per row of docs: key, fingerprint (16 hex digits), component_id.

    component_id is the smallest key that can be reached over links of at most
    k differing bits, itself included. Equal fingerprints always share a
    component. Texts without words have fingerprint zero, linked like any other;
    null counts as empty. Rows with a null key take part, and have a null
    component_id only if no linked row has a key. Copies never form pairs: the
    joins are over distinct fingerprints. Repeated rows get the same answer
    each. No rows: no rows. Other columns are ignored.
    """
    made = written(fingerprints(docs, key, text, shingle), "fingerprints")
    nodes = written(made.groupBy("fp").agg(F.min("key").alias("least")), "nodes")
    return _answers(made, nodes, grouped(nodes.select("fp"), k), key)
