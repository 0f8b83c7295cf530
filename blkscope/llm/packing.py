"""Best-fit packing of token sequences by piece length.

Which lengths share a sequence is decided on the table of counts by length,
which has at most as many rows as a sequence has tokens; the pieces then find
their places by their rank within their length. Best-two-fit: a sequence is
filled greedily, then its smallest piece gives way to two others that fill the
expanded gap more tightly.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import words_of
from .common import text_of, written

#: Parts of texts that a worker remembers the ids of (some 0.3 KB each). Beyond them it forgets those that it met only once.
REMEMBERED = 400_000

#: Documents whose new words are encoded together.
TOGETHER = 128


class Memory:
    """Ids of parts of texts. What did not come again since it last grew full is forgotten then, so that frequent parts are encoded once however much text there is."""

    def __init__(self, tokenizer: str, most: int = REMEMBERED) -> None:
        self.words, self.most = words_of(tokenizer), most
        self.ids: dict[str, bytes] = {}
        self.again: set[str] = set()

    def packed(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, four bytes each, least first."""
        docs = [self.words.units(x) for x in texts]
        parts = set().union(*docs)
        new = parts.difference(self.ids)
        if len(self.ids) + len(new) > self.most:
            kept = self.again | parts
            self.ids = {x: self.ids[x] for x in (kept if len(kept) <= self.most // 2 else parts) if x in self.ids}
            self.again = set()
        split = {x: self.words.words(x) for x in new}
        distinct = list({w for own in split.values() for w in own})
        of = dict(zip(distinct, self.words.encode(distinct)))
        self.ids.update((x, b"".join([of[w] for w in own])) for x, own in split.items())
        self.again |= parts - new
        return [b"".join(map(self.ids.__getitem__, own)) for own in docs]


@lru_cache(maxsize=1)
def memory_of(tokenizer: str) -> Memory:
    """One for a worker process, over its tasks."""
    return Memory(tokenizer)


def pieces(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """(key, piece, start, length, ids_crc32, part, rank): rank counts the pieces of one length within a part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, part, ranks, end = memory_of(tokenizer), TaskContext.get().partitionId(), Counter(), np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for first in range(0, batch.num_rows, TOGETHER):
                for at, ids in enumerate(memory.packed(batch.column(1).slice(first, TOGETHER).to_pylist()), first):
                    packed = ids + end
                    for k, a in enumerate(range(0, len(packed), 4 * capacity)):
                        piece = packed[a : a + 4 * capacity]
                        n = len(piece) // 4
                        for column, value in zip(out, (at, k, a // 4, n, zlib.crc32(piece), ranks[n])):
                            column.append(value)
                        ranks[n] += 1
            at, k, start, n, crc, rank = out
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), pa.array(k, pa.int32()), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array([part] * len(n), pa.int32()), pa.array(rank, pa.int64())],
                names=["key", "piece", "start", "length", "ids_crc32", "part", "rank"],
            )

    rows = docs.select(F.col(key).alias("key"), text_of(text).alias("text"))
    return rows.mapInArrow(run, f"key {dict(rows.dtypes)['key']}, piece int, start long, length long, ids_crc32 long, part int, rank long")


def _fill(first: int, lengths: list[int], counts: dict[int, int], capacity: int) -> Counter:
    """A sequence that starts with a piece of the length first, filled by best-two-fit."""
    used = Counter({first: 1})
    gap = capacity - first

    def largest(limit: int) -> int:
        """The largest length up to limit of which a piece is left; none: 0."""
        k = bisect_right(lengths, limit) - 1
        while k >= 0 and counts[lengths[k]] <= used[lengths[k]]:
            k -= 1
        return lengths[k] if k >= 0 else 0

    while n := largest(gap):
        taken = min(counts[n] - used[n], gap // n)
        used[n] += taken
        gap -= taken * n
    while gap and used.total() > 1:
        least = min(n for n in used if used[n])
        room = gap + least
        used[least] -= 1
        best = (least, 0)
        k = bisect_right(lengths, room - 1)
        while k and (a := lengths[k - 1]) * 2 >= room - (room - sum(best)) and sum(best) < room:
            k -= 1
            if counts[a] > used[a]:
                used[a] += 1
                b = largest(min(a, room - a))
                used[a] -= 1
                if b and a + b > sum(best):
                    best = (a, b)
        for n in best:
            if n:
                used[n] += 1
        gap = room - sum(best)
        if not best[1]:
            break
    return +used


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Kinds of sequences: how many of the kind, and (length, how many) of its pieces. All pieces of the histogram are used."""
    counts = {n: c for n, c in histogram.items() if c}
    lengths = sorted(counts)
    kinds = []
    while lengths:
        used = _fill(lengths[-1], lengths, counts, capacity)
        times = min(counts[n] // c for n, c in used.items())
        kinds.append((times, sorted(used.items(), reverse=True)))
        for n, c in used.items():
            counts[n] -= times * c
        lengths = [n for n in lengths if counts[n]]
    return kinds


def places(kinds: list[tuple[int, list[tuple[int, int]]]]) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, pieces of this length in one sequence, first sequence, offset of the first)."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: Counter = Counter()
    sequence = 0
    for times, parts in kinds:
        offset = 0
        for n, c in parts:
            out.setdefault(n, []).append((ranks[n], c, sequence, offset))
            ranks[n] += times * c
            offset += n * c
        sequence += times
    return {n: np.array(rows, dtype=np.int64) for n, rows in out.items()}


def best_fit_packing(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and end_id (null text: empty, so end_id alone); only
    documents longer than capacity are cut. Repeated rows are packed each. No
    documents: no rows. The driver sees the counts by length only.
    """
    made = written(pieces(docs, tokenizer, key, text, capacity, end_id), "pieces")
    by_part = written(made.groupBy("length", "part").agg(F.count("*").alias("n")), "piece-counts")
    histogram = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    where = places(plan(histogram, capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_part.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    # the offsets have a row for each length and task, so they are never broadcast
    ranked = made.join(offsets.hint("merge"), ["length", "part"]).select("key", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.empty_like(length), np.empty_like(length)
            for n in np.unique(length).tolist():
                mine, rows = length == n, where[n]
                row = rows[np.searchsorted(rows[:, 0], rank[mine], side="right") - 1]
                nth = rank[mine] - row[:, 0]
                sequence[mine] = row[:, 2] + nth // row[:, 1]
                offset[mine] = row[:, 3] + nth % row[:, 1] * n
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=["key", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = dict(ranked.dtypes)["key"]
    return ranked.mapInArrow(run, f"key {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long").withColumnRenamed("key", key)
