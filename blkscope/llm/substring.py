"""Substring deduplication: repeated passages found by sharded Aho-Corasick automata.

Of each window of WINDOW words the phrase of PHRASE words with the least hash is
its anchor; equal windows have equal anchors. Anchors that stand in different
documents are recurring phrases, confirmed over all documents by a shuffle. They
are dealt to the shards, one for each block of documents, that hold texts with
them; a shard compiles its phrases into one automaton of words and streams all
its documents through it. Windows whose anchor it locates are compared over all
shards by a 128-bit BLAKE2 digest of their words, and words covered by a window
that also starts in a document with a smaller key go. The quick hashes of words
only choose what is looked at; equality is that of the words themselves to the
automaton, and of their digests between shards.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import block_of, count_blocks, dealt, unpacked
from .common import text_of, written

WINDOW, PHRASE = 50, 10
BLOCK_BYTES = 8 << 20
PIECE = 1 << 20
U = np.uint64

#: Odd multipliers: of bytes within a word, of words within a phrase, and of words within a window.
BYTE, GRAM, ROLL = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F)

WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True


@lru_cache(maxsize=8)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base and its inverse to the powers 0 to n - 1, modulo 2 to the 64."""
    inverse = pow(base, -1, 1 << 64)
    up, down = (np.full(n, x, dtype=U) for x in (base, inverse))
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def _room(n: int) -> int:
    return 1 << max(10, n.bit_length())


def _runs(values: np.ndarray, length: int, base: int) -> np.ndarray:
    """The hash of each run of length values: their sum weighed by powers of base."""
    n = len(values)
    if n < length:
        return np.empty(0, dtype=U)
    up, down = _powers(base, _room(n))
    sums = np.concatenate((np.zeros(1, dtype=U), np.cumsum(values * up[:n], dtype=U)))
    return (sums[length:] - sums[: n - length + 1]) * down[: n - length + 1]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U(33))
    h = h * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each word of data, of words in order."""
    out = []
    at = 0
    while at < len(data):
        end = min(len(data), at + PIECE)
        while end < len(data) and not WHITE[data[end]]:
            end += 1
        raw = np.frombuffer(data, dtype=np.uint8, count=end - at, offset=at)
        edges = np.flatnonzero(np.diff(np.concatenate(([True], WHITE[raw], [True]))))
        starts, stops = edges[::2], edges[1::2]
        if len(starts):
            up, down = _powers(BYTE, _room(len(raw) + 1))
            sums = np.concatenate((np.zeros(1, dtype=U), np.cumsum((raw.astype(U) + U(1)) * up[: len(raw)], dtype=U)))
            out.append(_mixed((sums[stops] - sums[starts]) * down[starts] + (stops - starts).astype(U)))
        at = end
    return np.concatenate(out) if out else np.empty(0, dtype=U)


def phrases(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each phrase, and for each window the place of its anchor: the first of its phrases with the least hash."""
    grams = _mixed(_runs(words, PHRASE, GRAM))
    n = len(words) - WINDOW + 1
    if n < 1:
        return grams, np.empty(0, dtype=np.int64)
    least, place = grams, np.arange(len(grams))
    width, need = 1, WINDOW - PHRASE + 1
    while width < need:
        step = min(width, need - width)
        right = least[step:] < least[:-step]
        place = np.where(right, place[step:], place[:-step])
        least = np.where(right, least[step:], least[:-step])
        width += step
    return grams, place


def _rows(table: pa.Table) -> Iterator[tuple[int | None, bytes, bytes]]:
    """(key, name, words of the text as they stand) of a block's documents."""
    for key, name, raw in zip(table.column("key"), table.column("name"), unpacked(table.column("packed"))):
        yield key.as_py(), name.as_py(), raw


def _copies(known: pa.Table) -> set[tuple[int | None, bytes]]:
    """Documents of a block whose text a smaller key has: they are dealt with whole."""
    return {(k, n) for k, n in zip(known.column("key").to_pylist(), known.column("name").to_pylist()) if n is not None}


def _array(known: pa.Table, column: str) -> np.ndarray:
    return known.column(column).drop_null().to_numpy().view(U)


def _grouped(columns: list[np.ndarray], keys: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Different rows of columns with the least and the largest key of each."""
    order = np.lexsort((keys, *reversed(columns)))
    columns, keys = [c[order] for c in columns], keys[order]
    new = np.ones(len(keys), dtype=bool)
    if len(keys):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(keys)) - 1 if len(first) else first
    return [c[first] for c in columns], keys[first], keys[last]


def _empty(known: DataFrame, **columns: str) -> list[Column]:
    return [F.lit(None).cast(t).alias(c) for c, t in columns.items()]


def anchors_of(docs: DataFrame, copies: DataFrame) -> DataFrame:
    """(block, anchor, low, high): the anchors of each block's documents with the least and largest key that have them."""

    def run(own: pa.Table, known: pa.Table) -> pa.Table:
        skip = _copies(known)
        found, keys = [np.empty(0, dtype=U)], [np.empty(0, dtype=np.int64)]
        for key, name, raw in _rows(own):
            if key is None or (key, name) in skip:
                continue
            grams, place = phrases(word_hashes(raw))
            mine = np.unique(grams[np.unique(place)])
            found.append(mine)
            keys.append(np.full(len(mine), key, dtype=np.int64))
        (anchor,), low, high = _grouped([np.concatenate(found)], np.concatenate(keys))
        block = own.column("block")[0].as_py() if own.num_rows else known.column("block")[0].as_py()
        return pa.table({"block": pa.array(np.full(len(anchor), block, dtype=np.int32)), "anchor": pa.array(anchor.view(np.int64)), "low": pa.array(low), "high": pa.array(high)})

    return docs.groupBy("block").cogroup(copies.groupBy("block")).applyInArrow(run, "block int, anchor long, low long, high long")


def automaton_of(phrases_: set[tuple[int, ...]]) -> ahocorasick.Automaton:
    """The automaton of phrases, each a sequence of word numbers."""
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for x in phrases_:
        automaton.add_word(x, 1)
    if phrases_:
        automaton.make_automaton()
    return automaton


def located(numbers: list[int], automaton: ahocorasick.Automaton) -> np.ndarray:
    """At which words of a document, given by their numbers, a phrase of the automaton begins."""
    out = np.zeros(max(0, len(numbers) - PHRASE + 1), dtype=bool)
    if len(automaton) and len(out):
        ends = [end for end, _ in automaton.iter(tuple(numbers))]
        out[np.array(ends, dtype=np.int64) - PHRASE + 1] = True
    return out


def digests(words: list[bytes], at: np.ndarray) -> list[bytes]:
    """The digest of the words of each window that begins at one of the places."""
    joined = b" ".join(words)
    starts = np.concatenate(([0], np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)))
    stops = starts[at + WINDOW] - 1
    return [blake2b(joined[a:b], digest_size=16).digest() for a, b in zip(starts[at].tolist(), stops.tolist())]


def windows_of(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(block, w, h1, h2, low, high): windows whose anchor the shard's automaton of recurring phrases locates, with their quick hash and their digest in two halves."""

    def run(own: pa.Table, table: pa.Table) -> pa.Table:
        skip, recurring = _copies(table), np.sort(_array(table, "anchor"))
        number: dict[bytes, int] = {}
        confirmed: set[tuple[int, ...]] = set()
        held = []
        for key, name, raw in _rows(own) if len(recurring) else ():
            if key is None or (key, name) in skip:
                continue
            hashes = word_hashes(raw)
            if len(hashes) < WINDOW:
                continue
            numbers = [number.setdefault(w, len(number)) for w in raw.split()]
            grams, place = phrases(hashes)
            at = np.unique(place)
            at = at[recurring[np.minimum(np.searchsorted(recurring, grams[at]), len(recurring) - 1)] == grams[at]]
            confirmed.update(tuple(numbers[a : a + PHRASE]) for a in at.tolist())
            held.append((key, raw, numbers))
        automaton = automaton_of(confirmed)
        parts: list[list[np.ndarray]] = [[np.empty(0, dtype=U)], [np.empty((0, 2), dtype=U)], [np.empty(0, dtype=np.int64)]]
        for key, raw, numbers in held:
            found = located(numbers, automaton)
            if not found.any():
                continue
            hashes = word_hashes(raw)
            at = np.flatnonzero(found[phrases(hashes)[1]])
            parts[0].append(_runs(hashes, WINDOW, ROLL)[at])
            parts[1].append(np.frombuffer(b"".join(digests(raw.split(), at)), dtype="<u8").reshape(-1, 2))
            parts[2].append(np.full(len(at), key, dtype=np.int64))
        halves = np.concatenate(parts[1])
        (h1, h2, w), low, high = _grouped([halves[:, 0], halves[:, 1], np.concatenate(parts[0])], np.concatenate(parts[2]))
        block = own.column("block")[0].as_py() if own.num_rows else table.column("block")[0].as_py()
        columns = {"block": pa.array(np.full(len(h1), block, dtype=np.int32)), **{n: pa.array(np.ascontiguousarray(x).view(np.int64)) for n, x in (("w", w), ("h1", h1), ("h2", h2))}}
        return pa.table(columns | {"low": pa.array(low), "high": pa.array(high)})

    return docs.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(run, "block int, w long, h1 long, h2 long, low long, high long")


def _earlier(raw: bytes, key: int, quick: np.ndarray, marks: np.ndarray, first: dict[bytes, int]) -> np.ndarray:
    """Starts of windows that stand in the table of digests with a smaller key; quick are the table's quick hashes in order."""
    mine = _runs(word_hashes(raw), WINDOW, ROLL)
    at = np.flatnonzero(marks[(mine & U(len(marks) - 1)).astype(np.int64)])
    if len(at):
        at = at[quick[np.minimum(np.searchsorted(quick, mine[at]), len(quick) - 1)] == mine[at]]
    if not len(at):
        return at
    return at[[first.get(x, key) < key for x in digests(raw.split(), at)]]


def _shared(rows: DataFrame, *by: str, **more: Column) -> DataFrame:
    """What different keys have, with the least key as first, and more aggregates."""
    return rows.groupBy(*by).agg(F.min("low").alias("first"), F.max("high").alias("last"), F.max("block").alias("block"), *[e.alias(n) for n, e in more.items()]).filter("first < last AND block >= 0")


def substring_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of docs: key, n_words, n_removed, kept (the words that stay, joined by one space).

    Words are runs of other bytes than white space. Null and empty texts have
    none. Texts of fewer than WINDOW words stay whole. A row with a null key
    neither loses words nor makes others lose any; nor do rows with the same
    key to each other. Of equal texts only the one with the smallest key is
    searched, the others have no word left (or, if short, all). No rows: no
    rows. Other columns are ignored. Keys are whole numbers; others are a
    ValueError.
    """
    if dict(docs.dtypes)[key] not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"{key} must hold whole numbers, not {dict(docs.dtypes)[key]}")
    blocks = count_blocks(docs, text, block_bytes)
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    name = F.substring(F.unhex(F.sha2(text_of(text), 256)), 1, 16)
    own = docs.select(F.col(key).cast("long").alias("key"), text_of(text).alias("text"), name.alias("name"))
    mine = dealt(own, blocks, str.encode, "key", "text", ("name",))

    light = own.select("key", "name", block_of("key", "text", blocks).alias("block"))
    least = written(light.groupBy("name").agg(F.min("key").alias("least")), "least")  # apart, so that the join can split a large group
    copies = light.join(least, "name").filter("key > least").select("block", "key", "name").repartition(partitions, "block")

    # Both are dealt out once by what they are compared by. The sums and the joins back read the same exchange,
    # which needs them to read the same columns: hence the block in the sums and the keys in the joins.
    anchors = anchors_of(mine, copies).repartition(partitions, "anchor")
    recurring = _shared(anchors, "anchor").select("anchor", "first")
    asked = anchors.join(recurring, "anchor").filter("greatest(low, high) >= first").select("block", *_empty(anchors, key="long", name="binary"), "anchor")
    windows = windows_of(mine, copies.select("block", "key", "name", *_empty(copies, anchor="long")).unionByName(asked)).repartition(partitions, "h1", "h2")
    # Equal words have one quick hash too: asking for it makes both sides read w, so that windows are found once. Written
    # as an equality it would become a key of the join, and the sides would differ again.
    first = _shared(windows, "h1", "h2", quick=F.min("w")).select("h1", "h2", "first", "quick")
    told = windows.join(first, ["h1", "h2"]).filter("greatest(low, high) > first AND least(w, quick) >= greatest(w, quick)").select("block", *_empty(first, key="long", name="binary"), "w", "h1", "h2", "first")
    known = copies.select("block", "key", "name", *_empty(copies, w="long", h1="long", h2="long", first="long")).unionByName(told)

    def run(table: pa.Table, known: pa.Table) -> pa.Table:
        skip = _copies(known)
        h1, h2, quick = _array(known, "h1"), _array(known, "h2"), np.sort(_array(known, "w"))
        raw_digests = np.stack((h1, h2), axis=1).tobytes()
        first = {raw_digests[16 * k : 16 * k + 16]: x for k, x in enumerate(known.column("first").drop_null().to_pylist())}
        marks = np.zeros(1 << max(10, (8 * len(quick)).bit_length()), dtype=bool)
        marks[(quick & U(len(marks) - 1)).astype(np.int64)] = True
        keys, counts, removed, kept = [], [], [], []
        for key, name, raw in _rows(table):
            words = raw.split()
            n = len(words)
            gone = 0
            if (key, name) in skip:
                gone = n if n >= WINDOW else 0
                words = [] if gone else words
            elif key is not None and n >= WINDOW and len(quick):
                starts = _earlier(raw, key, quick, marks, first)
                if len(starts):
                    cover = np.zeros(n + 1, dtype=np.int64)
                    np.add.at(cover, starts, 1)
                    np.add.at(cover, starts + WINDOW, -1)
                    stays = np.cumsum(cover[:n]) == 0
                    gone = n - int(stays.sum())
                    words = [words[k] for k in np.flatnonzero(stays).tolist()]
            keys.append(key)
            counts.append(n)
            removed.append(gone)
            kept.append(b" ".join(words).decode())
        return pa.table({"key": pa.array(keys, pa.int64()), "n_words": pa.array(counts, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept": pa.array(kept, pa.string())})

    out = mine.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(run, "key long, n_words long, n_removed long, kept string")
    return out.withColumnRenamed("key", key)
