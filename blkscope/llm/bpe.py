"""BPE encoding and decoding over a table of distinct words.

Documents are dealt into blocks. Each block's distinct words go to the shards
of one distinct-word table, where every word is encoded once. The pieces of the
ids that a shard has come from a join with the vocabulary. Ids and decoded words
come back to the block and are put in the places of the words.

Serves tokenizer files whose pre-tokens are encoded independently of each other
(a normaliser, a splitting pattern, byte-level pieces, no post-processor).
"""

from __future__ import annotations

import json
import math
import os
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import BLOCK_BYTES, count_blocks, dealt, unpacked

#: Code points below this one need no Unicode normalisation, their classes never change, and but for U+0130 lower case stays below.
PLAIN = 0x180

#: Words that go to the library in one call.
TOGETHER = 64


def _char_class(kinds: str) -> str:
    return "".join(f"\\u{c:04x}" for c in range(PLAIN) if unicodedata.category(chr(c))[0] in kinds)


class Words:
    """Splits texts into the words that the tokenizer at path encodes one by one, and encodes them."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Regex, Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split, byte_level = spec["pre_tokenizer"]["pretokenizers"]
        pattern = split["pattern"]["Regex"]
        self.specials = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self._full = Tokenizer.from_file(path)
        self._split = pre_tokenizers.Split(Regex(pattern), "removed", invert=True)
        spaces = {"type": "Split", "pattern": {"String": " "}, "behavior": "Removed", "invert": False}
        bare = {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": [spaces, byte_level]}}
        self._bare = Tokenizer.from_str(json.dumps(spec | bare))
        self.pieces = {i: w for w, i in self._full.get_vocab(with_added_tokens=True).items()}
        self._last = np.zeros(max(self.pieces) + 1, dtype=bool)
        self._last[[i for i, w in self.pieces.items() if w.endswith(spec["model"]["end_of_word_suffix"])]] = True
        letters, digits, white = _char_class("L"), _char_class("N"), r"\t\n\x0b\x0c\r\x20\x85\xa0"
        # the same language as the pattern of the file for plain texts; no two branches start alike, so their order is free
        assert pattern == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+", "another splitting pattern"
        self._plain = re.compile(rf"[{letters}]+|'(?:s|t|re|ve|m|ll|d)|[{digits}]|[^{white}{letters}{digits}]+").findall
        self._beyond = re.compile(rf"[^\x00-\x1b\x20-\u012f\u0131-\u{PLAIN - 1:04x}]").search
        # \x1c to \x1f part str.split() but not the pattern
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None

    def units(self, text: str) -> list[str]:
        """Parts of a text between which no word runs on: what white space parts if the text is plain, else its words, marked by a line end."""
        if self._special is None or not any(x in text for x in self.specials):
            if self._beyond(text) is None:
                return text.lower().split()
            return ["\n" + w for w in self._part(text)]
        return ["\n" + w for k, x in enumerate(self._special.split(text)) for w in ([x] if k % 2 else self._part(x))]

    def words(self, unit: str) -> list[str]:
        """The words of a unit in order; a special token's string is a word of its own."""
        if unit.isalpha():
            return [unit]
        if unit[0] == "\n":
            return [unit[1:]]
        if unit[:-1].isalpha() and not unit[-1].isalpha():
            return [unit[:-1], unit[-1]]
        return self._plain(unit)

    def split(self, text: str) -> list[str]:
        return [w for x in self.units(text) for w in self.words(x)]

    def _part(self, text: str) -> list[str]:
        if self._beyond(text) is None:
            return self._plain(text.lower())
        return [w for w, _ in self._split.pre_tokenize_str(self._full.normalizer.normalize_str(text))]

    def encode(self, words: list[str]) -> list[bytes]:
        """The ids of each word, four bytes each, least first. Words go to the library some at a time; the id of a word's end says where the next one begins."""
        plain = [w for w in words if w not in self.specials]
        out: list[bytes] = []
        for e in self._bare.encode_batch_fast([" ".join(plain[k : k + TOGETHER]) for k in range(0, len(plain), TOGETHER)], add_special_tokens=False):
            ids = np.array(e.ids, dtype="<u4")
            raw, a = ids.tobytes(), 0
            for b in (4 * np.flatnonzero(self._last[ids]) + 4).tolist():
                out.append(raw[a:b])
                a = b
        if len(out) != len(plain):
            raise ValueError("a word without an end")
        if len(plain) == len(words):
            return out
        rest = iter(out)
        return [np.array([self.specials[w]], dtype="<u4").tobytes() if w in self.specials else next(rest) for w in words]


@lru_cache(maxsize=2)
def words_of(path: str) -> Words:
    """One per process and file."""
    return Words(path)


def _zip(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def _unzip(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def block_words(dealt_docs: DataFrame, tokenizer: str, shards: int) -> DataFrame:
    """(block, shard, words): the distinct words of each block by shard, sorted, each once."""

    def run(table: pa.Table) -> pa.Table:
        units: set[str] = set()
        known = words_of(tokenizer)
        for raw in unpacked(table.column("packed")):
            units.update(known.units(raw.decode()))
        words = {w for x in units for w in known.words(x)}
        lists: dict[int, list[str]] = {}
        for w in sorted(words):
            lists.setdefault(zlib.crc32(w.encode()) % shards, []).append(w)
        block = table.column("block")[0].as_py()
        return pa.table({"block": pa.array([block] * len(lists), pa.int32()), "shard": pa.array(list(lists), pa.int32()), "words": pa.array([_zip("\n".join(x).encode()) for x in lists.values()], pa.binary())})

    return dealt_docs.groupBy("block").applyInArrow(run, "block int, shard int, words binary")


def encoded_words(lists: DataFrame, tokenizer: str) -> DataFrame:
    """(shard, words, counts, ids, distinct): each shard's words, in some rows, with their numbers of ids and ids. A word is encoded once, whatever the number of lists it is in.

    lists has the rows of a shard in one partition.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, now, known = words_of(tokenizer), None, set()
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for _, shard, packed in zip(*(c.to_pylist() for c in batch.columns)):
                if shard != now:
                    now, known = shard, set()
                new = [w for w in _unzip(packed).decode().split("\n") if w not in known]
                if not new:
                    continue
                known.update(new)
                ids = words.encode(new)
                counts = np.fromiter((len(x) // 4 for x in ids), dtype="<u4", count=len(ids))
                ids = np.frombuffer(b"".join(ids), dtype="<i4")
                for column, value in zip(out, (shard, _zip("\n".join(new).encode()), _zip(counts.tobytes()), _zip(ids.tobytes()), np.unique(ids))):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int32())))], names=["shard", "words", "counts", "ids", "distinct"])

    return lists.sortWithinPartitions("shard").mapInArrow(run, "shard int, words binary, counts binary, ids binary, distinct array<int>")


def vocabulary(spark: SparkSession, tokenizer: str) -> DataFrame:
    """(id, piece) of the tokenizer file: as many rows as its vocabulary, whatever the data."""
    return spark.createDataFrame(sorted(words_of(tokenizer).pieces.items()), "id int, piece string")


def pieces_by_shard(encoded: DataFrame, vocab: DataFrame) -> DataFrame:
    """(shard, pieces): the pieces of the ids that each shard's words have, by a join on the id: one row at most for each shard and id, whatever the number of blocks.

    It reads all columns of encoded, as what puts ids and pieces together does:
    so both read one exchange, and words are encoded once.
    """
    whole = F.length("words") + F.length("counts") + F.length("ids") > 0
    ids = encoded.select("shard", F.explode(F.when(whole, F.col("distinct"))).alias("id")).distinct()
    return ids.join(F.broadcast(vocab), "id").groupBy("shard").agg(F.collect_list(F.struct("id", "piece")).alias("pieces"))


def decoded_lists(lists: DataFrame, encoded: DataFrame, pieces: DataFrame) -> DataFrame:
    """(block, words, counts, ids, texts): each list with its words' numbers of ids, ids and decoded texts."""
    none = F.lit(None).cast("binary")
    known = encoded.select("*", F.lit(None).cast("array<struct<id:int,piece:string>>").alias("pieces")).unionByName(
        pieces.select("shard", none.alias("words"), none.alias("counts"), none.alias("ids"), F.lit(None).cast("array<int>").alias("distinct"), "pieces")
    )

    def run(own: pa.Table, table: pa.Table) -> pa.Table:
        piece: dict[int, str] = {}
        for row in table.column("pieces").drop_null():
            flat = row.values
            piece.update(zip(flat.field("id").to_pylist(), flat.field("piece").to_pylist()))
        ids_of: dict[str, bytes] = {}
        text_of_word: dict[str, str] = {}
        for packed, counts, ids in zip(*(table.column(c) for c in ("words", "counts", "ids"))):
            if not packed.is_valid:
                continue
            stops = np.cumsum(np.frombuffer(_unzip(counts.as_py()), dtype="<u4")).tolist()
            raw = _unzip(ids.as_py())
            names = [piece[i] for i in np.frombuffer(raw, dtype="<i4").tolist()]
            a = 0
            for w, b in zip(_unzip(packed.as_py()).decode().split("\n"), stops):
                ids_of[w], text_of_word[w] = raw[4 * a : 4 * b], " ".join(names[a:b])
                a = b
        made: list[list[bytes]] = [[] for _ in range(3)]
        for packed in own.column("words"):
            words = _unzip(packed.as_py()).decode().split("\n")
            ids = [ids_of[w] for w in words]
            counts = np.fromiter((len(x) // 4 for x in ids), dtype="<u4", count=len(ids))
            for column, value in zip(made, (counts.tobytes(), b"".join(ids), "\n".join([text_of_word[w] for w in words]).encode())):
                column.append(_zip(value))
        return pa.table({"block": own.column("block"), "words": own.column("words")} | {n: pa.array(c, pa.binary()) for n, c in zip(("counts", "ids", "texts"), made)})

    return lists.groupBy("shard").cogroup(known.groupBy("shard")).applyInArrow(run, "block int, words binary, counts binary, ids binary, texts binary")


def encode_decode(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of docs: key, ids (array<int>), decoded.

    ids are those of the tokenizers library without special tokens added (their
    strings in a text become special tokens, as there); decoded is the text of
    its decode() of these ids. Null and empty texts: no ids, empty text.
    """
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = count_blocks(docs, text, block_bytes)
    mine = dealt(docs, blocks, str.encode, key, text)
    lists = block_words(mine, tokenizer, max(12, 4 * math.isqrt(blocks))).repartition(partitions, "shard")
    encoded = encoded_words(lists, tokenizer).repartition(partitions, "shard")
    known = decoded_lists(lists, encoded, pieces_by_shard(encoded, vocabulary(spark, tokenizer))).repartition(partitions, "block")

    def run(own: pa.Table, table: pa.Table) -> pa.Table:
        ids_of: dict[str, bytes] = {}
        text_of_word: dict[str, str] = {}
        for packed, counts, ids, texts in zip(*(table.column(c) for c in ("words", "counts", "ids", "texts"))):
            stops = np.cumsum(np.frombuffer(_unzip(counts.as_py()), dtype="<u4")).tolist()
            raw = _unzip(ids.as_py())
            a = 0
            for w, t, b in zip(_unzip(packed.as_py()).decode().split("\n"), _unzip(texts.as_py()).decode().split("\n"), stops):
                ids_of[w], text_of_word[w] = raw[4 * a : 4 * b], t
                a = b
        splitter = words_of(tokenizer)
        unit_ids: dict[str, bytes] = {}
        unit_text: dict[str, str] = {}
        parts, offsets, texts = [], [0], []
        for raw in unpacked(own.column("packed")):
            units = splitter.units(raw.decode())
            for x in units:
                if x not in unit_ids:
                    words = splitter.words(x)
                    unit_ids[x], unit_text[x] = b"".join([ids_of[w] for w in words]), " ".join([text_of_word[w] for w in words])
            parts.append(b"".join(map(unit_ids.__getitem__, units)))
            offsets.append(offsets[-1] + len(parts[-1]) // 4)
            texts.append(" ".join(map(unit_text.__getitem__, units)))
        ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(parts), dtype="<i4")))
        return pa.table({"key": own.column("key"), "ids": ids, "decoded": pa.array(texts, pa.string())})

    out = mine.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(run, f"key {dict(mine.dtypes)['key']}, ids array<int>, decoded string")
    return out.withColumnRenamed("key", key)
