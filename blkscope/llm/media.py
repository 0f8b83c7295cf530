"""Media columns: texts as 8-bit WAV media, chunked by content, stored once, reconstructed and decoded.

A payload is cut where a rolling gear hash of its last bytes says so. Chunks
with the same digest meet in one Spark shuffle and are one chunk from then on;
each place that asks for a chunk gets it from there, and the ordered chunk list
of a document puts its media together again, which is verified by digest.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

UNIT, PAD = 192, b" "
RATE = 8000

#: A cut needs MASK_BITS zero bits of the gear hash, which looks at as many bytes; chunks have these lengths at least and at most.
MASK_BITS, SHORTEST, LONGEST = 13, 2048, 65536

#: Of at most so many documents, so many characters each, a dictionary of so many bytes at most is trained for the chunk store's compression.
SAMPLE_DOCS, SAMPLE_CHARS, DICTIONARY_BYTES = 400, 4000, 112 << 10
LEVEL = 15


def gear_table() -> np.ndarray:
    """A pseudo-random number for each byte, from its SHA-256."""
    return np.array([int.from_bytes(hashlib.sha256(bytes([b])).digest()[:2], "little") for b in range(256)], dtype=np.uint16)


GEAR = gear_table()


def payload_of(text: str) -> tuple[int, bytes]:
    """The text's UTF-8 length, and these bytes padded with spaces to a positive multiple of UNIT."""
    raw = text.encode("utf-8", "replace")
    return len(raw), raw + PAD * (max(1, -(-len(raw) // UNIT)) * UNIT - len(raw))


def cuts(data: bytes) -> list[int]:
    """Where chunks end, the last one at the end of data. Depends on the bytes before each place only."""
    g = GEAR[np.frombuffer(data, dtype=np.uint8)]
    h = np.zeros(len(g), dtype=np.uint16)
    for k in range(min(MASK_BITS, len(g))):
        h[k:] += g[: len(g) - k] << np.uint16(k)
    marks = np.flatnonzero((h & ((1 << MASK_BITS) - 1)) == 0) + 1
    ends, at = [], 0
    while len(data) - at > SHORTEST:
        k = np.searchsorted(marks, at + SHORTEST)
        end = min(int(marks[k]) if k < len(marks) else len(data), at + LONGEST, len(data))
        ends.append(end)
        at = end
    if at < len(data) or not ends:
        ends.append(len(data))
    return ends


def wav(payload: bytes) -> bytes:
    """A mono WAV file of 8-bit samples, one for each byte."""
    pad = b"\0" * (len(payload) % 2)
    head = b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", len(payload))
    return b"RIFF" + struct.pack("<I", len(head) + len(payload) + len(pad)) + head + payload + pad


def samples(media: bytes) -> bytes:
    """The samples of a WAV file, found by its own chunk headers."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at = 12
    while at + 8 <= len(media):
        size = struct.unpack_from("<I", media, at + 4)[0]
        if media[at : at + 4] == b"data":
            return media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("a WAV file without samples")


def feature_of(payload: bytes) -> str:
    """Samples, mean level, RMS around the middle, and zero crossings, as a short string."""
    x = np.frombuffer(payload, dtype=np.uint8).astype(np.int64) - 128
    crossings = int(np.count_nonzero((x[1:] >= 0) != (x[:-1] >= 0)))
    return f"n={len(x)};sum={int(x.sum())};sq={int((x * x).sum())};zc={crossings};min={int(x.min())};max={int(x.max())}"


def dictionary_of(docs: DataFrame, text: str = "text") -> bytes:
    """A Zstandard dictionary from texts picked by their hash, so from the same ones each time; plain text if they are too few to train on.

    About twice SAMPLE_DOCS different texts pass the hash, whatever the number of tasks; the least digests of these are read.
    """
    share = min(1.0, 2 * SAMPLE_DOCS / max(1, docs.count()))
    picked = F.pmod(F.xxhash64(text_of(text)), F.lit(1 << 30)) < int(share * (1 << 30))
    some = docs.filter(picked).select(F.sha2(text_of(text), 256).alias("h"), F.substring(text_of(text), 1, SAMPLE_CHARS).alias("t")).distinct()
    rows = some.orderBy("h").limit(SAMPLE_DOCS).collect()
    samples = [r["t"].encode() for r in rows if r["t"]]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(samples)[:DICTIONARY_BYTES]


def _dict(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw) if len(raw) >= 8 else None


def with_payload(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, payload): length of the unpadded text, SHA-256 of the padded one; no bytes move."""
    raw = F.octet_length(text_of(text)).cast("long")
    pad = (F.greatest(F.lit(1).cast("long"), F.ceil(raw / UNIT)) * UNIT - raw).cast("int")
    return docs.select(F.col(key).alias("key"), raw.alias("n_bytes"), F.unhex(F.sha2(F.concat(text_of(text), F.repeat(F.lit(" "), pad)), 256)).alias("payload"))


def recipes(docs: DataFrame, text: str = "text") -> DataFrame:
    """(payload, n, pos, digest): the ordered chunk list of each different payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in range(4)]
            for text in batch.column(0):
                data = payload_of(text.as_py())[1]
                name, ends = hashlib.sha256(data).digest(), cuts(data)
                for pos, (a, b) in enumerate(zip([0, *ends], ends)):
                    for column, value in zip(columns, (name, len(ends), pos, hashlib.sha256(data[a:b]).digest())):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int32(), pa.int32(), pa.binary()))], names=["payload", "n", "pos", "digest"])

    return docs.select(text_of(text).alias("text")).mapInArrow(run, "payload binary, n int, pos int, digest binary").distinct()


def chunk_store(docs: DataFrame, dictionary: bytes, text: str = "text") -> DataFrame:
    """(digest, chunk): each different chunk once, compressed. A task drops its own repeats before they move."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = _dict(dictionary)
        compress = zstandard.ZstdCompressor(level=LEVEL, **({"dict_data": d} if d else {})).compress
        for batch in batches:
            mine: dict[bytes, bytes] = {}
            for text in batch.column(0):
                data = payload_of(text.as_py())[1]
                ends = cuts(data)
                for a, b in zip([0, *ends], ends):
                    digest = hashlib.sha256(data[a:b]).digest()
                    if digest not in mine:
                        mine[digest] = compress(data[a:b])
            yield pa.RecordBatch.from_arrays([pa.array(mine.keys(), pa.binary()), pa.array(mine.values(), pa.binary())], names=["digest", "chunk"])

    return docs.select(text_of(text).alias("text")).mapInArrow(run, "digest binary, chunk binary").groupBy("digest").agg(F.first("chunk").alias("chunk"))


def reconstructed(asked: DataFrame, store: DataFrame, dictionary: bytes) -> DataFrame:
    """(payload, media): each payload put together from its chunk list, verified by its digest, as a WAV file.

    The chunks of a payload come one after the other, so a task holds one payload at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = _dict(dictionary)
        expand = zstandard.ZstdDecompressor(**({"dict_data": d} if d else {})).decompress
        parts: list[bytes] = []
        for batch in batches:
            names, out, held = [], [], 0
            for name, n, pos, chunk in zip(*(batch.column(c) for c in ("payload", "n", "pos", "chunk"))):
                if pos.as_py() != len(parts):
                    raise ValueError("a chunk is missing")
                parts.append(expand(chunk.as_py()))
                if len(parts) == n.as_py():
                    data = b"".join(parts)
                    if hashlib.sha256(data).digest() != name.as_py():
                        raise ValueError("a payload does not have its digest")
                    names.append(name.as_py())
                    out.append(wav(data))
                    held += len(data)
                    parts = []
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(out, pa.binary())], names=["payload", "media"])
                        names, out, held = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(out, pa.binary())], names=["payload", "media"])

    partitions = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = asked.join(store, "digest").select("payload", "n", "pos", "chunk")
    return found.repartition(partitions, "payload").sortWithinPartitions("payload", "pos").mapInArrow(run, "payload binary, media binary")


def features(media: DataFrame) -> DataFrame:
    """(payload, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) from the samples of each media file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, x in zip(batch.column(0), batch.column(1)):
                file = x.as_py()
                data = samples(file)
                rows.append((name.as_py(), len(data), hashlib.sha256(data).digest(), zlib.crc32(data[-16:]), len(file), hashlib.sha256(file).digest(), feature_of(data)))
            columns = zip(*rows) if rows else [[]] * 7
            types = (pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["payload", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.mapInArrow(run, "payload binary, payload_bytes long, payload_sha256 binary, tail_crc32 long, media_bytes long, media_sha256 binary, feature string")


def media_features(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: key, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.

    Null counts as empty, and an empty text is one unit of padding. Each
    different payload is put together and decoded once, however many rows have
    it; copies get its values by a join on its digest.
    """
    dictionary = dictionary_of(docs, text)
    found = features(reconstructed(recipes(docs, text), chunk_store(docs, dictionary, text), dictionary))
    rows = with_payload(docs, key, text).join(found, "payload")
    hexed = [F.lower(F.hex(c)).alias(c) for c in ("payload_sha256", "media_sha256")]
    return rows.select(F.col("key").alias(key), "n_bytes", "payload_bytes", hexed[0], "tail_crc32", "media_bytes", hexed[1], "feature")
