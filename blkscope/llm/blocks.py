"""Documents dealt into blocks of bounded size, so that what a block's texts share is looked up once for the block.

A block is named by a hash of key and text. It holds about block_bytes of text
at most on average, whatever the size of the input; the number of blocks follows the input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks_for, text_of, tidy_map

BLOCK_BYTES = 16 << 20


def count_blocks(docs: DataFrame, text: str = "text", block_bytes: int = BLOCK_BYTES) -> int:
    """From the bytes of all texts, by one pass over them in the JVM; as many as there are shuffle partitions at least, so that all of these have work."""
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, blocks_for(docs.agg(F.sum(F.octet_length(text_of(text)))).first()[0], block_bytes))


def block_of(key: str, text: str, blocks: int) -> Column:
    """The block of a row, from its key and text."""
    return F.pmod(F.xxhash64(F.col(key).cast("string"), text_of(text)), F.lit(blocks)).cast("int")


def dealt(docs: DataFrame, blocks: int, pack: Callable[[str], bytes], key: str = "doc_id", text: str = "text", more: tuple[str, ...] = ()) -> DataFrame:
    """(block, key, more..., packed) with a block's rows in one partition; packed is pack(text), compressed.

    A plan that reads this twice shuffles it once: Spark reuses the exchange.
    """
    rows = docs.select(block_of(key, text, blocks).alias("block"), F.col(key).alias("key"), *more, text_of(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            packed = pa.array((compress(pack(x.as_py())) for x in batch.column(batch.num_columns - 1)), pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], packed], names=[*batch.schema.names[:-1], "packed"])

    fields = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes[:-1])
    out = rows.mapInArrow(tidy_map(run), f"{fields}, packed binary")
    return out.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "block")


def unpacked(packed: pa.ChunkedArray) -> Iterator[bytes]:
    expand = zstandard.ZstdDecompressor().decompress
    return (expand(x.as_py()) for x in packed)


def bundled(rows: DataFrame, blocks: int, pack: Callable[[str], str]) -> DataFrame:
    """(block, bundle) for rows whose columns begin with key and end with text; a bundle holds those rows of a batch that are of one block, texts packed, and is compressed as a whole."""
    wide = rows.select(block_of("key", "text", blocks).alias("block"), *rows.columns[:-1], text_of("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            block = batch.column(0).to_numpy()
            order = np.argsort(block, kind="stable")
            texts = pa.array((pack(x.as_py()) for x in batch.column(batch.num_columns - 1)), pa.string())
            own = pa.RecordBatch.from_arrays([*batch.columns[1:-1], texts], names=batch.schema.names[1:])
            names, bundles = [], []
            for part in np.split(order, np.flatnonzero(np.diff(block[order])) + 1) if len(order) else ():
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, own.schema) as writer:
                    writer.write_batch(own.take(pa.array(part)))
                names.append(int(block[part[0]]))
                bundles.append(compress(sink.getvalue().to_pybytes()))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(bundles, pa.binary())], names=["block", "bundle"])

    out = wide.mapInArrow(tidy_map(run), "block int, bundle binary")
    return out.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "block")


def opened(bundles: pa.ChunkedArray) -> pa.Table | None:
    """The rows of bundles; None without any."""
    tables = [pa.ipc.open_stream(raw).read_all() for raw in unpacked(bundles)]
    return pa.concat_tables(tables) if tables else None
