"""Logs as lines: (trace, line_no, line).

A log's encoding is told by its first HEAD bytes: a byte order mark, else UTF-8
if they are that, else CP949, the usual one of such logs elsewhere.
"""

from __future__ import annotations

import codecs
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


HEAD = 8192

#: Encodings of two bytes a unit, by Spark's names.
WIDE = {"utf-16-le": "UTF-16LE", "utf-16-be": "UTF-16BE"}


def encoding_of(head: bytes) -> str:
    """The encoding that the first bytes of a log tell; a character that the end cuts in two counts as whole."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if head.startswith(mark):
            return name
    try:
        codecs.getincrementaldecoder("utf-8")().decode(head)
    except UnicodeDecodeError:
        return "cp949"
    return "utf-8"


def encodings(spark: SparkSession, path: str | list[str]) -> dict[str, list[str]]:
    """The files that path names, by encoding. The driver reads the head of each, no more."""
    jvm = spark.sparkContext._jvm
    out: dict[str, list[str]] = {}
    for name in sorted(spark.read.text(path).inputFiles()):
        place = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(name))
        file = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(place)
        try:
            head = bytes(file.readNBytes(HEAD))
        finally:
            file.close()
        out.setdefault(encoding_of(head), []).append(name)
    return out


def read_log(spark: SparkSession, path: str | list[str], strict: bool = False) -> DataFrame:
    """Lines of logs, split over tasks by Spark, with their number from 1 in each file.

    trace is the file's name. Logs in CP949 are split too, as no character of it
    holds the byte of a line end; their lines are decoded in Arrow batches.
    So are those in UTF-16, see _wide_lines. Bytes further on that are no UTF-8
    become U+FFFD, or with strict are an error.
    """
    found = encodings(spark, path)
    parts = []
    if plain := found.get("utf-8"):
        text = F.validate_utf8("value") if strict else F.make_valid_utf8("value")
        parts.append(_numbered(spark, plain, F.regexp_replace(text, r"^\x{FEFF}|\r\z", "")))
    if other := found.get("cp949"):
        parts.append(_decoded_lines(_numbered(spark, other, F.col("value").cast("binary")), "cp949"))
    for encoding in WIDE:
        if wide := found.get(encoding):
            parts.append(_wide_lines(spark, wide, encoding))
    if not parts:
        return spark.createDataFrame([], "trace string, line_no long, line string")
    return reduce(DataFrame.unionByName, parts)


def _decoded_lines(lines: DataFrame, encoding: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(line=[bytes(x).decode(encoding, "replace").removesuffix("\r") for x in batch["line"]])

    return lines.mapInPandas(run, "trace string, line_no long, line string")


def _numbered(spark: SparkSession, path: str | list[str], line: Column) -> DataFrame:
    """The lines of files with their numbers; line is made from the column value.

    A line's place is its split and its place within it. Numbers count up from
    each split's first; only the splits' sizes, one row each, are scanned in
    order.
    """
    rows = spark.read.option("lineSep", "\n").text(path)
    rows = rows.select(F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__start"), F.monotonically_increasing_id().alias("__at"), line.alias("line"))
    sizes = rows.groupBy("__file", "__start").agg(F.count("*").alias("n"), F.min("__at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("__file").orderBy("__start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = sizes.select(F.col("__file").alias("f"), F.col("__start").alias("s"), "first", before.alias("before"))
    out = rows.join(splits, (F.col("__file") == F.col("f")) & (F.col("__start") == F.col("s")))
    # rows of one split have consecutive ids: a task reads it alone or after others, in order
    return out.select(F.element_at(F.split("__file", "/"), -1).alias("trace"), (F.col("__at") - F.col("first") + F.col("before") + 1).alias("line_no"), "line")


def _wide_lines(spark: SparkSession, paths: list[str], encoding: str) -> DataFrame:
    """The lines of UTF-16 logs with their numbers, from any splits of the files.

    A split's reader looks for the two bytes of a line end at any place, so it
    can take the second byte of one unit and the first of the next for one. What
    it cuts there has an odd number of bytes. Whether a piece begins in the middle of a
    unit is told by the odd pieces before it in its file: their number in
    each split is scanned in order, one row a split, and within a split by a
    window. A piece that does is put back to the one before it; as a rule there
    are none, and then no lines are grouped.
    """
    rows = spark.read.option("encoding", WIDE[encoding]).option("lineSep", "\n").text(paths)
    rows = rows.select(F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__start"), F.monotonically_increasing_id().alias("__at"), F.col("value").cast("binary").alias("raw"))
    odd = (F.octet_length("raw") % 2).cast("long")
    sizes = rows.groupBy("__file", "__start").agg(F.count("*").alias("n"), F.sum(odd).alias("odd"), F.min("__at").alias("first"))
    earlier = Window.partitionBy("__file").orderBy("__start").rowsBetween(Window.unboundedPreceding, -1)
    splits = sizes.select(F.col("__file").alias("f"), F.col("__start").alias("s"), "first", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in ("n", "odd")], F.sum("odd").over(Window.partitionBy("__file")).alias("odds"))
    found = rows.join(splits, (F.col("__file") == F.col("f")) & (F.col("__start") == F.col("s")))
    found = found.select("__file", "__start", "raw", (F.col("__at") - F.col("first") + F.col("n_before")).alias("place"), "odd_before", "odds")
    whole = found.filter("odds = 0").select("__file", (F.col("place") + 1).alias("line_no"), "raw")
    name = F.element_at(F.split("__file", "/"), -1).alias("trace")
    if sizes.agg(F.sum("odd")).first()[0]:
        whole = whole.unionByName(_put_back(found.filter("odds > 0"), odd, encoding))
    lines = _decoded_lines(whole.select(name, "line_no", F.col("raw").alias("line")), encoding)
    return lines.withColumn("line", F.regexp_replace("line", r"^\x{FEFF}", ""))


def _put_back(pieces: DataFrame, odd: Column, encoding: str) -> DataFrame:
    """The lines of files that have pieces cut in the middle of a unit."""
    before = Window.partitionBy("__file", "__start").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("inside", (F.col("odd_before") + F.coalesce(F.sum(odd).over(before), F.lit(0))) % 2)
    ends = pieces.groupBy("__file", "__start").agg(F.sum(1 - F.col("inside")).alias("lines"))
    earlier = Window.partitionBy("__file").orderBy("__start").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(F.col("__file").alias("f"), F.col("__start").alias("s"), F.coalesce(F.sum("lines").over(earlier), F.lit(0)).alias("lines_before"))
    upto = Window.partitionBy("__file", "__start").orderBy("place")
    pieces = pieces.join(ends, (F.col("__file") == F.col("f")) & (F.col("__start") == F.col("s"))).withColumn("line_no", F.col("lines_before") + F.sum(1 - F.col("inside")).over(upto))
    cut = "\n".encode(encoding).hex().upper()
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", F.hex("raw").alias("h")))), lambda p: p["h"]), cut)
    return pieces.groupBy("__file", "line_no").agg(F.unhex(joined).alias("raw"))


def read_encoded(spark: SparkSession, path: str | list[str], encoding: str | None = None) -> DataFrame:
    """Lines of logs in another encoding: a file is decoded by one task, so only for files that fit one.

    Without encoding: UTF-8 where the file is that, else CP949, the usual one of
    such logs, with what it lacks replaced.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, raw in zip(batch["path"], batch["content"]):
                text = decoded(bytes(raw), encoding)
                lines = text.split("\n")
                if lines and not lines[-1]:
                    lines.pop()
                yield pd.DataFrame({"trace": name.rsplit("/", 1)[-1], "line_no": range(1, len(lines) + 1), "line": [x.removesuffix("\r") for x in lines]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "trace string, line_no long, line string")


def decoded(raw: bytes, encoding: str | None = None) -> str:
    if encoding:
        return raw.decode(encoding, "replace")
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("cp949", "replace")
