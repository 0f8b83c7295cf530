"""WARC archives: a writer with revisit records and a reader that splits gzip files.

A reading task gets a range of bytes. It looks for gzip magic there, takes a
place for a member's start only if decoding yields a WARC header, and owns the
records that start inside its range, also where they end beyond it.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as SpanWindow
from pyspark.sql import functions as F

from .common import new_path, text_of, written

MAGIC, VERSION = b"\x1f\x8b\x08", b"WARC/1."
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
ROW = "urn:row:"
READ = 1 << 20


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(row_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One gzip member: a response with its payload, or a revisit without."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{ROW}{'' if row_id is None else row_id}>",
        f"WARC-Target-URI: {' '.join((url or '').split())}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{ROW}{refers_to}>"] if revisit else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    raw = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def write_warc(rows: DataFrame, folder: str, file_bytes: int = 64 << 20) -> DataFrame:
    """Archives of rows (id, url, payload, refers_to) in folder; a table of their (path, bytes, records).

    A file gets its final name when it is whole, and only files of tasks that
    ended well are in the table, so a task that runs twice does no harm.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        done: list[tuple[str, int, int]] = []
        out, name, size, n = None, "", 0, 0
        for batch in batches:
            for k in range(batch.num_rows):
                if out is None:
                    name, size, n = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(f"{base}/{name}.part", compression=None)
                row_id, url, payload, refers_to = (batch.column(c)[k].as_py() for c in range(4))
                member = record(row_id, url, payload, refers_to)
                out.write(member)
                size, n = size + len(member), n + 1
                if size >= file_bytes:
                    out.close()
                    fs.move(f"{base}/{name}.part", f"{base}/{name}")
                    done.append((f"{folder}/{name}", size, n))
                    out = None
        if out is not None:
            out.close()
            fs.move(f"{base}/{name}.part", f"{base}/{name}")
            done.append((f"{folder}/{name}", size, n))
        yield pa.RecordBatch.from_pydict({"path": pa.array([x[0] for x in done], pa.string()), "bytes": pa.array([x[1] for x in done], pa.int64()), "records": pa.array([x[2] for x in done], pa.int64())})

    return written(rows.select("id", "url", "payload", "refers_to").mapInArrow(run, "path string, bytes long, records long"), "warc-files")


class Window:
    """Bytes of a file from a place on, read as they are asked for and given back behind."""

    def __init__(self, file: pa.NativeFile, at: int) -> None:
        self.file, self.at, self.data = file, at, b""
        file.seek(at)

    def more(self) -> bool:
        got = self.file.read(READ)
        self.data += got
        return bool(got)

    def drop(self, n: int) -> None:
        self.data, self.at = self.data[n:], self.at + n


def member(window: Window) -> tuple[bytes | None, int] | None:
    """The content of the gzip member at the window's start and its compressed length; None if there is none or it is no WARC record.

    A member that begins as a record and can't be decoded to its end has the content None.
    """
    unpack, parts, total, used = zlib.decompressobj(31), [], 0, 0
    while True:
        if used >= len(window.data) and not window.more():
            return (None, 0) if total >= len(VERSION) else None
        try:
            got = unpack.decompress(memoryview(window.data)[used:])
        except zlib.error:
            return (None, 0) if total >= len(VERSION) or _begins(window.data) else None
        used = len(window.data) - len(unpack.unused_data)
        if got:
            parts.append(got)
            total += len(got)
        if total >= len(VERSION):
            if len(parts) > 1 and len(parts[0]) < len(VERSION):
                parts = [b"".join(parts)]
            if not parts[0].startswith(VERSION):
                return None
        if unpack.eof:
            return (b"".join(parts), used) if total >= len(VERSION) else None


def _begins(data: bytes) -> bool:
    """Whether what can be decoded of a damaged member begins as a record; a few bytes at a time, as an error gives back nothing."""
    unpack, out, rest = zlib.decompressobj(31), b"", data
    try:
        while rest and len(out) < len(VERSION):
            out += unpack.decompress(rest[:64], len(VERSION))
            rest = unpack.unconsumed_tail + rest[64:]
    except zlib.error:
        pass
    return out.startswith(VERSION)


def members_in(fs: pyarrow.fs.FileSystem, path: str, start: int, end: int) -> Iterator[tuple[int, int, bytes | None]]:
    """(place, length, content) of the members of a file that start from start to before end and begin as records; content None: damaged."""
    with fs.open_input_file(path) as file:
        window = Window(file, start)
        while window.at < end:
            at = window.data.find(MAGIC)
            if at < 0:
                window.drop(max(0, len(window.data) - len(MAGIC) + 1))
                if not window.more():
                    return
                continue
            if window.at + at >= end:
                return
            window.drop(at)
            found = member(window)
            if found is None:
                window.drop(1)
                continue
            yield window.at, found[1], found[0]
            window.drop(found[1] or 1)


def records_in(fs: pyarrow.fs.FileSystem, path: str, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(place, content) of the whole members among members_in."""
    return ((at, content) for at, _, content in members_in(fs, path, start, end) if content is not None)


def records_of(content: bytes) -> Iterator[tuple[dict[str, str], bytes, int]]:
    """parsed, for each of the records of a member one after the other."""
    while content:
        head, _, rest = content.partition(b"\r\n\r\n")
        fields, payload, stated = parsed(content)
        size = int(fields.get("content-length", 0))
        if not head.startswith(VERSION) or size > len(rest):
            raise ValueError("a member holds something behind its records, or less than a record states")
        yield fields, payload, stated
        content = rest[size:].lstrip(b"\r\n")


def parsed(content: bytes) -> tuple[dict[str, str], bytes, int]:
    """Header fields in lower case, the payload, and the length that the HTTP header states."""
    head, _, rest = content.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
    block = rest[: int(fields.get("content-length", 0))]
    if not fields.get("content-type", "").startswith("application/http"):
        return fields, block, len(block)
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = [int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    return fields, payload, stated[0] if stated else len(payload)


def _row(urn: str) -> int | None:
    tail = urn.strip("<>").removeprefix(ROW)
    return int(tail) if tail.lstrip("-").isdigit() else None


def read_warc(files: DataFrame, split_bytes: int = 8 << 20, tasks: int | None = None, payloads: bool = False) -> DataFrame:
    """One row per record of the archives in files (path, bytes): path, start, record_type, row_id, refers_to_id, url, payload_bytes, payload_digest, payload.

    The digest of a response is computed from what was read and must be the one
    in its header; that of a revisit is the header's. payload is null unless
    payloads. Archives without records, and no archives, give no rows; gzip members of
    other content are passed over.

    A range that begins inside a record may find a whole record in that one's
    payload. What was found is put in order of place for each archive, and what lies within
    another is no record. ValueError for a record that is cut off or damaged and
    for bytes between records that are not whole gzip members, so nothing is lost unseen.
    """
    spark = files.sparkSession
    ranges = files.filter("bytes > 0").select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long"))).alias("start"))
    ranges = ranges.select("path", "start", F.least(F.col("start") + split_bytes, F.col("bytes")).alias("end"))
    ranges = ranges.repartition(tasks or int(spark.conf.get("spark.sql.shuffle.partitions")), "path", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, end in zip(*(c.to_pylist() for c in batch.columns)):
                fs, place = pyarrow.fs.FileSystem.from_uri(path)
                rows: list[tuple] = []
                held = 0
                for at, length, fields, payload, stated in _each(fs, place, start, end):
                    if fields is None:
                        rows.append((path, at, DAMAGED, None, None, None, 0, None, None, None))
                        continue
                    kind = fields.get("warc-type", "")
                    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
                    if kind == "response" and payload_digest(payload) != digest:
                        raise ValueError(f"{path} at {at}: the payload does not have the digest of its header")
                    size = stated if kind == "revisit" else len(payload)
                    rows.append((path, at, kind, _row(fields.get("warc-record-id", "")), _row(fields.get("warc-refers-to", "")), fields.get("warc-target-uri"), size, digest, payload if payloads else None, at + length))
                    held += len(payload)
                    if held > 16 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), TYPES)], names=NAMES)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), TYPES)], names=NAMES)

    found = written(ranges.mapInArrow(run, "path string, start long, record_type string, row_id long, refers_to_id long, url string, payload_bytes long, payload_digest string, payload binary, stop long"), "warc-records")
    spans = found.groupBy("path", "start").agg(F.max("stop").alias("stop"))
    reach = F.coalesce(F.max("stop").over(SpanWindow.partitionBy("path").orderBy("start").rowsBetween(SpanWindow.unboundedPreceding, -1)), F.lit(0))
    spans = written(spans.withColumn("reach", reach), "warc-spans")
    damaged = spans.filter("stop IS NULL AND start >= reach").orderBy("path", "start").first()
    if damaged:
        raise ValueError(f"{damaged['path']} at {damaged['start']}: a record is cut off or damaged")
    ends = files.filter("bytes > 0").join(spans.groupBy(F.col("path").alias("p")).agg(F.max("stop").alias("last")), F.col("path") == F.col("p"), "left")
    gaps = spans.filter("start > reach").select("path", F.col("reach").alias("start"), F.col("start").alias("end"))
    gaps = gaps.unionByName(ends.select("path", F.coalesce("last", F.lit(0)).cast("long").alias("start"), F.col("bytes").alias("end")).filter("end > start"))
    written(gaps.mapInArrow(_checked, "path string"), "warc-gaps")
    inner = spans.filter("start < reach").select("path", "start")
    return found.join(inner, ["path", "start"], "left_anti").drop("stop")


def _each(fs: pyarrow.fs.FileSystem, place: str, start: int, end: int) -> Iterator[tuple[int, int, dict[str, str] | None, bytes, int]]:
    for at, length, content in members_in(fs, place, start, end):
        if content is None:
            yield at, 0, None, b"", 0
        else:
            for fields, payload, stated in records_of(content):
                yield at, length, fields, payload, stated


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nothing, if the bytes (path, start, end) are whole gzip members; else an error."""
    for batch in batches:
        for path, start, end in zip(*(c.to_pylist() for c in batch.columns)):
            fs, place = pyarrow.fs.FileSystem.from_uri(path)
            with fs.open_input_file(place) as file:
                file.seek(start)
                left, unpack, data = end - start, zlib.decompressobj(31), b""
                try:
                    while left or data:
                        if not data:
                            data = file.read(min(left, READ))
                            left = left - len(data) if data else 0
                        unpack.decompress(data)
                        data = unpack.unused_data
                        if unpack.eof and (left or data):
                            unpack = zlib.decompressobj(31)
                except zlib.error:
                    unpack = None
            if unpack is None or not unpack.eof:
                raise ValueError(f"{path} from {start} to {end}: bytes that are no whole gzip member")
        yield pa.RecordBatch.from_arrays([pa.array([], pa.string())], names=["path"])


DAMAGED = "damaged"
NAMES = ["path", "start", "record_type", "row_id", "refers_to_id", "url", "payload_bytes", "payload_digest", "payload", "stop"]
TYPES = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.int64()]


def with_revisits(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 0) -> DataFrame:
    """Rows (id, url, payload, refers_to) for write_warc.

    Of equal payloads of at least least_bytes, rows with the largest key are
    responses and the others refer to it; smaller payloads and rows with a
    null key are responses. Only digests and keys are grouped; payloads move
    once, to their row's answer.
    """
    rows = pages.select(F.col(key).cast("long").alias("id"), F.col(url).cast("string").alias("url"), F.encode(text_of(payload), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    light = rows.filter((F.octet_length("payload") >= least_bytes) & F.col("id").isNotNull()).groupBy("digest", "id").agg(F.lit(1).alias("one"))
    light = written(light.select("digest", "id"), "payload-digests")
    last = written(light.groupBy("digest").agg(F.max("id").alias("last")), "payload-last")  # apart, so that the join can split a large group
    answers = light.join(last, "digest").filter("id < last").select("id", "digest", F.col("last").alias("refers_to"))
    return rows.join(answers, ["id", "digest"], "left").select("id", "url", "payload", "refers_to")


def warc_round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 0) -> DataFrame:
    """Writes a record per page and reads the archives back: key, payload_bytes, payload_digest, record_type, refers_to, url.

    Repeated rows give a record each, a null payload is an empty one, no rows
    give none. It is an error if not as many records are read as were written.
    """
    folder = new_path(pages.sparkSession, "warc")
    folder = folder if "://" in folder else f"file://{folder}"
    files = write_warc(with_revisits(pages, key, url, payload, least_bytes), folder)
    read = read_warc(files)
    wrote, found = files.agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0], read.count()
    if wrote != found:
        raise ValueError(f"{wrote} records were written and {found} read")
    return read.select(F.col("row_id").alias(key), "payload_bytes", "payload_digest", "record_type", F.col("refers_to_id").alias("refers_to"), "url")


def list_archives(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, bytes) of the files that a glob names, without reading them."""
    return spark.read.format("binaryFile").load(pattern).select("path", F.col("length").alias("bytes"))
