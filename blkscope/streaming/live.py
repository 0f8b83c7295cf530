"""A log that grows: parsing as it comes, derivation with a state per trace, and figures per interval.

Parsing has no state, so it is the same expression as in batch. Derivation
keeps for every trace what later rows look back to: queue depth, last complete,
start of the busy span, previous send, and the requests that are open, in
the state store of the query, so a restart goes on where the checkpoint ends.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..schema import COMPLETE, EVENTS, MS, SEND, TABLES, UNIT_BYTES
from ..sources.parse import ROWS, groups_of
from ..sources.patterns import Registry


def stream_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of the files that come into a folder; line_no is not known while they do."""
    rows = spark.readStream.option("lineSep", "\n").text(folder)
    return rows.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("trace"), F.regexp_replace("value", r"\r\z", "").alias("line"))


def stream_parts(spark: SparkSession, folder: str, trace: str, files_at_once: int | None = None) -> DataFrame:
    """(trace, line_no, line) of the parts of one log as they come into a folder; the last number in a part's name is its place.

    line_no grows along the log, by part, split and line, but leaves numbers out. Parts must come in their order.
    """
    reader = spark.readStream.option("lineSep", "\n")
    rows = (reader.option("maxFilesPerTrigger", files_at_once) if files_at_once else reader).text(folder)
    part = F.regexp_extract(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), r"([0-9]+)[^0-9]*$", 1).try_cast("long")
    split = rows.select(F.coalesce(part, F.lit(0).cast("long")).alias("part"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.regexp_replace("value", r"\r\z", "").alias("line"))
    return split.mapInArrow(_placed, "line_no long, line string").select(F.lit(trace).alias("trace"), "line_no", "line")


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of splits as a task reads them, with a number that grows from split to split: a line is a byte at least, so the numbers of a split don't reach the next one's first."""
    last, seen = None, 0
    for batch in batches:
        numbers = []
        for part, file, start in zip(*(batch.column(i).to_pylist() for i in range(3))):
            last, seen = (file, start), (seen + 1 if (file, start) == last else 0)
            numbers.append((part << 44) + start + seen)
        yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), batch.column(3)], names=["line_no", "line"])


def stream_numbered_events(lines: DataFrame, kind: str, registry: Registry | None = None) -> DataFrame:
    """Events of one kind in the columns of schema.EVENTS as they come; seq is line_no."""
    pattern = (registry or Registry()).active_pattern(kind)
    row = ROWS[kind](groups_of(F.col("line"), pattern), pattern)
    names = [c.split()[0] for c in EVENTS[kind].split(", ")[2:]]
    return lines.select("trace", F.col("line_no").alias("seq"), row.alias("e")).filter(F.col("e").isNotNull()).select("trace", "seq", *[f"e.{c}" for c in names])


#: A trace's scalars in the state store, and the keys of its open requests and outstanding issues; the place of a time is (sorting key, line).
_SCALARS = "seq long, top double, qd long, busy double, busy_key double, busy_seq long, done double, done_key double, done_seq long, idle double, next_end long, next_op string"
_NAMES = [c.split()[0] for c in _SCALARS.split(", ")]


def _class(io_type: str) -> str:
    return {"R": "read", "W": "write", "D": "discard"}.get(io_type[:1], "other")


class _Cached:
    """A map of the state store for one batch: a key is fetched once and put back once."""

    def __init__(self, store: Any) -> None:
        self.store, self.now, self.old = store, {}, {}

    def get(self, key: tuple) -> tuple | None:
        if key not in self.now:
            self.now[key] = self.old[key] = tuple(self.store.getValue(key)) if self.store.containsKey(key) else None
        return self.now[key]

    def put(self, key: tuple, value: tuple | None) -> None:
        self.get(key)
        self.now[key] = value

    def flush(self) -> None:
        for key, value in self.now.items():
            if value is None:
                if self.old[key] is not None:
                    self.store.removeKey(key)
            elif value != self.old[key]:
                self.store.updateValue(key, value)


class Deriving(StatefulProcessor):
    """One trace's events in order, with their derived columns."""

    def __init__(self, kind: str, delay: float | None) -> None:
        self.kind, self.delay = kind, delay

    def init(self, handle: StatefulProcessorHandle) -> None:
        ufs = self.kind == "ufs"
        self.scalars = handle.getValueState("scalars", _SCALARS)
        self.open = handle.getMapState("open", "tag long, op string" if ufs else "sector long, op string", "since double")
        self.listed = None if ufs else handle.getMapState("listed", "sector long, op string, size long", "there boolean")
        self.held = None if self.delay is None else handle.getListState("held", EVENTS[self.kind])

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timer_values: Any) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in EVENTS[self.kind].split(", ")]
        new = [dict(zip(columns, r)) for frame in rows for r in frame[columns].astype(object).itertuples(index=False, name=None)]
        scalars = self.scalars.get()
        s = dict(zip(_NAMES, scalars if scalars is not None else [None] * len(_NAMES)))
        if self.delay is None:
            ready, late = self._by_line(new, s)
        else:
            ready, late = self._by_time(new, s, columns)
        out = self._derived(ready, s)
        out += [r | {c: None for c in ("qd", "dtoc", "ctoc", "ctod", "continuous")} for r in late]
        self.scalars.update(tuple(s[n] for n in _NAMES))
        if out:
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in TABLES[self.kind].split(", ")])
            yield frame.astype({c: "Int64" for c, t in (x.split() for x in TABLES[self.kind].split(", ")) if t == "long"} | {"continuous": "boolean"})

    def _by_line(self, new: list[dict], s: dict) -> tuple[list[dict], list[dict]]:
        new.sort(key=lambda r: r["seq"])
        cut = s["seq"] if s["seq"] is not None else -1
        late = [r for r in new if r["seq"] <= cut]
        ready = [r | {"__key": float(r["seq"])} for r in new if r["seq"] > cut]
        if ready:
            s["seq"] = ready[-1]["seq"]
        return ready, late

    def _by_time(self, new: list[dict], s: dict, columns: list[str]) -> tuple[list[dict], list[dict]]:
        """Rows up to the newest time less the delay, by (time, seq); what comes behind rows already given out is late."""
        released = s["top"] - self.delay if s["top"] is not None else float("-inf")
        late = [r for r in new if r["time"] <= released]
        kept = [dict(zip(columns, r)) for r in self.held.get()] + [r for r in new if r["time"] > released]
        tops = [r["time"] for r in kept]
        s["top"] = max([*tops, *([s["top"]] if s["top"] is not None else [])], default=None)
        cut = s["top"] - self.delay if s["top"] is not None else float("-inf")
        ready = sorted((r for r in kept if r["time"] <= cut), key=lambda r: (r["time"], r["seq"]))
        rest = [tuple(r[c] for c in columns) for r in kept if r["time"] > cut]
        if rest:
            self.held.put(rest)
        else:
            self.held.clear()
        return [r | {"__key": r["time"]} for r in ready], late

    def _derived(self, ready: list[dict], s: dict) -> list[dict]:
        ufs, out = self.kind == "ufs", []
        opened, listed = _Cached(self.open), None if ufs else _Cached(self.listed)
        for r in ready:
            send, complete = r["action"] == SEND[self.kind], r["action"] == COMPLETE[self.kind]
            op = r["opcode"] if ufs else _class(r["io_type"])
            time, address = r["time"], r["lba"] if ufs else r["sector"]
            if not ufs:
                if complete and r["io_type"].startswith("W") and r["size"] == 0:
                    continue
                if send or complete:
                    key = (address, op, r["size"])
                    if send and listed.get(key):
                        continue
                    listed.put(key, (True,) if send else None)
            key = (r["tag"], op) if ufs else (address, op)
            r |= {"dtoc": 0.0, "ctoc": 0.0, "ctod": 0.0, "continuous": False}
            s["qd"] = max(0, (s["qd"] or 0) + send - complete)
            if send:
                if ufs or op != "other":
                    r["continuous"] = (s["next_end"], s["next_op"]) == (address, op)
                    s["next_end"], s["next_op"] = address + r["size"], op
                opened.put(key, (time,))
                if s["qd"] == 1:
                    if s["idle"] is not None:
                        r["ctod"] = (time - s["idle"]) * MS
                    s["busy"], s["busy_key"], s["busy_seq"] = time, r["__key"], r["seq"]
            elif complete:
                if sent := opened.get(key):
                    r["dtoc"] = (time - sent[0]) * MS
                    opened.put(key, None)
                if s["busy"] is not None and (s["done"] is None or (s["busy_key"], s["busy_seq"]) > (s["done_key"], s["done_seq"])):
                    r["ctoc"] = (time - s["busy"]) * MS
                elif s["done"] is not None:
                    r["ctoc"] = (time - s["done"]) * MS
                s["done"], s["done_key"], s["done_seq"] = time, r["__key"], r["seq"]
                if s["qd"] == 0:
                    s["idle"] = time
            r["qd"] = s["qd"]
            del r["__key"]
            out.append(r)
        opened.flush()
        if listed:
            listed.flush()
        return out

    def close(self) -> None:
        pass


def stream_derive(events: DataFrame, kind: str, delay: float | None = None) -> DataFrame:
    """The table of a kind (ufs or block) as its events come, equal to what derive gives of all of them.

    delay None: rows are taken by line number; within a micro-batch they may
    stand in any order, and a line that is not behind the last one taken is late.
    With a delay, in the unit of time, rows wait until a row of their trace is so
    much newer, and are then taken by (time, seq): as derive does with
    strict_order. Here a row is late that is not newer than what was taken. A
    late row comes out with nulls in the derived columns and changes no state. The
    newest rows of a trace, up to the delay, stay in the state until newer ones come.

    A trace is one key, in one task at a time; traces run side by side. Needs
    the RocksDB state store, which this sets for the session.
    """
    if kind not in ("ufs", "block"):
        raise ValueError("requests are whole rows whose depth later ones can change; derive them in batch")
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return events.groupBy("trace").transformWithStateInPandas(statefulProcessor=Deriving(kind, delay), outputStructType=TABLES[kind], outputMode="Append", timeMode="None")


def stream_events(lines: DataFrame, kind: str, registry: Registry | None = None) -> DataFrame:
    """Events of one kind as they come."""
    pattern = (registry or Registry()).active_pattern(kind)
    row = ROWS[kind](groups_of(F.col("line"), pattern), pattern)
    return lines.select("trace", row.alias("e")).filter(F.col("e").isNotNull()).select("trace", "e.*")


def throughput(events: DataFrame, kind: str, interval: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """(trace, start, end, requests, bytes): sends per interval of the log's clock; lines later than late behind the newest are dropped by the watermark."""
    time = "start_time" if kind == "cus" else "time"
    rows = events if kind == "cus" else events.filter(F.col("action") == SEND[kind])
    clock = F.timestamp_micros((F.col(time) * 1000000).cast("long"))
    rows = rows.select("trace", clock.alias("clock"), (F.col("size") * UNIT_BYTES[kind]).alias("bytes"))
    if rows.isStreaming:
        rows = rows.withWatermark("clock", late)
    sums = rows.groupBy("trace", F.window("clock", interval).alias("w")).agg(F.count("*").alias("requests"), F.sum("bytes").alias("bytes"))
    return sums.select("trace", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "requests", "bytes")
