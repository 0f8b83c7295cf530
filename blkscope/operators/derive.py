"""Queue depth, latencies and continuity, as window expressions over buckets of a trace.

Everything here is a running sum, a running minimum or the last value before a
row, within a bucket; what the buckets before hand over (one row per bucket, or
per bucket and key) is scanned apart and joined to the bucket. Where a trace has
several buckets, these summaries and the rows they are of are written once: each
step reads the rows twice, so without that they would be computed anew twice at every step.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.units import io_class
from ..schema import COMPLETE, MS, SEND
from ..sources.temp import materialised
from .order import BUCKET, BUCKET_ROWS, HEAD, KEY, TRACE, by_order, local, ordered, sliced

PAIR = {"ufs": ("tag", "opcode"), "block": ("sector", "__op")}


@dataclass(frozen=True)
class Carried:
    """What the rows of traces so far hand on to the rows that follow them; see operators.resume, which makes it.

    marks: one row per trace with its order, its queue depth and the last events
    that later rows look back to. open: requests sent and not completed, by the
    columns of PAIR. listed: block issues that count as outstanding, by sector, class and size.
    """

    marks: DataFrame
    open: DataFrame
    listed: DataFrame | None = None


def _so_far(w: Window) -> Window:
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _before(w: Window) -> Window:
    return w.rowsBetween(Window.unboundedPreceding, -1)


def _handed(df: DataFrame, aggregates: dict[str, Column], carried: dict[str, Column], keys: tuple[str, ...] = ()) -> DataFrame:
    """df with the columns carried: expressions over a window of the earlier buckets' aggregates, joined to each row of a bucket."""
    at = (TRACE, *keys)
    summary = df.groupBy(*at, BUCKET).agg(*[v.alias(k) for k, v in aggregates.items()])
    w = _before(Window.partitionBy(*at).orderBy(BUCKET))
    names = [f"__on{i}" for i in range(len(at) + 1)]
    told = materialised(summary.select(*[F.col(c).alias(n) for c, n in zip((*at, BUCKET), names)], *[e.over(w).alias(k) for k, e in carried.items()]))
    on = [F.col(c).eqNullSafe(F.col(n)) for c, n in zip((*at, BUCKET), names)]
    condition = on[0]
    for c in on[1:]:
        condition = condition & c
    return df.join(told, condition).drop(*names)


def queue_depth(df: DataFrame, step: Column, out: str, single: bool, more: tuple[str, ...] = (), initial: Column | None = None) -> DataFrame:
    """df with out: the sum of steps so far that is never let below zero, the row's own step included. initial: what a trace begins with, the same on all its rows; zero where it is null."""
    begin = F.lit(0) if initial is None else F.coalesce(initial, F.lit(0))
    w = _so_far(local(more=more))
    df = df.withColumn("__step", step).withColumn("__sum", F.sum("__step").over(w))
    df = df.withColumn("__low", F.min("__sum").over(w))
    if single:
        return df.withColumn(out, begin + F.col("__sum") - F.least(F.lit(0), begin + F.col("__low"))).drop("__step", "__sum", "__low")
    df = materialised(df)
    earlier = _before(Window.partitionBy(TRACE).orderBy(BUCKET))
    summary = df.groupBy(TRACE, BUCKET).agg(F.sum("__step").alias("s"), F.min("__low").alias("m"), F.max(begin).alias("i"))
    summary = summary.withColumn("c", F.col("i") + F.coalesce(F.sum("s").over(earlier), F.lit(0)))
    summary = summary.withColumn("cm", F.coalesce(F.min(F.col("c") + F.col("m")).over(earlier), F.lit(0)))
    told = materialised(summary.select(F.col(TRACE).alias("__t"), F.col(BUCKET).alias("__b"), "c", "cm"))
    df = df.join(told, (F.col(TRACE) == F.col("__t")) & (F.col(BUCKET) == F.col("__b")))
    lowest = F.least(F.lit(0), F.col("cm"), F.col("c") + F.col("__low"))
    return df.withColumn(out, F.col("c") + F.col("__sum") - lowest).drop("__step", "__sum", "__low", "__t", "__b", "c", "cm")


def last_before(df: DataFrame, values: dict[str, Column], single: bool, keys: tuple[str, ...] = (), more: tuple[str, ...] = (), initial: dict[str, Column] | None = None) -> DataFrame:
    """df with a column for each of values: the last that was not null on an earlier row of the trace (and keys). initial: what stands for it where there is none."""
    w = local(*keys, more=more)
    for name, value in values.items():
        df = df.withColumn(f"__v_{name}", value)
    if not single:
        order = F.struct(*by_order(*more))
        df = _handed(
            df,
            {f"__m_{n}": F.max_by(F.col(f"__v_{n}"), F.when(F.col(f"__v_{n}").isNotNull(), order)) for n in values},
            {f"__c_{n}": F.last(F.col(f"__m_{n}"), ignorenulls=True) for n in values},
            keys,
        )
    for name in values:
        own = F.last(F.col(f"__v_{name}"), ignorenulls=True).over(_before(w))
        known = [own, *([] if single else [F.col(f"__c_{name}")]), *([initial[name]] if initial else [])]
        df = df.withColumn(name, F.coalesce(*known))
    return df.drop(*[f"__{k}_{n}" for k in "vc" for n in values])


def _events(df: DataFrame, kind: str) -> tuple[Column, Column]:
    return F.col("action") == SEND[kind], F.col("action") == COMPLETE[kind]


def dedup_block(df: DataFrame, bucket_rows: int | None = BUCKET_ROWS, strict_order: bool = False) -> DataFrame:
    """Block events without completes of writes of size 0 and without issues of a (sector, class, size) that is outstanding."""
    return _dedup(*ordered(df, head=_head(strict_order), bucket_rows=bucket_rows)).drop(KEY, BUCKET)


def _dedup(rows: DataFrame, single: bool, start: Carried | None = None) -> DataFrame:
    issue, complete = _events(rows, "block")
    flush = complete & F.col("io_type").startswith("W") & (F.col("size") == 0)
    rows = rows.filter(~flush).withColumn("__op", io_class(F.col("io_type"))).withColumn("__two", issue | complete)
    keys = ("sector", "__op", "size", "__two")
    if start is None:
        rows = last_before(rows, {"__previous": F.col("action")}, single, keys)
    else:
        rows = _looked_up(rows, start.listed.withColumn("since", F.lit(SEND["block"])), keys[:3], "__since")
        rows = last_before(rows, {"__previous": F.col("action")}, single, keys, initial={"__previous": F.when(F.col("__two"), F.col("__since"))}).drop("__since")
    again = issue & F.coalesce(F.col("__previous") == SEND["block"], F.lit(False))
    return rows.filter(~again).drop("__op", "__two", "__previous")


def _looked_up(rows: DataFrame, table: DataFrame, keys: tuple[str, ...], out: str) -> DataFrame:
    """rows with out: the column since of the table's row of the same trace and keys, of which there is one at most."""
    names = [f"__on{i}" for i in range(len(keys) + 1)]
    told = table.select(*[F.col(c).alias(n) for c, n in zip((TRACE, *keys), names)], F.col("since").alias(out))
    same = F.col(TRACE) == F.col(names[0])
    for c, n in zip(keys, names[1:]):
        same = same & F.col(c).eqNullSafe(F.col(n))
    return rows.join(told, same, "left").drop(*names)


def _head(strict_order: bool) -> int | None:
    return None if strict_order else HEAD


def derive(df: DataFrame, kind: str, bucket_rows: int | None = BUCKET_ROWS, strict_order: bool = False) -> DataFrame:
    """The table of a kind: its events with qd, latencies in ms (0.0 where there is none) and continuous, in any row order.

    ufs and block: df has the columns of schema.EVENTS that this needs; block
    events are deduplicated first. cus: one row per request. A second event at
    the same time comes after the first in line order. strict_order: a trace is
    sorted by time wherever in it time runs backwards, not only among its first
    rows. No rows: no rows.
    """
    if kind == "cus":
        return _derive_requests(df, bucket_rows, strict_order)
    rows = events_with_state(*ordered(df, head=_head(strict_order), bucket_rows=bucket_rows), kind)
    return rows.drop("__op", KEY, BUCKET)


def events_with_state(rows: DataFrame, single: bool, kind: str, start: Carried | None = None) -> DataFrame:
    """The derived columns of ordered ufs or block events, with __op, __key and __bucket; from start on where that is given."""
    if kind == "block":
        rows = _dedup(rows, single, start)
    send, complete = _events(rows, kind)
    address = "lba" if kind == "ufs" else "sector"
    op = F.col("opcode") if kind == "ufs" else io_class(F.col("io_type"))
    if start is not None:
        before = [F.struct(F.lit(-1).cast("long").alias(BUCKET), F.col(f"{c}.{KEY}").alias(KEY), F.col(f"{c}.seq").alias("seq"), F.col(f"{c}.time").alias("time")) for c in ("busy", "done")]
        marks = start.marks.select(F.col(TRACE).alias("__t"), F.col("qd").alias("__qd0"), *[F.when(F.col(c).isNotNull(), p).alias(f"__{c}0") for c, p in zip(("busy", "done"), before)], F.col("idle").alias("__idle0"), F.col("next").alias("__next0"))
        rows = rows.join(marks, F.col(TRACE) == F.col("__t"), "left").drop("__t")
    rows = queue_depth(rows, F.when(send, 1).when(complete, -1).otherwise(0).cast("long"), "qd", single, initial=None if start is None else F.col("__qd0"))

    # starts of busy spans, completes, completes that end a busy span, and sends that continuity looks at
    rows = rows.withColumn("__op", op).withColumn("__two", send | complete)
    marks = state_marks(kind)
    rows = last_before(rows, {f"__{k}": v for k, v in marks.items()}, single, initial=None if start is None else {f"__{k}": F.col(f"__{k}0") for k in marks})
    since = F.when(F.col("__done").isNull() | (F.col("__busy") > F.col("__done")), F.col("__busy.time")).otherwise(F.col("__done.time"))
    since = F.coalesce(since, F.col("__done.time"))
    rows = rows.withColumn("ctoc", F.coalesce(F.when(complete, (F.col("time") - since) * MS), F.lit(0.0)))
    rows = rows.withColumn("ctod", F.coalesce(F.when(send & (F.col("qd") == 1), (F.col("time") - F.col("__idle")) * MS), F.lit(0.0)))
    counted = send if kind == "ufs" else send & (F.col("__op") != "other")
    follows = (F.col(address) == F.col("__next.end")) & (F.col("__op") == F.col("__next.op"))
    rows = rows.withColumn("continuous", F.coalesce(counted & follows, F.lit(False)))

    # the previous send or complete of the same request
    pair = {"__pair": F.when(F.col("__two"), F.struct("action", "time"))}
    if start is None:
        rows = last_before(rows, pair, single, (*PAIR[kind], "__two"))
    else:
        rows = _looked_up(rows, start.open, PAIR[kind], "__sent")
        sent = F.when(F.col("__two") & F.col("__sent").isNotNull(), F.struct(F.lit(SEND[kind]).alias("action"), F.col("__sent").alias("time")))
        rows = last_before(rows, pair, single, (*PAIR[kind], "__two"), initial={"__pair": sent}).drop("__sent")
    paired = complete & (F.col("__pair.action") == SEND[kind])
    rows = rows.withColumn("dtoc", F.when(paired, (F.col("time") - F.col("__pair.time")) * MS).otherwise(0.0)).drop("__pair", "__two")
    return rows.drop("__busy", "__done", "__idle", "__next", "__qd0", "__busy0", "__done0", "__idle0", "__next0")


def state_marks(kind: str) -> dict[str, Column]:
    """What later rows of a trace look back to, each as a column that is null on rows that don't set it; over rows with qd and __op."""
    send, complete = F.col("action") == SEND[kind], F.col("action") == COMPLETE[kind]
    place = F.struct(BUCKET, KEY, "seq", "time")
    counted = send if kind == "ufs" else send & (F.col("__op") != "other")
    end = F.col("lba" if kind == "ufs" else "sector") + F.col("size")
    return {
        "busy": F.when(send & (F.col("qd") == 1), place),
        "done": F.when(complete, place),
        "idle": F.when(complete & (F.col("qd") == 0), F.col("time")),
        "next": F.when(counted, F.struct(end.alias("end"), F.col("__op").alias("op"))),
    }


def _derive_requests(df: DataFrame, bucket_rows: int | None, strict_order: bool) -> DataFrame:
    rows, single = ordered(df, "start_time", _head(strict_order), bucket_rows)

    # queue depth over starts and ends in order of time; ties by line, a request's start before its end
    ends = df.select(TRACE, F.col("seq").alias("request"), F.explode(F.array(F.struct(F.col("start_time").alias("time"), F.lit(0).alias("end")), F.struct(F.col("end_time").alias("time"), F.lit(1).alias("end")))).alias("e"))
    ends = ends.select(TRACE, F.col("request").alias("seq"), "request", "e.time", "e.end")
    ends, one = sliced(ends.withColumn(KEY, F.col("time")), bucket_rows)
    depth = queue_depth(ends, F.when(F.col("end") == 0, 1).otherwise(-1).cast("long"), "depth", one, ("end",))
    depth = depth.groupBy(F.col(TRACE).alias("__t"), F.col("request").alias("__r")).agg(F.max(F.when(F.col("end") == 0, F.col("depth"))).alias("start_qd"), F.max(F.when(F.col("end") == 1, F.col("depth"))).alias("end_qd"))
    rows = rows.join(depth, (F.col(TRACE) == F.col("__t")) & (F.col("seq") == F.col("__r"))).drop("__t", "__r")
    rows = rows if single else materialised(rows)

    rows = last_before(rows, {"__last": F.struct("end_time", (F.col("lba") + F.col("size")).alias("end"), "opcode"), "__idle": F.when(F.col("end_qd") == 0, F.col("end_time"))}, single)
    rows = rows.withColumn("dtoc", (F.col("end_time") - F.col("start_time")) * MS)

    def gap(to: Column, since: Column) -> Column:
        return F.coalesce(F.greatest(F.lit(0.0), (to - since) * MS), F.lit(0.0))

    rows = rows.withColumn("ctoc", F.when(F.col("__last").isNull(), 0.0).otherwise(gap(F.col("end_time"), F.col("__last.end_time"))))
    gone = F.when(F.col("start_qd") == 1, F.col("__idle")).otherwise(F.col("__last.end_time"))
    rows = rows.withColumn("ctod", F.when(gone.isNull(), 0.0).otherwise(gap(F.col("start_time"), gone)))
    follows = (F.col("lba") == F.col("__last.end")) & (F.col("opcode") == F.col("__last.opcode"))
    return rows.withColumn("continuous", F.coalesce(follows, F.lit(False))).drop("__last", "__idle", KEY, BUCKET)
