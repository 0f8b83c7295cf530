"""Traces that grow: a part is derived from the state that the parts before left, without their rows.

The state of a trace is small and at rest as rows: its order, its queue depth,
the last events that later rows look back to, requests that are open, and
for block events the issues that count as outstanding.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import COMPLETE, SEND
from ..sources.temp import materialised
from .derive import PAIR, Carried, events_with_state, state_marks
from .order import BUCKET, BUCKET_ROWS, HEAD, KEY, TRACE, ordered

_PLACE = f"struct<{KEY}:double,seq:bigint,time:double>"
_OP = {"ufs": "tag long, opcode string", "block": "sector long, __op string"}
MARKS = f"{TRACE} string, rows long, sorted boolean, last_seq long, last_time double, top_time double, qd long, busy {_PLACE}, done {_PLACE}, idle double, next struct<end:bigint,op:string>"
LISTED = f"{TRACE} string, sector long, __op string, size long"


def at_rest(spark: SparkSession, kind: str) -> Carried:
    """The state before any row."""
    return Carried(spark.createDataFrame([], MARKS), spark.createDataFrame([], f"{TRACE} string, {_OP[kind]}, since double"), spark.createDataFrame([], LISTED) if kind == "block" else None)


def order_flags(part: DataFrame, state: Carried, strict_order: bool = False) -> DataFrame:
    """(trace, sorted) of a part's traces: a trace keeps the order that it has.

    ValueError where the part would change rows derived before: lines not
    behind those there are, a time before the latest of a trace put in order
    of time, or time that runs backwards among a trace's first HEAD rows when
    some of these were taken in line order already. Such traces must be derived anew as a whole.
    """
    known = state.marks.select(F.col(TRACE).alias("__t"), "rows", F.col("sorted").alias("__sorted"), "last_seq", "last_time", "top_time")
    rows = part.select(TRACE, "seq", "time").join(known, F.col(TRACE) == F.col("__t"), "left").drop("__t")
    first = Window.partitionBy(TRACE).orderBy("seq")
    # a fixed bound first, so that tasks keep that many rows of a trace and no more
    top = rows.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= HEAD).filter(F.col("n") <= HEAD - F.coalesce("rows", F.lit(0)))
    back = F.col("time") < F.coalesce(F.lag("time").over(first), F.col("last_time"))
    backs = top.select(TRACE, F.coalesce(back, F.lit(False)).alias("back")).groupBy(F.col(TRACE).alias("__b")).agg(F.max("back").alias("back"))
    ends = rows.groupBy(TRACE).agg(*[F.first(c).alias(c) for c in ("rows", "__sorted", "last_seq", "top_time")], F.min("seq").alias("low_seq"), F.min("time").alias("low_time"))
    told = materialised(ends.join(backs, F.col(TRACE) == F.col("__b"), "left").withColumn("back", F.coalesce("back", F.lit(False))))
    new = F.col("rows").isNull()
    wrong = ~new & ((F.col("low_seq") <= F.col("last_seq")) | (F.col("__sorted") & (F.col("low_time") < F.col("top_time"))) | (~F.col("__sorted") & (F.lit(strict_order) | F.col("back"))))
    bad = [r[0] for r in told.filter(wrong).select(TRACE).limit(5).collect()]
    if bad:
        raise ValueError(f"a part does not follow what was derived of {', '.join(map(str, bad))}")
    return told.select(TRACE, F.when(new, F.lit(strict_order) | F.col("back")).otherwise(F.col("__sorted")).alias("sorted"))


def resume(part: DataFrame, kind: str, state: Carried, bucket_rows: int | None = BUCKET_ROWS, strict_order: bool = False, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> tuple[DataFrame, Carried]:
    """The rows of the table of a kind (ufs or block) that a part adds, and the state after it.

    Parts in the order of a trace's lines give together what derive gives of
    all lines at once. A part is read several times, and the derived rows once for
    each table of the state; keep, given these rows, may persist them.
    """
    if kind not in PAIR:
        raise ValueError("requests are whole rows whose depth later ones can change; derive them at once")
    flags = order_flags(part, state, strict_order)
    rows, single = ordered(part, bucket_rows=bucket_rows, flags=flags)
    rows = keep(events_with_state(rows, single, kind, state))
    return rows.drop("__op", KEY, BUCKET), _after(part, rows, kind, state, flags)


def _after(part: DataFrame, rows: DataFrame, kind: str, state: Carried, flags: DataFrame) -> Carried:
    at = F.struct(BUCKET, KEY, "seq")
    seen = part.groupBy(TRACE).agg(F.count("*").alias("rows"), F.max("seq").alias("last_seq"), F.max_by("time", "seq").alias("last_time"), F.max("time").alias("top_time"))
    marks = state_marks(kind)
    last = rows.groupBy(F.col(TRACE).alias("__l")).agg(F.max_by("qd", at).alias("qd"), *[F.max_by(v, F.when(v.isNotNull(), at)).alias(k) for k, v in marks.items()])
    place = [F.when(F.col(c).isNotNull(), F.struct(F.col(f"{c}.{KEY}").alias(KEY), F.col(f"{c}.seq").alias("seq"), F.col(f"{c}.time").alias("time"))).alias(c) for c in ("busy", "done")]
    new = seen.join(flags.select(F.col(TRACE).alias("__f"), "sorted"), F.col(TRACE) == F.col("__f")).join(last, F.col(TRACE) == F.col("__l"), "left")
    new = new.select(TRACE, "rows", "sorted", "last_seq", "last_time", "top_time", "qd", *place, "idle", "next")
    fields = [f for f in new.columns if f != TRACE]
    old = state.marks.select(F.col(TRACE).alias("__t"), *[F.col(c).alias(f"__{c}") for c in fields])
    both = new.join(old, F.col(TRACE) == F.col("__t"), "full_outer")

    def kept(c: str) -> Column:
        if c == "rows":
            return F.coalesce(c, F.lit(0)) + F.coalesce("__rows", F.lit(0))
        return F.greatest(c, "__top_time") if c == "top_time" else F.coalesce(c, f"__{c}")

    marks_after = both.select(F.coalesce(TRACE, "__t").alias(TRACE), *[kept(c).alias(c) for c in fields])

    two = rows.filter(F.col("action").isin(SEND[kind], COMPLETE[kind]))
    sent = F.when(F.col("last.action") == SEND[kind], F.col("last.time"))
    opened = _replaced(two.groupBy(TRACE, *PAIR[kind]).agg(F.max_by(F.struct("action", "time"), at).alias("last")).withColumn("since", sent).drop("last"), state.open, (TRACE, *PAIR[kind]), "since")
    listed = None
    if kind == "block":
        keys = (TRACE, "sector", "__op", "size")
        now = two.groupBy(*keys).agg(F.when(F.max_by("action", at) == SEND[kind], True).alias("since"))
        listed = _replaced(now, state.listed.withColumn("since", F.lit(True)), keys, "since").drop("since")
    return Carried(marks_after, opened, listed)


def _replaced(new: DataFrame, old: DataFrame, keys: tuple[str, ...], value: str) -> DataFrame:
    """Rows of new, and those of old whose keys new does not have; without those whose value is null."""
    names = [f"__o{i}" for i in range(len(keys))]
    same = None
    for c, n in zip(keys, names):
        one = F.col(c).eqNullSafe(F.col(n))
        same = one if same is None else same & one
    rest = old.select(*keys, value).join(new.select(*[F.col(c).alias(n) for c, n in zip(keys, names)]), same, "left_anti")
    return new.select(*keys, value).filter(F.col(value).isNotNull()).unionByName(rest)
