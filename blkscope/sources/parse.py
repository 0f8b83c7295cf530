"""Lines to typed rows: one regular expression match per line and kind.

The match writes all groups of a line into one delimited string, which becomes
an array. Arrays, and then the typed rows, are handed on through inline(), so
that Catalyst does not copy the match into each column that is made from it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import EVENTS, KINDS
from .patterns import Registry, for_spark

# Addresses that stand for none.
DEBUG_LBA, LARGEST_LBA, NO_SECTOR = 2305843009213693951, 1 << 48, "18446744073709551615"
UINT32, INT32 = (1 << 32) - 1, 1 << 31

#: A line of a kind has this in it; saves the other patterns' work. Patterns of one's own may do without.
MARKS = {"ufs": "ufshcd_command", "block": "()", "cus": ","}

#: Parts the groups of a match. In a line it counts as U+FFFD.
BETWEEN, INSTEAD = "\x01", "\ufffd"


def _uint(text: Column, largest: int = UINT32) -> Column:
    """Digits as a long if they are in range, else null."""
    return F.when(text.rlike(r"^\+?[0-9]{1,18}$"), F.when(text.cast("long") <= largest, text.cast("long")))


def groups_of(line: Column, pattern: str) -> Column:
    """An empty string and then the named groups in the order of the pattern if the pattern is found in the line, else an array of one."""
    plain, numbers = for_spark(pattern)
    flags, body = plain[:4], plain[4:]
    replacement = "".join(f"{BETWEEN}${n}" for n in numbers.values())
    return F.split(F.regexp_replace(F.translate(line, BETWEEN, INSTEAD), rf"{flags}\A.*?(?:{body}).*\z", replacement), BETWEEN)


def _fields(found: Column, pattern: str) -> tuple[Column, dict[str, Column]]:
    names = list(for_spark(pattern)[1])
    return F.size(found) == len(names) + 1, {name: F.get(found, F.lit(k + 1)) for k, name in enumerate(names)}


def ufs_row(found: Column, pattern: str) -> Column:
    """The event of a match as groups_of gives it, or null. A size is bytes, kept in units of 4 KB; a negative hwq_id or a number out of range rejects the line."""
    fits, f = _fields(found, pattern)
    size = F.when(f["size"].rlike(r"^-?[0-9]{1,10}$"), f["size"].cast("long"))
    size = F.when((size < INT32) & (size >= -INT32), F.floor(F.abs(size) / 4096).cast("long"))
    lba = F.coalesce(F.when(f["lba"].rlike(r"^[0-9]{1,18}$"), f["lba"].cast("long")), F.lit(0).cast("long"))
    group = F.regexp_extract(f["group_id"], r"^0*([0-9a-f]{0,8})$", 1)
    group = F.when(f["group_id"].rlike(r"^0*[0-9a-f]{1,8}$"), F.conv(F.concat(F.lit("0"), group), 16, 10).cast("long"))
    row = F.struct(
        f["time"].try_cast("double").alias("time"), f["process"].alias("process"), _uint(f["cpu"]).alias("cpu"), f["command"].alias("action"), _uint(f["tag"]).alias("tag"), f["opcode"].alias("opcode"),
        F.when((lba == DEBUG_LBA) | (lba > LARGEST_LBA), 0).otherwise(lba).alias("lba"), size.alias("size"), group.alias("groupid"), _uint(f["hwq_id"]).alias("hwqid"),
    )
    return _whole(fits, row, ("time", "cpu", "tag", "size", "groupid", "hwqid"))


def block_row(found: Column, pattern: str) -> Column:
    """The event of a match, or null. No extra is 0; a sector that stands for none, or that is no number, is 0."""
    fits, f = _fields(found, pattern)
    sector = F.when(f["sector"] == NO_SECTOR, 0).otherwise(F.coalesce(F.when(f["sector"].rlike(r"^[0-9]{1,18}$"), f["sector"].cast("long")), F.lit(0)))
    extra = _uint(f["extra"]) if "extra" in f else F.lit(None).cast("long")
    row = F.struct(
        f["time"].try_cast("double").alias("time"), f["process"].alias("process"), _uint(f["cpu"]).alias("cpu"), f["flags"].alias("flags"), f["action"].alias("action"), _uint(f["devmajor"]).alias("devmajor"), _uint(f["devminor"]).alias("devminor"),
        f["io_type"].alias("io_type"), F.coalesce(extra, F.lit(0)).alias("extra"), sector.cast("long").alias("sector"), _uint(f["size"]).alias("size"), f["comm"].alias("comm"),
    )
    return _whole(fits, row, ("time", "cpu", "devmajor", "devminor", "size"))


def cus_row(found: Column, pattern: str) -> Column:
    """The request of a match, or null. Numbers out of range are 0."""
    fits, f = _fields(found, pattern)

    def number(name: str, largest: int) -> Column:
        return F.coalesce(_uint(f[name], largest), F.lit(0)).cast("long")

    row = F.struct(
        f["opcode"].alias("opcode"), number("lba", (1 << 62)).alias("lba"), number("size", UINT32).alias("size"),
        F.coalesce(f["start_time"].try_cast("double"), F.lit(0.0)).alias("start_time"), F.coalesce(f["end_time"].try_cast("double"), F.lit(0.0)).alias("end_time"),
    )
    return _whole(fits, row, ())


def _whole(fits: Column, row: Column, needed: tuple[str, ...]) -> Column:
    for name in needed:
        fits = fits & row[name].isNotNull()
    return F.when(fits, row)


ROWS = {"ufs": ufs_row, "block": block_row, "cus": cus_row}


def parsed(lines: DataFrame, registry: Registry | None = None) -> DataFrame:
    """(trace, line_no, kind, ufs, block, cus): the kind of each line and its row; kind is null for a line that fits none, and for a blank one.

    A line is tried as a request, then as a ufs and then as a block event, until
    its numbers are right too.
    """
    registry = registry or Registry()
    line, found = F.col("line"), {}
    for kind in KINDS:
        mark = MARKS[kind] if registry.active[kind] in registry.list(kind)[kind] and registry.active[kind].startswith("Default ") else None
        own = groups_of(line, registry.active_pattern(kind))
        found[kind] = F.when(line.contains(mark), own) if mark else own
    matched = lines.select("trace", "line_no", F.inline(F.array(F.struct(*[found[k].alias(k) for k in KINDS]))))
    rows = F.struct(*[ROWS[k](F.col(k), registry.active_pattern(k)).alias(k) for k in KINDS])
    tried = matched.select("trace", "line_no", F.inline(F.array(rows)))
    kind = F.when(F.col("cus").isNotNull(), "cus").when(F.col("ufs").isNotNull(), "ufs").when(F.col("block").isNotNull(), "block")
    return tried.select("trace", "line_no", kind.alias("kind"), *KINDS)


def events(found: DataFrame, kind: str) -> DataFrame:
    """The rows of one kind in the columns of schema.EVENTS; seq is the line number."""
    columns = [c.split()[0] for c in EVENTS[kind].split(", ")[2:]]
    return found.filter(F.col("kind") == kind).select("trace", F.col("line_no").alias("seq"), *[F.col(f"{kind}.{c}").alias(c) for c in columns])


def missing_lines(found: DataFrame, most: int = 1000) -> DataFrame:
    """(trace, line_no) of lines that are of no kind: the first most of each trace, and one row 0 if there are more.

    The report is a list for people, hence its limit; missing_counts has the number.
    """
    w = Window.partitionBy("trace").orderBy("line_no")
    none = found.filter(F.col("kind").isNull()).select("trace", "line_no")
    first = none.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= most).select("trace", "line_no")
    more = missing_counts(found).filter(F.col("n") > most).select("trace", F.lit(0).cast("long").alias("line_no"))
    return first.unionByName(more)


def missing_counts(found: DataFrame) -> DataFrame:
    return found.filter(F.col("kind").isNull()).groupBy("trace").agg(F.count("*").alias("n"))


def kind_counts(found: DataFrame) -> DataFrame:
    """(trace, kind, n), lines of no kind as missing."""
    return found.groupBy("trace", F.coalesce("kind", F.lit("missing")).alias("kind")).agg(F.count("*").alias("n"))
