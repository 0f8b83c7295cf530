"""Trace tables at rest, a catalog of logs, and what clears them away."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.order import limits_of, slice_of
from ..schema import ADDRESS, TABLES, TIME

#: Rows of a file and the text in a file's name that tells its kind, the longer one first.
FILE_ROWS = 4_000_000
#: Binary digits of a time's and of an address's slice on the curve of the layout zoom.
CURVE_BITS = 8
NAMES = {"ufscustom": "cus", "ufs": "ufs", "block": "block"}


def save(df: DataFrame, folder: str, kind: str, mode: str = "append", codec: str = "snappy", layout: str = "time", group_rows: int | None = None) -> None:
    """df under folder/kind, a folder per trace. What is read back is the same for any layout; ranges skip other files and row groups.

    layout time: in order of time within files. layout zoom: in order of a curve
    through cells of time and address, so that a range on the address alone skips
    about as much as one on time. group_rows: rows of a row group, where Parquet's own size is too coarse.
    """
    if df.isEmpty():
        raise ValueError("a trace without rows is not saved")
    columns = [c.split()[0] for c in TABLES[kind].split(", ")]
    rows = df.select(*columns)
    order = ["trace", TIME[kind], "seq"]
    if layout == "zoom":
        rows, order = on_curve(rows, kind), ["trace", "__curve", TIME[kind], "seq"]
    elif layout != "time":
        raise ValueError(f"no layout {layout}")
    rows = rows.repartitionByRange(*order[:-1]).sortWithinPartitions(*order).select(*columns)
    writer = rows.write.mode(mode).option("compression", codec).option("maxRecordsPerFile", FILE_ROWS).option("partitionOverwriteMode", "dynamic").partitionBy("trace")
    if group_rows:
        writer = writer.option("parquet.block.row.count.limit", group_rows)
    writer.parquet(f"{folder}/{kind}")


def on_curve(rows: DataFrame, kind: str, bits: int = CURVE_BITS) -> DataFrame:
    """rows with __curve: the place of its cell of (time, address) on a Z-order curve.

    A trace has 2^bits slices of time and as many of the address with about as
    many rows each, so that neither a burst nor a hot region fills a cell; an address that
    very many rows share is one slice, put in order of time within it. Limits of a trace are one row.
    """
    axes = {"__x": F.col(TIME[kind]), "__y": F.col(ADDRESS[kind]).cast("double")}
    places = rows.select("trace", *[v.alias(k) for k, v in axes.items()])
    limits = places.groupBy(F.col("trace").alias("__t")).agg(*[F.array_distinct(limits_of(k, 1 << bits)).alias(f"{k}_limits") for k in axes])
    out = rows.join(limits, F.col("trace") == F.col("__t"))
    x, y = (slice_of(v, F.col(f"{k}_limits")) for k, v in axes.items())
    out = out.withColumn("__x", x).withColumn("__y", y)
    bit = [F.shiftleft(F.shiftright(c, b).bitwiseAND(F.lit(1).cast("long")), 2 * b + n) for n, c in enumerate((F.col("__x"), F.col("__y"))) for b in range(bits)]
    return out.withColumn("__curve", reduce(lambda p, q: p.bitwiseOR(q), bit)).drop("__t", "__x", "__y", "__x_limits", "__y_limits")


def load(spark: SparkSession, folder: str, kind: str, traces: list[str] | None = None) -> DataFrame:
    """The table of a kind; traces picks folders, which the others' files are never opened for."""
    df = spark.read.schema(TABLES[kind]).parquet(f"{folder}/{kind}")
    return df.filter(F.col("trace").isin(traces)) if traces is not None else df


def kind_of(path: str) -> str | None:
    """The kind that a file's name tells, None for no trace table."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    return next((k for text, k in NAMES.items() if text in name), None) if name.endswith(".parquet") else None


def paths_by_kind(paths: str) -> dict[str, list[str]]:
    """A list of paths with commas by the kinds that they tell; blanks and other files are left out."""
    out: dict[str, list[str]] = {}
    for p in (x.strip() for x in paths.split(",")):
        if p and (kind := kind_of(p)):
            out.setdefault(kind, []).append(p)
    return out


def _in_order(df: DataFrame) -> DataFrame:
    """df with __seq: a row's place in its file and the rows of the files before. One number for each file is scanned in order."""
    rows = df.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    sizes = rows.groupBy("__file").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    told = sizes.select(F.col("__file").alias("__f"), before.alias("__before"))
    return rows.join(told, F.col("__file") == F.col("__f")).withColumn("__seq", F.col("__before") + F.col("__row")).select(*df.columns, "__seq")


def load_files(spark: SparkSession, paths: list[str], kind: str) -> DataFrame:
    """Tables of one kind in files of others, all rows of all of them, as one trace each.

    Where a file has no seq, the order of its rows is; in a folder files count
    in the order of their names. Unsigned numbers become longs; a sector that
    stands for none is 0.
    """
    wanted = [tuple(c.split()) for c in TABLES[kind].split(", ")]

    def one(path: str) -> DataFrame:
        df = spark.read.parquet(path)
        have = set(df.columns)
        if "seq" not in have:
            df = _in_order(df)
        if missing := [c for c, _ in wanted if c not in have and c not in ("trace", "seq")]:
            raise ValueError(f"{path} lacks {', '.join(missing)}")
        out = []
        for c, t in wanted:
            if c == "trace":
                out.append((F.col(c) if c in have else F.lit(path.rstrip("/").rsplit("/", 1)[-1])).alias(c))
            elif c == "seq":
                out.append((F.col(c) if c in have else F.col("__seq")).alias(c))
            elif c in ("sector", "lba"):
                out.append(F.coalesce(F.col(c).try_cast(t), F.lit(0).cast("long")).alias(c))
            else:
                out.append(F.col(c).cast(t).alias(c))
        return df.select(*out)

    return reduce(DataFrame.unionByName, [one(p) for p in paths])


def union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def lengths(tables: dict[str, DataFrame]) -> DataFrame:
    """(kind, n) of each table; a count reads no column."""
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n") for k, df in tables.items()])


def footer_lengths(spark: SparkSession, folder: str, kinds: list[str], traces: bool = False) -> DataFrame:
    """(kind, n) of tables at rest, or (kind, trace, n), from the footers of their files: the count is pushed into the scan, no column is read.

    That needs Parquet's second reader, which a session of its own is set to; the caller's is left as it is.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.sources.useV1SourceList", "")
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    by = ["trace"] if traces else []
    return reduce(DataFrame.unionByName, [load(own, folder, k).groupBy(*by).agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), *by, "n") for k in kinds])


def shown_kinds(counts: DataFrame) -> DataFrame:
    return counts.filter("n > 0").select("kind")


def file_system(spark: SparkSession, path: str) -> tuple:
    """A path and the file system that it is on."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


class Versions:
    """Versions of something under a folder, each a name that is written once: who writes a number first has it.

    Stores that create a file only where there is none decide between writers;
    a local disk looks first and creates then, so there writers of one moment can still meet.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def last(self) -> tuple[int, str]:
        """The highest number and its name; 0 and an empty name before the first."""
        at, fs = file_system(self.spark, self.folder)
        found = sorted(f.getPath().getName() for f in fs.listStatus(at) if f.getPath().getName().startswith("commit-")) if fs.exists(at) else []
        return (int(found[-1].removeprefix("commit-")), self.name(int(found[-1].removeprefix("commit-")))) if found else (0, "")

    def name(self, number: int) -> str:
        at, fs = file_system(self.spark, f"{self.folder}/commit-{number:012d}")
        for _ in range(100):
            file = fs.open(at)
            try:
                text = bytes(file.readNBytes(4096)).decode()
            finally:
                file.close()
            if text.endswith("\n"):
                return text.strip()
            time.sleep(0.05)
        raise OSError(f"{at.toString()} was not written to its end")

    def claim(self, number: int, name: str) -> bool:
        """Makes name the version of that number, unless there is one."""
        at, fs = file_system(self.spark, f"{self.folder}/commit-{number:012d}")
        try:
            file = fs.create(at, False)
        except Py4JJavaError:
            if fs.exists(at):
                return False
            raise
        try:
            file.write(bytearray(f"{name}\n".encode()))
        finally:
            file.close()
        return True


class Catalog:
    """A small Parquet table of logs: id, name, path, kind, folder. Each change writes a new version of it.

    Of two writers who start from the same version one is first; the other reads again what that one wrote and makes its change to it.
    """

    SCHEMA = "id long, name string, path string, kinds string, folder string"

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.versions = Versions(spark, self.path)

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(f"{self.path}/{name}") if name else self.spark.createDataFrame([], self.SCHEMA)

    def table(self) -> DataFrame:
        """The newest version, by id from the newest."""
        return self._read(self.versions.last()[1]).orderBy(F.desc("id"))

    def _change(self, change: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Writes what change makes of the newest version, and returns what that was."""
        while True:
            number, name = self.versions.last()
            old, fresh = self._read(name), f"v{uuid.uuid4().hex}"
            change(old).coalesce(1).write.parquet(f"{self.path}/{fresh}")
            if self.versions.claim(number + 1, fresh):
                return old
            delete_paths(self.spark, [f"{self.path}/{fresh}"])

    def add(self, name: str, path: str, kinds: str, folder: str) -> int:
        def added(old: DataFrame) -> DataFrame:
            last = old.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"))
            return old.unionByName(last.select((F.col("last") + 1).alias("id"), *[F.lit(v).alias(c) for c, v in (("name", name), ("path", path), ("kinds", kinds), ("folder", folder))]))

        return (self._change(added).agg(F.max("id")).first()[0] or 0) + 1

    def update(self, log_id: int, **values: str) -> None:
        self._change(lambda old: old.withColumns({c: F.when(F.col("id") == log_id, F.lit(v)).otherwise(F.col(c)) for c, v in values.items()}))

    def delete(self, ids: list[int]) -> None:
        self._change(lambda old: old.filter(~F.col("id").isin(ids)))


def delete_paths(spark: SparkSession, paths: list[str]) -> list[str]:
    """Deletes files and folders; blanks and what is not there are passed over. Returns those that could not be deleted."""
    bad = []
    for p in (x.strip() for x in paths):
        if not p:
            continue
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if fs.exists(hadoop) and not fs.delete(hadoop, True):
            bad.append(p)
    return bad


def clean_catalog(catalog: Catalog, max_age_hours: float) -> int:
    """clean_up in the folders of all logs of the catalog."""
    folders = sorted({r["folder"] for r in catalog.table().select("folder").distinct().collect() if r["folder"]})
    return clean_up(catalog.spark, folders, max_age_hours)


def clean_up(spark: SparkSession, folders: list[str], max_age_hours: float, prefix: str = "trace_temp_") -> int:
    """Deletes temporary files named prefix... that are older than max_age_hours, in folders and their own folders. Returns how many."""
    done, oldest = 0, (time.time() - max_age_hours * 3600) * 1000
    for folder in folders:
        for glob in (f"{folder}/{prefix}*", f"{folder}/*/{prefix}*"):
            hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(glob)
            fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
            for status in fs.globStatus(hadoop) or []:
                if status.getModificationTime() <= oldest and fs.delete(status.getPath(), True):
                    done += 1
    return done
