"""Logs that are ingested part by part: each part is read once, derived from the state at rest, and added to the tables."""

from __future__ import annotations

import json
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import resume as R
from ..operators.derive import PAIR, Carried
from ..sources import parse, store
from ..sources.patterns import Registry
from ..sources.text import read_log


class GrowingLog:
    """One log under a folder of trace tables, and what its next part is derived from.

    Every part is a version: its rows and the state after it are written aside,
    then the version is claimed, then its files are moved into the tables. Whatever breaks
    off before the claim has left nothing; what breaks off after it is moved
    when the log is opened again. Who claims second has derived from an old state and gets an error.
    """

    def __init__(self, spark: SparkSession, folder: str, trace: str, registry: Registry | None = None, strict_order: bool = False) -> None:
        self.spark, self.folder, self.trace, self.registry, self.strict_order = spark, folder.rstrip("/"), trace, registry, strict_order
        self.own = f"{self.folder}/_grown/{trace}"
        self.versions = store.Versions(spark, self.own)

    def _at(self) -> tuple[int, dict]:
        number, told = self.versions.last()
        return number, json.loads(told) if told else {"at": "", "lines": 0, "kinds": []}

    def state(self, kind: str) -> Carried:
        """The state after the last part."""
        _, told = self._at()
        none = R.at_rest(self.spark, kind)
        if kind not in told["kinds"]:
            return none
        tables = [self.spark.read.schema(t.schema).parquet(f"{self.own}/{told['at']}/{kind}/{n}") if t is not None else None for n, t in zip(("marks", "open", "listed"), (none.marks, none.open, none.listed))]
        return Carried(*tables)

    def add(self, path: str | list[str], strict: bool = False) -> DataFrame:
        """Ingests the next part, one file or several in the order of their names; returns (trace, kind, n) of it, lines of no kind as missing.

        Line numbers go on from part to part. ValueError if the part holds
        requests, or does not follow what there is (see resume.order_flags). Kinds the part lacks keep their state.
        """
        self.publish()
        number, told = self._at()
        lines = read_log(self.spark, path, strict)
        sizes = lines.groupBy(F.col("trace").alias("file")).agg(F.max("line_no").alias("n"))
        before = sizes.select("file", (F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + told["lines"]).alias("before"), "n")
        lines = lines.join(before, F.col("trace") == F.col("file")).select(F.lit(self.trace).alias("trace"), (F.col("line_no") + F.col("before")).alias("line_no"), "line")
        held: list[DataFrame] = []

        def keep(df: DataFrame) -> DataFrame:
            held.append(df.persist(StorageLevel.MEMORY_AND_DISK))
            return df

        found = keep(parse.parsed(lines, self.registry))
        try:
            counts = parse.kind_counts(found)
            rows = counts.collect()
            kinds = {r["kind"] for r in rows}
            if "cus" in kinds:
                raise ValueError("requests are whole rows whose depth later ones can change; ingest such a log at once")
            fresh = f"v{uuid.uuid4().hex}"
            for kind in PAIR:
                if kind in kinds:
                    made, after = R.resume(parse.events(found, kind), kind, self.state(kind), strict_order=self.strict_order, keep=keep)
                    if not made.isEmpty():  # all may be events that deduplication drops
                        store.save(made, f"{self.own}/{fresh}/rows", kind, "overwrite")
                elif kind in told["kinds"]:
                    after = self.state(kind)
                else:
                    continue
                for name, table in (("marks", after.marks), ("open", after.open), ("listed", after.listed)):
                    if table is not None:
                        table.write.parquet(f"{self.own}/{fresh}/{kind}/{name}")
            last = found.agg(F.max("line_no")).first()[0] or told["lines"]
        finally:
            for df in held:
                df.unpersist()
        said = {"at": fresh, "lines": last, "kinds": sorted({k for k in PAIR if k in kinds} | set(told["kinds"]))}
        if not self.versions.claim(number + 1, json.dumps(said)):
            store.delete_paths(self.spark, [f"{self.own}/{fresh}"])
            raise RuntimeError(f"another part of {self.trace} was added meanwhile")
        self.publish()
        return self.spark.createDataFrame(rows, counts.schema)

    def publish(self) -> None:
        """Moves the rows of the last version into the tables; a file that is gone was moved before."""
        number, told = self._at()
        if not number:
            return
        for kind in PAIR:
            at, fs = store.file_system(self.spark, f"{self.own}/{told['at']}/rows/{kind}")
            if not fs.exists(at):
                continue
            files = fs.listFiles(at, True)
            while files.hasNext():
                file = files.next().getPath()
                if not file.getName().endswith(".parquet"):
                    continue
                target, _ = store.file_system(self.spark, f"{self.folder}/{kind}/{file.getParent().getName()}/part-{number:06d}-{file.getName()}")
                fs.mkdirs(target.getParent())
                if not fs.rename(file, target):
                    raise OSError(f"{file.toString()} could not be moved")
            fs.delete(at, True)
