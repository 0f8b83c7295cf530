"""Line patterns: the built-in ones, a registry, their translation for Spark, and a tester."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

# The patterns of the three kinds of lines, and the names that their groups must have.
UFS = r"^\s*(?P<process>.*?)\s+\[(?P<cpu>[0-9]+)\].*?(?P<time>[0-9]+\.[0-9]+):\s+ufshcd_command:\s+(?P<command>send_req|complete_rsp):.*?tag:\s*(?P<tag>\d+).*?size:\s*(?P<size>[-]?\d+).*?LBA:\s*(?P<lba>\d+).*?opcode:\s*(?P<opcode>0x[0-9a-f]+).*?group_id:\s*0x(?P<group_id>[0-9a-f]+).*?hwq_id:\s*(?P<hwq_id>[-]?\d+)"
BLOCK = r"^\s*(?P<process>.*?)\s+\[(?P<cpu>\d+)\]\s+(?P<flags>.+?)\s+(?P<time>[\d\.]+):\s+(?P<action>\S+):\s+(?P<devmajor>\d+),(?P<devminor>\d+)\s+(?P<io_type>[A-Z]+)(?:\s+(?P<extra>\d+))?\s+\(\)\s+(?P<sector>\d+)\s+\+\s+(?P<size>\d+)(?:\s+\S+)?\s+\[(?P<comm>.*?)\]$"
CUS = r"^(?P<opcode>0x[0-9a-f]+),(?P<lba>\d+),(?P<size>\d+),(?P<start_time>\d+(?:\.\d+)?),(?P<end_time>\d+(?:\.\d+)?)$"
GROUPS = {
    "ufs": ("process", "cpu", "time", "command", "tag", "size", "lba", "opcode", "group_id", "hwq_id"),
    "block": ("process", "cpu", "flags", "time", "action", "devmajor", "devminor", "io_type", "extra", "sector", "size", "comm"),
    "cus": ("opcode", "lba", "size", "start_time", "end_time"),
}
DEFAULTS = {"ufs": ("Default UFS Pattern", UFS), "block": ("Default Block Pattern", BLOCK), "cus": ("Default UFS Custom Pattern", CUS)}

_NAMED = re.compile(r"\(\?P?<([A-Za-z_]\w*)>")


def for_spark(pattern: str) -> tuple[str, dict[str, int]]:
    """The pattern with plain groups for regexp_extract, and the number of each named group.

    (?d) lets a dot match a carriage return, and $ becomes the end of the text.
    """
    numbers: dict[str, int] = {}
    out, at, count, in_class = [], 0, 0, False
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            out.append(pattern[at : at + 2])
            at += 2
            continue
        if in_class:
            in_class = c != "]"
        elif c == "[":
            in_class = True
        elif c == "$":
            c = r"\z"
        elif m := _NAMED.match(pattern, at):
            count += 1
            numbers[m[1]] = count
            out.append("(")
            at = m.end()
            continue
        elif c == "(" and pattern[at + 1 : at + 2] != "?":
            count += 1
        out.append(c)
        at += 1
    return "(?d)" + "".join(out), numbers


@dataclass
class Registry:
    """Patterns by kind and name, one of each kind active. Names are replaced when added again; the active one can't be deleted."""

    patterns: dict[str, dict[str, str]] = field(default_factory=lambda: {k: {n: p} for k, (n, p) in DEFAULTS.items()})
    active: dict[str, str] = field(default_factory=lambda: {k: n for k, (n, _) in DEFAULTS.items()})

    def _of(self, kind: str) -> dict[str, str]:
        if kind not in self.patterns:
            raise ValueError(f"kind {kind!r} is none of {', '.join(self.patterns)}")
        return self.patterns[kind]

    def add(self, name: str, kind: str, pattern: str) -> None:
        re.compile(pattern)
        if missing := [g for g in GROUPS[kind] if g not in for_spark(pattern)[1] and g != "extra"] if kind in GROUPS else []:
            raise ValueError(f"no group named {', '.join(missing)}")
        self._of(kind)[name] = pattern

    def activate(self, name: str, kind: str) -> None:
        if name not in self._of(kind):
            raise KeyError(name)
        self.active[kind] = name

    def delete(self, name: str, kind: str) -> None:
        if self.active[kind] == name:
            raise ValueError("the active pattern can't be deleted")
        del self._of(kind)[name]

    def list(self, kind: str | None = None) -> dict[str, dict[str, str]]:
        return {k: dict(v) for k, v in self.patterns.items() if kind in (None, k)}

    def active_pattern(self, kind: str) -> str:
        return self._of(kind)[self.active[kind]]

    def to_table(self, spark: SparkSession) -> DataFrame:
        rows = [(n, k, p, self.active[k] == n) for k, own in self.patterns.items() for n, p in own.items()]
        return spark.createDataFrame(rows, "name string, kind string, pattern string, is_active boolean")

    @classmethod
    def from_table(cls, table: DataFrame) -> Registry:
        """From a table as to_table makes it; kinds that it lacks keep their default."""
        out = cls()
        for r in table.collect():
            out.add(r["name"], r["kind"], r["pattern"])
            if r["is_active"]:
                out.activate(r["name"], r["kind"])
        return out


def test_pattern(lines: DataFrame, pattern: str, column: str = "line") -> DataFrame:
    """(line, matched, whole, captures, named) for each line that is not blank. Named groups need Python's re, in Arrow batches."""
    compiled = re.compile(pattern)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [compiled.search(x) for x in batch["line"]]
            yield pd.DataFrame(
                {
                    "line": batch["line"],
                    "matched": [m is not None for m in found],
                    "whole": [m[0] if m else None for m in found],
                    "captures": [list(m.groups()) if m else [] for m in found],
                    "named": [{k: v for k, v in m.groupdict().items() if v is not None} if m else {} for m in found],
                }
            )

    rows = lines.selectExpr(f"`{column}` AS line").filter("trim(line) != ''")
    return rows.mapInPandas(run, "line string, matched boolean, whole string, captures array<string>, named map<string,string>")


test_pattern.__test__ = False  # type: ignore[attr-defined]


class MatchLine:
    """A table function (pattern, line): one row with matched, whole, captures and a column for each named group.

    A pattern that is none gives the column error alone, with what is wrong, so that it can be shown like a result.
    """

    @staticmethod
    def analyze(pattern: AnalyzeArgument, line: AnalyzeArgument) -> AnalyzeResult:
        if not isinstance(pattern.value, str):
            raise ValueError("the pattern must be a constant string")
        try:
            groups = sorted(re.compile(pattern.value).groupindex.items(), key=lambda x: x[1])
        except re.error:
            return AnalyzeResult(StructType().add("error", StringType()))
        schema = StructType().add("matched", BooleanType()).add("whole", StringType()).add("captures", ArrayType(StringType()))
        for name, _ in groups:
            schema = schema.add(f"{name}_" if name in ("matched", "whole", "captures") else name, StringType())
        return AnalyzeResult(schema)

    def __init__(self) -> None:
        self.pattern, self.compiled = None, None

    def eval(self, pattern: str, line: str) -> Iterator[tuple]:
        if self.pattern != pattern:
            self.pattern = pattern
            try:
                self.compiled = re.compile(pattern)
            except re.error as e:
                self.compiled = str(e)
        if isinstance(self.compiled, str):
            yield (self.compiled,)
            return
        m = self.compiled.search(line) if line is not None else None
        names = [n for n, _ in sorted(self.compiled.groupindex.items(), key=lambda x: x[1])]
        yield (m is not None, m[0] if m else None, list(m.groups()) if m else [], *[m[n] if m else None for n in names])


def register_match_line(spark: SparkSession, name: str = "match_line") -> str:
    """Makes the table function known to SQL: SELECT t.* FROM lines, LATERAL match_line('(?P<a>x)', line) t."""
    spark.udtf.register(name, udtf(MatchLine))
    return name


def matched_lines(lines: DataFrame, pattern: str, column: str = "line") -> DataFrame:
    """line and the columns of MatchLine for each line that is not blank; for a pattern that is none, line and error."""
    spark = lines.sparkSession
    name = register_match_line(spark)
    rows = lines.selectExpr(f"`{column}` AS line").filter("trim(line) != ''")
    return spark.sql(f"SELECT l.line, t.* FROM {{rows}} l, LATERAL {name}(:pattern, l.line) t", args={"pattern": pattern}, rows=rows)
