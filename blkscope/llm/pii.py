"""Personal data: fixed patterns by kind, and identifiers that the contexts of these tell, in DataFrame operations only.

What the fixed patterns match are the seeds. A seed's neighbouring words are
lexical patterns; patterns and the identifier-like values that stand in them are
a graph. A pattern is as good as the share of its different values that are known
to be of a kind, a value as good as the best pattern that it stands in, and both
are scored in turn, so that a value told by one pattern speaks for others. What stands in
a pattern of high confidence and looks like its kind is found, though no fixed pattern matches it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of, unused, written

# Kinds in order. The patterns match what the ones of the contract do; where a run of characters can't match
# from its start it can't from within, so looking behind and giving nothing back keep them linear in any text.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a kind's pattern to be tried.
HINT = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}", "phone": r"\+[0-9]"}
_PART = "0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"

#: What looks like an identifier: written-out or bracketed addresses, dotted numbers with bracketed dots, long addresses, and
#: numbers of four digits or more. Those of none of the kinds count as values that speak against a pattern.
_AT, _DOT = r"(?:@|\s?[\[({]\s?(?:at|AT)\s?[\])}]\s?|\x20at\x20)", r"(?:\.|\s?[\[({]\s?(?:dot|DOT)\s?[\])}]\s?|\x20dot\x20)"
EMAILISH = rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++{_AT}[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)++"
IPISH = r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\.)[0-9]{1,3}){3}(?![0-9])|(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])"
NUMBERISH = r"(?<![A-Za-z0-9])\+?\(?[0-9](?:[\x20()./-]{0,2}[0-9]){3,}+"
LOOSE = f"{EMAILISH}|{IPISH}|{NUMBERISH}"
AT_HINT = r"(?i)[\[({\x20]\s?at\s?[\])}\x20]"

#: Characters before and behind in which context words are looked for, rounds of scoring, different values that a pattern
#: needs and that are added to its share's divisor, and the score from which a pattern is believed.
REACH, ROUNDS, SUPPORT, DOUBT, BELIEVED = 48, 3, 5, 1.0, 0.75

SPANS = "array<struct<start:int,no:int,end:int>>"

#: Matches whose places are added up in one go; longer lists are added up piece by piece.
PIECE = 128


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 0, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    return (n > 0) & (F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0)


def _good(kind: str, value: Column) -> Column:
    """Whether a match of a kind's pattern counts."""
    n = F.length(_digits(value))
    if kind == "ip":
        return value.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        return (n <= 19) & luhn(_digits(value))
    return n.between(10, 15) if kind == "phone" else F.lit(True)


def with_matches(rows: DataFrame, out: str, pattern: str, hint: Column, text: str = "text") -> DataFrame:
    """rows with out: [(gap, own, value, before, behind, start)] of a pattern's matches from the left, none in another; null without any.

    start counts code points from 0. It comes from the lengths of the matches and
    of what lies between them; PIECE at a time are added up, so that a text of very many matches costs not their square.
    """
    v, g, m, p = (f"{x}_{out}" for x in "vgmp")
    rows = rows.withColumn(v, F.when(hint, F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)))).withColumn(g, F.when(F.size(v) > 0, F.split(F.col(text), pattern, -1)))

    def told(value: Column, i: Column) -> Column:
        gap = F.get(g, i)
        return F.struct(F.length(gap).alias("gap"), F.length(value).alias("own"), value.alias("value"), F.right(gap, F.lit(REACH)).alias("before"), F.left(F.get(g, i + 1), F.lit(REACH)).alias("behind"))

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0), lambda acc, x: acc + x["gap"] + x["own"])

    rows = rows.withColumn(m, F.when(F.col(g).isNotNull(), F.transform(v, told)))
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.size(m) - 1) / PIECE).cast("int")), lambda i: total(F.slice(m, i * PIECE + 1, F.lit(PIECE))))
    before = F.aggregate(pieces, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
    rows = rows.withColumn(p, F.when(F.col(m).isNotNull(), before))

    def placed(x: Column, i: Column) -> Column:
        piece = F.floor(i / PIECE).cast("int")
        return x.withField("start", F.get(p, piece) + total(F.slice(m, piece * PIECE + 1, i % PIECE)) + x["gap"])

    return rows.withColumn(out, F.transform(m, placed)).drop(v, g, m, p)


def with_base(rows: DataFrame, out: str = "base", text: str = "text") -> DataFrame:
    """rows with out: [(start, no, end)] of the fixed patterns' matches that count, in order; no is the kind's place among KINDS."""
    parts = []
    for no, kind in enumerate(KINDS):
        hint = F.col(text).contains("@") if kind == "email" else F.col(text).rlike(HINT[kind])
        rows = with_matches(rows, f"m_{kind}", PATTERNS[kind], hint, text)
        parts.append(_counted(no, kind))
    return rows.withColumn(out, F.array_sort(F.concat(*parts))).drop(*[f"m_{k}" for k in KINDS])


def _counted(no: int, kind: str) -> Column:
    found = F.filter(f"m_{kind}", lambda m: _good(kind, m["value"]))
    spans = F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(no).alias("no"), (m["start"] + m["own"]).alias("end")))
    return F.coalesce(spans, F.array().cast(SPANS))


def count_of(spans: Column, no: int) -> Column:
    """How many of the spans are of a kind."""
    return F.size(F.filter(spans, lambda s: s["no"] == no)).cast("long")


def named(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["no"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _likely(value: Column) -> Column:
    """The kind's place that a value looks like which no fixed pattern matches; -1: of none."""
    digits = _digits(value)
    n = F.length(digits)
    address = F.regexp_replace(value, r"[\[\]()]", "")
    return (
        F.when(value.rlike(f"^(?:{EMAILISH})$"), 0)
        .when(address.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$") | value.rlike("^(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}$"), 1)
        .when(n.between(13, 19) & luhn(digits), 2)
        .when(n.between(7, 15) & ~value.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"), 3)
        .otherwise(-1)
    )


def scanned(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, sha, base, like): the fixed patterns' spans and the identifier-like values of each row, written once; texts are read once."""
    rows = docs.select(F.col(key).alias("key"), text_of(text).alias("text"))
    hint = F.col("text").rlike("[0-9]") | F.col("text").rlike(AT_HINT)
    rows = with_matches(with_base(rows), "like", LOOSE, hint)
    return written(rows.select("key", F.unhex(F.sha2("text", 256)).alias("sha"), "base", "like"), "scanned")


def occurrences(found: DataFrame) -> DataFrame:
    """(sha, start, end, no, value, seed, patterns): each identifier-like value of each different text, with its kind and the contexts that it stands in."""
    each = found.filter("like IS NOT NULL").select("sha", "base", F.explode("like").alias("m")).select("sha", "m.start", (F.col("m.start") + F.col("m.own")).alias("end"), "m.value", "m.before", "m.behind", "base").dropDuplicates(["sha", "start"])
    over = F.filter("base", lambda b: (b["start"] < F.col("end")) & (F.col("start") < b["end"]))
    each = each.withColumn("over", F.get(over, F.lit(0)))
    own = F.when(F.col("over").isNotNull(), F.col("over.no")).otherwise(_likely(F.col("value")))
    plain = F.when(F.col("value").rlike("[@A-Za-z]"), F.lower("value")).otherwise(_digits(F.col("value")))
    near = lambda p: F.lower(F.regexp_replace(p, "[0-9]+", "#"))
    one, two = near(F.regexp_extract("before", r"(\S+)\s*$", 1)), near(F.regexp_extract("before", r"(\S+\s+\S+)\s*$", 1))
    after = near(F.regexp_extract("behind", r"^\s*(\S+)", 1))
    patterns = F.array(F.when(one != "", F.concat(F.lit("1 "), one)), F.when(two != "", F.concat(F.lit("2 "), F.regexp_replace(two, r"\s+", " "))), F.when((one != "") & (after != ""), F.concat(F.lit("3 "), one, F.lit(" _ "), after)))
    return each.select("sha", "start", "end", own.alias("no"), plain.alias("value"), F.col("over").isNotNull().alias("seed"), F.array_compact(patterns).alias("patterns"))


def believed(each: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, doubt: float = DOUBT, least: float = BELIEVED) -> DataFrame:
    """(pattern, no, score): the contexts believed after so many rounds over the graph of patterns and values.

    Values count once in a pattern, however often and in how many copies they
    stand there. A round is two sums and a join on the pattern; both sides are written, so a context of very many values is split.
    """
    edges = each.select(F.explode("patterns").alias("pattern"), "no", "value", "seed").groupBy("pattern", "no", "value").agg(F.max("seed").alias("seed"))
    edges = written(edges, "edges")
    all_values = edges.groupBy("pattern").agg(F.count("*").alias("n")).filter(F.col("n") >= support)
    wide = written(edges.join(all_values, "pattern"), "edges")
    sure = edges.groupBy("no", "value").agg(F.max("seed").alias("seed"))
    scores = written(sure.select(F.col("no").alias("v_no"), F.col("value").alias("v"), F.col("seed").cast("double").alias("p")), "values")
    patterns = None
    for turn in range(rounds):
        told = wide.filter("no >= 0").join(scores, (F.col("no") == F.col("v_no")) & (F.col("value") == F.col("v")))
        patterns = written(told.groupBy("pattern", "no").agg((F.sum("p") / (F.first("n") + doubt)).alias("score")).filter(F.col("score") >= least), "patterns")
        if turn + 1 < rounds:
            best = wide.join(patterns, ["pattern", "no"]).groupBy(F.col("no").alias("b_no"), F.col("value").alias("b")).agg(F.max("score").alias("best"))
            scores = written(scores.join(best, (F.col("v_no") == F.col("b_no")) & (F.col("v") == F.col("b")), "left").select("v_no", "v", F.greatest("p", F.coalesce("best", F.lit(0.0))).alias("p")), "values")
    return patterns


def discovered(found: DataFrame, **more: float) -> DataFrame:
    """(sha, added): the spans of values that no fixed pattern matches and that stand in believed contexts of the kind they look like."""
    each = written(occurrences(found), "occurrences")
    patterns = believed(each, **more)
    fresh = each.filter("NOT seed AND no >= 0").select("sha", "start", "end", "no", F.explode("patterns").alias("pattern"))
    hits = fresh.join(patterns.select("pattern", "no"), ["pattern", "no"], "left_semi").select("sha", "start", "no", "end").distinct()
    return hits.groupBy("sha").agg(F.array_sort(F.collect_list(F.struct("start", "no", "end"))).alias("added"))


def personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text", **more: float) -> DataFrame:
    """One row per row of docs: key, base and added ([(start, no, end)] in code points, end exclusive).

    Null and empty texts have none. Rows of equal texts have equal spans,
    whatever their keys; other columns are ignored. more goes to believed. No rows: no rows.
    """
    found = scanned(docs, key, text)
    added = written(discovered(found, **more).withColumnRenamed("sha", "s"), "added")
    none = F.array().cast(SPANS)
    return found.join(added, F.col("sha") == F.col("s"), "left").select(F.col("key").alias(key), "base", F.coalesce("added", none).alias("added"))


def masked(docs: DataFrame, key: str = "doc_id", text: str = "text", **more: float) -> DataFrame:
    """docs with every span of its text replaced by its kind in angle brackets; spans that overlap are one, of the first one's kind."""
    k, sha, spans = unused(docs, "k", "sha", "spans")
    found = scanned(docs, key, text)
    added = written(discovered(found, **more), "added")
    all_spans = found.join(added, "sha", "left").select("sha", F.array_sort(F.concat("base", F.coalesce("added", F.array().cast(SPANS)))).alias("all"))
    all_spans = written(all_spans.filter(F.size("all") > 0).dropDuplicates(["sha"]).select(F.col("sha").alias(k), F.col("all").alias(spans)), "spans")
    names = F.array(*[F.lit(f"<{x}>") for x in KINDS])
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.when(s["start"] >= acc["at"], F.concat(F.substring(text_of(text), acc["at"] + 1, s["start"] - acc["at"]), F.get(names, s["no"]))).otherwise("")
        return F.struct(F.concat(acc["out"], gap).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    done = F.aggregate(F.col(spans), start, step, lambda acc: F.concat(acc["out"], F.substring(text_of(text), acc["at"] + 1, F.length(text_of(text)))))
    out = docs.withColumn(sha, F.unhex(F.sha2(text_of(text), 256))).join(all_spans, F.col(sha) == F.col(k), "left")
    return out.withColumn(text, F.when(F.col(spans).isNotNull(), done).otherwise(F.col(text))).drop(k, sha, spans)


