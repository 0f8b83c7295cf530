"""URL rules by host-suffix and path-prefix expressions, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (host, path, verdict) of the rules that the registered query applies.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z in lower case; none: empty."""
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(url, "://", 1))
    tail = F.substring(url, F.length(rest) + 4, F.length(url))
    return F.coalesce(F.translate(F.regexp_extract(tail, r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end up to ?, # or the end; none: empty."""
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(url, "://", 1))
    tail = F.substring(url, F.length(rest) + 4, F.length(url))
    return F.coalesce(F.regexp_extract(tail, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def url_filter(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow", prefix: int = 8) -> DataFrame:
    """One row per row of pages: key, host, path, rule, verdict.

    A rule fits its host and all subdomains if the path starts with its own;
    the longest (host and path together, then host) wins, and of rules given
    twice with different verdicts block does. Without a rule the verdict is
    default. Null urls and urls without :// have empty host and path, which
    rules never fit. prefix: hex digits of the digest that the join uses.

    Each url becomes its host suffixes times those path prefixes whose length
    some rule's path has. Only these lengths, whole numbers below the length of
    the longest rule, are read to the driver.
    """
    r = rules.select(F.translate("host", UPPER, LOWER).alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path"), F.col("verdict").alias("r_verdict"))
    r = r.filter("r_host != ''").groupBy("r_host", "r_path").agg(F.max("r_verdict").alias("r_verdict"))
    r = r.withColumn("r_digest", digest(F.col("r_host"), F.col("r_path"))).withColumn("short", F.substring("r_digest", 1, prefix))
    lengths = sorted(x[0] for x in r.select(F.length("r_path")).distinct().collect())

    urls = pages.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url"))
    urls = urls.select("key", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).groupBy("key", "host", "path").agg(F.count("*").alias("copies"))
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fitting = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length("path"))
    prefixes = F.transform(fitting, lambda n: F.substring(F.col("path"), F.lit(1), n))
    wide = (
        urls.withColumn("suffix", F.explode(suffixes))
        .withColumn("start", F.explode_outer(prefixes))
        .withColumn("digest", digest(F.col("suffix"), F.col("start")))
        .withColumn("short", F.substring("digest", 1, prefix))
    )
    found = wide.join(r, ["short"], "left").withColumn(
        "fit", F.when(F.col("digest") == F.col("r_digest"), F.struct((F.length("r_host") + F.length("r_path")).alias("n"), F.length("r_host").alias("h"), F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict")))
    )
    best = found.groupBy("key", "host", "path", "copies").agg(F.max("fit").alias("fit"))
    return best.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(
        F.col("key").alias(key), "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", F.lit(default)).alias("verdict")
    )
