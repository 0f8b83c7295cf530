"""Exact deduplication by content-defined chunk recipes, in DataFrame operations only.

A text is cut where its own content says so, each distinct chunk gets a
verified identifier, and texts are equal if their ordered identifier lists are.
Chunk texts move through one shuffle; after it only identifier lists move.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import squeezed, unused, written

#: A chunk ends behind a sentence once it is long enough, or, where no sentence ends before the longest length, behind
#: one of some letters that texts in most scripts have now and then. Only texts without either are cut by length.
SHORTEST, LONGEST = 512, 4096
SENTENCE = r"(?:[.!?] |[\n\u3002\uff01\uff1f])"
LETTER = r"[Qqx7\u0436\u05d0\u0627\u7684\u306e\uac00]"


def cut_pattern(shortest: int = SHORTEST, longest: int = LONGEST) -> str:
    return rf"(?s).{{{shortest - 1},{longest - 1}}}?{SENTENCE}|.{{{shortest - 1},{longest - 1}}}?{LETTER}|.{{1,{longest}}}"


def chunks_of(text: Column, shortest: int = SHORTEST, longest: int = LONGEST) -> Column:
    """The ordered chunks of a text; joined they are the text again. Empty text: none."""
    return F.regexp_extract_all(text, F.lit(cut_pattern(shortest, longest)), F.lit(0))


def sha256(chunk: Column) -> Column:
    return F.unhex(F.sha2(chunk, 256))


def colliding(docs: DataFrame, text: str = "text", digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """Digests that two different chunks share. Chunks are deduplicated within each task before they move."""
    return (
        docs.select(F.explode(chunks_of(squeezed(text))).alias("chunk"))
        .select(digest(F.col("chunk")).alias("digest"), "chunk")
        .distinct()
        .groupBy("digest")
        .agg(F.count("*").alias("texts"))
        .filter("texts > 1")
        .select("digest")
    )


def recipes(docs: DataFrame, key: str = "doc_id", text: str = "text", digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """key, text_sha256 of the normalised text, recipe (ordered chunk identifiers).

    An identifier is the chunk's digest. That no two different chunks have the
    same one is verified over all chunks; should some share one, the identifier
    of those is the digest followed by the chunk itself.
    """
    plain = docs.select(F.col(key).alias("key"), squeezed(text).alias("text")).select(
        "key", F.sha2("text", 256).alias("text_sha256"), F.transform(chunks_of(F.col("text")), digest).alias("recipe")
    )
    bad = written(colliding(docs, text, digest), "chunk-collisions")
    if bad.isEmpty():
        return plain
    chunks = docs.select(F.col(key).alias("key"), squeezed(text).alias("text")).distinct().select(
        "key", F.sha2("text", 256).alias("text_sha256"), F.posexplode_outer(chunks_of(F.col("text"))).alias("pos", "chunk")
    )
    named = (
        chunks.withColumn("digest", digest(F.col("chunk")))
        .join(bad.withColumn("bad", F.lit(True)), "digest", "left")
        .withColumn("id", F.when(F.col("bad"), F.concat(F.col("digest"), F.encode("chunk", "UTF-8"))).otherwise(F.col("digest")))
    )
    exact = named.groupBy("key", "text_sha256").agg(F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "id")))).alias("ids"))
    exact = exact.select(F.col("key").alias("k"), F.col("text_sha256").alias("s"), F.col("ids.id").alias("exact"))
    return plain.join(exact, F.col("key").eqNullSafe(F.col("k")) & (F.col("text_sha256") == F.col("s")), "left").select("key", "text_sha256", F.col("exact").alias("recipe"))


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per row of docs: key, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are after each run of white space became one space;
    null counts as empty, and all empty texts are equal. The row with the
    smallest key stays; of rows that repeat both key and text one stays. A null
    key stays only if its whole group has none. Other columns are ignored.
    """
    made = written(recipes(docs, key, text, digest), "recipes")
    rows = made.groupBy("recipe", "key", "text_sha256").agg(F.count("*").alias("copies"))
    groups = rows.groupBy("recipe").agg(F.min("key").alias("keep_id"), F.sum("copies").alias("group_size"))
    groups = written(groups, "groups")  # so that both sides of the join are dealt out for it and a large group can be split
    return (
        rows.join(groups, "recipe")
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
        .select(
            F.col("key").alias(key),
            "keep_id",
            F.col("group_size").cast("long").alias("group_size"),
            (F.col("key").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
            "text_sha256",
        )
    )


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the rows that exact_dedup drops, with all columns; of rows that repeat key and normalised text any one.

    Only keys and digests are grouped. Texts then move once, to be taken out by
    key and digest at any size alike; those of a key and digest that stand in
    several rows, of which one stays, move once more.
    """
    k, s, sha = unused(docs, "k", "s", "sha")
    rows = exact_dedup(docs, key, text).groupBy(F.col(key).alias(k), F.col("text_sha256").alias(s)).agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    rows = written(rows.filter("NOT kept OR n > 1"), "repeats")
    marked = docs.withColumn(sha, F.sha2(squeezed(text), 256))
    same = F.col(key).eqNullSafe(F.col(k)) & F.col(sha).eqNullSafe(F.col(s))  # without a test for nulls both joins read one exchange
    alone = marked.join(rows.select(k, s).hint("merge"), same, "left_anti")
    several = marked.join(rows.filter("kept").select(k, s).hint("merge"), same, "left_semi").dropDuplicates([key, sha])
    return alone.unionByName(several).drop(sha)
