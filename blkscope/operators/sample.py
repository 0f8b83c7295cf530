"""Samples of an exact size that do not depend on partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import PREVIEW_ROWS

SEED = 12345


def sample_exact(df: DataFrame, n: int = PREVIEW_ROWS, seed: int = SEED, order: tuple[str, ...] = ("trace", "seq")) -> DataFrame:
    """n rows of df (all if there are fewer) in their own order: those with the least hash of seed and order.

    Rows are counted by the hash's first four digits, 65,536 counts at most;
    only rows up to the digits at which n is reached are compared.
    """
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in order]))
    keyed = df.withColumn("__k", key)
    counts = keyed.groupBy(F.substring("__k", 1, 4).alias("p")).agg(F.count("*").alias("c"))
    reached = counts.select("p", F.sum("c").over(Window.orderBy("p")).alias("so_far")).filter(F.col("so_far") >= n).agg(F.coalesce(F.min("p"), F.lit("ffff")).alias("cut"))
    near = keyed.filter(F.substring("__k", 1, 4) <= reached.scalar())
    return near.orderBy("__k", *order).limit(n).drop("__k").orderBy(*order)


def sampling_info(total: int, n: int) -> dict[str, float]:
    """What a preview says of itself: all rows count as 100 per cent."""
    return {"total_count": total, "sampled_count": min(total, n), "sampling_ratio": 100.0 if total <= n else n * 100.0 / total}
