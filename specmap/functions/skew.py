"""Equi-joins that stay balanced when one key holds a large share of the rows.

A hub is a key with more than `threshold` rows. The threshold grows with the table, so there are at most
HUB_LIMIT hubs and their table can be broadcast: its size is bounded by construction, not by luck.
"""
import math

from pyspark.sql import DataFrame, functions as F

HUB_ROWS = 200_000     # a key with fewer rows than this fits any task
HUB_LIMIT = 100_000    # upper bound on the number of hub keys


def hubs(many: DataFrame, key: str, total: int | None = None, threshold: int | None = None) -> DataFrame | None:
    """(key, salts) of the keys that need splitting, or None when no key can be that large."""
    if threshold is None:
        total = many.count() if total is None else total
        threshold = max(HUB_ROWS, math.ceil(total / HUB_LIMIT))
        if total <= threshold:
            return None
    found = (many.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
             .where(F.col("_rows") > threshold)
             .select(F.col(key), F.ceil(F.col("_rows") / F.lit(threshold)).cast("int").alias("_salts")))
    return found


def salted_join(many: DataFrame, one: DataFrame, key: str, hub_table: DataFrame | None, how: str = "inner") -> DataFrame:
    """Join `many` to `one` (unique in `key`), spreading the rows of each hub over several tasks.

    The single row of a hub on the `one` side is repeated once per salt; rows of other keys are untouched.
    """
    if hub_table is None:
        return many.join(one, key, how)
    small = F.broadcast(hub_table)
    spread = F.xxhash64(*[F.col(c) for c in many.columns])
    left = (many.join(small, key, "left")
            .withColumn("_salt", F.when(F.col("_salts").isNull(), F.lit(0))
                        .otherwise(F.pmod(spread, F.col("_salts")).cast("int")))
            .drop("_salts"))
    right = (one.join(small, key, "left")
             .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1)))
             .drop("_salts"))
    return left.join(right, [key, "_salt"], how).drop("_salt")
