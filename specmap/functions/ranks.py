"""Global row numbers and exact quantiles without gathering the rows in one task."""
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut

_ROW_BITS = (1 << 33) - 1


def with_rank(df: DataFrame, order: Sequence[str | Column], name: str = "rnk") -> DataFrame:
    """Add the 0-based position of every row in the total order given by `order`.

    One range shuffle sorts the rows; a row's position is its number in its partition plus the sizes of the
    partitions before it. Only the partition sizes reach the driver.
    """
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    ordered = cut(df.repartitionByRange(*cols).sortWithinPartitions(*cols)
                  .withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = ordered.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n")).collect()
    starts, total = [], 0
    for row in sorted(sizes, key=lambda r: r["_part"]):
        starts.append((row["_part"], total))
        total += row["_n"]
    if len(starts) <= 1:
        return ordered.withColumn(name, F.col("_at").bitwiseAND(_ROW_BITS)).drop("_at")
    offsets = df.sparkSession.createDataFrame(starts, "_part long, _start long")
    return (ordered.withColumn("_part", part)
            .join(F.broadcast(offsets), "_part")
            .withColumn(name, F.col("_at").bitwiseAND(_ROW_BITS) + F.col("_start"))
            .drop("_at", "_part", "_start"))


def with_rows_before(df: DataFrame, order: Sequence[str], count: str, name: str) -> DataFrame:
    """Add the sum of `count` over all rows that come before a row in the total order given by `order`."""
    part = F.shiftright("_at", 33)
    ordered = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
                  .withColumn("_part", part))
    starts, total = [], 0
    for row in sorted(ordered.groupBy("_part").agg(F.sum(count).alias("_n")).collect(), key=lambda r: r["_part"]):
        starts.append((row["_part"], total))
        total += row["_n"]
    offsets = df.sparkSession.createDataFrame(starts, "_part long, _start long")         # one row per partition
    run = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (ordered.withColumn("_run", F.sum(count).over(run)).join(F.broadcast(offsets), "_part")
            .withColumn(name, F.col("_start") + F.col("_run") - F.col(count)).drop("_at", "_part", "_run", "_start"))


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float], by: str | None = None) -> DataFrame:
    """(by, prob, q): linearly interpolated quantiles of `value` per group; null and NaN values are ignored.

    Equal values are counted before anything is shuffled, so a value that most rows share is one row. The distinct
    values are ranked once in (group, value) order; each quantile then needs two of them. `by` names a column of few
    distinct values (labels, columns); the groups themselves may be of any size.
    """
    by = by or "_all"
    data = df.withColumn("_all", F.lit(0)).select(by, F.col(value).cast("double").alias("_v"))
    data = data.where(F.col("_v").isNotNull() & ~F.isnan("_v")).groupBy(by, "_v").agg(F.count(F.lit(1)).alias("_c"))
    ranked = with_rows_before(data, [by, "_v"], "_c", "rnk")
    groups = ranked.groupBy(by).agg(F.sum("_c").alias("_n"), F.min("rnk").alias("_first"))
    wanted = groups.withColumn("prob", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
    pos = F.col("prob") * (F.col("_n") - 1)
    wanted = wanted.withColumn("_lo", F.floor(pos)).withColumn("_f", pos - F.col("_lo"))
    low = F.col("_first") + F.col("_lo")
    high = F.col("_first") + F.least(F.col("_lo") + 1, F.col("_n") - 1)
    ends = wanted.select(by, "prob", "_f", F.explode(F.array(
        F.struct(low.alias("at"), F.lit(0).alias("end")), F.struct(high.alias("at"), F.lit(1).alias("end")))).alias("e"))
    ends = ends.select(F.col(by).alias("_by"), "prob", "_f", "e.at", "e.end")
    inside = (F.col(by) == F.col("_by")) & (F.col("at") >= F.col("rnk")) & (F.col("at") < F.col("rnk") + F.col("_c"))
    hit = ranked.join(F.broadcast(ends), inside)                        # |groups| x |probs| x 2 rows
    a, b = F.max(F.when(F.col("end") == 0, F.col("_v"))), F.max(F.when(F.col("end") == 1, F.col("_v")))
    out = hit.groupBy(by, "prob").agg((a + (b - a) * F.first("_f")).alias("q"))
    return out.drop("_all")
