"""Row numbers that need no single task: ranges are written once and numbered from what was written.

The bounds of a range partitioning are drawn anew whenever a plan runs, so that counts of one run say nothing about the
rows of another. Here the dealt rows are settled with their partition and place, and both are read from that table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .lineage import Scratch, settle


def numbered(df: DataFrame, order: list[str], within: list[str] | None = None, name: str = "ord", total: str | None = None, scratch: Scratch | None = None) -> DataFrame:
    """df with `name`, the place from 0 of each row in the ascending order of `order` (nulls first) among the rows with
    equal `within`, null being a value like others; `total` counts those rows. Equal rows get different places in any
    order; they are dealt over tasks too. No rows give no rows. The columns __p, __m, __t and those beginning with __w
    must not be there.

    What travels twice is df, once by range and once to the table; the joined counts have a row for each partition and
    each value of `within` that begins in it.
    """
    within = within or []
    keep = scratch.settle if scratch else settle
    ranged = df.withColumn("__t", F.monotonically_increasing_id())
    ranged = ranged.repartitionByRange(*within, *order, "__t").sortWithinPartitions(*within, *order, "__t").drop("__t")
    dealt = keep(ranged.withColumn("__p", F.spark_partition_id()).withColumn("__m", F.monotonically_increasing_id()))
    runs = dealt.groupBy("__p", *within).agg(F.min("__m").alias("__w_first"), F.count("*").alias("__w_n"))
    same = W.partitionBy(*within) if within else W.partitionBy(F.lit(0))
    below = F.coalesce(F.sum("__w_n").over(same.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    shift = (below - F.col("__w_first")).alias("__w_shift")
    runs = runs.select(F.col("__p").alias("__w_p"), *(F.col(c).alias(f"__w_{k}") for k, c in enumerate(within)), shift, F.sum("__w_n").over(same).alias("__w_total"))
    met = F.col("__p") == F.col("__w_p")
    for k, c in enumerate(within):
        met &= F.col(c).eqNullSafe(F.col(f"__w_{k}"))
    out = dealt.join(runs, met).withColumn(name, F.col("__m") + F.col("__w_shift"))
    if total:
        out = out.withColumn(total, F.col("__w_total"))
    return out.drop("__p", "__m", *(c for c in out.columns if c.startswith("__w_")))
