"""Joins with sites and specimens, and the small rankings that plots need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.sinks import consolidated

# The fifteen colours of sites, in order.
PALETTE = ["#4477AA", "#EE6677", "#117722", "#DDCC55", "#66CCEE", "#992266", "#E69F00", "#00AE83", "#D55E00", "#DD89B7", "#0072B2", "#44AA99", "#999933", "#882255", "#332288"]


def with_site(items: DataFrame, sites: DataFrame, key: str, default: str = "Unknown") -> DataFrame:
    """items with `site`, the default where there is none. sites: (key, site)."""
    return items.join(sites, key, "left").withColumn("site", F.coalesce("site", F.lit(default)))


def with_note(items: DataFrame, notes: DataFrame, key: str) -> DataFrame:
    return items.join(notes, key, "left").withColumn("note", F.coalesce("note", F.lit("")))


def colours(sites: DataFrame) -> DataFrame:
    """(site, rank, colour) of the distinct sites by name; the palette repeats."""
    names = sites.select("site").distinct()
    palette = F.array(*map(F.lit, PALETTE))
    return consolidated(names, "site").select("site", F.col("ord").cast("int").alias("rank")).withColumn("colour", F.get(palette, F.col("rank") % len(PALETTE)))


def codes(items: DataFrame, key: str, value: str) -> DataFrame:
    """(key, code): the value as a number if all values are numbers, else its place among the distinct values."""
    number = F.col(value).try_cast("double")
    numeric = items.agg(F.coalesce(F.bool_and(number.isNotNull() | F.col(value).isNull()), F.lit(False)).alias("_all"))
    names = consolidated(items.select(value).where(F.col(value).isNotNull()).distinct(), value).withColumnRenamed("ord", "_code")
    joined = items.join(names, value, "left").crossJoin(F.broadcast(numeric))
    return joined.select(key, F.when(F.col("_all"), number).otherwise(F.col("_code").cast("double")).alias("code"))


def top_per(df: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key, with `rank` from 1."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(*order))).where(F.col("rank") <= n)


def scalar_scatter(scores: DataFrame, sites: DataFrame, values: DataFrame) -> DataFrame:
    """scores (id, components) with `site`, `marker`, the place of the site among all by name, and `value`, that of the
    site; rows whose site has none are left out. sites: (id, site), unknown where it is missing; values: (site, value)."""
    placed = scores.join(sites, "id", "left").withColumn("site", F.coalesce("site", F.lit("Unknown")))
    marks = consolidated(placed.select("site").distinct(), "site").select("site", F.col("ord").cast("int").alias("marker"))
    return placed.join(marks, "site").join(values.where("value is not null"), "site").select(*scores.columns, "site", "marker", "value")


def axis_range(df: DataFrame, column: str, pad: float = 0.05) -> DataFrame:
    """(lo, hi) with a margin of 5 % of the span; a span of 0 counts as 1."""
    m = df.agg(F.min(column).alias("a"), F.max(column).alias("b"))
    room = F.when(F.col("b") > F.col("a"), F.col("b") - F.col("a")).otherwise(1.0) * pad
    return m.select((F.col("a") - room).alias("lo"), (F.col("b") + room).alias("hi"))


def hover(r: DataFrame, key: str, name: str, value: str) -> DataFrame:
    """(key, summary): the two strongest positive and the two strongest negative values of each key."""
    up = r.where(F.col(value) > 0).withColumn("k", F.row_number().over(W.partitionBy(key).orderBy(F.desc(value), name)))
    down = r.where(F.col(value) < 0).withColumn("k", F.row_number().over(W.partitionBy(key).orderBy(value, name)) + 2)
    up, down = up.where("k <= 2"), down.where("k <= 4")
    return up.unionByName(down).groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", name))), lambda x: x[name]), ",").alias("summary"))
