"""Running sums and numbering over one global order, without a task that holds all rows.

Rows are dealt into ranges of their ordinal, or into sampled ranges of any sort
key; each range is summed by itself, and only the one total of every range goes
through a window, which sums blocks of ranges first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from basewright.plans.scratch import materialise

#: Ordinals of a range, and ranges of a block.
RANGE, BLOCK = 4096, 4096


def offsets(totals: DataFrame, at: str, values: dict[str, str], part: list[str] = ()) -> DataFrame:
    """Of one row for each (part, ``at``), ``at`` an integer, for every (name, value): the sum of ``value`` over its part's rows before it, as ``name``.

    Blocks of BLOCK consecutive ``at`` are summed first, so a task holds the rows
    of one block, or one row for each block.
    """
    dealt = totals.withColumn("__block", F.floor(F.col(at) / BLOCK))
    before = Window.partitionBy(*part).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*part, "__block").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    upto = lambda value, window: F.coalesce(F.sum(value).over(window), F.lit(0))
    blocks = dealt.groupBy(*part, "__block").agg(*[F.sum(value).alias(f"__sum_{name}") for name, value in values.items()])
    blocks = blocks.select(*part, "__block", *[upto(f"__sum_{name}", before).alias(f"__base_{name}") for name in values])
    summed = dealt.select("*", *[upto(value, inside).alias(f"__in_{name}") for name, value in values.items()]).join(blocks, [*part, "__block"])
    return summed.select(*totals.columns, *[(F.col(f"__base_{name}") + F.col(f"__in_{name}")).alias(name) for name in values])


def running_total(df: DataFrame, ordinal: str, order: list[str], value: Column, name: str) -> DataFrame:
    """Add ``name``: the sum of ``value`` over all rows before this one, by ``ordinal`` then ``order``."""
    valued = df.withColumn("__value", value).withColumn("__range", F.floor(F.col(ordinal) / RANGE))
    starts = offsets(valued.groupBy("__range").agg(F.sum("__value").alias("__sum")), "__range", {"__offset": "__sum"}).drop("__sum")
    inside = Window.partitionBy("__range").orderBy(ordinal, *order).rowsBetween(Window.unboundedPreceding, 0)
    summed = valued.withColumn("__upto", F.sum("__value").over(inside)).join(starts, "__range")
    return summed.withColumn(name, F.col("__offset") + F.col("__upto") - F.col("__value")).drop("__range", "__value", "__upto", "__offset")


def numbered(df: DataFrame, part: list[str], order: list[str], name: str) -> DataFrame:
    """Add ``name``: 0, 1, 2, ... by ``part`` (few rows each would be wasteful; a file split is usual) then ``order``."""
    before = Window.orderBy(*part).rowsBetween(Window.unboundedPreceding, -1)
    counts = df.groupBy(*part).agg(F.count("*").alias("__n"))
    starts = counts.withColumn("__offset", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    inside = Window.partitionBy(*part).orderBy(*order)
    placed = df.withColumn("__at", F.row_number().over(inside).cast("long") - 1).join(starts, part)
    return placed.withColumn(name, F.col("__offset") + F.col("__at")).drop("__at", "__offset")


def numbered_by(df: DataFrame, order: list[str | Column], name: str) -> DataFrame:
    """Add ``name``: 0, 1, 2, ... by ``order``, a key without ties.

    Sampled splitters deal the rows into sorted ranges of about equal size whatever
    the key's values. They are written once, each row with its place in its range;
    one row a range gives the numbers at which the ranges start.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    split = F.lit((1 << 33) - 1)  # of that identifier: the task above, the row in it below
    dealt = dealt.withColumn("__range", F.shiftright("__id", 33)).withColumn("__at", F.col("__id").bitwiseAND(split)).drop("__id")
    dealt = materialise(dealt, "sorted-ranges")
    starts = offsets(dealt.groupBy("__range").agg(F.count("*").alias("__n")), "__range", {"__offset": "__n"}).drop("__n")
    placed = dealt.join(F.broadcast(starts), "__range")  # one row a task
    return placed.withColumn(name, F.col("__offset") + F.col("__at")).drop("__range", "__at", "__offset")
