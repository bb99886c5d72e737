"""Backward as-of join: each left row meets the right row with the greatest key not above its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def asof_join(left: DataFrame, right: DataFrame, on: str, by: list[str] | None = None, *, width: int = 1 << 16) -> DataFrame:
    """``left`` with the columns of ``right`` (null where nothing lies at or below).

    The distinct keys of ``left`` and the rows of ``right`` are dealt into bins of
    ``width`` keys and merged in one sorted pass a bin; a bin that starts without a
    right row takes the last one of the bins before, of which there is one row a
    bin. The rows of ``left``, of which a key may have any number, meet their key's
    match last. No range join, no cross join.
    """
    by = list(by or [])
    payload = [c for c in right.columns if c not in (on, *by)]
    keys = left.select(*by, on).distinct()
    right_struct = F.struct(F.col(on).alias("__at"), *payload)
    struct_type = right.select(right_struct.alias("s")).schema["s"].dataType
    packed_left = keys.select(*by, F.col(on).alias("__key"), F.lit(1).alias("__side"), F.lit(None).cast(struct_type).alias("__right"))
    packed_right = right.select(*by, F.col(on).alias("__key"), F.lit(0).alias("__side"), right_struct.alias("__right"))
    merged = packed_left.unionByName(packed_right).withColumn("__bin", F.floor(F.col("__key") / width))
    carried = merged.groupBy(*by, "__bin").agg(F.max_by("__right", F.when(F.col("__side") == 0, F.col("__key"))).alias("__last"))
    earlier = Window.partitionBy(*by).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    carried = carried.withColumn("__before", F.last("__last", ignorenulls=True).over(earlier)).drop("__last")
    inside = Window.partitionBy(*by, "__bin").orderBy("__key", "__side").rowsBetween(Window.unboundedPreceding, 0)
    seen = merged.withColumn("__seen", F.last("__right", ignorenulls=True).over(inside)).filter("__side = 1")
    found = seen.join(carried, [*by, "__bin"]).withColumn("__match", F.coalesce("__seen", "__before"))
    found = found.select(*by, F.col("__key").alias(on), *[F.col(f"__match.{c}").alias(c) for c in payload])
    return left.join(found, [*by, on])
