"""Helpers that the training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from basewright.plans.scratch import collect_garbage, distilled, forget, materialise, scope, shared_dir, spread, tidy

__all__ = ["collect_garbage", "distilled", "forget", "materialise", "scope", "shared_dir", "spread", "tidy"]

#: White space of the contracts: space and U+0009 to U+000D.
SPACES = r"[\x20\x09-\x0D]+"
#: A word of the contracts.
WORD = r"[^\x20\x09-\x0D]+"

#: A key is heavy if it has more than one in so many rows, so there are never more heavy keys than that.
HEAVY = 1000
#: Tasks that share the rows of a heavy key.
SALTS = 64


def id_text(column: str) -> Column:
    """The id as text for fold hashes; a null id counts as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def in_fold(column: str, modulus: int, remainder: int) -> Column:
    """crc32 of the id's text, modulo ``modulus``, equals ``remainder``."""
    return (F.crc32(id_text(column).cast("binary")) % modulus) == remainder


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def text_slices(column, most_bytes: int = 4 << 20):
    """Cut a string column of one Arrow batch into (start, stop) row ranges of bounded bytes."""
    import numpy as np
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    start, base = 0, 0
    while start < len(sizes):
        stop = max(start + 1, int(np.searchsorted(ends, base + most_bytes, side="right")))
        yield start, stop
        base = int(ends[stop - 1])
        start = stop


def row_key(*columns: str) -> Column:
    """A hash of the columns' text, to find a row again next to its id."""
    return F.xxhash64(*[F.col(c).cast("string") for c in columns])


def rows_of(df: DataFrame, chosen: DataFrame, key: Column, id_col: str = "doc_id") -> DataFrame:
    """row (a struct of all columns) of each row that ``chosen`` (id, key and any further columns, one row each) names, and those columns.

    Of rows that repeat id and key, which no operator tells apart, the first by all columns stays.
    """
    whole = F.struct(*[F.col(c) for c in df.columns])  # no column of the row can clash with those of the join
    own = df.select(whole.alias("row"), F.col(id_col).alias("own_id"), key.alias("own_key"), F.xxhash64(*[F.col(c) for c in df.columns]).alias("own_all"))
    more = [c for c in chosen.columns if c not in ("id", "key")]
    found = own.join(chosen, own["own_id"].eqNullSafe(chosen["id"]) & (own["own_key"] == chosen["key"]))
    first = Window.partitionBy("own_id", "own_key").orderBy("own_all")
    return found.withColumn("nth", F.row_number().over(first)).filter("nth = 1").select("row", *more)


def written(df: DataFrame, name: str) -> DataFrame:
    """A stage's result as a table; outside any scope it stays until it is forgotten or the process ends."""
    return materialise(df, name)


def gathered(df: DataFrame):
    """A bounded result as an Arrow table on the driver; its shuffle files go at once."""
    with tidy(df.sparkSession):
        return df.toArrow()


def heavy_keys(df: DataFrame, key: str) -> DataFrame:
    """key, heavy: the keys that hold more than one in HEAVY rows of a table, at most HEAVY rows whatever the input.

    A key of a few rows is not heavy, however small the table: its SALTS copies would cost more than its rows.
    """
    total = df.count()
    heavy = (F.col("n") * HEAVY > F.lit(total)) & (F.col("n") > 4 * SALTS)
    return df.groupBy(key).agg(F.count("*").alias("n")).filter(heavy).select(key, F.lit(True).alias("heavy"))


def salted(df: DataFrame, heavy: DataFrame, key: str, by: Column | None = None) -> DataFrame:
    """Add ``salt``: the rows of heavy keys are dealt over SALTS by a hash of ``by``, or without it copied to all of them; others have 0."""
    marked = df.join(F.broadcast(heavy), key, "left")  # at most HEAVY rows
    if by is not None:
        salt = F.when(F.col("heavy"), F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
        return marked.withColumn("salt", salt).drop("heavy")
    every = F.when(F.col("heavy"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return marked.withColumn("salt", F.explode(every)).drop("heavy")


def by_unique_key(rows: DataFrame, table: DataFrame, key: str, weight: str) -> DataFrame:
    """``rows``, a table, joined with ``table``, which has each key once and in ``weight`` how many rows hold it.

    Keys with more than one in HEAVY rows, at most HEAVY keys, are broadcast, so
    no task gets all rows of a hot key; the others meet in a plain join.
    """
    hot = F.col(weight) * HEAVY > F.lit(rows.count())
    heavy = table.filter(hot)
    light = rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(table.filter(~hot), key)
    return rows.join(F.broadcast(heavy), key).unionByName(light)
