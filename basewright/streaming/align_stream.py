"""Mapping reads that arrive as a stream.

A read lies in one micro-batch whole, so windows over its hits belong into
``foreachBatch``. The genome's blocks are made once, before the first batch, or
come from a stored index. Every batch writes its SAM rows and its counters to paths named
by the batch id; a batch that runs again overwrites its own, so results hold each
read once. What a batch writes to the shared folder goes with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from basewright.operators import align, genome
from basewright.plans.scratch import scope


def read_stream(spark: SparkSession, folder: str, schema, files_a_batch: int = 1000) -> DataFrame:
    """Reads as they arrive in a folder of Parquet files; a micro-batch takes at most so many files, which is the back-pressure."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def map_stream(reads: DataFrame, genome_: DataFrame, out: str, checkpoint: str, *, max_hits: int = align.MAX_HITS, strand: int = align.BOTH_STRANDS) -> StreamingQuery:
    """Start mapping; ``reads`` is a streaming DataFrame with read_id, name, seq, qual, ``genome_`` contigs or stored blocks."""
    blocks = genome.searchable(genome_)

    def one(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            with scope():
                found = align.hits(batch, blocks, max_hits, strand)
                align.sam_rows(found, batch).write.mode("overwrite").parquet(f"{out}/sam/batch={batch_id}")
                align.statistics(found, batch).drop("mappability").write.mode("overwrite").parquet(f"{out}/stats/batch={batch_id}")
        finally:
            batch.unpersist()

    return reads.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def streamed_rows(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(f"{out}/sam").drop("batch")


def streamed_statistics(spark: SparkSession, out: str) -> DataFrame:
    """Totals over all batches so far."""
    columns = ["total", "mapped", "uniq", "multi", "sam_rows"]
    sums = spark.read.parquet(f"{out}/stats").agg(*[F.sum(c).alias(c) for c in columns])
    return sums.withColumn("mappability", F.when(F.col("total") > 0, 100.0 * F.col("mapped") / F.col("total")))
