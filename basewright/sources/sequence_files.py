"""FASTA, FASTQ and SAM as text sources and sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from basewright.functions import dna
from basewright.operators.ordering import numbered

SAM_COLUMNS = ["qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual", "nh"]
_SAM_TYPES = ["string", "int", "string", "long", "int", "string", "string", "long", "long", "string", "string", "int"]


def _in_file_order(lines: DataFrame, name: str, *more: Column) -> DataFrame:
    """Number the rows by file, split and place in the split."""
    placed = lines.select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), *more
    )
    return numbered(placed, ["file", "block"], ["at"], name)


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, line (its number over all files, from 0), value: raw lines of one or more files."""
    return _in_file_order(spark.read.text(path), "line").select("file", "line", "value")


def read_fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, ordinal, name (the whole header), seq: one row a record, in file order. Files split at records."""
    records = _in_file_order(spark.read.option("lineSep", "\n>").text(path), "ordinal")
    text = F.regexp_replace(F.regexp_replace("value", r"^\s*>", ""), "\r", "")
    header = F.trim(F.substring_index(text, "\n", 1))
    body = F.when(F.instr(text, "\n") > 0, F.regexp_replace(F.substring(text, F.instr(text, "\n") + 1, F.length(text)), r"\s+", "")).otherwise("")
    return records.filter(F.trim(text) != "").select("file", "ordinal", header.alias("name"), body.alias("seq"))


def read_fastq(spark: SparkSession, path: str | list[str], strict_end: bool = False) -> DataFrame:
    """read_id, name, seq, plus, qual: four lines a record.

    A last record without a line end counts; with ``strict_end`` it goes, and so does every record of fewer than
    four lines. Compressed files cannot tell whether a line end is missing.
    """
    lines = _in_file_order(spark.read.option("lineSep", "\n").text(path), "line", F.col("_metadata.file_size").alias("bytes"))
    first = lines.groupBy("file").agg(F.min("line").alias("first"))
    placed = lines.join(first, "file").withColumn("no", F.col("line") - F.col("first"))
    part = lambda k, c: F.max(F.when(F.col("no") % 4 == k, F.trim(F.regexp_replace("value", "\r", "")))).alias(c)
    records = placed.groupBy("file", F.floor(F.col("no") / 4).alias("record")).agg(
        F.min("line").alias("line"), F.count("*").alias("n"), part(0, "header"), part(1, "seq"), part(2, "plus"), part(3, "qual")
    )
    if strict_end:
        # Every line and its end add up to the file's bytes; one byte more means that the last line has no end.
        sizes = lines.groupBy("file").agg((F.sum(F.octet_length("value") + 1) > F.max("bytes")).alias("open"), F.floor((F.count("*") - 1) / 4).alias("record"))
        last = sizes.filter("open").select("file", "record")
        whole = records.filter(F.col("n") == 4).join(last, ["file", "record"], "left_anti")
    else:
        whole = records.filter(F.col("n") >= 2)
    ordered = numbered(whole, ["file"], ["record"], "read_id")
    return ordered.select("read_id", F.expr("substring(header, 2)").alias("name"), "seq", "plus", F.coalesce("qual", F.lit("")).alias("qual"))


def parse_sam(lines: DataFrame, column: str = "value") -> DataFrame:
    """The twelve SAM columns of text lines; header lines go."""
    parts = F.split(F.col(column), "\t")
    kept = lines.filter(~F.col(column).startswith("@"))
    typed = [F.try_element_at(parts, F.lit(i + 1)).try_cast(t).alias(c) for i, (c, t) in enumerate(zip(SAM_COLUMNS, _SAM_TYPES, strict=True))]
    return kept.select(*typed)


def sam_lines(rows: DataFrame, standard: bool = False) -> DataFrame:
    """value: the text of each SAM row. Every field is followed by a tab; ``standard`` drops the last tab and tags the hit count."""
    fields = [F.col(c).cast("string") for c in SAM_COLUMNS]
    if standard:
        return rows.select(F.concat_ws("\t", *fields[:-1], F.concat(F.lit("NH:i:"), fields[-1])).alias("value"))
    return rows.select(F.concat(F.concat_ws("\t", *fields), F.lit("\t")).alias("value"))


def sam_header(chr_len: DataFrame) -> DataFrame:
    """value: @HD and one @SQ a contig (name, len)."""
    first = chr_len.sparkSession.createDataFrame([("@HD\tVN:1.6\tSO:unknown",)], "value string")
    return first.union(chr_len.select(F.concat(F.lit("@SQ\tSN:"), "name", F.lit("\tLN:"), F.col("len").cast("string"))))


def fasta_lines(records: DataFrame) -> DataFrame:
    return records.select(F.concat(F.lit(">"), "name", F.lit("\n"), "seq").alias("value"))


def fastq_lines(reads: DataFrame) -> DataFrame:
    return reads.select(F.concat(F.lit("@"), F.concat_ws("\n", "name", "seq", "plus", "qual")).alias("value"))


def record_length(reads: DataFrame) -> DataFrame:
    """read_id, bytes of the record as text, with its line ends."""
    return reads.select("read_id", (F.length(F.concat(F.lit("@"), F.concat_ws("\n", "name", "seq", "plus", "qual"))) + 1).cast("long").alias("n"))


def with_n_runs(segs: DataFrame) -> DataFrame:
    """ordinal, name, seq with runs of N put back."""
    runs = F.sort_array(F.collect_list(F.struct("seg_no", F.concat(F.expr("repeat('N', cast(n_before as int))"), "seq").alias("run"))))
    return segs.groupBy("ordinal", "name").agg(F.array_join(F.transform(runs, lambda x: x["run"]), "").alias("seq"))


def fasta_as_reads(records: DataFrame) -> DataFrame:
    """FASTA records used as reads: quality I for every base."""
    return records.select(F.col("ordinal").alias("read_id"), "name", "seq", F.lit("+").alias("plus"), dna.fasta_quality(F.col("seq")).alias("qual"))


def read_batches(reads: DataFrame, size: int) -> DataFrame:
    """Add ``batch``: reads in groups of ``size`` by read order."""
    return reads.withColumn("batch", F.floor(F.col("read_id") / size))


def first_without_n(reads: DataFrame, number: int) -> DataFrame:
    """Of the first ``number`` reads, which is the feature, those without N; the others still use up the number."""
    return reads.orderBy("read_id").limit(number).filter(~F.col("seq").rlike("[Nn]"))


def map_batches(reads: DataFrame, size: int, callback: Callable, schema: str) -> DataFrame:
    """``callback`` (a pandas frame, giving one of ``schema``) on every batch of ``size`` reads, in the executors."""
    return read_batches(reads, size).groupBy("batch").applyInPandas(callback, schema)


def records(rows: DataFrame, *order: str) -> Iterator[Row]:
    """The records one by one, in order; the driver holds two partitions at a time."""
    return (rows.orderBy(*order) if order else rows).toLocalIterator(prefetchPartitions=True)
