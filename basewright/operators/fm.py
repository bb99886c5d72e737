"""FM-index search: backward search and location, on an index that stays in tables.

An optional mode; the seed join needs none of it. Every read searches its reverse
complement, so a place in the text's second half is a forward hit. The transform
is cut into blocks of WIDTH rows with the counts before them. A distinct pattern
starts at the range of its last KMER bases and takes one round of joins with the
blocks for each further base; neither the driver nor a task holds the index.
Reads meet the ranges and places of their pattern at the end.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basewright.functions import dna
from basewright.operators.align import FORWARD, REVERSE, SEED
from basewright.operators.index import KMER, kmer_table
from basewright.operators.ordering import offsets
from basewright.plans.scratch import forget, materialise

#: Rows of the transform in a block, and rows of a range that are listed at once.
WIDTH, CHUNK = 1024, 4096


@dataclass
class FmIndex:
    """Tables: kmers (kmer, lo, hi), blocks (block, text, a, c, g, t: counts before it), places (row, pos); and the first row of each base."""

    size: int
    first: dict[str, int]
    kmers: DataFrame
    blocks: DataFrame
    places: DataFrame
    interval: int
    depth: int

    def __len__(self) -> int:
        return self.size


def gather(rows: DataFrame, interval: int, depth: int) -> FmIndex:
    """rows: row, pos, suffix, prev in suffix order."""
    slim = materialise(rows.select("row", "pos", F.left("suffix", F.lit(KMER)).alias("suffix"), "prev"), "fm-rows")
    in_order = F.transform(F.sort_array(F.collect_list(F.struct("row", "prev"))), lambda x: x["prev"])
    counts = [F.count_if(F.col("prev") == b).alias("n" + b.lower()) for b in dna.BASES]
    blocks = materialise(slim.groupBy(F.floor(F.col("row") / WIDTH).alias("block")).agg(F.array_join(in_order, "").alias("text"), *counts), "fm-blocks")
    total = blocks.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("size"), *[F.coalesce(F.sum("n" + b), F.lit(0)).alias(b) for b in "acgt"]).first()
    first, at = {}, 1
    for b in "acgt":
        first[b], at = at, at + total[b]
    before = offsets(blocks.drop("text"), "block", {b: "n" + b for b in "acgt"}).select("block", *"acgt")
    counted = materialise(blocks.select("block", "text").join(before, "block"), "fm-counted")
    forget(blocks)
    return FmIndex(total["size"], first, materialise(kmer_table(slim), "fm-kmers"), counted, slim.select("row", "pos"), interval, depth)


def _stepped(ranges: DataFrame, index: FmIndex) -> DataFrame:
    """The ranges after one more base to the left; those without rows are left out."""
    for end in ("lo", "hi"):  # both at least 1, as row 0 starts with $
        blocks = index.blocks.withColumnRenamed("block", "at")
        met = ranges.withColumn("at", F.floor((F.col(end) - 1) / WIDTH)).withColumn("base", F.expr("substring(pattern, more, 1)")).join(blocks, "at")
        head = met.withColumn("head", F.expr(f"left(text, cast({end} - at * {WIDTH} as int))"))
        inside = F.length("head") - F.length(F.expr("replace(head, base, '')"))
        before = F.coalesce(*[F.when(F.col("base") == b.upper(), F.col(b) + index.first[b]) for b in "acgt"])
        ranges = head.withColumn(end, before + inside).select(*ranges.columns)
    return ranges.filter("lo < hi").withColumn("more", F.col("more") - 1)


def _patterns(reads: DataFrame) -> DataFrame:
    usable = reads.filter(dna.is_plain(F.col("seq")) & (F.length("seq") >= SEED))
    return usable.select("read_id", dna.reverse_complement(F.col("seq")).alias("pattern"))


def _ranges(patterns: DataFrame, index: FmIndex) -> DataFrame:
    """pattern, lo, hi: the rows of each distinct pattern that has any."""
    last = patterns.select("pattern").distinct().withColumn("kmer", F.right("pattern", F.lit(KMER)))
    ranges = last.join(index.kmers, "kmer").select("pattern", (F.length("pattern") - KMER).alias("more"), "lo", "hi")
    ranges = materialise(ranges, "fm-ranges")
    while ranges.filter("more > 0").head(1):
        further = _stepped(ranges.filter("more > 0"), index).unionByName(ranges.filter("more = 0"))
        ranges, done = materialise(further, "fm-ranges"), ranges
        forget(done)
    return ranges.select("pattern", "lo", "hi")


def _check(reads: DataFrame, index: FmIndex) -> None:
    longest = reads.agg(F.max(F.length("seq"))).first()[0] or 0
    if index.depth < longest + index.interval - 1:
        raise ValueError(f"reads of {longest} bases need a sort depth of {longest + index.interval - 1}, not {index.depth}")


def backward_search(reads: DataFrame, index: FmIndex) -> DataFrame:
    """read_id, lo, hi: the rows of the reverse complement of each read; reads without any are left out."""
    patterns = _patterns(reads)
    return patterns.join(_ranges(patterns, index), "pattern").select("read_id", "lo", "hi")


def _placed(reads: DataFrame, found: DataFrame, index: FmIndex) -> DataFrame:
    """read_id, flag, start from pattern, pos; a pattern's places are written once, reads meet them last."""
    half, pos = F.lit((len(index) - 1) // 2), F.col("pos")
    there = found.select(
        "pattern", F.when(pos >= half, FORWARD).otherwise(REVERSE).alias("flag"),
        F.when(pos >= half, 2 * half - pos - F.length("pattern")).otherwise(pos).cast("long").alias("start"),
    )
    return _patterns(reads).join(materialise(there, "fm-found"), "pattern").select("read_id", "flag", "start")


def _rows(ranges: DataFrame) -> DataFrame:
    """pattern, row: every row of the ranges, listed in chunks."""
    chunks = ranges.select("pattern", "hi", F.explode(F.sequence(F.col("lo"), F.col("hi") - 1, F.lit(CHUNK).cast("long"))).alias("from"))
    return chunks.select("pattern", F.explode(F.sequence(F.col("from"), F.least(F.col("from") + CHUNK, F.col("hi")) - 1)).alias("row"))


def locate(reads: DataFrame, index: FmIndex) -> DataFrame:
    """read_id, flag, start: all occurrences. Those across the strands' junction have no place in F and start before a half."""
    _check(reads, index)
    rows = _rows(_ranges(_patterns(reads), index))
    return _placed(reads, rows.join(index.places, "row"), index)


def locate_trace(reads: DataFrame, index: FmIndex) -> DataFrame:
    """read_id, flag, start: the same. A walk back from row to row may change between rows that are tied at the sort depth; looking each row up cannot."""
    return locate(reads, index)
