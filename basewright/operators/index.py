"""Suffix order, Burrows-Wheeler and FM tables of a text as DataFrames, and the stored index.

The text ends in $, which sorts before A < C < G < T in binary order. It is given
as pieces (start, seq) that tile it, or as one row (text); suffixes come from its
blocks, so the work grows with its length. Rows of the suffix order are numbered
within sampled ranges of (suffix, position), so no single task sorts the text and
no repeat is too long for one; ties beyond ``depth`` characters go by position.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from basewright.operators import genome
from basewright.operators.ordering import numbered, numbered_by, offsets, running_total
from basewright.plans.scratch import materialise, scope

#: Defaults of the interface: characters that the suffix sort looks at, and rows between checkpoints.
DEPTH, INTERVAL = 256, 64
KMER = 12


def suffixes(text: DataFrame, depth: int = DEPTH) -> DataFrame:
    """pos, suffix (cut to depth), prev (the character before it, $ for the first)."""
    pieces = text if "seq" in text.columns else text.select(F.lit(0).cast("long").alias("start"), F.col("text").alias("seq"))
    blocks = genome.cut(pieces, depth).select("block", "text")
    # Every character gives the suffix after it; the last one, $, gives the first suffix of the text.
    at = blocks.withColumn("i", F.explode(F.sequence(F.lit(0), genome.bases(F.col("text")) - 1)))
    prev = F.substring("text", F.col("i") + 1, F.lit(1))
    after = at.select(
        (F.col("block") * genome.BLOCK + F.col("i") + 1).alias("pos"), F.substring("text", F.col("i") + 2, F.lit(depth)).alias("suffix"), prev.alias("prev")
    ).filter("prev <> '$'")
    first = blocks.filter("block = 0").select(F.lit(0).cast("long").alias("pos"), F.left("text", F.lit(depth)).alias("suffix"), F.lit("$").alias("prev"))
    return after.unionByName(first)


def suffix_rows(text: DataFrame, depth: int = DEPTH) -> DataFrame:
    """row, pos, suffix, prev in suffix order."""
    return numbered_by(suffixes(text, depth), ["suffix", "pos"], "row").select("row", "pos", "suffix", "prev")


def suffix_array(text: DataFrame, depth: int = DEPTH) -> DataFrame:
    return suffix_rows(text, depth).select("row", "pos")


def suffix_array_full(text: DataFrame) -> DataFrame:
    """Untruncated suffix order by rank doubling: each round joins ranks with the ranks h places on."""
    ranked = suffixes(text, 1).select("pos", F.expr("instr('$ACGT', suffix)").cast("long").alias("rank"))
    n, h = ranked.count(), 1
    while True:
        ranked = materialise(ranked, "ranks")
        if ranked.select("rank").distinct().count() == n or h >= n:
            return ranked.select((F.col("rank") - 1).alias("row"), "pos")
        ahead = ranked.select((F.col("pos") - h).alias("pos"), F.col("rank").alias("ahead"))
        both = ranked.join(ahead, "pos", "left").withColumn("ahead", F.coalesce("ahead", F.lit(0).cast("long")))
        # Rows of one rank are ordered among themselves; ranks count the rows before, so they stay comparable.
        inside = Window.partitionBy("rank").orderBy("ahead")
        before = ranked.groupBy("rank").agg(F.count("*").alias("size"))
        starts = running_total(before, "rank", [], F.col("size"), "base")
        ranked = both.withColumn("in_rank", F.rank().over(inside)).join(starts.select("rank", "base"), "rank").select(
            "pos", (F.col("base") + F.col("in_rank")).cast("long").alias("rank")
        )
        h *= 2


def bwt(rows: DataFrame) -> DataFrame:
    return rows.select("row", F.col("prev").alias("base"))


def c_table(rows: DataFrame) -> DataFrame:
    """base, lo: the first row whose suffix starts with that base."""
    sizes = rows.filter("prev <> '$'").groupBy(F.col("prev").alias("base")).agg(F.count("*").alias("n"))
    every = rows.sparkSession.createDataFrame([(b,) for b in "ACGT"], "base string")
    before = Window.orderBy("base").rowsBetween(Window.unboundedPreceding, -1)
    full = every.join(sizes, "base", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return full.select("base", (F.coalesce(F.sum("n").over(before), F.lit(0)) + 1).cast("long").alias("lo"))


def kmer_table(rows: DataFrame, k: int = KMER) -> DataFrame:
    """kmer, lo, hi: the rows [lo, hi) whose suffixes start with the k-mer."""
    starts = rows.withColumn("kmer", F.substring("suffix", 1, k)).filter(F.col("kmer").rlike(f"^[ACGT]{{{k}}}$"))
    return starts.groupBy("kmer").agg(F.min("row").alias("lo"), (F.max("row") + 1).alias("hi"))


def occ_rank(rows: DataFrame) -> DataFrame:
    """row, a, c, g, t: how often each base stands in the transform before that row."""
    width = 4096
    flags = rows.select("row", F.floor(F.col("row") / width).alias("block"), *[(F.col("prev") == b).cast("long").alias(b.lower()) for b in "ACGT"])
    totals = flags.groupBy("block").agg(*[F.sum(c).alias("s" + c) for c in "acgt"])
    totals = offsets(totals, "block", {"o" + c: "s" + c for c in "acgt"}).select("block", *["o" + c for c in "acgt"])
    inside = Window.partitionBy("block").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    summed = flags.select("row", "block", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(c) for c in "acgt"])
    return summed.join(totals, "block").select("row", *[(F.col(c) + F.col("o" + c)).cast("long").alias(c) for c in "acgt"])


def occ_checkpoints(rows: DataFrame, interval: int = INTERVAL) -> DataFrame:
    return occ_rank(rows).filter(F.col("row") % interval == 0)


def location_table(rows: DataFrame, interval: int = INTERVAL) -> DataFrame:
    """row, pos of the sampled suffixes."""
    return rows.filter(F.col("pos") % interval == 0).select("row", "pos")


def sample_distance(rows: DataFrame, interval: int = INTERVAL) -> DataFrame:
    """row, dist: steps back in the text to a sampled suffix; 0 marks the sampled ones."""
    return rows.select("row", (F.col("pos") % interval).cast("int").alias("dist"))


def location_join(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Positions of wanted rows."""
    return wanted.join(rows.select("row", "pos"), "row")


def split_classes(text: DataFrame, splits: int, depth: int = DEPTH) -> DataFrame:
    """pos, suffix, split: sampled splitters deal the suffixes into ranges that are sorted one by one."""
    dealt = suffixes(text, depth).repartitionByRange(splits, "suffix", "pos").sortWithinPartitions("suffix", "pos")
    return dealt.select("pos", "suffix", F.spark_partition_id().alias("split"))


# ---- the stored index -------------------------------------------------------------------------------------------------

FORMAT = 2
TABLES = ("contigs", "blocks", "chr_start", "chr_len", "npos_len")
FM_TABLES = ("bwt", "c_table", "occ_checkpoints", "location_table", "fbwt", "kmer_c_table")


class IndexExists(RuntimeError):
    pass


class IndexIncomplete(RuntimeError):
    pass


def _manifest(path: str) -> str:
    return f"{path}/manifest"


def index_is_complete(spark: SparkSession, path: str) -> bool:
    """All tables of the manifest can be read."""
    try:
        spec = json.loads(spark.read.text(_manifest(path)).first()[0])
        for name in spec["tables"]:
            spark.read.parquet(f"{path}/{name}")  # noqa: B018
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return False
        raise
    return spec["format"] == FORMAT


def index_tables(contigs: DataFrame, depth: int = DEPTH, interval: int = INTERVAL, fm: bool = False) -> dict[str, DataFrame]:
    """The tables of an index by name. ``blocks`` is what mapping searches; with ``fm`` there are the FM tables too."""
    segs = genome.segments(contigs)
    lengths = genome.contig_lengths(segs)
    tables = {
        "contigs": contigs, "blocks": genome.blocks(genome.placed_segments(segs)), "chr_start": lengths.select("name", "start"),
        "chr_len": lengths.select("name", "len"), "npos_len": genome.n_positions(segs),
    }
    if fm:
        rows = suffix_rows(genome.strands(contigs), depth)
        rows = materialise(rows.withColumn("suffix", F.left("suffix", F.lit(KMER))), "suffix-rows")  # no table needs more of it
        tables |= {
            "bwt": bwt(rows), "c_table": c_table(rows), "occ_checkpoints": occ_checkpoints(rows, interval),
            "location_table": location_table(rows, interval), "fbwt": sample_distance(rows, interval), "kmer_c_table": kmer_table(rows),
        }
    return tables


def build_index(contigs: DataFrame, path: str, *, depth: int = DEPTH, interval: int = INTERVAL, force: bool = False, fm: bool = False) -> None:
    """Write contigs, blocks and coordinate tables, with ``fm`` the FM tables too, and the manifest last."""
    spark = contigs.sparkSession
    if not 1 <= interval <= 256:
        raise ValueError("the interval must be from 1 to 256")
    if index_is_complete(spark, path) and not force:
        raise IndexExists(path)
    with scope():
        tables = index_tables(contigs, depth, interval, fm)
        for name, table in tables.items():
            table.write.mode("overwrite").parquet(f"{path}/{name}")
    total = spark.read.parquet(f"{path}/chr_len").agg(F.coalesce(F.sum("len"), F.lit(0))).first()[0]
    spec = {"format": FORMAT, "depth": depth, "interval": interval, "bases": total, "tables": list(tables)}
    spark.createDataFrame([(json.dumps(spec),)], "value string").coalesce(1).write.mode("overwrite").text(_manifest(path))


def compared(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """size, wrong: rows of ``stored``, and rows that only one of both has, as multisets; one pass over each."""
    columns = stored.columns
    both = stored.withColumn("__v", F.lit(1)).unionByName(fresh.select(*columns).withColumn("__v", F.lit(-1)))
    counts = both.groupBy(*columns).agg(F.sum("__v").alias("n"), F.count_if(F.col("__v") > 0).alias("size"))
    return counts.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("size"), F.coalesce(F.sum(F.abs("n")), F.lit(0)).alias("wrong"))


def load_index(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    if not index_is_complete(spark, path):
        raise IndexIncomplete(path)
    spec = json.loads(spark.read.text(_manifest(path)).first()[0])
    return {name: spark.read.parquet(f"{path}/{name}") for name in spec["tables"]}
