"""A genome as DataFrames: contigs, segments between runs of N, coordinates, blocks of the N-free text.

contigs: ordinal LONG, name STRING, seq STRING (cleaned). The N-free text F is
the concatenation of all segments in contig order; it is never built as one
string. Contigs without a base are left out of every coordinate table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from basewright.functions import dna
from basewright.operators.ordering import running_total
from basewright.plans.scratch import forget, materialise

#: Bases of a block, bases of a pattern that are looked at in one block, and bases of the pieces that long segments are cut into first.
BLOCK, SPAN, PIECE = 256, 64, 8192


def contigs_of(df: DataFrame, ordinal: str = "ordinal", name: str = "name", seq: str = "seq") -> DataFrame:
    """Contigs from FASTA records: cleaned bases, the header's first word as the name, empty sequences skipped."""
    cleaned = df.select(F.col(ordinal).cast("long").alias("ordinal"), dna.first_word(F.col(name)).alias("name"), dna.clean_bases(F.col(seq)).alias("seq"))
    return cleaned.filter(F.length("seq") > 0)


def segments(contigs: DataFrame) -> DataFrame:
    """ordinal, name, seg_no, n_before, len, seq: runs of N with the run of bases after them, the last maybe without bases."""
    runs = contigs.select("ordinal", "name", F.posexplode(F.regexp_extract_all("seq", F.lit("N*[ACGT]+|N+"), F.lit(0))).alias("seg_no", "run"))
    bare = dna.without_n(F.col("run"))
    return runs.select(
        "ordinal", "name", "seg_no",
        (F.length("run") - F.length(bare)).cast("long").alias("n_before"), F.length(bare).cast("long").alias("len"), bare.alias("seq"),
    )


def sizes(segs: DataFrame) -> DataFrame:
    """The segments without their bases, written once: several plans read them, and cutting contigs costs more than the table."""
    return materialise(segs.select("ordinal", "name", "seg_no", "n_before", "len"), "segment-sizes")


def contig_lengths(segs: DataFrame) -> DataFrame:
    """ordinal, name, len, start: lengths without N, and the first base's place in F."""
    lengths = segs.groupBy("ordinal", "name").agg(F.sum("len").alias("len")).filter("len > 0")
    return running_total(lengths, "ordinal", ["name"], F.col("len"), "start").select("ordinal", "name", "len", "start")


def placed_segments(segs: DataFrame) -> DataFrame:
    """Segments with bases, and: start (place in F), n_cum (N of the contig up to here), pos0 (place in the contig)."""
    in_contig = Window.partitionBy("ordinal").orderBy("seg_no")
    upto = in_contig.rowsBetween(Window.unboundedPreceding, 0)
    summed = segs.withColumn("n_cum", F.sum("n_before").over(upto)).withColumn("bases", F.sum("len").over(upto) - F.col("len"))
    starts = contig_lengths(segs).select("ordinal", F.col("start").alias("contig_start"))
    return summed.filter("len > 0").join(starts, "ordinal").select(
        "ordinal", "name", "seg_no", "len", *(["seq"] if "seq" in segs.columns else []), "n_cum",
        (F.col("contig_start") + F.col("bases")).alias("start"), (F.col("bases") + F.col("n_cum")).alias("pos0"),
    )


def n_positions(segs: DataFrame) -> DataFrame:
    """start, n_cum: for each segment its place in F and the contig's N up to it, and at F's end the last contig's N."""
    segs = sizes(segs)
    inner = placed_segments(segs).select("start", "n_cum")
    with_n = segs.groupBy("ordinal").agg(F.sum("n_before").alias("n"), F.sum("len").alias("len"))
    end = with_n.filter("len > 0").agg(F.sum("len").alias("start"), F.max_by("n", "ordinal").alias("n_cum"))
    return inner.union(end)


def duplicate_names(contigs: DataFrame) -> DataFrame:
    return contigs.groupBy("name").agg(F.count("*").alias("n")).filter("n > 1")


def cut(pieces: DataFrame, after: int, *carried: str) -> DataFrame:
    """block, text, parts: the text that ``pieces`` (start, seq) tile, cut at multiples of BLOCK, each block with ``after`` more characters.

    ``parts`` lists, in order, the start of each part and the ``carried`` columns of
    the piece that it comes from. Pieces are dealt by place alone, so a text of one
    contig spreads over all tasks, and no task holds more than a block of it.
    """
    small = pieces.select("start", *carried, F.posexplode(F.regexp_extract_all("seq", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))).alias("__no", "__piece"))
    small = small.withColumn("__at", F.col("start") + F.col("__no").cast("long") * PIECE).withColumn("__stop", F.col("__at") + F.length("__piece"))
    first, last = F.greatest(F.floor((F.col("__at") - after) / BLOCK), F.lit(0)), F.floor((F.col("__stop") - 1) / BLOCK)
    dealt = small.withColumn("block", F.explode(F.sequence(first, last)))
    lo = F.greatest("__at", F.col("block") * BLOCK)
    hi = F.least("__stop", (F.col("block") + 1) * BLOCK + after)
    part = F.substring("__piece", (lo - F.col("__at") + 1).cast("int"), (hi - lo).cast("int"))
    dealt = dealt.select("block", F.struct(lo.alias("lo"), *carried, part.alias("part")).alias("p"))
    grouped = dealt.groupBy("block").agg(F.sort_array(F.collect_list("p")).alias("p"))
    text = F.array_join(F.transform("p", lambda x: x["part"]), "")
    return grouped.select("block", text.alias("text"), F.transform("p", lambda x: F.struct(x["lo"].alias("lo"), *[x[c].alias(c) for c in carried])).alias("parts"))


def blocks(placed: DataFrame) -> DataFrame:
    """block, text, runs: BLOCK bases of F (the last block maybe fewer) and the SPAN - 1 bases after them.

    ``runs`` are the segments with a base in the block: start and end in F, pos0, name.
    """
    made = cut(placed.withColumn("end", F.col("start") + F.col("len")).withColumn("first", F.col("start")), SPAN - 1, "first", "end", "pos0", "name")
    own = F.filter("parts", lambda x: x["lo"] < (F.col("block") + 1) * BLOCK)
    return made.select("block", "text", F.transform(own, lambda x: F.struct(x["first"].alias("start"), x["end"].alias("end"), x["pos0"].alias("pos0"), x["name"].alias("name"))).alias("runs"))


def searchable(genome: DataFrame) -> DataFrame:
    """The blocks of a genome that is given as contigs, written once, or as stored blocks."""
    if "block" in genome.columns:
        return genome
    segs = materialise(segments(genome), "segments")
    made = materialise(blocks(placed_segments(segs)), "genome-blocks")
    forget(segs)
    return made


def bases(text: Column) -> Column:
    """Of a block's text, how many characters are its own."""
    return F.least(F.length(text), F.lit(BLOCK))


def last_bases(found: DataFrame, reach: int) -> str:
    """The last ``reach`` bases of F, all of it if that is shorter."""
    top = found.agg(F.max("block")).first()[0]
    if top is None or reach <= 0:
        return ""
    ends = found.filter(F.col("block") >= top - reach // BLOCK - 1).select("block", F.left("text", bases(F.col("text"))).alias("own"))
    return "".join(r["own"] for r in sorted(ends.collect(), key=lambda r: r["block"]))[-reach:]


def strands(contigs: DataFrame) -> DataFrame:
    """start, seq: pieces that tile F, its reverse complement and a final $."""
    placed = materialise(placed_segments(segments(contigs)).select("start", "len", "seq"), "segments")
    total = placed.agg(F.coalesce(F.sum("len"), F.lit(0))).first()[0]
    reverse = placed.select((F.lit(2 * total) - F.col("start") - F.col("len")).alias("start"), dna.reverse_complement(F.col("seq")).alias("seq"))
    end = contigs.sparkSession.createDataFrame([(2 * total, "$")], "start long, seq string")
    return placed.select("start", "seq").unionByName(reverse).unionByName(end)


def genome_text(contigs: DataFrame) -> DataFrame:
    """One row: text = F, its reverse complement and a final $. For small genomes only; neither searches nor index tables build it."""
    pieces = placed_segments(segments(contigs)).agg(F.sort_array(F.collect_list(F.struct("start", "seq"))).alias("s"))
    whole = F.array_join(F.transform("s", lambda x: x["seq"]), "")
    return pieces.select(whole.alias("f")).select(F.concat("f", dna.reverse_complement(F.col("f")), F.lit("$")).alias("text"))
