"""Exact, ungapped mapping of reads to a genome as a seed join.

A read and its reverse complement are two patterns. A pattern is looked at in
pieces of up to SPAN bases. The first bases of a piece, its seed (LONG_SEED of them, or
SEED where the piece is shorter), meet the k-mers of F's blocks in a hash join, and
the rest of the piece is compared with the text behind the k-mer; a pattern of
several pieces stands where all of them do. K-mers that are no piece's seed are
dropped before anything is shuffled, by a bit set of bounded size. Everything else
is a filter or a window:

* ``raw_n`` counts all occurrences in F and its reverse complement, also those
  that cross a gap, a contig's end or the junction of the two strands; a read
  with more than ``max_hits`` of them is not reported (negative: no cap), and its
  hits are not expanded.
* a hit counts only inside one run of bases (``run_left >= length``), which
  rules out gaps and contig ends at once.
* a palindrome gives a row for each strand.

A genome is given as contigs, or as the blocks that an index stores.
Reads shorter than the seed or with other characters than A, C, G, T do not map;
reads have any length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basewright.functions import dna, sieve
from basewright.operators import genome
from basewright.operators.genome import BLOCK, SPAN
from basewright.plans.scratch import distilled, materialise

SEED, LONG_SEED = 12, 24
#: A seed is hot if more than one in so many sampled places has it; there are never more hot seeds. Its places are dealt over SALTS.
HOT_SHARE, SALTS = 1000, 32
#: Defaults of the interface.
MAX_HITS, BOTH_STRANDS = 1000, 2
FORWARD, REVERSE = 0, 16


def patterns(reads: DataFrame, seed: int = SEED) -> DataFrame:
    """read_id, flag, pattern: both orientations of every usable read."""
    usable = reads.filter(dna.is_plain(F.col("seq")) & (F.length("seq") >= seed)).select("read_id", "seq")
    forward = usable.select("read_id", F.lit(FORWARD).alias("flag"), F.col("seq").alias("pattern"))
    reverse = usable.select("read_id", F.lit(REVERSE).alias("flag"), dna.reverse_complement(F.col("seq")).alias("pattern"))
    return forward.union(reverse)


def pieces(distinct: DataFrame) -> DataFrame:
    """pattern, of (pieces of it), off, piece, seed: each pattern in pieces of SPAN, the last one ending with it."""
    last = F.greatest(F.length("pattern") - SPAN, F.lit(0))
    offs = F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(SPAN)), F.array(last)))
    cut = distinct.select("pattern", F.size(offs).alias("of"), F.explode(offs).alias("off"))
    cut = cut.withColumn("piece", F.substring("pattern", F.col("off") + 1, F.lit(SPAN)))
    n = F.length("piece")
    size = F.when(n >= LONG_SEED, LONG_SEED).when(n >= SEED, SEED).otherwise(n)
    return cut.withColumn("seed", F.substring("piece", F.lit(1), size))


def kmers(blocks: DataFrame, k: int, words=None) -> DataFrame:
    """seed, start, rest, pos0, run_left, name: each place of F that starts a k-mer, or those in ``words``, a broadcast bit set.

    ``rest`` is what follows the k-mer, up to SPAN bases after its first one.
    """
    rows = _places(blocks.withColumn("start", F.col("block") * BLOCK), k, words, BLOCK, "runs")
    run = F.element_at(F.filter("runs", lambda x: x["start"] <= F.col("start")), -1)
    rows = rows.select("seed", "start", "rest", F.when(F.size("runs") > 0, run).alias("run"))
    return rows.select(
        "seed", "start", "rest", (F.col("run.pos0") + F.col("start") - F.col("run.start")).alias("pos0"),
        (F.col("run.end") - F.col("start")).alias("run_left"), F.col("run.name").alias("name"),
    )


def _places(texts: DataFrame, k: int, words, own: int | None, *carried: str) -> DataFrame:
    """seed, start, rest and the carried columns of texts (start, text), of each of which the first ``own`` characters are places."""
    if words is not None:
        at = sieve.sifted(texts, k, words, SPAN, own, *carried)
        return at.select(F.left("window", F.lit(k)).alias("seed"), "start", F.substring("window", k + 1, SPAN - k).alias("rest"), *carried)
    at = texts.withColumn("i", F.explode(F.sequence(F.lit(0), genome.bases(F.col("text")) - 1)))
    at = at.withColumn("seed", F.substring("text", F.col("i") + 1, F.lit(k))).filter(F.length("seed") == k)
    rest = F.substring("text", F.col("i") + 1 + k, F.lit(SPAN - k))
    return at.select("seed", (F.col("start") + F.col("i")).alias("start"), rest.alias("rest"), *carried)


def seed_join(pats: DataFrame, index: DataFrame, seed: int = SEED) -> DataFrame:
    """Every place of F whose k-mer starts a distinct pattern."""
    distinct = pats.select("pattern", F.substring("pattern", 1, seed).alias("seed")).distinct()
    return distinct.join(index, "seed")


def _hot_seeds(sample: DataFrame) -> DataFrame:
    """seed, hot: the seeds of more than one in HOT_SHARE sampled places. They only steer how rows are dealt."""
    total = sample.count()
    first = sample.groupBy("seed").agg(F.count("*").alias("n"))
    return first.filter((F.col("n") * HOT_SHARE > total) & (F.col("n") > 1)).select("seed", F.lit(True).alias("hot"))


def occurrences(distinct: DataFrame, places, *keys: str) -> DataFrame:
    """pattern, start, the keys, and what ``places(k, words)`` gives first: where the whole of each distinct pattern stands.

    ``distinct`` is a table of patterns; ``keys`` tell texts with places of their own apart.
    The second that ``places`` gives is a sample of seeds, by which the hot ones are known.
    """
    cut = pieces(distinct)
    words = distinct.sparkSession.sparkContext.broadcast(sieve.bit_set(cut, distinct.count()))
    sizes = [r["k"] for r in cut.select(F.length("seed").alias("k")).distinct().collect()]  # at most SEED + 1 different ones
    found = None
    for k in sizes:
        rows, sample = places(k, words)
        hot = F.broadcast(_hot_seeds(sample))  # at most HOT_SHARE rows
        dealt = rows.join(hot, "seed", "left")
        dealt = dealt.withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("start"), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))).drop("hot")
        wanted = cut.filter(F.length("seed") == k).join(hot, "seed", "left")
        wanted = wanted.withColumn("salt", F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).drop("hot")
        some = dealt.join(wanted, ["seed", "salt"]).filter(F.expr(f"startswith(rest, substring(piece, {k + 1}))"))
        found = some if found is None else found.unionByName(some)
    if found is None:
        return places(SEED, words)[0].join(distinct.limit(0), F.lit(True)).drop("seed", "rest")
    found = found.withColumn("start", F.col("start") - F.col("off")).drop("seed", "salt", "rest", "piece")
    single = found.filter("of = 1").drop("of", "off")
    if not distinct.filter(F.length("pattern") > SPAN).head(1):
        return single
    others = [c for c in single.columns if c not in ("pattern", "start", *keys)]
    whole = found.filter("of > 1").groupBy("pattern", *keys, "start").agg(
        F.count("*").alias("n"), F.first("of").alias("of"), F.max_by(F.struct("off", *others), -F.col("off")).alias("at")
    )
    return single.unionByName(whole.filter("n = of").select("pattern", *keys, "start", *[F.col(f"at.{c}").alias(c) for c in others]))


def _junction(blocks: DataFrame, reach: int) -> tuple[DataFrame, int]:
    """(blocks of the last ``reach`` bases of F and their mirror, at places below 0; the place at which the mirror starts)."""
    tail = genome.last_bases(blocks, reach)
    text = tail + tail[::-1].translate(str.maketrans(dna.BASES, dna.COMPLEMENT))
    first = -(len(text) // BLOCK + 2)
    rows = [(first + i, text[BLOCK * i : BLOCK * (i + 1) + SPAN - 1], []) for i in range(-(-len(text) // BLOCK))]
    return blocks.sparkSession.createDataFrame(rows, blocks.schema), first * BLOCK + len(tail)


def _found(pats: DataFrame, genome_: DataFrame) -> DataFrame:
    """pattern, start, pos0, run_left, name; places across the junction have none but a start below 0."""
    blocks = genome.searchable(genome_)
    distinct = materialise(pats.select("pattern").distinct(), "patterns")
    longest = distinct.agg(F.max(F.length("pattern"))).first()[0] or SEED
    across, mirror = _junction(blocks, longest - 1)
    every = blocks.unionByName(across)
    found = occurrences(distinct, lambda k, words: (kmers(every, k, words), blocks.select(F.left("text", F.lit(k)).alias("seed"))))
    return found.filter((F.col("start") >= 0) | ((F.col("start") < mirror) & (F.col("start") + F.length("pattern") > mirror)))


def places(reads: DataFrame, genome_: DataFrame, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """((read_id, flag, pattern), (pattern, start, pos0, run_left, name)): patterns of reads, and where each distinct one stands.

    Both grow with reads and genome only; their join, the hits, may grow with the product.
    """
    pats = materialise(patterns(reads, seed), "read-patterns")
    return pats, distilled(lambda: _found(pats, genome_), "occurrences")


def raw_hits(reads: DataFrame, genome_: DataFrame, seed: int = SEED, max_hits: int = -1) -> DataFrame:
    """read_id, flag, name, start, pos0, run_left, len, raw_n: all hits in F, also those that later filters drop.

    Hits of reads with more than ``max_hits`` raw hits are counted but not expanded.
    """
    pats, found = places(reads, genome_, seed)
    sizes = found.groupBy("pattern").agg(F.count_if(F.col("start") >= 0).alias("n"), F.count_if(F.col("start") < 0).alias("across"))
    every = F.col("n") + F.when(F.col("flag") == REVERSE, F.col("across")).otherwise(0)
    raw = pats.join(sizes, "pattern").groupBy("read_id").agg(F.sum(every).alias("raw_n")).filter("raw_n > 0")
    few = pats.join(capped(raw, max_hits), "read_id")
    return few.join(found.filter("start >= 0"), "pattern").select(
        "read_id", "flag", "name", "start", "pos0", "run_left", F.length("pattern").cast("long").alias("len"), "raw_n"
    )


def capped(raw: DataFrame, max_hits: int = MAX_HITS) -> DataFrame:
    """Reads with more raw hits than the cap are not reported; a negative cap means none."""
    return raw if max_hits < 0 else raw.filter(F.col("raw_n") <= max_hits)


def inside_runs(raw: DataFrame) -> DataFrame:
    return raw.filter("run_left >= len")


def on_strand(hits: DataFrame, strand: int = BOTH_STRANDS) -> DataFrame:
    """0: forward, 1: reverse, anything else: both."""
    return hits.filter(F.col("flag") == (FORWARD, REVERSE)[strand]) if strand in (0, 1) else hits


def counted(hits: DataFrame) -> DataFrame:
    """Add nh, the number of reported hits of the read."""
    sizes = hits.groupBy("read_id").agg(F.count("*").alias("nh"))
    return hits.join(sizes, "read_id")


def hits(reads: DataFrame, genome_: DataFrame, max_hits: int = MAX_HITS, strand: int = BOTH_STRANDS, seed: int = SEED) -> DataFrame:
    return counted(on_strand(inside_runs(raw_hits(reads, genome_, seed, max_hits)), strand))


def sam_rows(found: DataFrame, reads: DataFrame) -> DataFrame:
    """The SAM columns of every hit."""
    rows = found.join(reads.select("read_id", F.col("name").alias("qname"), "seq", "qual"), "read_id")
    reverse = F.col("flag") == REVERSE
    return rows.select(
        "qname", F.col("flag").cast("int").alias("flag"), F.col("name").alias("rname"), (F.col("pos0") + 1).cast("long").alias("pos"),
        F.lit(255).alias("mapq"), F.concat(F.length("seq").cast("string"), F.lit("M")).alias("cigar"), F.lit("*").alias("rnext"),
        F.lit(0).cast("long").alias("pnext"), F.lit(0).cast("long").alias("tlen"),
        F.when(reverse, dna.reverse_complement(F.col("seq"))).otherwise(F.col("seq")).alias("seq"),
        F.when(reverse, F.reverse("qual")).otherwise(F.col("qual")).alias("qual"), F.col("nh").cast("int").alias("nh"),
    )


def align(reads: DataFrame, genome_: DataFrame, max_hits: int = MAX_HITS, strand: int = BOTH_STRANDS, seed: int = SEED) -> DataFrame:
    return sam_rows(hits(reads, genome_, max_hits, strand, seed), reads)


def per_record(rows: DataFrame, callback, schema: str) -> DataFrame:
    """``callback`` (a record as a dict, giving dicts of ``schema``) on every record, in the executors."""
    columns = [part.strip().split(" ")[0] for part in schema.split(",")]

    def run(batches):
        import pandas as pd

        for batch in batches:
            out = [made for record in batch.to_dict("records") for made in callback(record)]
            yield pd.DataFrame(out, columns=columns)

    return rows.mapInPandas(run, schema)


def statistics(found: DataFrame, reads: DataFrame) -> DataFrame:
    """total, mapped, uniq, multi, sam_rows, mappability (percent; null without reads)."""
    per_read = found.groupBy("read_id").agg(F.max("nh").alias("nh"))
    counts = reads.select("read_id").join(per_read, "read_id", "left").agg(
        F.count("*").alias("total"), F.count("nh").alias("mapped"), F.count_if(F.col("nh") == 1).alias("uniq"),
        F.count_if(F.col("nh") > 1).alias("multi"), F.coalesce(F.sum("nh"), F.lit(0)).cast("long").alias("sam_rows"),
    )
    return counts.withColumn("mappability", F.when(F.col("total") > 0, 100.0 * F.col("mapped") / F.col("total")))


def text_search(texts: DataFrame, passages: DataFrame) -> DataFrame:
    """text_id, item_id, pos: places of whole passages in texts of any alphabet, by the same seed join, without blocks.

    texts: text_id, text; passages: item_id, passage. Empty passages and null texts give nothing.
    """
    whole = texts.filter("text <> ''").select("text_id", "text", F.lit(0).cast("long").alias("start"))

    def places(k: int, words) -> tuple[DataFrame, DataFrame]:
        passed = materialise(_places(whole, k, words, None, "text_id"), "passed-places")  # few beyond the passages' own
        return passed, passed.select("seed")

    def make() -> DataFrame:
        wanted = passages.filter("passage <> ''")
        distinct = materialise(wanted.select(F.col("passage").alias("pattern")).distinct(), "passages")
        found = occurrences(distinct, places, "text_id")
        return found.join(wanted, found["pattern"] == wanted["passage"]).select("text_id", "item_id", F.col("start").cast("long").alias("pos"))

    return distilled(make, "passages-found")
