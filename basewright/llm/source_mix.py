"""Mixing sources to target weights by a low-discrepancy schedule.

Every source's documents, in hash order, form a line of tokens that is cut into
blocks of equal length. The mix is a row of 2**k slots. Slot i has the van der
Corput point bitreverse(i) / 2**k, and the cumulative target shares map that
point to a source, so every stretch of slots holds the sources in nearly their
target proportions. The slots of one source are ranked; the r-th takes the r-th
stretch of the source's line, which starts again when it is used up. Each
source's last slot is cut or stretched to end at the source's target.

A block has LEAST_BLOCK tokens or up to twice as many, so the mix is equally fine at
every size, and the slots grow in proportion to the input. Slots are made in
stretches dealt over all tasks. Running sums, over a hot source, over its slots or
over the sources themselves, are taken in buckets and blocks of buckets, so no task
holds a source or one row of every source.

Defined results: null or wordless texts have size 0 and are never taken; a null
source is a source of its own, ordered last; a table without words gives
targets and taken of 0; rows that repeat id and text are interchangeable; extra
columns are ignored; an empty table gives an empty result. Reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from basewright.llm.common import WORD, distilled, documents, materialise, rows_of
from basewright.operators.ordering import numbered_by, offsets, running_total

#: Weights in source order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: A source is used at most so many times.
MAX_PASSES = 3
#: A block has so many tokens at least, and less than twice as many where the table has that many.
LEAST_BLOCK = 256
#: Points of a stretch that one row makes, and slots of a bucket, the unit of ranking.
STRETCH = 4096
#: Mean rows of a bucket, the unit of running sums.
BUCKET_ROWS = 512
#: Seed of the shuffled order inside a source.
SEED = 20


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """One row per source: skey, source, place, source_size, n_docs, target, lo, hi.

    A source's target is min(weight * level, MAX_PASSES * size) for the one level
    at which targets sum to all tokens: the limit of resharing excess by weight.
    lo and hi are the source's cumulative share, 0 to 1. Only totals reach the driver.
    """
    by_source = sizes.groupBy("skey").agg(
        F.first("source").alias("source"), F.sum("size").alias("source_size"), F.count("*").alias("n_docs")
    )
    weights = F.array(*[F.lit(w) for w in WEIGHTS])
    placed = numbered_by(by_source, [F.col("source").asc_nulls_last()], "place")
    placed = placed.withColumn("weight", F.get(weights, (F.col("place") % len(WEIGHTS)).cast("int")))
    placed = placed.withColumn("most", (F.col("source_size") * MAX_PASSES).cast("double")).withColumn("fill", F.col("most") / F.col("weight"))
    filled = numbered_by(placed, ["fill", "place"], "turn")
    filled = running_total(filled, "turn", [], F.col("most"), "most_before")
    filled = materialise(running_total(filled, "turn", [], F.col("weight"), "weight_before"), "mix-sources")
    sums = filled.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight"), F.count("*").alias("sources")).first()
    level = (F.lit(float(sums["size"] or 0)) - F.col("most_before")) / (F.lit(float(sums["weight"] or 1)) - F.col("weight_before"))
    best = filled.agg(F.max(level)).first()[0] or 0.0
    targeted = filled.withColumn("target", F.least(F.col("weight") * best, F.col("most")))
    # Shares are of whole tokens, so that sums do not depend on the order of adding.
    targeted = running_total(targeted.withColumn("quota", F.round("target").cast("long")), "place", [], F.col("quota"), "quota_before")
    targeted = materialise(targeted, "mix-sources")
    total = targeted.agg(F.sum("quota")).first()[0] or 0
    share = lambda tokens: tokens / F.lit(float(total)) if total else F.lit(0.0)
    last = F.col("place") == (sums["sources"] or 0) - 1
    return targeted.select(
        "skey", "source", F.col("place").cast("int").alias("place"), "source_size", "n_docs", "target",
        share(F.col("quota_before")).alias("lo"), F.when(last & F.lit(total > 0), F.lit(1.0)).otherwise(share(F.col("quota_before") + F.col("quota"))).alias("hi"),
    )


def token_line(sizes: DataFrame, targets: DataFrame, rows: int) -> DataFrame:
    """Every document with its start on its source's token line."""
    buckets = max(1, -(-rows // BUCKET_ROWS))
    hashed = sizes.withColumn("bucket", F.shiftrightunsigned("hash", 1) % F.lit(buckets))
    starts = offsets(hashed.groupBy("skey", "bucket").agg(F.sum("size").alias("bucket_size")), "bucket", {"offset": "bucket_size"}, ["skey"])
    starts = starts.join(targets.select("skey", "place", "source_size", "target"), "skey")
    starts = starts.select("skey", "bucket", "offset", "place", "source_size", "target")
    running = Window.partitionBy("skey", "bucket").orderBy("hash", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    placed = hashed.withColumn("upto", F.sum("size").over(running))
    return placed.join(starts, ["skey", "bucket"]).select(
        "doc_id", "hash", "place", "size", "source_size", "target", (F.col("offset") + F.col("upto") - F.col("size")).alias("start")
    )


def schedule(targets: DataFrame, bits: int, block: int) -> DataFrame:
    """The slots: slot, place, rank, source_size, and the stretch [from_token, to_token) of the source's line, unrolled."""
    slots = float(2**bits)
    ends = targets.filter("target >= 0.5").select(
        "place", "source_size", F.round("target").cast("long").alias("quota"),
        F.ceil(F.col("lo") * slots).alias("first"), F.ceil(F.col("hi") * slots).alias("end"),
    )
    # A source too small to own a point still gets one slot, at its place in the row.
    low = F.least("first", F.lit(2**bits - 1))
    ends = ends.select("place", "source_size", "quota", low.alias("low"), F.greatest(F.col("end") - 1, low).alias("high"))
    stretches = ends.withColumn("from", F.explode(F.sequence("low", "high", F.lit(STRETCH)))).repartition("place", "from")
    points = stretches.withColumn("point", F.explode(F.sequence(F.col("from"), F.least(F.col("from") + STRETCH - 1, F.col("high")))))
    reverse = F.conv(F.reverse(F.lpad(F.conv(F.col("point").cast("string"), 10, 2), max(bits, 1), "0")), 2, 10).cast("long")
    slotted = points.withColumn("slot", reverse if bits else F.lit(0).cast("long")).withColumn("bucket", F.floor(F.col("slot") / STRETCH))
    slotted = slotted.withColumn("of", F.col("high") - F.col("low") + 1)
    starts = offsets(slotted.groupBy("place", "bucket").agg(F.count("*").alias("n")), "bucket", {"base": "n"}, ["place"]).drop("n")
    inside = Window.partitionBy("place", "bucket").orderBy("slot")
    # Spark takes the slots for as small as the stretches they are made from and would broadcast them; they grow with the input.
    ranked = slotted.withColumn("at", F.row_number().over(inside) - 1).join(starts.hint("merge"), ["place", "bucket"])
    ranked = ranked.withColumn("rank", F.col("base") + F.col("at"))
    start = F.least(F.col("rank") * block, F.col("quota"))
    end = F.when(F.col("rank") + 1 == F.col("of"), F.col("quota")).otherwise(F.least((F.col("rank") + 1) * block, F.col("quota")))
    return ranked.select("slot", "place", "rank", "source_size", start.alias("from_token"), end.alias("to_token")).filter("to_token > from_token")


def _cut(frame: DataFrame, start: str, end: str, block: int, by: str = "block") -> DataFrame:
    """One row per block of ``block`` tokens that [start, end) touches."""
    first, last = F.floor(F.col(start) / block), F.floor((F.col(end) - 1) / block)
    return frame.withColumn(by, F.explode(F.sequence(first, last)))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """(documents, pieces).

    documents: doc_id, hash, size, source_size, target, place, start, for every row.
    pieces: slot, doc_id, place, start, from_word, to_word: the words
    [from_word, to_word) of that document go into that slot; ``slot`` orders the mix.
    """
    text = F.col(text_col)
    sizes = materialise(
        df.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            F.when(F.col(source_col).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col(source_col).cast("string"))).alias("skey"),
            word_count(text).alias("size"),
            _order_hash(id_col, text_col).alias("hash"),
        ),
        "mix-sizes",
    )
    rows, total = sizes.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    bits = max(0, (total // LEAST_BLOCK).bit_length() - 1)
    block = max(1, -(-total // 2**bits))
    targets = materialise(source_targets(sizes), "mix-targets")
    line = materialise(token_line(sizes, targets, rows), "mix-line")

    slots = schedule(targets, bits, block)
    passes = slots.withColumn(
        "round", F.explode(F.sequence(F.floor(F.col("from_token") / F.col("source_size")), F.floor((F.col("to_token") - 1) / F.col("source_size"))))
    )
    base = F.col("round") * F.col("source_size")
    stretches = passes.select(
        "slot", "place",
        (F.greatest("from_token", base) - base).alias("lo"),
        (F.least("to_token", base + F.col("source_size")) - base).alias("hi"),
    )
    stretches = _cut(stretches, "lo", "hi", block)
    ended = line.filter("size > 0").select("doc_id", "place", "start", (F.col("start") + F.col("size")).alias("end"))
    parts = _cut(ended, "start", "end", block)
    edge = F.col("block") * block
    begin = F.greatest("start", "lo", edge)
    stop = F.least("end", "hi", edge + block)
    pieces = (
        parts.join(stretches.hint("merge"), ["place", "block"])  # as in schedule()
        .filter(stop > begin)
        .select("slot", "doc_id", "place", "start", (begin - F.col("start")).alias("from_word"), (stop - F.col("start")).alias("to_word"))
    )
    return line, pieces


def taken_words(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, hash, size, source_size, target, taken: the words that the mix takes of every row, repeats counted."""
    line, pieces = mix(df, id_col, text_col, source_col)
    taken = pieces.groupBy("place", "start").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"))
    worded = line.filter("size > 0").join(taken, ["place", "start"], "left")  # (place, start) names a row with words
    wordless = line.filter("size = 0").withColumn("taken", F.lit(0).cast("long"))
    return worded.unionByName(wordless.select(worded.columns)).select(
        "doc_id", "hash", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken")
    )


def mixed_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``df`` as often as the mix takes them, to the nearest whole number.

    Only the few rows at an end of their source's stretch are taken in part.
    """
    times = F.sum(F.floor(F.col("taken") / F.col("size") + 0.5)).cast("int").alias("times")
    counted = taken_words(df, id_col, text_col, source_col).filter("size > 0").groupBy("doc_id", "hash").agg(times)
    chosen = distilled(lambda: counted.filter("times > 0").withColumnsRenamed({"doc_id": "id", "hash": "key"}), "taken")
    found = rows_of(df, chosen, _order_hash(id_col, text_col), id_col)
    return found.withColumn("time", F.explode(F.sequence(F.lit(1), "times"))).select("row.*")


def _order_hash(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.lit(SEED), F.col(id_col).cast("string"), F.col(text_col))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken_words(documents(spark, sf_dir)).drop("hash")
