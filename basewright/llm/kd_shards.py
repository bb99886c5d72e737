"""Sharding by a k-d tree over document metadata, native DataFrame operations only.

Dimensions are what the text itself determines (bytes, bytes a character, line
length), each scaled to 24 bits by its range in the table; a hash of the text
fills the key's lower bits. A node splits along its widest dimension at the
weighted median of that key, so both sides hold their share of the bytes, until
every leaf holds one shard, or about the target bytes. Equal texts have equal keys, hence one shard, and no
group of copies is ever joined or gathered; the shard of a row is an expression
of its own columns.

The exact weighted median is found by radix selection for all nodes of a level
at once: sums of bytes by 16 bits of the key, four times. Each such table has at
most 65,536 rows a node, partial sums are made before the shuffle, and the
driver gets one row a node.

Defined results: a null text counts as empty and has size 1; fewer distinct
texts than shards leave shards empty; a text heavier than a shard keeps a shard
of its own or shares one with few others; rows that repeat id and text are
interchangeable; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from basewright.llm.common import documents, materialise
from basewright.operators.ordering import offsets

#: Bits of a scaled dimension; the key has BITS + 38 bits.
BITS, HASH_BITS = 24, 38
#: Mean rows of a numbering bucket.
BUCKET_ROWS = 256
DIMENSIONS = ("bytes", "width", "line")


@dataclass
class Node:
    """A tree node that holds ``shards`` shards from number ``first`` on."""

    first: int
    shards: int
    dimension: str | None = None
    cut: int = 0  # keys below go left
    left: Node | None = None
    right: Node | None = None


def _key(dimension: str) -> Column:
    return F.shiftleft(F.col("scaled_" + dimension), HASH_BITS).bitwiseOR(F.shiftrightunsigned("hash", 64 - HASH_BITS))


def _walk(node: Node, leaf) -> Column:
    """The tree as nested conditions; ``leaf`` gives the value at a node without a split."""
    if node.dimension is None:
        return leaf(node)
    return F.when(_key(node.dimension) < node.cut, _walk(node.left, leaf)).otherwise(_walk(node.right, leaf))


def _cuts(rows: DataFrame, nodes: list[Node], totals: dict[int, int]) -> dict[int, int]:
    """The cut of every node: its left side's bytes are as near to their share as whole keys allow.

    rows: node (the node's first shard), key, size; totals: bytes of each node.
    """
    want = {n.first: totals[n.first] * (n.shards // 2) / n.shards for n in nodes if n.first in totals}
    prefix = dict.fromkeys(want, 0)
    below = dict.fromkeys(want, 0)
    weight = dict.fromkeys(want, 0)
    for shift in (48, 32, 16, 0):
        matches, wanted = F.lit(False), F.lit(None).cast("double")
        for n in want:
            same = F.lit(True) if shift == 48 else F.shiftrightunsigned("key", shift + 16) == F.lit(prefix[n])
            matches = matches | ((F.col("node") == n) & same)
            wanted = F.when(F.col("node") == n, F.lit(float(want[n] - below[n]))).otherwise(wanted)
        digits = (
            rows.filter(matches)
            .groupBy("node", F.shiftrightunsigned("key", shift).bitwiseAND(F.lit(0xFFFF)).alias("digit"))
            .agg(F.sum("size").alias("size"))
        )
        upto = Window.partitionBy("node").orderBy("digit").rowsBetween(Window.unboundedPreceding, 0)
        summed = digits.withColumn("upto", F.sum("size").over(upto)).withColumn("wanted", wanted)
        crossing = summed.filter((F.col("upto") >= F.col("wanted")) & (F.col("upto") - F.col("size") < F.col("wanted")))
        for r in crossing.collect():
            n = r["node"]
            prefix[n] = (prefix[n] << 16) | r["digit"]
            below[n] += r["upto"] - r["size"]
            weight[n] = r["size"]
    # The crossing key goes to the side that leaves the smaller error.
    return {n: prefix[n] + (abs(below[n] + weight[n] - want[n]) < abs(below[n] - want[n])) for n in want}


def grow_tree(rows: DataFrame, shards: int) -> Node:
    """rows: scaled_<dimension>, hash, size. Splits level by level until every leaf is one shard."""
    root = Node(0, shards)
    level = [root] if shards > 1 else []
    while level:
        placed = rows.withColumn("node", _walk(root, lambda n: F.lit(n.first)))
        spans = placed.groupBy("node").agg(F.sum("size").alias("size"), *[(F.max("scaled_" + d) - F.min("scaled_" + d)).alias(d) for d in DIMENSIONS]).collect()
        widest = {r["node"]: max(DIMENSIONS, key=lambda d: r[d]) for r in spans}
        choice = F.lit(None).cast("long")
        for n in level:
            choice = F.when(F.col("node") == n.first, _key(widest.get(n.first, DIMENSIONS[0]))).otherwise(choice)
        keyed = placed.withColumn("key", choice).filter(F.col("key").isNotNull()).select("node", "key", "size")
        cuts = _cuts(keyed, level, {r["node"]: r["size"] for r in spans})
        below = []
        for n in level:
            half = n.shards // 2
            n.dimension, n.cut = widest.get(n.first, DIMENSIONS[0]), cuts.get(n.first, 0)
            n.left, n.right = Node(n.first, half), Node(n.first + half, n.shards - half)
            below += [x for x in (n.left, n.right) if x.shards > 1]
        level = below
    return root


def describe(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, size, text_crc32, hash and the scaled dimensions of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).alias("doc_id"), text.alias("text")).select(
        "doc_id",
        (F.octet_length("text") + 1).cast("long").alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
        F.xxhash64("text").alias("hash"),
        F.length("text").alias("chars"),
        (F.length("text") - F.length(F.translate("text", "\n", "")) + 1).alias("lines"),
    )
    return rows.select(
        "doc_id", "size", "text_crc32", "hash",
        F.log2(F.col("size")).alias("bytes"),
        (F.col("size") / (F.col("chars") + 1)).alias("width"),
        F.log2((F.col("chars") + 1) / F.col("lines")).alias("line"),
    )


def kd_shards(df: DataFrame, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text", *, target_bytes: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard (0 to shards - 1), slot (gapless from 0 in each shard).

    With ``target_bytes`` nodes split until leaves have about that many bytes, else until there are ``shards`` leaves.
    """
    rows = materialise(describe(df, id_col, text_col), "shard-metadata")
    if shards is None:
        shards = max(1, -(-(rows.agg(F.sum("size")).first()[0] or 0) // target_bytes))
    spans = rows.agg(
        F.count("*").alias("rows"), *[f(d).alias(f"{name}_{d}") for d in DIMENSIONS for name, f in (("lo", F.min), ("hi", F.max))]
    ).first()
    scaled = []
    for d in DIMENSIONS:
        lo, hi = spans[f"lo_{d}"] or 0.0, spans[f"hi_{d}"] or 0.0
        step = (2**BITS - 1) / (hi - lo) if hi > lo else 0.0
        scaled.append(F.floor((F.col(d) - lo) * step).cast("long").alias("scaled_" + d))
    rows = rows.select("doc_id", "size", "text_crc32", "hash", *scaled)
    root = grow_tree(rows, shards)

    buckets = max(1, -(-spans["rows"] // (BUCKET_ROWS * shards)))
    draw = F.xxhash64("doc_id", "hash")
    placed = rows.select(
        "doc_id", "size", "text_crc32", _walk(root, lambda n: F.lit(n.first)).alias("shard"), draw.alias("draw"),
        F.pmod(draw, F.lit(buckets)).alias("bucket"),
    )
    starts = offsets(placed.groupBy("shard", "bucket").agg(F.count("*").alias("n")), "bucket", {"offset": "n"}, ["shard"]).drop("n")
    inside = Window.partitionBy("shard", "bucket").orderBy("draw", "doc_id")
    numbered = placed.withColumn("at", F.row_number().over(inside) - 1).join(starts, ["shard", "bucket"])
    return numbered.select("doc_id", "size", "text_crc32", "shard", (F.col("offset") + F.col("at")).cast("long").alias("slot"))


def op6_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: eight shards of nearly equal bytes."""
    return kd_shards(documents(spark, sf_dir), 8).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
