"""Exact duplicates by content sort.

White space runs become one space. Sampled splitters range-partition the rows
by (first HEAD code points of the normalised text, 64-bit hash, id), Spark's
external sort orders each range by those, the whole text and the id, so equal
texts are neighbours, and a streaming scan compares every text in full with its
neighbour. Hash and head only steer the sort: inside a range they never decide
equality. Because the id is the last splitter key, a group of copies larger than
one range simply spans several; the scan marks the runs that touch a range's
edge, and only those (at most a few per range) are stitched, by their SHA-256.

Defined results: a null text counts as empty; empty texts equal each other;
null ids sort last, so ``keep_id`` is null only when every id of the group is;
of rows that repeat the same id and text exactly one is kept; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basewright.llm.common import SPACES, documents, materialise
from basewright.llm.worker import works_for

#: Code points of the text in the range key: long enough to order texts, short enough to sample.
HEAD = 32


def _scan(batches):
    """Compare neighbours of one sorted range; one output row per input row, or with a fifth column ``row`` one per run.

    Of rows whose hash may go on in the next batch it holds ids and digests (and
    their ``row``, of which only a run's first comes out), and of texts never more
    than one batch and its predecessor's last.
    """
    import numpy as np

    works_for(__name__)
    part = TaskContext.get().partitionId()
    held: list = []  # rows that share the last hash seen: (ids, hashes, digests, starts a run)
    first_hash = last_text = None
    runs = 0

    def rows(upto_end: bool, ids, hashes, shas, new, whole):
        nonlocal runs
        n = len(ids)
        run = np.cumsum(new) - 1
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, n))
        columns = {
            "doc_id": ids,
            "text_sha256": shas,
            "part": pa.array(np.full(n, part, np.int32)),
            "run": pa.array(run + runs),
            "run_first": pc.take(ids, pa.array(starts[run])),
            "run_size": pa.array(sizes[run]),
            "leads": pa.array(new),
            "edge": pa.array(np.full(n, True) if upto_end else hashes == first_hash),
        }
        runs += len(starts)
        if whole is None:
            return pa.RecordBatch.from_pydict(columns)
        first = pa.array(starts)
        return pa.RecordBatch.from_pydict({name: x.take(first) for name, x in columns.items()} | {"row": whole})

    def joined(parts):
        ids, hashes, shas, new, whole = zip(*parts, strict=True)
        return pa.concat_arrays(ids), np.concatenate(hashes), pa.concat_arrays(shas), np.concatenate(new), _concat(whole)

    def leading(batch, new):
        """The rows that start a run."""
        return batch.column(4).filter(pa.array(new)) if batch.num_columns > 4 else None

    def _concat(parts):
        return pa.concat_arrays(parts) if parts[0] is not None else None

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        ids, shas, texts = batch.column(0), batch.column(2), batch.column(3)
        hashes = batch.column(1).to_numpy(zero_copy_only=False)
        new = np.ones(n, bool)
        new[1:] = pc.not_equal(texts.slice(1), texts.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        if held:
            new[0] = texts[0].as_py() != last_text
        else:
            first_hash = hashes[0]
        last_text = texts[n - 1].as_py()
        held.append((ids, hashes, shas, new, leading(batch, new)))
        other = np.flatnonzero(hashes != hashes[-1])
        if len(other) or held[0][1][0] != hashes[-1]:
            ids, hashes, shas, new, whole = joined(held)
            cut = int(np.flatnonzero(hashes != hashes[-1])[-1]) + 1
            lead, rest = (None, None) if whole is None else (whole.slice(0, int(new[:cut].sum())), whole.slice(int(new[:cut].sum())))
            yield rows(False, ids.slice(0, cut), hashes[:cut], shas.slice(0, cut), new[:cut], lead)
            held = [(ids.slice(cut), hashes[cut:], shas.slice(cut), new[cut:], rest)]
    if held:
        yield rows(True, *joined(held))


def _runs(df: DataFrame, id_col: str, text_col: str, carry: bool) -> DataFrame:
    """The scan's rows with span_first, span_size and span_part where a run goes on over ranges."""
    id_type = df.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit(""))
    normal = df.select(
        F.col(id_col).alias("doc_id"), F.regexp_replace(text, SPACES, " ").alias("normal"),
        *([F.struct(*[F.col(c) for c in df.columns]).alias("row")] if carry else []),
    )
    more, schema = [], f"doc_id {id_type}, text_sha256 string, part int, run bigint, run_first {id_type}, run_size bigint, leads boolean, edge boolean"
    if carry:
        more, schema = ["row"], f"{schema}, row {normal.schema['row'].dataType.simpleString()}"
    keyed = normal.select("doc_id", F.xxhash64("normal").alias("hash"), F.substring("normal", 1, HEAD).alias("head"), *([] if carry else ["normal"]), *more)
    by_id = F.col("doc_id").asc_nulls_last()
    dealt = keyed.repartitionByRange("head", "hash", by_id)
    if carry:  # the text travels once, inside its row
        dealt = dealt.withColumn("normal", F.regexp_replace(F.coalesce(F.col(f"row.`{text_col}`"), F.lit("")), SPACES, " "))
    ordered = dealt.sortWithinPartitions("head", "hash", "normal", by_id)
    scanned = ordered.select("doc_id", "hash", F.sha2("normal", 256).alias("text_sha256"), "normal", *more).mapInArrow(_scan, schema)
    runs = materialise(scanned, "content-runs")
    # At most a few runs per range touch its edges, so this table is bounded by the number of ranges.
    spans = (
        runs.filter("edge and leads")
        .groupBy("text_sha256")
        .agg(
            F.min_by("run_first", "part").alias("span_first"),
            F.sum("run_size").alias("span_size"),
            F.min("part").alias("span_part"),
            F.count("*").alias("parts"),
        )
        .filter("parts > 1")
        .drop("parts")
        .withColumn("edge", F.lit(True))
    )
    return runs.join(F.broadcast(spans), ["text_sha256", "edge"], "left")


def _kept() -> Column:
    return F.col("leads") & (F.col("span_part").isNull() | (F.col("part") == F.col("span_part")))


def content_sort_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    whole = F.col("span_part").isNull()
    return _runs(df, id_col, text_col, carry=False).select(
        "doc_id",
        F.when(whole, F.col("run_first")).otherwise(F.col("span_first")).alias("keep_id"),
        F.when(whole, F.col("run_size")).otherwise(F.col("span_size")).alias("group_size"),
        _kept().alias("kept"),
        "text_sha256",
    )


def exact_duplicates_dropped(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` without exact duplicates: of each group the row with the smallest id, carried through the sort."""
    return _runs(df, id_col, text_col, carry=True).filter(_kept()).select("row.*")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_sort_dedup(documents(spark, sf_dir))


OP7_SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER w = 1 AS kept,
       sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t ORDER BY doc_id NULLS LAST)
"""
