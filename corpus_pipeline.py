"""A corpus pipeline: toxic documents go, copies and near copies go, sources are mixed, tokens come out.

Every stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and
returns a DataFrame, which is written as Parquet and reread as the next stage's
``docs``. All but the last return the columns of ``docs``. Null and empty texts,
repeated rows, extra columns and empty tables are handled as the operators say;
texts without a word pass the first three stages as the operators define and
are never taken by the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from basewright.llm import bpe, common, exact_dedup, similarity_join, source_mix, toxicity

#: Near duplicates: word n-grams of that length, similarity in hundredths.
SHINGLE_WORDS, SIMILARITY = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from the labels of the query's training folds and drop documents scored 0.5 or more."""
    model = toxicity.learn_toxicity(docs, common.labels(spark, sf_dir), ~common.in_fold("doc_id", 5, 0))
    return toxicity.toxic_dropped(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest id stays."""
    return exact_dedup.exact_duplicates_dropped(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every component of linked texts the smallest id stays."""
    return similarity_join.near_duplicates_dropped(docs, SHINGLE_WORDS, SIMILARITY)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the schedule takes them: none to three times."""
    return source_mix.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, ids (little-endian unsigned 32-bit) of every row."""
    coded = bpe.bpe_round_trip(docs, bpe.vocabulary_path())
    return bpe.digests(coded, "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_join", drop_near_copies),
    ("source_mix", mix_sources),
    ("bpe", encode),
]

#: The first stage is a trained model, which SQL cannot express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; the result of the last, each other one written and reread.

    A stage's table goes when its successor is written; the tables of other runs stay.
    """
    docs, before = common.documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        docs = common.distilled(lambda: stage(spark, docs, sf_dir), f"stage-{name}")  # noqa: B023  (called at once)
        if before is not None:
            common.forget(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
