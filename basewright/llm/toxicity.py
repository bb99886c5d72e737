"""Toxicity by a factorisation machine over hashed terms.

Terms are the distinct lower-case letter runs of the whole text; the pairwise
part learns combinations such as an insult next to a group's name.

Defined results: null, empty and letterless texts have no terms and get the
bias's score, which stays under 0.5 unless most training rows are toxic; with no
usable labels every score is 0.5 or the base rate's; repeated rows repeat their
score; extra columns are ignored; an empty table gives an empty result. Labels,
language, source and id never enter a score.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basewright.llm import factorisation as fm
from basewright.llm.common import documents, in_fold, labels
from basewright.llm.hashing import WordHashes
from basewright.llm.worker import keeps

_hashes = WordHashes(fm.BITS, b"terms")
keeps(__name__, _hashes.clear)


def terms(texts: list[str], _metadata: dict) -> list[np.ndarray]:
    """Distinct hashed terms of each text."""
    out = []
    for text in texts:
        found = fm.letter_runs(text)
        out.append(np.unique(np.fromiter(map(_hashes.__getitem__, found), np.int64, len(found))))
    return out


def learn_toxicity(df: DataFrame, marks: DataFrame, allowed: Column, *, id_col: str = "doc_id", text_col: str = "text") -> fm.Model:
    """``allowed``, a condition on the column doc_id, names the rows of ``marks`` to learn from."""
    return fm.train(df, marks, "toxic", allowed, terms, id_col=id_col, text_col=text_col)


def score_toxicity(df: DataFrame, model: fm.Model, **columns) -> DataFrame:
    """doc_id, score."""
    return fm.score(df, model, terms, **columns)


def toxic_dropped(df: DataFrame, model: fm.Model, threshold: float = 0.5, **columns) -> DataFrame:
    """The rows of ``df`` with a score under the threshold."""
    return fm.score(df, model, terms, carry=True, **columns).filter(F.col("score") < threshold).select("row.*")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted; learns only from rows whose fold is not 0 of 5."""
    docs = documents(spark, sf_dir)
    model = learn_toxicity(docs, labels(spark, sf_dir), ~in_fold("doc_id", 5, 0))
    return fm.verdicts(score_toxicity(docs, model), 5, 0)
