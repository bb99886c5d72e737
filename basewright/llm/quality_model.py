"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Words are distinct lower-case letter runs; statistics of the whole text (share
of symbols, capitals, digits and line ends, repeated words and lines, lengths)
enter as their bin, so pairs of bins and words can interact; metadata columns
enter as their value, numbers as their bin of doubling width.

Defined results: a null text counts as empty; empty texts are scored from their
statistics; null metadata is a value of its own; repeated rows repeat their
score; extra columns are ignored; an empty table gives an empty result. Labels,
language, source and id never enter a score.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basewright.llm import factorisation as fm
from basewright.llm.common import documents, in_fold, labels
from basewright.llm.hashing import WordHashes
from basewright.llm.worker import keeps

_SYMBOLS = b"#*$%&|<>{}[]=_~^@\\"
_MARKS = b"!?.,;:"
_words = WordHashes(fm.BITS, b"words")
_others = WordHashes(fm.BITS, b"other")
keeps(__name__, _words.clear)
keeps(__name__, _others.clear)


def _bin(name: str, value: float, width: float) -> bytes:
    return f"{name}:{min(int(value / width), 40)}".encode()


def structure(text: str) -> list[bytes]:
    """Bins of the statistics of one text."""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    n, size = len(words), max(len(raw), 1)
    if not n:
        return [b"no words"]
    lines = [x for x in raw.split(b"\n") if x.strip()]
    counts = Counter(words)
    pairs = len(set(zip(words, words[1:], strict=False)))
    share = lambda some: (size - len(raw.translate(None, some))) / size
    return [
        _bin("symbols", share(_SYMBOLS), 0.02),
        _bin("marks", share(_MARKS), 0.02),
        _bin("digits", share(b"0123456789"), 0.02),
        _bin("capitals", share(bytes(range(65, 91))), 0.05),
        _bin("words", np.log2(n), 1),
        _bin("word length", size / n, 1),
        _bin("distinct", len(counts) / n, 0.1),
        _bin("distinct pairs", pairs / max(n - 1, 1), 0.05),
        _bin("top word", counts.most_common(1)[0][1] / n, 0.05),
        _bin("repeated lines", 1 - len(set(lines)) / len(lines), 0.05),
        _bin("words a line", np.log2(1 + n / len(lines)), 1),
        _bin("line ends", sum(x.rstrip()[-1:] in (b".", b"!", b"?", b":", b";") for x in lines) / len(lines), 0.1),
    ]


def _meta(name: str, value) -> bytes:
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        value = f"2^{int(np.log2(value))}" if value >= 1 else "0"
    return f"meta {name}={value}".encode()


def features(texts: list[str], metadata: dict) -> list[np.ndarray]:
    out = []
    for i, text in enumerate(texts):
        found = fm.letter_runs(text)
        bins = [_words[w] for w in found]
        bins += [_others[x] for x in structure(text)]
        bins += [_others[_meta(name, values[i])] for name, values in metadata.items()]
        out.append(np.unique(np.array(bins, np.int64)))
    return out


def score_quality(
    df: DataFrame, marks: DataFrame, allowed=None, *, id_col: str = "doc_id", text_col: str = "text", metadata: list[str] = (),
) -> DataFrame:
    """doc_id, score; ``allowed`` (a condition on doc_id) names the rows of ``marks`` to learn from."""
    how = {"id_col": id_col, "text_col": text_col, "metadata": metadata}
    model = fm.train(df, marks, "quality", F.lit(True) if allowed is None else allowed, features, **how)
    return fm.score(df, model, features, **how)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted; learns only from rows whose fold is not 1 of 3."""
    scored = score_quality(documents(spark, sf_dir), labels(spark, sf_dir), ~in_fold("doc_id", 3, 1), metadata=["n_chars"])
    return fm.verdicts(scored, 3, 1)
