"""A factorisation machine on hashed features, trained on a bounded sample and scored batch by batch.

The score of a document with the set S of features that the model knows, n = |S|, is
``bias + sum_i w_i + 1/2 sum_f [(sum_i v_if)^2 - sum_i v_if^2] / n``: the linear
part counts every feature fully, so one strong term stands out in a text of any
length, and the pairwise part (all pairs of S, in linear time by the
sum-of-squares identity) is divided by n. The logistic function gives 0 to 1.

Features are 64-bit hashes folded to ``2**BITS`` bins. A bin enters the model if
``min_rows`` training rows hold it and either its chi-square with the label reaches
``SIGNIFICANT``, or it is one of the ``MOST_PAIRED`` most informative bins by frequency and
interacts with another of them: the label's rate with both, less the rates with
one, plus that with neither, is ``SIGNIFICANT_PAIR`` squared errors from 0. So two
terms that tell nothing alone are learnt as a pair, while the many bins of random
words, which would be learnt by heart, stay out.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basewright.llm.common import in_fold, spread, text_slices
from basewright.llm.worker import works_for

#: Bins of the hashed feature space.
BITS = 22
#: Rank of the pairwise part.
RANK = 4
#: Training takes about so many labelled rows of each class, chosen by the hash of their id.
ROWS_PER_CLASS = 4000
#: Least chi-square, corrected for continuity, of a bin that enters the model (one in a thousand by chance).
SIGNIFICANT = 10.83
#: Bins whose pairs are screened, and the least squared interaction in standard errors (about one chance pair in a million).
MOST_PAIRED, SIGNIFICANT_PAIR = 600, 30.0
#: Passes over the training rows, step size, and weight of the penalties.
EPOCHS, STEP, RIDGE = 12, 0.08, 1e-4
SEED = 9


@dataclass
class Model:
    bins: np.ndarray  # kept bins, ascending
    weights: np.ndarray  # one per kept bin
    factors: np.ndarray  # kept bins x rank
    bias: float

    def margins(self, found: list[np.ndarray]) -> np.ndarray:
        """Raw scores of documents given as arrays of distinct bins."""
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        out = np.full(len(found), self.bias)
        if not len(self.bins) or not sizes.sum():
            return out
        every = np.concatenate(found)
        at = np.minimum(np.searchsorted(self.bins, every), len(self.bins) - 1)
        known = self.bins[at] == every
        rows = np.repeat(np.arange(len(found)), sizes)[known]
        return out + _terms(at[known], rows, len(found), self.weights, self.factors)[0]


def _terms(at, rows, n, weights, factors):
    """(linear + pairwise part per row, sums of factors per row, 1 / number of features)."""
    linear = np.bincount(rows, weights[at], n)
    scale = 1.0 / np.maximum(np.bincount(rows, minlength=n), 1)
    sums = np.stack([np.bincount(rows, factors[at, f], n) for f in range(factors.shape[1])], 1)
    squares = np.bincount(rows, (factors[at] ** 2).sum(1), n)
    return linear + 0.5 * scale * ((sums**2).sum(1) - squares), sums, scale


def screened(found: list[np.ndarray], labels: np.ndarray, min_rows: int) -> np.ndarray:
    """The bins, ascending, that enter the model."""
    rows = np.repeat(np.arange(len(found)), [len(x) for x in found])
    bins, back, seen = np.unique(np.concatenate(found), return_inverse=True, return_counts=True)
    n, ones = len(labels), labels.sum()
    with_one = np.bincount(back, labels[rows], len(bins))
    gap = np.abs(n * with_one - ones * seen)
    spread = seen * (n - seen) * ones * (n - ones)
    chi = n * np.maximum(gap - n / 2, 0) ** 2 / np.maximum(spread, 1)
    enters = (seen >= min_rows) & (chi >= SIGNIFICANT)
    return bins[enters | _interacting(back, rows, seen, labels, min_rows)]


def _interacting(back: np.ndarray, rows: np.ndarray, seen: np.ndarray, labels: np.ndarray, min_rows: int) -> np.ndarray:
    """Which bins interact with another one; of the bins held by neither few nor nearly all rows the nearest to half are screened."""
    n = len(labels)
    out = np.zeros(len(seen), bool)
    spread_of = np.minimum(seen, n - seen)
    some = np.flatnonzero(spread_of >= max(min_rows, 8))
    some = some[np.argsort(-spread_of[some], kind="stable")][:MOST_PAIRED]
    if len(some) < 2:
        return out
    place = np.full(len(seen), -1)
    place[some] = np.arange(len(some))
    held = np.zeros((n, len(some)), np.float32)
    known = place[back] >= 0
    held[rows[known], place[back[known]]] = 1
    both, both_ones = held.T @ held, held.T @ (held * labels[:, None].astype(np.float32))
    one, one_ones = both.diagonal()[:, None], both_ones.diagonal()[:, None]
    contrast, variance, least = 0.0, 0.0, np.inf
    for sign, size, ones in (
        (1, both, both_ones), (-1, one - both, one_ones - both_ones), (-1, one.T - both, one_ones.T - both_ones),
        (1, n - one - one.T + both, labels.sum() - one_ones - one_ones.T + both_ones),
    ):
        rate = (ones + 0.5) / (size + 1)  # of a cell, drawn a little to the middle
        contrast, variance, least = contrast + sign * rate, variance + rate * (1 - rate) / (size + 1), np.minimum(least, size)
    strong = (contrast**2 >= SIGNIFICANT_PAIR * variance) & (least >= 8)
    np.fill_diagonal(strong, False)
    out[some[strong.any(1)]] = True
    return out


def fit(found: list[np.ndarray], labels: np.ndarray, importance: np.ndarray, min_rows: int = 4) -> Model:
    """Logistic loss, AdaGrad, mini-batches in a fixed order: the same rows give the same model."""
    if not len(found) or not importance.sum():
        return Model(np.zeros(0, np.int64), np.zeros(0), np.zeros((0, RANK)), 0.0)
    rate = float(np.clip((labels * importance).sum() / importance.sum(), 1e-3, 1 - 1e-3))
    bias = float(np.log(rate / (1 - rate)))
    bins = screened(found, labels, min_rows)
    rng = np.random.default_rng(SEED)
    weights, factors = np.zeros(len(bins)), rng.normal(0, 0.1, (len(bins), RANK))
    if not len(bins) or rate in (1e-3, 1 - 1e-3):
        return Model(bins, weights, factors, bias)
    kept = []
    for x in found:
        at = np.minimum(np.searchsorted(bins, x), len(bins) - 1)
        kept.append(at[bins[at] == x])
    gw, gv, gb = np.full(len(bins), 1e-6), np.full((len(bins), RANK), 1e-6), 1e-6
    importance = importance / importance.mean()
    for _ in range(EPOCHS):
        order = rng.permutation(len(kept))
        for start in range(0, len(order), 64):
            batch = order[start : start + 64]
            sizes = np.array([len(kept[i]) for i in batch])
            at = np.concatenate([kept[i] for i in batch])
            rows = np.repeat(np.arange(len(batch)), sizes)
            part, sums, scale = _terms(at, rows, len(batch), weights, factors)
            error = importance[batch] * (1 / (1 + np.exp(-np.clip(bias + part, -30, 30))) - labels[batch]) / len(batch)
            gb += error.sum() ** 2
            bias -= STEP * error.sum() / np.sqrt(gb)
            if not len(at):
                continue
            uniq, back = np.unique(at, return_inverse=True)
            e = error[rows]
            dw = np.bincount(back, e) + RIDGE * weights[uniq]
            pull = (e * scale[rows])[:, None] * (sums[rows] - factors[at])
            dv = np.stack([np.bincount(back, pull[:, f]) for f in range(RANK)], 1) + RIDGE * factors[uniq]
            gw[uniq] += dw**2
            gv[uniq] += dv**2
            weights[uniq] -= STEP * dw / np.sqrt(gw[uniq])
            factors[uniq] -= STEP * dv / np.sqrt(gv[uniq])
    return Model(bins, weights, factors, bias)


Features = Callable[[list, dict], list]


_ASCII, _RUN = re.compile(rb"[a-z]+"), re.compile(r"[^\W\d_]+")


def letter_runs(text: str) -> set[bytes]:
    """The distinct lower-case runs of letters of a text, in UTF-8."""
    low = text.lower()
    if low.isascii():
        return set(_ASCII.findall(low.encode()))
    return {run.encode("utf-8", "replace") for run in set(_RUN.findall(low))}


def _batches(batches, features: Features, metadata: list[str], text_at: int | None = None) -> Iterator:
    """Slices and their features; the text is a column, or the field ``text_at`` of the column ``row``."""
    works_for(features.__module__)
    for batch in batches:
        text = batch.column("text") if text_at is None else batch.column("row").field(text_at)
        for start, stop in text_slices(text, 2 << 20):
            part = batch.slice(start, stop - start)
            texts = [t or "" for t in text.slice(start, stop - start).to_pylist()]
            yield part, features(texts, {c: part.column("meta_" + c).to_pylist() for c in metadata})


def _inputs(df: DataFrame, id_col: str, text_col: str, metadata: list[str]) -> DataFrame:
    return df.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *[F.col(c).alias("meta_" + c) for c in metadata]
    )


def train(
    df: DataFrame, marks: DataFrame, label_col: str, allowed: Column, features: Features, *,
    id_col: str = "doc_id", text_col: str = "text", metadata: list[str] = (), rows_per_class: int = ROWS_PER_CLASS,
) -> Model:
    """Fit on labelled rows that ``allowed`` (over column doc_id) admits.

    Each class gives about ``rows_per_class`` rows (all if it has fewer), by a
    threshold on the hash of the id, and rows weigh the inverse of that share.
    The chosen marks are broadcast: at most twice that bound by construction.
    A null label or id trains nothing; conflicting labels of one id go to the majority, ties to 1.
    """
    clean = (
        marks.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("label"))
        .filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & allowed)
        .groupBy("doc_id").agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    )
    sizes = {r["label"]: r["count"] for r in clean.groupBy("label").count().collect()}
    share = {k: min(1.0, rows_per_class / n) for k, n in sizes.items()}
    draw = F.pmod(F.xxhash64(F.lit(SEED), F.col("doc_id").cast("string")), F.lit(1 << 30)) / float(1 << 30)
    clean = clean.withColumn("draw", draw)
    chosen = clean.filter(F.lit(False))
    for k, p in share.items():  # the bound is far above the expected number; if it ever cuts, it cuts by hash
        chosen = chosen.union(clean.filter((F.col("label") == k) & (F.col("draw") < p)).orderBy("draw", "doc_id").limit(2 * rows_per_class))
    inputs = _inputs(df, id_col, text_col, list(metadata)).join(F.broadcast(chosen), "doc_id")

    def run(batches):
        import pyarrow as pa

        for part, found in _batches(batches, features, list(metadata)):
            yield pa.RecordBatch.from_arrays(
                [part.column("label"), part.column("draw"), pa.array([x.astype("<i4").tobytes() for x in found], pa.binary())], ["label", "draw", "bins"]
            )

    sample = inputs.mapInArrow(run, "label int, draw double, bins binary")
    sample = sample.orderBy("draw", "label", "bins").limit(4 * rows_per_class).select("label", "bins").toArrow()  # repeated rows may exceed it
    sample = sample.combine_chunks().sort_by([("label", "ascending"), ("bins", "ascending")])  # no order of arrival
    labels = np.array(sample.column("label").to_pylist(), float)
    found = [np.frombuffer(b, "<i4").astype(np.int64) for b in sample.column("bins").to_pylist()]
    weight = np.array([1.0 / share[int(x)] for x in labels])
    return fit(found, labels, weight)


def score(
    df: DataFrame, model: Model, features: Features, *,
    id_col: str = "doc_id", text_col: str = "text", metadata: list[str] = (), carry: bool = False,
) -> DataFrame:
    """doc_id, score for every row, and with ``carry`` the whole input row as the struct ``row``.

    The model's size is bounded by its training sample.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    id_type = df.schema[id_col].dataType.simpleString()
    inputs = _inputs(df, id_col, text_col, list(metadata))
    schema, more, text_at = f"doc_id {id_type}, score double", [], None
    if carry:  # the text travels once, inside its row
        text_at = [c.lower() for c in df.columns].index(text_col.lower())
        inputs = df.select(
            F.col(id_col).alias("doc_id"), *[F.col(c).alias("meta_" + c) for c in metadata], F.struct(*[F.col(c) for c in df.columns]).alias("row")
        )
        schema, more = schema + f", row {inputs.schema['row'].dataType.simpleString()}", ["row"]

    def run(batches):
        import pyarrow as pa

        for part, found in _batches(batches, features, list(metadata), text_at):
            margin = np.clip(shared.value.margins(found), -500, 500)
            columns = [part.column("doc_id"), pa.array(1 / (1 + np.exp(-margin))), *(part.column(c) for c in more)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "score", *more])

    return spread(inputs).mapInArrow(run, schema)


def verdicts(scored: DataFrame, modulus: int, remainder: int) -> DataFrame:
    """The contract's columns: doc_id, held_out, score, predicted."""
    return scored.select(
        "doc_id", in_fold("doc_id", modulus, remainder).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
