"""Language by a string kernel: blended-spectrum n-gram presence, Nystroem landmarks, kernel ridge regression.

A text is lower-cased and everything but letters becomes single spaces; its
spectrum is the set of its hashed character n-grams of every length in
``LENGTHS`` that hold a letter. The kernel of two texts is the size of the
spectra's intersection over the root of the product of their sizes. Landmarks
and training rows are a bounded sample of whole labelled texts. The Nystroem map
``K_landmarks^-1/2`` turns kernel values with the landmarks into features, and
one ridge regression per language separates it from the rest.

Scoring is two matrix products over a batch, ``(P L) A``: P is the batch's sparse
presence matrix, L the landmarks' presence, A the regressions after the Nystroem
map. As products associate, ``L A`` is computed once and P times it per batch.

Defined results: a null text and a text without a letter give ``und`` and 0, and
so does every text when nothing could be learnt; a null language trains nothing;
texts of any length are read whole; repeated rows repeat their result; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basewright.llm.common import documents, in_fold, spread, text_slices

#: Lengths of the blended n-grams.
LENGTHS = (1, 2, 3, 4)
#: Bins of hashed n-grams.
BITS = 18
#: About so many training texts a language, of which so many are landmarks.
ROWS_PER_LANGUAGE, LANDMARKS_PER_LANGUAGE = 400, 60
#: Bounds over all languages: training texts and landmarks, but for the least that every language gets.
MOST_ROWS, MOST_LANDMARKS = 4000, 800
#: Expected training texts of a language at least; so many that a draw by hash does not miss one.
LEAST_ROWS = 30
#: Where a language has enough texts of so many characters, it trains on those only.
SAMPLE_CHARS = (20, 8000)
#: Ridge, relative to the number of training rows, and the floor of kept eigenvalues.
RIDGE, FLOOR = 1e-3, 1e-6
SEED = 11

_OTHER = re.compile(r"[\W\d_]+")


def letters(text: str) -> str:
    """The lower-case text with a space for every run of characters that are no letters, and none at its ends."""
    clean = _OTHER.sub(" ", text.lower()).strip(" ")
    if clean.replace(" ", "").isalpha():
        return clean
    # \W and \d leave other numerals in: fractions, superscripts, Roman numerals. A class that names them all would be slow on every letter.
    return " ".join("".join([c if c.isalpha() else " " for c in clean]).split())


def spectrum(text: str) -> np.ndarray:
    """Distinct hashed n-grams of one text; empty without a letter."""
    clean = letters(text)
    if not clean:
        return np.zeros(0, np.int64)
    points = np.frombuffer(f" {clean} ".encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
    space = points == 32
    code = np.zeros(len(points), np.uint64)
    present = np.zeros(1 << BITS, bool)
    for n in range(1, max(LENGTHS) + 1):
        code = code[: len(points) - n + 1] * np.uint64(0x100000001B3) + points[n - 1 :]
        if n in LENGTHS:
            mixed = (code ^ (code >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n)
            bins = (mixed * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - BITS)
            if n == 1:
                bins = bins[~space]
            present[bins.astype(np.int64)] = True
    return np.flatnonzero(present)


def kernel(rows: list[np.ndarray], landmarks: list[np.ndarray]) -> np.ndarray:
    """Normalised intersections of every row with every landmark."""
    sizes = np.array([len(x) for x in landmarks])
    bins, starts = np.concatenate(landmarks), np.cumsum(sizes) - sizes
    present = np.zeros(1 << BITS, np.int64)
    out = np.zeros((len(rows), len(landmarks)))
    for i, x in enumerate(rows):
        present[x] = 1
        out[i] = np.add.reduceat(present[bins], starts) / np.sqrt(sizes * len(x))
        present[x] = 0
    return out


class Model:
    """languages, and the bins' products with the regressions (L A)."""

    def __init__(self, spectra: list[np.ndarray], languages: list[str]) -> None:
        self.languages = sorted(set(languages))
        self.weights = np.zeros((1 << BITS, len(self.languages)), np.float32)
        self.bias = np.zeros(len(self.languages))
        if not spectra:
            return
        marks: list[int] = []
        each = max(1, min(LANDMARKS_PER_LANGUAGE, MOST_LANDMARKS // len(self.languages)))
        for name in self.languages:
            marks += [i for i, x in enumerate(languages) if x == name][:each]
        landmarks = [spectra[i] for i in marks]
        values, vectors = np.linalg.eigh(kernel(landmarks, landmarks))
        good = values > FLOOR * max(values[-1], 1e-12)
        root = vectors[:, good] / np.sqrt(values[good])
        features = kernel(spectra, landmarks) @ root
        goal = np.where(np.array(languages)[:, None] == np.array(self.languages)[None], 1.0, -1.0)
        size = np.array([1.0 / max(languages.count(x), 1) for x in languages])
        size *= len(languages) / size.sum()  # every language weighs the same
        middle = (features * size[:, None]).sum(0) / size.sum()
        self.bias = (goal * size[:, None]).sum(0) / size.sum()
        x, y = features - middle, goal - self.bias
        inner = x.T @ (x * size[:, None]) + RIDGE * len(x) * np.eye(x.shape[1])
        ridge = np.linalg.solve(inner, x.T @ (y * size[:, None]))
        self.bias = self.bias - middle @ ridge
        on_landmarks = root @ ridge
        for j, points in enumerate(landmarks):
            self.weights[points] += (on_landmarks[j] / np.sqrt(max(len(points), 1))).astype(np.float32)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        spectra = [spectrum(t or "") for t in texts]
        names, scores = ["und"] * len(texts), [0.0] * len(texts)
        lettered = [i for i, x in enumerate(spectra) if len(x)]
        if not self.languages or not lettered:
            return names, scores
        sizes = np.array([len(spectra[i]) for i in lettered])
        starts = np.cumsum(sizes) - sizes
        rows = np.concatenate([spectra[i] for i in lettered])
        values = np.add.reduceat(self.weights[rows], starts, axis=0, dtype=float) / np.sqrt(sizes)[:, None] + self.bias
        best = values.argmax(1)
        for i, k, v in zip(lettered, best.tolist(), values.max(1).tolist(), strict=True):
            names[i], scores[i] = self.languages[k], min(1.0, max(0.0, (1 + v) / 2))
        return names, scores


def train(df: DataFrame, allowed: Column, id_col: str, text_col: str, lang_col: str) -> Model:
    """Learn from a sample bounded by twice MOST_ROWS texts, or twice LEAST_ROWS a language; every language gets a class.

    A threshold on the hash of id and text draws about the same number of rows of
    each language, of the middle lengths first; ``allowed`` is a condition on the
    column doc_id. Only the spectra of the drawn texts reach the driver.
    """
    lower, upper = SAMPLE_CHARS
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).filter(
        F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & allowed
    )
    middle = F.length("text").between(lower, upper)
    counts = {r["lang"]: (r["middle"], r["all"]) for r in rows.groupBy("lang").agg(F.count_if(middle).alias("middle"), F.count("*").alias("all")).collect()}
    if not counts:
        return Model([], [])
    draw = F.pmod(F.xxhash64(F.lit(SEED), F.col("doc_id").cast("string"), "text"), F.lit(1 << 30)) / float(1 << 30)
    each = max(LEAST_ROWS, min(ROWS_PER_LANGUAGE, MOST_ROWS // len(counts)))
    shares = _shares(df.sparkSession, counts, each)
    sample = rows.withColumn("draw", draw).join(F.broadcast(shares), "lang").filter(F.col("draw") < F.when(middle, F.col("of_middle")).otherwise(F.col("of_rest")))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for start, stop in text_slices(batch.column(0)):
                part = batch.slice(start, stop - start)
                found = [spectrum(t).astype("<i4").tobytes() for t in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), pa.array(found, pa.binary())], ["lang", "draw", "bins"])

    taken = sample.select("text", "lang", "draw").mapInArrow(run, "lang string, draw double, bins binary")
    taken = taken.orderBy("draw", "lang", "bins").limit(2 * max(MOST_ROWS, LEAST_ROWS * len(counts)))  # only repeated rows exceed it
    drawn = sorted((r["lang"], bytes(r["bins"])) for r in taken.collect())
    np.random.default_rng(SEED).shuffle(drawn)
    known = [(lang, np.frombuffer(x, "<i4").astype(np.int64)) for lang, x in drawn if len(x)]
    return Model([x for _, x in known], [lang for lang, _ in known])


def _shares(spark: SparkSession, counts: dict[str, tuple[int, int]], each: int) -> DataFrame:
    """lang, of_middle, of_rest: the shares of a language's texts to draw, the rest only where the middle has fewer than ``each``."""
    out = []
    for lang, (middle, every) in sorted(counts.items()):
        missing = max(each - middle, LEAST_ROWS) if middle < each else 0
        out.append((lang, min(1.0, each / max(middle, 1)), min(1.0, missing / max(every - middle, 1))))
    return spark.createDataFrame(out, "lang string, of_middle double, of_rest double")


def identify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score for every row; the model's size is fixed by BITS and the number of languages."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for start, stop in text_slices(batch.column(1)):
                part = batch.slice(start, stop - start)
                names, scores = shared.value.predict(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"]
                )

    rows = spread(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    return rows.mapInArrow(run, f"doc_id {id_type}, lang_pred string, score double")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learns only from rows whose fold is not 2 of 4."""
    docs = documents(spark, sf_dir)
    model = train(docs, ~in_fold("doc_id", 4, 2), "doc_id", "text", "lang")
    return identify(docs, model).select("doc_id", in_fold("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")
