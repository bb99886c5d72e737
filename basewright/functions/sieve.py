"""K-mers of many texts against a fixed-size bit set, in numpy on Arrow batches.

A k-mer's hash is a polynomial of its code points, made for all places of a batch
at once by doubling its length. Its top bits name a word of 64 bits, its lowest
ones two bits of that word. What passes is compared as text later.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

#: log2 of the most words of a bit set (32 MB), rows and places that are looked at in one go.
MOST_BITS, ROWS, PLACES = 22, 512, 1 << 18
_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)
_WORD = (1 << 64) - 1


def code_points(text: str) -> np.ndarray:
    if text.isascii():
        return np.frombuffer(text.encode("ascii"), np.uint8).astype(np.uint64)
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)


def hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """The hash of the k characters from each place on."""
    if len(codes) < k:
        return np.zeros(0, np.uint64)
    h, n = codes, 1
    for bit in bin(k)[3:]:
        h, n = h[:-n] * np.uint64(pow(_BASE, n, 1 << 64)) + h[n:], 2 * n
        if bit == "1":
            h, n = h[:-1] * np.uint64(_BASE) + codes[n:], n + 1
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


def _bits(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return h & np.uint64(63), (h >> np.uint64(6)) & np.uint64(63)


def passing(codes: np.ndarray, k: int, words: np.ndarray) -> np.ndarray:
    """Places whose k-mer is in the bit set, and a few others."""
    shift = np.uint64(64 - (len(words).bit_length() - 1))
    found = []
    for lo in range(0, max(0, len(codes) - k + 1), PLACES):
        h = hashes(codes[lo : lo + PLACES + k - 1], k)
        one, two = _bits(h)
        word = words[(h >> shift).astype(np.int64)]
        at = np.flatnonzero((word >> one) & np.uint64(1))
        found.append(lo + at[((word[at] >> two[at]) & np.uint64(1)) == 1])
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def bit_set(seeds: DataFrame, about: int) -> np.ndarray:
    """The bit set of ``seeds`` (seed), of about as many words as there are seeds and 2**MOST_BITS at most whatever the input."""
    bits = min(MOST_BITS, max(10, about.bit_length()))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            every = batch.column(0).to_pylist()
            for k in sorted({len(s) for s in every}):
                codes = code_points("".join(s for s in every if len(s) == k))
                h = hashes_of_rows(codes.reshape(-1, k))
                one, two = _bits(h)
                word = (h >> np.uint64(64 - bits)).astype(np.int64)
                both = ((np.uint64(1) << one) | (np.uint64(1) << two)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(both)], ["word", "bits"])

    rows = seeds.select("seed").mapInArrow(run, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(1 << bits, np.uint64)
    words[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return words


def hashes_of_rows(codes: np.ndarray) -> np.ndarray:
    """The hash of each row of a matrix of code points."""
    k = codes.shape[1]
    h = (codes * np.array([pow(_BASE, k - 1 - j, 1 << 64) for j in range(k)], np.uint64)).sum(axis=1, dtype=np.uint64)
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


def sifted(rows: DataFrame, k: int, words, window: int, own: int | None, *carried: str) -> DataFrame:
    """start, window and the carried columns of ``rows`` (start, text): the places of texts whose k-mer passes ``words``, a broadcast bit set.

    ``window`` is the text from there on, up to so many characters; only the first ``own`` characters of a text count as places of it.
    """
    given = rows.select("start", "text", *carried)
    schema = StructType([StructField("start", LongType()), StructField("window", StringType()), *[given.schema[c] for c in carried]])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                texts = part.column(1).to_pylist()
                sizes = np.array([len(t) for t in texts], np.int64)
                ends, joined = np.cumsum(sizes), "".join(texts)
                at = passing(code_points(joined), k, words.value)
                row = np.searchsorted(ends, at, "right")
                i = at - (ends - sizes)[row]
                keep = (i + k <= sizes[row]) & (True if own is None else i < own)
                at, row, i = at[keep], row[keep], i[keep]
                stops = np.minimum(at + window, ends[row])
                start = part.column(0).to_numpy()[row] + i
                seen = [joined[a:b] for a, b in zip(at.tolist(), stops.tolist(), strict=True)]
                rest = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(start, pa.int64()), pa.array(seen, pa.string()), *rest.columns[2:]], schema.names)

    return given.mapInArrow(run, schema)
