"""BPE encoding and decoding with a pair occurrence index.

A vocabulary file in the tokenizers JSON format gives ranks and normalisation.
The new chunks of an Arrow batch are encoded together: one index maps each
adjacent symbol pair to all its positions, a heap yields the active pair of
the lowest rank, its positions merge from left to right, and only the lists of
the neighbouring pairs change. Encoded chunks stay in a bounded per-worker
table, since white space bounds every pre-token and texts repeat chunks.

Supported file shape (checked, an error otherwise): NFC, white space to one
space, lower case; a split into contractions, letter runs, single numbers and
symbol runs; byte-level alphabet; BPE with a word-end suffix; no decoder, which
means that decoding joins token texts with single spaces.

Defined results: a null text counts as empty and gives no tokens; special
tokens written in a text become their ids; texts of any length are read whole;
repeated rows repeat their result; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basewright.llm.common import documents, spread, text_slices
from basewright.llm.worker import keeps, works_for

#: Unicode White_Space, which the file's normaliser folds and its split drops.
UNICODE_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The split pattern that the vocabulary file must carry (a fixed value of that file).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Entries of a worker's chunk table, and characters of its chunks; it starts anew beyond either.
TABLE_ENTRIES, TABLE_CHARS = 300_000, 8 << 20


#: Bytes of text that are encoded together.
SLICE = 3 << 20


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte: itself where printable, else the next free code point from 256."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    free = iter(range(256, 512))
    shown = set(printable)
    return [chr(b) if b in shown else chr(next(free)) for b in range(256)]


class PairIndexBpe:
    """Encoder and decoder for one vocabulary file."""

    def __init__(self, path: str) -> None:
        import numpy as np
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        steps = [s["type"] for s in spec["normalizer"]["normalizers"]]
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        if not all(t["content"].startswith("<|") for t in spec["added_tokens"]):
            raise ValueError(f"{path}: special tokens that do not start with <|")
        if steps != ["NFC", "Replace", "Lowercase"] or split != SPLIT or spec["decoder"] is not None or model["type"] != "BPE":
            raise ValueError(f"{path}: not a vocabulary of the supported shape")
        self.suffix = model["end_of_word_suffix"] or ""
        self.ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max(*self.ids.values(), *self.special.values())
        self.texts = [""] * size
        for text, i in (self.ids | self.special).items():
            self.texts[i] = text
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.rules = [(self.ids[a], self.ids[b], self.ids[a + b]) for a, b in pairs]
        self.width = size
        keys = np.array([a * size + b for a, b, _ in self.rules], np.int64)
        self.pair_ranks = np.argsort(keys, kind="stable")
        self.pair_keys = keys[self.pair_ranks]
        alphabet = byte_alphabet()
        self.inner = np.array([self.ids[c] for c in alphabet], np.int32)
        self.final = np.array([self.ids[c + self.suffix] for c in alphabet], np.int32)
        self.tokens = regex.compile(SPLIT)
        self.stretch = re.compile(f"[^{UNICODE_SPACE}]+")
        self.separator = re.compile(r"[\x1c-\x1f]")
        self.specials = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        self.table: dict[str, tuple[bytes, str]] = {}
        self.table_chars = 0

    def pre_tokens(self, chunk: str) -> list[str]:
        """Normalise one chunk without white space and split it."""
        if chunk.isascii() and (chunk.isalpha() or chunk[:-1].isalpha() and chunk[-1] in ".,!?;:"):
            chunk = chunk.lower()
            return [chunk] if chunk.isalpha() else [chunk[:-1], chunk[-1]]
        if not chunk.isascii():
            chunk = unicodedata.normalize("NFC", chunk)
            chunk = chunk.replace("Σ", "σ")  # lower case goes by code point: no final sigma
        return self.tokens.findall(chunk.lower())

    def rank_of(self, left, right):
        """Rank of each pair; ``len(self.pair_keys)`` where the file has none."""
        import numpy as np

        key = left.astype(np.int64) * self.width + right
        at = np.searchsorted(self.pair_keys, key)
        at[at == len(self.pair_keys)] = 0
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], len(self.pair_keys))

    def merge(self, words: list[str]):
        """(token ids of all words in a row, number of ids of each word)."""
        import numpy as np

        raw = [w.encode("utf-8") for w in words]
        length = np.fromiter(map(len, raw), np.int64, len(raw))
        ends = np.cumsum(length)
        data = np.frombuffer(b"".join(raw), np.uint8)
        symbol = self.inner[data]
        symbol[ends - 1] = self.final[data[ends - 1]]
        n, none = len(symbol), len(self.pair_keys)
        after = np.arange(1, n + 1, dtype=np.int32)
        after[ends - 1] = -1
        before = np.arange(-1, n - 1, dtype=np.int32)
        before[ends - length] = -1

        places: dict[int, list] = defaultdict(list)  # rank of a pair: arrays of its left positions
        active: list[int] = []

        def note(ranks, lefts) -> None:
            if not len(ranks):
                return
            order = np.argsort(ranks, kind="stable")
            ranks, lefts = ranks[order], lefts[order]
            cuts = np.flatnonzero(np.diff(ranks, prepend=-1))
            for rank, group in zip(ranks[cuts].tolist(), np.split(lefts, cuts[1:]), strict=True):
                if rank not in places:
                    heapq.heappush(active, rank)
                places[rank].append(group)

        left = np.flatnonzero(after >= 0).astype(np.int32)
        ranks = self.rank_of(symbol[left], symbol[left + 1])
        note(ranks[ranks < none], left[ranks < none])
        while active:
            rank = heapq.heappop(active)
            first, second, merged = self.rules[rank]
            at = np.unique(np.concatenate(places.pop(rank)))
            at = at[(symbol[at] == first) & (after[at] >= 0)]
            right = after[at]
            good = symbol[right] == second
            at, right = at[good], right[good]
            if first == second and len(at) > 1:  # of overlapping pairs the leftmost merges first
                keep, taken = [], -1
                for i, (x, y) in enumerate(zip(at.tolist(), right.tolist(), strict=True)):
                    if x != taken:
                        keep.append(i)
                        taken = y
                at, right = at[keep], right[keep]
            if not len(at):
                continue
            beyond = after[right]
            symbol[at] = merged
            symbol[right] = -1
            after[at] = beyond
            inside = beyond >= 0
            before[beyond[inside]] = at[inside]
            ahead = before[at]
            lefts = np.concatenate([at[inside], ahead[ahead >= 0]])
            ranks = self.rank_of(symbol[lefts], symbol[after[lefts]])
            note(ranks[ranks < none], lefts[ranks < none])
        left_over = symbol >= 0
        upto = np.cumsum(left_over)[ends - 1]
        return symbol[left_over], np.diff(upto, prepend=0)

    def learn(self, chunks: set[str]) -> None:
        """Encode the chunks that the table lacks, all at once."""
        import numpy as np

        new = [c for c in chunks if c not in self.table]
        if len(self.table) + len(new) > TABLE_ENTRIES or self.table_chars + sum(map(len, new)) > TABLE_CHARS:
            self.table.clear()
            self.table_chars = 0
            new = list(chunks)
        self.table_chars += sum(map(len, new))
        split = [self.pre_tokens(c) for c in new]
        place: dict[str, int] = {}
        for part in split:
            for w in part:
                place.setdefault(w, len(place))
        if not place:
            return
        ids, count = self.merge(list(place))
        ids = ids.astype("<u4")
        cut = np.append(0, np.cumsum(count)).tolist()
        raw, size = ids.tobytes(), ids.itemsize
        shown = [self.texts[i] for i in ids.tolist()]
        for chunk, part in zip(new, split, strict=True):
            spans = [(cut[k], cut[k + 1]) for k in map(place.__getitem__, part)]
            self.table[chunk] = (
                b"".join(raw[a * size : b * size] for a, b in spans),
                " ".join(" ".join(shown[a:b]) for a, b in spans),
            )

    def chunks(self, text: str) -> list[str]:
        """The stretches without Unicode White_Space."""
        # str.split() also cuts at U+001C to U+001F, which are not White_Space.
        return self.stretch.findall(text) if self.separator.search(text) else text.split()

    def _plain(self, text: str) -> tuple[bytes, list[str]]:
        rows = [self.table[c] for c in self.chunks(text)]
        return b"".join(r[0] for r in rows), [r[1] for r in rows if r[0]]

    def run(self, texts: list[str]) -> tuple[list[bytes], list[str]]:
        """Ids (little-endian unsigned 32-bit) and decoded text of each text."""
        import numpy as np

        parts: dict[int, list[str]] = {}  # texts that name special tokens, cut at them
        found: set[str] = set()
        for i, text in enumerate(texts):
            if "<|" in text and self.specials.search(text):
                parts[i] = re.split(f"({self.specials.pattern})", text)
                for piece in parts[i][::2]:
                    found.update(self.chunks(piece))
            else:
                found.update(self.chunks(text))
        self.learn(found)
        ids, decoded = [], []
        for i, text in enumerate(texts):
            if i in parts:
                raw, shown = b"", []
                for k, piece in enumerate(parts[i]):
                    if k % 2:
                        raw += np.array([self.special[piece]], "<u4").tobytes()
                        shown.append(piece)
                    else:
                        more, words = self._plain(piece)
                        raw += more
                        shown += words
            else:
                raw, shown = self._plain(text)
            ids.append(raw)
            decoded.append(" ".join(shown))
        return ids, decoded

    def decode(self, ids: bytes) -> str:
        import numpy as np

        return " ".join(self.texts[i] for i in np.frombuffer(ids, "<u4"))


_loaded: dict[str, PairIndexBpe] = {}
keeps(__name__, _loaded.clear)


def encoder(path: str) -> PairIndexBpe:
    """The encoder for a file, loaded once per worker process."""
    if path not in _loaded:
        _loaded[path] = PairIndexBpe(path)
    return _loaded[path]


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def bpe_round_trip(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (binary: little-endian unsigned 32-bit), decoded (text), one row per input row."""
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        works_for(__name__)
        coder = encoder(vocabulary)
        for batch in batches:
            for start, stop in text_slices(batch.column(1), SLICE):
                part = batch.slice(start, stop - start)
                ids, decoded = coder.run([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"]
                )

    rows = spread(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    return rows.mapInArrow(run, f"doc_id {id_type}, ids binary, decoded string")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return digests(bpe_round_trip(documents(spark, sf_dir), vocabulary_path()))


def digests(coded: DataFrame, *more: str) -> DataFrame:
    return coded.select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        *more,
    )
