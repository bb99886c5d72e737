"""Exact Jaccard similarity join on word n-grams by vertical partitioning.

Every text becomes the set of its distinct word n-grams (hashed). Equal sets
form one class, known by a digest. One global order of n-grams (the most common
ones last, the rest by hash) serves two purposes:

* Candidates. Two sets of Jaccard similarity t share an n-gram among the first
  ``n - ceil(t n) + 1`` of each in that order. Only n-grams that two sets hold
  there make blocks, and of blocks with the same members one is enough. A
  512-bit parity sketch of each set bounds the size of the symmetric difference
  from below, so a pair leaves a block only if sizes and sketches still allow
  the similarity, and a sketch as wide as the set is large bounds it again for
  larger sets, which fill 512 bits; no such test can lose a link. Two sets share
  many blocks; each knows its first ones, and the pair leaves the first that
  both know.
* Overlaps. That same order is cut into FRAGMENTS, the overlap of a pair is
  counted in each fragment separately from the two sets' segments, and the
  partial counts are summed for each pair. The sum decides.

Links inside one component need not all be verified: first each block's most
typical member and some drawn by hash are compared with the others, then for
each two components their likeliest pair, and at last every pair whose ends are
still in different components. No pair is verified twice.
So no group of copies is expanded into all pairs, and no link that joins two
components is lost. ``jaccard_links`` and ``jaccard_link_counts`` do without this
short cut: they verify every candidate pair and give all links.

The most common n-grams, at most MOST_COMMON whatever the input, are kept in a
bit set of fixed size. It only changes the order, never the result. A second one
names n-grams that two prefixes hold; it only saves work.

Defined results: texts without a word, and null texts, have an empty set, link
with nothing and are their own component; a text with fewer than n words has its
whole word sequence as one n-gram; equal sets link; repeated rows share one
class; rows with a null id take part, and the component's id is the smallest
non-null one; extra columns are ignored; an empty table gives an empty result.
Classes are known by 128 bits, n-grams by 64 in digests and by 48 in overlaps.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basewright.llm.common import (
    by_unique_key, collect_garbage, distilled, documents, forget, gathered, heavy_keys, materialise, row_key, rows_of, salted, spread, text_slices,
)
from basewright.llm.components import components
from basewright.llm.hashing import WordHashes
from basewright.llm.worker import keeps, works_for

TOKEN_BITS = 48
TOKEN_BYTES = TOKEN_BITS // 8
#: 64-bit words of a parity sketch.
SKETCH_WORDS = 8
#: Blocks of a class, the first by number, that its members know. Two classes leave the first block that both know, any shared one if there is none.
FIRST_BLOCKS = 8
#: Members of each block, drawn by hash, that the first round compares with the others beside the most typical one.
CENTRES = 3
#: Members of a block that one task compares with another member.
BLOCK_ROWS = 10_000
#: Fragments of the global order: so many equal ranges of the hash for common n-grams, and for the others.
HALVES = 2
FRAGMENTS = 2 * HALVES
#: log2 of the bits of the broadcast bit sets (8 MB each), and n-grams that count as common at most.
FILTER_BITS, MOST_COMMON = 26, 1 << 22
#: Bytes of packed n-grams that numpy works on at once.
SLICE = 4 << 20

_hashes = WordHashes(64, b"ngram")
keeps(__name__, _hashes.clear)


def ngram_sets(texts: list[str], n: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit n-gram hashes of each text; A to Z count as a to z."""
    words = [t.encode("utf-8").lower().split() for t in texts]  # of bytes: ASCII letters and ASCII white space only
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    flat = [w for part in words for w in part]
    number = np.fromiter(map(_hashes.__getitem__, flat), np.uint64, len(flat))
    rolled = np.zeros(max(len(number) - n + 1, 0), np.uint64)
    for i in range(n if len(rolled) else 0):  # with too few words the slices would count from the end
        rolled = (rolled ^ number[i : len(number) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        rolled ^= rolled >> np.uint64(29)
    rolled *= np.uint64(0xD6E8FEB86659FD93)
    rolled ^= rolled >> np.uint64(32)
    out, at = [], 0
    for part, size in zip(words, sizes.tolist(), strict=True):
        if size >= n:
            found = np.sort(rolled[at : at + size - n + 1])
            out.append(found[np.append(True, found[1:] != found[:-1])])
        elif size:
            whole = hashlib.blake2b(b" ".join(part), digest_size=8, key=b"short").digest()
            out.append(np.frombuffer(whole, np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
        at += size
    return out


def _pack(tokens: np.ndarray) -> bytes:
    return np.ascontiguousarray(tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :TOKEN_BYTES]).tobytes()


def _unpack(packed: bytes) -> np.ndarray:
    wide = np.zeros((len(packed) // TOKEN_BYTES, 8), np.uint8)
    wide[:, :TOKEN_BYTES] = np.frombuffer(packed, np.uint8).reshape(-1, TOKEN_BYTES)
    return wide.view("<u8").ravel().astype(np.int64)


def prefix_length(size: int, percent: int) -> int:
    return size - -(-percent * size // 100) + 1


def _sets(df: DataFrame, n: int) -> DataFrame:
    """doc_id, key, size, class, check, tokens (packed; null where this task has lately given the class before)."""
    id_type = df.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        works_for(__name__)
        given: set[bytes] = set()
        for batch in batches:
            for start, stop in text_slices(batch.column(1), 2 << 20):
                part = batch.slice(start, stop - start)
                sizes, classes, checks, tokens = [], [], [], []
                for found in ngram_sets([t or "" for t in part.column(1).to_pylist()], n):
                    sizes.append(len(found))
                    if not len(found):
                        classes.append(None)
                        checks.append(None)
                        tokens.append(None)
                        continue
                    digest = hashlib.blake2b(found.tobytes(), digest_size=16).digest()
                    classes.append(int.from_bytes(digest[:8], "little", signed=True))
                    checks.append(int.from_bytes(digest[8:], "little", signed=True))
                    tokens.append(None if digest in given else _pack(found >> np.uint64(64 - TOKEN_BITS)))
                    if len(given) >= 100_000:
                        given.clear()
                    given.add(digest)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(sizes, pa.int64()), pa.array(classes, pa.int64()), pa.array(checks, pa.int64()),
                     pa.array(tokens, pa.binary())],
                    ["doc_id", "key", "size", "class", "check", "tokens"],
                )

    return df.mapInArrow(run, f"doc_id {id_type}, key bigint, size bigint, class bigint, check bigint, tokens binary")


def _ngram_rows(df: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """The sets, with classes that 128 bits tell apart: where the first 64 are equal and the others not, both make the class."""
    inputs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), row_key(text_col).alias("key"))
    sets = materialise(_sets(spread(inputs), n), "ngram-sets")
    clashing = sets.filter("class is not null").groupBy("class").agg(F.min("check").alias("lo"), F.max("check").alias("hi")).filter("lo <> hi")
    clashing = materialise(clashing.select("class", F.lit(True).alias("clash")), "clashing-classes")
    if not clashing.head(1):
        return sets
    both = sets.join(clashing, "class", "left")
    return materialise(both.withColumn("class", F.when(F.col("clash"), F.xxhash64("class", "check")).otherwise(F.col("class"))).select(sets.columns), "ngram-sets")


def _bit_set(values: DataFrame, column: str) -> np.ndarray:
    """2**FILTER_BITS bits (8 MB, whatever the input) with a bit for every value given."""
    place = F.col(column).bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    bit = F.expr(f"shiftleft(1L, cast(`{column}` & 63 as int))")
    words = gathered(values.select(F.shiftright(place, 6).alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")))
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out


def _in_bit_set(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    place = values & ((1 << FILTER_BITS) - 1)
    return ((bits[place >> 6] >> (place & 63)) & 1).astype(bool)


def _reach(size: int, percent: int) -> int:
    """N-grams by hash among which a prefix lies unless many of them are common."""
    k = prefix_length(size, percent)
    return k + k // 4 + 2


def _common_ngrams(sets: DataFrame, percent: int) -> np.ndarray:
    """Bit set of the n-grams that the most sets hold among their first ones by hash: held twice or more, MOST_COMMON at most."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for start, stop in text_slices(batch.column(0), SLICE):
                packed = batch.column(0).slice(start, stop - start).to_pylist()
                heads = [_unpack(x[: TOKEN_BYTES * _reach(len(x) // TOKEN_BYTES, percent)]) for x in packed]
                token, count = np.unique(np.concatenate(heads), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(count.astype(np.int32))], ["token", "places"])

    counted = sets.filter("tokens is not null").select("tokens").mapInArrow(run, "token bigint, places int")
    counted = counted.groupBy("token").agg(F.sum("places").alias("places")).filter("places > 1")
    counted = materialise(counted.select("token", F.floor(F.log2("places")).cast("int").alias("doublings")), "repeated-ngrams")
    sizes, least = dict(counted.groupBy("doublings").count().collect()), 1
    while sum(n for k, n in sizes.items() if k >= least) > MOST_COMMON:
        least += 1
    common = _bit_set(counted.filter(F.col("doublings") >= least), "token")
    forget(counted)
    return common


def _parities(token: np.ndarray, bits: int) -> np.ndarray:
    return np.packbits((np.bincount(token % bits, minlength=bits) & 1).astype(np.uint8))


def _wide_sketch(token: np.ndarray) -> bytes | None:
    """Parities in the least power of two that reaches the set's size; none for sets that the common sketch is wide enough for."""
    return _parities(token, 1 << (len(token) - 1).bit_length()).tobytes() if len(token) > 64 * SKETCH_WORDS else None


def _wide_difference(x: bytes | None, y: bytes | None) -> int:
    """Least size of the symmetric difference that two wide sketches prove, the wider one folded to the other; 0 without one."""
    if not x or not y:
        return 0
    u, v = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    while len(u) != len(v):
        if len(u) < len(v):
            u, v = v, u
        u = u[: len(u) // 2] ^ u[len(u) // 2 :]
    return int(np.bitwise_count(u ^ v).sum())


def _classes(sets: DataFrame, common: np.ndarray, percent: int) -> DataFrame:
    """class, size, typical (share of common n-grams), sketch, wide (sketch of larger sets), prefix."""
    bits = sets.sparkSession.sparkContext.broadcast(common)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            typical, sketches, wide, prefixes = [], [], [], []
            for packed in batch.column(2).to_pylist():
                token = _unpack(packed)
                late = _in_bit_set(bits.value, token)
                typical.append(float(late[: _reach(len(token), percent)].mean()))
                sketches.append(_parities(token, 64 * SKETCH_WORDS).view("<i8").tolist())
                wide.append(_wide_sketch(token))
                k = prefix_length(len(token), percent)
                early = token[~late][:k]
                prefixes.append(np.concatenate([early, token[late][: k - len(early)]]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(typical, pa.float32()), pa.array(sketches, pa.list_(pa.int64())),
                 pa.array(wide, pa.binary()), pa.array(prefixes, pa.list_(pa.int64()))],
                ["class", "size", "typical", "sketch", "wide", "prefix"],
            )

    rows = sets.filter("tokens is not null").select("class", "size", "tokens")
    return rows.mapInArrow(run, "class bigint, size bigint, typical float, sketch array<bigint>, wide binary, prefix array<bigint>")


def _postings(classes: DataFrame) -> DataFrame:
    """token, class: the prefixes without n-grams that no second prefix holds, as far as a bit set tells."""
    counted = classes.select(F.explode("prefix").alias("token")).groupBy("token").agg(F.count("*").alias("n")).filter("n > 1")
    bits = classes.sparkSession.sparkContext.broadcast(_bit_set(counted, "token"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            lengths = batch.column(1).value_lengths().to_numpy()
            token = batch.column(1).flatten().to_numpy()
            known = _in_bit_set(bits.value, token)
            owner = np.repeat(np.arange(batch.num_rows), lengths)[known]
            yield pa.RecordBatch.from_arrays([pa.array(token[known]), batch.column(0).take(pa.array(owner))], ["token", "class"])

    return classes.select("class", "prefix").mapInArrow(run, "token bigint, class bigint")


def _held(sets: DataFrame, members: DataFrame) -> DataFrame:
    """class, size, tokens of the classes in blocks and of few others."""
    bits = sets.sparkSession.sparkContext.broadcast(_bit_set(members.select("class").distinct(), "class"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            yield batch.filter(pa.array(_in_bit_set(bits.value, batch.column(0).to_numpy())))

    return sets.filter("tokens is not null").select("class", "size", "tokens").mapInArrow(run, "class bigint, size bigint, tokens binary")


def _sizes_near(x: Column, y: Column, percent: int) -> Column:
    return F.least(x, y) * 100 >= F.greatest(x, y) * percent


def _difference(x: Column, y: Column) -> Column:
    """Least size of the symmetric difference that the sketches prove."""
    differing = F.lit(0)
    for i in range(SKETCH_WORDS):
        differing = differing + F.bit_count(x[i].bitwiseXOR(y[i]))
    return differing


def _near(x: str, y: str, percent: int) -> Column:
    """Sizes and sketches allow the similarity: (100 + t) * difference <= (100 - t) * sum of the sizes."""
    size_x, size_y = F.col(f"{x}.size"), F.col(f"{y}.size")
    differ = _difference(F.col(f"{x}.sketch"), F.col(f"{y}.sketch"))
    return _sizes_near(size_x, size_y, percent) & (differ * (100 + percent) <= (size_x + size_y) * (100 - percent))


def _may_link(pairs: DataFrame, traits: DataFrame, percent: int) -> DataFrame:
    """Those of a table of pairs (a, b) whose sizes and sketches allow the similarity; many pairs may have the same a.

    ``differ`` is the hundredth of their sizes' sum, at least, that the symmetric difference has.
    """

    def screen(batches):
        import pyarrow as pa

        for batch in batches:
            sums = batch.column("sizes").to_numpy()
            least = [_wide_difference(x, y) for x, y in zip(batch.column("left").to_pylist(), batch.column("right").to_pylist(), strict=True)]
            differ = np.maximum(np.array(least, np.int64), batch.column("differ").to_numpy())
            able = pa.array(differ * (100 + percent) <= sums * (100 - percent))
            out = [batch.column("a"), batch.column("b"), pa.array(100.0 * differ / sums)]
            yield pa.RecordBatch.from_arrays(out, ["a", "b", "differ"]).filter(able)

    own = F.struct("size", "sketch", "wide")
    hot = heavy_keys(pairs, "a")
    with_b = salted(pairs.join(traits.select(F.col("class").alias("b"), own.alias("y")), "b"), hot, "a", F.col("b"))
    both = with_b.join(salted(traits.select(F.col("class").alias("a"), own.alias("x")), hot, "a"), ["a", "salt"])
    differ = _difference(F.col("x.sketch"), F.col("y.sketch")).cast("long").alias("differ")
    near = both.filter(_near("x", "y", percent)).select(
        "a", "b", (F.col("x.size") + F.col("y.size")).alias("sizes"), differ, F.col("x.wide").alias("left"), F.col("y.wide").alias("right")
    )
    return near.mapInArrow(screen, "a bigint, b bigint, differ double")


def _segments(held: DataFrame, pairs: DataFrame, common: np.ndarray) -> DataFrame:
    """class, size, of_a, of_b (which end of pairs the class is), fragment, segment (packed) of the classes in the pairs.

    A bit set drops nearly all other classes before their n-grams are shuffled.
    """
    ends = pairs.select(F.col("a").alias("class"), F.lit(True).alias("of_a")).union(pairs.select(F.col("b").alias("class"), F.lit(False)))
    ends = ends.groupBy("class").agg(F.bool_or("of_a").alias("of_a"), F.bool_or(~F.col("of_a")).alias("of_b"))
    wanted = _held(held, ends).join(ends, "class").dropDuplicates(["class"])
    bits = held.sparkSession.sparkContext.broadcast(common)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for start, stop in text_slices(batch.column(2), SLICE):
                part = batch.slice(start, stop - start)
                segments = []
                for packed in part.column(2).to_pylist():
                    token = _unpack(packed)
                    fragment = _in_bit_set(bits.value, token) * HALVES + ((token >> (TOKEN_BITS - 16)) * HALVES >> 16)
                    segments += [_pack(token[fragment == i]) for i in range(FRAGMENTS)]
                rows = pa.array(np.repeat(np.arange(len(part)), FRAGMENTS))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c).take(rows) for c in ("class", "size", "of_a", "of_b")),
                     pa.array(np.tile(np.arange(FRAGMENTS, dtype=np.int32), len(part))), pa.array(segments, pa.binary())],
                    ["class", "size", "of_a", "of_b", "fragment", "segment"],
                )

    wanted = wanted.select("class", "size", "tokens", "of_a", "of_b")
    return wanted.mapInArrow(run, "class bigint, size bigint, of_a boolean, of_b boolean, fragment int, segment binary")


def verified(held: DataFrame, pairs: DataFrame, common: np.ndarray, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose n-gram sets reach the similarity: partial overlaps by fragment, summed."""

    def count(batches):
        import pyarrow as pa

        for batch in batches:
            common = [
                len(np.intersect1d(_unpack(x), _unpack(y), assume_unique=True)) if x and y else 0
                for x, y in zip(batch.column("left").to_pylist(), batch.column("right").to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("a", "b", "sizes")] + [pa.array(common, pa.int64())], ["a", "b", "sizes", "common"]
            )

    segments = materialise(_segments(held, pairs, common), "segments")
    hot = heavy_keys(pairs, "a")  # a member that many others are compared with
    left = segments.filter("of_a").select(F.col("class").alias("a"), "fragment", F.col("size").alias("size_a"), F.col("segment").alias("left"))
    right = segments.filter("of_b").select(F.col("class").alias("b"), "fragment", F.col("size").alias("size_b"), F.col("segment").alias("right"))
    wide = salted(pairs, hot, "a", F.col("b")).withColumn("fragment", F.explode(F.array(*[F.lit(f) for f in range(FRAGMENTS)])))
    both = wide.join(right, ["b", "fragment"]).join(salted(left, hot, "a"), ["a", "salt", "fragment"])
    counted = both.select("a", "b", (F.col("size_a") + F.col("size_b")).alias("sizes"), "left", "right").mapInArrow(
        count, "a bigint, b bigint, sizes bigint, common bigint"
    )
    summed = counted.groupBy("a", "b").agg(F.sum("common").alias("common"), F.first("sizes").alias("sizes"))
    links = materialise(summed.filter(F.col("common") * 100 >= (F.col("sizes") - F.col("common")) * percent).select("a", "b"), "links")
    forget(segments)
    return links


def _blocks(sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame, DataFrame, np.ndarray]:
    """(blocks of two or more classes: token (a number), class, size, typical, n; their n-grams; their traits, one row a class; common n-grams)."""
    common = _common_ngrams(sets, percent)
    classes = materialise(_classes(sets, common, percent), "classes")
    postings = materialise(_postings(classes).dropDuplicates(["token", "class"]), "postings")
    alike = [F.bit_xor(F.xxhash64(F.lit(i), "class")).alias(f"set{i}") for i in range(2)]  # 128 bits that know a set of classes
    heads = postings.groupBy("token").agg(F.count("*").alias("n"), *alike).filter("n > 1")
    heads = heads.groupBy("n", "set0", "set1").agg(F.min("token").alias("token"))
    heads = materialise(heads.select("token", "n", F.monotonically_increasing_id().alias("block")), "block-heads")
    blocks = materialise(by_unique_key(postings, heads, "token", "n").select(F.col("block").alias("token"), "class", "n"), "blocks")
    forget(heads)
    firsts = blocks.groupBy("class").agg(F.slice(F.array_sort(F.collect_list("token")), 1, FIRST_BLOCKS).alias("firsts"))
    traits = classes.join(firsts, "class").dropDuplicates(["class"])
    traits = materialise(traits.select("class", "size", "typical", "sketch", "wide", "firsts"), "traits")
    members = materialise(blocks.join(traits.select("class", "size", "typical"), "class"), "members")
    forget(classes, postings, blocks)
    collect_garbage(sets.sparkSession)
    return members, materialise(_held(sets, members), "held"), traits, common


def _on_blocks(members: DataFrame, others: DataFrame) -> DataFrame:
    """Join members (m) with ``others`` (h) of their block; a large block's members are dealt to several tasks, its others to all of them."""
    parts = F.ceil(F.col("n") / BLOCK_ROWS)
    left = members.withColumn("salt", F.pmod(F.xxhash64(F.lit(1), "class"), parts))
    right = others.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("n")
    return left.alias("m").join(right.alias("h"), ["token", "salt"])


def _meeting(members: DataFrame, traits: DataFrame, column: str, percent: int) -> DataFrame:
    """a, b: classes of one block, by ``column`` two and in this order, whose sizes and sketches allow the similarity.

    They leave the first block that both know, so most come once however many blocks
    they share. The first shared block that both know is the first that they share.
    """
    full = members.select(*dict.fromkeys(["token", "class", "n", column])).join(traits.select("class", "size", "sketch", "firsts"), "class")
    first = F.array_min(F.array_intersect("m.firsts", "h.firsts"))
    here = F.col("token") == F.coalesce(first, F.col("token"))
    both = _on_blocks(full, full).filter((F.col(f"m.{column}") < F.col(f"h.{column}")) & _near("m", "h", percent)).filter(here)
    return both.select(F.col("m.class").alias("a"), F.col("h.class").alias("b"))


def jaccard_links(df: DataFrame, n: int, percent: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """a, b, rows_a, rows_b: every two different classes (a < b) that link, and how many rows each has.

    The whole join: every candidate pair is verified, also inside one component,
    so a group of m near copies gives up to m (m - 1) / 2 rows. Rows of one class
    link with each other and are not listed; ``class`` of ``jaccard_components``
    or ``jaccard_link_counts`` names the rows of a class.
    """
    return distilled(lambda: _jaccard_links(_ngram_rows(df, n, id_col, text_col), percent), "jaccard-links")


def _jaccard_links(sets: DataFrame, percent: int) -> DataFrame:
    members, held, traits, common = _blocks(sets, percent)
    met = materialise(_meeting(members, traits, "class", percent).distinct(), "block-pairs")
    pairs = materialise(_may_link(met, traits, percent).select("a", "b"), "candidates")
    links = verified(held, pairs, common, percent)
    rows = sets.filter("class is not null").groupBy("class").agg(F.count("*").alias("rows"))
    return links.join(rows.toDF("a", "rows_a"), "a").join(rows.toDF("b", "rows_b"), "b").select("a", "b", "rows_a", "rows_b")


def jaccard_link_counts(df: DataFrame, n: int, percent: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, key, n_shingles, class, n_links: for each input row, how many other rows link with it."""

    def make() -> DataFrame:
        sets = _ngram_rows(df, n, id_col, text_col)
        links = materialise(_jaccard_links(sets, percent), "jaccard-links")
        ends = links.select(F.col("a").alias("class"), F.col("rows_b").alias("others"))
        ends = ends.union(links.select(F.col("b").alias("class"), F.col("rows_a").alias("others")))
        others = ends.groupBy("class").agg(F.sum("others").alias("others"))
        own = sets.filter("class is not null").groupBy("class").agg(F.count("*").alias("rows"))
        counts = own.join(others, "class", "left").select("class", "rows", (F.col("rows") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
        rows = sets.select("doc_id", "key", F.col("size").alias("n_shingles"), "class")
        linked = by_unique_key(rows.filter("class is not null"), materialise(counts, "counts"), "class", "rows")
        columns = ["doc_id", "key", "n_shingles", "class", "n_links"]
        return linked.select(columns).unionByName(rows.filter("class is null").withColumn("n_links", F.lit(0).cast("long")).select(columns))

    return distilled(make, "link-counts")


def jaccard_components(df: DataFrame, n: int, percent: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, key, n_shingles, class, component, component_id: one row per input row.

    Rows link when 100 * intersection >= percent * union of their n-gram sets;
    component_id is the smallest id reachable by links, component names the
    component (null without a word), and key is the hash of the text.
    """
    return distilled(lambda: _jaccard_components(df, n, percent, id_col, text_col), "components")


def merge_rounds(members: DataFrame, held: DataFrame, traits: DataFrame, common: np.ndarray, percent: int):
    """Yield (pairs verified, components so far: node and root of linked classes, None before any) round by round.

    The first round compares some members of a block with the others. What is left
    comes from the blocks of two or more components once: the second round takes the
    likeliest pair of each two components, the last one all pairs whose ends are
    still in different components.
    """
    one = F.struct("class", "size")
    centres = [F.struct("typical", "class"), *[F.xxhash64(F.lit(i), "class") for i in range(CENTRES)]]
    hubs = members.groupBy("token").agg(F.first("n").alias("n"), *[F.max_by(one, order).alias(f"hub{i}") for i, order in enumerate(centres)])
    every = F.array_distinct(F.array(*[f"hub{i}" for i in range(len(centres))]))
    hubs = hubs.select("token", "n", F.explode(every).alias("hub")).select("token", "n", "hub.*")
    near = (F.col("m.class") != F.col("h.class")) & _sizes_near(F.col("m.size"), F.col("h.size"), percent)
    pairs = _on_blocks(members, hubs).filter(near).select(F.col("h.class").alias("a"), F.col("m.class").alias("b"))
    once = pairs.groupBy(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).agg(F.first("a").alias("a"))
    once = once.select("a", (F.col("lo").bitwiseXOR(F.col("hi")).bitwiseXOR(F.col("a"))).alias("b"))
    block_pairs = materialise(once, "block-pairs")
    pairs = materialise(_may_link(block_pairs, traits, percent).select("a", "b"), "candidates")
    forget(block_pairs)
    roots, left = None, None
    for taken in ("centres", "likeliest", "rest"):
        if taken != "centres" and left is None:
            left = _left(members, traits, pairs, roots, percent)
        if taken == "likeliest":
            apart = _apart(left, roots).groupBy("ca", "cb").agg(F.min(F.struct("differ", "a", "b")).alias("best"))
            pairs = materialise(apart.select("best.a", "best.b"), "candidates")
        elif taken == "rest":
            pairs = materialise(_apart(left, roots).select("a", "b").join(pairs, ["a", "b"], "left_anti"), "candidates")
        if not pairs.head(1):
            continue
        edges = verified(held, pairs, common, percent)
        if edges.head(1):
            roots = components(edges if roots is None else edges.union(roots.toDF("a", "b")))  # the forest stands for all links so far
        yield pairs, roots
        collect_garbage(members.sparkSession)


def _left(members: DataFrame, traits: DataFrame, tried: DataFrame, roots: DataFrame | None, percent: int) -> DataFrame:
    """a, b, differ: the pairs of classes in different components that share a block, may link and have not been tried; ``members`` go."""
    if roots is None:
        named = members.withColumn("component", F.col("class"))
    else:
        named = members.join(roots.toDF("class", "root"), "class", "left").withColumn("component", F.coalesce("root", "class")).drop("root")
    named = materialise(named, "members")
    forget(members)
    still = named.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("left"))
    live = by_unique_key(named, still.filter("lo <> hi").select("token", "left"), "token", "left").drop("left")
    live = materialise(live, "members")
    forget(named)
    met = _meeting(live, traits, "component", percent).distinct()
    done = tried.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
    met = met.join(done, (F.least("a", "b") == done["lo"]) & (F.greatest("a", "b") == done["hi"]), "left_anti")
    met = materialise(met, "block-pairs")
    forget(live)
    left = materialise(_may_link(met, traits, percent), "left-pairs")
    forget(met)
    return left


def _apart(pairs: DataFrame, roots: DataFrame | None) -> DataFrame:
    """a, b, differ, ca, cb: the pairs whose ends are in different components, and these."""
    if roots is None:
        named, ends = pairs, (F.col("a"), F.col("b"))
    else:
        named = pairs.join(roots.toDF("a", "ra"), "a", "left").join(roots.toDF("b", "rb"), "b", "left")
        ends = F.coalesce("ra", "a"), F.coalesce("rb", "b")
    return named.select("a", "b", "differ", F.least(*ends).alias("ca"), F.greatest(*ends).alias("cb")).filter("ca <> cb")


def _jaccard_components(df: DataFrame, n: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    sets = _ngram_rows(df, n, id_col, text_col)
    members, held, traits, common = _blocks(sets, percent)
    rows = materialise(sets.select("doc_id", "key", F.col("size").alias("n_shingles"), "class"), "ngram-rows")
    forget(sets)
    roots = None
    for _, roots in merge_rounds(members, held, traits, common, percent):
        pass
    by_class = rows.filter("class is not null").groupBy("class").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows"))
    if roots is None:
        by_class = by_class.withColumn("component", F.col("class"))
    else:
        by_class = by_class.join(roots.toDF("class", "root"), "class", "left").withColumn("component", F.coalesce("root", "class")).drop("root")
    by_class = materialise(by_class, "class-components")
    least = by_class.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("of"))
    named = by_unique_key(by_class, least, "component", "of").select("class", "rows", "component", "component_id")
    linked = by_unique_key(rows.filter("class is not null"), materialise(named, "component-ids"), "class", "rows")
    alone = rows.filter("class is null").withColumn("component", F.lit(None).cast("long")).withColumn("component_id", F.col("doc_id"))
    columns = ["doc_id", "key", "n_shingles", "class", "component", "component_id"]
    return linked.select(columns).unionByName(alone.select(columns))


def near_duplicates_dropped(df: DataFrame, n: int, percent: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` without near duplicates: of each component the row with the smallest id, and every wordless row."""
    found = jaccard_components(df, n, percent, id_col, text_col)
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id").alias("id"), "key")
    firsts = found.filter("component is not null").groupBy("component").agg(F.min(order).alias("first")).select("first.id", "first.key")
    wordless = found.filter("component is null").select(F.col("doc_id").alias("id"), "key").distinct()
    return rows_of(df, firsts.union(wordless), row_key(text_col), id_col).select("row.*")


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id: 4-word shingles, similarity of 0.85 or more."""
    return jaccard_components(documents(spark, sf_dir), 4, 85).select("doc_id", "n_shingles", "component_id")


#: The same as SQL, which counts the overlap of every pair that shares an n-gram; doc_id must be unique and not null.
OP8_SQL = r"""WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
w AS (SELECT doc_id, len(words) AS n, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM docs),
g AS (
  SELECT DISTINCT doc_id, array_to_string(list(word) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING), ' ') AS gram, i, n FROM w),
s AS (SELECT DISTINCT doc_id, gram FROM g WHERE i + 3 <= n OR (n < 4 AND i = 1)),
sizes AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s AS a JOIN s AS b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN sizes AS x ON x.doc_id = a JOIN sizes AS y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM docs UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT docs.doc_id, cast(coalesce(sizes.n, 0) AS bigint) AS n_shingles, (SELECT min(b) FROM reach WHERE reach.a = docs.doc_id) AS component_id
FROM docs LEFT JOIN sizes ON sizes.doc_id = docs.doc_id"""
