"""Fixed genomes and reads, edge cases, and random genomes against a brute-force search."""

import random
import re

import pytest

from basewright.__main__ import main
from basewright.operators import align, fm, genome, index
from basewright.sources import sequence_files as files

GENOME = [
    (0, "chr1 first contig", "NNACGTTGCAATCGGATTNNNACGTTGCAATCGGCC"),
    (1, "chr2", "GGCCGATTGCAACGTAAATTTCCCGGG"),
    (2, "chr3", "AAATTTCCCGGGTTACGTAACCATGG"),
]
READS = {
    "uniq_fwd": "TTGCAATCGGATT", "multi": "ACGTTGCAATCGG", "rev_only": "GGTTACGTAACCCGGG", "multi_chr": "AAATTTCCCGGG", "palindrome": "GGTTACGTAACC",
    "cross_N": "ATCGGATTACGTTGCA", "cross_chr": "ATCGGCCGGCCGATT", "mismatch": "TTGCAATCGGATA", "len12": "TTTCCCGGGTTA",
}
HITS = {
    "uniq_fwd": ["chr1:6:0"], "multi": ["chr1:22:0", "chr1:3:0", "chr2:3:16"], "rev_only": ["chr3:7:16"], "multi_chr": ["chr2:16:0", "chr3:1:0"],
    "palindrome": ["chr3:11:0", "chr3:11:16"], "len12": ["chr3:4:0"],
}


@pytest.fixture(scope="module")
def contigs(spark):
    return genome.contigs_of(spark.createDataFrame(GENOME, "ordinal long, name string, seq string"))


def reads_of(spark, named):
    rows = [(i, n, s, "+", "".join(chr(33 + k % 60) for k in range(len(s)))) for i, (n, s) in enumerate(named.items())]
    return spark.createDataFrame(rows, "read_id long, name string, seq string, plus string, qual string")


def found(spark, contigs, named, **how):
    out = {}
    for r in align.align(reads_of(spark, named), contigs, **how).collect():
        out.setdefault(r["qname"], []).append(f"{r['rname']}:{r['pos']}:{r['flag']}")
    return {k: sorted(v) for k, v in out.items()}


def test_coordinates(contigs):
    segs = genome.segments(contigs)
    assert [tuple(r) for r in segs.select("name", "n_before", "len").orderBy("ordinal", "seg_no").collect()] == [
        ("chr1", 2, 16), ("chr1", 3, 15), ("chr2", 0, 27), ("chr3", 0, 26)
    ]
    assert {r["name"]: (r["start"], r["len"]) for r in genome.contig_lengths(segs).collect()} == {"chr1": (0, 31), "chr2": (31, 27), "chr3": (58, 26)}
    assert sorted(tuple(r) for r in genome.n_positions(segs).collect()) == [(0, 2), (16, 5), (31, 0), (58, 0), (84, 0)]


def test_hits(spark, contigs):
    assert found(spark, contigs, READS) == HITS


def test_strands(spark, contigs):
    both = {(k, h) for k, v in HITS.items() for h in v}
    assert {(k, h) for k, v in found(spark, contigs, READS, strand=0).items() for h in v} == {x for x in both if x[1].endswith(":0")}
    assert {(k, h) for k, v in found(spark, contigs, READS, strand=1).items() for h in v} == {x for x in both if x[1].endswith(":16")}


@pytest.mark.parametrize(("cap", "gone"), [(0, set(HITS)), (1, {"multi", "multi_chr", "palindrome"}), (2, {"multi", "multi_chr"}), (3, set()), (-1, set())])
def test_cap_counts_raw_hits(spark, contigs, cap, gone):
    assert set(found(spark, contigs, READS, max_hits=cap)) == set(HITS) - gone


def test_raw_counts(spark, contigs):
    reads = reads_of(spark, READS)
    names = dict(enumerate(READS))
    raw = {names[r["read_id"]]: r["raw_n"] for r in align.raw_hits(reads, contigs).collect()}
    assert raw == {"uniq_fwd": 1, "multi": 3, "rev_only": 1, "multi_chr": 3, "palindrome": 2, "cross_N": 1, "cross_chr": 2, "len12": 1}


def test_statistics(spark, contigs):
    reads = reads_of(spark, READS)
    row = align.statistics(align.hits(reads, contigs), reads).first()
    assert tuple(row)[:5] == (9, 6, 3, 3, 10)
    assert abs(row["mappability"] - 200 / 3) < 1e-9
    none = reads.limit(0)
    assert tuple(align.statistics(align.hits(none, contigs), none).first()) == (0, 0, 0, 0, 0, None)


def test_sam_text(spark, contigs):
    rows = align.align(reads_of(spark, {"rev_only": READS["rev_only"]}), contigs)
    quality = "".join(chr(33 + k) for k in range(16))[::-1]
    assert files.sam_lines(rows).first()["value"] == f"rev_only\t16\tchr3\t7\t255\t16M\t*\t0\t0\tCCCGGGTTACGTAACC\t{quality}\t1\t"
    assert files.parse_sam(files.sam_lines(rows)).collect() == rows.collect()


def test_unusable_reads(spark, contigs):
    assert found(spark, contigs, {"short": "ACGTTGCAATC", "n": "ACGTTGCNATCGG", "low": "acgttgcaatcgg", "empty": ""}) == {}


def test_index_tables(spark):
    text = spark.createDataFrame([("ACGTTGCATGCAACGT$",)], "text string")
    rows = index.suffix_rows(text).orderBy("row").collect()
    assert [r["pos"] for r in rows] == [16, 11, 12, 0, 7, 10, 6, 13, 1, 9, 5, 14, 2, 15, 8, 4, 3]
    assert "".join(r["prev"] for r in rows) == "TCA$CGGAATTCCGATG"
    table = index.suffix_rows(text)
    assert {r["base"]: r["lo"] for r in index.c_table(table).collect()} == {"A": 1, "C": 5, "G": 9, "T": 13}
    assert {r["row"]: r["pos"] for r in index.location_table(table, 4).collect()} == {0: 16, 2: 12, 3: 0, 14: 8, 15: 4}
    assert [r["dist"] for r in index.sample_distance(table, 4).orderBy("row").collect()] == [0, 3, 0, 0, 3, 2, 2, 1, 1, 1, 1, 2, 2, 3, 0, 0, 3]
    assert sorted(map(tuple, index.suffix_array_full(text).collect())) == [(r["row"], r["pos"]) for r in rows]


def brute(contigs, named, cap):
    """Literal model: hits inside runs of one contig, raw hits in F and its reverse complement."""
    rc = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    f = "".join(s.replace("N", "") for _, s in contigs)
    whole = f + rc(f)
    out = {}
    for name, read in named.items():
        raw = len(re.findall(f"(?={rc(read)})", whole))
        if raw > cap >= 0:
            continue
        for contig, seq in contigs:
            for flag, p in ((0, read), (16, rc(read))):
                for m in re.finditer(f"(?={p})", seq):
                    out.setdefault(name, []).append(f"{contig}:{m.start() + 1}:{flag}")
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_genomes(spark, seed):
    """Seed join = brute force = FM search, with gaps, ends, palindromes, caps, and a contig longer than a chunk."""
    rng = random.Random(seed)
    unit = "".join(rng.choice("ACGT") for _ in range(24))
    contigs = []
    for i in range(5):
        seq = "".join(rng.choice([unit, "N" * rng.randrange(1, 4), "".join(rng.choice("ACGT") for _ in range(rng.randrange(1, 40)))]) for _ in range(6))
        contigs.append((f"c{i}", seq + ("ACGT" * 100 if i == 2 else "")))
    f = "".join(s.replace("N", "") for _, s in contigs)
    named = {}
    for i in range(60):
        n = rng.randrange(12, 30)
        at = rng.randrange(0, len(f) - n)
        named[f"r{i}"] = f[at : at + n] if i % 3 else f[at : at + n][::-1].translate(str.maketrans("ACGT", "TGCA"))
    named["junction"] = (f + f[::-1].translate(str.maketrans("ACGT", "TGCA")))[len(f) - 6 : len(f) + 8]
    df = genome.contigs_of(spark.createDataFrame([(i, *c) for i, c in enumerate(contigs)], "ordinal long, name string, seq string"))
    for cap in (1, 3, -1):
        assert found(spark, df, named, max_hits=cap) == brute(contigs, named, cap)
    reads = reads_of(spark, named)
    table = fm.gather(index.suffix_rows(genome.genome_text(df), 4096), 16, 4096)  # no ties
    raw = sorted((r["read_id"], r["flag"], r["start"]) for r in align.raw_hits(reads, df).collect())
    inside = lambda rows: sorted((i, g, s) for i, g, s in map(tuple, rows) if 0 <= s <= len(f) - len(list(named.values())[i]))
    assert inside(fm.locate(reads, table).collect()) == raw
    assert inside(fm.locate_trace(reads, table).collect()) == raw


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "g.fa").write_text("".join(f">{n}\n{s[:20]}\r\n{s[20:]}\n" for _, n, s in GENOME))
    (tmp_path / "r.fq").write_text("\n".join(f"@{n}\n{s}\n+\n{'I' * len(s)}" for n, s in READS.items()))  # the last line has no end
    prefix = str(tmp_path / "index")
    assert main(["map", "-i", str(tmp_path / "r.fq"), "-p", prefix], spark) == 2
    assert main(["build", "-i", str(tmp_path / "g.fa"), "-p", prefix, "--fm"], spark) == 0
    assert main(["build", "-i", str(tmp_path / "g.fa"), "-p", prefix], spark) == 2
    assert main(["build", "-i", str(tmp_path / "g.fa"), "-p", prefix, "-f"], spark) == 0
    assert main(["map", "-i", str(tmp_path / "r.fq"), "-p", prefix], spark) == 0
    said = capsys.readouterr()
    assert len(said.out.splitlines()) == 10
    assert "reads 9, unique 3, multiple 3, mapped 66.67 %, rows 10" in said.err


def test_scans(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">one x\nACGT\n\nAC GT\n>two\n>three\nnnU\n")
    rows = files.read_fasta(spark, str(tmp_path / "a.fa")).orderBy("ordinal").collect()
    assert [(r["ordinal"], r["name"], r["seq"]) for r in rows] == [(0, "one x", "ACGTACGT"), (1, "two", ""), (2, "three", "nnU")]
    assert [tuple(r) for r in genome.contigs_of(spark.createDataFrame(rows)).orderBy("ordinal").collect()] == [(0, "one", "ACGTACGT"), (2, "three", "NNT")]
    (tmp_path / "b.fq").write_text("@a 1\nAC\n+\nII\n@b\nGG\n+\n@I")
    assert [tuple(r) for r in files.read_fastq(spark, str(tmp_path / "b.fq")).orderBy("read_id").collect()] == [(0, "a 1", "AC", "+", "II"), (1, "b", "GG", "+", "@I")]


def test_strict_end(spark, tmp_path):
    """The last record goes if its line has no end, whatever the line ends are; whole files stay."""
    for i, (end, text) in enumerate([("", "@a\nAC\n+\nII\n@b\nGG\n+\n@I"), ("\n", "@a\nAC\n+\nII\n@b\nGG\n+\n@I\n"), ("", "@a\r\nAC\r\n+\r\nII\r\n@b\r\nGG\r\n+\r\nII")]):
        path = tmp_path / f"{i}.fq"
        path.write_bytes(text.encode())
        assert files.read_fastq(spark, str(path)).count() == 2
        strict = files.read_fastq(spark, str(path), strict_end=True).collect()
        assert [(r["read_id"], r["name"], r["seq"]) for r in strict] == [(0, "a", "AC"), (1, "b", "GG")][: 2 if end else 1]


def test_long_reads(spark):
    """Reads of many pieces, over block edges, gaps and the junction."""
    rng = random.Random(7)
    seq = "".join(rng.choice("ACGT") for _ in range(3000))
    contigs = [("one", seq[:1500] + "NN" + seq[1500:]), ("two", seq[200:900])]
    rc = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    named = {f"r{n}": seq[300 : 300 + n] for n in (12, 23, 24, 64, 65, 127, 128, 129, 600, 601)}
    named |= {"back": rc(seq[310:890]), "over gap": seq[1400:1600], "odd": seq[300:400] + "A" + seq[401:500], "end": seq[880:900] + rc(seq[880:900])}
    df = genome.contigs_of(spark.createDataFrame([(i, *c) for i, c in enumerate(contigs)], "ordinal long, name string, seq string"))
    assert found(spark, df, named, max_hits=-1) == brute(contigs, named, -1)
    raw = {r["read_id"]: r["raw_n"] for r in align.raw_hits(reads_of(spark, named), df).collect()}
    f = seq + seq[200:900]
    whole = f + rc(f)
    for i, read in enumerate(named.values()):
        want = len(re.findall(f"(?={rc(read)})", whole))
        assert raw.get(i, 0) in (want, 0) and (want == 0 or i in raw or read == named["end"])


def test_one_contig_spreads(spark):
    """Blocks of one long contig lie in many partitions, each row at most a block and its context."""
    seq = "ACGTTGCA" * 20_000
    made = genome.blocks(genome.placed_segments(genome.segments(genome.contigs_of(spark.createDataFrame([(0, "c", seq)], "ordinal long, name string, seq string")))))
    rows = made.collect()
    assert "".join(r["text"][: genome.BLOCK] for r in sorted(rows, key=lambda r: r["block"])) == seq
    assert max(len(r["text"]) for r in rows) == genome.BLOCK + genome.SPAN - 1


def test_stream_leaves_nothing(spark, contigs, tmp_path):
    import os

    from basewright.plans import scratch
    from basewright.streaming import align_stream

    reads = reads_of(spark, READS)
    blocks = genome.searchable(contigs)
    reads.repartition(9).write.parquet(str(tmp_path / "in"))
    folder = scratch.shared_dir(spark).removeprefix("file://") + "/basewright"
    before = set(os.listdir(folder))
    stream = align_stream.read_stream(spark, str(tmp_path / "in"), reads.schema, files_a_batch=2)
    align_stream.map_stream(stream, blocks, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert set(os.listdir(folder)) == before
    assert align_stream.streamed_rows(spark, str(tmp_path / "out")).count() == 10
    assert [r["read_id"] for r in files.records(reads, "read_id")] == list(range(len(READS)))


def test_fm_index_stays_in_tables(spark, monkeypatch):
    """Repeats longer than the sort depth, over many small blocks and chunks, and nothing of the index comes to the driver."""
    rng = random.Random(11)
    seq = "".join(rng.choice("ACGT") for _ in range(150))
    f = seq * 3
    whole = f + f[::-1].translate(str.maketrans("ACGT", "TGCA"))
    monkeypatch.setattr(fm, "WIDTH", 7)
    monkeypatch.setattr(fm, "CHUNK", 2)
    monkeypatch.setattr(type(spark.range(1)), "toPandas", lambda self: pytest.fail("the index came to the driver"))
    df = genome.contigs_of(spark.createDataFrame([(0, "c", f)], "ordinal long, name string, seq string"))
    named = {"a": seq[20:36], "b": seq[140:150] + seq[:6], "c": seq[5:17], "none": "ACGT" * 4, "again": seq[20:36]}
    reads = reads_of(spark, named)
    rows = index.suffix_rows(genome.strands(df), 64)
    table = fm.gather(rows, 16, 64)
    rc = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    want = []
    for i, read in enumerate(named.values()):
        for m in re.finditer(f"(?={rc(read)})", whole):
            p = m.start()
            want.append((i, 0, 2 * len(f) - p - len(read)) if p >= len(f) else (i, 16, p))
    assert sorted(map(tuple, fm.locate(reads, table).collect())) == sorted(want)
    assert sorted(map(tuple, fm.locate_trace(reads, table).collect())) == sorted(want)
    kept = [(r["row"], r["suffix"]) for r in rows.collect()]
    spans = {i: [r for r, s in kept if s.startswith(rc(read))] for i, read in enumerate(named.values())}
    assert {r["read_id"]: (r["lo"], r["hi"]) for r in fm.backward_search(reads, table).collect()} == {i: (min(x), max(x) + 1) for i, x in spans.items() if x}


def test_sieve():
    """Every k-mer of the set passes, also over pieces of places and outside ASCII; few others do."""
    import numpy as np

    from basewright.functions import sieve

    rng = random.Random(5)
    for letters in ("ACGT", "añ日😀"):
        text = "".join(rng.choice(letters) for _ in range(sieve.PLACES + 500))
        codes = sieve.code_points(text)
        for k in (1, 12, 13, 24):
            got = sieve.hashes(codes[:200], k)
            rows = np.array([codes[i : i + k] for i in range(200 - k + 1)])
            assert (got == sieve.hashes_of_rows(rows)).all()
        wanted = [0, 77, sieve.PLACES - 13, sieve.PLACES - 1, len(text) - 24]
        words = np.zeros(1 << 10, np.uint64)
        for i in wanted:
            h = int(sieve.hashes(codes[i : i + 24], 24)[0])
            words[h >> 54] |= np.uint64(1 << (h & 63) | 1 << (h >> 6 & 63))
        passed = sieve.passing(codes, 24, words)
        assert set(wanted) <= set(passed.tolist()) and len(passed) < len(text) / 100


def test_text_search_outside_ascii(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice("abñ日😀\n") for _ in range(n)) for n in (1, 40, 700, 2000)] + ["ñ" * 300]
    passages = [texts[2][100:112], texts[3][5:70], texts[3][1500:1999], texts[1][-3:], "ñ" * 70, "nowhere at all", texts[2][:24]]
    got = align.text_search(spark.createDataFrame(list(enumerate(texts)), "text_id long, text string"), spark.createDataFrame(list(enumerate(passages)), "item_id long, passage string"))
    want = [(i, j, m.start()) for i, t in enumerate(texts) for j, p in enumerate(passages) for m in re.finditer(f"(?={re.escape(p)})", t)]
    assert sorted(map(tuple, got.select("text_id", "item_id", "pos").collect())) == sorted(want)


def test_asof_window_holds_keys_not_rows(spark):
    """Many left rows of one key share one row of the windows, and every one comes back."""
    from pyspark.sql import functions as F

    from basewright.operators.asof import asof_join

    left = spark.createDataFrame([(i, None if i == 0 else (i % 3) * 5 + 1) for i in range(600)], "id long, k long")
    right = spark.createDataFrame([(5, "a"), (8, "b"), (11, "c")], "k long, v string")
    got = asof_join(left, right, "k", width=4)
    assert sorted(map(tuple, got.select("id", "k", "v").collect())) == [(i, (i % 3) * 5 + 1, (None, "a", "c")[i % 3]) for i in range(1, 600)]
    keys = left.select("k").distinct().count()
    seen = []
    plain = type(left).filter

    def count(self, condition):
        if condition == "__side = 1":
            seen.append(plain(self, condition).count())
        return plain(self, condition)

    type(left).filter = count
    try:
        asof_join(left, right, "k", width=4)
    finally:
        type(left).filter = plain
    assert seen == [keys]


def test_compared_counts_both_sides(spark):
    """Rows more or fewer on either side count, copies and nulls too."""
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, None), (3, "y")], "k long, v string")
    b = spark.createDataFrame([("x", 1), (None, 2), ("z", 4)], "v string, k long")
    assert tuple(index.compared(a, b).first()) == (4, 3)
    assert tuple(index.compared(a, a).first()) == (4, 0)
    assert tuple(index.compared(a.limit(0), b).first()) == (0, 3)


def test_coordinates_cut_contigs_once(spark, tmp_path):
    """Contigs are read once for all coordinates."""
    spark.createDataFrame(GENOME, "ordinal long, name string, seq string").write.parquet(str(tmp_path / "c"))
    segs = genome.segments(genome.contigs_of(spark.read.parquet(str(tmp_path / "c"))))
    made = genome.n_positions(segs)
    assert not any(str(tmp_path) in f for f in made.inputFiles())
    assert sorted(map(tuple, made.collect())) == [(0, 2), (16, 5), (31, 0), (58, 0), (84, 0)]
