"""Queries of the sequence engine over the tables of a folder, and their SQL.

Two genomes come from the tables, each from every row of its table. ``supplier``
rows give short contigs with single N and repeated halves, which small SQL can
follow through every index table. ``documents`` rows give long contigs, whose
line ends are N, for the queries that map many reads.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basewright.functions import dna
from basewright.operators import align, fm, genome, index
from basewright.operators.asof import asof_join
from basewright.plans import scratch
from basewright.sources import sequence_files as files
from basewright.streaming import align_stream

# ---- the derived tables, one text for both engines ------------------------------------------------------------------

SUPPLIER_CONTIGS = """
SELECT cast(s_suppkey AS bigint) AS ordinal, concat('c', cast(s_suppkey AS string)) AS name,
       translate(concat(md5(concat('n', cast(s_nationkey AS string))), md5(s_name)), '0123456789abcdef', 'ACGTACGTACGTACGN') AS seq
FROM {supplier}"""

SUPPLIER_READS = """
SELECT read_id, concat('r', cast(read_id AS string), ' x') AS name,
       CASE WHEN read_id % 2 = 0 THEN f ELSE translate(reverse(f), 'ACGT', 'TGCA') END AS seq, '+' AS plus, 'ABCDEFGHIJKLMNOP' AS qual
FROM (
  SELECT ordinal * 8 + i AS read_id, substring(seq, cast(1 + (ordinal * 7919 + i * 104729) % 48 AS int), 16) AS f
  FROM {contigs} CROSS JOIN (VALUES (0), (1), (2), (3)) AS t(i)
  UNION ALL
  SELECT ordinal * 8 + 4 AS read_id, concat(right(bare, 8), left(lead(bare) OVER (ORDER BY ordinal), 8)) AS f
  FROM (SELECT ordinal, replace(seq, 'N', '') AS bare FROM {contigs}) AS b
) AS windows WHERE length(f) = 16"""

DOCUMENT_CONTIGS = """
SELECT doc_id AS ordinal, concat('d', cast(doc_id AS string)) AS name,
       translate(regexp_replace(lower(text), '[^a-z\n]', ''{g}), 'abcdefghijklmnopqrstuvwxyz\n', 'ACGTACGTACGTACGTACGTACGTACN') AS seq
FROM {documents} WHERE doc_id IS NOT NULL AND text IS NOT NULL"""

DOCUMENT_READS = """
SELECT read_id, concat('r', cast(read_id AS string)) AS name,
       CASE WHEN i % 2 = 0 THEN f ELSE translate(reverse(f), 'ACGT', 'TGCA') END AS seq, '+' AS plus, repeat('I', 36) AS qual
FROM (
  SELECT ordinal * 8 + i AS read_id, i, substring(seq, cast(1 + (ordinal * 7919 + i * 104729) % (length(seq) - 36) AS int), 36) AS f
  FROM {contigs} CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5), (6), (7)) AS t(i) WHERE length(seq) >= 64
) AS windows"""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def supplier_genome(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(contigs, reads)"""
    rows = spark.sql(SUPPLIER_CONTIGS, supplier=_table(spark, sf_dir, "supplier"))
    return genome.contigs_of(rows), spark.sql(SUPPLIER_READS, contigs=rows)


def document_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = DOCUMENT_CONTIGS.replace("{g}", "").replace("\\", "\\\\").replace("\n]", "\\n]").replace("z\n'", "z\\n'")
    return spark.sql(text, documents=scratch.spread(_table(spark, sf_dir, "documents").select("doc_id", "text")))


def document_genome(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(contigs, reads), written once; several plans read them, and the expressions cost more than the tables."""
    rows = scratch.materialise(document_rows(spark, sf_dir), "document-contigs")
    return genome.contigs_of(rows), scratch.materialise(spark.sql(DOCUMENT_READS, contigs=rows), "document-reads")


_SUPPLIER_SQL = f"c AS ({SUPPLIER_CONTIGS.format(supplier='supplier')}), r AS ({SUPPLIER_READS.format(contigs='c')})"
_DOCUMENT_SQL = f"c AS ({DOCUMENT_CONTIGS.format(documents='documents', g=chr(44) + ' ' + repr('g'))}), r AS ({DOCUMENT_READS.format(contigs='c')})"


def _mapping_sql(data: str, n: int) -> str:
    """Common tables of the mapping queries for reads of n bases: hits with everything that filters need."""
    return f"""WITH {data},
contig AS (SELECT ordinal, name, seq, replace(seq, 'N', '') AS bare FROM c),
placed AS (
  SELECT *, sum(length(bare)) OVER (ORDER BY ordinal) - length(bare) AS contig_start,
         coalesce(left(string_agg(left(bare, {n}), '') OVER (ORDER BY ordinal ROWS BETWEEN 1 FOLLOWING AND {n} FOLLOWING), {n}), '') AS beyond
  FROM contig WHERE length(bare) > 0),
base AS (
  SELECT ordinal, i AS pos0, i - row_number() OVER (PARTITION BY ordinal ORDER BY i) AS island,
         row_number() OVER (PARTITION BY ordinal ORDER BY i) - 1 AS nth
  FROM (SELECT ordinal, unnest(range(0, length(seq))) AS i, unnest(string_split(seq, '')) AS b FROM c) WHERE b <> 'N'),
kmer AS (
  SELECT name, cast(contig_start + nth AS bigint) AS start, pos0, n_free, substring(concat(bare, beyond), cast(nth + 1 AS int), {n}) AS w
  FROM (SELECT ordinal, pos0, nth, count(*) OVER (PARTITION BY ordinal, island ORDER BY pos0 DESC) AS n_free FROM base) AS b JOIN placed USING (ordinal)),
pat AS (
  SELECT read_id, 0 AS flag, seq AS p FROM r WHERE NOT contains(seq, 'N')
  UNION ALL SELECT read_id, 16 AS flag, translate(reverse(seq), 'ACGT', 'TGCA') AS p FROM r WHERE NOT contains(seq, 'N')),
found AS (SELECT read_id, flag, name, start, pos0, n_free FROM pat JOIN kmer ON w = p),
tail AS (SELECT right(string_agg(right(bare, {n}), '' ORDER BY ordinal), {n - 1}) AS t FROM placed),
junction AS (SELECT substring(concat(t, translate(reverse(t), 'ACGT', 'TGCA')), cast(k AS int), {n}) AS w FROM tail, unnest(range(1, {n})) AS u(k)),
raw AS (
  SELECT read_id, sum(k) AS raw_n FROM (
    SELECT read_id, count(*) AS k FROM found GROUP BY read_id
    UNION ALL SELECT read_id, count(*) AS k FROM pat JOIN junction ON w = p WHERE flag = 16 GROUP BY read_id) GROUP BY read_id),
inside AS (SELECT f.*, raw_n FROM found AS f JOIN raw USING (read_id) WHERE n_free >= {n}),
hit AS (SELECT *, count(*) OVER (PARTITION BY read_id) AS nh FROM inside WHERE raw_n <= 1000),
sam AS (
  SELECT r.name AS qname, flag, hit.name AS rname, pos0 + 1 AS pos, 255 AS mapq, '{n}M' AS cigar, '*' AS rnext, 0::BIGINT AS pnext, 0::BIGINT AS tlen,
         CASE WHEN flag = 16 THEN translate(reverse(seq), 'ACGT', 'TGCA') ELSE seq END AS seq,
         CASE WHEN flag = 16 THEN reverse(qual) ELSE qual END AS qual, cast(nh AS int) AS nh
  FROM hit JOIN r USING (read_id))
"""


_SUPPLIER_MAP = _mapping_sql(_SUPPLIER_SQL, 16)
_DOCUMENT_MAP = _mapping_sql(_DOCUMENT_SQL, 36)

_TEXT_SQL = f"""WITH {_SUPPLIER_SQL},
f AS (SELECT string_agg(replace(seq, 'N', ''), '' ORDER BY ordinal) AS f FROM c),
s AS (SELECT concat(f, translate(reverse(f), 'ACGT', 'TGCA'), '$') AS text FROM f),
sa AS (
  SELECT row_number() OVER (ORDER BY suffix, pos) - 1 AS row, pos, suffix, prev FROM (
    SELECT pos, substring(text, cast(pos + 1 AS int), 256) AS suffix, CASE WHEN pos = 0 THEN '$' ELSE substring(text, cast(pos AS int), 1) END AS prev
    FROM s, unnest(range(0, length(text))) AS u(pos)))
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return supplier_genome(spark, sf_dir)[1]


def _contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return supplier_genome(spark, sf_dir)[0]


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return genome.segments(_contigs(spark, sf_dir))


def _suffix_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.suffix_rows(genome.strands(_contigs(spark, sf_dir)))


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    contigs, reads = supplier_genome(spark, sf_dir)
    return align.raw_hits(reads, contigs)


def _lifted(spark: SparkSession, sf_dir: str, lift: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """All raw hits with what ``lift`` adds to the places (pattern, start) of distinct patterns, before they meet the reads."""
    contigs, reads = supplier_genome(spark, sf_dir)
    pats, found = align.places(reads, contigs)
    at = scratch.materialise(lift(found.filter("start >= 0").select("pattern", "start")), "lifted-places")
    return pats.join(at, "pattern")


def _fm(spark: SparkSession, sf_dir: str) -> fm.FmIndex:
    return fm.gather(_suffix_rows(spark, sf_dir), index.INTERVAL, index.DEPTH)


# ---- sources and sinks ----------------------------------------------------------------------------------------------


@_query(f"WITH {_SUPPLIER_SQL} SELECT concat(name, ' supplier ', cast(ordinal AS string)) AS name, seq FROM c")
def fasta_scan(spark, sf_dir):
    """Render contigs as wrapped FASTA files, then scan them."""
    rows = _contigs(spark, sf_dir).select(
        F.concat("name", F.lit(" supplier "), F.col("ordinal").cast("string")).alias("name"), F.regexp_replace("seq", "(.{25})", "$1\n").alias("seq")
    )
    path = scratch.new_path(spark, "fasta")
    files.fasta_lines(rows).write.text(path)
    return files.read_fasta(spark, path).select("name", "seq")


@_query(f"WITH {_SUPPLIER_SQL} SELECT concat('>', name, chr(10), seq) AS value FROM c")
def fasta_text(spark, sf_dir):
    return files.fasta_lines(_contigs(spark, sf_dir))


@_query(f"WITH {_SUPPLIER_SQL} SELECT name, seq, plus, qual FROM r")
def fastq_scan(spark, sf_dir):
    """Render reads as FASTQ files, then scan them."""
    path = scratch.new_path(spark, "fastq")
    files.fastq_lines(_reads(spark, sf_dir)).write.text(path)
    return files.read_fastq(spark, path).select("name", "seq", "plus", "qual")


@_query(f"WITH {_SUPPLIER_SQL} SELECT concat('@', name, chr(10), seq, chr(10), plus, chr(10), qual) AS value FROM r")
def fastq_text(spark, sf_dir):
    return files.fastq_lines(_reads(spark, sf_dir))


@_query(f"WITH {_SUPPLIER_SQL} SELECT read_id, cast(length(concat('@', name, seq, plus, qual)) + 4 AS bigint) AS n FROM r")
def record_len(spark, sf_dir):
    return files.record_length(_reads(spark, sf_dir))


@_query(f"WITH {_SUPPLIER_SQL} SELECT read_id, cast(floor(read_id / 1000) AS bigint) AS batch, seq FROM r")
def fastq_batch(spark, sf_dir):
    return files.read_batches(_reads(spark, sf_dir), 1000).select("read_id", "batch", "seq")


@_query(f"WITH {_SUPPLIER_SQL} SELECT read_id, seq FROM (SELECT * FROM r ORDER BY read_id LIMIT 100) WHERE NOT contains(seq, 'N')")
def reads_nskip(spark, sf_dir):
    """The batch reader's limit of reads is its feature; reads with N use it up without coming out."""
    return files.first_without_n(_reads(spark, sf_dir), 100).select("read_id", "seq")


@_query(f"WITH {_SUPPLIER_SQL} SELECT ordinal AS read_id, name, seq, '+' AS plus, repeat('I', length(seq)) AS qual FROM c")
def fasta_as_reads(spark, sf_dir):
    return files.fasta_as_reads(_contigs(spark, sf_dir))


@_query(f"""WITH {_SUPPLIER_SQL}, l AS (SELECT ordinal, unnest([concat('>', name), seq]) AS value FROM c) SELECT value, count(*) AS n FROM l GROUP BY value""")
def raw_lines(spark, sf_dir):
    """Lines of files as they are, with the number that each has in its file."""
    path = scratch.new_path(spark, "lines")
    files.fasta_lines(_contigs(spark, sf_dir)).write.text(path)
    return files.read_lines(spark, path).groupBy("value").agg(F.count("line").alias("n"))


@_query(f"""WITH {_SUPPLIER_SQL} SELECT cast(floor(read_id / 1000) AS bigint) AS batch, count(*) AS n, cast(sum(length(seq)) AS bigint) AS bases FROM r GROUP BY 1""")
def batch_callback(spark, sf_dir):
    """A Python callback on every batch of 1,000 reads."""
    import pandas as pd

    def count(batch):
        return pd.DataFrame({"batch": [batch["batch"].iloc[0]], "n": [len(batch)], "bases": [batch["seq"].str.len().sum()]})

    return files.map_batches(_reads(spark, sf_dir), 1000, count, "batch bigint, n bigint, bases bigint")


# ---- scalar functions -------------------------------------------------------------------------------------------------


@_query(f"WITH {_SUPPLIER_SQL} SELECT read_id, translate(reverse(seq), 'ACGT', 'TGCA') AS rc, reverse(qual) AS rq FROM r")
def revcomp(spark, sf_dir):
    return _reads(spark, sf_dir).select("read_id", dna.reverse_complement(F.col("seq")).alias("rc"), F.reverse("qual").alias("rq"))


@_query(f"""WITH {_SUPPLIER_SQL} SELECT read_id, cast((SELECT sum((strpos('ACGT', substring(seq, cast(i + 1 AS int), 1)) - 1) * (4 ** (11 - i)))
  FROM unnest(range(0, 12)) AS u(i)) AS bigint) AS code FROM r WHERE NOT contains(seq, 'N')""")
def kmer_code(spark, sf_dir):
    usable = _reads(spark, sf_dir).filter(dna.is_plain(F.col("seq")))
    return usable.select("read_id", dna.kmer_code(F.substring("seq", 1, 12)).alias("code"))


@_query(f"""WITH {_SUPPLIER_SQL}, p AS (SELECT name, rpad(replace(seq, 'N', ''), cast(length(replace(seq, 'N', '')) // 4 * 4 + 4 AS int), 'A') AS s FROM c)
SELECT name, array_to_string(list_transform(range(0, length(s) // 4), lambda b:
  cast(list_sum(list_transform(range(0, 4), lambda k: (strpos('ACGT', substring(s, cast(b * 4 + k + 1 AS int), 1)) - 1) * cast(4 ** (3 - k) AS bigint))) AS int)), ',') AS packed FROM p""")
def pack2bit(spark, sf_dir):
    bare = dna.without_n(F.col("seq"))
    return _contigs(spark, sf_dir).select("name", F.array_join(dna.pack(bare).cast("array<string>"), ",").alias("packed"))


@_query(f"WITH {_SUPPLIER_SQL} SELECT name, replace(seq, 'N', '') AS seq FROM c")
def unpack2bit(spark, sf_dir):
    bare = dna.without_n(F.col("seq"))
    return _contigs(spark, sf_dir).select("name", dna.unpack(dna.pack(bare), F.length(bare)).alias("seq"))


@_query(f"""WITH {_SUPPLIER_SQL}, p AS (SELECT name, ordinal % 40 AS off, replace(seq, 'N', '') AS s FROM c)
SELECT name, cast((SELECT sum((strpos('ACGT', substring(s, cast(off + i + 1 AS int), 1)) - 1) * (4 ** (7 - i))) FROM unnest(range(0, 8)) AS u(i)) AS bigint) AS code FROM p""")
def packed_kmer(spark, sf_dir):
    """Codes of 8-mers at any offset, straight from packed bytes."""
    packed = dna.pack(dna.without_n(F.col("seq")))
    return _contigs(spark, sf_dir).select("name", dna.packed_kmer(packed, (F.col("ordinal") % 40).cast("int"), 8).alias("code"))


@_query(f"WITH {_SUPPLIER_SQL} SELECT name, replace(seq, 'N', '') AS seq FROM c")
def seq_no_n(spark, sf_dir):
    return _contigs(spark, sf_dir).select("name", dna.without_n(F.col("seq")).alias("seq"))


@_query(f"WITH {_SUPPLIER_SQL} SELECT name, seq FROM c")
def seq_with_n(spark, sf_dir):
    return files.with_n_runs(_segments(spark, sf_dir)).select("name", "seq")


# ---- coordinates ------------------------------------------------------------------------------------------------------

_RUNS = f"""WITH {_DOCUMENT_SQL}, runs AS (
  SELECT ordinal, name, unnest(regexp_extract_all(seq, 'N*[ACGT]+|N+')) AS run, generate_subscripts(regexp_extract_all(seq, 'N*[ACGT]+|N+'), 1) - 1 AS seg_no
  FROM c WHERE length(seq) > 0),
seg AS (SELECT ordinal, name, seg_no, cast(length(run) - length(replace(run, 'N', '')) AS bigint) AS n_before,
  cast(length(replace(run, 'N', '')) AS bigint) AS len, replace(run, 'N', '') AS seq FROM runs),
lens AS (SELECT ordinal, name, cast(sum(len) AS bigint) AS len FROM seg GROUP BY ALL HAVING sum(len) > 0)
"""


def _document_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return genome.segments(genome.contigs_of(document_rows(spark, sf_dir)))


@_query(_RUNS + "SELECT name, cast(seg_no AS int) AS seg_no, n_before, len, seq FROM seg")
def segments(spark, sf_dir):
    return _document_segments(spark, sf_dir).select("name", "seg_no", "n_before", "len", "seq")


@_query(_RUNS + "SELECT name, len FROM lens")
def chr_len(spark, sf_dir):
    return genome.contig_lengths(genome.sizes(_document_segments(spark, sf_dir))).select("name", "len")


@_query(_RUNS + "SELECT name, cast(sum(len) OVER (ORDER BY ordinal) - len AS bigint) AS start FROM lens")
def chr_start(spark, sf_dir):
    return genome.contig_lengths(genome.sizes(_document_segments(spark, sf_dir))).select("name", "start")


@_query(_RUNS + """, cum AS (SELECT *, sum(n_before) OVER (PARTITION BY ordinal ORDER BY seg_no) AS n_cum,
  sum(len) OVER (ORDER BY ordinal, seg_no) - len AS start FROM seg)
SELECT cast(start AS bigint) AS start, cast(n_cum AS bigint) AS n_cum FROM cum WHERE len > 0
UNION ALL SELECT cast((SELECT sum(len) FROM seg) AS bigint), cast(sum(n_before) AS bigint) FROM seg WHERE ordinal = (SELECT max(ordinal) FROM lens)""")
def npos_len(spark, sf_dir):
    return genome.n_positions(_document_segments(spark, sf_dir))


@_query(f"WITH {_SUPPLIER_SQL} SELECT left(seq, 2) AS name, count(*) AS n FROM c GROUP BY 1 HAVING count(*) > 1")
def dup_contigs(spark, sf_dir):
    """Contigs named by their first two bases, so that names repeat."""
    return genome.duplicate_names(_contigs(spark, sf_dir).withColumn("name", F.left("seq", F.lit(2))))


@_query(_TEXT_SQL + "SELECT text FROM s")
def genome_text(spark, sf_dir):
    return genome.genome_text(_contigs(spark, sf_dir))


# ---- index tables -----------------------------------------------------------------------------------------------------


@_query(_TEXT_SQL + "SELECT row, pos FROM sa")
def suffix_array(spark, sf_dir):
    return _suffix_rows(spark, sf_dir).select("row", "pos")


@_query(_TEXT_SQL + "SELECT row_number() OVER (ORDER BY substring(text, cast(pos + 1 AS int))) - 1 AS row, pos FROM s, unnest(range(0, length(text))) AS u(pos)")
def suffix_array_full(spark, sf_dir):
    return index.suffix_array_full(genome.strands(_contigs(spark, sf_dir)))


@_query(_TEXT_SQL + "SELECT row, pos, 0 AS wrong FROM sa")
def split_classify(spark, sf_dir):
    """Number the sorted ranges one after the other; wrong counts rows out of order."""
    dealt = scratch.materialise(index.split_classes(genome.strands(_contigs(spark, sf_dir)), 8), "splits")
    rows = index.numbered(dealt, ["split"], ["suffix", "pos"], "row")
    spans = dealt.groupBy("split").agg(F.min("suffix").alias("lo"), F.max("suffix").alias("hi"))
    after = spans.select((F.col("split") - 1).alias("split"), F.col("lo").alias("next"))
    wrong = spans.join(after, "split").agg(F.count_if(F.col("hi") > F.col("next")).cast("int").alias("wrong"))
    return rows.join(F.broadcast(wrong), F.lit(True)).select("row", "pos", "wrong")  # one row


@_query(_TEXT_SQL + "SELECT row, prev AS base FROM sa")
def bwt(spark, sf_dir):
    return index.bwt(_suffix_rows(spark, sf_dir))


@_query(_TEXT_SQL + "SELECT b.base, 1 + count(sa.row) AS lo FROM (VALUES ('A'), ('C'), ('G'), ('T')) AS b(base) LEFT JOIN sa ON prev <> '$' AND prev < b.base GROUP BY b.base")
def c_table(spark, sf_dir):
    return index.c_table(_suffix_rows(spark, sf_dir))


@_query(_TEXT_SQL + "SELECT left(suffix, 12) AS kmer, min(row) AS lo, max(row) + 1 AS hi FROM sa WHERE length(suffix) >= 12 AND NOT contains(left(suffix, 12), '$') GROUP BY 1")
def kmer_c_table(spark, sf_dir):
    return index.kmer_table(_suffix_rows(spark, sf_dir))


_OCC = ", ".join(f"count(*) FILTER (prev = '{b}') OVER (ORDER BY row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS {b.lower()}" for b in "ACGT")


@_query(_TEXT_SQL + f"SELECT row, {_OCC} FROM sa")
def occ_rank(spark, sf_dir):
    return index.occ_rank(_suffix_rows(spark, sf_dir))


@_query(_TEXT_SQL + f"SELECT * FROM (SELECT row, {_OCC} FROM sa) WHERE row % 64 = 0")
def occ_checkpoints(spark, sf_dir):
    return index.occ_checkpoints(_suffix_rows(spark, sf_dir))


@_query(_TEXT_SQL + "SELECT row, pos FROM sa WHERE pos % 64 = 0")
def location_table(spark, sf_dir):
    return index.location_table(_suffix_rows(spark, sf_dir))


@_query(_TEXT_SQL + "SELECT row, cast(pos % 64 AS int) AS dist FROM sa")
def fbwt(spark, sf_dir):
    return index.sample_distance(_suffix_rows(spark, sf_dir))


@_query(_TEXT_SQL + "SELECT read_id, row, pos FROM r JOIN sa ON left(suffix, 16) = translate(reverse(seq), 'ACGT', 'TGCA') WHERE NOT contains(seq, 'N')")
def location_join(spark, sf_dir):
    rows = scratch.materialise(_suffix_rows(spark, sf_dir), "suffix-rows")
    usable = _reads(spark, sf_dir).filter(dna.is_plain(F.col("seq")))
    wanted = usable.withColumn("p", dna.reverse_complement(F.col("seq"))).join(rows.withColumn("p", F.left("suffix", F.lit(16))), "p").select("read_id", "row")
    return index.location_join(rows, wanted).select("read_id", "row", "pos")


@_query(_TEXT_SQL + """, n AS (SELECT count(*) AS n FROM sa)
SELECT part, size, 0::BIGINT AS wrong FROM (SELECT 'bwt' AS part, n AS size FROM n UNION ALL SELECT 'fbwt', n FROM n UNION ALL SELECT 'c_table', 4
UNION ALL SELECT 'contigs', count(*) FROM c UNION ALL SELECT 'chr_start', count(*) FROM c WHERE replace(seq, 'N', '') <> ''
UNION ALL SELECT 'chr_len', count(*) FROM c WHERE replace(seq, 'N', '') <> ''
UNION ALL SELECT 'npos_len', 1 + sum(len(regexp_extract_all(seq, '[ACGT]+')))::BIGINT FROM c
UNION ALL SELECT 'location_table', count(*) FROM sa WHERE pos % 64 = 0 UNION ALL SELECT 'occ_checkpoints', count(*) FROM sa WHERE row % 64 = 0
UNION ALL SELECT 'kmer_c_table', count(DISTINCT left(suffix, 12)) FROM sa WHERE length(suffix) >= 12 AND NOT contains(left(suffix, 12), '$')
UNION ALL SELECT 'blocks', cast(ceil(length(f) / 256.0) AS bigint) FROM f)""")
def index_roundtrip(spark, sf_dir):
    """Rows of every table of a stored and loaded index, and rows in which it differs from tables made afresh."""
    contigs, path = _contigs(spark, sf_dir), scratch.new_path(spark, "index")
    index.build_index(contigs, path, fm=True)
    stored, fresh = index.load_index(spark, path), index.index_tables(contigs, fm=True)
    counts = None
    for name, table in stored.items():
        one = index.compared(table, fresh[name]).select(F.lit(name).alias("part"), "size", "wrong")
        counts = one if counts is None else counts.union(one)
    return counts


# ---- mapping ----------------------------------------------------------------------------------------------------------


@_query(_SUPPLIER_MAP + "SELECT DISTINCT p AS pattern, start, name FROM pat JOIN kmer ON left(w, 12) = left(p, 12)")
def seed_join(spark, sf_dir):
    contigs, reads = supplier_genome(spark, sf_dir)
    placed = genome.placed_segments(genome.segments(contigs))
    places = align.kmers(genome.blocks(placed), align.SEED)
    return align.seed_join(align.patterns(reads), places).select("pattern", "start", "name")


@_query(_SUPPLIER_MAP + "SELECT read_id, flag, start FROM found")
def exact_hits(spark, sf_dir):
    return _raw(spark, sf_dir).select("read_id", "flag", "start")


_ASOF = _SUPPLIER_MAP + ", chr AS (SELECT name AS rname, contig_start AS start FROM placed)\n"


@_query(_ASOF + "SELECT read_id, flag, found.start, rname FROM found ASOF JOIN chr ON found.start >= chr.start")
def asof_contig(spark, sf_dir):
    starts = genome.contig_lengths(_segments(spark, sf_dir)).select("start", F.col("name").alias("rname"))
    return _lifted(spark, sf_dir, lambda at: asof_join(at, starts, "start")).select("read_id", "flag", "start", "rname")


@_query(_SUPPLIER_MAP + "SELECT read_id, flag, start, pos0 - (start - contig_start) AS n_cum FROM found JOIN placed USING (name)")
def asof_segment(spark, sf_dir):
    positions = genome.n_positions(_segments(spark, sf_dir))
    return _lifted(spark, sf_dir, lambda at: asof_join(at, positions, "start")).select("read_id", "flag", "start", "n_cum")


@_query(_SUPPLIER_MAP + "SELECT read_id, flag, pos0 FROM found")
def coord_lift(spark, sf_dir):
    """Contig coordinates from F's by two as-of joins."""
    segs = _segments(spark, sf_dir)
    starts = genome.contig_lengths(segs).select("start", F.col("start").alias("contig_start"))
    lifted = _lifted(spark, sf_dir, lambda at: asof_join(asof_join(at, starts, "start"), genome.n_positions(segs), "start"))
    return lifted.select("read_id", "flag", (F.col("start") - F.col("contig_start") + F.col("n_cum")).alias("pos0"))


@_query(_SUPPLIER_MAP + "SELECT read_id, flag, name, pos0 FROM inside")
def boundary_filter(spark, sf_dir):
    return align.inside_runs(_raw(spark, sf_dir)).select("read_id", "flag", "name", "pos0")


@_query(_SUPPLIER_MAP + "SELECT read_id, flag, name, pos0 FROM inside WHERE raw_n <= 1000 AND flag = 16")
def strand_filter(spark, sf_dir):
    contigs, reads = supplier_genome(spark, sf_dir)
    return align.hits(reads, contigs, strand=1).select("read_id", "flag", "name", "pos0")


@_query(_SUPPLIER_MAP + "SELECT read_id, flag, start, cast(raw_n AS bigint) AS raw_n FROM found JOIN raw USING (read_id) WHERE raw_n <= 3")
def multi_cap(spark, sf_dir):
    contigs, reads = supplier_genome(spark, sf_dir)
    return align.raw_hits(reads, contigs, max_hits=3).select("read_id", "flag", "start", "raw_n")


@_query(_SUPPLIER_MAP + "SELECT read_id, flag, name, pos0 FROM inside WHERE raw_n <= 1")
def unique_only(spark, sf_dir):
    contigs, reads = supplier_genome(spark, sf_dir)
    return align.hits(reads, contigs, 1).select("read_id", "flag", "name", "pos0")


@_query(_SUPPLIER_MAP + "SELECT DISTINCT read_id, nh FROM hit")
def nh_count(spark, sf_dir):
    contigs, reads = supplier_genome(spark, sf_dir)
    return align.hits(reads, contigs).select("read_id", "nh").distinct()


@_query(_SUPPLIER_MAP + "SELECT * FROM sam")
def sam_rows(spark, sf_dir):
    contigs, reads = supplier_genome(spark, sf_dir)
    return align.align(reads, contigs)


@_query(_SUPPLIER_MAP + "SELECT concat_ws(chr(9), qname, flag, rname, pos, mapq, cigar, rnext, pnext, tlen, seq, qual, nh) || chr(9) AS value FROM sam")
def sam_text(spark, sf_dir):
    contigs, reads = supplier_genome(spark, sf_dir)
    return files.sam_lines(align.align(reads, contigs))


@_query(_SUPPLIER_MAP + "SELECT qname, rname, pos + 15 AS last FROM sam WHERE flag = 16")
def record_callback(spark, sf_dir):
    """A Python callback on every SAM record, which gives any number of rows for each."""
    contigs, reads = supplier_genome(spark, sf_dir)

    def reverse_ends(record):
        return [{"qname": record["qname"], "rname": record["rname"], "last": record["pos"] + 15}] if record["flag"] == 16 else []

    return align.per_record(align.align(reads, contigs), reverse_ends, "qname string, rname string, last bigint")


@_query(_SUPPLIER_MAP + "SELECT * FROM sam")
def sam_parse(spark, sf_dir):
    """Write SAM text, then parse it."""
    contigs, reads = supplier_genome(spark, sf_dir)
    path = scratch.new_path(spark, "sam")
    files.sam_lines(align.align(reads, contigs)).write.text(path)
    return files.parse_sam(spark.read.text(path))


@_query(_SUPPLIER_MAP + "SELECT * FROM sam")
def stream_align(spark, sf_dir):
    """The same reads as a stream of files."""
    contigs, reads = supplier_genome(spark, sf_dir)
    path = scratch.new_path(spark, "stream")
    reads.repartition(3).write.parquet(f"{path}/in")
    stream = align_stream.read_stream(spark, f"{path}/in", reads.schema, files_a_batch=2)
    align_stream.map_stream(stream, contigs, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return align_stream.streamed_rows(spark, f"{path}/out")


@_query(_DOCUMENT_MAP + "SELECT * FROM sam")
def align_reads(spark, sf_dir):
    contigs, reads = document_genome(spark, sf_dir)
    return align.align(reads, contigs)


QUERIES["align"], ORACLE_SQL["align"] = QUERIES.pop("align_reads"), ORACLE_SQL.pop("align_reads")


@_query(_DOCUMENT_MAP + """, per AS (SELECT r.read_id, max(nh) AS nh FROM r LEFT JOIN hit USING (read_id) GROUP BY r.read_id)
SELECT count(*) AS total, count(nh) AS mapped, count(*) FILTER (nh = 1) AS uniq, count(*) FILTER (nh > 1) AS multi,
  cast(coalesce(sum(nh), 0) AS bigint) AS sam_rows, CASE WHEN count(*) > 0 THEN 100.0::DOUBLE * count(nh) / count(*) END AS mappability FROM per""")
def align_stats(spark, sf_dir):
    contigs, reads = document_genome(spark, sf_dir)
    return align.statistics(align.hits(reads, contigs), reads)


@_query(_TEXT_SQL + "SELECT read_id, min(row) AS lo, max(row) + 1 AS hi FROM r JOIN sa ON left(suffix, 16) = translate(reverse(seq), 'ACGT', 'TGCA') WHERE NOT contains(seq, 'N') GROUP BY read_id")
def fm_backward_search(spark, sf_dir):
    return fm.backward_search(_reads(spark, sf_dir), _fm(spark, sf_dir))


_LOCATED = _TEXT_SQL + """, half AS (SELECT length(f) AS half FROM f)
SELECT read_id, CASE WHEN pos >= half THEN 0 ELSE 16 END AS flag, CASE WHEN pos >= half THEN 2 * half - pos - 16 ELSE pos END AS start
FROM half, r JOIN sa ON left(suffix, 16) = translate(reverse(seq), 'ACGT', 'TGCA') WHERE NOT contains(seq, 'N')"""


@_query(_LOCATED)
def fm_locate(spark, sf_dir):
    return fm.locate(_reads(spark, sf_dir), _fm(spark, sf_dir))


@_query(_LOCATED)
def fm_locate_trace(spark, sf_dir):
    return fm.locate_trace(_reads(spark, sf_dir), _fm(spark, sf_dir))


@_query("SELECT DISTINCT d.doc_id AS text_id, b.item_id FROM documents AS d JOIN benchmark AS b ON contains(d.text, b.text)")
def text_exact_search(spark, sf_dir):
    """The same seed join on another alphabet: whole passages in whole documents."""
    texts = scratch.spread(_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("text_id"), "text"))
    passages = _table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("passage"))
    return align.text_search(texts, passages).select("text_id", "item_id").distinct()
