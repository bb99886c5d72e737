"""Command line: ``python -m basewright build | map``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from basewright.operators import align, genome, index
from basewright.sources import sequence_files as files


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="basewright")
    verbs = parser.add_subparsers(dest="verb", required=True)
    build = verbs.add_parser("build", help="index a FASTA file")
    build.add_argument("-i", "--input", required=True)
    build.add_argument("-p", "--prefix", required=True)
    build.add_argument("-l", "--depth", type=int, default=index.DEPTH, help="characters that the suffix sort looks at")
    build.add_argument("-s", "--interval", type=int, default=index.INTERVAL, help="rows between checkpoints")
    build.add_argument("-f", "--force", action="store_true", help="overwrite an index")
    build.add_argument("--fm", action="store_true", help="write the FM tables too (small genomes)")
    build.add_argument("-n", "--threads", type=int, default=1)
    mapping = verbs.add_parser("map", help="map FASTQ reads")
    mapping.add_argument("-i", "--input", required=True)
    mapping.add_argument("-p", "--prefix", required=True)
    mapping.add_argument("-o", "--output", default="stdout", help="folder of SAM text, or stdout or -")
    mapping.add_argument("-n", "--threads", type=int, default=1)
    mapping.add_argument("-m", "--max-hits", type=int, default=align.MAX_HITS, help="raw hits up to which a read is reported")
    mapping.add_argument("-s", "--strand", type=int, default=align.BOTH_STRANDS, help="0 forward, 1 reverse, 2 both")
    mapping.add_argument("--standard", action="store_true", help="SAM header, NH tag and no last tab")
    return parser


def _session(threads: int) -> SparkSession:
    """The cluster's session where one is configured, else a local one of so many threads."""
    builder = SparkSession.builder.appName("basewright")
    if not SparkSession.getActiveSession() and "spark.master" not in dict(builder._options):
        import os

        if "MASTER" not in os.environ and "PYSPARK_SUBMIT_ARGS" not in os.environ:
            builder = builder.master(f"local[{max(1, min(threads, os.cpu_count() or 1))}]")
    return builder.getOrCreate()


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0: done, 1: bad input, 2: the index exists (build) or is not complete (map)."""
    o = _parser().parse_args(args)
    spark = spark or _session(o.threads)
    try:
        if o.verb == "build":
            contigs = genome.contigs_of(files.read_fasta(spark, o.input))
            twice = genome.duplicate_names(contigs).limit(5).collect()
            if twice:
                print("contig names repeat: " + ", ".join(r["name"] for r in twice), file=sys.stderr)
                return 1
            index.build_index(contigs, o.prefix, depth=o.depth, interval=o.interval, force=o.force, fm=o.fm)
            return 0
        tables = index.load_index(spark, o.prefix)
        reads = files.read_fastq(spark, o.input)
        found = align.hits(reads, tables["blocks"], o.max_hits, o.strand).persist()
        lines = files.sam_lines(align.sam_rows(found, reads), o.standard)
        if o.standard:
            lines = files.sam_header(tables["chr_len"]).union(lines)
        if o.output in ("stdout", "-"):
            for row in lines.toLocalIterator():
                print(row["value"])
        else:
            lines.write.mode("overwrite").text(o.output)
        s = align.statistics(found, reads).first()
        share = "-" if s["mappability"] is None else f"{s['mappability']:.4g}"
        print(f"reads {s['total']}, unique {s['uniq']}, multiple {s['multi']}, mapped {share} %, rows {s['sam_rows']}", file=sys.stderr)
        found.unpersist()
        return 0
    except index.IndexExists as e:
        print(f"the index exists: {e}; -f overwrites it", file=sys.stderr)
        return 2
    except index.IndexIncomplete as e:
        print(f"no complete index: {e}", file=sys.stderr)
        return 2
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            print(f"cannot read {o.input}", file=sys.stderr)
            return 1
        raise


if __name__ == "__main__":
    sys.exit(main())
