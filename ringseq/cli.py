"""A command line over the operators: python -m ringseq.cli COMMAND [INPUT] [-o OUTPUT] ..."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from ringseq.operators import ops
from ringseq.sources import fasta


#: Levels of logging, from that without -v on.
LEVELS = ("ERROR", "WARN", "INFO", "DEBUG")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="ringseq", description="Circular nucleotide sequences: FASTA in, FASTA out.")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, help: str) -> argparse.ArgumentParser:
        p = commands.add_parser(name, help=help)
        p.add_argument("input", nargs="?", help="FASTA file, plain or gz, bz2, xz, zst [standard input]")
        p.add_argument("-o", "--output", help="file; its suffix chooses the compression [standard output]")
        p.add_argument("-t", "--threads", type=int, help="cores of a local Spark [all]; an active session keeps its own")
        p.add_argument("--master", help="Spark master, instead of a local one")
        p.add_argument("-v", "--verbose", action="count", default=0, help="log more: warnings, information, all; may be repeated")
        p.add_argument("-q", "--quiet", action="store_true", help="log nothing")
        return p

    command("cat", "each sequence twice in a row")
    command("decat", "the first half of each sequence")
    command("canonicalize", "least rotation of both polarities")
    p = command("rotate", "move the origin")
    group = p.add_mutually_exclusive_group(required=True)
    group.add_argument("-b", "--bases", type=int)
    group.add_argument("-p", "--percent", type=float)
    p = command("uniq", "one record of each circular sequence")
    p.add_argument("-c", "--canonicalize", "--norm", "--normalize", "--canon", dest="canonicalize", action="store_true")
    p.add_argument("--table")
    p = command("monomerize", "trim multimers to a monomer")
    p.add_argument("--sensitive", action="store_true")
    p.add_argument("--seed-length", type=int, default=10)
    group = p.add_mutually_exclusive_group()
    group.add_argument("--max-mismatch", type=int)
    group.add_argument("--min-identity", type=float)
    p.add_argument("--min-overlap", type=int)
    p.add_argument("--min-overlap-percent", type=float)
    p.add_argument("--min-length", type=int, default=0)
    p.add_argument("--max-length", type=int)
    p.add_argument("-k", "--keep-all", action="store_true")
    p.add_argument("--table")
    p = command("orfs", "open reading frames on the circle")
    p.add_argument("-m", "--min-length", type=int, default=75)
    p.add_argument("--start-codons", default="ATG")
    p.add_argument("--stop-codons", default="TAA,TAG,TGA")
    p.add_argument("--include-stop", action="store_true")
    p.add_argument("--no-stop-required", action="store_true")
    p.add_argument("--min-wraps", type=int, default=0)
    p.add_argument("--max-wraps", type=int, default=3)
    p.add_argument("--strand", choices=("forward", "reverse", "both"), default="both")
    p.add_argument("--reference-compat", action="store_true", help="with --strand reverse, search the forward strand too")
    p.add_argument("--min-ratio", type=float, default=0.0)
    p.add_argument("--table")
    return top


def main(argv: list[str] | None = None) -> int:
    a = vars(parser().parse_args(argv))
    name, source, output, master, table = a.pop("command"), a.pop("input"), a.pop("output"), a.pop("master"), a.pop("table", None)
    threads, verbose, quiet = a.pop("threads"), a.pop("verbose"), a.pop("quiet")
    if name == "monomerize" and not 5 <= a["seed_length"] <= 63:
        print("ringseq: --seed-length must be from 5 to 63", file=sys.stderr)
        return 2
    if threads is not None and threads < 1:
        print("ringseq: --threads must be 1 or more", file=sys.stderr)
        return 2
    level = "OFF" if quiet else LEVELS[min(verbose, len(LEVELS) - 1)]
    spark = SparkSession.getActiveSession() or SparkSession.builder.master(master or f"local[{threads or '*'}]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", str(verbose > 1).lower()).config("spark.log.level", level).getOrCreate()
    try:
        df = fasta.read_fasta(spark, source) if source else fasta.read_stdin(spark)
        if name == "uniq" and table:
            made, listed = ops.uniq_and_table(df, **a)
        else:
            made, listed = getattr(ops, name)(df, **a), None
        if name == "uniq" and not a["canonicalize"]:
            made = made.withColumn("seq", made["raw_seq"])
        if {"file", "ord"} <= set(made.columns):
            made = made.orderBy("file", "ord")
        fasta.write_fasta(made, output)
        if table:
            fasta.write_table(listed if listed is not None else getattr(ops, f"{name}_table")(df, **a), table)
    except (OSError, ValueError) as e:
        print(f"ringseq: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
