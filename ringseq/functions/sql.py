"""The library's functions by name in SQL."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from ringseq.deploy import ship

from . import exprs, kernels, udfs

#: Native functions as SQL expressions.
SQL_FUNCTIONS = {
    "normalize_dna": (
        "seq STRING",
        f"regexp_replace(translate(regexp_replace(seq, '[ \\\\t\\\\r\\\\n]', ''), '{exprs.NORMAL_FROM}', '{exprs.NORMAL_TO}'), '[^ACGTN-]', 'N')",
    ),
    "revcomp": ("seq STRING", f"translate(reverse(seq), '{exprs.COMPLEMENT_FROM}', '{exprs.COMPLEMENT_TO}')"),
    "cat_seq": ("seq STRING", "concat(seq, seq)"),
    "decat_seq": ("seq STRING", "substring(seq, 1, CAST(length(seq) / 2 AS INT))"),
    "rotate_bases": ("seq STRING, n BIGINT", "CASE WHEN length(seq) = 0 THEN seq ELSE substring(concat(seq, seq), CAST(pmod(-n, length(seq)) AS INT) + 1, length(seq)) END"),
    "rotate_percent": ("seq STRING, share DOUBLE", "CASE WHEN length(seq) = 0 THEN seq ELSE substring(concat(seq, seq), CAST(pmod(-floor(length(seq) * share), length(seq)) AS INT) + 1, length(seq)) END"),
    "orf_seq": ("seq STRING, start INT, size INT", "substring(repeat(seq, CAST(ceil((start + size) / greatest(length(seq), 1)) AS INT)), start + 1, size)"),
    "fasta_id": ("head STRING", "substring_index(head, ' ', 1)"),
}


@F.arrow_udf(IntegerType())
def _monomer_end(seq: pa.Array, seed_length: pa.Array, max_mismatch: pa.Array) -> pa.Array:
    rows = zip(seq.cast(pa.binary()).to_pylist(), seed_length.to_pylist(), max_mismatch.to_pylist())
    return pa.array([None if s is None else kernels.Monomerizer(k, d).end(s) for s, k, d in rows], pa.int32())


def register(spark: SparkSession) -> None:
    """normalize_dna, revcomp, cat_seq, decat_seq, rotate_bases, rotate_percent, orf_seq(seq, start, length) and fasta_id; lmsr, lmsr_index and canonicalize_dna;
    monomer_end(seq, seed_length, max_mismatch); find_orfs(seq) and longest_orfs(seq), arrays of structs for inline()."""
    ship(spark)
    for name, (args, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS STRING RETURN {body}")
    starts, stops = ("ATG",), ("TAA", "TAG", "TGA")
    for name, f in {
        "lmsr": udfs.lmsr,
        "lmsr_index": udfs.lmsr_index,
        "canonicalize_dna": udfs.canonical,
        "monomer_end": _monomer_end,
        "find_orfs": udfs.reading_frames(starts, stops),
        "longest_orfs": udfs.reading_frames(starts, stops, longest=True),
    }.items():
        spark.udf.register(name, f)
