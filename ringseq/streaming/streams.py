"""FASTA as a stream, and operators on streams.

The operators that work within a row (all but uniq) take a streaming DataFrame as they take any other. uniq_stream keeps
the first record that arrives of each circular sequence; its state, the canonical forms' keys, grows with the distinct
sequences.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ringseq.deploy import ship
from ringseq.functions import exprs, udfs
from ringseq.sources import fasta


def read_fasta_stream(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    """file, ord, head, id, raw_seq, seq of the FASTA files that come to a folder, plain or compressed, told by content.

    Spark follows the names that arrive; tasks open the files.
    """
    ship(spark)
    reader = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)

    def read(names: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in names:
            for path, size in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                yield from fasta.read_range(fasta.Range(path, 0, size))

    rows = reader.load(folder).select("path", "length").where("length > 0").mapInArrow(read, fasta.SCHEMA)
    return rows.select("file", "ord", "head", exprs.fasta_id(F.col("head")).alias("id"), "raw_seq", "seq")


def uniq_stream(df: DataFrame, canonicalize: bool = False) -> DataFrame:
    ship(df.sparkSession)
    keyed = df.withColumn("canonical_form", udfs.canonical(exprs.normalize_dna(F.col("seq")))).dropDuplicates(["canonical_form"])
    return keyed.withColumn("seq", F.col("canonical_form")).select(*df.columns) if canonicalize else keyed.select(*df.columns)


def write_stream(df: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """All that is there now as FASTA text files, exactly once; ends by itself."""
    records = df.select(exprs.fasta_record(F.col("head"), F.col("seq")).alias("value"))
    return records.writeStream.format("text").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(folder)
