"""Helpers that the operators of this package share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from ringseq.deploy import drop, drop_at_end, new_dir, save, ship

__all__ = ["WORD", "bounded", "copy_numbers", "crc32_of_id", "drop", "drop_at_end", "mapped", "new_dir", "row_hash", "save", "ship", "slices", "table", "values", "with_numbers", "words"]

#: White space that separates words: space and the bytes 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows up to which a table of short rows is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a folder. One that is read in fewer parts than there are cores, as one small file is, is dealt out to all cores: what follows is work."""
    df, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def words(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def crc32_of_id(doc_id: Column) -> Column:
    """crc32 of an id written as text."""
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8"))


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """A side of a join, of so many short rows: broadcast if there are few, else left to a shuffle."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def slices(batch: pa.RecordBatch, column: int, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about `limit` bytes of a string or binary column, one row at least: Python objects are made of no more at once."""
    values, at = batch.column(column), 0
    sums = pc.cumulative_sum(pc.fill_null(pc.binary_length(values), 0).cast(pa.int64())).to_numpy(zero_copy_only=False)
    while at < batch.num_rows:
        base = int(sums[at - 1]) if at else 0
        end = max(at + 1, int(sums.searchsorted(base + limit, side="right")))
        yield batch.slice(at, end - at)
        at = end


def values(column: pa.Array, rows: int = 256) -> Iterator:
    """A column's values, of a few rows at a time as Python objects."""
    for i in range(0, len(column), rows):
        yield from column[i : i + rows].to_pylist()


def _has_map(t: DataType) -> bool:
    if isinstance(t, StructType):
        return any(_has_map(f.dataType) for f in t)
    return isinstance(t, MapType) or isinstance(t, ArrayType) and _has_map(t.elementType)


def row_hash(df: DataFrame, *names: str) -> Column:
    """A hash of a row's columns; maps, which can't be hashed, count as JSON."""
    return F.xxhash64(*(F.to_json(F.struct(F.col(f"`{n}`"))) if _has_map(df.schema[n].dataType) else F.col(f"`{n}`") for n in names))


def copy_numbers(rows: DataFrame, over: int = 64) -> tuple[DataFrame, int] | None:
    """Numbers for rows that come very often: (rid, no), no from 0 among the rows of an equal k, and the table's size.

    rows: saved, with rid (unique), pid (the task that wrote it) and k, a hash that equal rows share. Only rows of a k with
    more than `over` rows get a number; None if there are no such rows. A set of equal rows gets the same set of numbers
    whatever the tasks, so a hash of k and no is the same on reruns, and no task holds all rows of a k: they are numbered
    within (k, pid), from offsets by k.
    """
    often = save(rows.groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") > over).select("k"), "often")
    n = often.count()
    if not n:
        drop(often)
        return None
    own = save(rows.select("rid", "pid", "k").join(bounded(often, n), "k", "left_semi"), "repeated")
    counts = own.groupBy("k", "pid").agg(F.count("*").alias("n"))
    before = Window.partitionBy("k").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = save(counts.select("k", "pid", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")), "offsets")
    place = F.row_number().over(Window.partitionBy("k", "pid").orderBy("rid")) - 1
    numbers = own.withColumn("i", place).join(offsets, ["k", "pid"]).select("rid", (F.col("offset") + F.col("i")).cast("long").alias("no"))
    numbers = save(numbers, "numbers")
    drop(often, own, offsets)
    return numbers, numbers.count()


def with_numbers(rows: DataFrame, numbers: tuple[DataFrame, int] | None) -> DataFrame:
    """rows with the column no: from copy_numbers(), 0 for all others."""
    if numbers is None:
        return rows.withColumn("no", F.lit(0).cast("long"))
    return rows.join(bounded(*numbers), "rid", "left").withColumn("no", F.coalesce("no", F.lit(0)).cast("long"))


def mapped(df: DataFrame, column: str, to: str, kind: str, f: Callable[[list], list], keep: bool = True) -> DataFrame:
    """df with the column `to` of the type `kind`: f, in Python workers, of a list of values of a string or binary column.

    Values go in and out in parts of a few MB, so a worker holds that, or one long value and what f makes of it. keep: the
    column itself stays.
    """
    ship(df.sparkSession)
    df = df.select(*(F.col(f"`{c}`") for c in df.columns if c != to or c == column))
    names = [c for c in df.columns if c != to and (keep or c != column)]
    made = StructType.fromDDL(f"x {kind}")["x"].dataType
    schema = StructType([df.schema[c] for c in names]).add(to, made)
    at, arrow = df.columns.index(column), to_arrow_type(made)

    def g(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at):
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(f(part.column(at).to_pylist()), arrow)], [*names, to])

    return df.mapInArrow(g, schema)
