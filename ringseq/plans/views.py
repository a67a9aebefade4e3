"""Sequence views over the driver's tables, alike in Spark and in SQL.

No table holds nucleotides, so they are derived: from texts the letters of nucleotides, whole; from keys by hashes.
Each view has ord, head (an id, a blank and a remark) and seq.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_HEX, _BASES = "0123456789abcdef", "ACGTACGTACGTACGT"


def _hashed(key: Column, blocks: Column) -> Column:
    """32 bases a block."""
    return F.translate(F.array_join(F.transform(F.sequence(F.lit(1), blocks), lambda j: F.md5(F.concat_ws("-", key.cast("string"), j.cast("string")))), ""), _HEX, _BASES)


def _sql_hashed(key: str, blocks: str) -> str:
    return f"translate(array_to_string(list_transform(range(1, 1 + {blocks}), lambda j: md5(({key}) || '-' || j)), ''), '{_HEX}', '{_BASES}')"


def _spread(df: DataFrame) -> DataFrame:
    """Rows in as many partitions as there are cores: a small file is one task otherwise, and what follows is work."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text"))
    return d.select(F.col("doc_id").alias("ord"), F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(" "), "lang").alias("head"), F.regexp_replace("text", "[^ACGTUNacgtun]", "").alias("seq"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey").cast("long")
    d = spark.read.parquet(f"{sf_dir}/orders.parquet").select(k.alias("k"))
    d = _spread(d)
    return d.select(F.col("k").alias("ord"), F.concat(F.lit("o"), F.col("k").cast("string"), F.lit(" order")).alias("head"), _hashed(F.col("k"), (4 + F.col("k") % 7).cast("int")).alias("seq"))


def multimers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A monomer of 20 to 60 bases once to three times, with a part of it at the end, and every fifth with a mutation."""
    d = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("int").alias("k"))
    d = _spread(d)
    mono = F.substring(_hashed(F.col("k"), F.lit(2)), F.lit(1), 20 + F.col("k") % 41)
    whole = F.concat(F.expr("repeat(m, 1 + k % 3)"), F.expr("substring(m, 1, k % 17)"))
    changed = F.concat(F.substring("w", 1, 2), F.translate(F.substring("w", 3, 1), "ACGT", "CGTA"), F.expr("substring(w, 4)"))
    d = d.withColumn("m", mono).withColumn("w", whole)
    return d.select(F.col("k").cast("long").alias("ord"), F.concat(F.lit("p"), F.col("k").cast("string"), F.lit(" part")).alias("head"), F.when(F.col("k") % 5 == 0, changed).otherwise(F.col("w")).alias("seq"))


def rotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three customers share a circle: turned, of either polarity, some as lower-case RNA."""
    d = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").cast("long").alias("k"))
    d = _spread(d)
    d = d.withColumn("b", _hashed((F.col("k") / 3).cast("long"), F.lit(1))).withColumn("r", (F.col("k") * 7 % 32).cast("int"))
    d = d.withColumn("t", F.concat(F.expr("substring(b, r + 1)"), F.expr("substring(b, 1, r)")))
    d = d.withColumn("t", F.when(F.col("k") % 2 == 1, F.translate(F.reverse("t"), "ACGT", "TGCA")).otherwise(F.col("t")))
    seq = F.when(F.col("k") % 4 == 0, F.translate("t", "ACGT", "acgu")).otherwise(F.col("t"))
    return d.select(F.col("k").alias("ord"), F.concat(F.lit("c"), F.col("k").cast("string"), F.lit(" customer")).alias("head"), seq.alias("seq"))


VIEWS = {"documents": documents, "orders": orders, "multimers": multimers, "rotated": rotated}

SQL = {
    "documents": "SELECT doc_id AS ord, 'd' || doc_id || ' ' || lang AS head, regexp_replace(text, '[^ACGTUNacgtun]', '', 'g') AS seq FROM documents",
    "orders": f"SELECT k AS ord, 'o' || k || ' order' AS head, {_sql_hashed('k', '4 + k % 7')} AS seq FROM (SELECT CAST(o_orderkey AS BIGINT) AS k FROM orders)",
    "multimers": f"""SELECT CAST(k AS BIGINT) AS ord, 'p' || k || ' part' AS head, CASE WHEN k % 5 = 0 THEN substr(w, 1, 2) || translate(substr(w, 3, 1), 'ACGT', 'CGTA') || substr(w, 4) ELSE w END AS seq
  FROM (SELECT k, repeat(m, CAST(1 + k % 3 AS BIGINT)) || substr(m, 1, k % 17) AS w FROM (SELECT k, substr({_sql_hashed('k', '2')}, 1, 20 + k % 41) AS m FROM (SELECT CAST(p_partkey AS INTEGER) AS k FROM part)))""",
    "rotated": f"""SELECT k AS ord, 'c' || k || ' customer' AS head, CASE WHEN k % 4 = 0 THEN translate(t, 'ACGT', 'acgu') ELSE t END AS seq
  FROM (SELECT k, CASE WHEN k % 2 = 1 THEN translate(reverse(t), 'ACGT', 'TGCA') ELSE t END AS t
    FROM (SELECT k, substr(b, r + 1) || substr(b, 1, r) AS t FROM (SELECT k, {_sql_hashed('k // 3', '1')} AS b, CAST(k * 7 % 32 AS INTEGER) AS r FROM (SELECT CAST(c_custkey AS BIGINT) AS k FROM customer))))""",
}
