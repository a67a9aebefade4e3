"""Sharding by vector bin packing.

Groups (equal texts) are put into shards so that bytes, tokens and rows are balanced jointly. An item is a vector of the
three, each as a share of the whole; items are placed largest first, each into the shard where the dot product with the
residual capacity is highest among those with room for it, or else among all.

A group that is more than 1 / (shards x fine) of the bytes or rows is an item of its own; of these there are fewer than
2 x shards x fine, whatever the input. Billions of smaller groups cannot be placed one by one: they are sorted into classes
of like vectors (bytes and tokens of the text, to a power of two), and an item is a slice of a class, by a hash of the text,
of an 8192nd of the whole at most, hash's unevenness aside. Only a group larger than a whole shard's share is split, over
pieces of a quarter of that share: no shard could hold it evenly. Every other group stays whole in one shard. Slots are
numbered within slices and within parts of large groups, from offsets that come with the plan.

Defined results: null texts count as empty (they are one group); null and repeated ids are rows like any other, and a large
group is split evenly whatever its ids; repeated rows get slots of their own; with fewer items than shards some shards are
empty; an empty table gives an empty one.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, save, words

#: Bytes that every row costs besides its text.
ROW_BYTES = 8
#: Parts of the whole that a slice holds one of.
SLICES = 8192


def place(items: np.ndarray, shards: int, weights: tuple[float, ...] = (1.0, 1.0, 1.0)) -> np.ndarray:
    """Shard of each item. items: [n, dimensions], not negative."""
    total = items.sum(axis=0)
    load = items / np.where(total > 0, total, 1)
    residual = np.full((shards, items.shape[1]), 1.0 / shards)
    w, out = np.asarray(weights[: items.shape[1]]), np.zeros(len(items), np.int64)
    for i in np.lexsort((np.arange(len(load)), -load.max(axis=1))):
        v = load[i]
        fits = (residual >= v - 1e-15).all(axis=1)
        score = residual @ (v * w)
        out[i] = k = int(np.argmax(np.where(fits, score, -np.inf) if fits.any() else residual[:, 0] * w[0]))
        residual[k] -= v
    return out


def shard(docs: DataFrame, shards: int = 24, fine: int = 256) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, shard, slot (gapless from 0 in each shard)."""
    spark = docs.sparkSession
    data = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = docs.select("doc_id", (F.length(data) + ROW_BYTES).cast("long").alias("size"), F.crc32(data).alias("text_crc32"), words(F.col("text")).alias("tokens"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), F.monotonically_increasing_id().alias("rid"))
    rows = save(rows, "rows")
    log2 = lambda c: F.length(F.bin(c))
    rows = rows.withColumn("class", F.concat_ws("/", F.lit("c"), log2("size"), log2("tokens")))
    # a row for each pair of powers of two: some hundreds
    classes = rows.groupBy("class").agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("n")).collect()
    total = {c: max(1, sum(r[c] for r in classes)) for c in ("size", "tokens", "n")}
    own = rows.groupBy(F.col("h").alias("big")).agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    share = F.greatest(F.col("size") / total["size"], F.col("n") / total["n"]) * shards
    pieces = F.when(share > 1, F.ceil(share * 4)).otherwise(1).cast("long")
    parts = F.ceil(F.col("n") / pieces * SLICES / max(SLICES * 512, total["n"])).cast("long")
    # fewer than 2 x shards x fine rows: each has more than that part of the bytes or the rows
    big = save(own.where(share > 1 / fine).select("big", pieces.alias("pieces"), parts.alias("parts")), "large")
    cut = [(r["class"], max(1, math.ceil(SLICES * max(r[c] / total[c] for c in total)))) for r in classes]
    rows = rows.join(bounded(big, 2 * shards * fine), rows["h"] == big["big"], "left").join(F.broadcast(spark.createDataFrame(cut, "class string, slices long")), "class")
    salt = F.xxhash64("rid")  # not of the id: ids may be null or repeated
    piece = F.concat_ws("/", F.lit("g"), "big", F.pmod(salt, F.col("pieces")), F.pmod(F.shiftrightunsigned(salt, 20), F.col("parts")))
    rows = rows.withColumn("cell", F.when(F.col("big").isNull(), F.concat_ws("/", "class", F.pmod("h", "slices"))).otherwise(piece))
    # some 60,000 cells at most, whatever the input: slices, large groups, their pieces and parts
    found = sorted(rows.groupBy("cell").agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("n")).collect())
    item = [r["cell"] if r["cell"][0] == "c" else r["cell"].rpartition("/")[0] for r in found]
    names = sorted(set(item))
    index = {x: i for i, x in enumerate(names)}
    vectors = np.zeros((len(names), 3))
    for r, x in zip(found, item):
        vectors[index[x]] += (r["size"], r["tokens"], r["n"])
    of, start, at = place(vectors, shards).tolist(), [0] * shards, []
    for r, x in zip(found, item):
        k = of[index[x]]
        at.append((r["cell"], k, start[k]))
        start[k] += r["n"]
    at = spark.createDataFrame(at, "cell string, shard int, start long")
    slot = F.row_number().over(Window.partitionBy("cell").orderBy("doc_id", "h", "rid")) - 1
    numbered = rows.select("doc_id", "size", "text_crc32", "cell", slot.cast("long").alias("i"))
    return numbered.join(bounded(at, len(found)), "cell").select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("i")).alias("slot"))
