"""Mixing sources to target weights by Pareto order sampling.

Sources share a total of words by weight; no source gets more than max_repeats times its own words, and what is above is
shared again by weight. Within a source, a document is due copies in proportion to 2 ** (tilt x class), where its class is the
whole part of log2 of its words, and max_repeats at most: so longer documents come somewhat more often, and the words that
are due add up to the target. The whole part of a document's copies is allocated with certainty; the rest is its inclusion
probability p, unequal within a source. Documents are ranked by Pareto's variable, the odds of a random number divided by
the odds of p, and taken in that order until the words still due are met; one that no longer fits is passed over for the next
that does, to the source's last. So each source's sample has a fixed size, counted in words: what it is short of is less
than any document it leaves.

A rank becomes a place, a whole number below 2 ** 48 that grows with it. Sums over equal cells of places, aggregated before
the shuffle, find the cell where a source's words are met; a cell of too many rows is cut again, until few rows (`zone` and
what shares their cells) have to be put in order. Then the places that follow are summed without the documents that are
longer than what is due, and so on until no later document fits. Only row numbers, words and ranks are shuffled, never texts.

Defined results: null texts have size 0 and are never taken; a null source is a source of its own, last in order; null ids
are ids like any other; random numbers come from a hash of doc_id, size and text, so reruns agree; rows that come very often
are numbered, each with a random number of its own, rarer repeated rows share one; an empty table gives an empty one.
"""

from __future__ import annotations

import math
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, copy_numbers, save, ship, with_numbers, words

#: Places of ranks: whole numbers below this.
PLACES = 1 << 48


def targets(sizes: dict, weights: list[float], total: float | None = None, max_repeats: float = 3.0) -> dict:
    """Words due to each source. sizes: words by source, None for null; weights repeat over the sources by code point, null last."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-8", "surrogatepass")) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left = float(sum(sizes.values()) if total is None else total)
    due, free = {}, set(order)
    while free:
        by = sum(weight[s] for s in free)
        full = {s for s in free if left * weight[s] / by > max_repeats * sizes[s]} if by else set()
        if not full:
            due |= {s: left * weight[s] / by if by else 0.0 for s in free}
            break
        due |= {s: max_repeats * sizes[s] for s in full}
        left -= sum(due[s] for s in full)
        free -= full
    return due


def copies_due(classes: dict[int, int], due: float, max_repeats: float, tilt: float) -> dict[int, float]:
    """Copies due to a document of each class, in proportion to 2 ** (tilt x class), max_repeats at most. classes: words by class."""
    out: dict[int, float] = {}
    left = due
    for c in sorted(classes, reverse=True):  # the class whose copies come to the limit first
        by = sum(2.0 ** (tilt * k) * classes[k] for k in classes if k not in out)
        if left * 2.0 ** (tilt * c) / by < max_repeats:
            return out | {k: max(0.0, left * 2.0 ** (tilt * k) / by) for k in classes if k not in out}
        out[c] = max_repeats
        left -= max_repeats * classes[c]
    return out


def _uniform(seed: int, *cols: Column) -> Column:
    """In (0, 1), from a hash."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11).cast("double") + 0.5) / float(1 << 53)


def _fits(zone: pd.DataFrame) -> pd.DataFrame:
    """Of rows in order of rank: those taken, as their words still fit in `left`."""
    zone = zone.sort_values(["rank", "k", "no", "size"], kind="stable")
    left, hit = float(zone["left"].iloc[0]), []
    for n in zone["size"].tolist():
        hit.append(n <= left)
        left -= n if hit[-1] else 0
    return zone.loc[hit, ["rid", "of", "size"]]


def ranked(docs: DataFrame, weights: list[float], max_repeats: float = 3.0, total: float | None = None, seed: int = 2, carry: list[str] | None = None, tilt: float = 0.125) -> tuple[DataFrame, dict]:
    """Rows with doc_id, source, size, source_size, target, whole, p, rank (null if p is 0), place; and the words each source's sample is due."""
    spark = docs.sparkSession
    ship(spark)
    size = words(F.col("text"))
    own = [F.col(f"`{c}`").alias(f"carried_{c}") for c in carry or []]
    rows = docs.select("doc_id", "source", size.alias("size"), F.xxhash64("doc_id", size, "text").alias("k"), F.monotonically_increasing_id().alias("rid"), F.spark_partition_id().alias("pid"), *own)
    rows = save(rows, "sizes")
    rows = with_numbers(rows, copy_numbers(rows)).withColumn("class", F.length(F.bin("size")) - 1)
    # a row for each source and class of size: a mix names its sources, and there are 63 classes at most
    sums: dict = {}
    for r in rows.groupBy("source", "class").agg(F.sum("size").alias("size"), F.count("*").alias("n")).toLocalIterator():
        sums.setdefault(r["source"], {})[r["class"]] = (int(r["size"]), r["n"])
    sizes = {s: sum(n for n, _ in by.values()) for s, by in sums.items()}
    due, plan, sampled = targets(sizes, weights, total, max_repeats), [], {}
    for s, by in sums.items():
        e = copies_due({c: n for c, (n, _) in by.items() if n}, due[s], max_repeats, tilt)
        part = {c: x - math.floor(x) for c, x in e.items()}
        sampled[s] = sum(part[c] * by[c][0] for c in e)
        mean = sum(part[c] * by[c][1] for c in e) / max(1, sum(by[c][1] for c in e if part[c]))
        plan += [(s, c, sizes[s], float(due[s]), math.floor(e.get(c, 0.0)), part.get(c, 0.0), mean / (1 - mean) if 0 < mean < 1 else 1.0) for c in by]
    at = spark.createDataFrame(plan, "of string, of_class int, source_size long, target double, whole long, p double, middle double")
    rows = rows.join(bounded(at, len(plan)), F.col("source").eqNullSafe(F.col("of")) & (F.col("class") == F.col("of_class"))).drop("of", "of_class")
    u = _uniform(seed, F.col("k"), F.col("no"))
    rows = rows.withColumn("rank", F.when((F.col("p") > 0) & (F.col("size") > 0), (u / (1 - u)) / (F.col("p") / (1 - F.col("p")))))
    # about even over a source's documents: a rank at the odds of its mean probability is half way
    x = F.col("rank") * F.col("middle")
    rows = rows.withColumn("place", F.least(F.lit(PLACES - 1), F.floor(x / (1 + x) * PLACES)).cast("long"))
    return rows, sampled


def _select(rows: DataFrame, due: dict, grid: int, zone: int) -> tuple[DataFrame, int, DataFrame, int]:
    """Which rows a sample takes: spans (of, first place, end, fits), in which all documents that fit are taken, and row numbers besides."""
    spark = rows.sparkSession
    slim = rows.select("source", "size", "rank", "place", "rid", "k", "no").where("rank is not null")
    spans, hits = [], []
    state = [(s, 0, PLACES, float(left)) for s, left in due.items() if left >= 1]
    while state:
        at = bounded(spark.createDataFrame(state, "of string, lo long, hi long, fits double"), len(state))
        fit = slim.join(at, F.col("source").eqNullSafe(F.col("of"))).where("place >= lo and place < hi and size <= fits")
        sums = fit.groupBy("of", "lo", "hi", "fits", F.expr(f"(place - lo) div ceil((hi - lo) / {grid})").alias("cell")).agg(F.sum("size").alias("words"), F.count("*").alias("n"))
        upto = Window.partitionBy("of").orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        sums = sums.select("*", (F.sum("words").over(upto) - F.col("words")).alias("before"), (F.sum("n").over(upto) - F.col("n")).alias("n_before"))
        met = F.when(F.col("before") + F.col("words") > F.col("fits"), F.struct("cell", "before", "n_before", "n"))
        sums = sums.select("*", F.min(met).over(Window.partitionBy("of")).alias("met"))
        # the zone: the cell where the words are met, and those after it while they have few rows
        last = F.max(F.when(F.col("n_before") + F.col("n") <= F.col("met.n_before") + zone, F.col("cell")))
        found = sums.groupBy("of", "lo", "hi", "fits").agg(F.min("met").alias("met"), last.alias("last"), F.sum("words").alias("words")).collect()  # a row for each source at most
        # where nothing fits, go on after it
        there = {r["of"] for r in found}
        state, zones = [(of, hi, PLACES, fits) for of, _, hi, fits in state if of not in there and hi < PLACES], []
        for r in found:
            of, lo, hi, fits, m = r["of"], r["lo"], r["hi"], r["fits"], r["met"]
            if m is None:  # all that fit are taken
                spans.append((of, lo, hi, fits))
                if hi < PLACES and fits - r["words"] >= 1:
                    state.append((of, hi, PLACES, fits - r["words"]))
                continue
            width, left = -(-(hi - lo) // grid), fits - m["before"]
            edge = lo + m["cell"] * width
            spans.append((of, lo, edge, fits))
            if m["n"] > zone and width > 1:
                state.append((of, edge, min(hi, edge + width), left))
            else:
                zones.append((of, edge, min(hi, lo + (max(m["cell"], r["last"] or 0) + 1) * width), left))
        if zones:
            at = bounded(spark.createDataFrame(zones, "of string, lo long, hi long, left double"), len(zones))
            inside = slim.join(at, F.col("source").eqNullSafe(F.col("of"))).where("place >= lo and place < hi and size <= left")
            got = inside.select("of", "lo", "left", "rid", "rank", "k", "no", "size").groupBy("of", "lo").applyInPandas(_fits, "rid long, of string, size long")
            hits.append(save(got, "hits"))
            took = {r["of"]: r["size"] for r in hits[-1].groupBy("of").agg(F.sum("size").alias("size")).collect()}
            state += [(of, hi, PLACES, left - took.get(of, 0)) for of, _, hi, left in zones if hi < PLACES and left - took.get(of, 0) >= 1]
    every = reduce(DataFrame.unionByName, hits).select("rid") if hits else spark.createDataFrame([], "rid long")
    return spark.createDataFrame(spans, "of string, lo long, hi long, fits double"), len(spans), every, every.count()


def mix(docs: DataFrame, weights: list[float], max_repeats: float = 3.0, total: float | None = None, seed: int = 2, carry: list[str] | None = None, tilt: float = 0.125, grid: int = 4096, zone: int = 4096) -> DataFrame:
    """One row per document: doc_id, size, source, source_size, target, copies, taken = copies x size; and the columns to carry.

    grid, zone: cells summed at once and rows put in order at once; the result doesn't depend on them.
    """
    rows, due = ranked(docs, weights, max_repeats, total, seed, carry, tilt)
    spans, n_spans, hits, n_hits = _select(rows, due, grid, zone)
    # one span at most holds a row
    inside = F.col("source").eqNullSafe(F.col("of")) & (F.col("place") >= F.col("lo")) & (F.col("place") < F.col("hi")) & (F.col("size") <= F.col("fits"))
    rows = rows.join(bounded(spans, n_spans), inside, "left").withColumn("within", F.col("lo").isNotNull()).drop("of", "lo", "hi", "fits")
    rows = rows.join(bounded(hits.withColumn("hit", F.lit(True)), n_hits), "rid", "left")
    sampled = (F.col("within") | F.coalesce("hit", F.lit(False))).cast("long")
    copies = F.when(F.col("size") > 0, F.col("whole") + sampled).otherwise(0).cast("long")
    return rows.select("doc_id", "size", "source", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), *(F.col(f"`carried_{c}`").alias(c) for c in carry or []))
