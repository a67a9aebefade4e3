"""Similarity join of embeddings by epsilon grid order.

Unit vectors of cosine >= t are at a distance of at most eps = sqrt(2 - 2 t). Vectors are projected on leading principal
dimensions, as many as hold 95% of the variance, `dims` at most; the length of what is left is one more coordinate, so
the projection of a unit vector is a unit vector, and projections are never further apart than their vectors. They are
sorted by the cells, eps wide, that the projections fall in: epsilon grid order. The order is cut into intervals of at most
`task_bytes` of components, and each interval into `SUBS` blocks. Pairs of intervals are joined in a task of their own where
the bounding boxes of some of their blocks are at most eps apart, and only such blocks are sent to it; all others can hold
no link. A task joins recursively: both sides are halved until they are small, and halves that are provably distant are
skipped. In the smallest, the cosine of the projections leaves candidates, and that of the vectors in double precision decides.

Equal vectors are one class, joined once. A pair of intervals gives, for each class, the number of vectors linked to it
(a sum, not the pairs) and as many links as connect what it has connected. So rows grow with the vectors.

Vectors of one length are joined after those of another. The basis is fitted on a bounded sample (`sample` vectors by hash,
64 MB of them); any orthonormal basis gives the same links, it only
prunes less. Boxes, a row for each block, come to the driver; pairs of intervals are found from them by executors.

Defined results: vectors that are null, zero, or hold null or non-finite components link with nothing, nor do vectors of
different lengths with each other; repeated rows are vectors of their own, linked to each other; a null id is never the least
of a component that has another; an empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, drop, save, ship
from .graph import components

LEAF = 256
#: Blocks of an interval that have a box each.
SUBS = 8
#: Components, in double precision, that come to the driver for the basis; of very long vectors 1000 all the same.
SAMPLE_BYTES = 64 << 20


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column of equal lengths, in double precision."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(a.flatten(), dtype=np.float64).reshape(len(a), -1)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows over their norms; scaled first, so very large and very small components neither overflow nor vanish."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def basis(x: np.ndarray, most: int, share: float = 0.95) -> np.ndarray:
    """[dimensions, k]: leading principal axes of the rows, until they hold a share of the variance; `most` at most."""
    c = x - x.mean(axis=0)
    values, axes = np.linalg.eigh(c.T @ c)
    sums = np.cumsum(np.maximum(values[::-1], 0))
    k = int(np.searchsorted(sums, share * sums[-1])) + 1
    return axes[:, ::-1][:, : min(k, most)]


def projected(x: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """[rows, k + 1]: coordinates on the axes, and the length of what they leave."""
    p = x @ axes
    return np.column_stack([p, np.sqrt(np.maximum(0, 1 - (p * p).sum(axis=1)))])


def gap2(lo_a: np.ndarray, hi_a: np.ndarray, lo_b: np.ndarray, hi_b: np.ndarray) -> np.ndarray:
    """Squared distance of boxes."""
    g = np.maximum(0, np.maximum(lo_a - hi_b, lo_b - hi_a))
    return (g * g).sum(axis=-1)


def order(p: np.ndarray, eps: float) -> np.ndarray:
    """Epsilon grid order of projections."""
    cell = np.floor(p / eps).astype(np.int64)
    return np.lexsort(cell.T[::-1])


class Side:
    """An interval in epsilon grid order, with projections and the boxes of its parts."""

    def __init__(self, x: np.ndarray, p: np.ndarray):
        self.x, self.p, self.q, self.box, self.compared = x, p, p.astype(np.float32), {}, 0

    def bounds(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        if (a, b) not in self.box:
            self.box[a, b] = (self.p[a:b].min(axis=0), self.p[a:b].max(axis=0))
        return self.box[a, b]


def join(left: Side, right: Side, same: bool, t: float, eps: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of a cosine of at least t; of one interval with itself, those with i < j."""
    limit, stack = eps * eps * (1 + 1e-9) + 1e-12, [(0, len(left.x), 0, len(right.x))]
    while stack:
        a, b, c, d = stack.pop()
        if a >= b or c >= d or same and d <= a or gap2(*left.bounds(a, b), *right.bounds(c, d)) > limit:
            continue
        if b - a <= LEAF and d - c <= LEAF:
            left.compared += (b - a) * (d - c)
            yield from _leaf(left, right, a, b, c, d, same, t, limit)
        elif b - a >= d - c:
            m = (a + b) // 2
            stack += [(a, m, c, d), (m, b, c, d)]
        else:
            m = (c + d) // 2
            stack += [(a, b, c, m), (a, b, m, d)]


def _leaf(left: Side, right: Side, a: int, b: int, c: int, d: int, same: bool, t: float, limit: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    near = left.q[a:b] @ right.q[c:d].T >= 1 - limit / 2 - 1e-5  # projections are unit vectors; in single precision
    if same:
        near &= np.arange(a, b)[:, None] < np.arange(c, d)[None, :]
    n = int(np.count_nonzero(near))
    if not n:
        return
    if n * 8 > near.size:
        i, j = np.nonzero(near & (left.x[a:b] @ right.x[c:d].T >= t))
    else:
        i, j = np.nonzero(near)
        ok = np.einsum("ij,ij->i", left.x[a + i], right.x[c + j]) >= t
        i, j = i[ok], j[ok]
    if len(i):
        yield i + a, j + c


def _forest(n: int, i: np.ndarray, j: np.ndarray, lab: np.ndarray) -> np.ndarray:
    """Labels of components, joined by the pairs."""
    while True:
        low = np.minimum(lab[i], lab[j])
        new = lab.copy()
        np.minimum.at(new, lab[i], low)
        np.minimum.at(new, lab[j], low)
        while (new[new] != new).any():
            new = new[new]
        new = new[lab]
        if (new == lab).all():
            return lab
        lab = new


def near_blocks(lo: np.ndarray, hi: np.ndarray, part: np.ndarray, i: int, limit: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each interval j >= i with a block near one of interval i's: j, and the near blocks of both. part: interval of each block, ascending."""
    a, b = np.searchsorted(part, [i, i + 1])
    rest = part[a:]
    near = np.stack([gap2(lo[k], hi[k], lo[a:], hi[a:]) <= limit for k in range(a, b)]) if b > a else np.zeros((0, len(rest)), bool)
    starts = np.flatnonzero(np.concatenate(([True], rest[1:] != rest[:-1]))) if len(rest) else np.empty(0, int)
    for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(rest)]):
        own = near[:, s:e]
        if own.any():
            yield int(rest[s]), np.flatnonzero(own.any(axis=1)) + a, np.flatnonzero(own.any(axis=0)) + a + s


def similar(vectors: DataFrame, t: float = 0.95, dims: int = 16, sample: int = 20000, task_bytes: int = 8 << 20, least: int = 8, stats: dict | None = None) -> DataFrame:
    """vectors: vec_id, embedding. One row for each: vec_id, n_links, component_id, kept.

    task_bytes: components of one side of a task, in double precision; least: intervals that even few vectors are cut into.
    stats: gets, by the vectors' length, the pairs of distinct vectors (pairs), those in pairs of intervals that are joined
    (sent) and those in the smallest halves (compared).
    """
    spark = vectors.sparkSession
    ship(spark)
    eps = math.sqrt(2 - 2 * t)
    rows = vectors.select(F.col("vec_id").alias("vec_id"), "embedding")
    finite = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))  # NaN counts as larger than infinity
    fine = F.coalesce(finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("fine", fine).withColumn("h", F.xxhash64("embedding"))
    # a class for each distinct vector; the hash only saves comparing vectors
    classes = rows.where("fine").groupBy("h", "embedding").agg(F.count("*").alias("n"), F.min("vec_id").alias("first"))
    classes = save(classes.withColumn("width", F.size("embedding")).withColumn("c", F.monotonically_increasing_id()), "classes")
    widths = {r["width"]: r["n"] for r in classes.groupBy("width").agg(F.count("*").alias("n")).toLocalIterator()}
    found, used = None, []
    for width, n in sorted(widths.items()):
        part = _of_width(classes.where(F.col("width") == width), n, width, t, eps, dims, sample, task_bytes, least, stats, used)
        found = part if found is None else found.union(part)
    if found is None:
        label = classes.select("h", "embedding", F.lit(0).cast("long").alias("more"), "n", F.col("first").alias("component_id"))
    else:
        found = save(found, "found")
        drop(*used)
        if stats is not None:
            for r in found.where("a is null").groupBy("b").agg(F.sum("n").alias("n")).collect():
                stats[int(r["b"])]["compared"] = r["n"]
        more = found.where("b is null").groupBy(F.col("a").alias("c")).agg(F.sum("n").alias("more"))
        comp = components(found.where("a is not null and b is not null"))
        of = classes.join(more, "c", "left").join(comp, F.col("c") == comp["node"], "left").select("h", "embedding", "n", "first", F.coalesce("more", F.lit(0)).alias("more"), F.coalesce("root", "c").alias("root"))
        of = save(of, "labels")
        low = save(of.groupBy("root").agg(F.min("first").alias("component_id")), "roots")
        label = of.join(low, "root").select("h", "embedding", "n", "more", "component_id")
        drop(found)
    linked = rows.where("fine").join(label, ["h", "embedding"]).select("vec_id", (F.col("more") + F.col("n") - 1).cast("long").alias("n_links"), "component_id")
    alone = rows.where("not fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _of_width(classes: DataFrame, n: int, width: int, t: float, eps: float, dims: int, sample: int, task_bytes: int, least: int, stats: dict | None, used: list) -> DataFrame:
    """Rows (a, b, n): a is linked to n vectors of other classes (b null); or a and b are linked (n zero); or n pairs of vectors of length b were compared (a null). The tables that they are read from are added to `used`."""
    spark = classes.sparkSession
    sample = min(sample, max(1000, SAMPLE_BYTES // (8 * width)))
    some = classes.select("embedding").orderBy(F.xxhash64("embedding")).limit(sample).toArrow()
    axes = basis(unit(matrix(some.column(0))), min(dims, width))
    limit = eps * eps * (1 + 1e-9) + 1e-12

    def keys(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if b.num_rows:
                cell = np.floor(unit(matrix(b.column(2))) @ axes[:, :8] / eps).astype(np.int64)
                key = np.zeros(len(cell), np.int64)
                for j in range(8):  # cells of unit vectors are -4 to 3 at eps >= 0.25; finer ones are clipped, which only prunes less
                    key = key * 64 + (np.clip(cell[:, j] + 32, 0, 63) if j < cell.shape[1] else 0)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(key)], ["c", "n", "embedding", "key"])

    element = classes.schema["embedding"].dataType.simpleString()
    parts = max(1, -(-n * width * 8 // task_bytes), min(least, -(-n // 512)))
    blocks = min(parts * SUBS, n)
    keyed = save(classes.select("c", "n", "embedding").mapInArrow(keys, f"c long, n long, embedding {element}, key long"), "keys")
    # blocks of the order lie between quantiles of the keys; where bounds are equal, their key's classes are shared out
    cuts = keyed.select(F.percentile_approx("key", [i / blocks for i in range(1, blocks)], max(10000, 50 * blocks)).alias("q")).first()["q"] if blocks > 1 else []
    cuts = spark.sparkContext.broadcast(np.array(cuts, np.int64))

    def place(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            key, c = np.asarray(b.column(3)), np.asarray(b.column(0)).astype(np.uint64)
            below, upto = np.searchsorted(cuts.value, key, side="left"), np.searchsorted(cuts.value, key, side="right")
            share = (c * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % (upto - below + 1).astype(np.uint64)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array((below + share.astype(np.int64)).astype(np.int32))], ["c", "n", "embedding", "block"])

    placed = save(keyed.mapInArrow(place, f"c long, n long, embedding {element}, block int"), "ordered")
    drop(keyed)
    k = axes.shape[1] + 1

    def boxes(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lo, hi, size = {}, {}, {}
        for b in it:
            if b.num_rows:
                p, block = projected(unit(matrix(b.column(1))), axes), np.asarray(b.column(0))
                for i in np.unique(block).tolist():
                    own = p[block == i]
                    lo[i] = np.minimum(lo.get(i, np.inf), own.min(axis=0))
                    hi[i] = np.maximum(hi.get(i, -np.inf), own.max(axis=0))
                    size[i] = size.get(i, 0) + len(own)
        there = sorted(lo)
        lists = [pa.array([x[i].tolist() for i in there], pa.list_(pa.float64())) for x in (lo, hi)]
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), *lists, pa.array([size[i] for i in there], pa.int64())], ["block", "lo", "hi", "size"])

    every = placed.select("block", "embedding").mapInArrow(boxes, "block int, lo array<double>, hi array<double>, size long")
    every = every.groupBy("block").agg(F.sum("size").alias("size"), *(F.min(F.col("lo")[i]).alias(f"lo{i}") for i in range(k)), *(F.max(F.col("hi")[i]).alias(f"hi{i}") for i in range(k)))
    box = sorted(every.collect())  # a row for each block
    block, size = np.array([r[0] for r in box], np.int64), np.array([r[1] for r in box], np.int64)
    tree = spark.sparkContext.broadcast((np.array([r[2 : k + 2] for r in box]), np.array([r[k + 2 :] for r in box]), block // SUBS, block))

    def partners(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lo, hi, part, block = tree.value
        for b in it:
            for i in b.column(0).to_pylist():
                out = [(int(block[x]), i * parts + j, side) for j, own, other in near_blocks(lo, hi, part, i, limit) for side, xs in ((0, own), (1, other)) for x in xs if side == 0 or j != i]
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out) if out else [()] * 3, (pa.int32(), pa.int64(), pa.int32()))], ["block", "pair", "side"])

    wanted = spark.range(parts).repartition(min(parts, 256)).mapInArrow(partners, "block int, pair long, side int")
    wanted = save(wanted, "pairs")
    n_wanted = wanted.count()
    if stats is not None:
        by = spark.createDataFrame([(int(i), int(m)) for i, m in zip(block, size)], "block int, m long")
        sent = wanted.join(by, "block").groupBy("pair").agg(F.sum(F.when(F.col("side") == 0, F.col("m"))).alias("x"), F.sum(F.when(F.col("side") == 1, F.col("m"))).alias("y"))
        sent = sent.agg(F.sum(F.when(F.col("y").isNull(), F.expr("x * (x - 1) div 2")).otherwise(F.col("x") * F.col("y")))).first()[0]
        stats[width] = {"vectors": n, "pairs": n * (n - 1) // 2, "sent": sent or 0, "compared": 0}
    used += [placed, wanted]
    sides = placed.join(bounded(wanted, n_wanted), "block")

    def solve(got: pa.Table) -> pa.Table:
        x, side = unit(matrix(got.column("embedding"))), np.asarray(got.column("side"))
        c, n = np.asarray(got.column("c")), np.asarray(got.column("n"))
        p, idx = projected(x, axes), []
        for s in (0, 1):
            own = np.flatnonzero(side == s)
            idx.append(own[order(p[own], eps)])
        one = not len(idx[1])
        left = Side(x[idx[0]], p[idx[0]])
        right = left if one else Side(x[idx[1]], p[idx[1]])
        other = idx[0] if one else idx[1]
        count, lab, held, m = np.zeros(len(x), np.int64), np.arange(len(x)), [], 0

        def settle() -> np.ndarray:
            i, j = (np.concatenate(v) for v in zip(*held))
            count[:] += np.bincount(i, n[j], len(x)).astype(np.int64) + np.bincount(j, n[i], len(x)).astype(np.int64)
            return _forest(len(x), i, j, lab)

        for i, j in join(left, right, one, t, eps):
            held.append((idx[0][i], other[j]))
            m += len(i)
            if m > 1 << 20:
                lab, held, m = settle(), [], 0
        if held:
            lab = settle()
        linked, member = np.flatnonzero(count), np.flatnonzero(lab != np.arange(len(x)))
        a = np.concatenate([c[linked], c[member], [0]])
        b = np.concatenate([np.zeros(len(linked), np.int64), c[lab[member]], [width]])
        return pa.table({
            "a": pa.array(a, mask=np.arange(len(a)) == len(a) - 1),
            "b": pa.array(b, mask=np.arange(len(b)) < len(linked)),
            "n": pa.array(np.concatenate([count[linked], np.zeros(len(member), np.int64), [left.compared]])),
        })

    return sides.groupBy("pair").applyInArrow(solve, "a long, b long, n long")
