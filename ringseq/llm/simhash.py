"""SimHash near-duplicates, compared bit-sliced.

A fingerprint has a bit set where over half of the text's word shingles have it set in their XXH64 value. Fingerprints at
a Hamming distance up to the radius are linked. Candidates come from bands: with `bands` bands and radius r, two linked
fingerprints agree on at least bands - r whole bands, so every choice of that many bands is a table, and a pair is
compared where it shares a table's key; no link is lost. Within the keys, fingerprints stand in blocks as bit planes:
word j of plane p has bit p of 64 fingerprints. One step adds a plane, XORed with a query's bit, to bitwise counters of
all distances at once (carry-save), and a block is abandoned once all its counters have passed the radius.

Defined results: null and empty texts have no word and fingerprint zero, which is linked like any other; texts of fewer
words than a shingle are one shingle; null ids come last, so a component has one only if all its ids are null; repeated rows and
ties are in one component; columns of any type are kept; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, row_hash, save, ship, values
from .graph import components

#: Fixed values of the fingerprint: seed of XXH64, bits.
SEED, BITS = 42, 64
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """The fingerprint of a whole text, unsigned."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    joined, h = b" ".join(words), xxhash.xxh64_digest
    if len(words) <= shingle:
        digests, n = h(joined, SEED), 1
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = np.concatenate(([0], ends[: -shingle]))
        n = len(starts)
        digests = b"".join([h(joined[a:b], SEED) for a, b in zip(starts.tolist(), (ends[shingle - 1 :] - 1).tolist())])
    counts = np.zeros(BITS, np.int64)
    raw = np.frombuffer(digests, np.uint8).reshape(n, 8)
    for i in range(0, n, 65536):
        counts += np.unpackbits(raw[i : i + 65536], axis=1).sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(text: Column, shingle: int = 4) -> Column:
    """The fingerprint as a signed 64-bit column."""

    @F.arrow_udf("long")
    def f(s: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(x, shingle) for x in values(s)], np.uint64).view(np.int64))

    return f(text)


def band_tables(bands: int, radius: int) -> list[list[tuple[int, int]]]:
    """For each table, its bands as (lowest bit, width)."""
    edges = [BITS * i // bands for i in range(bands + 1)]
    cut = [(a, b - a) for a, b in zip(edges, edges[1:])]
    return [list(t) for t in combinations(cut, bands - radius)]


def planes(fp: np.ndarray) -> np.ndarray:
    """Bit planes: [64 bits, ceil(n / 64)] words."""
    w = -(-len(fp) // 64)
    bits = np.zeros((w * 64, 64), np.uint8)
    bits[: len(fp)] = np.unpackbits(np.ascontiguousarray(fp.astype(np.uint64)).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def within(q: np.ndarray, block: np.ndarray, valid: np.ndarray, radius: int) -> np.ndarray:
    """Bit mask [queries, words] of a block's fingerprints at a distance up to radius of each query.

    valid: mask of the lanes to compare. A lane's counter runs in bit slices to 2 ** slices - 1 and is left once over.
    """
    live, slices = valid.copy(), (radius + 1).bit_length()
    counter = [np.zeros_like(live) for _ in range(slices)]
    for p in range(BITS):
        carry = (block[p][None, :] ^ np.where((q >> np.uint64(p)) & np.uint64(1), _ALL, np.uint64(0))[:, None]) & live
        for c in counter:
            carry_out = c & carry
            c ^= carry
            carry = carry_out
        over = carry
        if radius + 1 < 1 << slices:  # lanes whose counter has come to radius + 1
            hit = live.copy()
            for i, c in enumerate(counter):
                hit &= c if (radius + 1) >> i & 1 else ~c
            over |= hit
        live &= ~over
        if p % 8 == 7 and not live.any():
            break
    return live


def _local(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable over the pairs, for each of n."""
    lab = np.arange(n)
    while len(a):
        low = np.minimum(lab[a], lab[b])
        new = lab.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == lab).all():
            break
        lab = new
    return lab


def _small(fp: np.ndarray, key: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a block of whole keys: each fingerprint with a smaller one of its own component in its key."""
    start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    run = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(key))))
    w = -(-len(fp) // 64) * 64
    same = np.zeros((len(fp), w), np.uint8)
    same[:, : len(fp)] = np.tri(len(fp), k=-1, dtype=bool) & (run[:, None] == run[None, :])
    mask = within(fp, planes(fp), np.packbits(same, axis=1, bitorder="little").view(np.uint64), radius)
    i, j = np.nonzero(np.unpackbits(mask.view(np.uint8), axis=1, bitorder="little")[:, : len(fp)])
    lab = _local(len(fp), i, j)
    i = np.flatnonzero(lab != np.arange(len(fp)))
    return fp[i], fp[lab[i]]


def _large(fp: np.ndarray, radius: int, at_once: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """The same for one key of many fingerprints: a search by breadth over those not yet reached, so a dense group costs
    a few passes over it and not all its pairs."""
    left, out_a, out_b, root, front = fp.copy(), [], [], None, np.empty(0, np.uint64)
    block = planes(left)
    alive = np.ones(len(left), bool)
    while alive.any() or len(front):
        if not len(front):
            first = int(np.argmax(alive))
            root, front = left[first], left[first : first + 1]
            alive[first] = False
            continue
        q, front = front[:at_once], front[at_once:]
        valid = np.zeros(block.shape[1] * 64, np.uint8)
        valid[: len(alive)] = alive
        row = np.packbits(valid, bitorder="little").view(np.uint64)
        mask = np.bitwise_or.reduce(within(q, block, np.repeat(row[None, :], len(q), axis=0), radius), axis=0)
        got = np.flatnonzero(np.unpackbits(mask.view(np.uint8), bitorder="little")[: len(alive)])
        if len(got):
            new = left[got]
            alive[got] = False
            front = np.concatenate((front, new))
            out_a.append(new)
            out_b.append(np.full(len(new), root, np.uint64))
        if 2 * alive.sum() < len(alive) and len(alive) > 4 * at_once:
            left, alive = left[alive], np.ones(int(alive.sum()), bool)
            block = planes(left)
    none = [np.empty(0, np.uint64)]
    return np.concatenate(out_a or none), np.concatenate(out_b or none)


def _links_of_sorted(batches: Iterator[pa.RecordBatch], radius: int, block_rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp) come sorted by key. Keys up to a block's size are put into shared blocks, larger ones stand alone."""

    def solved(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.append(start, len(key)))
        keep = size > 1
        at, todo = 0, []
        for s, n in zip(start[keep].tolist(), size[keep].tolist()):
            if n > block_rows:
                yield from emit(*_large(fp[s : s + n], radius))
                continue
            if at + n > block_rows:
                i = np.concatenate(todo)
                yield from emit(*_small(fp[i], key[i], radius))
                at, todo = 0, []
            at += n
            todo.append(np.arange(s, s + n))
        if todo:
            i = np.concatenate(todo)
            yield from emit(*_small(fp[i], key[i], radius))

    def emit(a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    keys, fps = [], []
    for batch in batches:
        k, f = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
        if not len(k):
            continue
        cut = int(np.searchsorted(k, k[-1]))  # the last key may go on in the next batch
        if cut or (keys and keys[-1][-1] != k[0]):
            keys.append(k[:cut])
            fps.append(f[:cut])
            yield from solved(np.concatenate(keys), np.concatenate(fps))
            keys, fps = [], []
        keys.append(k[cut:])
        fps.append(f[cut:])
    if keys:
        yield from solved(np.concatenate(keys), np.concatenate(fps))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A hash of 64-bit words."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):  # fixed values of the SplitMix64 finalizer
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _bands_of(used: int, bands: int, radius: int) -> list[int]:
    """Masks of every choice of bands - radius of the bands that the bits not in `used` are cut into."""
    free = [b for b in range(BITS) if not used >> b & 1]
    cut = [sum(1 << b for b in free[len(free) * i // bands : len(free) * (i + 1) // bands]) for i in range(bands)]
    return sorted({sum(t) for t in combinations(cut, bands - radius)})


def _split(batches: Iterator[pa.RecordBatch], radius: int, bands: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp, used): each becomes one for every choice of bands of the bits that its key has not used."""
    for b in batches:
        key, fp, used = (c.to_numpy().view(np.uint64) for c in b.columns)
        for u in np.unique(used).tolist():
            own = used == u
            for i, mask in enumerate(_bands_of(u, bands, radius)):
                deeper = _mixed(_mixed(key[own] + np.uint64(i + 1)) ^ (fp[own] & np.uint64(mask)))
                columns = (deeper, fp[own], np.full(len(deeper), u | mask, np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in columns], ["key", "fp", "used"])


def link_classes(prints: DataFrame, radius: int = 4, bands: int = 6, split_at: int = 1 << 17) -> DataFrame:
    """prints: distinct column fp. Returns links (a, b) that connect just what the links within the radius connect.

    A key of more than split_at fingerprints is split again by bands of the bits that it leaves, with no link lost, three
    times at most: then 45 bits are used, and a key can't have more fingerprints than the other bits have values.
    """
    chosen = band_tables(bands, radius)
    key = lambda t, cut: F.lit(t).cast("long") * (1 << 48) + sum(
        (F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << w) - 1)) * F.lit(1 << sum(x[1] for x in cut[:i])) for i, (a, w) in enumerate(cut)), F.lit(0)
    )
    tables = F.array(*(key(t, cut).cast("long") for t, cut in enumerate(chosen)))
    rows = prints.select(F.explode(tables).alias("key"), "fp")
    masks = np.array([sum(((1 << w) - 1) << a for a, w in cut) for cut in chosen], np.uint64).view(np.int64).tolist()
    used = F.element_at(F.array(*map(F.lit, masks)), (F.shiftright("key", 48) + 1).cast("int")).cast("long")
    done = None
    for _ in range(3):
        large = save(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > split_at).select("key"), "large")
        n = large.count()
        if not n:
            break
        ship(prints.sparkSession)
        small = rows.join(bounded(large, n), "key", "left_anti").select("key", "fp")
        done = small if done is None else done.unionByName(small)
        deeper = rows.join(bounded(large, n), "key", "left_semi").select("key", "fp", used.alias("used"))
        rows = save(deeper.mapInArrow(lambda it: _split(it, radius, bands), "key long, fp long, used long"), "deeper")
        used = F.col("used")
    rows = rows.select("key", "fp") if done is None else done.unionByName(rows.select("key", "fp"))
    rows = rows.repartition("key").sortWithinPartitions("key", "fp")
    return rows.mapInArrow(lambda it: _links_of_sorted(it, radius), "a long, b long")


def simhash_components(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 4, radius: int = 4, bands: int = 6) -> DataFrame:
    """One row per row of docs: doc_id, fp (signed), root (of its component: a fingerprint), component_id (its smallest doc_id)."""
    ship(docs.sparkSession)
    rows = save(docs.select(F.col(doc_id).alias("doc_id"), fingerprints(F.col(text), shingle).alias("fp")), "prints")
    return rows.join(_labels(rows, radius, bands), "fp").select("doc_id", "fp", "root", "component_id")


def _labels(rows: DataFrame, radius: int, bands: int) -> DataFrame:
    """(fp, root, component_id) for the rows' (doc_id, fp)."""
    prints = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    found = components(link_classes(prints, radius, bands))
    of = save(prints.join(found, prints["fp"] == found["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "classes")
    # written, so that the join has exchanges of its own and a root of very many fingerprints can be split
    low = save(of.groupBy("root").agg(F.min("first").alias("component_id")), "roots")
    return of.join(low, "root").select("fp", "root", "component_id")


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 4, radius: int = 4, bands: int = 6) -> DataFrame:
    """The rows of docs of which no other row of the component comes first by (doc_id, null last, hash of the row); one row of each component.

    Rows that go are found on row numbers, and left out of the rows by them; equal rows of equal place are interchangeable.
    """
    ship(docs.sparkSession)
    names = docs.columns
    packed = docs.select(F.struct(*(F.col(f"`{n}`") for n in names)).alias("doc"), fingerprints(F.col(f"`{text}`"), shingle).alias("fp"), row_hash(docs, *names).alias("h"))
    place = F.struct(F.col(f"doc.`{doc_id}`").isNull().alias("none"), F.col(f"doc.`{doc_id}`").alias("doc_id"), "h", "rid")
    packed = save(packed.withColumn("rid", F.monotonically_increasing_id()).select("doc", "fp", "rid", place.alias("place")), "printed")
    label = _labels(packed.select(F.col("place.doc_id").alias("doc_id"), "fp"), radius, bands).select("fp", "root")
    first = packed.groupBy("fp").agg(F.min("place").alias("place")).join(label, "fp").groupBy("root").agg(F.min("place").alias("place"))
    others = save(packed.select("rid").join(first.select("place.rid"), "rid", "left_anti"), "others")
    return packed.join(bounded(others, others.count()), "rid", "left_anti").select("doc.*")
