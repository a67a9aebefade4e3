"""Packing token sequences into windows: a histogram of lengths, non-negative least squares over shallow combinations, greedy rest.

Documents are encoded and closed with an end id; each gives whole windows and a rest. The lengths' histogram (one count
for each length up to the window: bounded) comes to the driver. There, combinations of two or three lengths that fill a
window exactly are enumerated, least squares with repeat counts not below zero is solved for how often each is used, and
the counts are rounded as far as pieces are there. What remains is packed greedily, best fit first; where nothing fits, a
piece is cut to fill the window. The plan is in intervals of ranks within a length, so it does not grow with the rows:
a piece finds its place from its length and its rank, which is numbered within cells of a length, salted so that a length
that very many documents share is many cells.

Ranks are numbered over rows without ids; only pieces that the plan cuts are joined with their ids again.

Defined results: null and empty texts are the end id alone; null ids are kept as they are, and whole numbers of 64 bits
beside them; repeated rows are packed as often as they come; ties of equal length are ranked by a hash of doc_id, start and
ids, and within its cells by doc_id and start; an empty table gives an empty one. One window at most is left unfilled.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, copy_numbers, drop, save, ship, slices, with_numbers

_ENCODERS: dict = {}
#: White space in a row beyond which a text is cut for the ranks' pattern, whose stack a million exhausts.
LONG_BLANK = 100_000
#: What the pattern takes for white space; Python's has four more.
_BLANK = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def parts(text: str) -> Iterator[tuple[str, bool]]:
    """The text, cut at very long white space; and whether a part is such white space, which the pattern makes one piece.

    The last blank before a word is not in that piece: the pattern leaves it to what follows.
    """
    done = 0
    for m in _BLANK.finditer(text):
        if m.end() - m.start() > LONG_BLANK:
            end = m.end() - (m.end() < len(text))
            yield text[done : m.start()], False
            yield text[m.start() : end], True
            done = end
    yield text[done:], False


def encoder(tokenizer: str):
    """A function from a text to its ids, for a tokenizer's JSON file; kept by path in each Python worker.

    Where the vocabulary also comes as ranks beside it (.tiktoken), those give the same ids sooner; texts that hold the
    text of a special token go by the JSON file. Very much white space in a row is encoded apart from the ranks' pattern.
    """
    if tokenizer not in _ENCODERS:
        import json
        import os
        from functools import lru_cache
        from pathlib import Path

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

        @lru_cache(maxsize=1)
        def slow():  # made when a text needs it: it takes 40 MB
            from tokenizers import Tokenizer

            return Tokenizer.from_file(tokenizer)

        plain = lambda text: slow().encode(text, add_special_tokens=False).ids
        special = [t["content"] for t in json.loads(Path(tokenizer).read_text("utf-8"))["added_tokens"]]
        ranks = Path(tokenizer).with_suffix(".tiktoken")
        found = plain
        if ranks.exists():
            import public_tokenizers
            import tiktoken

            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.read_bytes().splitlines())}
            fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
            one = lambda part, blank: fast._encode_single_piece(part) if blank else fast.encode_ordinary(part)
            quick = lambda text: fast.encode_ordinary(text) if len(text) <= LONG_BLANK else [i for p in parts(text) for i in one(*p)]
            found = lambda text: plain(text) if any(t in text for t in special) else quick(text)
        _ENCODERS[tokenizer] = found
    return _ENCODERS[tokenizer]


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())


def pieces(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1) -> DataFrame:
    """Whole windows and a rest of each document: doc_id, start, length, doc_tokens, crc, ids (little-endian 32 bit, packed to 16 where they fit)."""
    ship(docs.sparkSession)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            for part in slices(batch, 1):
                of, rows = [], []
                for k, text in enumerate(part.column(1).to_pylist()):
                    ids = np.array([*encode(text or ""), end_id], np.uint32)
                    for i in range(0, len(ids), window):
                        own = ids[i : i + window]
                        of.append(k)
                        rows.append((i, len(own), len(ids), crc(own), packed(own)))
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(of)), *columns], ["doc_id", "start", "length", "doc_tokens", "crc", "ids"])

    return docs.select("doc_id", "text").mapInArrow(f, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, start long, length int, doc_tokens long, crc long, ids binary")


def packed(ids: np.ndarray) -> bytes:
    """First byte: bytes of an id."""
    return b"\2" + ids.astype("<u2").tobytes() if not len(ids) or int(ids.max()) < 65536 else b"\4" + ids.astype("<u4").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1)


def combinations_filling(lengths: np.ndarray, window: int, each: int = 4) -> list[tuple[int, ...]]:
    """Pairs and triples of the lengths that fill the window; of the triples with a given longest length, some `each`."""
    there, out = set(lengths.tolist()), []
    for a in lengths.tolist()[::-1]:
        rest = window - a
        if rest in there and rest <= a:
            out.append((a, rest))
        second = lengths[(lengths <= min(a, rest - 1)) & (2 * lengths >= rest)]
        second = second[np.isin(rest - second, lengths)]
        for b in second[np.unique(np.linspace(0, len(second) - 1, each).round().astype(int))].tolist() if len(second) else []:
            out.append((a, b, rest - b))
    return out


def nonnegative(columns: list[tuple[int, ...]], counts: np.ndarray, sweeps: int = 12) -> np.ndarray:
    """Least squares of counts by non-negative multiples of the columns, by coordinate descent."""
    x, rest = [0.0] * len(columns), counts.astype(float).tolist()
    norm = [sum(c.count(i) ** 2 for i in set(c)) for c in columns]
    for _ in range(sweeps):
        moved = 0.0
        for j, c in enumerate(columns):
            g = 0.0
            for i in c:
                g += rest[i]
            new = x[j] + g / norm[j]
            if new < 0:
                new = 0.0
            d = new - x[j]
            if d:
                x[j] = new
                for i in c:
                    rest[i] -= d
                moved += abs(d)
        if moved < 1e-3 * max(1.0, sum(x)):
            break
    return np.array(x)


def plan(counts: np.ndarray, window: int = 2048) -> tuple[dict[int, np.ndarray], int]:
    """counts[l]: pieces of length l. For each length, rows (first rank, end rank, from, tokens, first sequence, offset); and the sequences' number."""
    left = counts.astype(np.int64).copy()
    queue: dict[int, deque] = {int(n): deque([(int(n), 0, int(left[n]), 0)]) for n in np.flatnonzero(left)}
    out: dict[int, list] = {}
    made = 0

    def use(length: int, repeats: int, tokens: int, offset: int) -> None:
        """Put `repeats` pieces of a length, or their first tokens, at an offset of the next `repeats` sequences."""
        at, need, own = made, repeats, queue[length]
        left[length] -= repeats
        while need:
            origin, rank, n, sub = own.popleft()
            k = min(n, need)
            if n > k:
                own.appendleft((origin, rank + k, n - k, sub))
            out.setdefault(origin, []).append((rank, rank + k, sub, tokens, at, offset))
            if tokens < length:
                queue.setdefault(length - tokens, deque()).append((origin, rank, k, sub + tokens))
                left[length - tokens] += k
            at, need = at + k, need - k

    def repeat(pattern: list[tuple[int, int]], repeats: int) -> None:
        nonlocal made
        offset = 0
        for length, tokens in pattern:
            use(length, repeats, tokens, offset)
            offset += tokens
        made += repeats

    if left[window]:
        repeat([(window, window)], int(left[window]))
    lengths = np.flatnonzero(left)
    columns = combinations_filling(lengths, window)
    x = nonnegative(columns, left)
    for j in np.argsort(-x, kind="stable").tolist():
        c = columns[j]
        n = min(int(x[j] + 0.5), *(int(left[i]) // c.count(i) for i in c))
        if n > 0:
            repeat([(i, i) for i in c], n)
    while left.any():
        pattern, gap, used = [], window, {}
        while gap:
            fits = np.flatnonzero(left[1 : gap + 1])[::-1] + 1
            length = next((int(n) for n in fits if left[n] > used.get(int(n), 0)), 0)
            if not length:
                break
            used[length] = used.get(length, 0) + 1
            pattern.append((length, length))
            gap -= length
        if gap:  # cut a piece of the most frequent length there is
            rest = left.copy()
            for n, k in used.items():
                rest[n] -= k
            length = int(np.argmax(rest))
            if rest[length] > 0:
                used[length] = used.get(length, 0) + 1
                pattern.append((length, gap))
        repeat(pattern, min(int(left[n]) // k for n, k in used.items()))
    return {n: np.array(sorted(r), np.int64) for n, r in out.items()}, made


def pack(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, an array, if kept)."""
    spark = docs.sparkSession
    found = pieces(docs, tokenizer, window, end_id)
    stored = save(found.select("*", F.xxhash64("doc_id", "start", "crc").alias("k"), F.monotonically_increasing_id().alias("rid"), F.spark_partition_id().alias("pid")), "pieces")
    rows = stored.drop("ids")
    by_length = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    counts = np.zeros(window + 1, np.int64)
    for n, k in by_length.items():
        counts[n] = k
    # cells: of 512 rows, or a 20000th of all; there are at most window + 20000 of them
    full = max(512, int(counts.sum()) // 20000)
    salts = spark.createDataFrame([(n, -(-k // full)) for n, k in sorted(by_length.items())], "length int, salts long")
    rows = with_numbers(rows, copy_numbers(rows)).join(F.broadcast(salts), "length").withColumn("cell", F.pmod(F.xxhash64("k", "no"), "salts"))
    rows = cells = save(rows.drop("salts", "pid", "k"), "cells")
    first, at = [], dict.fromkeys(by_length, 0)
    for r in sorted(rows.groupBy("length", "cell").agg(F.count("*").alias("n")).collect()):
        first.append((r["length"], r["cell"], at[r["length"]]))
        at[r["length"]] += r["n"]
    first = spark.createDataFrame(first, "length int, cell long, first long")
    number = F.row_number().over(Window.partitionBy("length", "cell").orderBy("doc_id", "start", "crc", "no")) - 1
    rows = rows.withColumn("i", number).join(F.broadcast(first), ["length", "cell"])
    rows = rows.select("doc_id", "start", "length", "doc_tokens", "crc", "rid", (F.col("first") + F.col("i")).alias("rank"))
    places = spark.sparkContext.broadcast(plan(counts, window)[0])
    names = ["doc_id", "start", "length", "crc", "doc_tokens", "sequence_id", "offset", "rid", "from", "cut"]

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = np.asarray(b.column(2)), np.asarray(b.column(6))
            for n in np.unique(length).tolist():
                own, p = np.flatnonzero(length == n), places.value[n]
                i, j = np.nonzero((rank[own][:, None] >= p[None, :, 0]) & (rank[own][:, None] < p[None, :, 1]))
                k, p = own[i], p[j]
                got = b.take(pa.array(k))
                columns = [np.asarray(got.column(1)) + p[:, 2], p[:, 3], got.column(4), got.column(3), p[:, 4] + rank[k] - p[:, 0], p[:, 5], got.column(5), p[:, 2], p[:, 3] < n]
                yield pa.RecordBatch.from_arrays([got.column(0), *map(pa.array, columns)], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    placed = rows.mapInArrow(f, f"doc_id {kind}, start long, length long, crc long, doc_tokens long, sequence_id long, offset long, rid long, from long, cut boolean")
    placed = save(placed, "placed")
    drop(cells)
    cut = placed if keep_ids else placed.where("cut")
    cut = stored.select("rid", "ids").join(bounded(cut, cut.count()), "rid").withColumn("of", _part("ids", "from", "length"))
    columns = ["doc_id", "start", "length", F.col("of.crc").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"]
    if keep_ids:
        return cut.select(*columns, F.col("of.ids").alias("ids"))
    whole = placed.where("not cut").select("doc_id", "start", "length", F.col("crc").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
    return whole.unionByName(cut.select(*columns))


def _part(ids: str, start: str, length: str) -> Column:
    """Of packed ids: a part's checksum and ids."""

    @F.arrow_udf("crc long, ids array<int>")
    def f(ids: pa.Array, start: pa.Array, length: pa.Array) -> pa.Array:
        own = [unpacked(x)[a : a + n].astype(np.int32) for x, a, n in zip(ids.to_pylist(), start.to_pylist(), length.to_pylist())]
        ends = np.cumsum([0, *map(len, own)], dtype=np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(own or [np.empty(0, np.int32)])))
        return pa.StructArray.from_arrays([pa.array([crc(x) for x in own], pa.int64()), lists], ["crc", "ids"])

    return f(ids, start, length)
