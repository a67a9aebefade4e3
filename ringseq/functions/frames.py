"""Reading frames of a batch of sequences at once: arrays over all their bases, both strands in one call.

The results are those of kernels.find_orfs and kernels.longest_orfs on each sequence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .exprs import COMPLEMENT_FROM, COMPLEMENT_TO

_COMPLEMENT = np.arange(256, dtype=np.uint8)
_COMPLEMENT[[*COMPLEMENT_FROM.encode()]] = [*COMPLEMENT_TO.encode()]
#: Bases that are worked on at once; a longer sequence is alone.
BASES = 1 << 20


def flat(seqs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all the strings, and where each begins, with the end of the last; null counts as empty."""
    a = pc.fill_null(seqs, "").cast(pa.large_string())
    _, offsets, data = a.buffers()
    at = np.frombuffer(offsets, np.int64)[a.offset : a.offset + len(a) + 1]
    return (np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8))[at[0] : at[-1]], at - at[0]


def parts(at: np.ndarray, bases: int | None = None) -> Iterator[tuple[int, int]]:
    """Runs of sequences of about so many bases."""
    i, bases = 0, bases or BASES
    while i < len(at) - 1:
        j = max(i + 1, int(np.searchsorted(at, at[i] + bases, side="right")) - 1)
        yield i, j
        i = j


def codons(data: np.ndarray, at: np.ndarray, starts: tuple[str, ...], stops: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Where start and stop codons begin on each circle, as places in data. A codon of both kinds is a start, but across the origin both."""
    size = np.diff(at)
    some = size > 0
    first, last = at[:-1][some], at[1:][some] - 1

    def after(x: np.ndarray) -> np.ndarray:
        """The next base on the circle."""
        out = np.empty_like(x)
        out[:-1] = x[1:]
        out[last] = x[first]
        return out

    one = after(data) if len(data) else data
    two = after(one) if len(data) else data

    def met(codons: tuple[str, ...]) -> np.ndarray:
        hit = np.zeros(len(data), bool)
        for c in {x.encode() for x in codons}:
            if len(c) == 3:
                hit |= (data == c[0]) & (one == c[1]) & (two == c[2])
        hit[at[:-1][size == 1]] = False
        return hit

    is_start = met(starts)
    stop = np.flatnonzero(met(stops))
    both = stop[is_start[stop]]
    if len(both):
        end = at[np.searchsorted(at, both, side="right")]
        stop = np.setdiff1d(stop, both[both < end - 2], assume_unique=True)
    return np.flatnonzero(is_start), stop


def _strand(data: np.ndarray, at: np.ndarray, starts: tuple[str, ...], stops: tuple[str, ...]) -> tuple[np.ndarray, ...]:
    """(sequence, start, stop or -1, wraps, length) of every frame.

    A sequence's stops are laid out by frame, over as many turns as frames need, each sequence's three frames after
    one another: so one search in a sorted array finds the first stop in step for all starts.
    """
    size = np.diff(at)
    turns = np.where(size % 3 == 0, 1, 3)
    width = size * (turns + 1) + 3
    base = np.concatenate(([0], np.cumsum(3 * width)))[:-1]
    start, stop = codons(data, at, starts, stops)
    of_stop = np.searchsorted(at, stop, side="right") - 1
    local, laid = stop - at[of_stop], []
    for k in range(4):
        own = k <= turns[of_stop]
        of, place = of_stop[own], local[own] + size[of_stop[own]] * k
        laid.append(base[of] + place % 3 * width[of] + place)
    laid = np.sort(np.concatenate(laid))
    of = np.searchsorted(at, start, side="right") - 1
    s, n = start - at[of], size[of]
    from_ = base[of] + s % 3 * width[of] + s
    most = n * turns[of]
    if len(laid):
        i = np.searchsorted(laid, from_ + (turns[of] == 1))  # where frames never change, a start that is a stop too doesn't end itself
        found = laid[np.minimum(i, len(laid) - 1)]
        d = found - from_
        ok = (i < len(laid)) & (found < base[of] + (s % 3 + 1) * width[of]) & (d < most)
    else:
        d, ok = np.zeros(len(s), np.int64), np.zeros(len(s), bool)
    full = np.maximum(n, 1)
    return of, s, np.where(ok, (s + d) % full, -1), np.where(ok, (s + d + 2) // full, turns[of]), np.where(ok, d + 3, most)


def frames(seqs: pa.Array, starts: tuple[str, ...], stops: tuple[str, ...], strands: str = "+", longest: bool = False, min_length: int = -3, stop_required: bool = False, min_wraps: int = 0, max_wraps: int = 3, min_ratio: float = 0.0) -> pa.ListArray:
    """For each sequence, a list of structs: reverse, start, stop, wraps, length. strands: "+", "-" or "+-".

    min_length counts without the stop codon, min_ratio with it over the sequence's length; longest: of each stop, and of no
    stop, the longest frame, of equally long ones the last by (start modulo 3, start).
    """
    data, at = flat(seqs)
    columns: list[list[np.ndarray]] = [[], [], [], [], [], []]
    for i, j in parts(at):
        own, places = data[at[i] : at[j]], at[i : j + 1] - at[i]
        found = []
        if "+" in strands:
            found.append((*_strand(own, places, starts, stops), 0))
        if "-" in strands:  # the batch read backwards
            of, *rest = _strand(_COMPLEMENT[own[::-1]], places[-1] - places[::-1], starts, stops)
            found.append((j - i - 1 - of, *rest, 1))
        of, s, stop, wraps, length = (np.concatenate([x[k] for x in found]) for k in range(5))
        back = np.concatenate([np.full(len(x[0]), x[5], np.int64) for x in found])
        size = np.diff(places)[of]
        keep = (length - 3 >= min_length) & (wraps >= min_wraps) & (wraps <= max_wraps) & (length / size >= min_ratio)
        if stop_required:
            keep &= stop >= 0
        of, s, stop, wraps, length, back = (x[keep] for x in (of, s, stop, wraps, length, back))
        if longest:
            group = (of * 2 + back) * (int(size.max(initial=0)) + 2) + stop
            order = np.lexsort((s, s % 3, length, group))
            group = group[order]
            order = order[np.flatnonzero(np.append(group[1:] != group[:-1], True))] if len(order) else order
        else:
            order = np.argsort(of * 2 + back, kind="stable")
        for c, x in zip(columns, (of + i, back, s, stop, wraps, length)):
            c.append(x[order])
    of, back, s, stop, wraps, length = (np.concatenate(c) if c else np.empty(0, np.int64) for c in columns)
    ends = np.concatenate(([0], np.cumsum(np.bincount(of, minlength=len(seqs)))))
    ints = [pa.array(s.astype(np.int32)), pa.array(stop.astype(np.int32), mask=stop < 0), pa.array(wraps.astype(np.int32)), pa.array(length.astype(np.int32))]
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.StructArray.from_arrays([pa.array(back == 1), *ints], ["reverse", "start", "stop", "wraps", "length"]))


def places(seqs: pa.Array, starts: tuple[str, ...], stops: tuple[str, ...]) -> pa.StructArray:
    """For each sequence, the lists starts and stops: where codons begin on its circle."""
    data, at = flat(seqs)
    found: tuple[list, list] = ([], [])
    for i, j in parts(at):
        for out, x in zip(found, codons(data[at[i] : at[j]], at[i : j + 1] - at[i], starts, stops)):
            out.append(x + at[i])
    lists = []
    for out in found:
        x = np.concatenate(out) if out else np.empty(0, np.int64)
        of = np.searchsorted(at, x, side="right") - 1
        ends = np.concatenate(([0], np.cumsum(np.bincount(of, minlength=len(seqs)))))
        lists.append(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array((x - at[of]).astype(np.int32))))
    return pa.StructArray.from_arrays(lists, ["starts", "stops"])
