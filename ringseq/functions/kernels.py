"""String kernels on bytes: minimal rotation, canonical form, terminal self-overlap, reading frames."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np

from .exprs import COMPLEMENT_FROM, COMPLEMENT_TO

_COMPLEMENT = bytes.maketrans(COMPLEMENT_FROM.encode(), COMPLEMENT_TO.encode())
_RUNS = {b: re.compile(re.escape(bytes([b])) + b"+") for b in range(256)}


def revcomp(seq: bytes) -> bytes:
    return seq[::-1].translate(_COMPLEMENT)


def lmsr_index(seq: bytes) -> int:
    """Smallest index at which a lexicographically least rotation starts.

    It starts with a longest run of the least byte. Few such runs are compared as slices; many, in linear time.
    """
    n = len(seq)
    if n < 2:
        return 0
    low, ring = min(seq), seq + seq
    best, starts = 0, []
    for m in _RUNS[low].finditer(ring, 0, 2 * n):
        a, size = m.start(), m.end() - m.start()
        if a > n:
            break
        if size >= n:
            return 0
        if size < best or a == 0 and seq[-1] == low:  # a run at the start that goes on from the end is met there
            continue
        if size > best:
            best, starts = size, []
        starts.append(a % n)
    if len(starts) == 1:
        return starts[0]
    if len(starts) <= 32:
        return min((ring[i : i + n], i) for i in set(starts))[1]
    return _least(ring, n)


def _least(ring: bytes, n: int) -> int:
    """Two candidates advance over their common prefix; the larger skips all that it has matched."""
    i, j, k = 0, 1, 0
    while i < n and j < n and k < n:
        a, b = ring[i + k], ring[j + k]
        if a == b:
            k += 1
            continue
        if a > b:
            i += k + 1
        else:
            j += k + 1
        j += i == j
        k = 0
    return min(i, j)


def lmsr(seq: bytes) -> bytes:
    i = lmsr_index(seq)
    return seq[i:] + seq[:i]


def canonicalize(seq: bytes) -> bytes:
    """The lesser of the least rotations of both polarities."""
    one = lmsr(seq)
    return min(one, lmsr(revcomp(one)))


@dataclass(frozen=True)
class Monomerizer:
    """Finds the monomer at the start of a multimer by the overlap of its end with what lies before.

    The last seed_length bases are searched; a hit ends an overlap of the sequence's start with its end, which is accepted
    up to max_mismatch mismatches (default 0) or from min_identity on.
    """

    seed_length: int = 10
    max_mismatch: int | None = None
    min_identity: float | None = None

    def __post_init__(self) -> None:
        if not 1 <= self.seed_length <= 63:
            raise ValueError("seed_length must be from 1 to 63")
        if self.max_mismatch is not None and self.min_identity is not None:
            raise ValueError("max_mismatch and min_identity exclude each other")
        if self.max_mismatch is not None and self.max_mismatch < 0:
            raise ValueError("max_mismatch must not be negative")
        if self.min_identity is not None and not 0 <= self.min_identity <= 1:
            raise ValueError("min_identity must be from 0 to 1")

    def _allowed(self, overlap: int) -> int:
        if self.min_identity is not None:
            return overlap - math.floor(overlap * self.min_identity)
        return self.max_mismatch or 0

    def first_end(self, seq: bytes) -> int | None:
        """End of the prefix that remains when the first overlap is cut off; None if there is none."""
        n, k = len(seq), self.seed_length
        if n <= k:
            return None
        bases, seed = np.frombuffer(seq, np.uint8), seq[-k:]
        at = seq.find(seed, 0, n - k)
        while at >= 0:
            m = at + k
            if np.count_nonzero(bases[:m] != bases[n - m :]) <= self._allowed(m):
                return n - m
            at = seq.find(seed, at + 1, n - k)
        return None

    def end(self, seq: bytes) -> int | None:
        """The same, again and again on what remains."""
        found = None
        while (e := self.first_end(seq)) is not None:
            found, seq = e, seq[:e]
        return found

    def end_sensitive(self, seq: bytes) -> int | None:
        """The same; then once more on the reverse complement of the monomer, for mutations in the seed."""
        found = self.end(seq)
        back = self.first_end(revcomp(seq[:found]))
        return found if back is None else back

    def slice(self, seq: bytes, sensitive: bool = False) -> bytes:
        return seq[: self.end_sensitive(seq) if sensitive else self.end(seq)]


def codon_positions(seq: bytes, start_codons: tuple[str, ...], stop_codons: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Where start and stop codons begin on the circle, from 0, ascending. Codons not of 3 letters are never met.

    A codon of both kinds is a start, but across the origin it is both.
    """
    n = len(seq)
    if n < 2:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    a = np.frombuffer(seq + seq[:2], np.uint8).astype(np.int64)
    codons = a[:n] << 16 | a[1 : n + 1] << 8 | a[2 : n + 2]
    code = lambda cs: [c[0] << 16 | c[1] << 8 | c[2] for c in (x.encode() for x in cs) if len(c) == 3]
    is_start, is_stop = np.isin(codons, code(start_codons)), np.isin(codons, code(stop_codons))
    is_stop[: n - 2] &= ~is_start[: n - 2]
    return np.flatnonzero(is_start), np.flatnonzero(is_stop)


def find_orfs(seq: bytes, start_codons: tuple[str, ...] = ("ATG",), stop_codons: tuple[str, ...] = ("TAA", "TAG", "TGA")) -> np.ndarray:
    """All reading frames on the circle: rows (start, stop or -1, wraps, length), one for each start codon.

    A frame runs from its start to the first stop in step. Where the length is a multiple of 3, frames never change, and a
    stop is met within one turn or never; otherwise the frame shifts at each crossing of the origin, and all frames are
    met in three turns.
    """
    n = len(seq)
    starts, stops = codon_positions(seq, start_codons, stop_codons)
    turns = 1 if n % 3 == 0 else 3
    out = np.empty((len(starts), 4), np.int64)
    out[:, 0], out[:, 1], out[:, 2], out[:, 3] = starts, -1, turns, n * turns
    ring = np.concatenate([stops + n * t for t in range(turns + 1)])
    for frame in range(3):
        own, at = np.flatnonzero(starts % 3 == frame), ring[ring % 3 == frame]
        if not len(own) or not len(at):
            continue
        s = starts[own]
        i = np.searchsorted(at, s, side="right" if turns == 1 else "left")
        d = np.where(i < len(at), at[np.minimum(i, len(at) - 1)] - s, n * turns)
        ok = d < n * turns
        s, d, own = s[ok], d[ok], own[ok]
        out[own, 1], out[own, 2], out[own, 3] = (s + d) % n, (s + d + 2) // n, d + 3
    return out


def longest_orfs(orfs: np.ndarray) -> np.ndarray:
    """For each stop, and for no stop, the longest; of equally long ones the last by (start modulo 3, start)."""
    order = np.lexsort((orfs[:, 0], orfs[:, 0] % 3, orfs[:, 3]))[::-1]
    _, first = np.unique(orfs[order, 1], return_index=True)
    return orfs[order[np.sort(first)]]
