"""Document quality from a linear-chain conditional random field over lines.

Every line of a text gets a label, good or bad. A label's score is a weighted sum of features of the line and of the lines
before and after it; a 2 x 2 table scores neighbouring labels. Forward-backward gives each line's marginal of being good;
their mean, weighted by the lines' lengths, is mapped to a score by a logistic curve.

Labels mark documents, not lines, so training alternates: lines of good documents are good; in bad documents the field
itself, from one round to the next, decides which lines are good (at least the worst line stays bad). The field and the
curve are fitted on a bounded sample of labelled rows: `sample` documents by hash of their id, of up to `max_lines` lines
each and `total_lines` in all. Scoring reads every whole text.

Defined results: null and empty texts are one empty line, whose weight counts as one character; a table without labels, or
with labels of one kind only, gives a field of zero weights and that kind's share (or 0.5) as every score; repeated label
rows count as their mean, and documents that repeat a labelled id as one, the least text; null labels are left out; a null id is
not held out, and not learnt from.
"""

from __future__ import annotations

import math
import operator
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc32_of_id, save, ship, slices, values

_SYMBOL = re.compile(r"[^\w\s.,;:'\"()?-]")
_DIGIT = re.compile(r"\d")
OWN = 11
WIDTH = 3 * OWN + 3


def line_features(line: str) -> tuple[float, ...]:
    """Own features of one line, each about 0 to 1."""
    words, n = line.split(), len(line) + 1
    k = len(words)
    if not k:
        return (1.0,) + (0.0,) * (OWN - 1)
    symbols = len(_SYMBOL.findall(line))
    return (
        0.0,
        min(1.0, math.log1p(n) / 10),
        sum(map(str.isupper, words)) / k,
        min(1.0, symbols / k),
        1.0 if 4 * symbols > k else 0.0,
        1 - len(set(words)) / k,
        sum(map(operator.eq, words, words[1:])) / k,
        min(1.0, len(_DIGIT.findall(line)) / n * 4),
        min(1.0, n / k / 20),
        1.0 if words[-1][-1] in ".!?…" else 0.0,
        1.0 if k < 4 else 0.0,
    )


def own_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """[lines, OWN], and the lines' lengths."""
    lines = (text or "").split("\n")
    return np.array([line_features(x) for x in lines]), np.array([len(x) or 1e-9 for x in lines]) if len(lines) > 1 or lines[0] else np.ones(1)


def with_neighbours(own: np.ndarray) -> np.ndarray:
    """[lines, WIDTH]: a line's features, those of the lines before and after it, and marks of the first and last line."""
    out = np.zeros((len(own), WIDTH))
    out[:, :OWN] = own
    out[1:, OWN : 2 * OWN] = own[:-1]
    out[:-1, 2 * OWN : 3 * OWN] = own[1:]
    out[0, -3], out[-1, -2], out[:, -1] = 1, 1, 1
    return out


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """[lines, WIDTH] with the neighbours' features, and the lines' lengths."""
    own, lengths = own_features(text)
    return with_neighbours(own), lengths


@dataclass
class Field:
    """weights: score of good over bad by feature; table: scores of neighbouring labels [bad, good] x [bad, good]; slope, shift: the curve."""

    weights: np.ndarray
    table: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def marginals(self, x: np.ndarray) -> np.ndarray:
        """P(good) of each line of x [lines, WIDTH]."""
        return self._marginals(x @ self.weights)

    def evidence(self, own: np.ndarray) -> np.ndarray:
        """with_neighbours(own) @ weights, without that matrix."""
        a, b, c = self.weights[: 3 * OWN].reshape(3, OWN) @ own.T
        e = a + self.weights[-1]
        e[1:] += b[:-1]
        e[:-1] += c[1:]
        e[0] += self.weights[-3]
        e[-1] += self.weights[-2]
        return e

    def _marginals(self, evidence: np.ndarray) -> np.ndarray:
        """By forward-backward on the ratio good to bad."""
        e = np.exp(np.clip(evidence, -30, 30)).tolist()
        (bb, bg), (gb, gg) = np.exp(self.table).tolist()
        n, ahead, r = len(e), [], e[0]
        for t in range(n):
            if t:
                r = min(1e12, max(1e-12, e[t] * (r * gg + bg) / (r * gb + bb)))
            ahead.append(r)
        out, b = [0.0] * n, 1.0
        for t in range(n - 1, -1, -1):
            out[t] = ahead[t] * b / (1 + ahead[t] * b)
            q = e[t] * b
            b = min(1e12, max(1e-12, (q * gg + gb) / (q * bg + bb)))
        return np.array(out)

    def mean(self, x: np.ndarray, lengths: np.ndarray) -> float:
        return float(self.marginals(x) @ lengths / lengths.sum())

    def score(self, text: str | None) -> float:
        own, lengths = own_features(text)
        m = min(1 - 1e-6, max(1e-6, float(self._marginals(self.evidence(own)) @ lengths / lengths.sum())))
        return 1 / (1 + math.exp(-min(30, max(-30, self.slope * math.log(m / (1 - m)) + self.shift))))


def _gradient(seqs: list[tuple[np.ndarray, np.ndarray]], w: np.ndarray, table: np.ndarray, l2: float) -> tuple[np.ndarray, np.ndarray]:
    """Of the log-likelihood of the labels, over sequences of equal padded length: x [n, T, f], y [n, T], -1 beyond the end."""
    gw, gt = -l2 * w, -l2 * table
    for x, y in seqs:
        n, steps = y.shape
        live = y >= 0
        e = np.clip(x @ w, -30, 30)
        node = np.stack([np.zeros_like(e), e], axis=2)
        a, b = np.zeros((n, steps, 2)), np.zeros((n, steps, 2))
        a[:, 0] = node[:, 0]
        for t in range(1, steps):
            a[:, t] = node[:, t] + np.logaddexp(a[:, t - 1, :1] + table[0], a[:, t - 1, 1:] + table[1])
            a[:, t] = np.where(live[:, t, None], a[:, t], a[:, t - 1])
        for t in range(steps - 2, -1, -1):
            q = node[:, t + 1] + b[:, t + 1]
            b[:, t] = np.where(live[:, t + 1, None], np.logaddexp(table[:, 0] + q[:, :1], table[:, 1] + q[:, 1:]), 0)
        z = np.logaddexp(a[:, -1, 0], a[:, -1, 1])
        good = np.where(live, np.exp(a[:, :, 1] + b[:, :, 1] - z[:, None]), 0)
        gw += np.einsum("nt,ntf->f", np.where(live, y - good, 0), x)
        pair = np.exp(a[:, :-1, :, None] + table + (node + b)[:, 1:, None, :] - z[:, None, None, None]) * live[:, 1:, None, None]
        gt -= pair.sum(axis=(0, 1))
        both = live[:, 1:]
        np.add.at(gt, (y[:, :-1][both].astype(int), y[:, 1:][both].astype(int)), 1)
    return gw, gt


def _padded(docs: list[tuple[np.ndarray, np.ndarray]], longest: int = 64) -> list[tuple[np.ndarray, np.ndarray]]:
    """Documents cut to pieces of up to `longest` lines (training only), by powers of two of their length."""
    by: dict[int, list] = {}
    for x, y in docs:
        for i in range(0, len(y), longest):
            by.setdefault(1 << (len(y[i : i + longest]) - 1).bit_length(), []).append((x[i : i + longest], y[i : i + longest]))
    out = []
    for steps, own in sorted(by.items()):
        x, y = np.zeros((len(own), steps, WIDTH)), np.full((len(own), steps), -1.0)
        for k, (u, v) in enumerate(own):
            x[k, : len(v)], y[k, : len(v)] = u, v
        out.append((x, y))
    return out


def fit(docs: list[tuple[np.ndarray, np.ndarray, int]], rounds: int = 3, steps: int = 40, l2: float = 0.5) -> Field:
    """docs: (features, lengths, label) of each labelled document."""
    labels = np.array([y for _, _, y in docs], float)
    share = (labels.sum() + 1) / (len(labels) + 2) if len(labels) else 0.5
    field = Field(np.zeros(WIDTH), np.zeros((2, 2)), 0.0, math.log(share / (1 - share)))
    if len(set(labels.tolist())) < 2:
        return field
    n_lines = sum(len(n) for _, n, _ in docs)
    lines = [np.full(len(n), float(y)) for _, n, y in docs]
    for k in range(rounds):
        seqs = _padded([(x, y) for (x, _, _), y in zip(docs, lines)])
        w, table = field.weights.copy(), field.table.copy()
        m, v = [np.zeros_like(w), np.zeros_like(table)], [np.zeros_like(w), np.zeros_like(table)]
        for i in range(1, steps + 1):
            for j, (p, g) in enumerate(zip((w, table), _gradient(seqs, w, table, l2))):
                m[j] = 0.9 * m[j] + 0.1 * g / n_lines
                v[j] = 0.99 * v[j] + 0.01 * (g / n_lines) ** 2
                p += 0.3 * (m[j] / (1 - 0.9**i)) / (np.sqrt(v[j] / (1 - 0.99**i)) + 1e-8)
        field = Field(w, table)
        if k < rounds - 1:
            for d, (x, _, y) in enumerate(docs):
                if not y:
                    good = field.marginals(x)
                    lines[d] = (good > 0.5).astype(float)
                    lines[d][int(np.argmin(good))] = 0.0
    mean = np.array([min(1 - 1e-6, max(1e-6, field.mean(x, n))) for x, n, _ in docs])
    z, slope, shift = np.log(mean / (1 - mean)), 1.0, 0.0
    for _ in range(50):  # Newton's method, with a little weight on slope 1 and shift 0
        p = 1 / (1 + np.exp(-np.clip(slope * z + shift, -30, 30)))
        g = np.array([((labels - p) * z).sum() - (slope - 1), (labels - p).sum() - 0.1 * shift])
        h = p * (1 - p)
        hess = np.array([[(h * z * z).sum() + 1, (h * z).sum()], [(h * z).sum(), h.sum() + 0.1]])
        d = np.linalg.solve(hess, g)
        slope, shift = slope + float(np.clip(d[0], -1, 1)), shift + float(np.clip(d[1], -1, 1))
    return Field(field.weights, field.table, max(slope, 0.0), shift)


def held_out(doc_id: Column) -> Column:
    """By the id's checksum; false for a null id."""
    return F.coalesce(F.pmod(crc32_of_id(doc_id), F.lit(5)) == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = 2500, max_lines: int = 2000, total_lines: int = 200_000) -> Field:
    """Fit on labelled rows that aren't held out: `sample` documents of at most `max_lines` lines, and `total_lines` in all.

    What comes to the driver is 48 bytes for each of those lines.
    """
    spark = docs.sparkSession
    ship(spark)
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    # as many of each label at most, so a rare label is seen; bounded: `sample` rows of ids
    picked = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample // 2) for y in (0, 1)]
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    picked = [tuple(r) for p in picked for r in p.collect()]
    at = spark.createDataFrame([(i, y, k) for k, (i, y) in enumerate(picked)], known.withColumn("place", F.lit(0)).schema)
    # one row an id, however often it comes: the least text, by a partial aggregate
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(at), "doc_id").groupBy("place", "y").agg(F.min("text").alias("text"))
    rows = save(rows.withColumn("n", F.size(F.split("text", "\n"))).where(F.col("n") <= max_lines), "labelled")
    took, use = {0: 0, 1: 0}, []
    for r in sorted(rows.select("place", "y", "n").collect()):
        if took[r["y"]] + r["n"] <= total_lines // 2:
            took[r["y"]] += r["n"]
            use.append((r["place"],))
    rows = rows.join(F.broadcast(spark.createDataFrame(use, "place int")), "place")

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                x = [own_features(t) for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([a.astype(np.float32).tobytes() for a, _ in x]), pa.array([b.astype(np.float32).tobytes() for _, b in x])], ["place", "y", "x", "n"])

    got = sorted(rows.select("place", "y", "text").mapInArrow(f, "place int, y int, x binary, n binary").collect())
    data = [(with_neighbours(np.frombuffer(r["x"], np.float32).astype(float).reshape(-1, OWN)), np.frombuffer(r["n"], np.float32).astype(float), r["y"]) for r in got]
    field = fit(data)
    if len(counts) == 2 and data:  # the sample's shares of the labels are not the table's
        took = [sum(y == k for _, _, y in data) for k in (0, 1)]
        if all(took):
            field.shift += math.log(counts[1] / counts[0]) - math.log(took[1] / took[0])
    return field


def scored(docs: DataFrame, field: Field, text: str = "text", to: str = "score") -> DataFrame:
    """docs with the column `to`."""
    ship(docs.sparkSession)

    @F.arrow_udf("double")
    def f(s: pa.Array) -> pa.Array:
        return pa.array([field.score(x) for x in values(s)], pa.float64())

    return docs.withColumn(to, f(F.col(text)))
