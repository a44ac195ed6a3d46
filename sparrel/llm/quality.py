"""Quality classifier: document statistics, Random Fourier features of a Gaussian kernel, ridge
scores from partition-summed normal equations, isotonic calibration.

Only fitting is bounded: by `sample` labelled rows, picked by a hash of doc_id. Scoring reads every
whole text. Scores depend on the text alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparrel.llm.common import extended, saved, slices, small
from sparrel.llm.shingles import mix, word_hashes

_KIND = np.zeros(256, dtype=np.uint8)  # 0: anything else below 128
_KIND[65:91], _KIND[97:123], _KIND[48:58], _KIND[128:] = 1, 2, 3, 4
_KIND[[ord(c) for c in ".,;:?'\"()-"]] = 5
_KIND[ord("!")], _KIND[ord("|")] = 6, 7
_KIND[[9, 11, 12, 13, 32]], _KIND[10] = 8, 9

#: Names of the statistics, in order.
STATISTICS = (
    *("other", "upper", "lower", "digit", "high", "stop", "exclaim", "bar", "blank", "newline"),
    *("log_words", "mean_word", "spread_word", "long_word", "repeat_next", "top_word", "distinct_words", "distinct_triples", "repeat_lines", "odd_ends", "bare_ends", "entropy"),
)


def statistics(text: str | None) -> np.ndarray:
    """What a score is made of, for one whole text; all zero for null and for empty text."""
    out = np.zeros(len(STATISTICS))
    raw = (text or "").encode()
    if not raw:
        return out
    bytes_ = np.frombuffer(raw, dtype=np.uint8)
    count = np.bincount(bytes_, minlength=256)
    out[:10] = np.bincount(_KIND, weights=count, minlength=10) / len(raw)
    share = count[count > 0] / len(raw)
    out[21] = -(share * np.log2(share)).sum()
    words = word_hashes(raw)
    n = len(words)
    if not n:
        return out
    blank = _KIND[bytes_] >= 8
    edge = np.flatnonzero(np.diff(~blank, prepend=False, append=False))
    size = (edge[1::2] - edge[::2]).astype(float)
    _, times = np.unique(words, return_counts=True)
    triples = mix(mix(words[:-2] + np.uint64(1)) + mix(words[1:-1] + np.uint64(2)) * np.uint64(3) + words[2:])
    lines = [x for x in raw.split(b"\n") if x.strip()]
    last = _KIND[bytes_[edge[1::2] - 1]]
    out[10:21] = (
        *(np.log1p(n), size.mean(), size.std(), (size > 24).mean()),
        *((words[1:] == words[:-1]).mean() if n > 1 else 0, times.max() / n if n > 8 else 0, len(times) / n),
        *(len(np.unique(triples)) / len(triples) if len(triples) else 1, 1 - len(set(lines)) / len(lines)),
        *(np.isin(last, (0, 6, 7)).mean(), np.isin(last, (1, 2, 3, 4)).mean()),
    )
    return out


@dataclass(frozen=True)
class QualityModel:
    """A fitted model; a few hundred kB at most, whatever the corpus."""

    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        f = np.cos(z @ self.directions + self.phases) * np.sqrt(2 / len(self.phases))
        return np.hstack([f, np.ones((len(x), 1))])

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not len(self.knots):
            return np.full(len(x), 0.5)
        return np.clip(np.interp(self.features(x) @ self.weights, self.knots, self.levels), 0, 1)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots and never falling levels, to interpolate between."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # weight, sum of y, first and last x
    for a, b in zip(x[order], y[order], strict=True):
        blocks.append([1, b, a, a])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            w, s, _, hi = blocks.pop()
            blocks[-1][0] += w
            blocks[-1][1] += s
            blocks[-1][3] = hi
    knots = np.array([k for w, s, lo, hi in blocks for k in (lo, hi)])
    levels = np.array([(s + 0.5) / (w + 1) for w, s, lo, hi in blocks for _ in range(2)])
    return knots, np.maximum.accumulate(levels)


def _statistics_batches(keep: list[str]) -> object:
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            x = [statistics(t).tolist() for t in batch.column("text").to_pylist()]
            yield pa.record_batch([*(batch.column(k) for k in keep), pa.array(x, pa.list_(pa.float64()))], names=[*keep, "x"])

    return made


def fit_quality(
    docs: DataFrame, labels: DataFrame, learn: Column | None = None, *, sample: int = 20_000, dims: int = 256, ridge: float = 1e-3, seed: int = 7
) -> QualityModel:
    """Fit on documents (doc_id, text) with labels (doc_id, quality 0 or 1).

    learn: a condition on doc_id that labelled rows must meet. sample: about so many labelled rows
    are used at most, by a hash of doc_id. A doc_id labelled both ways counts as 0; labels that
    are null or neither 0 nor 1 don't count. Without rows of both labels all scores are 0.5.
    A fifth of the rows, by hash, is kept from the ridge fit and fits the calibration."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").cast("double").alias("y"))
    known = known.where(learn) if learn is not None else known
    known = saved(known, "known")
    n = known.count()
    part = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 20))
    if n > sample:
        known = known.where(part < int((1 << 20) * sample / n))
    known = known.withColumn("calibrates", F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), F.lit(5)) == 0)
    rows = docs.select("doc_id", "text").join(small(known, min(n, sample)), "doc_id")
    rows = saved(rows.mapInArrow(_statistics_batches(["y", "calibrates"]), "y double, calibrates boolean, x array<double>"), "statistics")

    d = len(STATISTICS)
    fit = rows.where("not calibrates")
    moments = fit.agg(F.min("y"), F.max("y"), *(f(F.col("x")[i]) for i in range(d) for f in (F.avg, F.stddev_pop))).first()
    rng = np.random.default_rng(seed)
    directions, phases = rng.normal(size=(d, dims)) / np.sqrt(d), rng.uniform(0, 2 * np.pi, dims)
    none = np.empty(0)
    if moments[0] is None or moments[0] == moments[1]:
        return QualityModel(np.zeros(d), np.ones(d), directions, phases, np.zeros(dims + 1), none, none)
    mean, scale = np.array(moments[2::2]), np.maximum(np.array(moments[3::2]), 1e-6)
    bare = QualityModel(mean, scale, directions, phases, np.zeros(dims + 1), none, none)

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = np.zeros((dims + 1, dims + 1)), np.zeros(dims + 1)
        for batch in batches:
            if batch.num_rows:
                z = bare.features(np.array(batch.column("x").to_pylist()))
                a += z.T @ z
                b += z.T @ batch.column("y").to_numpy()
        yield pa.record_batch([pa.array([a.tobytes()], pa.binary()), pa.array([b.tobytes()], pa.binary())], names=["a", "b"])

    # at most 16 partitions of the bounded sample: 16 matrices of (dims + 1) squared reach the driver
    a, b = np.zeros((dims + 1, dims + 1)), np.zeros(dims + 1)
    for one in fit.coalesce(16).mapInArrow(equations, "a binary, b binary").toLocalIterator():
        a += np.frombuffer(one.a).reshape(a.shape)
        b += np.frombuffer(one.b)
    weights = np.linalg.solve(a + ridge * a[-1, -1] * np.diag([*[1 / dims] * dims, 0.0]), b)
    held = rows.where("calibrates").collect()  # a fifth of the bounded sample
    if not held:
        return bare
    raw = bare.features(np.array([r.x for r in held])) @ weights
    return QualityModel(mean, scale, directions, phases, weights, *isotonic(raw, np.array([r.y for r in held])))


def with_quality(docs: DataFrame, model: QualityModel, text: str = "text", *, threshold: float = 0.7) -> DataFrame:
    """Add `score` (0 to 1; higher: label 1 is likelier) and `predicted` (1 from the threshold on) to
    every row; columns of these names are replaced. Null text counts as empty text."""
    docs = docs.drop("score", "predicted")
    keep = docs.columns

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            s = model.scores(np.array([statistics(t) for t in batch.column(text).to_pylist()]))
            yield pa.record_batch([*batch.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*keep, "score", "predicted"])

    return docs.mapInArrow(made, extended(docs, {"score": "double", "predicted": "int"}))
