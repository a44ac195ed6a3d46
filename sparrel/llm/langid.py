"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of a bounded, documented sample of labelled texts give a matrix of log-probabilities, which is
broadcast (buckets x languages x 4 bytes); texts are scored whole, in numpy, in batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparrel.llm.common import extended, saved, slices

#: Numbers of a table (4 bytes each), which buckets are fitted to, and the fewest buckets there are.
CELLS, LEAST_BUCKETS = 1 << 23, 1 << 10
_A, _B = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77)
_LETTERS: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.array([chr(i).isalpha() for i in range(0x110000)], dtype=bool)
    return _LETTERS


def grams(texts: list[str | None], buckets: int, n: int = 3, step: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bucket numbers of the n-grams of 1 to n characters of all texts together, and the number of
    the text that each belongs to. Case is folded, runs of other characters than letters are one
    space, and no n-gram reaches over the end of a text. Long batches come in several parts of
    whole n-grams that start at `step` places each, so that memory is bounded."""
    letters = _letters()
    codes, owner = [], []
    for i, t in enumerate(texts):
        c = np.frombuffer(f" {(t or '').lower()} ".encode("utf-32-le"), dtype=np.uint32)
        is_letter = letters[c]
        c = np.where(is_letter, c, 32).astype(np.uint32)
        c = c[is_letter | np.concatenate([[True], is_letter[:-1]])]
        codes.append(c)
        owner.append(np.full(len(c), i, dtype=np.int32))
    if not codes:
        return
    c, own = np.concatenate(codes), np.concatenate(owner)
    mask = np.uint32(buckets - 1)
    for at in range(0, len(c), step):
        part, po = c[at : at + step + n - 1], own[at : at + step + n - 1]
        h = np.zeros(len(part), dtype=np.uint32)
        for k in range(n):
            m = min(step, len(part) - k)
            if m <= 0:
                break
            h = (h[:m] ^ (part[k : k + m] + np.uint32(k + 1)) * _A) * _B
            h ^= h >> np.uint32(15)
            good = po[k : k + m] == po[:m]
            if not k:
                good &= part[:m] != 32
            yield h[good] & mask, po[:m][good]


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    prior: np.ndarray
    table: np.ndarray  # buckets x languages, float32 log-probabilities

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """For each text the likeliest language and its posterior probability; `und` and 0 if it has
        no letter, or if nothing was learnt. Of languages with equal scores the first by name."""
        total = np.zeros((len(texts), len(self.languages)))
        seen = np.zeros(len(texts), dtype=bool)
        if not self.languages:
            return ["und"] * len(texts), [0.0] * len(texts)
        # a part's rows of the table have CELLS / 8 numbers or so
        for bucket, own in grams(texts, len(self.table), step=max(256, CELLS // 8 // len(self.languages))):
            if not len(own):
                continue
            starts = np.flatnonzero(np.diff(own, prepend=-1))
            total[own[starts]] += np.add.reduceat(self.table[bucket], starts, axis=0, dtype=np.float64)
            seen[own[starts]] = True
        total += self.prior
        best = total.argmax(1)
        score = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
        return [self.languages[b] if s else "und" for b, s in zip(best, seen, strict=True)], np.where(seen, score, 0.0).tolist()


def buckets_for(languages: int, most: int) -> int:
    """As many buckets as keep the table at CELLS numbers, a power of two from LEAST_BUCKETS to `most`."""
    buckets = most
    while buckets * languages > CELLS and buckets > LEAST_BUCKETS:
        buckets //= 2
    return buckets


def fit_languages(docs: DataFrame, learn: Column | None = None, *, sample: int = 20_000, buckets: int = 1 << 15, seed: int = 11) -> LanguageModel:
    """Learn from documents (doc_id, text, lang) with neither text nor lang null.

    learn: a condition that rows must meet. sample: about so many rows are learnt from at most,
    by a hash of doc_id. buckets: a power of two; with more than CELLS / buckets languages fewer, down to
    LEAST_BUCKETS, so the table stays at CELLS numbers up to 8,192 languages and grows by 4 kB for each
    beyond. Without a row the model says `und` for everything.

    The corpus is read by one narrow stage, which keeps the sample; its counts are summed by
    partition, then by language, and the driver gets one row a language."""
    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    rows = rows.where(learn) if learn is not None else rows
    n = rows.count()
    if n > sample:
        rows = rows.where(F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 20)) < int((1 << 20) * sample / n))
    rows = saved(rows.select("text", "lang"), "sample")
    priors = sorted((r.lang, r.n) for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect())  # at most `sample` rows
    if not priors:
        return LanguageModel((), np.empty(0), np.empty((buckets, 0), np.float32))
    names = tuple(x for x, _ in priors)
    buckets = buckets_for(len(names), buckets)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts of a slice by language: the buckets that occur, and how often."""
        for batch in slices(batches, "text"):
            langs = batch.column("lang").to_pylist()
            here = sorted(set(langs))
            place = {x: i for i, x in enumerate(here)}
            number = np.array([place[x] for x in langs])
            found = [np.unique(number[own] * buckets + bucket, return_counts=True) for bucket, own in grams(batch.column("text").to_pylist(), buckets)]
            for key, times in found:
                cuts = np.searchsorted(key, np.arange(len(here) + 1) * buckets)
                parts = [(x, key[lo:hi] % buckets, times[lo:hi]) for x, lo, hi in zip(here, cuts, cuts[1:], strict=False) if lo < hi]
                if parts:
                    yield pa.record_batch(
                        [pa.array([x for x, _, _ in parts], pa.string()), pa.array([k.astype("<i4").tobytes() for _, k, _ in parts], pa.binary()), pa.array([c.astype("<i8").tobytes() for _, _, c in parts], pa.binary())],
                        names=["lang", "bucket", "times"],
                    )

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each language of a partition that is sorted by language: counts of all buckets."""
        lang, total = None, np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for x, k, c in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if x != lang:
                    if lang is not None:
                        yield pa.record_batch([pa.array([lang]), pa.array([total.tobytes()], pa.binary())], names=["lang", "counts"])
                    lang, total = x, np.zeros(buckets, dtype=np.int64)
                total[np.frombuffer(k, "<i4")] += np.frombuffer(c, "<i8")
        if lang is not None:
            yield pa.record_batch([pa.array([lang]), pa.array([total.tobytes()], pa.binary())], names=["lang", "counts"])

    parts = rows.mapInArrow(counted, "lang string, bucket binary, times binary").repartition("lang").sortWithinPartitions("lang")
    counts = {r.lang: np.frombuffer(r.counts, dtype=np.int64) for r in parts.mapInArrow(summed, "lang string, counts binary").collect()}
    prior = np.log(np.array([n for _, n in priors]) / sum(n for _, n in priors))
    smooth = np.stack([counts.get(x, np.zeros(buckets)) + 0.5 for x in names], axis=1)
    return LanguageModel(names, prior, np.log(smooth / smooth.sum(0)).astype(np.float32))


def with_language(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """Add `lang_pred` and `lang_score` to every row; columns of these names are replaced. Null text
    and text without a letter are `und`, with score 0."""
    docs = docs.drop("lang_pred", "lang_score")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = docs.columns

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, 1 << 20):
            names, scores = shared.value.predict(batch.column(text).to_pylist())
            yield pa.record_batch([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*keep, "lang_pred", "lang_score"])

    return docs.mapInArrow(made, extended(docs, {"lang_pred": "string", "lang_score": "double"}))
