"""Best-fit packing of token sequences by pattern packing with non-negative least squares.

Lengths, not documents, are packed: the histogram of piece lengths (at most `size` numbers, whatever
the corpus) reaches the driver, patterns of a few lengths that fill a sequence are enumerated, their
repeat counts are fitted to the histogram by non-negative least squares and rounded down, and the rest
is packed best fit decreasing. Pieces then take places by their rank among pieces of equal length;
ranks come from counts by (length, hash bucket), so that a length that a third of all pieces have
is dealt out.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparrel.llm.bpe import PATTERN, byte_letters, default_path
from sparrel.llm.common import extended, saved, slices

#: Characters of a run of white space, or of a text, up to which tiktoken gets it as it is; its pattern
#: search gives up at about a million.
SAFE_RUN = 200_000
_RUN = regex.compile(r"\s++")


@lru_cache(maxsize=2)
def _encoding(path: str):
    """The tokenizer file as an encoder of the tiktoken library, which gives the same ids several
    times faster: merges of such a file are in the order of their ids, which is tested here."""
    import json

    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters, vocab = byte_letters(), spec["model"]["vocab"]
    special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
    made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
    if any(a >= b for a, b in zip(made, made[1:], strict=False)):
        raise ValueError("the ids of this tokenizer file aren't in the order of its merges")
    ranks = {bytes(letters[c] for c in s): i for s, i in vocab.items() if s not in special}
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


def token_ids(encoding, text: str) -> np.ndarray:
    """Ids of a whole text; strings of special tokens in it become their ids. Longer runs of white
    space than SAFE_RUN are cut out as the pattern cuts them: but for the last character where
    something follows, and merged without the pattern."""
    if len(text) <= SAFE_RUN:
        return encoding.encode_to_numpy(text, allowed_special="all")
    special = sorted(encoding.special_tokens_set, key=len, reverse=True)
    out = []
    for part in regex.split("(" + "|".join(map(regex.escape, special)) + ")", text) if special else [text]:
        at = 0
        if part not in special:
            for m in _RUN.finditer(part):
                if m.end() - m.start() > SAFE_RUN:
                    end = m.end() - (m.end() < len(part))
                    out.append(encoding.encode_to_numpy(part[at : m.start()], allowed_special="all"))
                    out.append(np.array(encoding._encode_single_piece(part[m.start() : end]), np.uint32))
                    at = end
        out.append(encoding.encode_to_numpy(part[at:], allowed_special="all"))
    return np.concatenate(out)


def pieces(docs: DataFrame, *, path: str | None = None, size: int = 2048, end: int = 0, ids: bool = True) -> DataFrame:
    """Tokenize documents (doc_id, text) and cut them: a document is its ids, then the id `end`; one
    of more than `size` is cut into pieces of `size`, of which the first may be shorter. Returns
    doc_id, piece, start, length, ids_crc32 (of little-endian unsigned 32-bit ids) and, with
    ids=True, the ids. Null text is empty; each row is a document of its own."""
    path = path or default_path()
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * ids

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(path)
        for batch in slices(batches, "text"):
            rows, parts = [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                got = np.append(token_ids(encoding, text or ""), np.uint32(end)).astype("<u4")
                cuts = [0, *range(len(got) % size or size, len(got) + 1, size)]
                for k, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    rows.append((doc, k, lo, hi - lo, zlib.crc32(got[lo:hi].tobytes())))
                    if ids:
                        parts.append(got[lo:hi].astype(np.int32))
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
            if ids:
                columns.append(pa.array(parts, pa.list_(pa.int32())))
            yield pa.record_batch(columns, names=[f.split()[0] for f in schema.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(made, schema)


def patterns(lengths: list[int], size: int, waste: int, most: int = 40_000) -> list[tuple[int, ...]]:
    """Patterns of one to four of the lengths that fill a sequence but for at most `waste`: all single
    ones and pairs, then triples and fours whose further lengths are spread over the whole range,
    up to `most` in all."""
    have = sorted(lengths)

    def fits(rest: int) -> list[int]:
        """Lengths that fill `rest` but for the waste, the fullest first."""
        return have[bisect_left(have, rest - waste) : bisect_left(have, rest + 1)][::-1]

    out = {(a,) for a in fits(size)}
    for a in have:
        for b in fits(size - a)[:2]:
            out.add(tuple(sorted((a, b))))
    spread = have[:: max(1, len(have) // 48)]
    for a in have:
        for b in spread:
            for c in fits(size - a - b)[:1]:
                out.add(tuple(sorted((a, b, c))))
    few = have[:: max(1, len(have) // 16)]
    for a in have:
        for b in few:
            for c in few:
                if b <= c and len(out) < most:
                    for d in fits(size - a - b - c)[:1]:
                        out.add(tuple(sorted((a, b, c, d))))
    return sorted(out)


def fit_counts(found: list[tuple[int, ...]], histogram: dict[int, int], sweeps: int = 60) -> np.ndarray:
    """Repeat counts x >= 0 of patterns with least squares of (pieces used - histogram), by cyclic
    coordinate descent; patterns of more pieces than one length has stay at their bound."""
    x = np.zeros(len(found))
    rest = {k: float(v) for k, v in histogram.items()}
    parts = [list(Counter(p).items()) for p in found]
    norms = [sum(m * m for _, m in p) for p in parts]
    for _ in range(sweeps):
        moved = 0.0
        for j, p in enumerate(parts):
            step = sum(m * rest[a] for a, m in p) / norms[j]
            step = max(step, -x[j])
            if step:
                x[j] += step
                for a, m in p:
                    rest[a] -= m * step
                moved = max(moved, abs(step))
        if moved < 0.5:
            break
    return x


def plan(histogram: dict[int, int], size: int = 2048) -> list[tuple[tuple[int, ...], int]]:
    """Patterns and how often each is used; together they use every piece of the histogram once."""
    left = {a: n for a, n in histogram.items() if n and a < size}
    used: Counter[tuple[int, ...]] = Counter({(size,): histogram[size]} if histogram.get(size) else {})
    found = patterns([*left], size, max(1, size // 512))
    counts = fit_counts(found, left)
    for j in np.argsort(-counts, kind="stable"):
        need = Counter(found[j])
        n = min(int(counts[j]), *(left[a] // m for a, m in need.items()))
        if n > 0:
            used[found[j]] += n
            for a, m in need.items():
                left[a] -= m * n
    # the rest, best fit decreasing, many equal pieces at a time
    room: list[int] = []  # spaces of open bins, sorted
    bins: dict[int, Counter[tuple[int, ...]]] = {}

    def put(bin_: tuple[int, ...], n: int) -> None:
        space = size - sum(bin_)
        if space not in bins:
            bins[space] = Counter()
            insort(room, space)
        bins[space][bin_] += n

    for a in sorted((k for k, n in left.items() if n), reverse=True):
        n = left[a]
        while n:
            at = bisect_left(room, a)
            if at == len(room):
                k = size // a
                if n >= k:
                    put((a,) * k, n // k)
                if n % k:
                    put((a,) * (n % k), 1)
                break
            space = room[at]
            bin_, have = next(iter(bins[space].items()))
            take = min(n, have)
            if take == have:
                del bins[space][bin_]
                if not bins[space]:
                    del bins[space], room[at]
            else:
                bins[space][bin_] -= take
            put((*bin_, a), take)
            n -= take
    for group in bins.values():
        used.update(group)
    return sorted(used.items(), reverse=True)


def places(used: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """The plan by length and rank: pieces of one length with ranks from `rank` on (to the next row's)
    go to sequences `sequence`, `sequence` + 1, ... at `offset`. Its size depends on the plan alone."""
    rows, taken, sequence = [], Counter(), 0
    for bin_, n in used:
        offset = 0
        for a in bin_:
            rows.append((a, taken[a], sequence, offset))
            taken[a] += n
            offset += a
        sequence += n
    rows.sort()
    return {k: np.array(c, dtype=np.int64) for k, c in zip(("length", "rank", "sequence", "offset"), zip(*rows, strict=True) if rows else ([],) * 4, strict=True)}


def pack(cut: DataFrame, *, size: int = 2048) -> DataFrame:
    """Add sequence_id and offset to pieces (doc_id, piece, length from 1 to size, ...), a saved table
    or one that is cheap to make again; other columns stay, but those of the new names are replaced.
    Sequences are gapless from offset 0. Ties (pieces of equal length) go by doc_id and piece."""
    cut = cut.drop("sequence_id", "offset")
    spark = cut.sparkSession
    buckets = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = cut.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    counts = saved(dealt.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n")), "counts")
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("length").alias("_length"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # at most `size` rows
    if any(not 0 < a <= size for a in histogram):
        raise ValueError(f"pieces must have lengths from 1 to {size}")
    shared = spark.sparkContext.broadcast(places(plan(histogram, size)))
    own = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece")
    ranked = dealt.withColumn("_rank", F.row_number().over(own) - 1)
    # both sides are dealt by (length, bucket) already; starts grow with the buckets, so no broadcast
    ranked = ranked.join(starts.hint("merge"), (F.col("length") == F.col("_length")) & (F.col("_bucket") == F.col("_b")))
    ranked = ranked.withColumn("_rank", (F.col("_rank") + F.col("_before")).cast("long")).select(*cut.columns, "_rank")
    keep = cut.columns

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = shared.value
        key = at["length"] * (1 << 48) + at["rank"]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            row = np.searchsorted(key, length * (1 << 48) + rank, side="right") - 1
            sequence = at["sequence"][row] + rank - at["rank"][row]
            yield pa.record_batch([*(batch.column(c) for c in keep), pa.array(sequence, pa.int64()), pa.array(at["offset"][row], pa.int64())], names=[*keep, "sequence_id", "offset"])

    return ranked.mapInArrow(made, extended(cut, {"sequence_id": "long", "offset": "long"}))
