"""N-gram Jaccard join by T-occurrence search with DivideSkip.

Two sets of n and m shingles with a Jaccard of at least t share at least T = ceil(t (n + m) / (1 + t)) of
them. Searching a block of documents for a query set, the longest inverted lists are put aside, the
short ones are heap-merged (skipping what can't occur often enough), and what has occurred often
enough is probed for in the long lists by binary search (Li, Lu and Lu, 2008).

How documents get together, without writing all pairs of a group:

1. A first scan makes each set's size and 128-bit fingerprint, and counts shingles in a sketch of bounded
   size. Documents of equal sets are one set from here on.
2. Shingles have one global order: rare by the sketch first, then by hash. Any order is right; this one
   keeps common passages out of the prefixes. Sets that link share a shingle among their first
   n - ceil(t n) + 1. A second scan deals those out; lists of one set go at once.
3. Short lists give pairs, of which those that share too few prefix shingles to reach T go. Long lists
   give a star each, from a set to those of compatible size. Both are searched exactly.
4. Long lists that still hold several components are searched again: what is not of the list's
   largest component against the whole list, by blocks of bounded size. Prefixes go to the blocks first, and
   texts to those where a link is possible.

Only edges that join something come back from a search. The result is exact, but for collisions of
64-bit shingle hashes within two sets and of 128-bit fingerprints.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparrel.llm.common import Groups, components, saved, slices, small
from sparrel.llm.shingles import mix, shingle_set

#: Counters of the sketch, by the number of documents: eight a document from the least to the most. They take two
#: bytes each in a task and one in the broadcast ranks, so 16 MB at most.
SLOTS, MOST_SLOTS = 1 << 21, 1 << 24
_PART = 1 << 16
#: Ranks of counts: sixths of a power of two.
_STEP = 6
#: Sets in a list up to which its pairs are written one by one.
SHORT = 64
#: Documents that have a shingle, from which on its list is dealt out over several tasks, so many to a task.
HOT = 1 << 16
#: Targets of a query in a unit of a star; sets of a block of a long list on the average; queries of a block that
#: are searched for in one go; and shingles of an index at most (but for one larger set).
SPREAD, BLOCK, PART, INDEX = 64, 2048, 256, 1 << 20


def occurrences(n: int, m: int, percent: int) -> int:
    """The least overlap of sets of n and m with 100 * overlap >= percent * union."""
    return -(-percent * (n + m) // (100 + percent))


class Prefixes:
    """Prefixes of a block of sets, to tell at once which sets a query can link with at all."""

    def __init__(self, prefixes: list[np.ndarray], sizes: np.ndarray, percent: int) -> None:
        self.percent, self.sizes = percent, sizes
        token, owner = np.concatenate(prefixes), np.repeat(np.arange(len(sizes)), [len(p) for p in prefixes])
        order = np.argsort(token, kind="stable")
        self.token, self.owner = token[order], owner[order]

    def candidates(self, n: int, query: np.ndarray) -> np.ndarray:
        """Numbers of the sets that share enough prefix shingles with a query of n shingles (see pairs)."""
        lo, hi = np.searchsorted(self.token, query, "left"), np.searchsorted(self.token, query, "right")
        lo, hi = lo[hi > lo], hi[hi > lo]
        if not len(lo):
            return np.empty(0, dtype=int)
        shared = np.bincount(np.concatenate([self.owner[a:b] for a, b in zip(lo, hi, strict=True)]), minlength=len(self.sizes))
        need = -(-self.percent * (n + self.sizes) // (100 + self.percent))
        others = -(-self.percent * np.maximum(n, self.sizes) // 100) - 1
        return np.flatnonzero((shared > 0) & (shared >= need - others))


class Index:
    """Inverted lists of a block of sets, searched by T-occurrence with DivideSkip."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sizes = [len(s) for s in sets]
        token = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.lexsort((owner, token))
        token, self.owner = token[order], owner[order]
        first = np.flatnonzero(np.append(True, token[1:] != token[:-1])) if len(token) else np.empty(0, int)
        self.tokens, self.bounds = token[first], np.append(first, len(token))

    def lists(self, query: np.ndarray) -> list[list[int]]:
        """The list of each shingle of the query that occurs here: ascending numbers of sets."""
        if not len(self.tokens):
            return []
        at = np.minimum(np.searchsorted(self.tokens, query), len(self.tokens) - 1)
        at = at[self.tokens[at] == query]
        return [self.owner[a:b].tolist() for a, b in zip(self.bounds[at], self.bounds[at + 1], strict=True)]

    def search(self, query: np.ndarray, percent: int, skip: float = 0.03) -> list[int]:
        """Sets whose Jaccard with the query is at least percent / 100. skip: the greater, the fewer
        lists are put aside; results don't depend on it."""
        n = len(query)
        least = max(1, -(-percent * n // 100))  # the smallest T of any set that can link
        lists = self.lists(query)
        if len(lists) < least:
            return []
        lists.sort(key=len)
        aside = min(least - 1, int(least / (skip * np.log2(len(lists[-1]) + 1) + 1)))
        short, long = lists[: len(lists) - aside], lists[len(lists) - aside :]
        out = []
        for i, found in merge_skip(short, least - aside):
            need = occurrences(n, self.sizes[i], percent)
            for k, one in enumerate(long):
                if found + len(long) - k < need:
                    break
                at = bisect_left(one, i)
                found += at < len(one) and one[at] == i
            if found >= need:
                out.append(i)
        return out


def merge_skip(lists: list[list[int]], least: int) -> Iterator[tuple[int, int]]:
    """Numbers that occur in at least `least` of the ascending lists, with how often, by a heap; lists
    jump over what can't occur so often."""
    least = max(1, least)
    heap = [(one[0], k, 0) for k, one in enumerate(lists) if one]
    heapq.heapify(heap)
    while len(heap) >= least:
        top, popped = heap[0][0], []
        while heap and heap[0][0] == top:
            popped.append(heapq.heappop(heap))
        if len(popped) >= least:
            yield top, len(popped)
            for _, k, at in popped:
                if at + 1 < len(lists[k]):
                    heapq.heappush(heap, (lists[k][at + 1], k, at + 1))
            continue
        while heap and len(popped) < least - 1:
            popped.append(heapq.heappop(heap))
        if not heap:
            return
        bar = heap[0][0]
        for _, k, at in popped:
            at = bisect_left(lists[k], bar, at)
            if at < len(lists[k]):
                heapq.heappush(heap, (lists[k][at], k, at))


def _texts(batch: pa.RecordBatch, size: int) -> Iterator[np.ndarray]:
    for t in batch.column("text").to_pylist():
        yield shingle_set((t or "").encode(), size)


def _print(s: np.ndarray) -> tuple[int, int]:
    """A 128-bit fingerprint of a set."""
    a, b = mix(s), mix(s * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
    return int(a.sum(dtype=np.uint64).view(np.int64)), int(b.sum(dtype=np.uint64).view(np.int64))


def _slot(s: np.ndarray, slots: int) -> np.ndarray:
    return (s & np.uint64(slots - 1)).astype(np.int64)


def slots_for(documents: int) -> int:
    slots = SLOTS
    while slots < 8 * documents and slots < MOST_SLOTS:
        slots *= 2
    return slots


def scan(docs: DataFrame, size: int, slots: int) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, n, f, g): the size and fingerprint of each document's set; and the sketch: ranks of how often
    shingles of each slot occur, over all documents."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(slots, dtype=np.uint16)
        names = ["doc_id", "n", "f", "g", "part", "counts"]
        for batch in slices(batches, "text"):
            rows = []
            for s in _texts(batch, size):
                slot = np.unique(_slot(s, slots))
                sketch[slot] += sketch[slot] < 65535
                rows.append((len(s), *_print(s)))
            n, f, g = zip(*rows, strict=True)
            none = pa.nulls(len(rows))
            yield pa.record_batch([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(f, pa.int64()), pa.array(g, pa.int64()), none.cast(pa.int32()), none.cast(pa.binary())], names=names)
        for p in range(slots // _PART):
            counts = sketch[p * _PART : (p + 1) * _PART]
            if counts.any():
                none = pa.nulls(1, pa.int64())
                yield pa.record_batch([none, none, none, none, pa.array([p], pa.int32()), pa.array([counts.astype("<u2").tobytes()], pa.binary())], names=names)

    rows = saved(docs.select("doc_id", "text").mapInArrow(made, "doc_id long, n long, f long, g long, part int, counts binary"), "scan")

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
        """Sums of a part's counters, for parts that come one after another."""
        part, whole = None, np.zeros(_PART, dtype="<u4")
        for batch in batches:
            for p, c in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                if p != part:
                    if part is not None:
                        yield part, whole
                    part, whole = p, np.zeros(_PART, dtype="<u4")
                more = np.frombuffer(c, dtype="<u2" if len(c) == 2 * _PART else "<u4")
                whole += np.minimum(more, np.uint32(0xFFFFFFFF) - whole)
        if part is not None:
            yield part, whole

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p, c in total(batches):
            yield pa.record_batch([pa.array([p], pa.int32()), pa.array([c.tobytes()], pa.binary())], names=["part", "counts"])

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p, c in total(batches):
            rank = np.round(np.log2(np.maximum(c, 1)) * _STEP).astype(np.uint8)  # the order needs no more
            yield pa.record_batch([pa.array([p], pa.int32()), pa.array([rank.tobytes()], pa.binary())], names=["part", "rank"])

    # a part's counters are summed as they stream by, first those of 64 tasks of the scan each, if there are more
    parts = rows.where("part is not null").select("part", "counts")
    tasks = parts.groupBy("part").count().agg(F.max("count")).first()[0] or 0
    if tasks > 64:
        share = F.pmod(F.xxhash64("counts"), F.lit(-(-tasks // 64)))
        parts = parts.repartition("part", share).sortWithinPartitions("part").mapInArrow(summed, "part int, counts binary")
    rank = np.zeros(slots, dtype=np.uint8)
    for r in parts.repartition("part").sortWithinPartitions("part").mapInArrow(ranked, "part int, rank binary").collect():  # a byte a slot
        rank[r.part * _PART : (r.part + 1) * _PART] = np.frombuffer(r.rank, dtype=np.uint8)
    return rows.where("part is null").select("doc_id", "n", "f", "g"), rank


def prefix(s: np.ndarray, rank: np.ndarray, percent: int) -> np.ndarray:
    """The first n - ceil(t n) + 1 shingles of a set in the global order."""
    p = len(s) + percent * len(s) // -100 + 1
    if p >= len(s):
        return s
    key = rank[_slot(s, len(rank))]
    edge = np.partition(key, p - 1)[p - 1]
    below = s[key < edge]
    return np.concatenate([below, np.sort(s[key == edge])[: p - len(below)]])


def _runs(n: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
    """Runs of ascending sizes that are near enough to the first of the run to link with it."""
    at = 0
    while at < len(n):
        stop = int(np.searchsorted(n, n[at] * 100 // percent, side="right"))
        yield at, stop
        at = stop


def _whole(batches: Iterator[pa.RecordBatch], names: tuple[str, ...], keys: int) -> Iterator[list[np.ndarray]]:
    """Columns of batches that are sorted by the first `keys` of them, cut where those change."""
    carry = [np.empty(0, np.int64)] * len(names)
    for batch in batches:
        if not batch.num_rows:
            continue
        now = [np.concatenate([c, batch.column(k).to_numpy()]) for c, k in zip(carry, names, strict=True)]
        same = np.ones(len(now[0]), dtype=bool)
        for c in now[:keys]:
            same &= c == c[-1]
        cut = len(same) - int(same[::-1].argmin()) if not same.all() else 0
        if cut:
            yield [c[:cut] for c in now]
        carry = [c[cut:] for c in now]
    if len(carry[0]):
        yield carry


def lists(docs: DataFrame, rank: Broadcast, size: int, percent: int, hot: int) -> DataFrame:
    """Prefix lists of two sets or more: (token, id, n, m, star, salt). id: a document of the set, the same
    in all lists; m: how many sets the list has; star: for lists longer than SHORT the set of the
    list that this one is compared with first. The list of a shingle that `hot` documents or more may have (by
    the sketch) is dealt out by fingerprint, about `hot` to a part, and counts as long; salt: its part, else null."""
    shards = np.maximum(1, 2.0 ** (np.arange(256) / _STEP) // hot).astype(np.int64)
    dealing = bool(shards[rank.value.max()] > 1)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int, int]] = set()  # sets of this partition
        for batch in slices(batches, "text"):
            token, salt, n, frag, ids = [], [], [], [], []
            for doc, s in zip(batch.column("doc_id").to_pylist(), _texts(batch, size), strict=True):
                mark = (len(s), *_print(s))
                if doc is None or not len(s) or mark in seen:
                    continue
                seen.add(mark)
                p = prefix(s, rank.value, percent)
                token.append(p.view(np.int64))
                if dealing:
                    parts = shards[rank.value[_slot(p, len(rank.value))]]
                    salt.append(np.where(parts > 1, (mark[1] >> 8) % parts, -1))
                else:
                    salt.append(np.full(len(p), -1))
                for column, value in ((n, len(s)), (frag, mark[1]), (ids, doc)):
                    column.append(np.full(len(p), value, dtype=np.int64))
            if token:
                yield pa.record_batch([pa.array(np.concatenate(c)) for c in (token, salt, n, frag, ids)], names=["token", "salt", "n", "f", "id"])

    dealt = docs.select("doc_id", "text").mapInArrow(made, "token long, salt long, n long, f long, id long")
    dealt = dealt.repartition("token", "salt").sortWithinPartitions("token", "salt", "n", "f", "id")

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Equal sets once, lists of one gone unless they are parts of a longer one."""
        for t, salt, n, f, i in _whole(batches, ("token", "salt", "n", "f", "id"), 2):
            new = np.ones(len(t), dtype=bool)
            new[1:] = (t[1:] != t[:-1]) | (salt[1:] != salt[:-1]) | (n[1:] != n[:-1]) | (f[1:] != f[:-1])
            t, salt, n, i = t[new], salt[new], n[new], i[new]
            first = np.flatnonzero(np.append(True, (t[1:] != t[:-1]) | (salt[1:] != salt[:-1])))
            m = np.diff(np.append(first, len(t)))
            m = np.where(salt[first] >= 0, np.maximum(m, SHORT + 1), m)
            ends = np.append(first[1:], len(t))
            star = np.full(len(t), -1, dtype=np.int64)
            for lo, hi in zip(first[m > SHORT], ends[m > SHORT], strict=True):
                for a, b in _runs(n[lo:hi], percent):
                    star[lo + a + 1 : lo + b] = i[lo + a]
            m = np.repeat(m, ends - first)
            keep = m > 1
            if keep.any():
                yield pa.record_batch([pa.array(x[keep]) for x in (t, i, n, m)] + [pa.array(star[keep], mask=star[keep] < 0), pa.array(salt[keep], mask=salt[keep] < 0)], names=["token", "id", "n", "m", "star", "salt"])

    return saved(dealt.mapInArrow(chosen, "token long, id long, n long, m long, star long, salt long"), "lists")


def centres(long: DataFrame, percent: int) -> DataFrame:
    """Pairs (query, target) among the centres of the parts that a list was dealt out in."""

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, n, i in _whole(batches, ("token", "n", "id"), 1):
            first = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
            star = np.full(len(t), -1, dtype=np.int64)
            for lo, hi in zip(first, np.append(first[1:], len(t)), strict=True):
                for a, b in _runs(n[lo:hi], percent):
                    star[lo + a + 1 : lo + b] = i[lo + a]
            keep = star >= 0
            if keep.any():
                yield pa.record_batch([pa.array(star[keep]), pa.array(i[keep])], names=["query", "target"])

    parts = long.where("salt is not null and star is null").select("token", "n", "id")
    return parts.repartition("token").sortWithinPartitions("token", "n", "id").mapInArrow(met, "query long, target long")


def pairs(short: DataFrame, percent: int) -> DataFrame:
    """Pairs (query, target) of sets that may link, from lists (token, id, n) of at most SHORT sets.

    Let T be what two sets must share. Of the set whose prefix ends first in the global order, all
    shared shingles outside both prefixes are among its ceil(t n) - 1 others, so the prefixes share
    at least T less that many. A pair that also shares a long list isn't lost: it is met there."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, n, i in _whole(batches, ("token", "n", "id"), 1):
            first = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
            many = np.diff(np.append(first, len(t)))
            m, place = np.repeat(many, many), np.arange(len(t)) - np.repeat(first, many)
            for step in range(1, int(m.max())):
                a = np.flatnonzero(place + step < m)
                b = a + step
                a, b = a[n[b] * percent <= n[a] * 100], b[n[b] * percent <= n[a] * 100]
                if len(a):
                    swap = i[a] > i[b]
                    lo, hi = np.where(swap, b, a), np.where(swap, a, b)
                    yield pa.record_batch([pa.array(x) for x in (i[lo], i[hi], n[lo], n[hi])], names=["query", "target", "qn", "tn"])

    dealt = short.select("token", "n", "id").repartition("token").sortWithinPartitions("token", "n", "id")
    met = dealt.mapInArrow(made, "query long, target long, qn long, tn long")
    met = met.groupBy("query", "target", "qn", "tn").agg(F.count(F.lit(1)).alias("c"))
    need = F.ceil((F.col("qn") + F.col("tn")) * percent / (100 + percent))
    others = F.ceil(F.greatest("qn", "tn") * percent / 100) - 1
    return met.where(F.col("c") >= need - others).select("query", "target")


def texts_of(units: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, text) of the sets that units name, each once, as a saved table."""
    wanted = saved(units.select("id").distinct(), "wanted")
    texts = docs.select(F.col("doc_id").alias("id"), "text").join(small(wanted), "id", "left_semi")
    return saved(texts.dropDuplicates(["id"]), "texts")


def _early(also: list[int] | None, u: int, places: dict[int, int], query: bool) -> int:
    """The lists before list u that hold a set, as bits; those without a query don't matter."""
    early = [t for t in also or () if t < u]
    if query:
        for t in early:
            places.setdefault(t, len(places))
    return sum(1 << places[t] for t in early if t in places)


def hopeful(units: DataFrame, texts: DataFrame, rank: Broadcast, size: int, percent: int) -> DataFrame:
    """Of units (see searched) the rows whose prefixes allow a link with another row of the unit that they aren't
    joined with. Here prefixes travel with the rows, by 32 bits a shingle: shingles that fall together
    only leave more rows. So texts go to the units that they may link in, not to all. PART queries and their
    targets make a unit of their own."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = list(_texts(batch, size))
            marks = [np.sort((prefix(s, rank.value, percent) >> np.uint64(32)).astype("<u4")).tobytes() for s in sets]
            yield pa.record_batch([batch.column("id"), pa.array(map(len, sets), pa.int64()), pa.array(marks, pa.binary())], names=["id", "n", "prefix"])

    signs = saved(texts.mapInArrow(signed, "id long, n long, prefix binary"), "signs")
    n = 2 * int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = units.join(signs, "id").select(*units.columns, "n", "prefix")
    rows = rows.repartition(n, "u", "v", "w").sortWithinPartitions("u", "v", "w", "target")
    names = units.columns

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit = None
        queries: list[tuple] = []  # row, comp, bits, n, prefix
        targets: list[tuple] = []
        places: dict[int, int] = {}
        hit: set[int] = set()  # queries that may link
        part = 1 << 20  # numbers of parts of a unit come after the unit's own

        def search() -> pa.RecordBatch | None:
            marks = [t[4] for t in targets]
            prefixes = Prefixes(marks, np.array([t[3] for t in targets]), percent)
            comps, bits = np.array([t[1] for t in targets]), [t[2] for t in targets]
            wanted = np.zeros((len(targets), -(-len(queries) // PART)), dtype=bool)
            for k, (_, comp, early, m, mark) in enumerate(queries):
                near = prefixes.candidates(m, mark)
                near = near[comps[near] != comp]
                if early:
                    near = near[[not early & bits[i] for i in near]]
                if len(near):
                    hit.add(k)
                    wanted[near, k // PART] = True
            kept = [placed(targets[i][0], int(s)) for i, s in zip(*np.nonzero(wanted), strict=True)]
            targets.clear()
            return table(kept)

        def placed(row: tuple, s: int) -> tuple:
            return (*row[:2], row[2] * part + s, *row[3:])

        def table(kept: list[tuple]) -> pa.RecordBatch | None:
            if not kept:
                return None
            types = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*kept, strict=True), types, strict=True)], names=names)

        def close() -> Iterator[pa.RecordBatch]:
            if targets and (out := search()) is not None:
                yield out
            if (out := table([placed(queries[k][0], k // PART) for k in sorted(hit)])) is not None:
                yield out
            queries.clear()
            places.clear()
            hit.clear()

        for batch in batches:
            for *row, m, mark in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                u, v, w, target, i, comp, also = row
                if (u, v, w) != unit:
                    if unit is not None:
                        yield from close()
                    unit = (u, v, w)
                side = targets if target else queries
                side.append((tuple(row), i if comp is None else comp, _early(also, u, places, not target), m, np.frombuffer(mark, "<u4")))
                if target and len(targets) >= BLOCK and (out := search()) is not None:
                    yield out
        if unit is not None:
            yield from close()

    ddl = "u long, v long, w long, target boolean, id long, comp long, lists array<long>"
    return saved(rows.mapInArrow(made, ddl), "hopeful")


def searched(units: DataFrame, texts: DataFrame, rank: Broadcast, size: int, percent: int) -> DataFrame:
    """Exact links (a, b) found in units of work (u, v, w, target, id, comp, lists), a saved table: all
    queries of a unit are searched for in an index of those of its targets whose prefixes allow a link,
    that aren't joined with the query yet (by links found before or by comp, if that is not null) and
    that share no list before this one with it.
    Of the links, those come back that join something in the unit."""
    rows = units.join(texts, "id")
    n = 2 * int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, much work
    rows = rows.repartition(n, "u", "v", "w").sortWithinPartitions("u", "v", "w", "target")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit = None
        queries: list[tuple[int, np.ndarray, int]] = []
        targets: list[tuple[int, np.ndarray, int]] = []
        groups = Groups()
        places: dict[int, int] = {}
        found: list[tuple[int, int]] = []

        def search() -> None:
            """Every query against the targets that it isn't joined with yet."""
            sets = [s for _, s, _ in targets]
            prefixes = Prefixes([prefix(s, rank.value, percent) for s in sets], np.array(list(map(len, sets))), percent)
            for q, s, early in queries:
                own = groups.root(q)
                near = prefixes.candidates(len(s), prefix(s, rank.value, percent)).tolist()
                near = [i for i in near if not early & targets[i][2] and groups.root(targets[i][0]) != own]
                if near:
                    hits = (targets[near[i]][0] for i in Index([sets[i] for i in near]).search(s, percent))
                    found.extend((q, t) for t in hits if groups.join(q, t))
            targets.clear()

        def close() -> pa.RecordBatch | None:
            if targets:
                search()
            out = None
            if found:
                out = pa.record_batch([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b"])
            queries.clear()
            groups.parent.clear()
            places.clear()
            found.clear()
            return out

        for whole in batches:
            for batch in slices(iter([whole]), "text"):
                columns = [batch.column(c).to_pylist() for c in ("u", "v", "w", "target", "id", "comp", "lists")]
                for u, v, w, target, i, comp, also, s in zip(*columns, _texts(batch, size), strict=True):
                    if (u, v, w) != unit:
                        if unit is not None and (out := close()) is not None:
                            yield out
                        unit, held = (u, v, w), 0
                    if comp is not None:
                        groups.join(i, comp)  # a component is known by one of its sets
                    (targets if target else queries).append((i, s, _early(also, u, places, not target)))
                    held += len(s) * target
                    if target and (len(targets) >= BLOCK or held > INDEX):
                        search()
                        held = 0
        if unit is not None and (out := close()) is not None:
            yield out

    return saved(rows.mapInArrow(made, "a long, b long"), "links")


def _salted(edges: DataFrame) -> DataFrame:
    """Units of one query each for edges (query, target): a query with many targets has a unit for
    each SPREAD of them."""
    many = saved(edges.groupBy("query").agg(F.ceil(F.count(F.lit(1)) / SPREAD).alias("blocks")).where("blocks > 1"), "many")
    dealt = edges.join(small(many), "query", "left").withColumn("v", F.pmod(F.xxhash64("target"), F.coalesce("blocks", F.lit(1).cast("long"))))
    fixed = [F.lit(-1).cast("long").alias("w"), F.lit(None).cast("long").alias("comp"), F.lit(None).cast("array<long>").alias("lists")]
    targets = dealt.select(F.col("query").alias("u"), "v", F.lit(True).alias("target"), F.col("target").alias("id"), *fixed)
    queries = dealt.select(F.col("query").alias("u"), "v", F.col("query").alias("id")).distinct()
    return targets.unionByName(queries.select("u", "v", F.lit(False).alias("target"), "id", *fixed))


def _blocked(long: DataFrame, joined: DataFrame) -> DataFrame:
    """Units for long lists (token, id) that hold more than one component: what is outside a list's
    largest component, by blocks, against the whole list, by blocks. Lists of the same sets are
    searched once; `lists` are a set's open lists, by which a pair is searched in its first one only."""
    at = long.join(joined, F.col("id") == F.col("node"), "left").select("token", "id", F.coalesce("component", "id").alias("comp"))
    at = saved(at, "labelled")
    by = at.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("c"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("mark"))
    by = by.groupBy("token").agg(F.max_by("comp", F.struct("c", "comp")).alias("top"), F.max("c").alias("c"), F.sum("c").alias("m"), F.sum("mark").alias("mark"), F.count(F.lit(1)).alias("comps"))
    by = by.where("comps > 1").groupBy("mark", "m", "top", "c").agg(F.min("token").alias("token"))
    by = by.select("token", "top", F.ceil((F.col("m") - F.col("c")) / BLOCK).alias("nq"), F.ceil(F.col("m") / BLOCK).alias("nt"))
    rows = at.join(small(saved(by, "open")), "token")
    own = rows.groupBy("id").agg(F.sort_array(F.collect_set("token")).alias("lists"))  # of a prefix, so bounded by the text
    rows = rows.join(own, "id")
    block = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    to = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    queries = rows.where("comp != top").withColumn("v", block("nq")).withColumn("w", to("nt")).withColumn("target", F.lit(False))
    targets = rows.withColumn("w", block("nt")).withColumn("v", to("nq")).withColumn("target", F.lit(True))
    names = ("u", "v", "w", "target", "id", "comp", "lists")
    return queries.withColumnRenamed("token", "u").select(*names).unionByName(targets.withColumnRenamed("token", "u").select(*names))


def _numbered(docs: DataFrame, size: int, percent: int, hot: int) -> DataFrame:
    """near_duplicates() of documents whose doc_id doesn't tell sets apart, by numbers of their rows."""
    rows = saved(docs.withColumn("row", F.monotonically_increasing_id()), "rows")
    got = near_duplicates(rows.select(F.when(F.col("doc_id").isNotNull(), F.col("row")).alias("doc_id"), "text"), size=size, percent=percent, hot=hot)
    got = saved(got.toDF("row", "n_shingles", "of"), "numbered")
    known = got.where("row is not null").join(rows.where("doc_id is not null").select("row", "doc_id"), "row")
    least = saved(known.groupBy("of").agg(F.min("doc_id").alias("component_id")), "least")
    known = known.join(small(least), "of").select("doc_id", "n_shingles", "component_id")
    none = F.lit(None).cast("long")
    return known.unionByName(got.where("row is null").select(none.alias("doc_id"), "n_shingles", none.alias("component_id")))


def near_duplicates(docs: DataFrame, *, size: int = 5, percent: int = 80, hot: int = HOT) -> DataFrame:
    """For documents (doc_id, text): doc_id, n_shingles and component_id, a row for each row.

    A set is the distinct runs of `size` words (see shingles); with fewer words it is the whole sequence;
    without words or text (null too) it is empty and links with nothing. Documents link when
    100 * intersection >= percent * union; component_id is the smallest doc_id that links reach.
    Rows with null doc_id link with nothing and have a null component. Repeated rows stay. Rows of one
    doc_id with different texts are documents of their own, each with the component of its text. hot: see
    lists; results don't depend on it."""
    docs = docs.select("doc_id", "text")
    sets, ranks = scan(docs, size, slots_for(docs.count()))
    several = sets.where("doc_id is not null and n > 0").groupBy("doc_id").agg(*(f(c).alias(f"{k}_{c}") for c in "nfg" for k, f in (("min", F.min), ("max", F.max))))
    if several.where("min_n < max_n or min_f < max_f or min_g < max_g").limit(1).count():
        return _numbered(docs, size, percent, hot)
    rank = docs.sparkSession.sparkContext.broadcast(ranks)
    usable = sets.where("doc_id is not null and n > 0")
    reps = usable.groupBy("n", "f", "g").agg(F.min("doc_id").alias("rep"))
    listed = lists(docs, rank, size, percent, hot)
    short, long = listed.where(F.col("m") <= SHORT), listed.where(F.col("m") > SHORT)
    stars = long.where("star is not null").select(F.col("star").alias("query"), F.col("id").alias("target"))
    stars = stars.unionByName(centres(long, percent))
    edges = saved(pairs(short, percent).unionByName(stars.distinct()).distinct(), "pairs")
    units = saved(_salted(edges), "units")
    links = searched(units, texts_of(units, docs), rank, size, percent)
    units = saved(_blocked(long, components(links)), "blocks")
    texts = texts_of(units, docs)
    links = links.unionByName(searched(hopeful(units, texts, rank, size, percent), texts, rank, size, percent))

    # a list's id is some document of its set: translate to the smallest
    ends = links.select(F.col("a").alias("doc_id")).unionByName(links.select(F.col("b").alias("doc_id"))).distinct()
    named = saved(usable.join(small(saved(ends, "ends")), "doc_id", "left_semi").join(reps, ["n", "f", "g"]).select("doc_id", "rep").distinct(), "named")
    a, b = (named.select(F.col("doc_id").alias(x), F.col("rep").alias(f"rep_{x}")) for x in ("a", "b"))
    joined = components(links.join(a, "a").join(b, "b").select("rep_a", "rep_b"))
    found = reps.join(joined, F.col("rep") == F.col("node"), "left").select("n", "f", "g", F.coalesce("component", "rep").alias("component_id"))
    found = usable.select("n", "f", "g", "doc_id").join(found, ["n", "f", "g"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    rest = sets.where("doc_id is null or n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return found.unionByName(rest)
