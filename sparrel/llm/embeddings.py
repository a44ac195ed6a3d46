"""Near-duplicate embeddings: Euclidean p-stable hashing of normalised vectors in several tables, then
exact cosines in double precision.

Equal vectors of a label are one vector with a count. Tables make buckets of quantised random
projections; buckets of one vector go at once. Larger ones are cut into blocks by a hash of the id and
every pair of blocks is a unit of work of bounded size; a unit multiplies its two blocks and gives
back, for each vector, its number of links and one edge, so pairs are never written. A pair that meets
in several tables counts in the first of them only; a unit whose vectors all share a bucket of an
earlier table is done with.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparrel.llm.common import components, saved, small
from sparrel.llm.shingles import mix

#: Vectors of a block at most, on average: a unit of work has two blocks.
BLOCK = 512


def usable(embedding: str = "embedding", label: str = "label") -> Column:
    """Whether a row may link: label and vector not null, all components finite, not all zero."""
    c = F.col(embedding)
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(label).isNotNull() & c.isNotNull() & (F.size(c) > 0) & ~bad & F.exists(c, lambda x: x != 0)


def _vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All components one after another, and where each vector starts and the last one ends."""
    size = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.append(0, np.cumsum(size))


def _normalised(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def table_keys(x: np.ndarray, tables: int, projections: int, width: float, seed: int) -> np.ndarray:
    """For normalised vectors a 64-bit bucket key for each table (rows x tables)."""
    rng = np.random.default_rng(seed + x.shape[1])
    a, b = rng.normal(size=(x.shape[1], tables * projections)), rng.uniform(0, width, tables * projections)
    cells = np.floor((x @ a + b) / width).astype(np.int64).astype(np.uint64).reshape(len(x), tables, projections)
    key = mix(np.arange(tables, dtype=np.uint64) + np.uint64(1 + x.shape[1] * 1024))[None, :].repeat(len(x), 0)
    for k in range(projections):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + cells[:, :, k])
    return key.view(np.int64)


def _unit(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...] | None, table: int, cosine: float) -> tuple[np.ndarray, ...] | None:
    """Links within block a, or between blocks a and b, of (id, n, normalised vectors, keys), of pairs whose
    first common table is this one: id, an id linked with it (maybe over others), and its links here."""
    (ids, n, x, keys), (other_ids, m, y, other_keys) = a, b or a
    i, j = np.nonzero(x @ y.T >= cosine)
    if b is None:
        i, j = i[i != j], j[i != j]
    for t in range(table):
        first = keys[i, t] != other_keys[j, t]
        i, j = i[first], j[first]
    if not len(i):
        return None
    hit = np.zeros((len(ids), len(other_ids)), dtype=bool)
    hit[i, j] = True
    links = [hit @ n] if b is None else [hit @ m, n @ hit]
    low = [np.arange(len(ids)), np.arange(len(ids), len(ids) + len(other_ids))] if b else [np.arange(len(ids))]
    while True:  # lowest place by propagation
        least = np.minimum(low[0], np.where(hit, low[-1][None, :], low[0][:, None]).min(1))
        new = [least] if b is None else [least, np.minimum(low[1], np.where(hit, least[:, None], low[1][None, :]).min(0))]
        if all((p == q).all() for p, q in zip(low, new, strict=True)):
            break
        low = new
    all_ids, count, root = (np.concatenate(c) for c in ([ids, other_ids] if b else [ids], links, low))
    some = count > 0
    return all_ids[some], all_ids[root[some]], count[some]


def near_duplicates(vectors: DataFrame, *, cosine: float = 0.98, tables: int = 32, projections: int = 10, width: float = 1.0, seed: int = 5) -> DataFrame:
    """For vectors (vec_id, embedding, label): vec_id, n_links, component_id and kept, a row for each row.

    Rows of equal label link when found and of cosine >= `cosine`; a pair at distance d is found with
    probability 1 - (1 - p(width / d) ** projections) ** tables, which is 0.998 at cosine 0.98 and
    more above it. n_links counts the other rows that a row links with, component_id is the
    smallest vec_id that links reach, kept is whether it is the row's own. Rows that can't link (see
    usable) and rows with null vec_id have no links and are their own component. Vectors of
    different lengths don't link. Labels may be of any type that can be grouped."""
    rows = vectors.select("vec_id", "embedding", "label").withColumn("_ok", usable() & F.col("vec_id").isNotNull())
    # 128 bits that stand for label and vector where rows meet again
    marks = [F.xxhash64("label", "embedding").alias("_a"), F.xxhash64(F.lit(seed), "embedding", "label").alias("_b")]
    reps = rows.where("_ok").groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"))
    reps = reps.select("rep", "n", "embedding", F.xxhash64("label").alias("mark"), *marks)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pc.list_value_length(batch.column("embedding")).to_numpy(zero_copy_only=False)
            for d in np.unique(size):
                part = batch.filter(pa.array(size == d))
                flat, _ = _vectors(part.column("embedding"))
                key = table_keys(_normalised(flat.reshape(-1, d)), tables, projections, width, seed)
                key ^= part.column("mark").to_numpy()[:, None]
                keys = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1) * tables, pa.int32()), pa.array(key.ravel()))
                yield pa.record_batch([*(part.column(c) for c in ("rep", "n", "embedding", "_a", "_b")), keys], names=["rep", "n", "embedding", "_a", "_b", "keys"])

    kind = reps.schema["embedding"].dataType.simpleString()
    keyed = saved(reps.mapInArrow(hashed, f"rep long, n long, embedding {kind}, _a long, _b long, keys array<long>"), "keyed")

    buckets = keyed.select("rep", F.posexplode("keys").alias("t", "key"))
    shared = saved(buckets.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "shared")
    members = buckets.join(small(shared), "key").withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int"))
    members = members.withColumn("b", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    # a unit for each pair of blocks of a bucket; a member goes to those with its block
    units = members.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    units = units.select("key", "t", F.least("b", "o").alias("u"), F.greatest("b", "o").alias("v"), (F.col("b") > F.col("o")).alias("second"), "rep")
    units = saved(units, "units").join(keyed.select("rep", "n", "embedding", "keys"), "rep")
    units = units.repartition("key", "u", "v").sortWithinPartitions("key", "u", "v", "second")

    def multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held = None, []  # parts of a unit: second, table, dimension, id, n, components, keys
        found: list[tuple[np.ndarray, ...]] = []

        def put() -> None:
            second = np.concatenate([h[0] for h in held])
            ids, n, keys = (np.concatenate([h[k] for h in held]) for k in (3, 4, 6))
            table = held[0][1]
            if len({h[2] for h in held}) > 1 or len(ids) < 2 or unit[1] != unit[2] and (second.all() or not second.any()):
                return  # keys of vectors of several lengths that fall together, or one block alone
            if (keys[:, :table] == keys[0, :table]).all(0).any():
                return  # all in one bucket of an earlier table
            x = _normalised(np.concatenate([h[5] for h in held]).reshape(len(ids), -1))
            sides = [tuple(c[side] for c in (ids, n, x, keys)) for side in (~second, second)]
            got = _unit(sides[0], sides[1] if second.any() else None, table, cosine)
            if got is not None:
                found.append(got)

        def out() -> Iterator[pa.RecordBatch]:
            if found:
                yield pa.record_batch([pa.array(np.concatenate(c), pa.int64()) for c in zip(*found, strict=True)], names=["rep", "other", "links"])
                found.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            key, u, v, t, second, rep, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "u", "v", "t", "second", "rep", "n"))
            flat, start = _vectors(batch.column("embedding"))
            keys = batch.column("keys").flatten().to_numpy().reshape(len(key), tables)
            size = np.diff(start)
            cuts = np.flatnonzero((key[1:] != key[:-1]) | (u[1:] != u[:-1]) | (v[1:] != v[:-1]) | (size[1:] != size[:-1])) + 1
            for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                now = (key[lo], u[lo], v[lo])
                if now != unit:
                    if held:
                        put()
                    unit, held = now, []
                held.append((second[lo:hi], int(t[lo]), int(size[lo]), rep[lo:hi], n[lo:hi], flat[start[lo] : start[hi]], keys[lo:hi]))
            yield from out()
        if held:
            put()
        yield from out()

    links = saved(units.mapInArrow(multiplied, "rep long, other long, links long"), "links")
    count = links.groupBy("rep").agg(F.sum("links").alias("links"))
    joined = components(links.select("rep", "other")).withColumnRenamed("node", "rep")
    found = keyed.select("rep", "n", "_a", "_b").join(count, "rep", "left").join(joined, "rep", "left")
    found = found.select("_a", "_b", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("_n"), F.coalesce("component", "rep").alias("_c"))
    mine = rows.select("vec_id", *(F.when(F.col("_ok"), c).alias(f"_{k}") for k, c in zip("ab", marks, strict=True)))
    out = mine.join(found, ["_a", "_b"], "left")
    whole = F.coalesce("_c", "vec_id")
    return out.select("vec_id", F.coalesce("_n", F.lit(0)).cast("long").alias("n_links"), whole.alias("component_id"), F.coalesce(F.col("vec_id") == whole, F.lit(False)).alias("kept"))
