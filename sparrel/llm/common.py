"""What the operators share: scratch tables, checked broadcasts, whole-text batches and
distributed connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrel.sources.scratch import scratch

#: Rows up to which a table of ids or of edges may be broadcast (16 bytes a row: 16 MB at most).
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the application's scratch folder, which all executors share, and read it back:
    lineage ends here, and what was written survives the loss of any executor. The folder goes with the driver."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Hint a broadcast if df has BROADCAST_ROWS rows or fewer of plain numbers; else leave it to a
    shuffled join. df should be cheap to count, such as a saved table."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def fields(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def extended(df: DataFrame, added: dict[str, str]) -> str:
    """The schema of df with columns added, or replaced where the names are the same."""
    kept = [f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name not in added]
    return ", ".join([*kept, *(f"`{k}` {v}" for k, v in added.items())])


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches where the text of a slice would exceed `most` bytes; a longer text has a
    slice of its own. No row is lost, no text is cut."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        import pyarrow.compute as pc

        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(size)
        at = 0
        while at < n:
            stop = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right"))
            stop = min(n, max(at + 1, stop))
            yield batch.slice(at, stop - at)
            at = stop


class Groups:
    """Disjoint groups of numbers, each known by its smallest."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        up = parent.setdefault(x, x)
        while up != x:
            parent[x] = up = parent[up]
            x, up = up, parent[up]
        return x

    def join(self, a: int, b: int) -> bool:
        """Whether a and b were in two groups, which are one from now on."""
        x, y = self.root(a), self.root(b)
        if x != y:
            self.parent[max(x, y)] = min(x, y)
        return x != y


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def pairs() -> Iterator[tuple[int, int]]:
        for batch in batches:
            yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)

    groups = Groups()
    kept = [p for p in pairs() if groups.join(*p)]
    if kept:
        lo, hi = zip(*kept, strict=True)
        yield pa.record_batch([pa.array(lo, pa.int64()), pa.array(hi, pa.int64())], names=["lo", "hi"])


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a long, b long): returns (node, component), with the
    smallest node of each component, for every node of an edge between two different nodes.

    Partitions first reduce their edges to a forest. Then large-star and small-star steps alternate;
    each is an aggregation and a join by node, so no group is collected, and each round is saved
    in the shared folder; a node with very many edges is a skewed key, which adaptive execution splits. The driver
    sees counts and checksums only; that a round changed nothing is settled by comparing its edges."""
    a, b = edges.columns[:2]
    edge = edges.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"))
    edge = saved(edge.mapInArrow(_forest, "lo long, hi long").distinct(), "edges")
    state = before = None
    while True:
        got = edge.agg(F.count(F.lit(1)), F.sum(F.xxhash64("lo", "hi") % 1_000_003)).first()
        if not got[0] or tuple(got) == state and edge.join(before, ["lo", "hi"], "left_anti").isEmpty():
            return edge.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(
                edge.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
            )
        state, before = tuple(got), edge
        both = edge.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionAll(edge.select("hi", "lo"))
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        low = large.join(least, "hi").where("lo != m").select(F.col("m").alias("lo"), F.col("lo").alias("hi"))
        edge = saved(low.unionByName(least.select(F.col("m").alias("lo"), "hi")).distinct(), "edges")
