"""Recall of the embedding search against brute force, for a folder of test tables:

    python -m sparrel.llm.recall /root/testdata/check_s

All pairs of a label are compared on the driver, by blocks, so this is for tables that fit there."""

from __future__ import annotations

import sys

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrel.llm import embeddings
from sparrel.llm.common import table


def exact_links(vectors: DataFrame, cosine: float = 0.98) -> int:
    """Links of all pairs of equal label, each counted from both ends."""
    rows = vectors.where(embeddings.usable() & F.col("vec_id").isNotNull()).select("label", "embedding").collect()
    by: dict[tuple, list] = {}
    for r in rows:
        by.setdefault((r.label, len(r.embedding)), []).append(r.embedding)
    total = 0
    for group in by.values():
        x = embeddings._normalised(np.array(group, dtype=np.float64))
        total += sum(int((x[at : at + 2048] @ x.T >= cosine).sum()) for at in range(0, len(x), 2048)) - len(x)
    return total


def recall(vectors: DataFrame) -> tuple[int, int]:
    """Links found, and links there are."""
    return embeddings.near_duplicates(vectors).agg(F.coalesce(F.sum("n_links"), F.lit(0))).first()[0], exact_links(vectors)


if __name__ == "__main__":
    spark = SparkSession.builder.master("local[*]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    for folder in sys.argv[1:]:
        found, there = recall(table(spark, folder, "embeddings"))
        print(f"{folder}: {found // 2} of {there // 2} links, recall {found / max(1, there):.6f}")
    spark.stop()
