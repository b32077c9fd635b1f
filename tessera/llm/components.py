"""Connected components of a large set of links, by alternating large and small stars.

Each step is a minimum per node and a join, so a node with very many links is summed up in
parts and its join can be split. The links are written to the shared folder after each step.

A few links, ``TASK_LINKS`` at most, are left to one task instead, which joins sets: each step of the stars is some ten exchanges,
and for each of these Spark's driver keeps a thread for a minute.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ship, stage, unstage

#: Links that one task takes.
TASK_LINKS = 50_000


def _by_sets(links: DataFrame) -> DataFrame:
    """``id`` and ``label`` of few links, by one task: of two sets that a link joins, the one with the greater least node goes to the other."""
    ship(links.sparkSession)

    def run(batches):
        above: dict[int, int] = {}

        def least(x: int) -> int:
            while (up := above.get(x, x)) != x:
                above[x] = x = above.get(up, up)
            return x

        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                if (x := least(a)) != (y := least(b)):
                    above[max(x, y)] = min(x, y)
        ids = sorted(above)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([least(x) for x in ids], pa.int64())], names=["id", "label"])

    return links.coalesce(1).mapInArrow(run, "id long, label long")


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Large: a node's greater neighbours move to its least one. Small: its lesser neighbours and itself do."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        both = links.select(F.col("b").alias("u"), F.col("a").alias("v"))  # a < b
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = both.join(least, "u")
    if large:
        out = moved.filter(F.col("v") > F.col("u")).select("m", "v")
    else:
        out = moved.select("m", "v").unionByName(least.select("m", F.col("u").alias("v")))
    return out.filter(F.col("m") != F.col("v")).select(F.least("m", "v").alias("a"), F.greatest("m", "v").alias("b")).distinct()


def components(links: DataFrame, most: int | None = None) -> DataFrame:
    """For links (a, b), a < b, ``most`` at most: ``id`` and ``label``, the least node it reaches, for each node that isn't that itself."""
    links = stage(links.select("a", "b").distinct(), "links", most)
    fingerprint = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
    before = fingerprint(links)
    if before[0] <= TASK_LINKS:
        labels = stage(_by_sets(links), "sets")
        unstage(links)
        return labels
    while before[0]:
        step = stage(_star(_star(links, True), False), "links", before[0])  # a star has no more links than there were
        after = fingerprint(step)
        unstage(links)
        links = step
        if after == before:
            break
        before = after
    return links.select(F.col("b").alias("id"), F.col("a").alias("label"))
