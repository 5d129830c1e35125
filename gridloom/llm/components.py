"""Distributed connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import discard, materialize, with_least


def connected_components(edges: DataFrame, label: str = "components") -> DataFrame:
    """Component of each node that some edge names.

    edges: two columns `a`, `b` of long node names, in either order; nulls and loops
    are left out. Returns (node, component), component being the smallest node name
    reached. Every step of a round writes its table to the shared folder, so lineage and
    plans stay short, and only counts and a checksum come to the driver. Node minima are
    partial aggregates; the joins on a node key are plain equi-joins, which adaptive
    execution splits when a node has very many neighbours.
    """
    pairs = (
        edges.where("a is not null and b is not null and a <> b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )
    now, mark = materialize(pairs, label), None
    while True:
        seen = now.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first()
        if tuple(seen) == mark or not seen[0]:
            break
        mark = tuple(seen)
        both, used = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b"))), [now]
        large = with_least(both, "a", "b", 2 * seen[0], used).where("b > a").select(F.least("m", "a").alias("a"), "b").distinct()
        large = materialize(large, label)
        small = (
            with_least(large, "b", "a", seen[0], used)
            .select(F.explode(F.array(F.struct("m", F.col("a").alias("y")), F.struct("m", F.col("b").alias("y")))).alias("e"))
            .select(F.col("e.m").alias("a"), F.col("e.y").alias("b"))
            .where("a <> b")
            .distinct()
        )
        after = materialize(small, label)
        for table in (large, *used):
            discard(table)
        now = after
    members = now.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return members.unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
