"""Shared plumbing of the training-data operators: tables, lineage cuts, small numpy helpers."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.runtime import ship_package

#: One white-space class for all word-based operators (space, tab to carriage return).
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir.

    Where that is unset, local mode (tests) takes a folder of this machine; a cluster must set it.
    """
    set_by_cluster = spark.conf.get("spark.checkpoint.dir", None)
    if set_by_cluster:
        return set_by_cluster.rstrip("/")
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="gridloom-"))
    return sc.getCheckpointDir().rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/gridloom/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and rereads it: the lineage ends in files that outlive executors."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._gridloom_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes the files behind a materialize() result that nothing reads any more."""
    path = getattr(df, "_gridloom_path", None)
    if path:
        spark = df.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def whole_text(col: str = "text"):
    """Null texts count as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names for new columns beside those of df: with underscores behind them where df has them already."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def hashed_sample(df: DataFrame, *key: str, most: int, rows: int) -> DataFrame:
    """Rows of df, which has `rows`, whose key hashes lowest: all of them up to `most`, else a share that stays below it.

    A filter, so nothing is sorted and each task hands on only its share. The share aims
    four standard deviations below `most`. Rows of one key stay or go together.
    """
    if rows <= most:
        return df
    share = (most - 4 * most**0.5) / rows
    return df.where(F.xxhash64(*key, F.lit(1)) < F.lit(int((share - 0.5) * 2.0**64)).cast("long"))


def union_pairs(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the sets of i[k] and j[k] in a parent array whose entries point straight at set minima."""
    while True:
        a, b = parent[i], parent[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent[:] = up


def group_slices(*keys: np.ndarray):
    """(start, stop) of each run of equal keys in arrays sorted by them."""
    n = len(keys[0])
    if not n:
        return
    new = np.zeros(n, bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    starts = np.flatnonzero(new)
    yield from zip(starts, np.append(starts[1:], n))


def whole_groups(batches, keys: list[str]):
    """Regroups an iterator of sorted frames so that no run of equal keys is cut in two."""
    import pandas as pd

    held = []
    for pdf in batches:
        if not len(pdf):
            continue
        last = np.ones(len(pdf), bool)
        for k in keys:
            last &= (pdf[k] == pdf[k].iloc[-1]).to_numpy()
        cut = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
        if cut == 0 and held and all(held[-1][k].iloc[-1] == pdf[k].iloc[0] for k in keys):
            held.append(pdf)
            continue
        ready = pd.concat([*held, pdf.iloc[:cut]], ignore_index=True)
        if len(ready):
            yield ready
        held = [pdf.iloc[cut:]]
    if held:
        yield pd.concat(held, ignore_index=True)


def even_keys(n: int) -> list[int]:
    """n integers, the i-th of which Spark's hash partitioning into n deals to partition i."""
    k = np.arange(64 * n, dtype=np.uint32)
    turn = lambda x, r: (x << np.uint32(r)) | (x >> np.uint32(32 - r))
    # Murmur3 of one 32-bit integer with seed 42, as Spark's hash() computes it
    h = turn(k * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593) ^ np.uint32(42)
    h = (turn(h, 13) * np.uint32(5) + np.uint32(0xE6546B64)) ^ np.uint32(4)
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(16)
    at = np.mod(h.view(np.int32).astype(np.int64), n)
    found, first = np.unique(at, return_index=True)
    return [int(k[f]) for f in first] if len(found) == n else list(range(n))


HOT = 200  #: rows up to which the rows of one key may meet in a task whatever their share
MANY = 4096  #: keys at most that hold more rows and are broadcast


def with_least(rows: DataFrame, key: str, value: str | Column, rows_in_all: int, used: list | None = None) -> DataFrame:
    """rows with `m`, the least value of their key; rows of a null key go.

    Keys with over rows_in_all / MANY rows (and HOT), of which there are MANY at most, get theirs by
    broadcast, so their rows stay where they are; the others meet theirs in a shuffle. The minima are
    written first: a plan that makes them anew in each branch grows fivefold with every call, and the
    driver keeps all plans. used: gets the table of minima, to discard when the result has been written.
    """
    limit = max(HOT, rows_in_all // MANY)
    least = materialize(rows.groupBy(key).agg(F.min(value).alias("m"), F.count(F.lit(1)).alias("_d")), "least")
    if used is not None:
        used.append(least)
    if (least.where(f"{key} is not null").agg(F.max("_d")).first()[0] or 0) <= limit:
        return rows.join(least.select(key, "m").hint("merge"), key)
    hot = F.broadcast(least.where(F.col("_d") > limit).select(key, "m"))
    rest = rows.join(hot.drop("m"), key, "left_anti").join(least.where(F.col("_d") <= limit).select(key, "m").hint("merge"), key)
    return rest.unionByName(rows.join(hot, key))


def tiled(df: DataFrame, keys: list[str], by: str, cap: int) -> DataFrame:
    """Deals the members of each bucket to square tiles of about cap x cap members.

    A bucket of more than `cap` members becomes c = ceil(n / cap) chunks; the tile
    (i, j) with i <= j holds chunks i and j, so each pair of the bucket meets in
    exactly one tile and no task holds more than about 2 * cap members of a bucket.
    Adds `tile` and `side` (0: chunk i, 1: chunk j). Buckets of one member go.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    parts = F.ceil(F.col("_n") / F.lit(cap)).cast("int")
    return (
        df.join(counts, keys)
        .withColumn("_c", parts)
        .withColumn("_m", F.expr(f"int(pmod(xxhash64({by}, 17L), _c))"))
        .withColumn(
            "_t",
            F.explode(
                F.expr(
                    "transform(sequence(0, _c - 1), o -> named_struct("
                    "'tile', least(o, _m) * _c + greatest(o, _m), 'side', if(_m > o, 1, 0)))"
                )
            ),
        )
        .select(*df.columns, F.col("_t.tile").alias("tile"), F.col("_t.side").alias("side"))
    )
