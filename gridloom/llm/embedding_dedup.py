"""Embedding near-dedup: random-hyperplane sign tables, exact cosine checks, distributed components.

Vectors of each dimension get a signature of `tables` times `bits` signs; in each table
those with equal bits form a bucket. Only signatures travel to the buckets at first. A
vector whose signature there is far from all others, by more than chance allows for a
pair at the threshold, is done with in that table; for the rest the vectors follow, and
pairs are compared exactly. Buckets are worked on in tiles of bounded size. A pair counts
in the first table in which its bits agree, so link counts need no pair list: a tile
returns one row per member (its new links) and a spanning forest of its links.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import group_slices, materialize, read_table, shuffle_width, tiled, union_pairs, whole_groups, with_least
from .components import connected_components

BUCKET = 1024  #: vectors that a bucket should hold on average
TILE = 4096  #: signatures a side of a tile holds, about
VECTORS = 256  #: vectors a side of a tile holds, about
MISS = 0.002  #: chance allowed to miss a pair exactly at the threshold
SIGNS = 128  #: of a signature at least
SPREAD = 5  #: standard deviations by which a pair's signatures may differ more than expected
FINE = 2.0**20  #: steps of a component when signs are taken


def plan_tables(n: int, threshold: float) -> tuple[int, int]:
    """(bits, tables): buckets of about BUCKET vectors, and a pair at the threshold missed with chance MISS at most."""
    bits = max(4, math.ceil(math.log2(max(1, n / BUCKET))))
    agree = (1 - math.acos(min(1.0, threshold)) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(MISS) / math.log1p(-agree)))


def hyperplanes(dim: int, signs: int) -> np.ndarray:
    """Normal vectors in whole steps, so that products with whole numbers are exact in any order of summation."""
    return np.rint(np.random.default_rng([dim, signs, 95]).standard_normal((dim, signs)) * 1024)


def unit_rows(vectors) -> np.ndarray:
    """Rows scaled to length 1 in double precision, safe for huge and tiny components."""
    x = np.array(vectors, np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def signatures(unit: np.ndarray, signs: int) -> np.ndarray:
    """One row of signs (0, 1) per vector."""
    return (np.rint(unit * FINE) @ hyperplanes(unit.shape[1], signs) > 0).astype(np.uint8)


def far_apart(signs: int, threshold: float) -> int:
    """Signs by which a pair at the threshold differs at most, but for chances of SPREAD standard deviations."""
    share = math.acos(min(1.0, threshold)) / math.pi
    return math.floor(signs * share + SPREAD * (signs * share * (1 - share)) ** 0.5)


def _buckets(signs: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """The bucket of each row of signs in each table."""
    return signs[:, : bits * tables].reshape(len(signs), tables, bits) @ (1 << np.arange(bits, dtype=np.int64))


def cosine_links(source: DataFrame, classes: DataFrame, n: int, threshold: float = 0.95) -> tuple[DataFrame, DataFrame]:
    """(links, forest): (row, n_new) to be summed by row, and edges (a, b) connecting what links connect.

    classes: `row` long and unique, `rep` (id of one of its vectors), `dim`, `copies` (how
    many vectors a link to this row counts for) and `sigs`, with signs for n vectors;
    source: (row, vec_id, vec), in which each class has its vector under the id rep. Only
    ids may be null. Empty tables give no rows.
    """
    bits, tables = plan_tables(n, threshold)
    signs = padded(bits * tables)
    limit = far_apart(signs, threshold)
    spark = source.sparkSession
    dtype = np.dtype(np.float32 if dict(source.dtypes)["vec"] == "array<float>" else np.float64)
    keys = ["dim", "t", "bucket"]

    def deal(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            bucket = _buckets(unpacked(pdf["sigs"]), bits, tables)
            for t in range(tables):
                yield pd.DataFrame({"row": pdf["row"], "dim": pdf["dim"], "t": t, "bucket": bucket[:, t], "sigs": pdf["sigs"]})

    def near(batches):
        for pdf in whole_groups(batches, [*keys, "tile"]):
            found = np.zeros(len(pdf), bool)
            sigs = np.frombuffer(b"".join(pdf["sigs"]), np.uint64).reshape(len(pdf), -1)
            bucket, table = _buckets(unpacked(pdf["sigs"]), bits, tables), pdf["t"].to_numpy()
            side = pdf["side"].to_numpy()
            for lo, hi in group_slices(*[pdf[k].to_numpy() for k in (*keys, "tile")]):
                left = np.flatnonzero(side[lo:hi] == 0) + lo
                right = np.flatnonzero(side[lo:hi] == 1) + lo
                right = right if len(right) else left
                for b in range(0, len(left), 256):
                    a = left[b : b + 256]
                    i, j = np.nonzero(np.bitwise_count(sigs[a, 0][:, None] ^ sigs[None, right, 0]) <= limit)
                    i, j = a[i], right[j]
                    apart = i != j
                    i, j = i[apart], j[apart]
                    close = np.zeros(len(i), np.int64)
                    for w in range(sigs.shape[1]):
                        close += np.bitwise_count(sigs[i, w] ^ sigs[j, w])
                    i, j = i[close <= limit], j[close <= limit]
                    first = ~(bucket[i, : table[lo]] == bucket[j, : table[lo]]).any(axis=1)
                    found[i[first]] = found[j[first]] = True
            at = np.flatnonzero(found)
            yield pdf.iloc[at][["row", *keys]]

    def compare(batches):
        for pdf in whole_groups(batches, [*keys, "tile"]):
            out = []
            for lo, hi in group_slices(*[pdf[k].to_numpy() for k in (*keys, "tile")]):
                one = pdf.iloc[lo:hi]
                unit = unit_rows(np.array(one["vec"].tolist(), dtype))
                bucket = _buckets(signatures(unit, signs), bits, tables)
                side, weight, t = one["side"].to_numpy(), one["copies"].to_numpy(), int(one["t"].iloc[0])
                left = np.flatnonzero(side == 0)
                right = np.flatnonzero(side == 1) if side.any() else left
                fresh, parent = np.zeros(hi - lo, np.int64), np.arange(hi - lo)
                for b in range(0, len(left), 256):
                    a = left[b : b + 256]
                    i, j = np.nonzero(unit[a] @ unit[right].T >= threshold - 1e-9)
                    i, j = a[i], right[j]
                    keep = (i != j) if right is not left else i < j
                    i, j = i[keep], j[keep]
                    keep = (np.einsum("ij,ij->i", unit[i], unit[j]) >= threshold) & ~(bucket[i, :t] == bucket[j, :t]).any(axis=1)
                    i, j = i[keep], j[keep]
                    np.add.at(fresh, i, weight[j])
                    np.add.at(fresh, j, weight[i])
                    union_pairs(parent, i, j)
                at = np.flatnonzero(fresh)
                row = one["row"].to_numpy()
                out.append(pd.DataFrame({"row": row[at], "n_new": fresh[at], "root": row[parent[at]]}))
            if out:
                yield pd.concat(out, ignore_index=True)

    def in_tiles(df: DataFrame, cap: int) -> DataFrame:
        dealt = tiled(df, keys, "row", cap).repartition(shuffle_width(spark), *keys, "tile")
        return dealt.sortWithinPartitions(*keys, "tile")

    seats = "row long, dim int, t int, bucket int"
    asked = in_tiles(classes.select("row", "dim", "sigs").mapInPandas(deal, f"{seats}, sigs binary"), TILE).mapInPandas(near, seats)
    asked = materialize(asked.distinct(), "cosine-asked")
    wanted = classes.select("row", "rep", "copies").join(asked.select("row").distinct(), "row", "left_semi")
    here = source.withColumnRenamed("row", "_row")
    vectors = here.join(wanted, (F.col("_row") == F.col("row")) & F.col("vec_id").eqNullSafe(F.col("rep"))).dropDuplicates(["row"]).select("row", "vec", "copies")
    met = in_tiles(asked.join(vectors, "row"), VECTORS).mapInPandas(compare, "row long, n_new long, root long")
    met = materialize(met, "cosine-links")
    return met.select("row", "n_new"), met.where("row <> root").select(F.col("root").alias("a"), F.col("row").alias("b"))


def unpacked(sigs) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b"".join(sigs), np.uint8).reshape(len(sigs), -1), axis=1)


def padded(signs: int) -> int:
    """Signs of a whole number of 64-bit words, SIGNS at least."""
    return max(SIGNS, -(-signs // 64) * 64)


def with_signs(vectors: DataFrame, signs: int) -> DataFrame:
    """(vec_id, row, dim, sigs) of (vec_id, row, vec): signs packed to bytes; null where vec is null."""
    dtype = np.dtype(np.float32 if dict(vectors.dtypes)["vec"] == "array<float>" else np.float64)

    def run(batches):
        for pdf in batches:
            dims = pdf["vec"].map(lambda v: 0 if v is None else len(v)).to_numpy(np.int64)
            sigs = np.full(len(pdf), None, object)
            for dim in np.unique(dims[dims > 0]):
                at = np.flatnonzero(dims == dim)
                packed = np.packbits(signatures(unit_rows(np.array(pdf["vec"].iloc[at].tolist(), dtype)), signs), axis=1)
                sigs[at] = [w.tobytes() for w in packed]
            yield pd.DataFrame({"vec_id": pdf["vec_id"].astype("Int64"), "row": pdf["row"].astype("Int64"), "dim": dims.astype(np.int32), "sigs": sigs})

    return vectors.select("vec_id", F.col("row").cast("long").alias("row"), "vec").mapInPandas(run, "vec_id long, row long, dim int, sigs binary")


def embedding_components(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector.

    Exact copies are one class first, so a group of copies costs one vector; a member
    links to all other members and to all members of linked classes. Vectors that are
    null, empty, zero or hold null or non-finite components link with nothing, not even
    with equal ones. Vectors of different lengths never link. Rows with a null id keep
    n_links, with a null component and kept false unless others name it; rows repeated
    with one id count as separate vectors of that id. Extra columns are not read. An
    empty table gives no rows. Equal vectors are told by 64 bits of a hash.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("vec"))
    fine = F.expr(
        "vec is not null and size(vec) > 0 and forall(vec, v -> v is not null and not isnan(v) and abs(v) < double('inf'))"
        " and exists(vec, v -> v <> 0)"
    )
    kind = dict(rows.dtypes)["vec"][6:-1]
    rows = rows.withColumn("vec", F.when(fine, F.expr(f"transform(vec, v -> if(v = 0, {kind}(0), v))")))
    # a vector's name; nothing else is told of it where it is not fine
    rows = rows.withColumn("row", F.when(F.col("vec").isNotNull(), F.xxhash64("vec")))
    n = rows.count()
    bits, tables = plan_tables(n, threshold)
    signed = materialize(with_signs(rows, padded(bits * tables)), "vector-signs")
    good = signed.where("row is not null")
    classes = good.groupBy("row").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("rep"), F.min("dim").alias("dim"), F.min("sigs").alias("sigs"))
    classes = materialize(classes, "vector-classes")
    found, forest = cosine_links(rows.where("row is not null"), classes, n, threshold)
    links = found.groupBy("row").agg(F.sum("n_new").alias("near"))
    member = connected_components(forest).withColumnRenamed("node", "row")
    grouped = classes.select("row", "rep", "copies").join(member, "row", "left").withColumn("root", F.coalesce("component", "row"))
    named = (
        with_least(materialize(grouped, "vector-grouped"), "root", "rep", n)
        .join(links, "row", "left")
        .select("row", F.col("m").alias("component_id"), (F.coalesce("near", F.lit(0)) + F.col("copies") - 1).alias("links"))
    )
    named = materialize(named, "vector-named")
    return (
        signed.select("vec_id", "row")
        .join(named, "row", "left")
        .select(
            "vec_id",
            F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
            F.when(F.col("row").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
    )

def op5_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    """Query: (vec_id, n_links, component_id, kept) of every vector, linked at cosine 0.95 or more."""
    return embedding_components(read_table(spark, sf_dir, "embeddings"))


#: All pairs by their cosine in double precision, and what they reach.
ORACLE_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
fine AS (SELECT * FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
n AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS size FROM fine),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_inner_product(a.e, b.e) / (a.size * b.size) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT v.vec_id, coalesce(k.n_links, 0) AS n_links, m.component_id, v.vec_id = m.component_id AS kept FROM v
JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) m ON m.a = v.vec_id LEFT JOIN (SELECT a, count(*) AS n_links FROM links GROUP BY a) k ON k.a = v.vec_id
"""
