"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

Each source has a word budget: its share of all words by weight, at most `most` times
its own words. A document's expected copies are its source's ratio of budget to words,
tilted a little towards longer documents without changing the source's total. The whole
part is certain. The fractions p are an unequal-probability sample of fixed size in
words: documents rank by (u / (1 - u)) / (p / (1 - p)), u being a hash of the document,
and the longest prefix that fits the rest of the budget is taken, then the one document
whose size comes nearest to what is still open.

The prefix is found without a sorted pass over a source: word sums in coarse, then in
fine buckets of the ranking variable narrow each source to one bucket, and only that
bucket's rows are summed in order. No step gathers a source's rows in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._base import WORD, discard, materialize, read_table, whole_text

WEIGHTS = (5, 2, 1)  #: of the sources in order, repeating
MOST = 3  #: copies of a document, and a source's target over its size
FEW = 20_000  #: sources up to which tables of one row per source are broadcast; beyond, they join by shuffle
COARSE, FINE = 64, 1024  #: ranking buckets to a unit of the log rank, and parts of one of them


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, size) rows: water-filled shares of all words.

    Sources by code point, null last, carry the weights in turn. A source never gets
    more than `most` times its size; what that cuts off is shared anew by weight. One
    row per source is sorted; documents are only summed.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    cycle = F.array(*[F.lit(w) for w in weights])
    turn = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("w", F.element_at(cycle, (turn % len(weights) + 1).cast("int")).cast("long"))
    cap = F.lit(most).cast("long") * F.col("source_size")
    by = W.orderBy((cap / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before = by.rowsBetween(W.unboundedPreceding, -1)
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum(cap).over(before), F.lit(0))) / (
        F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0))
    )
    free = F.when(level * F.col("w") <= cap, level)
    per = per.withColumn("free", free)
    # the first source in this order that its share does not overfill sets the level for all after it
    lvl = F.first("free", ignorenulls=True).over(by.rowsBetween(W.unboundedPreceding, W.currentRow))
    target = F.when(lvl.isNull(), cap.cast("double")).otherwise(lvl * F.col("w"))
    return per.select("source", "source_size", target.alias("target"))


def chance(key: Column) -> Column:
    """A reproducible uniform number in (0, 1) from 52 bits of a key's MD5."""
    return (F.conv(F.substring(F.md5(key.cast("string")), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(2.0**52)


def repeated(docs: DataFrame, weights: tuple = WEIGHTS, most: int = MOST) -> DataFrame:
    """docs with every row as often as the mix takes it; the columns of docs stay.

    Rows that agree in id, source and size are taken alike. Of documents without words,
    which no target speaks of, one copy stays.
    """
    copies = mix_copies(docs, weights, most).groupBy("doc_id", "source", "size").agg(F.max("copies").alias("copies"))
    hashed = lambda d, s, n: F.xxhash64(d, F.coalesce(s, F.lit("")), s.isNull(), n)
    left = docs.select(F.struct(*docs.columns).alias("row"), hashed(F.col("doc_id"), F.col("source"), word_count(whole_text())).alias("key"))
    right = copies.select(hashed(F.col("doc_id"), F.col("source"), F.col("size")).alias("key"), F.when(F.col("size") == 0, 1).otherwise(F.col("copies")).cast("int").alias("copies"))
    right = right.groupBy("key").agg(F.max("copies").alias("copies"))
    joined = left.join(right, "key").where("copies > 0")
    return joined.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def mix_copies(docs: DataFrame, weights: tuple = WEIGHTS, most: int = MOST) -> DataFrame:
    """One row per document: (doc_id, source, size, source_size, target, copies, taken).

    size counts words, a null text has none; a source may be null. taken = size * copies
    and copies is at most `most`. Documents without words are never sampled. A null
    doc_id takes part under one hash. Repeated rows rank alike and are taken or left
    together. An empty table gives no rows. Extra
    columns are ignored.
    """
    sized = docs.select(
        "doc_id",
        "source",
        # a key that is never null, so that every join below is a plain equi-join
        F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), "source")).alias("skey"),
        word_count(whole_text()).alias("size"),
    )
    sized = materialize(sized, "sizes")
    # a document's tilt, in thousandths: 0 for no words, towards 1000 for many
    lean = F.expr("(size * 1000) div (size + 200)")
    budget = source_targets(sized, weights, most).withColumn(
        "skey", F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), "source"))
    )
    mean = sized.groupBy("skey").agg(F.try_divide(F.sum(F.col("size") * lean), F.sum("size").cast("double")).alias("mean_lean"))
    facts = materialize(budget.drop("source").join(mean, "skey"), "targets")
    few = facts.count() <= FEW
    per_source = lambda df: F.broadcast(df) if few else df
    rows = sized.join(per_source(facts), "skey")
    top = F.lit(float(most))
    ratio = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), top)).otherwise(0.0)
    rows = rows.withColumn("ratio", ratio).withColumn("lean", lean)
    tilt = F.least(F.col("ratio"), top - F.col("ratio"))
    expected = F.col("ratio") + tilt * (F.col("lean") - F.col("mean_lean")) / F.lit(1000.0)
    rows = rows.withColumn("expected", F.when(F.col("size") > 0, F.greatest(F.lit(0.0), F.least(expected, top))).otherwise(0.0))
    rows = rows.withColumn("sure", F.floor("expected").cast("long")).withColumn("p", F.col("expected") - F.floor("expected"))
    u = chance(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    rank = (u / (1 - u)) / (F.col("p") / (1 - F.col("p")))
    rows = rows.withColumn("rank", F.when((F.col("p") > 0) & (F.col("size") > 0), rank))
    spot = (F.log("rank") + 100) * COARSE
    rows = rows.withColumn("b1", F.floor(spot)).withColumn("b2", F.floor((spot - F.floor(spot)) * FINE))
    rows = ranked = materialize(rows.drop("ratio", "lean", "mean_lean", "expected"), "ranked")

    by_source = W.partitionBy("skey")
    # whole words that are open after the certain copies
    left = F.floor(F.max("target") - F.sum(F.col("sure") * F.col("size"))).cast("long")
    room = rows.groupBy("skey").agg(left.alias("room"))
    cand = rows.where("rank is not null").select("skey", "rank", "doc_id", "size", "b1", "b2")

    def boundary(parts: DataFrame, key: str, room: DataFrame) -> DataFrame:
        """(skey, key, room): the bucket in which a source's running sum first passes its room, and the room left at its start."""
        run = F.sum("words").over(by_source.orderBy(key).rowsBetween(W.unboundedPreceding, W.currentRow))
        over = parts.withColumn("run", run).join(per_source(room), "skey").where("run > room")
        hit = over.groupBy("skey").agg(F.min(F.struct(key, "run", "words", "room")).alias("h"))
        return hit.select("skey", F.col(f"h.{key}").alias(key), F.expr("h.room - h.run + h.words").alias("room"))

    first = boundary(cand.groupBy("skey", "b1").agg(F.sum("size").alias("words")), "b1", room)
    inner = materialize(cand.join(per_source(first), ["skey", "b1"]), "boundary")
    parts = inner.groupBy("skey", "b2").agg(F.sum("size").alias("words"))
    second = boundary(parts, "b2", inner.groupBy("skey").agg(F.max("room").alias("room")))
    last = inner.drop("room").join(per_source(second), ["skey", "b2"])
    run = F.sum("size").over(by_source.orderBy("rank", "doc_id", "size").rangeBetween(W.unboundedPreceding, W.currentRow))
    over = last.withColumn("run", run).where("run > room")
    # the first key that no longer fits; everything before it is taken
    stop = over.groupBy("skey").agg(F.min(F.struct("rank", "doc_id", "size")).alias("stop"))
    rows = rows.join(per_source(room.join(stop, "skey", "left")), "skey")
    me = F.struct("rank", "doc_id", "size")
    drawn = F.col("rank").isNotNull() & (F.col("stop").isNull() | (me < F.col("stop")))
    rows = materialize(rows.withColumn("drawn", F.coalesce(drawn, F.lit(False))).drop("stop", "b1", "b2"), "drawn")
    for table in (sized, facts, ranked, inner):
        discard(table)
    # the last gap goes to the one document whose size comes nearest, if that is nearer than none
    gap = rows.groupBy("skey").agg((F.max("room") - F.sum(F.when(F.col("drawn"), F.col("size")).otherwise(0))).alias("gap"))
    rest = rows.where("rank is not null and not drawn").groupBy("skey", "rank", "doc_id", "size").agg(F.count(F.lit(1)).alias("n"))
    rest = rest.join(per_source(gap), "skey").withColumn("off", F.abs(F.col("gap") - F.col("n") * F.col("size")))
    fits = rest.where((F.col("off") < F.abs("gap")) & (F.abs(F.col("gap") - F.col("size")) < F.abs("gap")))
    pick = fits.groupBy("skey").agg(F.min_by(me, F.struct("off", "rank", "doc_id", "size")).alias("pick"))
    rows = rows.join(per_source(pick), "skey", "left")
    chosen = F.col("drawn") | (F.col("rank").isNotNull() & me.eqNullSafe(F.col("pick")))
    copies = F.col("sure") + F.when(chosen, 1).otherwise(0)
    return rows.select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        copies.cast("long").alias("copies"),
        (F.col("size") * copies).cast("long").alias("taken"),
    )


def op1_pareto_mixing(spark, sf_dir: str) -> DataFrame:
    """Query: (doc_id, size, source_size, target, taken) of every document."""
    return mix_copies(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST([5, 2, 1][CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS INT)] AS BIGINT) AS w,
         CAST(sum(size * ((size * 1000) // (size + 200))) AS BIGINT) / CAST(sum(size) AS DOUBLE) AS mean_lean
  FROM sized GROUP BY source),
lev AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER o, 0) AS DOUBLE)
            / CAST(sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS DOUBLE) AS level
  FROM per WINDOW o AS (ORDER BY CAST(3 * source_size AS DOUBLE) / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
tgt AS (
  SELECT source, source_size, mean_lean,
         CASE WHEN first_free IS NULL THEN CAST(3 * source_size AS DOUBLE) ELSE first_free * w END AS target
  FROM (SELECT *, first_value(CASE WHEN level * w <= 3 * source_size THEN level END IGNORE NULLS)
          OVER (ORDER BY CAST(3 * source_size AS DOUBLE) / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS first_free FROM lev)),
e AS (
  SELECT s.doc_id, s.source, s.size, t.source_size, t.target, t.mean_lean, (s.size * 1000) // (s.size + 200) AS lean,
         CASE WHEN t.source_size > 0 THEN least(t.target / t.source_size, 3.0::DOUBLE) ELSE 0.0::DOUBLE END AS ratio
  FROM sized s JOIN tgt t ON s.source IS NOT DISTINCT FROM t.source),
x AS (
  SELECT *, CASE WHEN size > 0 THEN greatest(0.0::DOUBLE, least(ratio + least(ratio, 3.0::DOUBLE - ratio) * (lean - mean_lean) / 1000.0::DOUBLE, 3.0::DOUBLE)) ELSE 0.0::DOUBLE END AS expected
  FROM e),
r AS (
  SELECT *, CAST(floor(expected) AS BIGINT) AS sure, expected - floor(expected) AS p,
         (CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) AS DOUBLE) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM x),
k AS (
  SELECT *, CASE WHEN p > 0 AND size > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS rank,
         CAST(floor(target - sum(sure * size) OVER (PARTITION BY source)) AS BIGINT) AS room
  FROM r),
c AS (
  SELECT *, CASE WHEN rank IS NOT NULL THEN sum(size) OVER (PARTITION BY source, rank IS NULL ORDER BY rank, doc_id, size RANGE UNBOUNDED PRECEDING) <= room ELSE false END AS drawn
  FROM k),
g AS (
  SELECT *, room - coalesce(sum(CASE WHEN drawn THEN size END) OVER (PARTITION BY source), 0) AS gap,
         count(*) OVER (PARTITION BY source, rank, doc_id, size) AS n FROM c),
f AS (
  SELECT *, CASE WHEN rank IS NOT NULL AND NOT drawn AND abs(gap - size) < abs(gap) AND abs(gap - n * size) < abs(gap) THEN abs(gap - n * size) END AS off FROM g),
b AS (SELECT *, rank() OVER (PARTITION BY source ORDER BY off NULLS LAST, rank, doc_id, size) AS o FROM f)
SELECT doc_id, size, source_size, target,
       CAST(size * (sure + CASE WHEN drawn OR (off IS NOT NULL AND o = 1) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM b
"""
