"""Document fingerprints: SimHash over weighted word pairs, and block-table search.

Terms are pairs of neighbouring words (A-Z lower-cased; a lone word stands for itself),
weighted by 1 + log2 of their count in the document. Each term's 64-bit hash votes on
every bit with its weight, for or against. The search puts each fingerprint into one
table for every choice of `blocks - radius` leading blocks: two fingerprints within the
radius agree on all blocks of at least one table.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import even_keys, group_slices, materialize, read_table, shuffle_width, tiled, whole_groups, whole_text

TILE = 4096  #: fingerprints a side of a tile holds, about
SPREAD = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit (multiply and shift twice)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(raw: bytes, letters: np.ndarray = ~_SPACE, stem: int | None = None) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial in its bytes, by position from its start, then mixed.

    letters: which bytes words consist of. stem: hash only so many leading bytes of each.
    """
    data = _LOWER[np.frombuffer(raw, np.uint8)]
    inside = letters[data]
    if not inside.any():
        return np.zeros(0, np.uint64)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    starts = np.flatnonzero(first)
    at = np.flatnonzero(inside)
    word = np.cumsum(first)[at] - 1
    place = at - starts[word]
    if stem is not None:
        near = place < stem
        at, place = at[near], place[near]
    power = np.full(int(place.max()) + 1, SPREAD, np.uint64)
    power[0] = 1
    power = np.cumprod(power, dtype=np.uint64)
    terms = (data[at].astype(np.uint64) + np.uint64(1)) * power[place]
    begin = np.flatnonzero(first[at])
    return mixed(np.add.reduceat(terms, begin))


def simhash(text: str | None) -> int:
    """The fingerprint of a whole text as an unsigned integer; zero without words."""
    words = word_hashes((text or "").encode("utf-8", "surrogatepass"))
    if not len(words):
        return 0
    terms = mixed(words[:-1] * SPREAD + words[1:]) if len(words) > 1 else words
    terms, count = np.unique(terms, return_counts=True)
    weight = 1 + np.log2(count)
    votes = np.zeros(64)
    for lo in range(0, len(terms), 32768):
        bits = np.unpackbits(terms[lo : lo + 32768].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        votes += weight[lo : lo + 32768] @ (2.0 * bits - 1)
    return int.from_bytes(np.packbits(votes > 1e-9).tobytes(), "big")


def edited(text: str, follower: str) -> str:
    """text with its last quarter (rounded down) replaced by the first as many code points of follower, or all it has."""
    k = len(text) // 4
    return text[: len(text) - k] + follower[:k]


def likeness(a: int, b: int) -> float:
    return 1 - (a ^ b).bit_count() / 64


def with_follower(docs: DataFrame) -> DataFrame:
    """(bucket, guest, doc_id, text) in which each row is followed by the next document of the table.

    doc_id ranges of about equal row counts become buckets that are sorted apart. Each
    range starts at an id that occurs, and the rows of that id also close the range
    before as guests (those of the first id close the last range), so no row has to look
    beyond its bucket.
    """
    spark = docs.sparkSession
    parts = shuffle_width(spark)
    cuts = ", ".join(str(i / parts) for i in range(1, parts)) or "0.5"
    facts = docs.selectExpr("min(doc_id) AS lo", f"percentile_approx(doc_id, array({cuts})) AS cuts", "count_if(doc_id is null) AS nulls").first()
    bounds = sorted({facts["lo"], *(facts["cuts"] or ())} - {None}) or [0]
    marks = F.array(*[F.lit(b).cast("long") for b in bounds])
    bucket = F.greatest(F.coalesce(F.size(F.filter(marks, lambda b: b <= F.col("doc_id"))), F.lit(0)) - 1, F.lit(0))
    first = F.col("doc_id").isNull() if facts["nulls"] else F.col("doc_id") == bounds[0]
    seat = lambda b, g: F.struct(b.cast("int").alias("bucket"), F.lit(g).alias("guest"))
    own, end = seat(F.col("_b"), 0), seat(F.lit(len(bounds) - 1), 1)
    leads = (F.col("_b") > 0) & (F.element_at(marks, F.col("_b") + 1) == F.col("doc_id"))
    if facts["nulls"]:
        leads = leads | F.lit(False)
    seats = F.when(first, F.array(own, end)).when(leads, F.array(own, seat(F.col("_b") - 1, 1))).otherwise(F.array(own))
    # a bucket travels under a number that hash partitioning deals to a partition of its own
    keys = F.array(*[F.lit(k) for k in even_keys(parts)])
    return (
        docs.withColumn("_b", bucket)
        .withColumn("_s", F.explode(seats))
        .select(F.element_at(keys, F.col("_s.bucket") + 1).alias("bucket"), "_s.guest", "doc_id", "text")
        .repartition(parts, "bucket")
        .sortWithinPartitions("bucket", "guest", "doc_id", "text")
    )


def fingerprint_table(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text.

    Returns doc_id, n_chars, edited_sha256, fp and edited_fp (bits as signed longs),
    near_edited and near_next. Null texts are empty, empty texts have fingerprint zero;
    null ids come before all others; repeated rows follow one another, ordered by text;
    a table of one row is its own follower; extra columns are not read.
    """

    def run(batches):
        waiting = None  # (bucket, doc_id, text, fp) of the last row, whose follower is still to come

        for pdf in batches:
            out = []
            for bucket, guest, doc, text in zip(pdf["bucket"], pdf["guest"], pdf["doc_id"], pdf["text"], strict=True):
                if waiting is None and guest:
                    continue
                fp = simhash(text)
                if waiting is not None and waiting[0] == bucket:
                    _, d, t, f = waiting
                    new = edited(t, text)
                    e = simhash(new)
                    digest = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
                    out.append((d, len(t), digest, f, e, likeness(f, e), likeness(f, fp)))
                waiting = None if guest else (bucket, doc, text, fp)
            frame = pd.DataFrame(out, columns=["doc_id", "n_chars", "edited_sha256", "fp", "edited_fp", "near_edited", "near_next"])
            for c in ("fp", "edited_fp"):
                frame[c] = np.array(frame[c].tolist(), np.uint64).view(np.int64)
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    kind = "doc_id long, n_chars long, edited_sha256 string, fp long, edited_fp long, near_edited double, near_next double"
    return with_follower(docs.select("doc_id", whole_text().alias("text"))).mapInPandas(run, kind)


def near_fingerprints(fps: DataFrame, radius: int = 3, blocks: int = 5) -> DataFrame:
    """(fp, n_near): for each fingerprint how many other distinct ones lie within the radius; those without any are absent.

    fps: one long column `fp`, distinct and not null. Every pair within the radius counts
    once, in the first of its tables; no pair list is made, and large buckets are split
    into tiles. An empty table gives no rows.
    """
    width = 64 // blocks
    edges = [(k * width, 64 if k == blocks - 1 else (k + 1) * width) for k in range(blocks)]
    masks = [np.uint64(((1 << hi) - 1) ^ ((1 << lo) - 1)) for lo, hi in edges]
    tables = list(combinations(range(blocks), blocks - radius))
    first = np.full(2**blocks, -1)
    for t in range(len(tables) - 1, -1, -1):
        need = sum(1 << k for k in tables[t])
        first[[s for s in range(2**blocks) if s & need == need]] = t

    def deal(batches):
        for pdf in batches:
            value = pdf["fp"].to_numpy(np.int64).view(np.uint64)
            for t, chosen in enumerate(tables):
                mask = np.bitwise_or.reduce([masks[k] for k in chosen])
                yield pd.DataFrame({"t": t, "key": (value & mask).view(np.int64), "fp": pdf["fp"].to_numpy()})

    def count(batches):
        for pdf in whole_groups(batches, ["t", "key", "tile"]):
            value = pdf["fp"].to_numpy(np.int64).view(np.uint64)
            side, tt = pdf["side"].to_numpy(), pdf["t"].to_numpy()
            near = np.zeros(len(pdf), np.int64)
            for lo, hi in group_slices(tt, pdf["key"].to_numpy(), pdf["tile"].to_numpy()):
                left = np.flatnonzero(side[lo:hi] == 0) + lo
                right = np.flatnonzero(side[lo:hi] == 1) + lo
                within = not len(right)
                right = left if within else right
                for b in range(0, len(left), 512):
                    a = left[b : b + 512]
                    i, j = np.nonzero(np.bitwise_count(value[a][:, None] ^ value[None, right]) <= radius)
                    i, j = a[i], right[j]
                    apart = value[i] ^ value[j]
                    same = sum(((apart & m) == 0).astype(np.int64) << k for k, m in enumerate(masks))
                    keep = (first[same] == tt[lo]) & (i != j)
                    if within:
                        keep &= i < j
                    near += np.bincount(i[keep], minlength=len(pdf)) + np.bincount(j[keep], minlength=len(pdf))
            at = np.flatnonzero(near)
            yield pd.DataFrame({"fp": pdf["fp"].to_numpy()[at], "n": near[at]})

    dealt = tiled(fps.select("fp").mapInPandas(deal, "t int, key long, fp long"), ["t", "key"], "fp", TILE)
    met = (
        dealt.repartition(shuffle_width(fps.sparkSession), "t", "key", "tile")
        .sortWithinPartitions("t", "key", "tile")
        .mapInPandas(count, "fp long, n long")
    )
    return met.groupBy("fp").agg(F.sum("n").alias("n_near"))


def op2_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Query: fingerprints of all texts and edited texts, their likeness, and n_near: other fingerprints within 3 bits."""
    table = materialize(fingerprint_table(read_table(spark, sf_dir, "documents")), "simhash")
    near = near_fingerprints(table.select("fp").distinct())
    hexed = lambda c: F.lpad(F.lower(F.hex(c)), 16, "0")
    return table.join(near, "fp", "left").select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        hexed("fp").alias("fingerprint"),
        hexed("edited_fp").alias("edited_fingerprint"),
        "near_edited",
        "near_next",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
    )
