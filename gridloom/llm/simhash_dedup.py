"""SimHash near-dedup: exact Hamming joins over vantage-point trees, then components.

A fingerprint pair within `radius` bits agrees on at least one of `blocks` equal bit
blocks up to radius // blocks bits (pigeonhole). For each block a vantage-point tree,
fitted on a bounded sample, splits the fingerprints by Hamming distance of the block
to a vantage value; a fingerprint visits every shard whose ball it may overlap by the
triangle inequality and owns exactly one. Each shard compares its owners with all its
visitors exactly, in tiles of bounded size, so a shard that a common block makes large is
shared by many tasks. What leaves a tile is a spanning forest of the links, never the
pairs, so dense groups of near copies cost rows in proportion to their size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import group_slices, hashed_sample, materialize, read_table, shuffle_width, tiled, union_pairs, whole_groups, with_least
from .components import connected_components
from .fingerprint import mixed

SAMPLE = 65536  #: distinct fingerprints at most that the trees are fitted on
DEPTH = 14  #: levels of a tree at most, so there are 2^14 shards of a block at most
LEAF = 131072  #: fingerprints that a shard owns, about: few shards, as each level of a tree adds two fifths to the visits
SHARD_TILE = 262144  #: owners, and visitors, that a tile of a shard holds at most, about
VIEWS = 3  #: fingerprints of 64 bits that near copies are searched by
EXACT_TILE = 1024  #: texts of one group that are compared at once, about half


def shingle_fingerprints(text: str | None, words: int, views: int = 1) -> list[int]:
    """Majority votes of the XXH64 (seed 42) of all word shingles, as unsigned integers; later views mix the hashes anew.

    A-Z are lower-cased; words are runs without space, tab, line feed, vertical tab,
    form feed and carriage return; fewer than `words` words make one shingle, none
    gives zero. A bit is set if more than half of the shingles set it.
    """
    total, votes = 0, np.zeros((views, 64), np.int64)
    for h in _shingle_hashes(text, words):
        total += len(h)
        for v in range(views):
            h = mixed(h) if v else h
            votes[v] += _bits_set(h)
    return _majority(votes, total)


def _shingle_hashes(text: str | None, words: int):
    """XXH64 (seed 42) of the word shingles in parts of 65,536; none without words."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return
    joined = b" ".join(tokens)
    size = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    k = min(words, len(tokens))
    digest = xxhash.xxh64_intdigest
    total = len(tokens) - k + 1
    for lo in range(0, total, 65536):
        hi = min(lo + 65536, total)
        spans = zip(starts[lo:hi].tolist(), ends[lo + k - 1 : hi + k - 1].tolist(), strict=True)
        yield np.array([digest(joined[a:b], 42) for a, b in spans], np.uint64)


def _bits_set(h: np.ndarray) -> np.ndarray:
    return np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)


def _majority(votes: np.ndarray, total: int) -> list[int]:
    return [int.from_bytes(np.packbits(2 * v > total).tobytes(), "big") for v in votes]


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The distinct shingle hashes of a text, in order."""
    parts = list(_shingle_hashes(text, words))
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def set_views(text: str | None, words: int, views: int) -> list[int]:
    """A name of the text's shingle set (equal for equal sets) and `views` majority votes of the set; zeros without words."""
    h = shingle_set(text, words)
    if not len(h):
        return [0] * (views + 1)
    name, votes, total = xxhash.xxh64_intdigest(h.tobytes(), 42), np.zeros((views, 64), np.int64), len(h)
    for v in range(views):
        h = mixed(h) if v else h
        votes[v] = _bits_set(h)
    return [name, *_majority(votes, total)]


def shingle_fingerprint(text: str | None, words: int) -> int:
    return shingle_fingerprints(text, words)[0]


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, fp) of every whole text; fp is the fingerprint's bits as a signed long. Null texts are empty."""

    def run(batches):
        for pdf in batches:
            fp = np.array([shingle_fingerprint(t, words) for t in pdf["text"]], np.uint64)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "fp": fp.view(np.int64)})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, fp long")


class VantageTree:
    """A complete tree of `depth` levels over one bit block; node i has the children 2i+1 (ball) and 2i+2 (rest)."""

    def __init__(self, sample: np.ndarray, depth: int, radius: int, seed: int):
        rng = np.random.default_rng(seed)
        self.depth, self.radius = depth, radius
        self.vantage = np.zeros(2**depth - 1, np.uint64)
        self.ball = np.full(2**depth - 1, 64, np.int64)
        members = {0: sample}
        for node in range(2**depth - 1):
            own = members.pop(node, sample[:0])
            if not len(own):
                continue
            best = None
            for v in rng.choice(own, min(16, len(own)), replace=False):
                upto = np.cumsum(np.bincount(np.bitwise_count(own ^ v), minlength=65))
                ball = np.arange(65)
                inside = upto[np.minimum(ball + radius, 64)]
                outside = len(own) - np.where(ball >= radius, upto[np.maximum(ball - radius, 0)], 0)
                most = np.maximum(inside, outside)
                at = int(most.argmin())
                if best is None or most[at] < best[0]:
                    best = (most[at], v, at)
            _, self.vantage[node], self.ball[node] = best
            near = np.bitwise_count(own ^ best[1]) <= best[2]
            members[2 * node + 1], members[2 * node + 2] = own[near], own[~near]

    def shards(self, values: np.ndarray):
        """(row, shard, owner) of every visit."""
        row, node = np.arange(len(values)), np.zeros(len(values), np.int64)
        owner = np.ones(len(values), bool)
        for _ in range(self.depth):
            d = np.bitwise_count(values[row] ^ self.vantage[node]).astype(np.int64)
            ball = self.ball[node]
            near, into, out = d <= ball, d - self.radius <= ball, d + self.radius > ball
            row, node, owner = (
                np.concatenate([row[into], row[out]]),
                np.concatenate([2 * node[into] + 1, 2 * node[out] + 2]),
                np.concatenate([owner[into] & near[into], owner[out] & ~near[out]]),
            )
        return row, node - (2**self.depth - 1), owner


def _block(values: np.ndarray, k: int, blocks: int) -> np.ndarray:
    width = 64 // blocks
    mask = np.uint64(2**width - 1) if width < 64 else np.uint64(2**64 - 1)
    return (values >> np.uint64(k * width)) & mask


def _links(block: np.ndarray, at: np.ndarray, to: np.ndarray, within: int):
    """Pairs (i, j), i in `at` and j in `to`, of blocks of any width that differ by at most `within` bits."""
    for left in range(0, len(to), 16384):
        b = to[left : left + 16384]
        for lo in range(0, len(at), 256):
            a = at[lo : lo + 256]
            i, j = np.nonzero(np.bitwise_count(block[a][:, None] ^ block[None, b]) <= within)
            yield a[i], b[j]


def _probed(block: np.ndarray, at: np.ndarray, to: np.ndarray, within: int, most: int = 1 << 20):
    """The same of 16-bit blocks, whose near values are listed and looked up; `most` pairs at a time."""
    order = to[np.argsort(block[to], kind="stable")]
    start = np.searchsorted(block[order], np.arange(65537))
    masks = np.arange(65536)
    for mask in masks[np.bitwise_count(masks) <= within]:
        to_value = block[at].astype(np.int64) ^ mask
        n = start[to_value + 1] - start[to_value]
        who, k = np.flatnonzero(n), n[n > 0]
        total = np.cumsum(k)
        for lo in range(0, int(total[-1]) if len(k) else 0, most):
            pair = np.arange(lo, min(lo + most, int(total[-1])))
            g = np.searchsorted(total, pair, "right")
            yield at[who[g]], order[start[to_value[who[g]]] + pair - total[g] + k[g]]


def _in_tiles(rows: DataFrame, deal, kind: str, by: str, join) -> DataFrame:
    """join() of every tile of every shard that deal() sends rows to; it gets `at` (owners) and `to` as flags of its rows.

    A shard's owners are cut into d and its visitors, owners among them, into c chunks of
    SHARD_TILE at most; tile (i, j) holds owners i and visitors j, so each owner meets
    each visitor once. The shards are numbered and bounded (2^DEPTH for each tree), so
    their sizes, from a pass of their own over the rows, are broadcast.
    """

    def count(batches):
        for pdf in deal(batches):
            shard, at, n = np.unique(pdf["shard"].to_numpy(), return_inverse=True, return_counts=True)
            yield pd.DataFrame({"shard": shard, "n": n, "own": np.bincount(at, pdf["owner"].to_numpy(float), len(shard)).astype(np.int64)})

    parts = lambda c: F.greatest(F.ceil(F.sum(c) / F.lit(SHARD_TILE)), F.lit(1)).cast("int")
    sizes = rows.mapInPandas(count, "shard long, n long, own long").groupBy("shard").agg(parts("n").alias("_c"), parts("own").alias("_d"))
    dealt = rows.mapInPandas(deal, kind).join(F.broadcast(materialize(sizes, "shards")), "shard")
    dealt = dealt.withColumns({"_j": F.expr(f"int(pmod(xxhash64({by}, 17L), _c))"), "_i": F.expr(f"int(pmod(xxhash64({by}, 19L), _d))")})
    seats = F.expr("array_union(transform(sequence(0, _d - 1), i -> i * _c + _j), if(owner, transform(sequence(0, _c - 1), j -> _i * _c + j), array()))")
    dealt = dealt.withColumn("tile", F.explode(F.when(F.col("_c") * F.col("_d") == 1, F.array(F.lit(0))).otherwise(seats)))
    roles = {"at": F.col("owner") & (F.expr("tile div _c") == F.col("_i")), "to": F.col("tile") % F.col("_c") == F.col("_j")}
    return dealt.withColumns(roles).drop("owner", "_c", "_d", "_i", "_j").groupBy("shard", "tile").applyInPandas(join, "a long, b long")


def _trees(fps: DataFrame, n: int, col: str, within: int, blocks: int, leaf: int) -> list[VantageTree]:
    some = hashed_sample(fps.select(col), col, most=SAMPLE, rows=n).collect()
    sample = np.sort(np.array([r[0] for r in some], np.int64)).view(np.uint64)
    depth = 0
    while leaf * 2**depth < n and depth < DEPTH:
        depth += 1
    return [VantageTree(_block(sample, k, blocks), depth, within, k) for k in range(blocks)]


def hamming_forest(fps: DataFrame, radius: int = 4, blocks: int = 4, leaf: int = LEAF) -> DataFrame:
    """Edges (a, b) of a forest that connects exactly what links of at most `radius` bits connect.

    fps: a long column `fp` of distinct fingerprints, none of them null. All links are
    searched; the sample of at most SAMPLE fingerprints decides only where the trees
    split, and shards that stay large are compared in more tiles. An empty table gives no
    rows.
    """
    within = radius // blocks
    trees = _trees(fps, fps.count(), "fp", within, blocks, leaf)
    narrow = np.uint16 if blocks >= 4 else np.uint32 if blocks >= 2 else np.uint64

    def deal(batches):
        for pdf in batches:
            values = pdf["fp"].to_numpy(np.int64).view(np.uint64)
            for k, tree in enumerate(trees):
                row, shard, owner = tree.shards(_block(values, k, blocks))
                yield pd.DataFrame({"shard": shard * blocks + k, "fp": values[row].view(np.int64), "owner": owner})

    def join(pdf):
        own = pdf["fp"].to_numpy(np.int64).view(np.uint64)
        part = _block(own, int(pdf["shard"].iloc[0]) % blocks, blocks).astype(narrow)
        parent = np.arange(len(own))
        at, to = (np.flatnonzero(pdf[c].to_numpy(bool)) for c in ("at", "to"))
        for i, j in _probed(part, at, to, within) if blocks == 4 else _links(part, at, to, within):
            near = np.bitwise_count(own[i] ^ own[j]) <= radius
            union_pairs(parent, i[near], j[near])
        tied = np.flatnonzero(parent != np.arange(len(own)))
        return pd.DataFrame({"a": own[parent[tied]].view(np.int64), "b": own[tied].view(np.int64)})

    return _in_tiles(fps.select("fp"), deal, "shard long, fp long, owner boolean", "fp", join)


def components_of(classes: DataFrame, radius: int, **options) -> DataFrame:
    """(fp, root) of every fingerprint in classes; root names its component of links."""
    edges = materialize(hamming_forest(classes, radius, **options), "links")
    member = connected_components(edges).withColumnRenamed("node", "fp")
    return classes.select("fp").join(member, "fp", "left").select("fp", F.coalesce("component", "fp").alias("root"))


def simhash_components(docs: DataFrame, words: int = 4, radius: int = 4) -> DataFrame:
    """Every row of docs as (doc_id, fp, component_id): its fingerprint and the smallest doc_id its links reach.

    Rows are kept whatever they hold: a null text is an empty one (fingerprint zero), a
    null doc_id keeps its row and takes the component of its fingerprint (null if no
    member has an id), repeated rows stay repeated, an empty table gives no rows and
    extra columns are not read.
    """
    marked = materialize(fingerprints(docs, words), "fingerprints")
    classes = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    grouped = materialize(components_of(classes, radius).join(classes, "fp"), "grouped")
    named = with_least(grouped, "root", "rep", grouped.count()).select("fp", F.col("m").alias("component_id"))
    return marked.join(materialize(named, "named"), "fp").select("doc_id", "fp", "component_id")


def near_candidates(classes: DataFrame, within: int, most: int, leaf: int = LEAF) -> DataFrame:
    """Edges (a, b) of a forest that connects what links connect: any block of 16 bits of any view within `within` bits, and all views within `most` together.

    classes: id, unique, and the views v0, v1 and so on, none of them null. Each block of
    each view has its own tree. All links are searched. No rows give no rows.
    """
    names = [c for c in classes.columns if c.startswith("v")]
    blocks = 4  # of 16 bits, which _probed() takes
    n = classes.count()
    trees = [t for c in names for t in _trees(classes, n, c, within, blocks, leaf)]
    kinds = len(trees)

    def deal(batches):
        for pdf in batches:
            for k, tree in enumerate(trees):
                values = pdf[names[k // blocks]].to_numpy(np.int64).view(np.uint64)
                row, shard, owner = tree.shards(_block(values, k % blocks, blocks))
                yield pdf.iloc[row].assign(shard=shard * kinds + k, owner=owner)

    def join(pdf):
        ids = pdf["id"].to_numpy(np.int64)
        view = [pdf[c].to_numpy(np.int64).view(np.uint64) for c in names]
        k = int(pdf["shard"].iloc[0]) % kinds
        own = view[k // blocks]
        parent = np.arange(len(ids))
        at, to = (np.flatnonzero(pdf[c].to_numpy(bool)) for c in ("at", "to"))
        for i, j in _probed(_block(own, k % blocks, blocks), at, to, within):
            near = sum(np.bitwise_count(v[i] ^ v[j]).astype(np.int64) for v in view) <= most
            union_pairs(parent, i[near], j[near])
        tied = np.flatnonzero(parent != np.arange(len(ids)))
        return pd.DataFrame({"a": ids[parent[tied]], "b": ids[tied]})

    kind = ", ".join(f"{c} long" for c in ("id", *names, "shard")) + ", owner boolean"
    return _in_tiles(classes.select("id", *names), deal, kind, "id", join)


def alike(sets: list[np.ndarray], side: np.ndarray, likeness: float):
    """(i, j) of each pair of sets with a Jaccard similarity of at least `likeness`; where there are two sides, those across them."""
    size = np.array([len(x) for x in sets])
    code = np.unique(np.concatenate(sets), return_inverse=True)[1]
    edge = np.concatenate([[0], np.cumsum(size)])
    holder = np.repeat(np.arange(len(sets)), size)[np.argsort(code, kind="stable")]
    first = np.concatenate([[0], np.cumsum(np.bincount(code))])
    one_side = (side == side[0]).all()
    for i in range(len(sets)):
        c = code[edge[i] : edge[i + 1]]
        if not len(c):
            continue
        both = np.bincount(np.concatenate([holder[first[x] : first[x + 1]] for x in c]), minlength=len(sets))
        near = both >= likeness * (size + size[i] - both) - 1e-9
        near[i] = False
        j = np.flatnonzero(near if one_side else near & (side != side[i]))
        yield np.full(len(j), i), j


def exact_links(members: DataFrame, words: int, likeness: float) -> DataFrame:
    """Edges (a, b) of a forest that connects what pairs of one root with an exact shingle similarity of at least `likeness` connect.

    members: id, root and text. Every pair of a root is compared, in tiles of bounded size.
    """

    def run(batches):
        for pdf in whole_groups(batches, ["root", "tile"]):
            a, b = [], []
            for lo, hi in group_slices(pdf["root"].to_numpy(), pdf["tile"].to_numpy()):
                part = pdf.iloc[lo:hi]
                ids, parent = part["id"].to_numpy(np.int64), np.arange(hi - lo)
                sets = [shingle_set(t, words) for t in part["text"]]
                for i, j in alike(sets, part["side"].to_numpy(), likeness):
                    union_pairs(parent, i, j)
                tied = np.flatnonzero(parent != np.arange(len(ids)))
                a.append(ids[parent[tied]])
                b.append(ids[tied])
            yield pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)})

    dealt = tiled(members, ["root"], "id", EXACT_TILE)
    width = shuffle_width(members.sparkSession)
    return dealt.repartition(width, "root", "tile").sortWithinPartitions("root", "tile").mapInPandas(run, "a long, b long")


def search_bound(likeness: float, views: int) -> int:
    """Bits of all views by which texts of that shingle similarity differ, and three standard deviations more."""
    share = float(np.arccos(2 * likeness / (1 + likeness)) / np.pi)
    return int(64 * views * share + 3 * (64 * views * share * (1 - share)) ** 0.5)


def deduplicated(docs: DataFrame, words: int = 5, likeness: float = 0.8, within: int = 1) -> DataFrame:
    """One row of each group of near copies: that of the smallest doc_id; all columns of docs stay.

    Documents link when their sets of word shingles have a Jaccard similarity of at
    least `likeness`, which is computed exactly; links close transitively. Pairs to
    compare come from VIEWS fingerprints of 64 bits of each set: those with a block of 16
    bits that differs by at most `within` bits and with no more than search_bound() bits
    different in all, which the trees search exactly, and all pairs of the groups that
    these connect. By the binomial, sets of a similarity of exactly 0.8 are within one
    bit in a block with chance 0.28 and so in any of 12 with chance 0.98: 98 of 100 such
    pairs are compared, and more above 0.8.

    Texts without words are one group. Null ids come last; of rows that agree in their
    id the first written one stays. Repeated rows are copies; no rows give no rows.
    """
    names = ["id", *(f"v{k}" for k in range(VIEWS))]
    views = F.arrow_udf(_views(words, names), ", ".join(f"{c} long" for c in names))
    tagged = docs.select(F.struct(*docs.columns).alias("doc"), views(F.col("text")).alias("v"), F.monotonically_increasing_id().alias("row"))
    tagged = materialize(tagged.select("doc", "v.*", "row"), "tagged")
    first = F.struct(F.col("doc.doc_id").isNull().alias("n"), F.col("doc.doc_id").alias("d"), F.col("row").alias("r"))
    slim = tagged.select("id", *names[1:], first.alias("who"))
    # rows of one id have one shingle set, and so the same views
    classes = slim.groupBy("id").agg(*(F.min(c).alias(c) for c in names[1:]), F.min("who").alias("who"))
    classes = materialize(classes, "classes")
    found = materialize(near_candidates(classes, within, search_bound(likeness, VIEWS)), "candidates")
    roots = connected_components(found).withColumnsRenamed({"node": "id", "component": "root"})
    asked = roots.join(classes.select("id", F.col("who.r").alias("row")), "id")
    texts = asked.join(tagged.select("row", F.col("doc.text").alias("text")), "row").select("id", "root", "text")
    links = materialize(exact_links(materialize(texts, "texts"), words, likeness), "links")
    member = connected_components(links).withColumnsRenamed({"node": "id", "component": "root"})
    grouped = classes.select("id", "who").join(member, "id", "left").withColumn("root", F.coalesce("root", "id"))
    grouped = materialize(grouped, "grouped")
    # rows that stay: of each component's best class the best row
    stays = grouped.groupBy("root").agg(F.min("who").alias("best")).select(F.col("best.r").alias("row"))
    return tagged.join(stays, "row", "left_semi").select("doc.*")


def _views(words: int, names: list[str]):
    """The name and the views of a text's shingle set as an Arrow function; texts become Python strings one at a time."""

    def run(texts: pa.Array) -> pa.Array:
        v = np.array([set_views(t.as_py(), words, len(names) - 1) for t in texts], np.uint64).reshape(-1, len(names)).view(np.int64)
        return pa.StructArray.from_arrays([pa.array(v[:, k].copy()) for k in range(len(names))], names)

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return run


def op9_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    """Query: (doc_id, fingerprint, component_id) of every document."""
    found = simhash_components(read_table(spark, sf_dir, "documents"))
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return found.select("doc_id", hexed.alias("fingerprint"), "component_id")
