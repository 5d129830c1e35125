"""Toxicity by class-conditional Kneser-Ney models of words.

A toxic and an ordinary model are compared by log-likelihood per word. In each class the
probability of a word is interpolated: its count less one absolute discount over all
words of the class, plus the mass so freed times what the level below says, which is the
class's probability of the word's long stem times the word's share of that stem; long
stems go on to short stems, and these to a distribution that both classes share. All
shares come from continuation counts (distinct words before an expression) of both
classes together, so an expression that is rare in both says only what its stem says,
and one without a known stem hardly anything. At every level the probabilities of all
expressions, with one place for those never seen, add up to 1.

A document's evidence is the difference of the two log-likelihoods, normalised by
length: over the whole text, over its most toxic windows of a few lengths, and over its
most toxic words. A logistic fit turns it into a score. The evidence it is fitted on
comes from models that have not counted the document's own part of the labelled rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import discard, materialize, read_table
from .fingerprint import SPREAD, mixed, word_hashes

FEW = 2_000_000  #: labelled rows up to which their ids are broadcast to the texts
STEMS = (4, 6)  #: leading bytes of a word that make its short and its long stem
LEVELS = len(STEMS) + 1  #: short stems, long stems, words
DISCOUNT = 2.0  #: taken off every count
WINDOWS = (1, 8, 24)  #: lengths, in words, of the windows
TOP = 5  #: words whose ratios are also averaged, the highest of the text
PARTS = 4  #: parts of the labelled rows; each is left out of the model that its rows are fitted by
AT_ONCE = 100_000  #: words that a task counts before it hands them on
PAIRS_AT_ONCE = 500_000  #: the same for pairs of words
MARKS = 4  #: least hashes that near copies mostly have in common

EVIDENCE = 2 + len(WINDOWS)

LETTERS = np.zeros(256, bool)
LETTERS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def tokens(text: str | None) -> list[np.ndarray]:
    """Hashes of the stems, shortest first, and of the words (runs of letters, digits and non-ASCII bytes, A-Z lower-cased)."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return [*(word_hashes(raw, LETTERS, k) for k in STEMS), word_hashes(raw, LETTERS)]


@dataclass
class Model:
    """Log-likelihood ratios (toxic over ordinary) of the listed expressions, level by level.

    keys: sorted hashes; llr: a row for each left-out part and a last one for the model
    of all parts; rest: the same for expressions that a level does not list, on top of
    what the level below says.
    """

    keys: list
    llr: list
    rest: np.ndarray

    def ratios(self, levels: list[np.ndarray], part: int = -1) -> np.ndarray:
        """One log-likelihood ratio per word."""
        out = np.zeros(len(levels[-1]))
        for level, (keys, llr, seen) in enumerate(zip(self.keys, self.llr, levels, strict=True)):
            at, known = _find(keys, seen)
            out += self.rest[part, level]
            if len(keys):
                out = np.where(known, llr[part][at], out)
        return out

    def evidence(self, text: str | None, part: int | None = -1) -> list[float]:
        """Mean ratio of the whole text, the highest mean of a window of each length, the mean of the TOP highest ratios; zeros without words.

        By the model without `part`; None: without the text's own part.
        """
        levels = tokens(text)
        llr = self.ratios(levels, part_of(levels[-1]) if part is None else part)
        n = len(llr)
        if not n:
            return [0.0] * EVIDENCE
        run = np.concatenate([[0.0], np.cumsum(llr)])
        # a window longer than the text is filled up with words that say nothing
        best = [float((run[min(k, n):] - run[: n + 1 - min(k, n)]).max() / k) for k in WINDOWS]
        top = np.partition(llr, n - TOP)[n - TOP :] if n > TOP else llr
        return [float(run[-1] / n), *best, float(top.sum() / TOP)]


def _find(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
    return at, keys[at] == values


def part_of(words: np.ndarray) -> int:
    """The part of a text of these words: one and the same for texts whose MARKS least hashes, each by another mixing, of word pairs agree."""
    h, mark = mixed(words[:-1] * SPREAD + words[1:]) if len(words) > 1 else words, np.zeros(1, np.uint64)
    for _ in range(MARKS if len(words) else 0):
        mark = mixed(mark * SPREAD + h.min())
        h = mixed(h)
    return int(mark[0] % np.uint64(PARTS))


COUNTS = [f"{c}{k}" for c in ("ordinary", "toxic") for k in range(PARTS)]


def count_expressions(docs: DataFrame) -> DataFrame:
    """(level, key, a, ordinary0.., toxic0..): occurrences of stems and words by class and part of the rows.

    docs: text, toxic (0 or 1) and, where it is not that of part_of, part; every row
    counts, copies of others, too. a: the next shorter stem. Rows of level LEVELS have a
    word as key and, in a, the distinct words before it (the first word of a text has
    none before it, which counts as one). Pairs of words travel without counts, in a pass
    of their own, and once for each task.
    """

    def counted(seen: dict) -> pd.DataFrame:
        out = []
        for (level, column), found in seen.items():
            key, a = (np.concatenate(x) for x in zip(*found, strict=True))
            key, at, n = np.unique(key, return_index=True, return_counts=True)
            counts = np.zeros((len(key), len(COUNTS)), np.int32)
            counts[:, column] = n
            out.append(pd.DataFrame(counts, columns=COUNTS).assign(level=np.int32(level), key=key.view(np.int64), a=a[at].view(np.int64)))
        return pd.concat(out)[["level", "key", "a", *COUNTS]]

    def run(batches):
        seen, words = {}, 0
        for pdf in batches:
            for text, toxic, part in zip(pdf["text"], pdf["toxic"], pdf["part"] if given else [None] * len(pdf), strict=True):
                levels = tokens(text)
                w = levels[-1]
                if not len(w):
                    continue
                column = int(toxic) * PARTS + (int(part) if given else part_of(w))
                for level, key in enumerate(levels):
                    seen.setdefault((level, column), []).append((key, levels[max(level - 1, 0)]))
                words += len(w)
                if words >= AT_ONCE:
                    yield counted(seen)
                    seen, words = {}, 0
        if seen:
            yield counted(seen)

    given = "part" in docs.columns
    kind = "level int, key long, a long, " + ", ".join(f"{c} int" for c in COUNTS)
    rows = docs.select("text", "toxic", *["part"] * given).mapInPandas(run, kind)
    rows = rows.groupBy("level", "key").agg(F.first("a").alias("a"), *(F.sum(c).alias(c) for c in COUNTS))
    before = docs.select("text").mapInPandas(neighbours, "key long, a long").distinct().groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    return rows.unionByName(before.select(F.lit(LEVELS).alias("level"), F.col("a").alias("key"), F.col("n").alias("a"), *(F.lit(0).cast("long").alias(c) for c in COUNTS)))


def neighbours(batches):
    """(key, a) of the distinct pairs of neighbouring words in texts, with the second word in a; rows of one word together."""

    def distinct(found: list) -> pd.DataFrame:
        key, at = np.unique(np.concatenate([k for k, _ in found]), return_index=True)
        a = np.concatenate([w for _, w in found])[at]
        order = np.argsort(a, kind="stable")
        return pd.DataFrame({"key": key[order].view(np.int64), "a": a[order].view(np.int64)})

    found, words = [], 0
    for pdf in batches:
        for text in pdf["text"]:
            w = word_hashes((text or "").encode("utf-8", "surrogatepass"), LETTERS)
            if not len(w):
                continue
            found.append((mixed(np.concatenate([[np.uint64(0)], w[:-1]]) * SPREAD + w), w))
            words += len(w)
            if words >= PAIRS_AT_ONCE:
                yield distinct(found)
                found, words = [], 0
    if found:
        yield distinct(found)


def kneser_ney(listed: list[pd.DataFrame], shared: float, counts: list[np.ndarray], words: float, discount: float = DISCOUNT) -> tuple[list, np.ndarray]:
    """(probabilities of the listed expressions, mass that goes to the level below), level by level, of one class.

    listed: tables with cont (continuation count), under (that of the next shorter stem)
    and parent (its place in the table before). counts: of the listed expressions; those
    not listed have no more than the discount. words: all words of the class; without
    any, everything is left to the shared distribution. shared: continuations of all
    short stems, one more for each and one for those never seen.
    """
    probs, rest = [], np.ones(len(listed))
    for level, (table, n) in enumerate(zip(listed, counts, strict=True)):
        kept = np.maximum(n - discount, 0) / max(words, 1.0)
        rest[level] = max(1 - kept.sum(), 1e-9)
        cont = table["cont"].to_numpy(float)
        base = probs[-1][table["parent"].to_numpy()] * cont / (table["under"].to_numpy(float) + 1) if level else (cont + 1) / shared
        probs.append(kept + rest[level] * base)
    return probs, rest


def listed_expressions(counts: DataFrame) -> tuple[list[pd.DataFrame], float, np.ndarray]:
    """(tables for kneser_ney, shared, words by class and part) from materialised counts.

    Only expressions that exceed the discount in a class come to the driver. For all
    others the level below says all there is, with the same ratio as for unseen ones, so
    the models lose nothing.
    """
    cont = counts.where(F.col("level") == LEVELS).select("key", F.col("a").alias("cont"))
    most = F.greatest(*(sum((F.col(f"{c}{k}") for k in range(PARTS)), F.lit(0)) for c in ("ordinary", "toxic")))
    every = counts.where(F.col("level") == 0).agg(*(F.sum(c).alias(c) for c in COUNTS)).first()
    words = np.array([every[c] or 0 for c in COUNTS], float)
    listed, shared, used = [None] * LEVELS, 1.0, []
    for level in range(LEVELS - 1, -1, -1):
        one = materialize(counts.where(F.col("level") == level).join(cont, "key"), "toxic-level")
        used.append(one)
        found = one.where(most > DISCOUNT).select("key", "a", "cont", *COUNTS).toArrow()  # no Python object for each number
        found = {c: found[c].to_numpy() for c in found.column_names}
        found |= {c: found[c].view(np.uint64) for c in ("key", "a")}
        order = np.argsort(found["key"])
        listed[level] = pd.DataFrame({c: v[order] for c, v in found.items()})
        if level:
            cont = one.groupBy(F.col("a").alias("key")).agg(F.sum("cont").alias("cont"))
        else:
            shared += float(one.agg(F.coalesce(F.sum(F.col("cont") + 1), F.lit(0))).first()[0])
        if level < LEVELS - 1:
            at, _ = _find(listed[level]["key"].to_numpy(), listed[level + 1]["a"].to_numpy())
            under = listed[level]["cont"].to_numpy()
            listed[level + 1] = listed[level + 1].assign(parent=at, under=under[at] if len(under) else [])
    for table in used:
        discard(table)
    return listed, shared, words


def build(counts: DataFrame) -> Model:
    """The models without each part and of all parts, from materialised counts."""
    listed, shared, words = listed_expressions(counts)
    llr, rest = [[] for _ in listed], []
    for part in [*range(PARTS), None]:
        own = [k for k in range(PARTS) if k != part]
        probs, left = [], []
        for c in range(2):
            cols = [c * PARTS + k for k in own]
            n = [t[[COUNTS[k] for k in cols]].to_numpy(float).sum(axis=1) for t in listed]
            p, r = kneser_ney(listed, shared, n, words[cols].sum())
            probs.append(p)
            left.append(r)
        for level in range(LEVELS):
            llr[level].append((np.log(probs[1][level]) - np.log(probs[0][level])).astype(np.float32))
        rest.append(np.log(left[1]) - np.log(left[0]))
    return Model([t["key"].to_numpy() for t in listed], [np.array(x) for x in llr], np.array(rest))


def fit_logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights, the constant last, of a logistic regression with a ridge on the scaled columns, in which both labels weigh the same."""
    w = np.zeros(x.shape[1] + 1)
    if not 0 < y.sum() < len(y):
        return w
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    x = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        grad = x.T @ (weight * (p - y)) + 1e-3 * w
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(w))
        w -= np.linalg.solve(hess, grad)
    w[:-1] /= scale
    w[-1] -= w[:-1] @ mean
    return w


def best_cut(z: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> float:
    """The threshold on z with the highest F1, in the middle of the gap to the next lower value; weight: rows that each row stands for."""
    if not len(z) or not y.any():
        return math.inf
    weight = np.ones(len(z)) if weight is None else weight
    order = np.argsort(-z, kind="stable")
    hit, taken = np.cumsum((y * weight)[order]), np.cumsum(weight[order])
    f1 = 2 * hit / (taken + (y * weight).sum())
    last = np.append(z[order][1:] != z[order][:-1], True)
    k = int(np.argmax(np.where(last, f1, -1)))
    low = z[order][k + 1] if k + 1 < len(z) else z[order][k] - 1
    return float((z[order][k] + low) / 2)


def learn(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1):
    """(model, weights, cut) from all labelled rows outside the held-out fold.

    Each row counts as it stands, in the counts, the fit and the cut, also copies and
    near copies of others; as near copies mostly share a part, the evidence that the fit
    sees comes from models that have counted neither. Texts are read anew by each pass,
    so only ids, counts and evidence are written.
    """
    rows = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = materialize(rows.where(F.crc32(F.col("doc_id").cast("string")) % folds != held).where("toxic in (0, 1)"), "toxic-labels")
    labelled = docs.select("doc_id", "text").join(F.broadcast(rows) if rows.count() <= FEW else rows, "doc_id").select("text", "toxic")
    counts = materialize(count_expressions(labelled), "toxic-counts")
    model = build(counts)
    e = materialize(labelled.select("toxic", _evidence(model, None)("text").alias("e")), "toxic-evidence")
    w = fit_logistic_rows(e)
    z = F.lit(float(w[-1]))
    for k in range(EVIDENCE):
        z = z + F.element_at("e", k + 1) * float(w[k])
    cut = best_cut_rows(e.select(z.alias("z"), F.col("toxic").cast("double").alias("hit"), F.lit(1.0).alias("n")))
    for table in (rows, counts, e):
        discard(table)
    return model, w, cut


def _sums(rows: DataFrame, of, shape: tuple) -> np.ndarray:
    """The sum over all rows of arrays that `of` makes of the evidence and the labels of a batch; a task hands on one array, and all of them come in one job."""

    def run(batches):
        total = np.zeros(shape)
        for pdf in batches:
            if len(pdf):
                total += of(np.array(pdf["e"].tolist(), float), pdf["toxic"].to_numpy(float))
        yield pd.DataFrame({"total": [total.tobytes()]})

    total = np.zeros(shape)
    for r in rows.select("e", "toxic").mapInPandas(run, "total binary").collect():
        total += np.frombuffer(r["total"]).reshape(shape)
    return total


def fit_logistic_rows(rows: DataFrame) -> np.ndarray:
    """fit_logistic over materialised rows (e, toxic), a pass for each step."""
    one = lambda x: np.column_stack([x, np.ones(len(x))])
    (n, pos), *_ = _sums(rows, lambda x, y: np.array([[len(y), y.sum()]]), (1, 2))
    if not 0 < pos < n:
        return np.zeros(EVIDENCE + 1)
    mean = _sums(rows, lambda x, y: x.sum(axis=0), (EVIDENCE,)) / n
    scale = np.maximum(np.sqrt(_sums(rows, lambda x, y: ((x - mean) ** 2).sum(axis=0), (EVIDENCE,)) / n), 1e-9)
    w = np.zeros(EVIDENCE + 1)
    for _ in range(50):

        def step(x, y, w=w):
            x = one((x - mean) / scale)
            p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
            weight = np.where(y == 1, 0.5 / pos, 0.5 / (n - pos))
            return np.column_stack([(x * (weight * p * (1 - p))[:, None]).T @ x, x.T @ (weight * (p - y))])

        got = _sums(rows, step, (EVIDENCE + 1, EVIDENCE + 2))
        move = np.linalg.solve(got[:, :-1] + 1e-3 * np.eye(EVIDENCE + 1), got[:, -1] + 1e-3 * w)
        w = w - move
        if np.abs(move).max() < 1e-7:
            break
    w[:-1] /= scale
    w[-1] -= w[:-1] @ mean
    return np.array([float(f"{v:.8g}") for v in w])  # sums differ in their last digits with the order of the rows


def best_cut_rows(rows: DataFrame) -> float:
    """best_cut over rows (z, hit, n) of any number: bins of scores that cannot hold the best F1 are left, the others are split until each holds one score."""
    lo, hi, hits = rows.agg(F.min("z"), F.max("z"), F.sum("hit")).first()
    if not hits:
        return math.inf
    open_, best = [(lo, hi, 0.0, 0.0)], (-1.0, 0.0)  # ranges and what lies above them: hits, rows
    while open_:
        edges = F.lit(None)
        for k, (a, b, _, _) in enumerate(open_):
            at = F.least(F.floor((F.col("z") - a) / (b - a) * 1024), F.lit(1023)) if b > a else F.lit(0)
            edges = F.when(F.col("z").between(a, b), k * 1024 + at).otherwise(edges)
        found = rows.select(edges.cast("long").alias("at"), "z", "hit", "n").where("at is not null").groupBy("at")
        found = found.agg(F.min("z").alias("lo"), F.max("z").alias("hi"), F.sum("hit").alias("hit"), F.sum("n").alias("n")).collect()
        left, was = [], None
        for r in sorted(found, key=lambda r: -r["lo"]):
            k = r["at"] // 1024
            if k != was:
                was, (_, _, hit, taken) = k, open_[k]
            f1 = 2 * (hit + r["hit"]) / (taken + r["n"] + hits)
            best = max(best, (f1, r["lo"]))
            if r["lo"] < r["hi"]:
                # at best all hits of the bin come first
                most = 2 * (hit + r["hit"]) / (taken + r["hit"] + hits)
                left.append((most, (r["lo"], r["hi"], hit, taken)))
            hit, taken = hit + r["hit"], taken + r["n"]
        left = sorted((x for x in left if x[0] >= best[0]), key=lambda x: -x[1][0])
        open_ = [x[1] for x in left]
    low = rows.where(F.col("z") < best[1]).agg(F.max("z")).first()[0]
    return float((best[1] + (best[1] - 1 if low is None else low)) / 2)


def _by_text(fn, kind: str, arrow: pa.DataType):
    """fn as a column function of a text. Texts become Python strings one at a time, so a batch costs its Arrow buffers only."""

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([fn(t.as_py()) for t in texts], arrow)

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, kind)


def _evidence(model: Model, part: int | None = -1):
    """The evidence of a text as a column function, by the model without the part; None: without the text's own part."""
    if part is not None:
        model = Model(model.keys, [x[[part]] for x in model.llr], model.rest[[part]])
        part = 0
    return _by_text(lambda text: model.evidence(text, part), "array<double>", pa.list_(pa.float64()))


def toxicity_scores(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, cut: float = 0.7, keep: tuple = ()) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs, after the columns named in keep.

    labels: doc_id and toxic (1 toxic, 0 ordinary); rows with crc32(doc_id as text) mod
    folds = held are never learnt from. A document labelled twice takes its higher
    label; null labels and ids are not learnt from. Without labels of both values all
    scores are 0. Null texts are empty; null ids are in no fold (held_out false);
    repeated rows score alike, and so do equal texts; a text of any length is scored
    whole; no rows give no rows; columns not named in keep are not read.
    """
    model, w, limit = learn(docs, labels, folds, held)
    fold = F.crc32(F.col("doc_id").cast("string")) % folds
    e = F.col("_evidence")
    z = F.lit(float(w[-1]))
    for k in range(len(w) - 1):
        z = z + F.element_at(e, k + 1) * float(w[k])
    base = math.log(cut / (1 - cut))
    z = z - F.lit(limit) + base if math.isfinite(limit) else F.lit(-math.inf)
    names = list(dict.fromkeys([*keep, "doc_id"]))
    scored = docs.select(*names, _evidence(model)(F.col("text")).alias("_evidence")).withColumn("_z", z)
    scored = scored.select(*names, F.coalesce(fold == held, F.lit(False)).alias("held_out"), (1 / (1 + F.exp(-F.col("_z")))).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= cut, 1).otherwise(0))


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    """Query: toxicity score and prediction of every document."""
    return toxicity_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
