"""Quality by Bradley-Terry ranking: logistic loss on feature differences of preference pairs.

Features are shares and ratios of a whole text. Every better with every worse document
of the labelled rows of the training folds makes a pair; their feature differences fit
the weights. The pairs are never listed: rows meet in bins of their scores, and a pair's
chance is that of its bins' mean scores. The threshold is the score quantile at the
share of worse documents among all these rows; the score maps it to `cut`.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import discard, materialize, read_table

PAIRS = 40_000  #: pairs that fit_pairs draws
BINS = 512  #: bins of scores, about equally full
COARSE = 16  #: bins that second moments are kept for; they only steer the steps
RIDGE = 1e-3
FEATURES = (
    "marks", "bangs", "bars", "upper", "digits", "spaces", "wide", "line_repeats", "word_variety",
    "word_length", "word_spread", "length", "line_length", "shouting", "top_word", "odd_words",
)

_KIND = np.zeros(256, np.uint8)
for _chars, _k in ((b"#$%&*@^~=<>{}[]\\/_+`", 1), (b"!?", 2), (b"|", 3), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 4), (b"0123456789", 5), (b" \t\n\x0b\x0c\r", 6), (b"abcdefghijklmnopqrstuvwxyz", 7)):
    _KIND[list(_chars)] = _k
_KIND[128:] = 8


def text_features(text: str | None) -> list[float]:
    """The feature values of one whole text; an empty or null text has zeros."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return [0.0] * len(FEATURES)
    kinds = np.bincount(_KIND[np.frombuffer(raw, np.uint8)], minlength=9) / len(raw)
    lines = [line for line in raw.split(b"\n") if line.strip()]
    sizes = np.fromiter(map(len, words), float, len(words))
    seen: dict = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    letters = kinds[4] + kinds[7] + kinds[8]
    shouted = sum(c for w, c in seen.items() if len(w) > 2 and w.isupper()) / len(words)
    odd = sum(c for w, c in seen.items() if not w[-1:].isalnum() and w[-1] < 128 and w[-1:] not in b".,;:'\")-") / len(words)
    return [
        kinds[1], kinds[2], kinds[3], kinds[4] / max(letters, 1e-9), kinds[5], kinds[6], kinds[8],
        1 - len(set(lines)) / len(lines), len(seen) / len(words) ** 0.9, min(sizes.mean(), 30) / 10, min(sizes.std(), 30) / 10,
        math.log1p(len(words)) / 10, min(math.log1p(len(words) / len(lines)), 10) / 10, shouted, max(seen.values()) / len(words), odd,
    ]


def with_features(docs: DataFrame) -> DataFrame:
    """(doc_id, one double per feature) of every row; only ids and texts are read."""

    def run(batches):
        for pdf in batches:
            x = pd.DataFrame([text_features(t) for t in pdf["text"]], columns=list(FEATURES), dtype=float)
            x.insert(0, "doc_id", pdf["doc_id"].astype("Int64").to_numpy())
            yield x

    kind = "doc_id long, " + ", ".join(f"{f} double" for f in FEATURES)
    return docs.select("doc_id", "text").mapInPandas(run, kind)


def fit_pairs(better: np.ndarray, worse: np.ndarray, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(weights, scale): Bradley-Terry weights of the scaled features by drawn pairs of rows at hand; zeros where a side is empty. Queries use fit_all_pairs."""
    scale = np.maximum(np.concatenate([better, worse]).std(axis=0), 1e-6) if len(better) + len(worse) else np.ones(len(FEATURES))
    w = np.zeros(len(FEATURES))
    if not len(better) or not len(worse):
        return w, scale
    rng = np.random.default_rng(seed)
    x = (better[rng.integers(0, len(better), PAIRS)] - worse[rng.integers(0, len(worse), PAIRS)]) / scale
    for _ in range(30):
        p = 1 / (1 + np.exp(np.clip(x @ w, -40, 40)))  # chance of the wrong order
        grad = -x.T @ p / len(x) + 1e-3 * w
        hess = (x * (p * (1 - p))[:, None]).T @ x / len(x) + 1e-3 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w, scale


def _moments(rows: DataFrame, mean: np.ndarray, scale: np.ndarray, w: np.ndarray, spread: float) -> tuple[np.ndarray, np.ndarray]:
    """Sums over all rows by label and bin of the score: (count, score, scaled features), and by label and coarse bin their second moments."""
    f = len(FEATURES)

    def run(batches):
        first, second = np.zeros((2 * BINS, f + 2)), np.zeros((2 * COARSE, f, f))
        for pdf in batches:
            x = (pdf[list(FEATURES)].to_numpy(float) - mean) / scale
            z = x @ w
            at = np.minimum((BINS / (1 + np.exp(np.clip(-1.7 * z / spread, -40, 40)))).astype(np.int64), BINS - 1)
            side = pdf["quality"].to_numpy(np.int64)
            for k, column in enumerate((None, z, *x.T)):
                first[:, k] += np.bincount(side * BINS + at, column, 2 * BINS)
            coarse = side * COARSE + at * COARSE // BINS
            for c in np.unique(coarse):
                second[c] += x[coarse == c].T @ x[coarse == c]
        yield pd.DataFrame({"first": [first.tobytes()], "second": [second.tobytes()]})

    first, second = np.zeros((2, BINS, f + 2)), np.zeros((2, COARSE, f, f))
    for r in rows.select("quality", *FEATURES).mapInPandas(run, "first binary, second binary").toLocalIterator():
        first += np.frombuffer(r["first"]).reshape(first.shape)
        second += np.frombuffer(r["second"]).reshape(second.shape)
    return first, second


def fit_all_pairs(rows: DataFrame) -> np.ndarray:
    """Bradley-Terry weights of the features by all pairs of a row of quality 1 and one of quality 0; zeros where a side is empty.

    rows: quality (0 or 1) and the features, materialised. A step costs one pass over
    the rows; a task hands on sums of a fixed size.
    """
    f = len(FEATURES)
    first, second = _moments(rows, np.zeros(f), np.ones(f), np.zeros(f), 1.0)
    n = first[:, :, 0].sum(axis=1)
    if not n.all():
        return np.zeros(f)
    mean = first[:, :, 2:].sum(axis=(0, 1)) / n.sum()
    moment = second.sum(axis=(0, 1)) / n.sum() - np.outer(mean, mean)
    scale = np.maximum(np.sqrt(np.maximum(np.diag(moment), 0)), 1e-6)
    moment = moment / np.outer(scale, scale)
    w, spread = np.zeros(f), 1.0
    for _ in range(30):
        (worse, better), (worse2, better2) = _moments(rows, mean, scale, w, spread)
        score = [s[:, 1] / np.maximum(s[:, 0], 1) for s in (better, worse)]
        p = 1 / (1 + np.exp(np.clip(score[0][:, None] - score[1][None, :], -40, 40)))  # chance of the wrong order
        q = p * (1 - p)
        grad = -((p @ worse[:, 0]) @ better[:, 2:] - (better[:, 0] @ p) @ worse[:, 2:]) / n.prod() + RIDGE * w
        cross = better[:, 2:].T @ q @ worse[:, 2:]
        hess = -cross - cross.T
        for own, own2, weight in ((better, better2, q @ worse[:, 0]), (worse, worse2, better[:, 0] @ q)):
            held = own[:, 0].reshape(COARSE, -1)
            mid = (weight.reshape(COARSE, -1) * held).sum(axis=1) / np.maximum(held.sum(axis=1), 1)
            hess = hess + np.tensordot(mid, own2, 1)
        step = np.linalg.solve(hess / n.prod() + RIDGE * np.eye(f), grad)
        w = w - step
        spread = max(math.sqrt(max(float(w @ moment @ w), 0.0)), 1e-6)
        if np.abs(step).max() < 1e-5:
            break
    # sums of doubles differ in their last digits with the order of the rows
    return np.array([float(f"{v:.8g}") for v in w / scale])


def ranked(rows: DataFrame, column: str, k: int) -> float:
    """The value of rank k, from 0, of a column of doubles: counts in ever narrower ranges, over all rows and without sorting them."""
    z = F.col(column)
    lo, hi = rows.agg(F.min(z), F.max(z)).first()
    while lo < hi:
        at = F.least(F.floor((z - lo) / (hi - lo) * 4096), F.lit(4095))
        found = rows.where(z.between(lo, hi)).groupBy(at.alias("at")).agg(F.count(z).alias("n"), F.min(z).alias("lo"), F.max(z).alias("hi")).collect()
        for r in sorted(found):
            if k < r["n"]:
                lo, hi = r["lo"], r["hi"]
                break
            k -= r["n"]
    return lo


def quality_scores(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, cut: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs.

    labels: doc_id and quality (1 better, 0 worse); rows with crc32(doc_id as text) mod
    folds = held are never learnt from. A document labelled twice takes its higher
    label; null labels and ids are not learnt from. Without labels of both values every
    score is the cut. Null texts are empty and scored like any other; null ids are in no
    fold (held_out false); repeated rows score alike, and so do equal texts; a text of
    any length is scored whole; no rows give no rows; extra columns are not read.
    """
    fold = F.crc32(F.col("doc_id").cast("string")) % folds
    x = materialize(with_features(docs).withColumn("held_out", F.coalesce(fold == held, F.lit(False))), "quality-features")
    learnt = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    learnt = materialize(x.where(~F.col("held_out")).join(learnt.where("quality in (0, 1)"), "doc_id").select("quality", *FEATURES), "quality-learnt")
    weights = fit_all_pairs(learnt)
    z = F.lit(0.0)
    for f, v in zip(FEATURES, weights, strict=True):
        z = z + F.col(f) * float(v)
    limit, n = 0.0, {r["quality"]: r["n"] for r in learnt.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(n) == 2:  # between the last score of the share of worse rows and the next
        scores = learnt.select(z.alias("z"))
        limit = (ranked(scores, "z", n[0] - 1) + ranked(scores, "z", n[0])) / 2
    discard(learnt)
    z = z + (math.log(cut / (1 - cut)) - limit)
    scored = x.select("doc_id", "held_out", (1 / (1 + F.exp(-z))).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= cut, 1).otherwise(0))


def op7_quality(spark, sf_dir: str) -> DataFrame:
    """Query: quality score and prediction of every document."""
    return quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
