"""Training reads every labelled row: weights, thresholds and counts do not come from a sample."""

import corpus_pipeline
import numpy as np
import pytest

from gridloom.llm import quality, toxicity
from gridloom.llm._base import materialize


def test_weights_are_those_of_all_pairs(spark):
    rng = np.random.default_rng(5)
    f = len(quality.FEATURES)
    x, y = rng.normal(0, 1, (500, f)), rng.integers(0, 2, 500)
    x[:, :3] += 0.6 * y[:, None]
    rows = spark.createDataFrame([(int(q), *map(float, r)) for q, r in zip(y, x)], "quality int, " + ", ".join(f"{n} double" for n in quality.FEATURES))
    scale = x.std(axis=0)
    w = quality.fit_all_pairs(materialize(rows.repartition(3), "test-pairs")) * scale
    d = ((x[y == 1][:, None, :] - x[y == 0][None, :, :]) / scale).reshape(-1, f)
    p = 1 / (1 + np.exp(d @ w))
    grad = -d.T @ p / len(d) + quality.RIDGE * w
    assert np.abs(grad).max() < 1e-4 and np.abs(w).max() > 0.3


def test_ranks_of_all_rows(spark):
    v = np.concatenate([np.random.default_rng(2).normal(0, 5, 3000), np.full(2000, 1.5)])
    rows = spark.createDataFrame([(float(a),) for a in v], "z double").repartition(3)
    for k in (0, 1200, 2999, 3000, 4999):
        assert quality.ranked(rows, "z", k) == np.sort(v)[k]


def test_quality_threshold_splits_all_labelled_rows(spark):
    """More rows than were once learnt from at most: as many lie below the threshold as are worse."""
    n = 24_000
    docs = spark.range(n).selectExpr("id AS doc_id", "concat('word ', repeat('!', int(pmod(xxhash64(id), 37))), ' and ', repeat('ab', int(pmod(xxhash64(id, 1), 91)))) AS text")
    labels = spark.range(n).selectExpr("id AS doc_id", "int(pmod(xxhash64(id), 37) + pmod(xxhash64(id, 2), 11) < 24) AS quality")
    got = quality.quality_scores(docs, labels).join(labels, "doc_id").where("not held_out").toPandas()
    assert (got["quality"] == 0).sum() > 8_000 and len(got) > 19_000
    # equal scores at the threshold fall on one side together
    near = (got["score"] - 0.3).abs().lt(1e-12).sum()
    assert abs((got["predicted"] == 0).sum() - (got["quality"] == 0).sum()) <= max(near, 8)


def test_cut_over_rows_is_the_best_of_all(spark):
    rng = np.random.default_rng(9)
    y = (rng.random(6000) < 0.2).astype(float)
    z, n = np.round(rng.normal(0, 1, 6000) + 1.5 * y, 3), rng.integers(1, 4, 6000).astype(float)
    rows = spark.createDataFrame([tuple(map(float, r)) for r in zip(z, y * n, n)], "z double, hit double, n double").repartition(3)
    cut, want = toxicity.best_cut_rows(rows), toxicity.best_cut(z, y, n)
    f1 = lambda c: 2 * (y * n)[z > c].sum() / (n[z > c].sum() + (y * n).sum())
    assert f1(cut) == f1(want)


def test_logistic_over_rows_is_the_same_fit(spark):
    rng = np.random.default_rng(4)
    y = (rng.random(700) < 0.3).astype(int)
    x = rng.normal(0, 2, (700, toxicity.EVIDENCE)) + y[:, None]
    rows = spark.createDataFrame([([float(v) for v in r], int(k)) for r, k in zip(x, y)], "e array<double>, toxic int").repartition(3)
    assert np.allclose(toxicity.fit_logistic_rows(rows), toxicity.fit_logistic(x, y.astype(float)), atol=1e-5)


def test_all_labelled_texts_are_counted(spark, monkeypatch):
    """More rows of a label than were once learnt from at most."""
    n, seen = 16_000, []
    docs = spark.range(n).selectExpr("id AS doc_id", "concat('a', id, ' b', id, ' c', id) AS text")
    labels = spark.range(n).selectExpr("id AS doc_id", "int(id % 400 = 0) AS toxic")

    def build(counts):
        seen.append(counts.where("level = 0").agg({c: "sum" for c in toxicity.COUNTS}).first())
        raise InterruptedError

    monkeypatch.setattr(toxicity, "build", build)
    try:
        toxicity.learn(docs, labels, folds=11)
    except InterruptedError:
        pass
    kept = labels.where("crc32(string(doc_id)) % 11 <> 1").count()
    assert kept > 12_000 and sum(seen[0]) == 3 * kept


def test_pipeline_counts_all_labelled_texts(spark, monkeypatch, tmp_path):
    n, seen = 16_000, []
    docs = spark.range(n).selectExpr("id AS doc_id", "concat('a', id, ' b', id) AS text", "'en' AS lang", "'s' AS source", "1L AS n_chars")
    spark.range(n).selectExpr("id AS doc_id", "int(id % 400 = 0) AS toxic").write.parquet(f"{tmp_path}/labels.parquet")

    def build(counts):
        seen.append(counts.where("level = 0").agg({c: "sum" for c in toxicity.COUNTS}).first())
        raise InterruptedError

    monkeypatch.setattr(toxicity, "build", build)
    try:
        corpus_pipeline.drop_toxic(spark, docs, str(tmp_path))
    except InterruptedError:
        pass
    assert sum(seen[0]) == 2 * docs.where("crc32(string(doc_id)) % 3 <> 1").count() > 20_000


def copies(spark, n):
    """n rows of a few texts and their near copies, each of more words than near copies differ by."""
    long = "concat_ws(' ', transform(sequence(1, 300), k -> concat('w', k * (1 + id % 3))))"
    return spark.range(n).selectExpr("id AS doc_id", f"concat({long}, ' end', id % 10) AS text", "'en' AS lang", "'s' AS source", "1L AS n_chars")


def test_near_copies_are_counted_row_by_row(spark, monkeypatch, tmp_path):
    n, seen = 60, []
    docs = copies(spark, n)
    labels = spark.range(n).selectExpr("id AS doc_id", "int(id % 3 = 0) AS toxic")
    labels.write.parquet(f"{tmp_path}/labels.parquet")

    def build(counts):
        seen.append(counts.where("level = 0").agg({c: "sum" for c in toxicity.COUNTS}).first())
        raise InterruptedError

    monkeypatch.setattr(toxicity, "build", build)
    for run in (lambda: toxicity.learn(docs, labels), lambda: corpus_pipeline.drop_toxic(spark, docs, str(tmp_path))):
        with pytest.raises(InterruptedError):
            run()
    kept = docs.where("crc32(string(doc_id)) % 3 <> 1").count()
    assert kept > 30 and [sum(s) for s in seen] == [301 * kept] * 2


def test_fit_and_cut_see_every_near_copy(spark, monkeypatch):
    seen = []
    real = toxicity.best_cut_rows

    def cut(rows):
        seen.extend(rows.agg({"n": "sum", "*": "count"}).first())
        return real(rows)

    monkeypatch.setattr(toxicity, "best_cut_rows", cut)
    docs = copies(spark, 60)
    toxicity.learn(docs, spark.range(60).selectExpr("id AS doc_id", "int(id % 3 = 0) AS toxic"))
    kept = docs.where("crc32(string(doc_id)) % 3 <> 1").count()
    assert seen == [kept, kept]


def test_a_text_and_its_near_copy_share_a_part():
    words = [f"w{k}" for k in range(2000)]
    part = lambda w: toxicity.part_of(toxicity.tokens(" ".join(w))[-1])
    assert part(words) == part([*words, "x"]) and {part([f"{k}-{j}" for j in range(5)]) for k in range(99)} == set(range(toxicity.PARTS))
    assert part([]) == part([]) and part(["a"]) in range(toxicity.PARTS)


def test_listed_expressions_come_without_python_rows(spark, monkeypatch):
    """A Python object for each number of the models' tables took the driver's memory."""
    docs = spark.range(50).selectExpr("concat('a b c', id % 5) AS text", "int(id % 2) AS toxic")
    counts = materialize(toxicity.count_expressions(docs), "test-listed")

    def rows(self):
        raise AssertionError("rows of the models came as Python objects")

    monkeypatch.setattr(type(counts), "toPandas", rows)
    listed, _, words = toxicity.listed_expressions(counts)
    assert words.sum() == 150 and len(listed[-1]) == 7
    assert all((np.diff(t["key"].to_numpy().astype(float)) > 0).all() for t in listed)
