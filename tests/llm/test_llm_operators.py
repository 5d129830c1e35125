"""Training-data operators on small fixtures: against brute force, with odd rows, and empty."""

import hashlib
import random
import re

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from gridloom.llm import bpe, chat_format, components, embedding_dedup, fingerprint, mixing, pii, quality, simhash_dedup, token_counts, toxicity
from gridloom.runtime import ship_package

DOCS = "doc_id long, text string, lang string, source string, n_chars long, base string, _size int, fp long"
LONG = "wort " * 30000 + "ende"


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship_package(spark)


def frame(spark, rows):
    """Documents of (id, text, source) with extra columns whose names operators use inside."""
    full = [(i, t, "en", s, None if t is None else len(t), "x", 1, 2) for i, t, s in rows]
    return spark.createDataFrame(full, DOCS)


ODD = [
    (1, "alpha beta gamma delta epsilon", "a"), (1, "alpha beta gamma delta epsilon", "a"), (2, None, "a"), (3, "", None), (None, "some words here", None),
    (4, LONG, "b"), (5, "  \n\t ", "b"), (6, "é中😀 mixed\x1fseparators", "c"), (7, "alpha beta gamma delta epsilon", "c"), (8, "one", "c"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, ODD)


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


# components


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + k) for k in range(1, 300)] + [(7, 7), (None, 3), (5, 4)]
    got = components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in got} == {**{i: 0 for i in range(61)}, **{100 + k: 100 for k in range(300)}}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# 1 mixing


def test_mix_meets_targets_and_caps(spark):
    rng = random.Random(5)
    docs = [(i, " ".join("w" * rng.randint(1, 5) for _ in range(rng.randint(1, 60))), rng.choice("abcde")) for i in range(3000)]
    got = mixing.mix_copies(frame(spark, docs)).toPandas()
    assert (got["taken"] <= 3 * got["size"]).all() and (got["copies"] <= 3).all() and len(got) == 3000
    per = got.groupby("source").agg(target=("target", "max"), taken=("taken", "sum"), size=("source_size", "max"))
    assert (per["target"] <= 3 * per["size"] + 1e-6).all()
    assert per["target"].sum() == pytest.approx(got["size"].sum())
    assert (abs(per["taken"] - per["target"]) <= 0.005 * per["target"] + 2).all()
    again = mixing.mix_copies(frame(spark, docs).repartition(7)).toPandas()
    pd.testing.assert_frame_equal(got.sort_values("doc_id", ignore_index=True), again.sort_values("doc_id", ignore_index=True))


def test_targets_reshare_what_caps_cut_off(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 5)], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(sizes).collect()}
    # a takes 30 and null, weighing 5 again, 15; b and c share the rest 2 to 1
    assert got["a"] == 30 and got[None] == 15
    assert got["b"] == pytest.approx((2015 - 45) * 2 / 3) and got["c"] == pytest.approx((2015 - 45) / 3)


def test_longer_documents_are_likelier(spark):
    docs = [(i, " ".join(["w"] * (5 if i % 2 else 400)), "ab"[i % 4 > 1]) for i in range(4000)]
    got = mixing.mix_copies(frame(spark, docs)).where("source = 'b'").toPandas()
    rate = got.groupby("size")["copies"].mean()
    assert rate[400] > rate[5]


def test_mix_of_odd_and_no_rows(odd, none):
    got = mixing.mix_copies(odd).toPandas()
    assert len(got) == len(ODD) and got.loc[got["size"] == 0, "taken"].eq(0).all()
    assert mixing.mix_copies(none).count() == 0
    assert mixing.repeated(odd).columns == odd.columns and mixing.repeated(none).count() == 0


# 2 fingerprints


def test_followers_edits_and_likeness(spark, odd):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["ab", "cd", "ef", "gh", "ij"]) + str(rng.randint(0, 99)) for _ in range(rng.randint(0, 80))) for _ in range(120)]
    got = fingerprint.fingerprint_table(frame(spark, [(i * 3, t, "a") for i, t in enumerate(texts)])).toPandas().sort_values("doc_id")
    for i, r in enumerate(got.itertuples()):
        t, after = texts[i], texts[(i + 1) % len(texts)]
        k = len(t) // 4
        new = t[: len(t) - k] + after[:k]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(new.encode()).hexdigest())
        assert r.fp == np.uint64(fingerprint.simhash(t)).astype(np.int64) and r.edited_fp == np.uint64(fingerprint.simhash(new)).astype(np.int64)
    assert got["near_edited"].mean() > got["near_next"].mean() + 0.15
    assert fingerprint.fingerprint_table(odd).count() == len(ODD)


def test_one_and_no_document(spark, none):
    one = fingerprint.fingerprint_table(frame(spark, [(5, "abcdefgh", "a")])).collect()
    assert one[0]["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest()
    assert fingerprint.fingerprint_table(none).count() == 0


def test_simhash_of_equal_words_and_of_none():
    assert fingerprint.simhash(None) == fingerprint.simhash(" \n") == 0
    assert fingerprint.simhash("Ab  cd\tEF") == fingerprint.simhash("aB cd ef")
    assert fingerprint.simhash("x" * 100000) != 0


def test_block_tables_find_all_within_radius(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    near = [b ^ np.uint64(sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 6), replace=False))) for b in base for _ in range(12)]
    fps = np.unique(np.concatenate([base, np.array(near, np.uint64)]))
    want = {int(f.astype(np.int64)): int((np.bitwise_count(fps ^ f) <= 3).sum()) - 1 for f in fps}
    df = spark.createDataFrame([(int(f.astype(np.int64)),) for f in fps], "fp long")
    got = {r["fp"]: r["n_near"] for r in fingerprint.near_fingerprints(df).collect()}
    assert got == {k: v for k, v in want.items() if v}


# 3 personal data


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    def good(kind, s):
        d = [int(c) for c in s if c.isdigit()]
        if kind == "ip":
            return all(int(p) <= 255 for p in s.split("."))
        if kind == "card":
            return 12 <= len(d) <= 19 and sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(d[::-1])) % 10 == 0
        return kind == "email" or 9 <= len(d) <= 15

    spans = [(m.start(), k, name, m.end()) for k, (name, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text) if good(name, m.group())]
    return ",".join(f"{name}:{a}:{b}" for a, _, name, b in sorted(spans))


def test_base_spans_equal_plain_patterns(spark):
    rng = random.Random(8)
    bits = ["a@b.c", "a@b", "_x@d.e-f.g", "@", ".", "-", " ", "1", "23", "4111 1111-1111 1111", "4111111111111112", "10.0.0.255", "1.2.3.4.5", "999.1.1.1", "+1 (555) 123-4567", "+12", "+", "é", "😀", "\n", "(", "00123456789012345678", "b.c_y@z.q"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(1500)]
    docs = frame(spark, [(i, t, "a") for i, t in enumerate(texts)])
    found = pii.find_spans(docs, np.zeros(14) - 9).select("doc_id", pii.span_list("base_").alias("base")).toPandas()
    bad = [(texts[r.doc_id], r.base, base_spans(texts[r.doc_id])) for r in found.itertuples() if r.base != base_spans(texts[r.doc_id])]
    assert not bad, bad[:3]


def test_very_long_runs_do_not_break_the_patterns(spark):
    texts = ["a" * 200000, "1" * 200000, "1 " * 100000, "1." * 100000, "a@" * 50000, "+1" + " " * 100000, "a.b" * 60000 + "@c.d"]
    found = pii.find_spans(frame(spark, [(i, t, "a") for i, t in enumerate(texts)]), np.zeros(14) - 9)
    got = {r["doc_id"]: r["n"] for r in found.select("doc_id", F.size("base_").alias("n")).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 25000, 4: 0, 5: 0, 6: 1}


def test_classifier_adds_what_context_supports(spark):
    rng = random.Random(1)
    rows = []
    for i in range(400):
        d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
        rows.append((i, f"call my phone +1 (555) {d(3)}-{d(4)} now or mail me{i}@site.com" if i % 2 else f"phone ({d(3)}) {d(3)}-{d(4)} and write to bob{i} [at] site [dot] com", "a"))
    docs = frame(spark, rows)
    w = pii.train(docs)
    found = pii.find_spans(docs, w).withColumn("masked", pii.masked(F.col("text"), "spans")).toPandas()
    assert (found["spans"].map(len) >= found["base_"].map(len)).all() and found["base"].eq("x").all()
    even = found[found["doc_id"] % 2 == 0]
    assert (even["spans"].map(len) > 0).mean() > 0.9 and even["masked"].str.contains("<phone>").mean() > 0.9
    assert found[found["doc_id"] % 2 == 1]["masked"].str.contains(r"^call my phone <phone> now or mail <email>$").all()


def test_spans_of_odd_and_no_rows(odd, none):
    w = pii.train(odd)
    assert pii.find_spans(odd, w).count() == len(ODD)
    assert not pii.train(none).any() and pii.find_spans(none, pii.train(none)).count() == 0


# 4 byte-level BPE


PATH = public_tokenizers.path(bpe.RANKS)


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


def odd_texts():
    rng = random.Random(3)
    bits = [" ", "  ", "\n", "\t", "a", "Bc", "1", "é", "中", "!", "...", "'s", "\x1c", "\x85", "don't", " the", "\r\n", "😀", "٣", "ab" * 40, "　", " .", "�"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(600)]


def test_ids_equal_the_library(spark, reference):
    texts = odd_texts() + ["abc" * 5000, LONG[:3000]]
    docs = frame(spark, [(i, t, "a") for i, t in enumerate(texts)])
    got = bpe.encode_documents(docs, PATH).select("doc_id", "ids", bpe.decoded(F.col("ids"), PATH).alias("raw")).toPandas()
    for r in got.itertuples():
        assert list(r.ids) == reference.encode_ordinary(texts[r.doc_id])
        assert bytes(r.raw).decode() == texts[r.doc_id]


def test_higher_order_form_gives_the_same_ids(spark, reference):
    texts = odd_texts()[:150]
    docs = frame(spark, [(i, t, "a") for i, t in enumerate(texts)])
    for r in docs.select("doc_id", bpe.encoder(PATH)(F.col("text")).alias("ids")).collect():
        assert r["ids"] == reference.encode_ordinary(texts[r["doc_id"]])


def test_pieces_of_one_length_fold_alike():
    ranks, rng = bpe.load_ranks(PATH), random.Random(14)
    for n in (2, 3, 5, 9, 17, 64):
        pieces = list({"".join(rng.choice(" thereandonins\u00e9z") for _ in range(n)).encode()[:n] for _ in range(300)})
        pieces = [p for p in pieces if len(p) == n]
        want = [b"".join(ranks[x].to_bytes(4, "little") for x in bpe.fold_merges(p, ranks)) for p in pieces]
        assert bpe.fold_words(pieces, PATH) == want


def test_words_are_forgotten_and_learnt_again(reference, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 20)
    rng, encoder = random.Random(15), bpe.WordEncoder(PATH)
    for _ in range(30):
        texts = ["".join(rng.choice(["ab", "cde", " ", "\n", ".", "...", "\n\n", " x", "9", "\r\n", "é", "w" * 300]) for _ in range(rng.randint(0, 30))) for _ in range(20)] + [None]
        assert [list(i) for i in encoder.encode(texts)] == [reference.encode_ordinary(t or "") for t in texts]


def test_long_pieces_merge_alike():
    ranks = bpe.load_ranks(PATH)
    rng = random.Random(4)
    for n in (256, 700, 3000):
        piece = bytes(rng.choice(b"abcdethe ") for _ in range(n))
        short, bpe.LONG = bpe.LONG, 10**9
        try:
            want = bpe.fold_merges(piece, ranks)
        finally:
            bpe.LONG = short
        assert bpe.fold_merges(piece, ranks) == want


def test_bpe_of_odd_and_no_rows(odd, none):
    assert bpe.encode_documents(odd, PATH).where("size(ids) = 0").count() == 2
    assert bpe.encode_documents(none, PATH).count() == 0


# 5 embeddings


def test_links_equal_brute_force(spark):
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((60, 24))
    x = np.concatenate([c + rng.standard_normal((k, 24)) * 0.12 for c, k in zip(centres, rng.integers(1, 40, 60), strict=True)]).astype(np.float32)
    x = np.concatenate([x, x[:25], x[:10] * 3])
    rows = [(i, v.tolist(), "l") for i, v in enumerate(x)]
    got = embedding_dedup.embedding_components(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string")).toPandas().sort_values("vec_id")
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    link = u @ u.T >= 0.95
    np.fill_diagonal(link, False)
    found = got["n_links"].to_numpy()
    assert (found <= link.sum(1)).all() and found.sum() >= 0.99 * link.sum()
    label = np.arange(len(x))
    while True:
        new = np.minimum(label, np.where(link, label[None], len(x)).min(1))
        if (new == label).all():
            break
        label = new
    assert (got["component_id"].to_numpy() == label).mean() > 0.99


def test_large_buckets_are_tiled(spark):
    rng = np.random.default_rng(7)
    x = np.ones((700, 8)) + rng.standard_normal((700, 8)) * 0.01
    tiles = embedding_dedup.TILE, embedding_dedup.VECTORS
    embedding_dedup.TILE, embedding_dedup.VECTORS = 96, 64
    try:
        got = embedding_dedup.embedding_components(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).toPandas()
    finally:
        embedding_dedup.TILE, embedding_dedup.VECTORS = tiles
    assert (got["n_links"] == 699).all() and (got["component_id"] == 0).all() and got["kept"].sum() == 1


def test_vectors_that_link_with_nothing(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, None), (3, [0.0, 0.0]), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, []), (9, [1.0, None]), (10, [1.0, 2.0]), (11, [1.0, 2.0, 0.0]), (None, [1.0, 2.0]), (12, [1e-30, 2e-30])]
    got = embedding_dedup.embedding_components(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas().set_index("vec_id")
    assert (got.loc[range(1, 10), "n_links"] == 0).all() and got.loc[range(1, 10), "kept"].all()
    assert got.loc[10, "n_links"] == 2 and got.loc[12, "component_id"] == 10 and got.loc[11, "n_links"] == 0
    assert embedding_dedup.embedding_components(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


# 6 chat formatting


def test_chats_read_back(spark):
    rng = random.Random(9)
    bits = ["\\", "#", "### ", "</turn>", " </turn>\n", "assistant: ", ":", "\n", "é", "x", "<", "\\\\#"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "a:#b\\"]), "".join(rng.choice(bits) for _ in range(rng.randint(0, 9)))) for c in range(120) for t in range(rng.randint(1, 6))]
    rows += [(500, 1, "assistant", None), (500, None, None, "n"), (None, 2, "user", "q"), (None, 1, "assistant", "p")]
    chats = chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    want = {}
    for c, _, r, t in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or 0)):
        want.setdefault(c, []).append((r or "", t or ""))
    got = chats.toPandas()
    assert len(got) == len(want)
    for r in got.itertuples():
        turns = want[None if pd.isna(r.conv_id) else int(r.conv_id)]
        assert chat_format.read_back(r.formatted) == turns and r.n_turns == len(turns)
        raw = r.formatted.encode()
        loss = [chat_format.unescape(raw[a:b]).decode() for a, b in zip(r.loss_starts, r.loss_ends, strict=True)]
        assert loss == [t for role, t in turns if role == "assistant"]


def test_conversations_larger_than_a_batch(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        rows = [(c, t, "assistant", f"{c}-{t}") for c in range(6) for t in range(40)]
        got = chat_format.digests(chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).toPandas()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {c: hashlib.sha256("".join(f"{c}-{t}" for t in range(40)).encode()).hexdigest() for c in range(6)}
    assert dict(zip(got["conv_id"], got["loss_sha256"], strict=True)) == want


def test_no_conversations(spark):
    assert chat_format.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# 7 and 8 classifiers


def labelled(spark, n, make):
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(n):
        y = int(rng.random() < 0.5)
        rows.append((i, make(rng, y), "a"))
        labels.append((i, y, y))
    return frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def words(rng, n):
    return [rng.choice("ba de fo gu ki lo me nu pa ri".split()) + rng.choice("na te so du mi".split()) for _ in range(n)]


def test_quality_ranks_held_out_documents(spark, odd, none):
    docs, labels = labelled(spark, 800, lambda r, y: " ".join(w + ("" if y else r.choice(["###", "!!", "|", ""])) for w in words(r, 40)))
    got = quality.quality_scores(docs, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    held = got[got["held_out"]]
    assert len(held) > 100 and (held["predicted"] == held["quality"]).mean() > 0.95 and got["score"].between(0, 1).all()
    assert quality.quality_scores(odd, labels).count() == len(ODD) and quality.quality_scores(none, labels).count() == 0
    assert quality.quality_scores(odd, labels.where("quality = 1")).where("score is null").count() == 0


def test_toxicity_of_held_out_documents(spark, odd, none):
    docs, labels = labelled(spark, 900, lambda r, y: " ".join(words(r, 60) + ([r.choice(["vilo", "grot", "snee"])] * 3 if y else [])))
    got = toxicity.toxicity_scores(docs, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    held = got[got["held_out"]]
    assert len(held) > 200 and (held["predicted"] == held["toxic"]).mean() > 0.97
    assert toxicity.toxicity_scores(odd, labels).count() == len(ODD) and toxicity.toxicity_scores(none, labels).count() == 0
    plain = toxicity.toxicity_scores(odd, labels.where("toxic = 0")).toPandas()
    assert plain["score"].eq(0).all() and plain["predicted"].eq(0).all()


# 9 SimHash near-dedup


def plain_fingerprint(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_equal_plain_ones(spark, odd):
    rng = random.Random(12)
    texts = [" ".join(words(rng, rng.randint(0, 30))).title() for _ in range(80)] + ["É A\x0bb\x1fc", None]
    for t in texts:
        assert simhash_dedup.shingle_fingerprint(t, 4) == plain_fingerprint(t, 4)
    first = spark.range(1).select(F.xxhash64(F.lit("a b c d")).alias("h")).first()["h"]
    assert simhash_dedup.shingle_fingerprint("a b c d", 4) == first % 2**64
    assert simhash_dedup.simhash_components(odd).count() == len(ODD)


@pytest.mark.parametrize("tile", [1 << 18, 12])
def test_components_equal_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(simhash_dedup, "SHARD_TILE", tile)
    rng = np.random.default_rng(13)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    chain = [b ^ np.uint64(sum(1 << int(k) for k in rng.choice(64, rng.integers(1, 9), replace=False))) for b in base for _ in range(9)]
    fps = np.unique(np.concatenate([base, np.array(chain, np.uint64)]))
    df = spark.createDataFrame([(int(f.astype(np.int64)),) for f in fps], "fp long")
    parent = np.arange(len(fps))
    for r in simhash_dedup.hamming_forest(df, 4, leaf=64).collect():
        i, j = (int(np.searchsorted(fps, np.int64(r[c]).astype(np.uint64))) for c in ("a", "b"))
        simhash_dedup.union_pairs(parent, np.array([i]), np.array([j]))
    want = np.arange(len(fps))
    i, j = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None]) <= 4)
    simhash_dedup.union_pairs(want, i, j)
    np.testing.assert_array_equal(parent, want)


def test_one_of_each_group_stays(spark, odd, none):
    kept = simhash_dedup.deduplicated(odd)
    assert kept.columns == odd.columns
    ids = sorted((r["doc_id"] for r in kept.collect()), key=str)
    assert ids.count(1) == 1 and 7 not in ids and 8 in ids and 2 in ids and 3 not in ids and 5 not in ids
    assert simhash_dedup.deduplicated(none).count() == 0 and simhash_dedup.simhash_components(none).count() == 0


# 10 token counts


END = token_counts.END


@pytest.mark.parametrize("size", [1, 3, 64])
def test_separator_scan_over_any_blocks(spark, size):
    rng = np.random.default_rng(size)
    ids = rng.integers(0, 9, 400).astype("<u2")
    ids[rng.random(400) < 0.1] = END
    ids[50:170] = 3
    raw = ids.tobytes()
    blocks = [("f", i, bytearray(raw[k : k + 2 * size])) for i, k in enumerate(range(0, len(raw), 2 * size))] + [("g", 0, bytearray(np.array([END, END], "<u2").tobytes()))]
    found = token_counts.document_lengths(token_counts.block_summaries(spark.createDataFrame(blocks, "file string, part long, payload binary")), group=4).toPandas()
    at = np.flatnonzero(ids == END)
    want = (np.diff(np.concatenate([[-1], at])) - 1).tolist()
    rest = len(ids) - 1 - at[-1]
    f = found[found["file"] == "f"].sort_values("number")
    assert f["n_tokens"].tolist() == want + ([rest] if rest else []) and f["ended"].sum() == len(at)
    assert found[found["file"] == "g"]["n_tokens"].tolist() == [0, 0]


def test_counts_of_odd_and_no_rows(odd, none):
    path = public_tokenizers.path(token_counts.TOKENIZER)
    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    got = sorted((r["doc_id"] or 0, r["n_tokens"]) for r in token_counts.token_counts(odd, path).collect())
    assert got == sorted((i or 0, len(enc.encode_ordinary(t or ""))) for i, t, _ in ODD)
    assert token_counts.token_counts(none, path).count() == 0


def test_token_files_hold_the_library_ids(spark, tmp_path):
    path = public_tokenizers.path(token_counts.TOKENIZER)
    enc = token_counts._tokenizer(path)
    rng = random.Random(20)
    texts = [" ".join(words(rng, rng.randint(0, 40))) + rng.choice(["", "é中😀", "\n\r\n"]) for _ in range(90)]
    docs = frame(spark, [(i, t, "a") for i, t in enumerate(texts)]).repartition(3)
    token_counts.write_token_files(docs, path, f"{tmp_path}/t")
    names = {}
    for r in token_counts.document_names(spark, f"{tmp_path}/t").collect():
        names.setdefault(r["file"], {})[r["number"]] = r["doc_id"]
    assert len(names) == 3 and sorted(i for n in names.values() for i in n.values()) == list(range(len(texts)))
    for f, own in names.items():
        want = [x for k in sorted(own) for x in [*enc.encode_ordinary(texts[own[k]]), END]]
        (file,) = (tmp_path / "t/kind=tokens").glob(f"part-{f:05d}-*")
        assert np.frombuffer(file.read_bytes(), "<u2").tolist() == want
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(docs, path).collect()}
    assert got == {i: len(enc.encode_ordinary(t)) for i, t in enumerate(texts)}


def test_flat_files_are_cut_into_blocks(spark, tmp_path):
    ids = np.array([5, 6, END, 7, END], "<u2")
    (tmp_path / "a.bin").write_bytes(ids.tobytes())
    blocks = token_counts.flat_files(spark, str(tmp_path), block=4)
    got = token_counts.document_lengths(token_counts.block_summaries(blocks)).orderBy("number").collect()
    assert [r["n_tokens"] for r in got] == [2, 1]
