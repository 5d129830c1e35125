"""Every opN query on the smallest tables: its columns, and its rows against plain computations."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import tiktoken
import xxhash

import corpus_pipeline
from gridloom.llm import bpe, chat_format, queries, quality, simhash_dedup, token_counts, toxicity

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")

COLUMNS = {
    "op1_pareto_mixing": ["doc_id", "size", "source_size", "target", "taken"],
    "op2_fingerprints": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    "op3_pii": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    "op4_byte_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op5_embedding_dedup": ["vec_id", "n_links", "component_id", "kept"],
    "op6_chat_format": ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
    "op7_quality": ["doc_id", "held_out", "score", "predicted"],
    "op8_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op9_simhash_dedup": ["doc_id", "fingerprint", "component_id"],
    "op10_token_counts": ["doc_id", "n_tokens"],
}


def table(name):
    return duckdb.sql(f"SELECT * FROM '{SF}/{name}.parquet'").df()


@pytest.fixture(scope="module")
def docs():
    return table("documents").sort_values("doc_id", ignore_index=True)


@pytest.fixture(scope="module")
def got(spark):
    """The rows of a query, asked once."""
    held = {}

    def rows(name):
        if name not in held:
            held[name] = queries.QUERIES[name](spark, SF).toPandas()
        return held[name]

    return rows


@pytest.mark.parametrize("name", list(COLUMNS))
def test_a_row_for_every_row(got, name):
    rows = got(name)
    source = "embeddings" if name.startswith("op5") else "conversations" if name.startswith("op6") else "documents"
    n = table(source)["conv_id"].nunique() + 1 if source == "conversations" else len(table(source))
    assert list(rows.columns)[: len(COLUMNS[name])] == COLUMNS[name] and len(rows) == n


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows_as_sql(got, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want, rows = con.sql(queries.ORACLE_SQL[name]).df(), got(name)
    assert list(rows.columns) == list(want.columns)
    key = [rows.columns[0]]
    pd.testing.assert_frame_equal(rows.sort_values(key, ignore_index=True), want.sort_values(key, ignore_index=True), check_dtype=False)


# 2


def plain_simhash(text):
    top = 2**64 - 1

    def mixed(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & top
        x = (x ^ x >> 27) * 0x94D049BB133111EB & top
        return x ^ x >> 31

    spread = 0x9E3779B97F4A7C15
    words = [mixed(sum((b + 1) * pow(spread, i, 2**64) for i, b in enumerate(w)) & top) for w in re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), text.encode()))]
    terms = Counter(mixed(a * spread + b & top) for a, b in zip(words, words[1:])) if len(words) > 1 else Counter(words)
    votes = [sum((1 + math.log2(c)) * (1 if t >> b & 1 else -1) for t, c in terms.items()) for b in range(64)]
    return sum(1 << b for b in range(64) if votes[b] > 1e-9)


def test_fingerprints_of_texts_and_their_edits(got, docs):
    rows = got("op2_fingerprints").set_index("doc_id")
    texts = list(docs["text"].fillna(""))
    marks = [plain_simhash(t) for t in texts]
    for i, d in enumerate(docs["doc_id"]):
        after, k = texts[(i + 1) % len(texts)], len(texts[i]) // 4
        new = texts[i][: len(texts[i]) - k] + after[:k]
        edit = plain_simhash(new)
        r = rows.loc[d]
        assert (r["n_chars"], r["fingerprint"], r["edited_fingerprint"]) == (len(texts[i]), f"{marks[i]:016x}", f"{edit:016x}")
        assert r["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
        assert r["near_edited"] == 1 - (marks[i] ^ edit).bit_count() / 64 and r["near_next"] == 1 - (marks[i] ^ marks[(i + 1) % len(marks)]).bit_count() / 64


# 4, 10


def test_ids_and_counts_are_the_library_s(got, docs):
    ranks = lambda name: bpe.load_ranks(public_tokenizers.path(name))
    library = lambda name: tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(name), special_tokens={})
    ids, count = library(bpe.RANKS), library(token_counts.TOKENIZER)
    four, ten = got("op4_byte_bpe").set_index("doc_id"), got("op10_token_counts").set_index("doc_id")
    sha = lambda raw: hashlib.sha256(raw).hexdigest()
    for d, t in zip(docs["doc_id"], docs["text"].fillna("")):
        own = ids.encode_ordinary(t)
        assert tuple(four.loc[d, ["n_tokens", "ids_sha256", "decoded_sha256"]]) == (len(own), sha(",".join(map(str, own)).encode()), sha(t.encode()))
        assert ten.loc[d, "n_tokens"] == len(count.encode_ordinary(t))


# 5


def test_links_are_those_of_all_pairs(got):
    rows, v = got("op5_embedding_dedup").sort_values("vec_id"), table("embeddings").sort_values("vec_id")
    x = np.array([np.array(e, float) for e in v["embedding"]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    link = x @ x.T >= 0.95
    np.fill_diagonal(link, False)
    assert (rows["n_links"].to_numpy() == link.sum(1)).all() and (rows["kept"] == (rows["vec_id"] == rows["component_id"])).all()


# 6


def test_conversations_read_back(got):
    rows = got("op6_chat_format").set_index("conv_id")
    said = r"\### Assistant: </turn> ok"
    turns = defaultdict(list, {-7: [("user", said), ("assistant", said)]})
    for r in table("conversations").sort_values(["conv_id", "turn", "role", "text"]).itertuples():
        turns[r.conv_id].append((r.role if isinstance(r.role, str) else "", r.text if isinstance(r.text, str) else ""))
    assert set(rows.index) == set(turns)
    for c, own in turns.items():
        loss = "".join(t for role, t in own if role == "assistant")
        whole = "".join(f"{role}\n{t}\n" for role, t in own)
        r = rows.loc[c]
        assert (r["n_turns"], r["turns_sha256"]) == (len(own), hashlib.sha256(whole.encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        size = sum(len(f"### {role}:  </turn>\n") + len(t) + sum(map(t.count, "\\#<")) for role, t in own)
        assert r["formatted_chars"] == size


def test_buffers_are_cut_between_conversations():
    import pyarrow as pa

    rows = [(c, "user", "x#" * 40) for c in range(9) for _ in range(3)]
    t = pa.table({"conv_id": pa.array([r[0] for r in rows], pa.int64()), "role": [r[1] for r in rows], "text": [r[2] for r in rows]})
    parts = list(chat_format.bounded(t, 1200))
    assert len(parts) > 3 and all(len(set(p["conv_id"].to_pylist())) >= 1 for p in parts)
    made = pa.Table.from_batches([chat_format.assemble(p) for p in parts])
    assert made.equals(pa.Table.from_batches([chat_format.assemble(t)]).combine_chunks()) or made.to_pydict() == pa.Table.from_batches([chat_format.assemble(t)]).to_pydict()


# 7, 8


@pytest.mark.parametrize(("name", "folds", "held", "cut"), [("op7_quality", 5, 0, 0.3), ("op8_toxicity", 3, 1, 0.7)])
def test_folds_and_predictions_follow_their_rules(got, name, folds, held, cut):
    rows = got(name)
    assert (rows["held_out"] == [zlib.crc32(str(d).encode()) % folds == held for d in rows["doc_id"]]).all()
    assert rows["score"].between(0, 1).all() and (rows["predicted"] == (rows["score"] >= cut)).all()


def test_pair_weights_are_where_the_loss_is_least():
    rng = np.random.default_rng(3)
    better, worse = rng.normal(0.3, 1, (200, len(quality.FEATURES))), rng.normal(0, 1, (150, len(quality.FEATURES)))
    w, scale = quality.fit_pairs(better, worse)
    draw = np.random.default_rng(7)
    x = (better[draw.integers(0, 200, quality.PAIRS)] - worse[draw.integers(0, 150, quality.PAIRS)]) / scale
    loss = lambda v: np.log1p(np.exp(-x @ v)).mean() + 0.5e-3 * v @ v
    least = loss(w)
    for k in range(len(w)):
        for step in (-1e-2, 1e-2):
            assert loss(w + step * np.eye(len(w))[k]) > least


CORPUS = [("idle hands idle minds idly", 1), ("idle minds wander", 1), ("hands wander wide and wide", 0), ("minds at rest and hands at rest", 0), ("restless hands rest", 0), ("wander wide idle", 0), ("idle idle idle", 1)]


class Plain:
    def __init__(self, levels, counts, cont, total, place):
        self.levels, self.counts, self.cont, self.total, self.place = levels, counts, cont, total, place
        self.left = [1 - sum(max(n - toxicity.DISCOUNT, 0) for n in c.values()) / total for c in counts]

    def __call__(self, w, k):
        """Probability of an expression; of one that is not known, of the place that its stem keeps for such."""
        key = self.levels[k](w)
        known = key in self.cont[k]
        if k == 0:
            base = (self.cont[0][key] + 1) / self.place if known else 1 / self.place
        else:
            up = self.levels[k - 1](w)
            base = self(w, k - 1) * (self.cont[k][key] if known else 1) / (self.cont[k - 1][up] + 1) if up in self.cont[k - 1] else self(w, k - 1)
        return max(self.counts[k][key] - toxicity.DISCOUNT, 0) / self.total + self.left[k] * base


def plain_models(parts, left_out):
    """log ratios by a plain rewrite of the interpolation, over dicts; parts: part of each text of CORPUS."""
    levels = [lambda w: w[:4], lambda w: w[:6], lambda w: w]
    before = defaultdict(set)
    for t, _ in CORPUS:
        w = t.split()
        for a, b in zip([None, *w], w):
            before[b].add(a)
    cont = [Counter() for _ in levels]
    for w, s in before.items():
        for k, f in enumerate(levels):
            cont[k][f(w)] += len(s)
    models = []
    for y in (0, 1):
        words = [w for (t, v), p in zip(CORPUS, parts) for w in t.split() if v == y and p != left_out]
        counts = [Counter(map(f, words)) for f in levels]
        total, place = max(len(words), 1), sum(cont[0].values()) + len(cont[0]) + 1
        models.append(Plain(levels, counts, cont, total, place))
    return models, cont


def test_models_equal_plain_interpolation(spark):
    parts = [k % toxicity.PARTS for k in range(len(CORPUS))]
    sample = spark.createDataFrame([(t, y, p) for (t, y), p in zip(CORPUS, parts)], "text string, toxic int, part int")
    model = toxicity.build(corpus_pipeline.materialize(toxicity.count_expressions(sample), "test-counts"))
    asked = sorted({w for t, _ in CORPUS for w in t.split()}) + ["idlers", "idle-x", "handsome", "nothing"]
    for part in (*range(toxicity.PARTS), -1):
        (ordinary, toxic), _ = plain_models(parts, part if part >= 0 else None)
        for w in asked:
            if "-" in w:
                continue
            want = math.log(toxic(w, 2)) - math.log(ordinary(w, 2))
            assert model.ratios(toxicity.tokens(w), part)[0] == pytest.approx(want, abs=1e-5), (part, w)


def test_probabilities_of_a_level_add_up_to_one():
    models, cont = plain_models([0] * len(CORPUS), None)
    for prob in models:
        unseen = prob.left[0] / prob.place  # what a level keeps for expressions that were never seen
        assert sum(prob(s, 0) for s in cont[0]) + unseen == pytest.approx(1)
        for k in (1, 2):
            unseen = prob.left[k] * (unseen + sum(prob(up, k - 1) / (cont[k - 1][up] + 1) for up in cont[k - 1]))
            assert sum(prob(w, k) for w in cont[k]) + unseen == pytest.approx(1)


def test_listed_probabilities_add_up_to_what_is_not_left():
    table = pd.DataFrame({"cont": [3, 1], "under": [0, 0], "parent": [0, 0]})
    below = pd.DataFrame({"cont": [2, 1, 1], "under": [3, 3, 1], "parent": [0, 0, 1]})
    probs, rest = toxicity.kneser_ney([table, below], 4 + 2 + 1, [np.array([9.0, 4.0]), np.array([6.0, 3.0, 4.0])], 13.0)
    assert probs[0].sum() + rest[0] / 7 == pytest.approx(1)
    assert probs[1].sum() + rest[1] * (probs[0] / (table["cont"] + 1)).sum() + rest[1] * rest[0] / 7 == pytest.approx(1)


# 9


def plain_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def smallest(n, pairs):
    at = list(range(n))
    for i, j in pairs:
        a, b = at[i], at[j]
        if a != b:
            at = [min(a, b) if x in (a, b) else x for x in at]
    return at


def test_components_are_those_of_all_pairs(got, docs):
    rows = got("op9_simhash_dedup").set_index("doc_id")
    fps = [plain_fingerprint(t) for t in docs["text"].fillna("")]
    ids = list(docs["doc_id"])
    root = smallest(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    for i, d in enumerate(ids):
        assert rows.loc[d, "fingerprint"] == f"{fps[i]:016x}" and rows.loc[d, "component_id"] == ids[root[i]]


# pipeline


def test_dedup_keeps_one_of_each_exact_group(spark, docs):
    sets = [set(simhash_dedup.shingle_set(t, 5).tolist()) for t in docs["text"].fillna("")]
    alike = lambda a, b: a == b or (a and b and len(a & b) >= 0.8 * len(a | b))
    root = smallest(len(sets), [(i, j) for i in range(len(sets)) for j in range(i) if alike(sets[i], sets[j])])
    want = {docs["doc_id"][i] for i in range(len(sets)) if root[i] == i}
    stay = {r["doc_id"] for r in simhash_dedup.deduplicated(corpus_pipeline.read_table(spark, SF, "documents")).select("doc_id").collect()}
    assert want <= stay and len(stay - want) <= 0.02 * len(docs)


def test_run_goes_through_all_stages(spark, docs):
    rows = queries.QUERIES["pipeline"](spark, SF).toPandas()
    assert list(rows.columns) == ["doc_id", "source", "ids", "n_tokens"] and len(rows) > 50
    assert set(rows["doc_id"]) <= set(docs["doc_id"]) and (rows["n_tokens"] == rows["ids"].map(len)).all()
