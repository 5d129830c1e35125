"""Personal data by weak supervision, in DataFrame operations only.

Base spans follow fixed patterns. Wider patterns propose further candidates. Labelers
(pattern, gazetteer, context, shape) vote 1, 0 or -1 (no opinion) on every candidate of
the whole corpus; expectation-maximisation over the counts of vote patterns estimates
their reliabilities, and a logistic span classifier is trained on the posteriors. Only
the counts of distinct patterns come to the driver: at most 4 kinds x 3^4 votes x 4
shapes. The classifier goes back into the plan as an arithmetic expression.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._base import free_names, read_table, whole_text

KINDS = ("email", "ip", "card", "phone")

# Forms of the contract's patterns that match the same spans without backtracking or
# recursion on very long runs: repeats are possessive, and a run of local characters or
# digits is entered at its start only (or where the last match ended).
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
# digit chains with single separators are maximal, so a chain's length can be asked in the pattern
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE = dict(zip(KINDS, (EMAIL, IP, CARD, PHONE), strict=True))
# wider forms whose matches are candidates only
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[({]\x20?(?i:at)\x20?[\])}]\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[\[({]\x20?(?i:dot)\x20?[\])}])\x20?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\[\.\]|\(\.\))[0-9]{1,3}(?:\[?\(?\.\)?\]?)[0-9]{1,3}(?:\[?\(?\.\)?\]?)[0-9]{1,3}(?![0-9])",
    "phone": r"(?<![0-9+(.-])(?<![0-9]\x20)(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
# what a text must contain for a pattern to be tried at all
NEEDS = {"email": "%@%", "ip": "%.%.%.%", "card": None, "phone": "%+%"}

# gazetteers: usual top-level domains, country calling codes, first digits of issuers
DOMAINS = "com|org|net|edu|gov|info|io|de|fr|es|uk|eu|it|nl|ch|at|us|ca"
CALLING = "1|7|20|27|30|31|32|33|34|36|39|40|41|43|44|45|46|47|48|49|52|54|55|61|81|82|86|91"
ISSUERS = "3[0-9]|4|5[1-5]|6|2[2-7]"
CUES = {
    "email": r"mail|contact|write|schreib|écri|correo|@",
    "ip": r"\bip\b|host|server|address|client|from|ping",
    "card": r"card|visa|master|amex|credit|kredit|carte|tarjeta|pay",
    "phone": r"phone|tel|call|mobile|fax|anruf|appel|llama|\bt:",
}
AGAINST = r"version|\bv$|isbn|order|token|hash|sha|serial|build|license"

_SPAN = "array<struct<kind:int,start:int,end:int,s:string,base:boolean>>"


def _located(text: str, regex: str, kind: int, base: bool) -> Column:
    """All matches of a pattern with their places, from the matches and the pieces between them."""
    hits = F.regexp_extract_all(F.col(text), F.lit(regex), F.lit(0))
    zipped = F.arrays_zip(hits.alias("hit"), F.split(F.col(text), regex, -1).alias("gap"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))

    def step(acc, x):
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        one = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), x["hit"].alias("s"), F.lit(base).alias("base"))
        return F.when(x["hit"].isNull(), acc).otherwise(F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out")))

    return F.aggregate(zipped, zero, step, lambda acc: acc["out"])


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(s: Column) -> Column:
    d = _digits(s)

    def step(acc, i):
        x = F.substring(d, F.length(d) - i + 1, F.lit(1)).cast("int") * (F.lit(2) - i % 2)
        return acc + x - F.when(x > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), step) % 10 == 0


def _valid(x: Column) -> Column:
    s, kind = x["s"], x["kind"]
    parts = F.forall(F.split(s, r"\."), lambda p: F.coalesce(p.try_cast("int"), F.lit(999)) <= 255)
    count = F.length(_digits(s))
    return (
        F.when(kind == 0, True).when(kind == 1, parts).when(kind == 2, count.between(12, 19) & luhn(s)).otherwise(count.between(9, 15))
    )


def candidates(docs: DataFrame, text: str) -> DataFrame:
    """Adds `base` (the valid base spans by start, then kind) and `more` (candidates beside them)."""
    none = F.array().cast(_SPAN)
    digit = F.col(text).rlike("[0-9]")
    found = {}
    for k, kind in enumerate(KINDS):
        wanted = digit if NEEDS[kind] is None else F.col(text).like(NEEDS[kind])
        if kind in ("ip", "phone"):
            wanted = wanted & digit
        found[f"_{kind}"] = F.when(wanted, _located(text, BASE[kind], k, True)).otherwise(none)
    asks = {"email": F.col(text).rlike(r"[\[({]\x20?(?i:at)\x20?[\])}]"), "ip": F.col(text).rlike(r"[\[(]\.[\])]"), "phone": digit}
    for kind, regex in WIDE.items():
        found[f"_w_{kind}"] = F.when(asks[kind], _located(text, regex, KINDS.index(kind), False)).otherwise(none)
    docs = docs.withColumns(found)
    strict = F.concat(*[F.col(f"_{k}") for k in KINDS])
    docs = docs.withColumn("_strict", F.transform(strict, lambda x: x.withField("base", _valid(x))))
    order = lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["kind"] - b["kind"])
    docs = docs.withColumn("base", F.array_sort(F.filter("_strict", lambda x: x["base"]), order))
    # strict matches that fail their check stay candidates, as do the wide ones
    loose = F.concat(F.filter("_strict", lambda x: ~x["base"]), *[F.col(f"_w_{k}") for k in WIDE])
    apart = lambda x: ~F.exists("base", lambda b: (x["start"] < b["end"]) & (b["start"] < x["end"]))
    docs = docs.withColumn("more", F.array_sort(F.filter(loose, apart), order))
    return docs.drop(*found, "_strict")


def _voted(text: str, x: Column) -> Column:
    """A candidate with its four votes and its shape."""
    s, kind = x["s"], x["kind"]
    head = F.lower(F.substring(F.col(text), F.greatest(x["start"] - 31, F.lit(1)), F.least(x["start"], F.lit(32))))
    pick = lambda by: F.when(kind == 0, by[0]).when(kind == 1, by[1]).when(kind == 2, by[2]).otherwise(by[3])
    vote = lambda yes, no: F.when(yes, 1).when(no, 0).otherwise(-1)
    count = F.length(_digits(s))
    never = F.lit(False)
    gazetteer = pick(
        [
            vote(s.rlike(rf"(?i)(?:\.|dot[\])}}]?\x20?)(?:{DOMAINS})$"), never),
            vote(s.rlike(r"^(?:[1-9]|[1-9][0-9]|1[0-9]{2}|2[0-4][0-9])[\[(]?\."), ~s.rlike("^[1-9]")),
            vote(_digits(s).rlike(f"^(?:{ISSUERS})"), ~_digits(s).rlike(f"^(?:{ISSUERS})")),
            vote(s.rlike(rf"^\+(?:{CALLING})(?![0-9]{{12}})"), never),
        ]
    )
    context = vote(pick([head.rlike(CUES[k]) for k in KINDS]), head.rlike(AGAINST))
    shape = pick(
        [
            vote(s.rlike("[A-Za-z]"), F.length(s) > 128),
            vote(_valid(x), ~_valid(x)),
            vote(count.isin(15, 16), ~count.between(13, 19)),
            vote(count.between(10, 13), ~count.between(7, 15)),
        ]
    )
    return F.struct(
        *[x[f] for f in ("kind", "start", "end", "base")],
        F.when(x["base"], 1).when(kind == 2, 0).otherwise(-1).alias("v0"),
        gazetteer.alias("v1"),
        context.alias("v2"),
        shape.alias("v3"),
        (F.when(s.rlike(r"[\x20().-]"), 1).otherwise(0) + F.when(F.length(s) > 15, 2).otherwise(0)).alias("shape"),
    )


VOTES = ("v0", "v1", "v2", "v3")


def estimate(patterns: list, rounds: int = 60):
    """Weights of the span classifier from (kind, v0..v3, shape, n) rows, by EM and logistic regression.

    Each kind has a prior and, for each labeler, its chances to vote 1 on a true and on
    a false candidate; a labeler without an opinion says nothing. Counts are smoothed by
    one vote each. Without any candidate all weights are zero.
    """
    if not patterns:
        return np.zeros(_features(np.zeros((1, 6), int)).shape[1])
    p = np.array([[r[c] for c in ("kind", *VOTES, "shape")] for r in patterns], int)
    n = np.array([r["n"] for r in patterns], float)
    votes = p[:, 1:5]
    said = votes >= 0
    truth = (0.5 + (votes == 1).sum(1)) / (1.0 + said.sum(1))
    for _ in range(rounds):
        log = np.zeros((2, len(p)))
        for kind in np.unique(p[:, 0]):
            at = p[:, 0] == kind
            for y, w in ((1, truth), (0, 1 - truth)):
                mass = (n * w)[at]
                log[y, at] += np.log((mass.sum() + 1) / (n[at].sum() + 2))
                for j in range(4):
                    yes = ((votes[at, j] == 1) * mass).sum()
                    rate = np.clip((yes + (1.5 if y else 0.5)) / ((said[at, j] * mass).sum() + 2), 0.02, 0.98)
                    log[y, at] += np.where(said[at, j], np.where(votes[at, j] == 1, np.log(rate), np.log(1 - rate)), 0)
        truth = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
    x = _features(p)
    w = np.zeros(x.shape[1])
    scale = n / n.sum()
    for _ in range(40):  # Newton steps with a ridge
        q = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        grad = x.T @ (scale * (q - truth)) + 1e-3 * w
        hess = (x * (scale * q * (1 - q))[:, None]).T @ x + 1e-3 * np.eye(len(w))
        w -= np.linalg.solve(hess, grad)
    return w


def _features(p: np.ndarray) -> np.ndarray:
    cols = [p[:, 0] == k for k in range(4)]
    for j in range(1, 5):
        cols += [p[:, j] == 1, p[:, j] == 0]
    cols += [p[:, 5] % 2 == 1, p[:, 5] >= 2]
    return np.stack(cols, 1).astype(float)


def _logit(x: Column, w: np.ndarray) -> Column:
    terms = [x["kind"] == k for k in range(4)]
    for v in VOTES:
        terms += [x[v] == 1, x[v] == 0]
    terms += [x["shape"] % 2 == 1, x["shape"] >= 2]
    total = F.lit(0.0)
    for t, weight in zip(terms, w, strict=True):
        total = total + F.when(t, float(weight)).otherwise(0.0)
    return total


def train(docs: DataFrame) -> np.ndarray:
    """The span classifier's weights from the votes on all candidates of all texts."""
    seen = candidates(docs.select(whole_text().alias("_text")), "_text")
    seen = seen.where("size(base) + size(more) > 0")
    each = seen.select(F.explode(F.transform(F.concat("base", "more"), lambda x: _voted("_text", x))).alias("x")).select("x.*")
    return estimate(each.groupBy("kind", *VOTES, "shape").agg(F.count(F.lit(1)).alias("n")).collect())


def find_spans(docs: DataFrame, weights: np.ndarray, cut: float = 0.5) -> DataFrame:
    """docs with `base` and `spans`, the last columns: base spans, and those with the added ones, by start, then kind.

    Spans are structs (kind, start, end) in code points, end exclusive; kind indexes
    KINDS. Null and empty texts have no spans; repeated rows have the same ones; no rows
    give no rows. Columns of docs stay, and where one is called base or spans, the new
    one has an underscore behind its name (see free_names). An added span overlaps no
    base span and no added span before it.
    """
    base_name, spans_name = free_names(docs, "base", "spans")
    docs = candidates(docs.select(F.struct(*docs.columns).alias("row"), whole_text().alias("_text")), "_text")
    limit = float(np.log(cut / (1 - cut)))
    good = F.filter(F.transform("more", lambda x: _voted("_text", x)), lambda x: _logit(x, weights) >= limit)
    slim = lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))
    docs = docs.withColumn("base", F.transform("base", slim)).withColumn("_added", F.transform(good, slim))
    kind = "array<struct<kind:int,start:int,end:int>>"
    first = F.aggregate(
        "_added",
        F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out")),
        lambda acc, x: F.when(x["start"] < acc["at"], acc).otherwise(
            F.struct(x["end"].alias("at"), F.concat(acc["out"], F.array(x)).alias("out"))
        ),
        lambda acc: acc["out"],
    )
    docs = docs.withColumn("_added", first)
    order = lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["kind"] - b["kind"])
    both = F.when(F.size("_added") == 0, F.col("base")).otherwise(F.array_sort(F.concat("base", "_added"), order))
    return docs.select("row.*", F.col("base").alias(base_name), both.alias(spans_name))


def span_list(col: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(col, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["end"])), ",")


def masked(text: Column, spans: str) -> Column:
    """The text with every run of overlapping spans replaced by the first one's kind in angle brackets."""
    names = F.array(*[F.lit(f"<{k}>") for k in KINDS])
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc, x):
        gap = F.substring(text, acc["at"] + 1, x["start"] - acc["at"])
        ahead = F.struct(x["end"].alias("at"), F.concat(acc["out"], F.array(gap, F.element_at(names, x["kind"] + 1))).alias("out"))
        inside = F.struct(F.greatest(acc["at"], x["end"]).alias("at"), acc["out"].alias("out"))
        return F.when(x["start"] < acc["at"], inside).otherwise(ahead)

    tail = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text)))
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, zero, step, tail))


def op3_pii(spark, sf_dir: str) -> DataFrame:
    """Query: base counts by kind, digest of the base spans and all spans of every document.

    n_email, n_ip, n_card and n_phone count base spans; n_added counts what the span
    classifier adds.
    """
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_spans(docs, train(docs))
    of = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    counts = [of(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(span_list("base"), 256).alias("base_sha256"),
        span_list("spans").alias("spans"),
        (F.size("spans") - F.size("base")).cast("long").alias("n_added"),
    )
