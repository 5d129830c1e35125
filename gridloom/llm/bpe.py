"""Byte-level BPE: ranked merges folded over the bytes of distinct words.

A text is cut by the tokenizer's pattern; each piece is encoded apart: as one id if the
rank map has it, else by merging, again and again, the leftmost pair of lowest rank.
A task folds the merges of its new distinct words together, those of one length in one
array, and keeps words in a bounded memory, which only saves work. Decoding joins the bytes that the ids stand for.

Two forms share the algorithm: `encode_documents` runs it in Arrow batches and is what
the query uses; `encoder` says the same in Spark's higher-order functions, with the ranks
as a literal map, for plans that must stay free of Python (see the README for its cost).
"""

from __future__ import annotations

import base64
import heapq
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._base import free_names, read_table, whole_text

RANKS = "byte_bpe_multi_50k.tiktoken"  #: file of ranks, by its name among the public tokenizers
REMEMBERED = 150_000  #: words that a task keeps with their ids, in each of two generations
STEP = 512  #: texts whose ids are handed back at once
NONE = 1 << 62  #: rank of a pair that no merge joins
ENDS = ".,;:!?\n"  #: marks, and a line feed after them, that follow a word as pieces of their own
LONG = 256  #: bytes from which a piece is merged with a heap
FOLDED = 64  #: bytes up to which new pieces of one length are folded together
BUCKETS = 8192  #: of the literal maps

# The tokenizer's pattern with white space by Unicode, as its own library reads it.
_SPACE = r"\p{IsWhite_Space}"
JAVA_PATTERN = public_tokenizers.PATTERN.replace(r"[^\s\p{L}", rf"[^{_SPACE}\p{{L}}").replace(r"\s", _SPACE).replace(r"\S", r"\P{IsWhite_Space}")
PATTERN = public_tokenizers.PATTERN.replace(r"[^\s\p{L}", r"[^\p{White_Space}\p{L}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")

#: Where cutting a text before each blank could cut a piece: a blank between two white-space characters or at the end after one.
_AMONG_BLANKS = re.compile(r"\s (?:\s|\Z)")
#: After a line feed that is the only white space between two words, where a piece ends either way.
_LINES = re.compile(r"(?<=\S\n)(?=\S)")


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f.read().splitlines())}


def fold_merges(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """Tokens of one piece: merges of the leftmost pair of lowest rank until no pair has one."""
    if len(piece) >= LONG:
        return _fold_long(piece, ranks)
    get = ranks.get
    parts = [piece[i : i + 1] for i in range(len(piece))]
    rank = [get(piece[i : i + 2], NONE) for i in range(len(piece) - 1)]
    while rank and (least := min(rank)) != NONE:
        at = rank.index(least)
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
        del rank[at]
        if at:
            rank[at - 1] = get(parts[at - 1] + parts[at], NONE)
        if at < len(rank):
            rank[at] = get(parts[at] + parts[at + 1], NONE)
    return parts


def _fold_long(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The same merges over a linked list with a heap of pairs, so a long piece costs n log n."""
    n = len(piece)
    end = list(range(1, n + 1))  # of the part that starts here; 0 once it is merged away
    before = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i]
        if not j or j >= n or end[j] != stop:
            continue
        end[i], end[j] = stop, 0
        if stop < n:
            before[stop] = i
            if (r := ranks.get(piece[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (h := before[i]) >= 0 and (r := ranks.get(piece[h:stop])) is not None:
            heapq.heappush(heap, (r, h, stop))
    out, i = [], 0
    while i < n:
        out.append(piece[i : end[i]])
        i = end[i]
    return out


@lru_cache(maxsize=4)
def pair_table(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, ids, first): the sorted pairs of tokens, left id times 2^32 plus right id, that merge; what they merge to; and the ids of the 256 bytes."""
    ranks = load_ranks(path)
    found = [(a << 32 | b, v) for token, v in ranks.items() for k in range(1, len(token)) if (a := ranks.get(token[:k])) is not None and (b := ranks.get(token[k:])) is not None]
    pairs = np.array(sorted(found), np.int64).reshape(-1, 2)
    return pairs[:, 0].copy(), pairs[:, 1].copy(), np.array([ranks[bytes([b])] for b in range(256)], np.int64)


def _merged(keys: np.ndarray, ids: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """What neighbours merge to, NONE where they do not or where one is not there (negative)."""
    pair = left << np.int64(32) | right
    at = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
    return np.where((keys[at] == pair) & (left >= 0) & (right >= 0), ids[at], NONE)


def fold_words(pieces: list[bytes], path: str) -> list[bytes]:
    """fold_merges() of many pieces of one length at once: in every turn each merges its leftmost pair of lowest rank. Ids come as bytes of 32-bit integers."""
    keys, ids, first = pair_table(path)
    n, size = len(pieces), len(pieces[0])
    part = first[np.frombuffer(b"".join(pieces), np.uint8).reshape(n, size)]
    rank = _merged(keys, ids, part[:, :-1], part[:, 1:])
    row = np.arange(n)
    while len(row):
        own = rank[row]
        k = own.argmin(axis=1)
        least = own[np.arange(len(row)), k]
        go = least < NONE
        row, k, least = row[go], k[go], least[go]
        if not len(row):
            break
        # what lies behind the pair moves up by one
        a, r = part[row], own[go]
        col = np.arange(size)
        a = np.take_along_axis(a, np.minimum(col + (col > k[:, None]), size - 1), axis=1)
        a[:, -1] = -1
        r = np.take_along_axis(r, np.minimum(col[:-1] + (col[:-1] >= k[:, None]), size - 2), axis=1)
        r[:, -1] = NONE
        i = np.arange(len(row))
        a[i, k] = least
        r[i, np.minimum(k, size - 2)] = np.where(k < size - 1, _merged(keys, ids, least, a[i, np.minimum(k + 1, size - 1)]), NONE)
        before = k > 0
        r[i[before], k[before] - 1] = _merged(keys, ids, a[i[before], k[before] - 1], least[before])
        part[row], rank[row] = a, r
    there = part >= 0
    raw, ends = part[there].astype("<i4").tobytes(), np.concatenate([[0], np.cumsum(there.sum(axis=1))]) * 4
    return [raw[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


class WordEncoder:
    """Encodes whole texts, distinct words once while they are remembered.

    Texts are cut before blanks and after single line feeds, where no piece can lie across
    the cut, so a text's ids are those of its words, joined. Words are kept in two
    generations: when the young one is full it becomes the old one, and words met again
    are young again.
    """

    def __init__(self, path: str):
        import regex

        ranks = load_ranks(path)
        self.path, self.ranks, self.cut = path, ranks, regex.compile(PATTERN).findall
        self.coded = {k: v.to_bytes(4, "little") for k, v in ranks.items()}
        self.folded: dict[bytes, bytes] = {}
        self.young: dict[str, bytes] = {}  # of words with a blank before them
        self.old: dict[str, bytes] = {}
        self.heads: dict[str, bytes] = {}  # of words that begin a text or a line
        self.tails: dict[str, bytes] = {}

    def piece(self, raw: bytes) -> bytes:
        one = self.coded.get(raw) or self.folded.get(raw)
        return b"".join(map(self.coded.__getitem__, fold_merges(raw, self.ranks))) if one is None else one

    def pieces(self, text: str) -> bytes:
        return b"".join([self.piece(p.encode("utf-8", "surrogatepass")) for p in self.cut(text)])

    def _tail(self, tail: str) -> bytes:
        ids = self.tails.get(tail)
        if ids is None:
            ids = self.pieces(tail)
            if len(tail) < LONG and len(self.tails) < REMEMBERED:
                self.tails[tail] = ids
        return ids

    def learn(self, words: set[str], heads: set[str]) -> None:
        """Makes the ids of words and heads known: new pieces of one length are folded together."""
        if len(self.young) >= REMEMBERED:
            self.young, self.old = {}, self.young
        if len(self.heads) >= REMEMBERED:
            self.heads = {}
        young, old, coded = self.young, self.old, self.coded
        fresh = [w for w in words if w not in young]
        again = {w: old[w] for w in fresh if w in old}
        young.update(again)
        plain, others, new = [], [], set()
        for known, blank, some in ((young, " ", [w for w in fresh if w not in again]), (self.heads, "", [w for w in heads if w not in self.heads])):
            # letters, then marks, then at most one line feed: the letters are one piece
            cores = [w.rstrip(ENDS) for w in some]
            easy = [c.isalpha() and "\n" not in w[len(c) : -1] for w, c in zip(some, cores, strict=True)]
            own = [(w, c) for w, c, e in zip(some, cores, easy, strict=True) if e]
            raws = [(blank + c).encode("utf-8", "surrogatepass") for _, c in own]
            cut = {w: [p.encode("utf-8", "surrogatepass") for p in self.cut(blank + w)] for w, e in zip(some, easy, strict=True) if not e}
            plain.append((known, own, raws))
            others.append((known, cut))
            new.update(raws, *cut.values())
        new.difference_update(coded)
        by_size: dict[int, list[bytes]] = {}
        for p in new:
            if 1 < len(p) <= FOLDED:
                by_size.setdefault(len(p), []).append(p)
        folded = self.folded = {}
        for same in by_size.values():
            folded.update(zip(same, fold_words(same, self.path), strict=True))
        piece, tail = self.piece, self._tail
        for known, own, raws in plain:
            ids = [coded.get(r) or folded.get(r) or piece(r) for r in raws]
            known.update([(w, i) if len(w) == len(c) else (w, i + tail(w[len(c) :])) for (w, c), i in zip(own, ids, strict=True)])
        for known, cut in others:
            known.update([(w, b"".join(map(piece, own))) for w, own in cut.items()])

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text."""
        cut = [None if not t else t if _AMONG_BLANKS.search(t) else [line.split(" ") for line in _LINES.split(t)] for t in texts]
        words: set[str] = set()
        heads: set[str] = set()
        for lines in cut:
            if isinstance(lines, list):
                for line in lines:
                    heads.add(line[0])
                    words.update(line[1:])
        self.learn(words, heads)
        young, known, out = self.young, self.heads, []
        for lines in cut:
            if lines is None:
                raw = b""
            elif isinstance(lines, str):
                raw = self.pieces(lines)
            else:
                raw = b"".join([x for line in lines for x in (known[line[0]], *[young[w] for w in line[1:]])])
            out.append(np.frombuffer(raw, "<i4"))
        # words too long to be met again are not kept
        for memory, own in ((young, words), (known, heads)):
            for w in own:
                if len(w) >= LONG:
                    memory.pop(w, None)
        return out


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """docs with `ids`, the token ids of the whole text, as the last column.

    Null and empty texts have no ids; repeated rows and ties make no difference; no rows
    give no rows; a piece of any length costs n log n. Columns of docs stay, and where
    one is called ids, the new one is called ids_ (see free_names).
    """
    (name,) = free_names(docs, "ids")

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = WordEncoder(path)
        for texts in batches:
            for lo in range(0, len(texts), STEP):
                ids = encoder.encode(texts.slice(lo, STEP).to_pylist())
                ends = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
                yield pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return docs.withColumn(name, F.arrow_udf(run, "array<int>")(whole_text()))


def decoded(ids: Column, path: str) -> Column:
    """The bytes that the ids stand for: their pieces, joined."""
    by_id = {v: k for k, v in load_ranks(path).items()}
    pieces = F.from_json(F.lit(json.dumps([by_id[i].hex() if i in by_id else "" for i in range(max(by_id) + 1)])), "array<string>")
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.element_at(pieces, i + 1)), ""))


def _bucketed(entries: dict, kind: str) -> Column:
    """A literal array of maps; an entry lies in the map of its key's CRC-32."""
    maps: list[dict] = [{} for _ in range(BUCKETS)]
    for k, v in entries.items():
        maps[zlib.crc32(k.encode()) % BUCKETS][k] = v
    return F.from_json(F.lit(json.dumps(maps, ensure_ascii=False)), f"array<map<string,{kind}>>")


def _look(maps: Column, key: Column) -> Column:
    return F.try_element_at(F.element_at(maps, (F.crc32(key.cast("binary")) % BUCKETS + 1).cast("int")), key)


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def encode_bytes(hexed: Column, ranks: Column) -> Column:
    """Ids of one piece, given as hexadecimal digits: the fold of ranked merges over its bytes."""
    n = (F.length(hexed) / 2).cast("int")
    pieces = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(hexed, i * 2 - 1, F.lit(2)))

    def start(p):
        pair = lambda i: _look(ranks, F.concat(F.element_at(p, i), F.element_at(p, i + 1)))
        r = F.when(F.size(p) > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.size(p) - 1, F.lit(1))), pair)).otherwise(F.array().cast("array<int>"))
        return F.struct(p.alias("p"), r.alias("r"))

    def step(acc, _):
        p, r = acc["p"], acc["r"]

        def merge(k):
            one = F.concat(F.element_at(p, k), F.element_at(p, k + 1))
            before = F.when(k > 1, F.array(_look(ranks, F.concat(F.try_element_at(p, F.greatest(k - 1, F.lit(1))), one)))).otherwise(F.array().cast("array<int>"))
            after = F.when(k + 1 < F.size(p), F.array(_look(ranks, F.concat(one, F.try_element_at(p, k + 2))))).otherwise(F.array().cast("array<int>"))
            rest = F.greatest(F.size(p) - k - 1, F.lit(0))
            pieces = F.concat(F.slice(p, F.lit(1), k - 1), F.array(one), F.slice(p, k + 2, rest))
            left = F.concat(F.slice(r, F.lit(1), F.greatest(k - 2, F.lit(0))), before, after, F.slice(r, k + 2, rest))
            return F.struct(pieces.alias("p"), left.alias("r"))

        least = F.array_min(r)
        return F.when(least.isNull(), acc).otherwise(_let(F.array_position(r, least).cast("int"), merge))

    turns = F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1)))
    whole = _let(_let(pieces, start), lambda s: F.aggregate(turns, s, step))
    return F.transform(whole["p"], lambda x: _look(ranks, x))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(JAVA_PATTERN), F.lit(0))


def encoder(path: str):
    """A function from a text column to its array of ids, in higher-order functions only."""
    table = load_ranks(path)
    ranks = _bucketed({k.hex().upper(): v for k, v in table.items()}, "int")

    def word_ids(w: Column) -> Column:
        hexed = F.hex(w.cast("binary"))
        direct = lambda h: F.when(_look(ranks, h).isNotNull(), F.array(_look(ranks, h)))
        return _let(hexed, lambda h: F.coalesce(direct(h), encode_bytes(h, ranks)))

    return lambda text: F.flatten(F.transform(words_of(text), word_ids))



def op4_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Query: number and digest of every document's ids, and the digest of the bytes decoded from them."""
    path = public_tokenizers.path(RANKS)
    found = encode_documents(read_table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(decoded(F.col("ids"), path), 256).alias("decoded_sha256"),
    )
