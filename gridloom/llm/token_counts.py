"""Token counts from flat token files without an index, by a separator scan.

A token file is a stream of 16-bit little-endian ids in which every document ends with an
end-of-document id; nothing says where documents lie. Files are read in blocks. Each
block finds its separators with one vectorised search and reports only its head, its tail
and the lengths between; a prefix scan over block summaries (within groups of blocks,
then over the groups) gives what each block carries in, so a document may span any number
of blocks.

Spark's own text writer makes the files, on any file system it knows: a document's ids
are a line of raw bytes, and the line separator is the end-of-document id. The same task
writes the names of its documents, in the same order, to a file of its own, so the two
belong together whatever became of earlier attempts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._base import materialize, read_table, scratch, whole_text
from .bpe import STEP, load_ranks

TOKENIZER = "byte_bpe_50k.tiktoken"  #: ranks, by name among the public tokenizers
END = 50256  #: the id that ends a document; free in that vocabulary
BLOCK = 1 << 20  #: bytes of a block
GROUP = 1024  #: blocks of a group in the prefix scan
WIDTH = np.dtype("<u2")


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(path), special_tokens={})


def token_bytes(text: Column, path: str) -> Column:
    """The 16-bit ids of each text as bytes."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode = _tokenizer(path).encode_ordinary
        for texts in batches:
            for lo in range(0, len(texts), STEP):
                yield pa.array([np.array(encode(t.as_py()), WIDTH).tobytes() for t in texts.slice(lo, STEP)], pa.binary())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "binary")(text)


def write_token_files(docs: DataFrame, path: str, folder: str, end: int = END) -> None:
    """Writes folder/kind=tokens/part-<n>..., the token stream of each task, and folder/kind=names/part-<n>..., its documents' ids in order.

    Null texts are empty; every row ends with a separator; a null id is an empty name.
    Nothing is shuffled. No rows give no files.
    """
    rows = docs.select("doc_id", whole_text().alias("text")).select(
        F.monotonically_increasing_id().alias("n"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("name"), token_bytes(F.col("text"), path).cast("string").alias("ids")
    )
    line = lambda kind, c: F.struct(F.lit(kind).alias("kind"), F.col(c).alias("value"))
    lines = rows.select("n", F.explode(F.array(line("names", "name"), line("tokens", "ids"))).alias("l")).select("n", "l.*").sortWithinPartitions("kind", "n")
    lines.select("kind", "value").write.partitionBy("kind").option("encoding", "ISO-8859-1").option("lineSep", _mark(end)).text(folder)


def _mark(end: int) -> str:
    return int(end).to_bytes(WIDTH.itemsize, "little").decode("latin-1")


def _part() -> Column:
    """The number of the task that wrote a file."""
    return F.regexp_extract("path", r"/part-([0-9]+)-[^/]*$", 1).try_cast("long")


def document_names(spark, folder: str, end: int = END) -> DataFrame:
    """(file, number, doc_id): the documents of each token file in order, from the files that write_token_files() puts beside them."""
    names = F.split(F.decode("content", "ISO-8859-1"), f"\\Q{_mark(end)}\\E", -1)
    # every name is followed by a mark, so the last piece is none
    found = spark.read.format("binaryFile").load(f"{folder}/kind=names").select(_part().alias("file"), F.posexplode(F.slice(names, F.lit(1), F.size(names) - 1)).alias("number", "name"))
    return found.select("file", F.col("number").cast("long").alias("number"), F.col("name").try_cast("long").alias("doc_id"))


def flat_files(spark, path: str, block: int = BLOCK) -> DataFrame:
    """(file, part, payload) of the flat token files under a path, read by Spark; file is the file's path.

    A file is one row of Spark's reader before it is cut into blocks, so files of 2 GiB or
    more must be cut before. Empty files give no rows.
    """
    size = F.length("content")
    parts = F.sequence(F.lit(0), F.greatest(F.ceil(size / block).cast("int") - 1, F.lit(0)))
    cut = F.transform(parts, lambda i: F.struct(i.cast("long").alias("part"), F.substring("content", i * block + 1, F.lit(block)).alias("payload")))
    found = spark.read.format("binaryFile").load(path).where("length > 0")
    return found.select(F.col("path").alias("file"), F.explode(cut).alias("b")).select("file", "b.*")


def block_summaries(blocks: DataFrame, end: int = END, width: np.dtype = WIDTH) -> DataFrame:
    """(file, part, ends, head, tail, inner): separators of a block, tokens before the first, after the last, and between."""

    def run(batches):
        for pdf in batches:
            rows = []
            for file, part, payload in zip(pdf["file"], pdf["part"], pdf["payload"], strict=True):
                ids = np.frombuffer(payload, width, count=len(payload) // width.itemsize)
                at = np.flatnonzero(ids == end)
                if len(at):
                    rows.append((file, part, len(at), int(at[0]), len(ids) - 1 - int(at[-1]), (np.diff(at) - 1).tolist()))
                else:
                    rows.append((file, part, 0, len(ids), len(ids), []))
            yield pd.DataFrame(rows, columns=["file", "part", "ends", "head", "tail", "inner"])

    kind = dict(blocks.dtypes)["file"]
    return blocks.select("file", "part", "payload").mapInPandas(run, f"file {kind}, part long, ends long, head long, tail long, inner array<long>")


def document_lengths(summaries: DataFrame, group: int = GROUP) -> DataFrame:
    """(file, number, n_tokens, ended): length of each document of each file, in order from 0.

    Separators do not count. Empty documents have length 0. Tokens after a file's last
    separator are one more document that has not ended. An empty file has no documents.
    """
    s = summaries.withColumn("g", F.floor(F.col("part") / group))
    inside = W.partitionBy("file", "g").orderBy("part")
    before = inside.rowsBetween(W.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    s = s.withColumn("run", zero(F.sum("tail").over(before))).withColumn("n0", zero(F.sum("ends").over(before)))
    # running tails at the last block with a separator: what lies before it is not carried on
    s = s.withColumn("cut", F.max(F.when(F.col("ends") > 0, F.col("run"))).over(before))
    groups = s.groupBy("file", "g").agg(
        F.sum("tail").alias("tails"), F.sum("ends").alias("n"), F.max(F.when(F.col("ends") > 0, F.col("run"))).alias("last")
    )
    over = W.partitionBy("file").orderBy("g").rowsBetween(W.unboundedPreceding, -1)
    groups = groups.withColumn("base", zero(F.sum("tails").over(over))).withColumn("base_n", zero(F.sum("n").over(over)))
    groups = groups.withColumn("base_cut", F.max(F.col("base") + F.col("last")).over(over))
    s = s.join(groups.select("file", "g", "base", "base_n", "base_cut"), ["file", "g"])
    cut = zero(F.coalesce(F.col("base") + F.col("cut"), F.col("base_cut")))
    s = s.withColumn("carry", F.col("base") + F.col("run") - cut).withColumn("n0", F.col("base_n") + F.col("n0"))
    lengths = F.concat(F.array(F.col("head") + F.col("carry")), F.col("inner"))
    ended = s.where("ends > 0").select("file", "n0", F.posexplode(lengths).alias("at", "n_tokens"))
    ended = ended.select("file", (F.col("n0") + F.col("at")).alias("number"), "n_tokens", F.lit(True).alias("ended"))
    close = s.groupBy("file").agg(
        F.max_by(F.when(F.col("ends") > 0, F.col("tail")).otherwise(F.col("tail") + F.col("carry")), "part").alias("n_tokens"), F.sum("ends").alias("number")
    )
    rest = close.where("n_tokens > 0").select("file", "number", "n_tokens", F.lit(False).alias("ended"))
    return ended.unionByName(rest)


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, file, number) of every row of docs, counted in the flat token files written from them.

    Null texts are empty and count 0; null ids and repeated rows keep their rows; an empty
    table gives none; a text of any length is counted whole; extra columns are not read.
    file is the number of the task that wrote a row, number its place in the file.
    """
    spark = docs.sparkSession
    if docs.isEmpty():
        return docs.select("doc_id", *(F.lit(0).cast("long").alias(c) for c in ("n_tokens", "file", "number")))
    folder = scratch(spark, "token-files")
    write_token_files(docs, path, folder)
    blocks = flat_files(spark, f"{folder}/kind=tokens").withColumnRenamed("file", "path").withColumn("file", _part()).drop("path")
    found = document_lengths(materialize(block_summaries(blocks), "block-summaries"))
    return document_names(spark, folder).join(found, ["file", "number"]).select("doc_id", "n_tokens", "file", "number")


def op10_token_counts(spark, sf_dir: str) -> DataFrame:
    """Query: tokens of every document, counted by a separator scan of the token files written from all texts."""
    return token_counts(read_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
