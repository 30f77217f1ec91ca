"""Encoding of a whole corpus with a public byte-level tokenizer (problem 8).

Every text is split once into its pre-tokens.  Within a chunk of texts (bounded
in characters) a pre-token is kept as a number into the chunk's list of different
words, so the positions are a compact integer array instead of a row per word.
The words of all chunks are shuffled, each distinct one is encoded once, the ids
are joined back to the chunks, and every text is put together by position.
A word has at most one row per chunk, however often it occurs, and a word that
stands in very many chunks is joined under a salt.

Defined results: null and empty texts have the empty list of ids.  Each row of
the input gives one row; repeated ids keep their rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import BROADCAST_LIMIT, staged, tasks_for
from .tokenizer import encoding, ranks, splitter, vocabulary

CHUNK_CHARS = 4 << 20
#: Chunks above which a word is salted; so many rows of a word one task may meet.
HOT_CHUNKS = 20_000
#: Chunks that one task puts together.
TASK_CHUNKS = 2


def _split_schema(key_type: str) -> str:
    return f"chunk long, key {key_type}, words array<string>, at binary"


def split_words(df: DataFrame, key: str, text: str, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """(chunk, key, words, at): a row per text with word numbers ``at`` (int32), and one per chunk with its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, part, number = splitter().findall, TaskContext.get().partitionId(), 0
        index: dict[str, int] = {}
        used, kind = 0, None

        def closing() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([(part << 32) | number], pa.int64()), pa.nulls(1, kind), pa.array([list(index)], pa.list_(pa.string())), pa.nulls(1, pa.binary())],
                names=["chunk", "key", "words", "at"],
            )

        for b in batches:
            kind = b.column(0).type
            keys, texts = b.column(0), b.column(1)
            start, ats = 0, []
            for i in range(len(texts)):
                t = texts[i].as_py()
                if t:
                    grow = index.setdefault
                    at = np.fromiter([grow(w, len(index)) for w in find(t)], dtype=np.int32)
                    used += len(t)
                    ats.append(at.tobytes())
                else:
                    ats.append(b"")
                if used >= chunk_chars or i == len(texts) - 1:
                    n = i + 1 - start
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([(part << 32) | number] * n, pa.int64()), keys.slice(start, n), pa.nulls(n, pa.list_(pa.string())), pa.array(ats, pa.binary())],
                        names=["chunk", "key", "words", "at"],
                    )
                    start, ats = i + 1, []
                if used >= chunk_chars:
                    yield closing()
                    number, used = number + 1, 0
                    index.clear()
        if index:
            yield closing()

    kind = dict(df.dtypes)[key]
    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, _split_schema(kind))


def encode_words(words: DataFrame, path: str, *carried: str) -> DataFrame:
    """(word, carried, ids) of rows with a word each: ids are little-endian int32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path).encode_ordinary
        for b in batches:
            ids = [np.asarray(enc(w), np.int32).tobytes() for w in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids, pa.binary())], names=[*b.schema.names, "ids"])

    kinds = dict(words.dtypes)
    return words.select("word", *carried).mapInArrow(run, "word string, " + "".join(f"{c} {kinds[c]}, " for c in carried) + "ids binary")


def word_ids(words: DataFrame, path: str, hot: int = HOT_CHUNKS) -> DataFrame:
    """words (chunk, n, word) with ids, each distinct word being encoded once.

    A word in more than ``hot`` chunks, or in a ten-thousandth of all rows, is joined
    under several salts; there are at most 10,000 of these, which bounds their broadcast.
    """
    counts = staged(words.groupBy("word").agg(F.count("*").alias("c")), "counts")
    limit = max(hot, (counts.agg(F.sum("c")).first()[0] or 0) // 10_000)
    many = counts.filter(F.col("c") > limit).select("word", F.ceil(F.col("c") / limit).cast("int").alias("s"))
    # Words only, or with their salts where there is a word that needs them.
    if many.isEmpty():
        return words.join(encode_words(counts, path), "word")
    salts = F.broadcast(many)
    known = encode_words(counts, path).join(salts, "word", "left").select("word", "ids", F.explode(F.sequence(F.lit(0), F.coalesce("s", F.lit(1)) - 1)).alias("salt"))
    salted = words.join(salts, "word", "left").withColumn("salt", F.pmod(F.xxhash64("chunk"), F.coalesce("s", F.lit(1))).cast("int")).drop("s")
    return salted.join(known, ["word", "salt"])


def encode_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, hot: int = HOT_CHUNKS) -> DataFrame:
    """(key, ids) of every row of df."""
    path = path or vocabulary()
    kind = dict(df.dtypes)[key]
    parts = staged(split_words(df, key, text), "words")
    # What a chunk's texts say and what its words mean meet again by the chunk's number.
    listed = parts.filter("words is not null")
    known = word_ids(listed.select("chunk", F.posexplode("words").alias("n", "word")), path, hot).select(F.col("chunk").alias("of"), "n", "ids")
    texts = parts.filter("words is null").select("chunk", "key", "at")
    # Both sides go to a number of tasks that grows with the chunks.
    tasks = tasks_for(listed.count(), TASK_CHUNKS, 1)
    texts, known = texts.repartition(tasks, "chunk"), known.repartition(tasks, "of")

    def assemble(left: pa.Table, right: pa.Table) -> pa.Table:
        numbers = right.column("n").to_numpy()
        coded = right.column("ids").combine_chunks()
        coded = coded.chunk(0) if isinstance(coded, pa.ChunkedArray) else coded
        ids = coded.to_pylist()
        size = np.zeros(len(ids), np.int64)
        size[numbers] = [len(x) // 4 for x in ids]
        order = np.argsort(numbers, kind="stable")
        flat = np.frombuffer(b"".join([ids[i] for i in order]), np.int32)
        begin = np.cumsum(size) - size
        values, lengths = [], []
        for at in left.column("at").to_pylist():
            w = np.frombuffer(at, np.int32)
            n = size[w]
            total = int(n.sum())
            ends = np.cumsum(n)
            values.append(flat[np.repeat(begin[w] - (ends - n), n) + np.arange(total)])
            lengths.append(total)
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        joined = np.concatenate(values) if values else np.zeros(0, np.int32)
        return pa.table({key: left.column("key"), "ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(joined))})

    return texts.groupBy("chunk").cogroup(known.groupBy("of")).applyInArrow(assemble, f"{key} {kind}, ids array<int>")


def token_bytes(df: DataFrame, path: str | None = None) -> DataFrame:
    """(id, bytes) of the vocabulary, as hex; its size is that of the vocabulary file."""
    rows = sorted((i, b.hex()) for b, i in ranks(path or vocabulary()).items())
    return df.sparkSession.createDataFrame(rows, "id int, hex string")


def decode_corpus(df: DataFrame, key: str = "doc_id", ids: str = "ids", path: str | None = None, block: int = 4096) -> DataFrame:
    """(key, text): ids joined to the token-byte table and put together by position.

    Keys must be unique.  Ids outside of the vocabulary are left out; the empty
    list gives the empty text.
    """
    table = token_bytes(df, path)
    if sum(map(len, ranks(path or vocabulary()))) < BROADCAST_LIMIT:
        table = F.broadcast(table)
    at = df.select(key, F.posexplode_outer(ids).alias("pos", "id"))
    pieces = at.join(table, "id", "left").groupBy(key, F.floor(F.coalesce("pos", F.lit(0)) / block).alias("b")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "hex"))), lambda x: F.coalesce(x["hex"], F.lit(""))), "").alias("h"))
    joined = pieces.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "h"))), lambda x: x["h"]), "").alias("h"))
    return joined.select(key, F.decode(F.unhex("h"), "UTF-8").alias("text"))


def count_tokens(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(key, n_tokens) of every row; null and empty texts have 0."""
    path = path or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path).encode_ordinary
        for b in batches:
            n = [len(enc(t)) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["key", "n"])

    kind = dict(df.dtypes)[key]
    counted = df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, n long")
    return counted.select(F.col("key").alias(key), F.col("n").alias("n_tokens"))
