"""Encoding of a corpus with a public byte-pair tokenizer, and decoding.

Texts are cut into pre-tokens once, in Arrow batches. A block (a bounded piece of a batch) lists each distinct word it
holds, and every document becomes the positions of its pre-tokens as numbers of words of its block. Only the words
travel: they are exploded, made distinct over the whole corpus, encoded once each, and joined back to the blocks; a
block's documents are then put together by position. So the shuffles carry the blocks' vocabularies and four bytes a
pre-token, never a row for each token; a hot word comes once for each block.

Defined cases: null and empty texts have no ids (an empty list, 0 tokens); strings of special tokens in a text are
ordinary text; every row gives a row, repeated or null ``doc_id`` included; other columns are ignored. A text longer
than a block is a block of its own.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.session import written

#: Fixed value: the published pattern that splits text before the merges of the byte-pair files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Characters of text after which a block is closed.
BLOCK_CHARS = 4_000_000


@dataclass(frozen=True)
class Vocabulary:
    """A rank file in tiktoken's format; read on the driver (about 1 MB, whatever the corpus) and sent with the tasks."""

    path: str = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    pattern: str = PATTERN

    def lines(self) -> bytes:
        with open(self.path, "rb") as f:
            return f.read()

    def tokens(self) -> list[tuple[int, bytes]]:
        return [(int(n), base64.b64decode(token)) for token, n in map(bytes.split, self.lines().splitlines())]


def _encoding(lines: bytes, pattern: str):
    import tiktoken

    ranks = {base64.b64decode(token): int(n) for token, n in map(bytes.split, lines.splitlines())}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


class _Slots(dict):
    """Numbers words in the order in which they first come."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def blocks(df: DataFrame, id_col: str, text_col: str, pattern: str = PATTERN, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``block, doc_id, slots, words``: a row for each document (its words as numbers), and one with the block's words."""
    id_type = df.schema[id_col].dataType
    schema = T.StructType(
        [
            T.StructField("block", T.LongType()),
            T.StructField("doc_id", id_type),
            T.StructField("slots", T.ArrayType(T.IntegerType())),
            T.StructField("words", T.ArrayType(T.StringType())),
        ]
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find = regex.compile(pattern).findall
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            texts, start = batch.column(1), 0
            slots, arrays, chars = _Slots(), [], 0
            for i in range(len(texts)):
                text = texts[i].as_py() or ""
                arrays.append(np.array(list(map(slots.__getitem__, find(text))), dtype=np.int32))
                chars += len(text)
                if chars >= block_chars or i == len(texts) - 1:
                    n = len(arrays)
                    offsets = np.zeros(n + 1, np.int32)
                    np.cumsum([len(a) for a in arrays], out=offsets[1:])
                    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.int32)
                    ids = batch.column(0).slice(start, n)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(n + 1, block)),
                            pa.concat_arrays([ids, pa.nulls(1, ids.type)]),
                            pa.concat_arrays([pa.ListArray.from_arrays(offsets, flat), pa.nulls(1, pa.list_(pa.int32()))]),
                            pa.concat_arrays([pa.nulls(n, pa.list_(pa.string())), pa.array([list(slots)], pa.list_(pa.string()))]),
                        ],
                        names=["block", "doc_id", "slots", "words"],
                    )
                    block, start = block + 1, i + 1
                    slots, arrays, chars = _Slots(), [], 0

    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(cut, schema)


def _single(encoding):
    """Encodes the bytes of one pre-token: without cutting it again where the library lets us."""
    inner = getattr(encoding, "_core_bpe", None)
    return inner.encode_single_piece if hasattr(inner, "encode_single_piece") else lambda piece: encoding.encode_ordinary(piece.decode())


def _words(spark: SparkSession, rows: DataFrame, vocabulary: Vocabulary) -> tuple[DataFrame, DataFrame]:
    """The blocks' words with their numbers, and each distinct word of the corpus with its ids."""
    lines, pattern = spark.sparkContext.broadcast(vocabulary.lines()), vocabulary.pattern

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = None
        for batch in batches:
            one = one or _single(_encoding(lines.value, pattern))
            ids = [one(w.encode()) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["word", "ids"])

    listed = rows.where(F.col("words").isNotNull()).select("block", F.posexplode("words").alias("slot", "word"))
    return listed, listed.select("word").distinct().mapInArrow(encode, "word string, ids array<int>")


def _assembled(rows: DataFrame, entries: DataFrame, schema: T.StructType, finish) -> DataFrame:
    """Each block's documents with the ids of their words; ``finish`` makes the block's result."""

    def assemble(docs: pa.Table, words: pa.Table) -> pa.Table:
        slot = words["slot"].to_numpy()
        lists = words["ids"].combine_chunks()
        size, first = np.zeros(len(slot), np.int64), np.zeros(len(slot), np.int64)
        offsets = np.asarray(lists.offsets, dtype=np.int64)
        size[slot], first[slot] = np.diff(offsets), offsets[:-1]
        slots = docs["slots"].combine_chunks()
        bounds, flat = np.asarray(slots.offsets), np.asarray(slots.values)
        flat, bounds = flat[bounds[0] : bounds[-1]], bounds - bounds[0]
        lengths = size[flat]
        ends = np.zeros(len(flat) + 1, np.int64)
        np.cumsum(lengths, out=ends[1:])
        return finish(docs["doc_id"], ends[bounds], lambda: np.asarray(lists.values)[np.repeat(first[flat] - ends[:-1], lengths) + np.arange(ends[-1])])

    docs = rows.where(F.col("words").isNull()).select(F.col("block").alias("of_block"), "doc_id", "slots")
    return docs.groupBy("of_block").cogroup(entries.groupBy("block")).applyInArrow(assemble, schema)


def encoded(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: Vocabulary = Vocabulary()) -> DataFrame:
    """``doc_id, ids``: the token ids of each row's text, without special tokens."""
    rows = written(blocks(df, id_col, text_col, vocabulary.pattern), "blocks")
    listed, words = _words(df.sparkSession, rows, vocabulary)
    schema = T.StructType([T.StructField("doc_id", df.schema[id_col].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def finish(doc_id, ends, ids) -> pa.Table:
        values = pa.array(ids().astype(np.int32))
        return pa.table({"doc_id": doc_id, "ids": pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values)})

    return _assembled(rows, listed.join(words, "word").select("block", "slot", "ids"), schema, finish)


def counted(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: Vocabulary = Vocabulary()) -> DataFrame:
    """``doc_id, tokens``: the number of tokens of each row's text."""
    rows = written(blocks(df, id_col, text_col, vocabulary.pattern), "blocks")
    listed, words = _words(df.sparkSession, rows, vocabulary)
    schema = T.StructType([T.StructField("doc_id", df.schema[id_col].dataType), T.StructField("tokens", T.LongType())])

    def finish(doc_id, ends, _) -> pa.Table:
        return pa.table({"doc_id": doc_id, "tokens": pa.array(np.diff(ends))})

    return _assembled(rows, listed.join(words, "word").select("block", "slot", "ids"), schema, finish)


def decoded(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: Vocabulary = Vocabulary()) -> DataFrame:
    """``doc_id, text``: the texts behind lists of ids. ``doc_id`` must be unique.

    Ids are exploded with their positions and joined with the token-byte table; that table has the vocabulary's fixed
    size, so it is broadcast. Bytes that are no UTF-8 become the replacement character; null lists give an empty text.
    """
    spark = df.sparkSession
    table = spark.createDataFrame([(n, bytearray(b)) for n, b in vocabulary.tokens()], "id int, bytes binary")
    return (
        df.select(F.col(id_col).alias("doc_id"), F.posexplode_outer(ids_col).alias("pos", "id"))
        .join(F.broadcast(table), "id", "left")
        .groupBy("doc_id")
        .agg(F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", F.hex("bytes").alias("h"))))).alias("parts"))
        .select("doc_id", F.decode(F.unhex(F.array_join(F.transform("parts", lambda p: p["h"]), "")), "UTF-8").alias("text"))
    )
