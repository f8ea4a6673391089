"""Long exact spans shared between records.

A run of at least ``length`` code points that stands in two documents is a run of shared windows of that length. Rolling
(Rabin-Karp) hashes are taken of every window, as polynomials modulo 2**64 over a whole text at once. Counting all of
them would shuffle a row for each character, so windows are first sifted without loss: every window of ``length`` holds
``length - GRAM + 1`` short grams, and the smallest gram hash among them depends on the window's content alone; the same
window elsewhere has the same smallest gram. Only those smallest grams are counted over documents (about one row for each
70 characters); a window goes on only if its smallest gram stands in two documents. The windows left are hashed in full,
counted in Spark, and those in two documents are merged into maximal intervals.

Everything is counted over distinct texts, named by a hash; whole copies, known by digest, are shared from end to end
and are read once for each batch. Grams and windows are counted with partial aggregation, so that boilerplate in a third
of all documents is one row for each task; the join back has the texts on its streamed side.

Defined cases: null and short texts have no spans; a null id cannot be reported and its row is left out; rows of one id
count as one document if their texts are alike, and a repeat within one text is none; other columns are ignored. Windows
and texts are named by 64 bits, so among ten billion windows about three unequal ones are taken for equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.session import written

#: Code points of the short grams by which windows are sifted.
GRAM = 64

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=_U)
    out[:1] = 1
    return np.cumprod(out, out=out)


class Roller:
    """Hashes of all windows of a text; powers are kept between texts."""

    def __init__(self) -> None:
        self.n = 0

    def _grow(self, n: int) -> None:
        if n > self.n:
            self.n = max(n, 2 * self.n, 1 << 16)
            self.up = _powers(_BASE, self.n)
            self.down = _powers(pow(_BASE, -1, 1 << 64), self.n)

    def sums(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        self._grow(len(points) + 1)
        terms = (points.astype(_U) + _U(1)) * _U(0x94D049BB133111EB) * self.up[: len(points)]
        out = np.zeros(len(points) + 1, _U)
        np.cumsum(terms, out=out[1:])
        return out

    def hashes(self, sums: np.ndarray, length: int) -> np.ndarray:
        if len(sums) <= length:
            return np.zeros(0, _U)
        x = (sums[length:] - sums[:-length]) * self.down[: len(sums) - length]
        x ^= x >> _U(31)
        x *= _U(0xBF58476D1CE4E5B9)
        x ^= x >> _U(29)
        return x


def _sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` neighbours."""
    step = 1
    while 2 * step <= width:
        h = np.minimum(h[:-step], h[step:])
        step *= 2
    rest = width - step
    return np.minimum(h[: len(h) - rest], h[rest:]) if rest else h


def _sifters(roller: Roller, sums: np.ndarray, length: int, gram: int) -> np.ndarray:
    """The smallest gram hash of each window."""
    return _sliding_min(roller.hashes(sums, gram), length - gram + 1).view(np.int64)


def _texts(df: DataFrame, id_col: str, text_col: str, length: int) -> tuple[DataFrame, DataFrame]:
    """The texts long enough, with the hash that stands for them; and ``doc_id, text_key, chars, copied`` of each document."""
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).where(
        F.col("doc_id").isNotNull() & (F.length("text") >= length)
    )
    keys = written(docs.select("doc_id", F.md5("text").alias("digest"), F.length("text").alias("chars")).distinct(), "digests")
    classes = keys.groupBy("digest").agg((F.min("doc_id") < F.max("doc_id")).alias("copied"))
    keys = keys.join(classes, "digest").select("doc_id", F.xxhash64("digest").alias("text_key"), "chars", "copied")
    return docs.select(F.xxhash64(F.md5("text")).alias("text_key"), "text"), keys


def shared_windows(texts: DataFrame, length: int, gram: int = GRAM) -> DataFrame:
    """``text_key, start`` of each window of a text that stands in another text too."""
    gram = min(gram, length)

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller = Roller()
        for batch in batches:
            found, keys = [], []
            first = {}  # of the copies in a batch, one is read
            for i, key in enumerate(batch.column(0).to_pylist()):
                first.setdefault(key, i)
            for key, i in first.items():
                m = _sifters(roller, roller.sums(batch.column(1)[i].as_py()), length, gram)
                found.append(np.unique(m[np.r_[True, m[1:] != m[:-1]]]))
                keys.append(key)
            keys = np.repeat(np.array(keys, dtype=np.int64), [len(f) for f in found])
            grams = np.concatenate(found) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(keys)], names=["gram", "text_key"])

    grams = written(texts.mapInArrow(sift, "gram long, text_key long"), "grams")
    repeated = grams.groupBy("gram").agg(F.min("text_key").alias("a"), F.max("text_key").alias("z")).where("a < z").select("gram")
    wanted = grams.join(repeated, "gram").groupBy("text_key").agg(F.collect_set("gram").alias("grams"))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller = Roller()
        for batch in batches:
            for key, text, grams in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                sums = roller.sums(text.as_py())
                at = np.flatnonzero(np.isin(_sifters(roller, sums, length, gram), np.asarray(grams.values)))
                hashes = roller.hashes(sums, length)[at].view(np.int64)
                for k in range(0, len(at), 500_000):
                    part = at[k : k + 500_000].astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(part), key, dtype=np.int64)), pa.array(part), pa.array(hashes[k : k + 500_000])],
                        names=["text_key", "start", "window"],
                    )

    # copies fall away before the join, in each task first, so that a text of a third of all documents is a row for a task
    candidates = written(
        texts.groupBy("text_key").agg(F.first("text").alias("text"))
        .join(wanted, "text_key")
        .select("text_key", "text", "grams")
        .mapInArrow(windows, "text_key long, start int, window long"),
        "windows",
    )
    counted = candidates.groupBy("window").agg(F.min("text_key").alias("a"), F.max("text_key").alias("z")).where("a < z").select("window")
    return candidates.join(counted, "window").select("text_key", "start")


def shared_chars(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200) -> DataFrame:
    """``doc_id, shared_chars`` of each document with a shared run: characters in at least one run, each once."""
    texts, keys = _texts(df, id_col, text_col, length)
    later = F.lead("start").over(Window.partitionBy("text_key").orderBy("start"))
    chars = (
        shared_windows(texts, length)
        .withColumn("step", F.least(F.coalesce(later - F.col("start"), F.lit(length)), F.lit(length)))
        .groupBy("text_key")
        .agg(F.sum("step").alias("shared"))
    )
    return (
        keys.join(chars, "text_key", "left")
        .groupBy("doc_id")
        .agg(F.max(F.when(F.col("copied"), F.col("chars")).otherwise(F.col("shared"))).cast("long").alias("shared_chars"))
        .where("shared_chars is not null")
    )


def shared_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200) -> DataFrame:
    """``doc_id, start, stop``: the maximal intervals of characters that stand elsewhere, from 0, ``stop`` not included."""
    texts, keys = _texts(df, id_col, text_col, length)
    by_text = Window.partitionBy("text_key").orderBy("start")
    islands = (
        shared_windows(texts, length)
        .withColumn("new", F.coalesce((F.col("start") - F.lag("start").over(by_text) > length).cast("int"), F.lit(1)))
        .withColumn("island", F.sum("new").over(by_text))
        .groupBy("text_key", "island")
        .agg(F.min("start").alias("start"), (F.max("start") + length).alias("stop"))
        .drop("island")
    )
    whole = keys.where("copied").select("doc_id", F.lit(0).alias("start"), F.col("chars").alias("stop"))
    return keys.where("not copied").join(islands, "text_key").select("doc_id", "start", "stop").unionByName(whole.distinct())
