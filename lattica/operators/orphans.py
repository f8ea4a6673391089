"""References to records that do not exist, kept as state that grows batch by batch.

The tracker holds four tables in the shared folder:

* ``parents``  one row per key with the spans of time in which a record of it was live, and the times of removals,
* ``pending``  the references that no span covers (the orphans),
* ``resolved`` the references that a span covers,
* ``tally``    the number of references per key, table, field and month.

The first three are parted into buckets of keys. A batch brings references, spans and removals, and reads and rewrites
only the buckets that it touches: new references probe their buckets of the parent index; spans that arrive probe only
what waits in theirs; a removal ends the open spans of its key that began before it, and a span with an end replaces the
open one that began with it, and only then the resolved references of these buckets are probed again: those after the end
are orphans from then on. After every batch a manifest is written, so a tracker opened on the same folder goes on where
the last batch ended. A snapshot counts, from the tally, the references whose key has no live record at a moment: a
deletion reopens all references of its key there.

Skew: the index has one row for each key and the references are the streamed side of a plain join, so Spark splits a
hot key's partition (adaptive skew join); counting is pre-aggregated before each shuffle.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.session import new_path, written

#: White space that may surround a key.
BLANKS = " \t\n\r\x0b\x0c\u00a0\u2009\u200b\u3000\ufeff"

_TEXT, _TIME = T.StringType(), T.TimestampNTZType()
REFERENCES = T.StructType(
    [T.StructField(n, _TEXT) for n in ("space", "key", "table_name", "ref_field", "row_key")] + [T.StructField("at", _TIME)]
)
REMOVALS = T.StructType([T.StructField("space", _TEXT), T.StructField("key", _TEXT), T.StructField("live_until", _TIME)])
SPANS = T.StructType([T.StructField("space", _TEXT), T.StructField("key", _TEXT), T.StructField("live_from", _TIME), T.StructField("live_until", _TIME)])


def clean_key(key: Column) -> Column:
    """The key without surrounding blanks and letter case; null if nothing is left."""
    key = F.lower(F.btrim(key.cast("string"), F.lit(BLANKS)))
    return F.when(key != "", key)


def references(
    df: DataFrame, space: str, table_name: str, row_key: str, at: str, fields: list[str]
) -> DataFrame:
    """One row for each non-null, non-blank reference of ``df``; the wide row is unpivoted in the scan's stage."""
    pairs = F.array(*[F.struct(F.lit(f).alias("ref_field"), clean_key(F.col(f)).alias("key")) for f in fields])
    return (
        df.select(F.col(row_key).cast("string").alias("row_key"), F.col(at).cast("timestamp_ntz").alias("at"), F.inline(pairs))
        .where(F.col("key").isNotNull())
        .select(F.lit(space).alias("space"), "key", F.lit(table_name).alias("table_name"), "ref_field", "row_key", "at")
    )


def spans(df: DataFrame, space: str, key: str, live_from: str | None = None, live_until: str | None = None) -> DataFrame:
    """The times at which records are live: from ``live_from`` (null: always) until before ``live_until`` (null: still)."""
    never = F.lit(None).cast("timestamp_ntz")
    return df.select(
        F.lit(space).alias("space"),
        clean_key(F.col(key)).alias("key"),
        (F.col(live_from).cast("timestamp_ntz") if live_from else never).alias("live_from"),
        (F.col(live_until).cast("timestamp_ntz") if live_until else never).alias("live_until"),
    ).where(F.col("key").isNotNull())


def _covered(all_spans: Column, at: Column) -> Column:
    """Whether one of the spans holds at the time; a reference without time is covered by any record."""
    return F.coalesce(
        F.exists(
            all_spans,
            lambda s: at.isNull()
            | ((s["live_from"].isNull() | (s["live_from"] <= at)) & (s["live_until"].isNull() | (at < s["live_until"]))),
        ),
        F.lit(False),
    )


def _ended(all_spans: Column, ends: Column) -> Column:
    """The spans, open ones ended by the first removal since their beginning; one that also came with an end is left out."""
    end = lambda s: F.array_min(F.filter(ends, lambda e: s["live_from"].isNull() | (e >= s["live_from"])))
    replaced = lambda s: s["live_until"].isNull() & F.exists(all_spans, lambda o: o["live_until"].isNotNull() & o["live_from"].eqNullSafe(s["live_from"]))
    kept = F.when(F.size(all_spans) > 1, F.filter(all_spans, lambda s: ~replaced(s))).otherwise(all_spans)
    closed = F.transform(kept, lambda s: F.struct(s["live_from"].alias("live_from"), F.coalesce(s["live_until"], end(s)).alias("live_until")))
    return F.when(F.size(ends) == 0, kept).otherwise(closed)


def period_of(at: Column) -> Column:
    """The month of a time as YYYY-MM, ``unknown`` without one."""
    return F.coalesce(F.date_format(at, "yyyy-MM"), F.lit("unknown"))


#: Buckets of keys: a batch of few keys touches as many buckets at most. More of them suit larger histories and smaller
#: batches; a tracker keeps its own number in its manifest.
BUCKETS = 8
#: Tallies of so many batches are put together.
TALLIES = 16
_SPAN_LIST = "array<struct<live_from:timestamp_ntz,live_until:timestamp_ntz>>"
_PARENTS = f"space string, key string, spans {_SPAN_LIST}, ends array<timestamp_ntz>"
_TALLY = "space string, key string, table_name string, ref_field string, period string, n long"


class OrphanTracker:
    """Keyed pending-orphan state. ``ingest`` may be called any number of times; the order of batches doesn't matter.
    ``folder``: where the state lives; a tracker opened on the folder of another one goes on from its last batch.

    Defined cases: null and blank keys are no references and no records; a null time is covered by any record of the
    key; removals without key or time, and of keys without an open span, change nothing; a batch whose number was taken
    already changes nothing; repeated rows count in the tally as often as they come, and once in :meth:`found`; empty
    batches change nothing; columns besides those named are ignored.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, buckets: int = BUCKETS):
        self.spark, self.home = spark, (folder or new_path(spark, "orphans")).rstrip("/")
        self.batch, self.step, self.stale, self.buckets = -1, 0, [], buckets
        self.dirs: dict[str, dict[str, list[str]]] = {"parents": {}, "pending": {}, "resolved": {}, "tally": {"": []}}
        for entry in self._files().globStatus(self._path(f"{self.home}/manifest-*")) or []:
            held = json.loads(spark.read.text(entry.getPath().toString(), wholetext=True).first()[0])
            if held["step"] > self.step:
                self.dirs, self.batch, self.step, self.buckets = held["dirs"], held["batch"], held["step"], held["buckets"]

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("space", "key"), F.lit(self.buckets)).cast("int")

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)

    def _files(self):
        return self._path(self.home).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _read(self, table: str, buckets: set[str] | None = None) -> DataFrame:
        """A table, or some of its buckets."""
        schema = {"parents": _PARENTS, "tally": _TALLY}.get(table, REFERENCES)
        dirs = [d for b, listed in self.dirs[table].items() if buckets is None or b in buckets for d in listed]
        return self.spark.read.schema(schema).parquet(*dirs) if dirs else self.spark.createDataFrame([], schema)

    def _write(self, df: DataFrame, name: str, *parts: str) -> dict[tuple[str, ...], str]:
        """The folders of a frame written by bucket (and other columns); a bucket is a few files of even size, however hot."""
        at = f"{self.home}/{name}-{self.step:06d}"
        df.withColumn("bucket", self._bucket()).hint("rebalance", *parts, "bucket").write.partitionBy(*parts, "bucket").parquet(at)
        found = self._files().globStatus(self._path(at + "/*=*" * (len(parts) + 1))) or []
        return {tuple(x.split("=")[1] for x in f.getPath().toString().split("/")[-len(parts) - 1 :]): f.getPath().toString() for f in found}

    def _put(self, table: str, dirs: dict[tuple[str, ...], str], buckets: set[str] = frozenset()) -> None:
        """Adds folders to a table; those of ``buckets`` are replaced."""
        for b in buckets:
            self.stale += self.dirs[table].pop(b, [])
        for key, d in dirs.items():
            self.dirs[table].setdefault(key[-1], []).append(d)

    def ingest(self, refs: DataFrame, arrived: DataFrame, removed: DataFrame | None = None, batch: int | None = None) -> "OrphanTracker":
        """Takes one batch into the state; ``removed``: ``space, key, live_until`` of records deleted; ``batch``: the
        batch's number, where a source may bring a batch again."""
        if batch is not None and batch <= self.batch:
            return self
        self.step, fresh = self.step + 1, self.step == 0
        arrivals = arrived.groupBy("space", "key").agg(F.collect_set(F.struct("live_from", "live_until")).alias("spans"))
        arrivals = arrivals.withColumn("ends", F.array().cast("array<timestamp_ntz>"))
        if removed is not None:
            ends = removed.where("key is not null and live_until is not null").groupBy("space", "key").agg(F.collect_set("live_until").alias("ends"))
            arrivals = arrivals.unionByName(ends.select("space", "key", F.array().cast(_SPAN_LIST).alias("spans"), "ends"))
        reopen, touched = False, set()
        if fresh and removed is None:
            self._put("parents", self._write(arrivals, "parents"))
        else:
            arrivals = written(arrivals, "arrivals")
            touched = {str(r[0]) for r in arrivals.select(self._bucket().alias("b")).distinct().collect()}  # a row a bucket
            merged = lambda c: F.array_distinct(F.flatten(F.collect_list(c))).alias(c)
            old = self._read("parents", touched).unionByName(arrivals)
            new = self._write(old.groupBy("space", "key").agg(merged("spans"), merged("ends")), "parents")
            closing = arrivals.select("space", "key", "ends", F.filter("spans", lambda s: s["live_until"].isNotNull()).alias("closed"))
            opened = self._read("parents", touched).select("space", "key", F.filter("spans", lambda s: s["live_until"].isNull()).alias("opened"))
            meets = F.exists("closed", lambda c: F.exists("opened", lambda o: o["live_from"].eqNullSafe(c["live_from"])))
            reopen = not closing.join(opened, ["space", "key"]).where((F.size("ends") > 0) | meets).isEmpty()
            self._put("parents", new, touched)
        came = self._write(self._checked(refs, self._read("parents")), "references", "ok")
        part = lambda dirs, ok: {k: d for k, d in dirs.items() if k[0] == ok}
        if touched:
            changed = self._read("parents", touched)
            waited = self._write(self._checked(self._read("pending", touched), changed), "pending", "ok")
            held = self._write(self._checked(self._read("resolved", touched), changed), "resolved", "ok") if reopen else {}
            self._put("pending", part(waited, "false"), touched)
            self._put("resolved", part(held, "true"), touched if reopen else set())
            self._put("pending", part(held, "false"))
            self._put("resolved", part(waited, "true"))
        self._put("pending", part(came, "false"))
        self._put("resolved", part(came, "true"))
        counts = refs.groupBy("space", "key", "table_name", "ref_field", period_of(F.col("at")).alias("period")).agg(F.count("*").alias("n"))
        tallies = self.dirs["tally"][""]
        if len(tallies) >= TALLIES:  # one table again, so that a history is as many tables at most
            counts = self._read("tally").unionByName(counts).groupBy("space", "key", "table_name", "ref_field", "period").agg(F.sum("n").alias("n"))
            self.stale, self.dirs["tally"][""] = self.stale + tallies, []
        at = f"{self.home}/tally-{self.step:06d}"
        counts.write.parquet(at)
        self.dirs["tally"][""].append(at)
        self.batch = self.batch if batch is None else batch
        held = json.dumps({"buckets": self.buckets, "step": self.step, "batch": self.batch, "dirs": self.dirs})
        out = self._files().create(self._path(f"{self.home}/manifest-{self.step:06d}"))
        out.write(bytearray(held.encode()))
        out.close()
        return self

    def prune(self) -> None:
        """Deletes the folders that later batches replaced; frames got before must have been used up."""
        for d in self.stale:
            self._files().delete(self._path(d), True)
        self.stale = []

    @staticmethod
    def _checked(refs: DataFrame, index: DataFrame) -> DataFrame:
        """The references with ``ok``: whether a record covers them."""
        ok = _covered(_ended(F.col("spans"), F.col("ends")), F.col("at"))
        return refs.join(index, ["space", "key"], "left").select(*[f.name for f in REFERENCES.fields], F.coalesce(ok, F.lit(False)).alias("ok"))

    def found(self) -> DataFrame:
        """The orphans: one row for each reference of a row for which no record was live at the row's time."""
        return self._read("pending").select("table_name", "ref_field", "row_key", period_of(F.col("at")).alias("period")).distinct()

    def report(self) -> DataFrame:
        """Orphan references per table, field and month."""
        return self.found().groupBy("table_name", "ref_field", "period").agg(F.count("*").alias("orphans"))

    def snapshot(self, moment: Column) -> DataFrame:
        """At a moment, per table, field and month of the reference: references so far, and those whose key has no
        live record at that moment (a record deleted since reopens them, one added since resolves them)."""
        live = F.coalesce(
            F.exists(
                _ended(F.col("spans"), F.col("ends")),
                lambda s: (s["live_from"].isNull() | (s["live_from"] <= moment))
                & (s["live_until"].isNull() | (moment < s["live_until"])),
            ),
            F.lit(False),
        )
        return (
            self._read("tally").where((F.col("period") == "unknown") | (F.col("period") <= F.date_format(moment, "yyyy-MM")))
            .groupBy("space", "key", "table_name", "ref_field", "period")
            .agg(F.sum("n").alias("n"))
            .join(self._read("parents"), ["space", "key"], "left")
            .groupBy("table_name", "ref_field", "period")
            .agg(F.sum("n").alias("refs"), F.sum(F.when(~live, F.col("n")).otherwise(0)).alias("open_refs"))
            .select(F.date_format(moment, "yyyy-MM-dd").alias("as_of"), "*")
        )
