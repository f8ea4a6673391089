import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lattica.operators.orphans import REFERENCES, REMOVALS, SPANS, OrphanTracker, references, spans
from lattica.streaming.orphan_stream import late_counts, track

DAY = datetime(2024, 1, 1)


def at(n):
    return None if n is None else DAY + timedelta(days=n)


def case(seed, n=300):
    """References (a third of them to one key) and spans of keys that come, go and come again."""
    rng = random.Random(seed)
    refs = [("s", f"k{0 if rng.random() < 0.33 else rng.randrange(40)}", "t", "f", str(i), at(rng.choice([None, *range(400)]))) for i in range(n)]
    live = []
    for k in range(0, 30):
        start = rng.randrange(200)
        end = start + rng.randrange(1, 100) if rng.random() < 0.5 else None
        live.append(("s", f"k{k}", at(start), at(end)))
        if end and rng.random() < 0.5:
            live.append(("s", f"k{k}", at(end + 20), None))
    return refs, live + live[:5]


def brute(refs, live):
    out = set()
    for _, key, table, field, row, t in refs:
        own = [s for s in live if s[1] == key]
        if not any(t is None or ((a is None or a <= t) and (z is None or t < z)) for _, _, a, z in own):
            out.add((table, field, row, t.strftime("%Y-%m") if t else "unknown"))
    return sorted(out)


def test_any_batches_equal_brute_force(spark, collect):
    refs, live = case(3)
    for cuts in ([None], [100, None], [50, 60, 250, None]):
        state, low = OrphanTracker(spark), -1
        for high in cuts:
            inside = lambda t, low=low, high=high: (t is None and low < 0) or (t is not None and t >= at(max(low, 0)) and (high is None or t < at(high)))
            state.ingest(
                spark.createDataFrame([r for r in refs if inside(r[5])], REFERENCES), spark.createDataFrame([s for s in live if inside(s[2])], SPANS)
            )
            low = high
        assert collect(state.found()) == brute(refs, live)


def test_late_parents_and_deletions(spark, collect):
    state = OrphanTracker(spark)
    state.ingest(spark.createDataFrame([("s", "a", "t", "f", "1", None), ("s", "a", "t", "f", "2", at(5))], REFERENCES), spark.createDataFrame([], SPANS))
    assert collect(state.found()) == [("t", "f", "1", "unknown"), ("t", "f", "2", "2024-01")]
    state.ingest(spark.createDataFrame([], REFERENCES), spark.createDataFrame([("s", "a", at(3), at(40))], SPANS))
    assert collect(state.found()) == []
    open_at = lambda n: sum(r.open_refs for r in state.snapshot(F.lit(at(n)).cast("timestamp_ntz")).collect())
    assert (open_at(39), open_at(41)) == (0, 2)  # the deletion reopens both


def test_removal_in_a_later_batch(spark, collect):
    """A removal reopens the references after it, in any order of the batches; a new record of the key is not ended."""
    df = spark.createDataFrame
    refs = [("s", "a", "t", "f", str(n), at(n)) for n in (5, 20, 31, 70)] + [("s", "b", "t", "f", "6", at(6)), ("s", "a", "t", "f", "0", None)]
    batches = [
        (refs[:2] + refs[4:], [("s", "a", at(3), None), ("s", "b", None, None)], None),
        (refs[2:4], [], None),
        ([], [], [("s", "a", at(10)), ("s", None, at(1)), ("s", "b", None), ("s", "c", at(1))]),
        ([], [("s", "a", at(60), None)], None),
    ]
    for order in ((0, 1, 2, 3), (2, 3, 1, 0), (3, 0, 2, 1)):
        state = OrphanTracker(spark)
        for i in order:
            r, live, removed = batches[i]
            state.ingest(df(r, REFERENCES), df(live, SPANS), None if removed is None else df(removed, REMOVALS))
        assert collect(state.found()) == [("t", "f", "20", "2024-01"), ("t", "f", "31", "2024-02")]
        assert collect(state.report()) == [("t", "f", "2024-01", 1), ("t", "f", "2024-02", 1)]
        open_at = lambda n, state=state: sum(x.open_refs for x in state.snapshot(F.lit(at(n)).cast("timestamp_ntz")).collect())
        assert (open_at(9), open_at(32), open_at(75)) == (0, 4, 0)


def test_end_of_a_span_in_a_later_batch(spark, collect):
    """A span that comes again with its end closes the open one; any order of arrivals equals brute force."""
    df = spark.createDataFrame
    refs = [("s", "a", "t", "f", str(n), at(n)) for n in (2, 10)]
    steps = [(refs, []), ([], [("s", "a", at(1), None)]), ([], [("s", "a", at(1), at(5))])]
    for order in ((0, 1, 2), (2, 1, 0), (1, 2, 0), (1, 0, 2)):
        state = OrphanTracker(spark)
        for i in order:
            state.ingest(df(steps[i][0], REFERENCES), df(steps[i][1], SPANS))
        assert collect(state.found()) == [("t", "f", "10", "2024-01")]
        assert [r.open_refs for r in state.snapshot(F.lit(at(10)).cast("timestamp_ntz")).collect()] == [2]


def test_restarted_tracker(spark, collect, tmp_path):
    """A tracker opened on the folder of another goes on; a batch brought again is taken once."""
    refs, live = case(5, 80)
    df, folder = spark.createDataFrame, str(tmp_path / "state")
    OrphanTracker(spark, folder).ingest(df(refs[:50], REFERENCES), df(live[:20], SPANS), batch=0)
    state = OrphanTracker(spark, folder).ingest(df(refs[:50], REFERENCES), df(live[:20], SPANS), batch=0)
    state.ingest(df(refs[50:], REFERENCES), df(live[20:], SPANS), batch=1)
    state.prune()
    assert collect(OrphanTracker(spark, folder).found()) == collect(state.found()) == brute(refs, live)
    assert sum(r.refs for r in state.snapshot(F.lit(at(999)).cast("timestamp_ntz")).collect()) == len(refs)


def test_unpivot_keys_and_clashing_columns(spark, collect):
    df = spark.createDataFrame([("r1", " K ", None, at(1), "x"), ("r1", " K ", None, at(1), "x"), ("r2", "", "\u00a0", at(1), "x"), (None, "m", "k", None, "x")], "id string, a string, b string, ts timestamp_ntz, space string")
    refs = references(df, "s", "t", "id", "ts", ["a", "b"])
    assert collect(refs.select("key", "ref_field", "row_key")) == sorted([("k", "a", "r1"), ("k", "a", "r1"), ("m", "a", None), ("k", "b", None)], key=repr)
    live = spans(spark.createDataFrame([("K",), (None,)], "id string"), "s", "id")
    found = OrphanTracker(spark).ingest(refs, live).found()
    assert collect(found) == [("t", "a", None, "unknown")]


def test_stream(spark, collect, tmp_path):
    refs, live = case(9, 60)
    schema = "kind string, space string, key string, table_name string, ref_field string, row_key string, at timestamp_ntz, live_from timestamp_ntz, live_until timestamp_ntz"
    rows = [("reference", *r, None, None) for r in refs] + [("span", s, k, None, None, None, None, a, z) for s, k, a, z in live]
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(tmp_path / "in"))
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query, state = track(spark, events, str(tmp_path / "cp"))
    query.awaitTermination(120)
    assert collect(state.found()) == brute(refs, live)


def test_late_counts_plan(spark, tmp_path):
    spark.createDataFrame([(DAY, "a")], "ts timestamp, k string").write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("ts timestamp, k string").parquet(str(tmp_path / "e"))
    query = late_counts(stream, "ts", "1 hour", "1 day", "k").writeStream.format("memory").queryName("late").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert spark.table("late").columns == ["window_start", "key", "n"]
