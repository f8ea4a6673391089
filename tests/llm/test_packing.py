import math
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lattica.llm.packing import fill, packed

WINDOWS = [("short", 512), ("wide", 2048), ("none", 0), (None, None)]


def frames(spark, sizes):
    items = spark.createDataFrame(list(enumerate(sizes)), "doc_id long, tokens long").selectExpr("*", "'x' as capacity", "'y' as piece", "1 as shard")
    return items, spark.createDataFrame(WINDOWS, "window_name string, capacity_tokens int")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 100), max_size=60))
def test_fill_never_overflows(sizes):
    sizes = np.array(sorted(sizes, reverse=True), dtype=np.int64)
    at = fill(sizes, 100)
    assert len(at) == len(sizes)
    if len(sizes):
        load = np.bincount(at, weights=sizes)
        assert load.max() <= 100
        assert len(load) <= max(1, math.ceil(sizes.sum() / 50))  # no two sequences half empty


def test_every_token_has_a_place(spark):
    rng = random.Random(1)
    sizes = [rng.choice([0, None, 5, 100, 300, 511, 512, 513, 1024, 5000, rng.randrange(600)]) for _ in range(700)]
    got = packed(*frames(spark, sizes), shard_items=200).toPandas()
    assert set(got.window_name) == {"short", "wide"}
    for name, capacity in (("short", 512), ("wide", 2048)):
        part = got[got.window_name == name]
        assert part.groupby("doc_id").tokens.sum().to_dict() == {i: s or 0 for i, s in enumerate(sizes)}
        assert part.groupby("container").tokens.sum().max() <= capacity
        pieces = part.groupby("doc_id").size()
        assert all(pieces[i] == max(1, math.ceil((s or 0) / capacity)) for i, s in enumerate(sizes))  # split only if too long
        assert part.groupby("container").tokens.sum().mean() / capacity > 0.9
        assert not part.duplicated(["doc_id", "piece"]).any()


def test_deterministic_and_empty(spark, collect):
    sizes = [7] * 50
    assert collect(packed(*frames(spark, sizes))) == collect(packed(*frames(spark, sizes)))
    assert collect(packed(*frames(spark, []))) == []
    items, windows = frames(spark, sizes)
    assert collect(packed(items, windows.limit(0))) == []


def test_repeated_and_null_ids(spark):
    """Rows of one id or none are items of their own: no container is overfull, none is lost."""
    items = spark.createDataFrame([(7, 200)] * 3 + [(None, 200)] * 3 + [(None, 30)] * 40, "doc_id long, tokens long")
    windows = spark.createDataFrame([("w", 100)], "window_name string, capacity_tokens int")
    rows = packed(items, windows, shard_items=10).collect()
    loads = {}
    for r in rows:
        loads[r.container] = loads.get(r.container, 0) + r.tokens
    assert max(loads.values()) <= 100 and sum(loads.values()) == 1200 + 1200 and len(rows) == 12 + 40


def test_too_many_windows(spark):
    import pytest

    windows = spark.range(1001).selectExpr("cast(id as string) window_name", "cast(id + 1 as int) capacity_tokens")
    with pytest.raises(ValueError):
        packed(spark.createDataFrame([(1, 5)], "doc_id long, tokens long"), windows)
