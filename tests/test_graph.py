import random

from lattica.operators import community, graph, steiner


def frame(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def test_components(spark, collect):
    edges = frame(spark, [(1, 2), (2, 3), (4, 5), (7, 7), (None, 9)])
    assert collect(graph.components(edges)) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (7, 7), (9, 9)]
    assert [r[0] for r in collect(graph.largest_component(edges))] == [1, 2, 3]
    assert collect(graph.components(edges.limit(0))) == []


def test_components_random(spark, collect):
    rng = random.Random(5)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 480)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    want = sorted(((x, find(x)) for p in pairs for x in p), key=repr)
    assert collect(graph.components(frame(spark, pairs))) == sorted(set(want), key=repr)


def test_simple_graph(spark, collect):
    df = spark.createDataFrame([("a", "r1", "b", "doc1", 1), ("a", "r2", "b", None, 2), ("", "r", "b", "d", 3)], "h string, r string, t string, d string, o int")
    assert collect(graph.simple_graph(df, ["o"], ["r", "d"])) == [("a", "b", "r2", "doc1")]


def test_reindex_and_unify(spark, collect):
    nodes = spark.createDataFrame([(5,), (9,), (12,), (12,), (None,)], "node long")
    ids, moved = graph.reindexed(nodes, frame(spark, [(5, 12), (9, 99)]))
    assert collect(ids) == [(12, 2), (5, 0), (9, 1)]
    assert collect(moved.select("new_src", "new_dst")) == [(0, 2), (1, None)]
    fields = spark.createDataFrame([("x", i) for i in range(3)] + [("y", i) for i in range(2)] + [("z", i) for i in range(2)], "field string, node long")
    got = collect(graph.unified(fields, ["y", "x"]))
    assert sorted(r for r in got if r[2] == 0) == [(0, "y", 0), (2, "x", 0), (5, "z", 0)]


def test_hops(spark, collect):
    chain = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "src string, dst string")
    start = spark.createDataFrame([("a",)], "node string")
    assert collect(graph.collected_edges(chain, start, 2)) == [("a", "b", 0), ("b", "c", 1)]
    events = graph.expansion_events(spark.createDataFrame([("s", "x"), ("x", "y"), ("y", "x")], "src string, dst string"), spark.createDataFrame([("s",)], "node string"), 2)
    assert collect(events) == [("s", "x", 1), ("x", "y", 2), ("y", "x", 2)]


TRIANGLES = [(1, 2), (2, 3), (1, 3), (4, 5), (5, 6), (4, 6), (3, 4)]


def test_modularity(spark):
    labels = spark.createDataFrame([(i, 0 if i < 4 else 1) for i in range(1, 7)], "node long, community long")
    assert abs(graph.modularity(frame(spark, TRIANGLES), labels).first()[0] - 0.357143) < 1e-6


def test_communities(spark, collect):
    for gamma in (None, 0.4):
        got = dict(collect(community.communities(frame(spark, TRIANGLES), gamma=gamma)))
        assert len({got[i] for i in (1, 2, 3)}) == 1 and len({got[i] for i in (4, 5, 6)}) == 1 and got[1] != got[4]
    members = spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "node long, community long")
    assert collect(community.at_least(members, 2)) == [(1, 0), (2, 0)]
    assert collect(community.touching(members, spark.createDataFrame([(3,)], "node long"))) == [(3, 1)]


def test_steiner(spark, collect):
    edges = frame(spark, [(1, 2), (2, 3), (3, 4), (2, 9), (4, 5), (20, 21)])
    tree = collect(steiner.steiner(edges, spark.createDataFrame([(1,), (9,), (4,), (77,)], "node long")))
    assert tree == [(1, 2), (2, 3), (2, 9), (3, 4)]


def test_carried_forward(spark, collect):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "b"), (4, None)], "o int, v string").selectExpr("1 as p", "o", "v")
    assert [r[3] for r in collect(graph.carried_forward(df, "v", ["o"], ["p"], "l"))] == ["a", "a", "b", "b"]
