"""A small connected sub-network that holds given nodes (Mehlhorn's approximation), with joins only.

All nodes learn their nearest terminal by breadth-first waves; edges between two terminals' regions are bridges as long
as the way over them; a minimum spanning forest of the terminals keeps the shortest bridges (Borůvka rounds: every tree
takes its least bridge); the ways back from the bridges' ends to their terminals make up the tree.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators.graph import components, undirected, without_loops
from lattica.session import written


def steiner(edges: DataFrame, terminals: DataFrame, node: str = "node", src: str = "src", dst: str = "dst") -> DataFrame:
    """``src, dst`` of the tree's edges (of one tree for each component that holds terminals)."""
    links = written(without_loops(undirected(edges, src, dst)), "links")
    both = links.select(F.inline(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))))
    ends = both.select(F.col("src").alias("node")).distinct()
    start = terminals.select(F.col(node).alias("node")).distinct().join(ends, "node", "left_semi")
    reached = written(start.select("node", F.col("node").alias("root"), F.lit(0).alias("depth"), F.lit(None).cast("long").alias("parent")), "reached")
    frontier = reached
    for depth in itertools.count(1):
        step = (
            both.join(frontier.select(F.col("node").alias("src"), "root"), "src")
            .groupBy(F.col("dst").alias("node"))
            .agg(F.min(F.struct("root", "src")).alias("best"))
            .join(reached.select("node"), "node", "left_anti")
            .select("node", F.col("best.root").alias("root"), F.lit(depth).alias("depth"), F.col("best.src").alias("parent"))
        )
        frontier = written(step, "wave")
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    reached = written(reached, "reached")
    side = lambda end, n: reached.select(F.col("node").alias(end), F.col("root").alias(f"r{n}"), F.col("depth").alias(f"d{n}"))
    bridges = links.join(side("src", 1), "src").join(side("dst", 2), "dst").where("r1 <> r2")
    bridges = bridges.select(F.least("r1", "r2").alias("a"), F.greatest("r1", "r2").alias("b"), F.struct((F.col("d1") + F.col("d2") + 1).alias("cost"), "src", "dst").alias("way"))
    bridges = written(bridges.groupBy("a", "b").agg(F.min("way").alias("way")), "bridges")
    trees = start.select("node", F.col("node").alias("tree"))
    chosen = None
    while True:  # every round at least halves the trees that a bridge can join
        of = lambda end: trees.select(F.col("node").alias(end), F.col("tree").alias(f"t{end}"))
        open_ = bridges.join(of("a"), "a").join(of("b"), "b").where("ta <> tb")
        least = (
            open_.select(F.inline(F.array(F.struct(F.col("ta").alias("tree"), "way", "a", "b"), F.struct(F.col("tb").alias("tree"), "way", "a", "b"))))
            .groupBy("tree")
            .agg(F.min(F.struct("way", "a", "b")).alias("best"))
            .select("best.a", "best.b", "best.way")
            .distinct()
        )
        least = written(least, "least")
        if least.isEmpty():
            break
        chosen = least if chosen is None else written(chosen.unionByName(least).distinct(), "chosen")
        joined = components(chosen, "a", "b")
        trees = written(start.join(joined, "node", "left").select("node", F.coalesce("component", "node").alias("tree")), "trees")
    if chosen is None:
        return links.select("src", "dst").limit(0)
    tree = written(chosen.select("way.src", "way.dst").distinct(), "tree")
    at = tree.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    parents = reached.where("parent is not null").select("node", "parent")
    while True:
        up = written(at.join(parents, "node").distinct(), "up")
        if up.isEmpty():
            break
        tree = tree.unionByName(up.select(F.least("node", "parent").alias("src"), F.greatest("node", "parent").alias("dst")))
        at = up.select(F.col("parent").alias("node")).distinct()
    return tree.distinct()
