"""Graph operators on edge tables; every loop step is a join, and steps are written, so lineage stays short."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.operators.dedupe import dense_ids
from lattica.session import written


def simple_graph(triples: DataFrame, order: list[str], attributes: list[str], source: str = "h", target: str = "t") -> DataFrame:
    """One edge for each (source, target): of each attribute the last value that is not null. Blank ends make no edge."""
    last = F.struct(*[F.col(o) for o in order])
    return (
        triples.where((F.trim(F.col(source)) != "") & (F.trim(F.col(target)) != ""))
        .groupBy(F.col(source).alias("src"), F.col(target).alias("dst"))
        .agg(*[F.max_by(F.col(a), F.when(F.col(a).isNotNull(), last)).alias(a) for a in attributes])
    )


def undirected(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Each pair once, the smaller end first; loops stay."""
    return edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull()).select(
        F.least(src, dst).alias("src"), F.greatest(src, dst).alias("dst")
    ).distinct()


def without_loops(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    return edges.where(F.col(src) != F.col(dst)).select(F.col(src).alias("src"), F.col(dst).alias("dst")).distinct()


def degrees(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``node``, ``degree``: ends in and out."""
    ends = F.explode(F.array(F.col(src), F.col(dst)))
    return edges.select(ends.alias("node")).where("node is not null").groupBy("node").agg(F.count("*").alias("degree"))


def induced(edges: DataFrame, nodes: DataFrame, node: str = "node", src: str = "src", dst: str = "dst") -> DataFrame:
    """Edges with both ends among the nodes."""
    ids = nodes.select(F.col(node).alias("__id")).distinct()
    for end in (src, dst):
        edges = edges.join(ids, edges[end] == ids["__id"], "left_semi")
    return edges


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``node``, ``component``: the least node that can be reached.

    Large-star and small-star rounds (Kiveris and others, 2014): each contracts the edges towards least neighbours, so
    rounds grow with the logarithm of the size, and a hub's edges are grouped with map-side minima only.
    """
    pairs = without_loops(undirected(edges, src, dst))
    nodes = edges.select(F.explode(F.array(F.col(src), F.col(dst))).alias("node")).where("node is not null").distinct()
    state = written(pairs, "components")

    def star(links: DataFrame, large: bool) -> DataFrame:
        # large: every node with all neighbours; small: with those not above it
        both = links.select(F.inline(F.array(F.struct(F.col("src").alias("u"), F.col("dst").alias("v")), F.struct(F.col("dst").alias("u"), F.col("src").alias("v")))))
        around = both if large else both.where("v < u")
        least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        joined = around.join(least, "u")
        if large:
            out = joined.where("v > u").select(F.col("m").alias("src"), F.col("v").alias("dst"))
        else:
            out = joined.select(F.col("m").alias("src"), F.col("v").alias("dst")).unionByName(least.select(F.col("m").alias("src"), F.col("u").alias("dst")))
        return out.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()

    sums = lambda d: d.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
    before, after = None, sums(state)
    while after != before:
        state = written(star(star(state, True), False), "components", replaces=state)
        before, after = after, sums(state)
    return nodes.join(state.select(F.col("dst").alias("node"), F.col("src").alias("c")), "node", "left").select(
        "node", F.coalesce("c", "node").alias("component")
    )


def largest_component(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``node`` of the largest component; of equal ones, that with the least node."""
    labels = written(components(edges, src, dst), "labels")
    top = labels.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1)
    return labels.join(F.broadcast(top.select("component")), "component").select("node")


def hops(edges: DataFrame, start: DataFrame, k: int, node: str = "node", src: str = "src", dst: str = "dst", candidates: DataFrame | None = None) -> DataFrame:
    """``node``, ``depth`` of all nodes within k steps along the edges; with ``candidates`` only these are entered."""
    seen = written(start.select(F.col(node).alias("node")).where("node is not null").distinct().withColumn("depth", F.lit(0)), "hops")
    links = edges.select(F.col(src).alias("__s"), F.col(dst).alias("__d"))
    if candidates is not None:
        links = links.join(candidates.select(F.col(node).alias("__d")).distinct(), "__d", "left_semi")
    for depth in range(1, k + 1):
        frontier = seen.where(F.col("depth") == depth - 1)
        new = frontier.join(links, frontier["node"] == links["__s"]).select(F.col("__d").alias("node")).distinct()
        new = written(new.where("node is not null").join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)), "hops")
        seen = seen.unionByName(new)
    return seen


def collected_edges(edges: DataFrame, start: DataFrame, k: int, node: str = "node", src: str = "src", dst: str = "dst") -> DataFrame:
    """Edges that leave a node less than k steps from the start, each once, with its ``depth``."""
    near = hops(edges, start, k - 1, node, src, dst)
    return edges.join(near, edges[src] == near["node"]).drop("node")


def expansion_events(edges: DataFrame, seeds: DataFrame, k: int, node: str = "node", src: str = "src", dst: str = "dst") -> DataFrame:
    """Edges found while expanding from seeds over a shrinking set of candidates: ``src, dst, hop``.

    At hop h the edges between the frontier and nodes not yet taken are recorded, in both directions; the nodes found
    become the frontier. Edges among nodes already taken are not recorded.
    """
    taken = written(seeds.select(F.col(node).alias("node")).distinct(), "taken")
    frontier, out = taken, []
    links = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src <> dst").distinct()
    for hop in range(1, k + 1):
        fresh = links.join(frontier.withColumnRenamed("node", "src"), "src").join(taken.withColumnRenamed("node", "dst"), "dst", "left_anti")
        back = links.join(frontier.withColumnRenamed("node", "dst"), "dst").join(taken.withColumnRenamed("node", "src"), "src", "left_anti")
        found = written(
            fresh.select("src", "dst", F.col("dst").alias("new")).unionByName(back.select("src", "dst", F.col("src").alias("new"))), "expansion"
        )
        out.append(found.select("src", "dst", F.lit(hop).alias("hop")))
        frontier = written(found.select(F.col("new").alias("node")).distinct(), "frontier")
        taken = taken.unionByName(frontier)
    return reduce(DataFrame.unionByName, out)


def reindexed(nodes: DataFrame, edges: DataFrame, node: str = "node", src: str = "src", dst: str = "dst") -> tuple[DataFrame, DataFrame]:
    """Nodes with ``new_id`` 0..n-1 in the order of the old ids, and edges in new ids (null where an end is no node)."""
    ids = written(dense_ids(nodes.select(F.col(node).alias("old_id")).where("old_id is not null").distinct(), ["old_id"], "new_id"), "new-ids")
    ends = {end: ids.select(F.col("old_id").alias(f"__{end}"), F.col("new_id").alias(f"new_{end}")) for end in (src, dst)}
    for end in (src, dst):
        edges = edges.join(ends[end], F.col(end) == F.col(f"__{end}"), "left").drop(f"__{end}")
    return ids, edges


def unified(nodes: DataFrame, fields: list[str], field: str = "field", node: str = "node") -> DataFrame:
    """``global_id, field, local_id``: nodes of each field numbered on from those of the fields before it, in the order
    of ``fields``; fields not in the list come last in the order of their names."""
    position = F.coalesce(F.array_position(F.array(*map(F.lit, fields)), F.col(field)), F.lit(0))
    rank = F.when(position > 0, position).otherwise(len(fields) + 1)
    rows = nodes.select(F.col(field).alias("field"), F.col(node).alias("local_id"), rank.alias("__rank")).where("field is not null").distinct()
    return dense_ids(rows, ["__rank", "field", "local_id"], "global_id").select("global_id", "field", "local_id")


def modularity(edges: DataFrame, membership: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """One row ``modularity`` of a labelling of an undirected graph with unit weights."""
    of = lambda end: membership.select(F.col("node").alias(end), F.col("community").alias(f"c_{end}"))
    labelled = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).join(of("src"), "src").join(of("dst"), "dst")
    ends = labelled.select(F.explode(F.array("c_src", "c_dst")).alias("community")).groupBy("community").agg(F.count("*").alias("ends"))
    inner = labelled.where("c_src = c_dst").groupBy(F.col("c_src").alias("community")).agg(F.count("*").alias("inner"))
    return (
        ends.join(inner, "community", "left")
        .agg(
            F.sum(F.coalesce("inner", F.lit(0))).alias("inner"), F.sum("ends").alias("ends"),
            F.sum(F.col("ends").cast("double") * F.col("ends")).alias("squares"),
        )
        .select((F.col("inner") / (F.col("ends") / 2) - F.col("squares") / (F.col("ends").cast("double") * F.col("ends"))).alias("modularity"))
    )


def top_by_degree(edges: DataFrame, n: int, src: str = "src", dst: str = "dst") -> DataFrame:
    return degrees(edges, src, dst).orderBy(F.desc("degree"), "node").limit(n)


def pair_counts(edges: DataFrame, a: Column, b: Column) -> DataFrame:
    """Edges by the unordered pair of their ends' labels."""
    return edges.groupBy(F.least(a, b).alias("first"), F.greatest(a, b).alias("second")).agg(F.count("*").alias("n"))


def carried_forward(df: DataFrame, value: str, order: list[str], partition: list[str], name: str) -> DataFrame:
    """The last value that was not null, in the order given, within each partition."""
    window = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(window))
