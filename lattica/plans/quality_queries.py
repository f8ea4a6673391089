"""What must hold of results that SQL can't compute: one row for each check, all of them true."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.operators import community, graph
from lattica.operators.steiner import steiner
from lattica.plans.graph_queries import GAMMA, _clean_edges, edges, membership, top_cited
from lattica.session import written


def _value(df: DataFrame):
    return df.first()[0]


def _rows(spark: SparkSession, **checks: bool) -> DataFrame:
    return spark.createDataFrame([(k, bool(v)) for k, v in checks.items()], "check_name string, holds boolean")


def _communities(spark: SparkSession, links: DataFrame, labels: DataFrame, quality, reference: DataFrame) -> DataFrame:
    """Whether every node has one label, each community is connected, and the quality is that of a reference at least."""
    labels, links = written(labels, "labels"), written(links.select("src", "dst").where("src <> dst"), "links")
    ends = links.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    of = lambda end: labels.select(F.col("node").alias(end), F.col("community").alias(f"c_{end}"))
    pieces = graph.components(links.join(of("src"), "src").join(of("dst"), "dst").where("c_src = c_dst"))
    parts = labels.join(pieces, "node", "left").groupBy("community").agg(F.count_distinct(F.coalesce("component", "node")).alias("n"))
    alone = ends.join(reference, "node", "left").select("node", F.coalesce("community", "node").alias("community"))
    return _rows(
        spark, every_node_once=labels.count() == ends.count() == ends.join(labels, "node").count(), connected=parts.where("n > 1").isEmpty(),
        as_good_as_categories=_value(quality(links, labels)) >= _value(quality(links, alone)),
        as_good_as_single_nodes=_value(quality(links, labels)) >= _value(quality(links, ends.withColumn("community", F.col("node")))),
    )


def g03_checks(spark, folder):
    links = _clean_edges(spark, folder)
    return _communities(spark, links, community.communities(links, refine=False), graph.modularity, membership(spark, folder).select("node", "community"))


def g06_checks(spark, folder):
    links = edges(spark, folder).where("source is not null and target is not null").select(F.col("source").alias("src"), F.col("target").alias("dst"))
    potts = lambda e, m: community.potts(e, m, GAMMA)
    return _communities(spark, links, community.communities(links, gamma=GAMMA), potts, membership(spark, folder).select("node", "community"))


def g07_checks(spark, folder):
    links = _clean_edges(spark, folder)
    return _communities(spark, links, community.communities(links), graph.modularity, membership(spark, folder).select("node", "community"))


def g09_checks(spark, folder):
    """The Steiner network of the most cited nodes holds them all, in one tree for each component that holds any."""
    top = written(top_cited(spark, folder).select("node"), "terminals")
    links = _clean_edges(spark, folder)
    tree = written(steiner(links, top), "tree")
    inside = tree.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    pieces = graph.components(tree).select("component").distinct().count()
    held = graph.components(links).join(top, "node").groupBy("component").agg(F.count("*").alias("n")).where("n > 1")
    terminals = graph.components(links).join(top, "node").join(held.select("component"), "component", "left_semi")
    return _rows(
        spark, holds_all_terminals=terminals.join(inside, "node", "left_anti").isEmpty(), no_circle=tree.count() == inside.count() - pieces,
        one_tree_a_component=pieces == held.count(), edges_of_the_network=tree.join(links, ["src", "dst"], "left_anti").isEmpty(),
    )


def _true(*names: str) -> str:
    return " union all ".join(f"select '{n}' check_name, true holds" for n in names)


_LABELLING = _true("every_node_once", "connected", "as_good_as_categories", "as_good_as_single_nodes")
QUERIES = {"g03_checks": g03_checks, "g06_checks": g06_checks, "g07_checks": g07_checks, "g09_checks": g09_checks}
ORACLE = {
    "g03_checks": _LABELLING, "g06_checks": _LABELLING, "g07_checks": _LABELLING,
    "g09_checks": _true("holds_all_terminals", "no_circle", "one_tree_a_component", "edges_of_the_network"),
}
