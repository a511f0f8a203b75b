"""Connected components by label contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioworks.session import cut_lineage


def connected_components(edges: DataFrame, src: str = "a", dst: str = "b", nodes: DataFrame | None = None) -> DataFrame:
    """(node, component) where the component is named by its smallest node.

    Every round each vertex hooks onto its smallest neighbour, hooks are followed to their ends, and the edges are
    rewritten onto those ends. Edges inside one vertex vanish, so the edge set shrinks to nothing.
    Each round is cut to the checkpoint folder.
    """
    links = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u <> v")
    links = cut_lineage(links.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    labels = links.select(F.col("u").alias("node")).union(links.select(F.col("v").alias("node"))).distinct().withColumn("component", F.col("node"))
    rounds = []
    while not links.isEmpty():
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hook = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        while True:  # follow the hooks to their ends; every pass doubles the distance covered
            step = hook
            for _ in range(2):
                nxt = step.select(F.col("u").alias("m"), F.col("m").alias("m2"))
                step = step.join(nxt, "m", "left").select("u", F.coalesce("m2", "m").alias("m"), (F.col("m2") != F.col("m")).alias("_moved"))
            step = cut_lineage(step)
            hook = step.select("u", "m")
            if step.where("_moved").isEmpty():
                break
        left = hook.select("u", F.col("m").alias("mu"))
        right = hook.select(F.col("u").alias("v"), F.col("m").alias("mv"))
        moved = links.join(left, "u", "left").join(right, "v", "left").select(
            F.coalesce("mu", "u").alias("p"), F.coalesce("mv", "v").alias("q")
        )
        links = cut_lineage(
            moved.where("p <> q").select(F.least("p", "q").alias("u"), F.greatest("p", "q").alias("v")).distinct()
        )
        rounds.append(hook)
    for hook in rounds:  # as many as the rounds took, which is a logarithm of the longest chain
        relabel = hook.select(F.col("u").alias("component"), F.col("m").alias("_to"))
        labels = labels.join(relabel, "component", "left").select("node", F.coalesce("_to", "component").alias("component"))
    labels = cut_lineage(labels)
    if nodes is None:
        return labels
    return nodes.select(F.col(nodes.columns[0]).alias("node")).distinct().join(labels, "node", "left").select(
        "node", F.coalesce("component", "node").alias("component")
    )


def household_components(person_links: DataFrame, home_links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, person, household): components of the links of one person, and of those persons by the links of one home.

    The second labelling runs on the graph whose vertices are the persons of the first, so its size is that of the home
    links between different persons. Both labels are the smallest node. A split has to keep whole households.
    """
    person = cut_lineage(connected_components(person_links, "a", "b", nodes))
    of = lambda side: person.select(F.col("node").alias(side), F.col("component").alias(f"_{side}"))
    between = home_links.select("a", "b").join(of("a"), "a").join(of("b"), "b").where("_a <> _b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    home = connected_components(between, "a", "b").select(F.col("node").alias("component"), F.col("component").alias("_home"))
    return person.join(home, "component", "left").select("node", F.col("component").alias("person"), F.coalesce("_home", "component").alias("household"))


def group_sizes(components: DataFrame) -> DataFrame:
    """Groups of more than one member with their size."""
    return components.groupBy("component").agg(F.count("*").alias("members")).where("members > 1")
