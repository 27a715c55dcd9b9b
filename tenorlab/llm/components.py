"""Connected components of an edge table, by label spreading with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenorlab.llm._common import drop_table, materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """node, root (the component's smallest node) for every node of ``edges`` (a, b: long, not null).

    Each round a node takes the least root among its neighbours' and its own, then its root's root, so a label's reach
    doubles. Minima are pre-aggregated before each shuffle and joins are equi-joins whose hot keys adaptive execution
    splits. Every round is a table in the shared folder. An edge from a node to itself makes it a component of one.
    """
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root")), "labels")
    while True:
        mine = labels.withColumnRenamed("root", "was")
        theirs = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("root").alias("least"))
        hooked = mine.join(theirs, mine["node"] == theirs["a"]).select("node", "was", F.least("was", "least").alias("root"))
        up = labels.select(F.col("node").alias("r"), F.col("root").alias("rr"))
        jumped = hooked.join(up, hooked["root"] == up["r"]).select("node", "was", F.least("root", "rr").alias("root"))
        fresh = materialize(jumped, "labels")
        changed = fresh.where(F.col("was") != F.col("root")).limit(1).count()
        drop_table(labels)
        if not changed:
            return fresh.select("node", "root")
        labels = fresh.select("node", "root")
        labels._shared_path = fresh._shared_path
