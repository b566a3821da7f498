"""Distributed connected components: minimum labels with pointer jumping.

Each round, a node takes the least label among its neighbours and then the
label of its label, so paths shorten by halves. State is written to the shared
checkpoint folder every round; nothing is gathered on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import base


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for each node that has an edge to another node; component is the least node.

    Null ends and loops are no edges. Ids may be of any ordered type.
    """
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    sym = base.materialize(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = base.materialize(sym.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")))
    while True:
        msg = sym.join(labels, sym.a == labels.node).groupBy(sym.b.alias("v")).agg(F.min("component").alias("m"))
        told = labels.join(msg, labels.node == msg.v).select("node", F.col("component").alias("old"), F.least("component", "m").alias("now"))
        up = labels.select(F.col("node").alias("u"), F.col("component").alias("ul"))
        step = base.materialize(told.join(up, told.now == up.u).select("node", "old", F.least("now", "ul").alias("component")))
        base.release(labels)
        labels = step
        if not step.where("old <> component").limit(1).count():
            base.release(sym)
            out = step.select("node", "component")
            out._quarry_path = step._quarry_path  # for base.release
            return out
