"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velspar.session import materialise

#: Rows of one written file.
EDGES_A_FILE = 250_000


def connected(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, component) for the ends of edges (a, b): component is the smallest node reachable.

    Each round every component takes the smallest component that an edge leads to, labels are then followed to their ends,
    and edges inside one component go. Labels and edges stay distributed; each round's tables are written, so a lost executor costs no
    lineage. A round at least halves the components that still have edges. An edge from a node to itself makes it a component; empty edges give an
    empty table.
    """
    edges = materialise(spark, edges.select("a", "b").distinct(), "edges")
    files = 1 + edges.count() // EDGES_A_FILE  # every later table has at most twice as many rows

    def written(df: DataFrame, name: str) -> DataFrame:
        return materialise(spark, df.coalesce(files), name)

    labels = written(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("component", F.col("node")), "labels")
    live = edges.where("a <> b")
    while not live.isEmpty():
        # Hook: every component to its smallest neighbour if that is smaller. Hooks point to smaller nodes, so they have no cycles.
        hooks = live.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("up")).groupBy("node").agg(F.min("up").alias("up"))
        hooks = written(hooks, "hooks")
        while True:  # pointer jumping to the roots
            up = hooks.select(F.col("node").alias("up"), F.col("up").alias("next"))
            jumped = hooks.join(up, "up", "left").select("node", F.coalesce("next", "up").alias("up"), F.col("next").isNotNull().alias("moved"))
            jumped = written(jumped, "hooks")
            moved = not jumped.where("moved").isEmpty()
            hooks = jumped.drop("moved")
            if not moved:
                break
        root = hooks.select(F.col("node").alias("component"), F.col("up"))
        labels = written(labels.join(root, "component", "left").select("node", F.coalesce("up", "component").alias("component")), "labels")
        for end in ("a", "b"):
            live = live.join(hooks.withColumnRenamed("node", end), end, "left").withColumn(end, F.coalesce("up", end)).drop("up")
        live = written(live.where("a <> b").distinct(), "edges")
    return labels
