"""Connected components of an edge table, by least labels with pointer jumping.

Each round costs a few joins on small integer columns: a node takes the least label of its
neighbours, then the label of its label. Nothing is collected but one flag a round. Labels and
neighbours are joined as stored tables, so that AQE splits a hub's rows.

Defined results: edges with a null end are left out, an edge of a node with itself links nothing,
repeated edges count once, and no edges give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import discard, stage


def components(edges: DataFrame, tasks: int | None = None) -> DataFrame:
    """``edges`` (a, b) → (node, label): the least node that is reachable, for every node of an edge.
    ``tasks`` bounds the files of a stored round."""
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other"))
    both = stage(both.unionAll(both.select(F.col("other").alias("node"), F.col("node").alias("other"))).filter("node <> other").distinct(), "edges", tasks)
    labels = stage(both.groupBy("node").agg(F.min("other").alias("least")).select("node", F.least("node", "least").alias("label")), "labels", tasks)
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("other"), "label"), "other")
            .groupBy("node")
            .agg(F.min("label").alias("near"))
        )
        step = labels.select("node", "label").join(near, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("was"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        fresh = stage(
            step.join(jump, "label", "left").select("node", F.least("label", F.coalesce("further", "label")).alias("label"), "was"), "labels", tasks
        )
        discard(labels)
        if fresh.filter("label <> was").isEmpty():
            discard(both)
            return fresh.select("node", "label")
        labels = fresh
