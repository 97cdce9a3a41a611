"""Connected components by minimum labels with pointer jumping, on tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 200) -> DataFrame:
    """(node, comp): the smallest node reachable from each node that has an edge.

    Each round takes the least label among a node's neighbours and then the label's own label, so that long
    chains shorten by doubling. Both steps are joins and partial aggregates; nothing is sent to the driver but
    the number of labels that changed. Edges with a null end are ignored.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    both = materialize(e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "cc-edges")
    labels = materialize(both.groupBy(F.col("u").alias("node")).agg(F.least(F.col("node"), F.min("v")).alias("comp")), "cc")
    for _ in range(max_rounds):
        near = both.join(labels.select(F.col("node").alias("v"), "comp"), "v").groupBy(F.col("u").alias("node")).agg(F.min("comp").alias("near"))
        step = labels.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        up = labels.select(F.col("node").alias("comp"), F.col("comp").alias("top"))
        step = step.join(up, "comp", "left").select("node", "old", F.least("comp", F.coalesce("top", "comp")).alias("comp"))
        step = materialize(step, "cc")
        settled = step.where("comp <> old").isEmpty()
        discard(labels)
        labels = step
        if settled:
            discard(both)
            return labels.select("node", "comp")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
