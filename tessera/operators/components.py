"""Named components of a graph, and checks on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.keys import UNIT
from tessera.operators.graph import connected_components


def named_components(nodes: DataFrame, edges: DataFrame, node: str = "node") -> DataFrame:
    """(node, component_id, size) for all nodes; a node without edges is a component.

    The id is FC_ and sixteen hex digits of the digest of the sorted members.
    """
    found = connected_components(edges)
    labelled = nodes.select(F.col(node).alias("node")).distinct().join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = labelled.groupBy("component").agg(F.concat(F.lit("FC_"), F.substring(F.sha2(F.array_join(F.sort_array(F.collect_list(F.col("node").cast("string"))), UNIT), 256), 1, 16)).alias("component_id"), F.count("*").alias("size"))
    return labelled.join(named, "component").select("node", "component_id", "size")
