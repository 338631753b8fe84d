"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.llm.common import settle


def _unfinished(edges: DataFrame) -> bool:
    """Whether some node has two smaller neighbours, or a smaller and a larger one; else every component is a star."""
    ends = edges.select(F.explode(F.array(
        F.struct(F.col("u").alias("node"), F.lit(1).alias("smaller")), F.struct(F.col("v").alias("node"), F.lit(0).alias("smaller")))).alias("end"))
    sides = ends.select("end.*").groupBy("node").agg(F.sum("smaller").alias("below"), F.count(F.lit(1)).alias("all"))
    return sides.where("below > 1 or below = 1 and all > 1").count() > 0


def _round(edges: DataFrame) -> DataFrame:
    """Every node hands its larger neighbours to its smallest one, then every node its smaller neighbours to the smallest.

    Edges lead from the larger node to the smaller one. The table is scanned twice
    and shuffled four times: a round costs the driver its stages, whatever its rows.
    """
    least = edges.groupBy("u").agg(F.min("v").alias("m")).toDF("v", "m")
    large = edges.join(least.hint("merge"), "v", "left").select("u", F.coalesce("m", "v").alias("v"))
    small = large.withColumn("m", F.min("v").over(W.partitionBy("u")))
    ends = F.explode(F.array("u", "v")).alias("u")
    return small.select(ends, F.col("m").alias("v")).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of an edge (u, v); the label is the component's smallest node.

    Repeats ``_round`` until every component is a star around its smallest node.
    The edge count never grows, and the number of rounds grows with the logarithm
    of the size. Each round is written to the shared folder. Joins are merge joins:
    a broadcast would bring its table to the driver, once a join and round.
    """
    current = settle(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while _unfinished(current):
        current = settle(_round(current), "edges")
    return current.select(F.col("u").alias("node"), F.col("v").alias("label")).union(
        current.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
