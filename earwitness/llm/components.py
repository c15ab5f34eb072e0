"""Connected components by contraction, for edge tables of any size."""

from __future__ import annotations

import uuid
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earwitness.llm.common import shared_folder


def roots(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` -> ``(node, root)`` for every node of an edge; one root per component.

    Every node points to its smallest neighbour (or stays), pointers are followed
    until they end, and the edges are contracted to the ends. The smallest node of
    a neighbourhood absorbs at least one other, so the node count halves at least;
    a component of millions takes a few rounds. All steps are aggregates with
    map-side sums and equi-joins that AQE can split. Self-loops and repeated edges
    are harmless, null ends are ignored.

    Every step is written under the shared checkpoint folder, in place of the one
    before the last, and read again. A checkpoint would hand on the estimated size:
    that of a join is the product of both sides, so the number's digits double with
    each pointer jump, on the driver. A table that is read has the size of its files.
    """
    spark = edges.sparkSession
    folder, turns = f"{shared_folder(spark)}/roots-{uuid.uuid4().hex}", Counter()

    def kept(df: DataFrame, name: str) -> DataFrame:
        path = f"{folder}/{name}-{turns[name] % 2}"
        turns[name] += 1
        df.write.mode("overwrite").parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    edges = kept(edges.select("a", "b").where("a is not null and b is not null").distinct(), "edges")
    every = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    found = every.select("node", F.col("node").alias("root"))
    edges = edges.where("a <> b")
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        down = kept(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("to")), "down")
        while True:
            ahead = down.select(F.col("node").alias("to"), F.col("to").alias("beyond"))
            jumped = kept(down.join(ahead, "to").select("node", F.col("beyond").alias("to"), (F.col("to") != F.col("beyond")).alias("moved")), "down")
            down = jumped.select("node", "to")
            if jumped.where("moved").isEmpty():
                break
        found = found.join(down.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        ends = edges.join(down.select(F.col("node").alias("a"), F.col("to").alias("x")), "a").join(down.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
        edges = kept(ends.select(F.col("x").alias("a"), F.col("y").alias("b")).where("a <> b").distinct(), "edges")
        found = kept(found, "found")
    return found


def smallest_labels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``nodes(node, label)`` + ``edges(a, b)`` -> ``(node, component)``: the smallest label reachable by edges."""
    joined = nodes.join(roots(edges), "node", "left")
    lowest = joined.where("root is not null").groupBy("root").agg(F.min("label").alias("lowest"))
    return joined.join(lowest, "root", "left").select("node", F.when(F.col("root").isNull(), F.col("label")).otherwise(F.col("lowest")).alias("component"))
