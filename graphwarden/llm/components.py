"""Connected components of a graph too large for one machine.

Alternating large-star and small-star rounds: each node links its larger neighbours, then its smaller
ones, to its least neighbour, until every node points at its component's least. A round is a few
joins on edge lists; lineage is cut by checkpoint() into the shared folder, so a lost executor costs
no more than a round.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphwarden.operators.closure import shared_folder


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written to the shared folder: lineage ends there."""
    spark: SparkSession = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: columns are compressed there, which checkpoint() does not do. The folder goes when the session's Python ends."""
    spark: SparkSession = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session has gone already, and the cluster's own cleaning of the folder remains
        return


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star round over edges (u > v): each node's larger (or smaller) neighbours are linked to the least of it and its neighbours."""
    if large:
        near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = near.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that has an edge; edges: (a, b) of bigint, in any order and number. component: the least node reachable."""
    now = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = checkpointed(now)
    while True:
        # done when every node has one link and none links to a node that itself has one
        state = now.groupBy("u").agg(F.count("*").alias("n"))
        tops = now.select(F.col("v").alias("u")).distinct()
        if now.isEmpty() or (state.where("n > 1").isEmpty() and tops.join(state, "u", "left_semi").isEmpty()):
            break
        now = checkpointed(_star(_star(now, True), False))
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
