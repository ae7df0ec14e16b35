"""Paths in a link table (scope, a, b): closure, reach between given ends, and nodes on cycles.

Reach and cycles work on a graph that is folded first. A node with one way out is a pointer to the next one, and
pointers of pointers lead past whole chains and trees in a logarithm of rounds: the node goes, and links to it lead
to where its pointers end. The same is done against the links. What is left has two ways in and out of
every node; its cycles are found by colours, and folding goes on with what they leave.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shared_folder(spark) -> str:
    """The folder in spark.checkpoint.dir; a local session may do without, a cluster may not."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return os.path.join(tempfile.gettempdir(), "graphwarden-checkpoints")


def checkpointed(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, read back: lineage ends there, and so do the constraints that a plan of many self-joins piles up. The folder goes when the session's Python ends."""
    spark = df.sparkSession
    path = new_folder(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def new_folder(spark) -> str:
    """A folder's name in the shared one that nothing has yet; it goes when the session's Python ends."""
    path = f"{shared_folder(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark, path: str) -> None:
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session has gone already, and the cluster's own cleaning of the folder remains
        return


def closure(edges: DataFrame) -> DataFrame:
    """All (scope, a, b) with a path of one link or more; cycles are fine.

    Each round joins the newest pairs with all pairs known, so the number of rounds is the logarithm
    of the longest shortest path, and only new pairs are written.
    """
    frontier = reached = checkpointed(edges.select("scope", "a", "b").distinct())
    while not frontier.isEmpty():
        ahead = frontier.select("scope", "a", F.col("b").alias("via")).join(reached.select("scope", F.col("a").alias("via"), "b"), ["scope", "via"]).select("scope", "a", "b")
        behind = reached.select("scope", "a", F.col("b").alias("via")).join(frontier.select("scope", F.col("a").alias("via"), "b"), ["scope", "via"]).select("scope", "a", "b")
        frontier = checkpointed(ahead.unionByName(behind).distinct().join(reached, ["scope", "a", "b"], "left_anti"))
        reached = reached.unionByName(frontier)
    return reached


# folding


def _turned(edges: DataFrame) -> DataFrame:
    return edges.select("scope", F.col("b").alias("a"), F.col("a").alias("b"))


def _ends(edges: DataFrame, end: str) -> DataFrame:
    return edges.select("scope", F.col(end).alias("node")).distinct()


@dataclass
class Fold:
    """One folding: pointers after 1, 4, 16, ... links (scope, node, to, open), and the links that led into what was folded (scope, a, via, b): from a by the folded node via to b."""

    powers: list[DataFrame]
    entries: DataFrame
    turned: bool

    @property
    def circling(self) -> DataFrame:
        """(scope, node): nodes on cycles of pointers alone: after so many steps none else is led to."""
        return self.powers[-1].where("open").select("scope", F.col("to").alias("node")).distinct()


def _jumped(pointers: DataFrame) -> DataFrame:
    """Pointers of pointers; open: whether what is led to has a pointer itself."""
    ahead = pointers.select("scope", F.col("node").alias("to"), F.col("to").alias("next"), F.col("open").alias("further"))
    moved = pointers.where("open").drop("open").join(ahead, ["scope", "to"]).select("scope", "node", F.col("next").alias("to"), F.col("further").alias("open"))
    return pointers.where("NOT open").unionByName(moved)


def _pointers(single: DataFrame) -> list[DataFrame]:
    """Pointers (scope, node, to, open) after 1, 4, 16, ... steps, until nothing is led to that steps would leave."""
    known = single.select("scope", F.col("node").alias("to"), F.lit(True).alias("open"))
    powers = [checkpointed(single.join(known, ["scope", "to"], "left").select("scope", "node", "to", F.coalesce("open", F.lit(False)).alias("open")))]
    led = powers[-1].where("open").select("scope", "to").distinct().count()
    while led:
        powers.append(checkpointed(_jumped(_jumped(powers[-1]))))
        before, led = led, powers[-1].where("open").select("scope", "to").distinct().count()
        if led == before:
            break
    return powers


def _fold(edges: DataFrame, turned: bool, keep: DataFrame | None) -> tuple[DataFrame, Fold] | None:
    """(links left, what was folded) of nodes with one way out, and without those that lead nowhere; None if there are neither. Nodes of keep (scope, node) stay."""
    now = _turned(edges) if turned else edges
    # ways out of every node: none of a sink, one of a pointer
    ways = now.select("scope", F.col("a").alias("node"), F.lit(1).alias("out"), F.col("b").alias("to")).unionByName(now.select("scope", F.col("b").alias("node"), F.lit(0).alias("out"), F.lit(None).alias("to")))
    ways = ways.groupBy("scope", "node").agg(F.sum("out").alias("n"), F.min("to").alias("to")).where("n < 2")
    ways = checkpointed(ways if keep is None else ways.join(keep, ["scope", "node"], "left_anti"))
    single, sinks = ways.where("n = 1").select("scope", "node", "to"), ways.where("n = 0").select("scope", "node")
    there = {r.n for r in ways.select("n").distinct().collect()}  # 0 and 1 at most
    if not there:
        return None
    if there == {0}:  # nothing is led on: what leads nowhere goes
        left = checkpointed(now.join(sinks.select("scope", F.col("node").alias("b")), ["scope", "b"], "left_anti").select("scope", "a", "b"))
        return _turned(left) if turned else left, Fold([], left.select("scope", "a", F.lit(None).cast("string").alias("via"), "b"), turned)
    powers = _pointers(single)
    rest = now.join(single.select("scope", F.col("node").alias("a")), ["scope", "a"], "left_anti")
    led = rest.join(powers[-1].select("scope", F.col("node").alias("b"), "to", "open"), ["scope", "b"], "left").where("open IS NULL OR NOT open")
    entries = led.select("scope", "a", F.when(F.col("to").isNotNull(), F.col("b")).alias("via"), F.coalesce("to", "b").alias("b"))
    entries = checkpointed(entries.join(sinks.select("scope", F.col("node").alias("b")), ["scope", "b"], "left_anti").select("scope", "a", "via", "b").distinct())
    left = entries.select("scope", "a", "b").distinct()
    return _turned(left) if turned else left, Fold(powers, entries, turned)


def reached_pairs(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (scope, a, b) with a path from a to b, of one link or more.

    The graph is folded to the pairs' ends and to what branches and meets between them, in rounds that grow
    with the logarithm of the longest chain; of that the closure is made.
    """
    pairs = checkpointed(pairs.select("scope", "a", "b").distinct())
    if pairs.isEmpty():
        return pairs
    keep = checkpointed(_ends(pairs, "a").unionByName(_ends(pairs, "b")).distinct())
    now, idle = checkpointed(edges.select("scope", "a", "b").distinct()), 0
    turned = False
    while idle < 2:
        folded = _fold(now, turned, keep)
        idle = idle + 1 if folded is None else 0
        if folded is not None:
            # a way from a node to itself matters at the pairs' ends alone
            now = folded[0].where("a <> b").unionByName(folded[0].where("a = b").join(keep.withColumnRenamed("node", "a"), ["scope", "a"], "left_semi").select("scope", "a", "b"))
            now = checkpointed(now)
        turned = not turned
    return pairs.join(closure(now), ["scope", "a", "b"], "left_semi")


def cyclic_nodes(edges: DataFrame) -> DataFrame:
    """(scope, node) of all nodes on a cycle; a self-link is one.

    After folding, a cycle is one of pointers alone, a link from a node to itself, or in what is left; that is
    coloured, and what the colours leave is folded again. Nodes that were folded are on a cycle
    if a link by them joins two nodes of one class: they take its class, from the last folding to the first.
    """
    now = checkpointed(edges.select("scope", "a", "b").distinct())
    found = [now.where("a = b").select("scope", F.col("a").alias("node"))]
    classes: list[DataFrame] = []  # (scope, node, class) of nodes on cycles of what was left by all foldings
    folds: list[Fold] = []
    now, turned, idle = now.where("a <> b"), False, 0
    while not now.isEmpty():
        folded = _fold(now, turned, None)
        if folded is not None:
            left, fold = folded
            folds.append(fold)
            found.append(left.where("a = b").select("scope", F.col("a").alias("node")))
            now, idle = left.where("a <> b"), 0
        elif idle:
            now, some = _coloured(now)
            classes.append(some)
            idle = 0
        else:
            idle = 1
        turned = not turned
    # classes tell only folded nodes apart: without a link into them there is none to tell
    same = _unioned([c.select("scope", "node", "class") for c in classes])
    for at, fold in reversed(list(enumerate(folds))):
        if not fold.powers:
            continue
        known = fold.entries.where("via IS NOT NULL")
        if same is not None:
            ends = known.join(same.select("scope", F.col("node").alias("a"), F.col("class").alias("ca")), ["scope", "a"], "left").join(same.select("scope", F.col("node").alias("b"), F.col("class").alias("cb")), ["scope", "b"], "left")
        else:
            ends = known.withColumns({"ca": F.lit(None).cast("string"), "cb": F.lit(None).cast("string")})
        marked = checkpointed(ends.where("a = b OR ca = cb").select("scope", "a", F.col("via").alias("node"), F.coalesce("ca", F.col("a").cast("string")).alias("class")))
        parts = [marked.select("scope", "node", "class"), marked.select("scope", F.col("a").alias("node"), "class")]
        if not marked.isEmpty():
            parts[0] = _along(parts[0].distinct(), fold.powers)
        circling = fold.circling
        found += [*parts, circling]
        if at:  # links of an earlier folding may lead by these
            parts.append(_named(circling, fold.powers))
            same = checkpointed(_unioned([*([same] if same is not None else []), *parts]).distinct())
    return checkpointed(_unioned([f.select("scope", "node") for f in [*found, *classes]]).distinct())


def _unioned(parts: list[DataFrame]) -> DataFrame | None:
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p)
    return out


def _along(marked: DataFrame, powers: list[DataFrame]) -> DataFrame:
    """Marked nodes (scope, node, class) with all that pointers lead to from them."""
    for power in powers:
        step = power.select("scope", "node", "to")
        for _ in range(3):
            ahead = marked.join(step, ["scope", "node"]).select("scope", F.col("to").alias("node"), "class")
            marked = marked.unionByName(ahead).distinct()
        marked = checkpointed(marked)
    return marked


def _named(circling: DataFrame, powers: list[DataFrame]) -> DataFrame:
    """(scope, node, class) of nodes on cycles of pointers: the class is the cycle's least node."""
    least = circling.withColumn("class", F.col("node").cast("string"))
    for power in powers:
        step = power.select("scope", "node", "to")
        for _ in range(3):
            ahead = least.join(step, ["scope", "node"]).join(least.select("scope", F.col("node").alias("to"), F.col("class").alias("further")), ["scope", "to"])
            least = ahead.select("scope", "node", F.least("class", "further").alias("class"))
        least = checkpointed(least)
    return least


def _coloured(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links left, (scope, node, class) of nodes on cycles that were found).

    Each node takes the greatest node that reaches it as its colour. Those of a colour that reach
    its own node by links of that colour are one class. The least colour of every part is settled, so each time some
    are; links between colours are on no cycle.
    """
    nodes = _ends(edges, "a").unionByName(_ends(edges, "b")).distinct()
    colour = checkpointed(nodes.withColumn("class", F.col("node")))
    while True:
        met = edges.join(colour.withColumnRenamed("node", "a"), ["scope", "a"]).select("scope", F.col("b").alias("node"), "class")
        nxt = checkpointed(colour.unionByName(met).groupBy("scope", "node").agg(F.max("class").alias("class")))
        if nxt.join(colour, ["scope", "node", "class"], "left_anti").isEmpty():
            break
        colour = nxt
    of_a, of_b = colour.select("scope", F.col("node").alias("a"), F.col("class").alias("ca")), colour.select("scope", F.col("node").alias("b"), F.col("class").alias("cb"))
    within = checkpointed(edges.join(of_a, ["scope", "a"]).join(of_b, ["scope", "b"]).where("ca = cb").select("scope", "a", "b", F.col("ca").alias("class")))
    front = back = checkpointed(colour.where("node = class"))
    while not front.isEmpty():
        step = within.join(front.select("scope", F.col("node").alias("b"), "class"), ["scope", "b", "class"]).select("scope", F.col("a").alias("node"), "class").distinct()
        front = checkpointed(step.join(back, ["scope", "node", "class"], "left_anti"))
        back = back.unionByName(front)
    gone = checkpointed(back.select("scope", "node", "class"))
    several = gone.groupBy("scope", "class").agg(F.count("*").alias("n")).where("n > 1").select("scope", "class")
    some = gone.join(several, ["scope", "class"], "left_semi").select("scope", "node", F.col("class").cast("string").alias("class"))
    out = gone.select("scope", "node")
    left = within.join(out.withColumnRenamed("node", "a"), ["scope", "a"], "left_anti").join(out.withColumnRenamed("node", "b"), ["scope", "b"], "left_anti").select("scope", "a", "b")
    return checkpointed(left), checkpointed(some)
