"""Stable names of blank nodes, by refinement of colours.

A blank node's first colour is what its statements say, a neighbour that is blank standing there as one. In a
round each gets a new one: the hash of its old colour, and of the colours of its neighbours and of the nodes
that lie ahead and behind. Ahead is where the one statement leads that names another blank node, if there is one
alone, behind where the one comes from; these pointers double with each round, so that a chain or list is
told apart from its ends in a logarithm of rounds. What a node is told enters as two sums of
hashes, so a node with very many statements is aggregated in parts.

Colours are two longs, and a round deals them once: what is not blank is in the first colour and is not looked at again,
and pointers are rows of their own, which only scopes have where some node lies between two others.

Each scope has as many rounds as it needs, whatever others hold: it is done when a round tells no more of its nodes
apart, which then no further round would, as the round looked at all neighbours. There is no limit.
Nodes that no such refinement tells apart share a name; findings about them are told apart by their occurrence
number.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphwarden.functions.terms import BNODE
from graphwarden.operators.closure import checkpointed

PREFIX = "_:c"


def colours(statements: DataFrame) -> DataFrame:
    """(scope, node, colour) of the blank nodes in statements (scope, s, s_blank, p, o, o_blank)."""
    side = F.explode(
        F.array(
            F.struct(F.lit("of").alias("role"), F.col("s").alias("node"), F.col("s_blank").alias("blank"), F.col("o").alias("other"), F.col("o_blank").alias("other_blank")),
            F.struct(F.lit("in").alias("role"), F.col("o").alias("node"), F.col("o_blank").alias("blank"), F.col("s").alias("other"), F.col("s_blank").alias("other_blank")),
        )
    )
    ends = checkpointed(statements.select("scope", "p", side.alias("x")).where("x.blank").select("scope", "p", "x.node", "x.role", "x.other", "x.other_blank"))
    said = F.concat_ws("\x1f", "role", "p", F.when(F.col("other_blank"), "_").otherwise(F.col("other")))
    first = ends.groupBy("scope", "node").agg(_total(1, said).alias("a"), _total(2, said).alias("b"), *[F.count_if(F.col("other_blank") & (F.col("role") == r)).alias(r) for r in ("of", "in")])
    now = checkpointed(first.select("scope", "node", *_coloured("a", "b"), "of", "in"))
    before = checkpointed(_kinds(now).where("kinds > 1"))
    pointers = _pointers(ends, now)
    looks = ends.where("other_blank").select("scope", F.col("node").alias("looking"), F.concat_ws("\x1f", "role", "p").alias("how"), F.col("other").alias("node"))
    now = now.select("scope", "node", "c1", "c2")
    done = [now.join(before, "scope", "left_anti")]
    while not before.isEmpty():
        now = now.join(before, "scope", "left_semi")
        pointers = _doubled(pointers, before)
        nxt = checkpointed(_refined(now, looks.join(before, "scope", "left_semi"), pointers))
        more = checkpointed(_kinds(nxt).join(before.withColumnRenamed("kinds", "had"), "scope").where("kinds > had").select("scope", "kinds"))
        done.append(nxt.join(more, "scope", "left_anti"))
        now, before = nxt, more
    spelled = F.concat(*[F.lpad(F.lower(F.hex(c)), 16, "0") for c in ("c1", "c2")])
    return reduce(DataFrame.unionByName, done).select("scope", "node", spelled.alias("colour"))


def _total(seed: int, said: Column) -> Column:
    return F.sum(F.xxhash64(F.lit(seed), said).cast("decimal(20,0)"))


def _coloured(*of: Column | str) -> list[Column]:
    return [F.xxhash64(F.lit(seed), *of).alias(c) for seed, c in ((1, "c1"), (2, "c2"))]


def _kinds(now: DataFrame) -> DataFrame:
    """(scope, kinds): how many colours a scope has."""
    return now.select("scope", "c1", "c2").distinct().groupBy("scope").agg(F.count("*").alias("kinds"))


def _pointers(ends: DataFrame, now: DataFrame) -> DataFrame | None:
    """(scope, way, node, far) of pointers to the next node, in scopes where one may lead on; None without such."""
    between = now.where("of > 0 AND in > 0 AND (of = 1 OR in = 1)").select("scope").distinct()
    if between.isEmpty():
        return None
    alone = now.join(between, "scope", "left_semi").select("scope", "node", F.explode(F.filter(F.array(*[F.when(F.col(r) == 1, r) for r in ("of", "in")]), lambda r: r.isNotNull())).alias("way"))
    return checkpointed(ends.where("other_blank").select("scope", F.col("role").alias("way"), "node", F.col("other").alias("far")).join(alone, ["scope", "way", "node"]))


def _doubled(pointers: DataFrame | None, scopes: DataFrame) -> DataFrame | None:
    """Pointers to what lies as far again, in scopes; None where no pointer leads on."""
    if pointers is None:
        return None
    pointers = pointers.join(scopes, "scope", "left_semi")
    near = pointers.select("scope", "way", F.col("node").alias("start"), F.col("far").alias("node"))
    out = checkpointed(near.join(pointers, ["scope", "way", "node"]).select("scope", "way", F.col("start").alias("node"), "far"))
    return None if out.isEmpty() else out


def _refined(now: DataFrame, looks: DataFrame, pointers: DataFrame | None) -> DataFrame:
    """The next round: (scope, node, c1, c2). now is dealt by its nodes once, for both joins: its columns keep their names, and neither join adds a filter."""
    now = now.where("scope IS NOT NULL AND node IS NOT NULL")
    if pointers is not None:
        looks = looks.unionByName(pointers.select("scope", F.col("node").alias("looking"), F.col("way").alias("how"), F.col("far").alias("node")))
    told = looks.join(now, ["scope", "node"])

    def total(seed: int) -> Column:
        return F.sum(F.xxhash64(F.lit(seed), "how", "c1", "c2").cast("decimal(20,0)"))

    sums = told.groupBy("scope", F.col("looking").alias("node")).agg(total(1).alias("a"), total(2).alias("b"))
    # where a sum is null a node has no blank neighbour
    return now.join(sums, ["scope", "node"], "left").select("scope", "node", *_coloured("c1", "c2", F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0))))


def stable(findings: DataFrame, t: DataFrame) -> DataFrame:
    """findings with stable names in focus and value; scopes whose findings have no blank node are not looked at."""
    used = findings.where(F.col("focus").startswith("_:") | F.col("value").startswith("_:")).select(F.col("source_module").alias("scope")).distinct()
    if used.isEmpty():
        return findings
    touching = t.where((F.col("s_kind") == BNODE) | (F.col("o_kind") == BNODE)).join(used, "scope", "left_semi")
    known = colours(touching.select("scope", F.col("s_nt").alias("s"), (F.col("s_kind") == BNODE).alias("s_blank"), "p", F.col("o_nt").alias("o"), (F.col("o_kind") == BNODE).alias("o_blank")))
    out = findings
    for column in ("focus", "value"):
        named = known.select(F.col("scope").alias("source_module"), F.col("node").alias(column), F.concat(F.lit(PREFIX), "colour").alias("__name"))
        out = out.join(named, ["source_module", column], "left").withColumn(column, F.coalesce("__name", column)).drop("__name")
    return out.select(*findings.columns)
