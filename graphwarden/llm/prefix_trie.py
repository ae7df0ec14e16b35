"""Prefix trie of conversations: which beginnings conversations share, and what storing them once saves.

A conversation is the sequence of its turns, and a node of the trie is a distinct beginning. The job:

1. Rebuild: conversations of one family are streamed in order through one fold, which names each
   beginning by a 128-bit digest of the one before it and the turn. Texts go no further than their digests.
2. Nodes: beginnings are counted by partial aggregation, so one that all conversations share is no burden.
   Below a beginning that only one conversation has there is nothing to roll up: those rows are closed form.
3. Shards: what is shared, with the first unshared node of each conversation, is dealt out by beginnings.
   A beginning with more nodes than a shard may have is opened at the depth where it first branches, as often
   as needed; the nodes above the cuts are the upper levels.
4. Tries: numpy builds a level-order trie of each task's shards (a LOUDS bit vector and label arrays) and
   rolls subtrees up level by level from the bottom by add.at.
5. The upper levels take their shards' totals, summed by key first, and are rolled up as one more such trie.
   There are no more of them than shards times the depth of the cuts, whatever the number of conversations.

Turns come in order of `turn`, null first, ties by the digest of role and text (whose equal rows are
interchangeable). Null role and text are empty; rows without a conv_id belong to no conversation and are left
out; repeated rows are turns of their own. An empty table gives no node. Columns other than the four are
left out, whatever their names. A family's turns are folded by one task, in order and in constant memory.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphwarden.llm.components import written

#: The fixed rebuilding rule: conversations of a family have one donor, and take so many turns of it.
FAMILY, MOST_TAKEN = 5, 8
#: Shards that a partition of the trie's nodes has at least on average, so that sizes even out; nodes that are a shard at any rate.
SHARDS, LEAST_NODES = 8, 64
#: Ids joined into one piece of text before pieces of a node meet.
PIECE_IDS = 4096
#: Nodes that one numpy trie holds before a further shard begins a new one.
TRIE_NODES = 1 << 18

KEY, PARENT = ["k1", "k2"], ["p1", "p2"]
FOLDED = T.StructType([T.StructField(c, T.LongType(), False) for c in ("conv_id", "depth", "k1", "k2", "p1", "p2", "bytes", "last")])


def taken(conv_id: int) -> int:
    return zlib.crc32(str(conv_id).encode()) % (MOST_TAKEN + 1)


def donor(conv_id: int) -> int:
    """conv_id less its remainder, which has the sign of conv_id."""
    return conv_id - (abs(conv_id) % FAMILY) * (1 if conv_id >= 0 else -1)


def turns(conversations: DataFrame) -> DataFrame:
    """(family, conv_id, turn, digest, bytes): 128 bits of SHA-256 stand for a turn's role and text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    told = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    rows = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.unhex(F.substring(F.sha2(told, 256), 1, 32)).alias("digest"), F.octet_length(text).cast("bigint").alias("bytes")).where("conv_id IS NOT NULL")
    return rows.withColumn("family", F.col("conv_id") - F.col("conv_id") % FAMILY)


def rebuilt(conversations: DataFrame) -> DataFrame:
    """One row for each rebuilt conversation and depth, from 0: the key of the beginning and of the one before, the bytes of its last turn, and last = 1 at the whole conversation."""
    rows = turns(conversations)
    dealt = rows.repartition("family").sortWithinPartitions("family", F.col("conv_id") != F.col("family"), "conv_id", F.col("turn").asc_nulls_first(), "digest")

    def run(batches):
        unpack = struct.Struct("<qq").unpack
        family = conv = None
        lent: list[tuple[bytes, int]] = []  # the donor's first turns
        out: list[tuple] = []
        key, depth, skip, held = b"", 0, 0, None

        def step(digest: bytes, size: int) -> None:
            nonlocal key, depth, held
            before = unpack(key)
            key = hashlib.blake2b(key + digest, digest_size=16).digest()
            depth += 1
            out.append(held)
            held = (conv, depth, *unpack(key), *before, size)

        def flush():
            cols = list(zip(*[(*r, 0) if len(r) == 7 else r for r in out], strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=FOLDED.names)

        for batch in batches:
            for fam, c, digest, size in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if c != conv:
                    if held is not None:
                        out.append((*held, 1))
                    if fam != family:
                        family, lent = fam, []
                    conv, key, depth, skip, held = c, bytes(16), 0, taken(c), (c, 0, 0, 0, 0, 0, 0)
                    if c != family:
                        for d, s in lent[:skip]:
                            step(d, s)
                    else:
                        skip = 0
                if c == family and len(lent) < MOST_TAKEN:
                    lent.append((digest, size))
                if skip:
                    skip -= 1
                else:
                    step(digest, size)
            if len(out) > 1 << 15:
                yield flush()
        if held is not None:
            out.append((*held, 1))
        if out:
            yield flush()

    return dealt.select("family", "conv_id", "digest", "bytes").mapInArrow(run, FOLDED)


def louds(level: np.ndarray, key: np.ndarray, above: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, bits, first place of each level) of a forest: rows in level order under one super-root, siblings together, and the bit vector.

    key and above number a row's key and its parent's alike; level is 0 for the roots. A node is written as
    a 1 for each child and a closing 0, in level order, the super-root first: it has place 0.
    """
    at = np.zeros(int(max(key.max(initial=0), above.max(initial=0))) + 1, np.int64)
    degree = np.zeros(len(key) + 1, np.int64)
    by_level = np.argsort(level, kind="stable")
    bounds = np.searchsorted(level[by_level], np.arange(int(level.max(initial=-1)) + 2))
    order, place = [], 1
    for k, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        rows = by_level[lo:hi]
        up = at[above[rows]] if k else np.zeros(len(rows), np.int64)
        rows = rows[np.argsort(up, kind="stable")]
        np.add.at(degree, up, 1)
        at[key[rows]] = place + np.arange(len(rows))
        place += len(rows)
        order.append(rows)
    bits = np.ones(int(degree.sum()) + len(degree), np.uint8)
    bits[np.cumsum(degree + 1) - 1] = 0
    return np.concatenate([np.zeros(0, np.int64), *order]), bits, bounds + 1


def parents(bits: np.ndarray) -> np.ndarray:
    """Place of the parent of each node but the super-root, by rank and select: the i-th 1 is node i, and the 0s before it close the nodes before its parent."""
    ones = np.flatnonzero(bits)
    return ones - np.arange(len(ones))


#: What a trie is built of: leaves, saved and children that a node has beside those of its rows' children.
NODE = ["k1", "k2", "p1", "p2", "level", "conv_id", "saved", "leaves", "children"]
ROLLED = T.StructType([T.StructField(c, T.LongType(), c == "parent_conv_id") for c in ("k1", "k2", "p1", "p2", "level", "parent_conv_id", "children", "leaves", "saved")])


def roll_up(cols: dict[str, np.ndarray]) -> pa.RecordBatch:
    """The nodes of whole shards with their children, leaves and savings of their subtrees, and their parents' conv_id (null for roots)."""
    pair = np.dtype([("a", np.int64), ("b", np.int64)])
    both = np.empty((2, len(cols["k1"])), pair)
    both["a"], both["b"] = (cols["k1"], cols["p1"]), (cols["k2"], cols["p2"])
    number = np.unique(both, return_inverse=True)[1].reshape(both.shape)
    order, bits, begins = louds(cols["level"], number[0], number[1])
    up = parents(bits)
    label = {c: np.concatenate([[0], v[order]]) for c, v in cols.items()}
    children, leaves, saved = label["children"], label["leaves"], label["saved"]
    np.add.at(children, up, 1)
    leaves[(children == 0)] = 1
    for lo, hi in zip(begins[-2::-1], begins[:0:-1], strict=True):
        np.add.at(leaves, up[lo - 1 : hi - 1], leaves[lo:hi])
        np.add.at(saved, up[lo - 1 : hi - 1], saved[lo:hi])
    above = pa.array(label["conv_id"][up], mask=up == 0)
    return pa.RecordBatch.from_arrays([*(pa.array(label[c][1:]) for c in NODE[:5]), above, *(pa.array(x[1:]) for x in (children, leaves, saved))], names=ROLLED.names)


def tries(nodes: DataFrame) -> DataFrame:
    """roll_up() of the shards of each task; nodes: NODE with s1, s2, those of a shard next to each other."""

    def run(batches):
        held: list[dict[str, np.ndarray]] = []
        size = 0
        for batch in batches:
            cols = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in (*NODE, "s1", "s2")}
            if not batch.num_rows:
                continue
            # shards that end within the batch may go; the last one may continue
            cut = int(np.flatnonzero((cols["s1"] == cols["s1"][-1]) & (cols["s2"] == cols["s2"][-1]))[0])
            apart = not held or (held[-1]["s1"][-1], held[-1]["s2"][-1]) != (cols["s1"][0], cols["s2"][0])
            if size + cut >= TRIE_NODES and (cut or (held and apart)):
                held.append({c: v[:cut] for c, v in cols.items()})
                yield roll_up({c: np.concatenate([x[c] for x in held]) for c in NODE})
                held, size = [], 0
                cols = {c: v[cut:] for c, v in cols.items()}
            held.append(cols)
            size += len(cols["s1"])
        if held:
            yield roll_up({c: np.concatenate([x[c] for x in held]) for c in NODE})

    return nodes.select(*NODE, "s1", "s2").mapInArrow(run, ROLLED)


def shards(nodes: DataFrame, folded: DataFrame, limit: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """(shards, nodes above all shards): rows of nodes with s1, s2, the beginning that names the shard, and level, the depth below it."""

    def named(rows: DataFrame, depth) -> DataFrame:
        # a node's least member passes through every beginning above it
        ways = folded.select(F.col("conv_id"), F.col("depth").alias("cut"), F.col("k1").alias("s1"), F.col("k2").alias("s2"))
        return rows.withColumn("cut", depth).join(ways, ["conv_id", "cut"])

    closed, upper = [], []
    open_ = written(named(nodes, F.lit(1).cast("bigint")))
    while True:
        heavy = open_.groupBy("s1", "s2").count().where(F.col("count") > limit).drop("count")
        branch = open_.join(heavy, ["s1", "s2"], "left_semi").groupBy("s1", "s2", "depth").count().groupBy("s1", "s2").agg(F.min(F.when(F.col("count") > 1, F.col("depth"))).alias("at")).where("at IS NOT NULL")
        branch = written(branch)
        if branch.isEmpty():
            closed.append(open_)
            break
        closed.append(open_.join(branch, ["s1", "s2"], "left_anti"))
        inside = open_.join(branch, ["s1", "s2"]).drop("s1", "s2", "cut")
        upper.append(inside.where("depth < at").drop("at"))
        open_ = written(named(inside.where("depth >= at"), F.col("at")).drop("at"))
    return closed, upper


def ends(folded: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256): ids of the conversations that are a beginning as a whole, ascending and joined by commas, hashed.

    Ids are sorted over all tasks and joined in pieces there, so the task of a beginning that very many
    conversations are meets pieces only, and streams them.
    """
    rows = folded.where("last = 1").select(*KEY, "conv_id").repartitionByRange(*KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id")

    def join(batches):
        for batch in batches:
            k1, k2, ids = (batch.column(c).to_numpy() for c in range(3))
            new = np.ones(len(ids), bool)
            new[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
            first = np.flatnonzero(new)
            run = np.arange(len(ids)) - np.repeat(first, np.diff([*first, len(ids)]))
            cuts = np.flatnonzero(run % PIECE_IDS == 0)
            texts = [",".join(map(str, ids[a:b].tolist())) for a, b in zip(cuts, [*cuts[1:], len(ids)], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(k1[cuts]), pa.array(k2[cuts]), pa.array(ids[cuts]), pa.array(texts, pa.string())], names=["k1", "k2", "first", "ids"])

    def hash_(batches):
        last, digest = None, None
        for batch in batches:
            out = []
            for k1, k2, ids in zip(*(batch.column(c).to_pylist() for c in (0, 1, 3)), strict=True):
                if (k1, k2) != last:
                    if last is not None:
                        out.append((*last, digest.hexdigest()))
                    last, digest = (k1, k2), hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield _hashed(out)
        if last is not None:
            yield _hashed([(*last, digest.hexdigest())])

    def _hashed(out):
        cols = list(zip(*out, strict=True)) or [[]] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.string()), strict=True)], names=["k1", "k2", "ends_sha256"])

    pieces = rows.mapInArrow(join, "k1 long, k2 long, first long, ids string")
    return pieces.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(hash_, "k1 long, k2 long, ends_sha256 string")


def trie(conversations: DataFrame, least_nodes: int = LEAST_NODES) -> DataFrame:
    """One row for each distinct beginning of the rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = conversations.sparkSession
    folded = written(rebuilt(conversations))
    counted = folded.groupBy(*KEY, *PARENT, "depth", "bytes").agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.sum("last").alias("n_ends"))
    nodes = written(counted)
    shared = nodes.where("n_convs > 1 AND depth > 0").select(*KEY, *PARENT, "depth", "conv_id", ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"), F.lit(0).cast("bigint").alias("leaves"), F.lit(0).cast("bigint").alias("children"))
    # of nodes that one conversation has, its first: what follows is its only child, or nothing
    single = nodes.where("n_convs = 1 AND depth > 0").groupBy("conv_id").agg(*[F.min_by(c, "depth").alias(c) for c in (*KEY, *PARENT, "n_ends")], F.min("depth").alias("first"))
    first = single.select(*KEY, *PARENT, F.col("first").alias("depth"), "conv_id", F.lit(0).cast("bigint").alias("saved"), F.lit(1).cast("bigint").alias("leaves"), (1 - F.col("n_ends")).alias("children"))
    rolled_in = written(shared.unionByName(first))
    limit = max(least_nodes, rolled_in.count() // (SHARDS * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    closed, upper = shards(rolled_in, folded, limit)
    dealt = reduce(DataFrame.unionByName, closed).withColumn("level", F.col("depth") - F.col("cut"))
    low = written(tries(dealt.repartition("s1", "s2").sortWithinPartitions("s1", "s2")))
    root = nodes.where("depth = 0").select(*KEY, *PARENT, "depth", "conv_id", *[F.lit(0).cast("bigint").alias(c) for c in ("saved", "leaves", "children")])
    tops = low.where("level = 0")
    under = tops.groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.sum("saved").alias("saved_under"), F.sum("leaves").alias("leaves_under"), F.count("*").alias("children_under"))
    above = written(reduce(DataFrame.unionByName, [u.select(*root.columns) for u in upper], root))
    added = [(F.col(c) + F.coalesce(F.col(f"{c}_under"), F.lit(0))).alias(c) for c in ("saved", "leaves", "children")]
    # one trie: the nodes above all cuts
    joined = above.join(under, KEY, "left").select(*KEY, *PARENT, F.col("depth").alias("level"), "conv_id", *added, F.lit(0).cast("bigint").alias("s1"), F.lit(0).cast("bigint").alias("s2"))
    high = tries(joined.coalesce(1))
    kept = [*KEY, "parent_conv_id", "children", "leaves", "saved"]
    hung = tops.drop("parent_conv_id").join(above.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id")), PARENT).select(*kept)
    rolled = low.where("level > 0").select(*kept).unionByName(hung).unionByName(high.select(*kept).withColumn("rolled", F.lit(True)), allowMissingColumns=True).withColumn("rolled", F.lit(True))
    every = nodes.join(rolled, KEY, "left").join(ends(folded), KEY, "left")
    alone = F.col("rolled").isNull()
    return every.select(
        "conv_id",
        "depth",
        F.when(alone, F.col("conv_id")).otherwise(F.col("parent_conv_id")).alias("parent_conv_id"),
        "n_convs",
        F.when(alone, 1 - F.col("n_ends")).otherwise(F.col("children")).alias("n_children"),
        F.when(alone, F.lit(1).cast("bigint")).otherwise(F.col("leaves")).alias("n_leaves"),
        F.when(alone, F.lit(0).cast("bigint")).otherwise(F.col("saved")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


#: The same in SQL, by lists of turns; ties of turn by the digest.
ORACLE = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x, sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS g FROM conversations WHERE conv_id IS NOT NULL
), o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, g) AS pos FROM t
), h(crc) AS (SELECT list(c) FROM (WITH RECURSIVE k AS (SELECT i AS i, i AS c, 0 AS s FROM range(256) q(i) UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, s + 1 FROM k WHERE s < 8) SELECT c FROM k WHERE s = 8 ORDER BY i)
), f AS (SELECT DISTINCT conv_id AS c FROM t
), m AS (SELECT c, xor(list_reduce(list_concat([4294967295::BIGINT], [ord(ch)::BIGINT FOR ch IN string_split(c::VARCHAR, '')]), lambda s, b: xor(s // 256, crc[xor(s % 256, b) + 1])), 4294967295) % 9 AS h FROM f, h
), b AS (
  SELECT m.c, d.pos, d.r, d.x, d.g FROM m JOIN o d ON d.conv_id = m.c - m.c % 5 AND d.pos <= m.h
  UNION ALL SELECT m.c, w.pos, w.r, w.x, w.g FROM m JOIN o w ON w.conv_id = m.c AND w.pos > m.h
), s AS (SELECT c, list(g ORDER BY pos) AS gs, list(strlen(x)::BIGINT ORDER BY pos) AS ns FROM b GROUP BY c
), w AS (SELECT m.c, coalesce(gs, []) AS gs, coalesce(ns, []) AS ns FROM m LEFT JOIN s USING (c)
), p AS (SELECT c, d, len(gs) = d AS last, sha256(array_to_string(gs[1:d], ',')) AS k, CASE WHEN d > 0 THEN sha256(array_to_string(gs[1:d - 1], ',')) END AS pk, CASE WHEN d > 0 THEN ns[d] ELSE 0 END AS n FROM (SELECT *, unnest(range(0, len(gs) + 1)) AS d FROM w)
), n AS (SELECT k, d, any_value(pk) AS pk, any_value(n) AS n, count(*) AS n_convs, min(c) AS conv_id, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE last), '')) AS ends_sha256 FROM p GROUP BY k, d
), kids AS (SELECT pk AS k, count(*) AS n FROM n WHERE pk IS NOT NULL GROUP BY 1
), up AS (SELECT DISTINCT a.k AS top, z.k AS below FROM p a JOIN p z ON a.c = z.c AND z.d >= a.d
), roll AS (SELECT top AS k, sum((n.n_convs - 1) * n.n)::BIGINT AS saved_tokens, count(*) FILTER (WHERE kids.n IS NULL) AS n_leaves FROM up JOIN n ON n.k = below LEFT JOIN kids ON kids.k = below GROUP BY 1)
SELECT n.conv_id, n.d AS depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(kids.n, 0)::BIGINT AS n_children, roll.n_leaves, roll.saved_tokens, n.ends_sha256
FROM n JOIN roll USING (k) LEFT JOIN kids USING (k) LEFT JOIN n u ON u.k = n.pk"""
