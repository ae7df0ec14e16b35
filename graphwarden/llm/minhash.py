"""Near-duplicates: MinHash bands, sequential Bayesian verification, exact sets.

1. Documents with the same sequence of lower-case words are one class; its least doc_id stands for
   it (an aggregation with map-side combine, so a third of all rows in one class is no skew).
2. Representatives get `BANDS` band keys from `BANDS * ROWS` minima. Only (key, id) rows are
   shuffled; a key that one representative has is dropped, and of keys with the very same members
   one is kept (their member sets are compared by count and hashes).
3. Signatures (16 bits of each minimum) of the members left go to their keys. Batches of minima are
   compared one after another, and a pair is pruned as soon as the posterior chance that its
   similarity reaches the threshold falls below `MISS`. Of the pairs that survive, a task gives a
   spanning forest. A key with more than `BLOCK` members is dealt in blocks, each beside one
   member of the key that all blocks share, so its rows are as many as its members.
4. The pairs of the forests are counted on full sets: each set meets the few others of its forest
   pairs, dealt by one end in blocks. Confirmed pairs are links.
5. Where a forest pair failed, or blocks of a key did not come together, more of the key's pairs may
   link. Such keys are verified once more on full sets, by pairs whose ends are in different
   components by then: in one task, or, above BLOCK members, in pairs of blocks; members in the key's largest
   component do not meet each other.
6. Components of the links give classes, and members take the class of their representative.

Rows: documents without text or words have no shingles and link with nothing; with fewer words than
a shingle the whole sequence is the one shingle. A doc_id that repeats is one document by its least
text of each class: its rows are joined by doc_id where they share it. A null doc_id is a class of
its own kind: it gets component null and stays. Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphwarden.llm.components import components, written
from graphwarden.llm.textbatch import buffers, id_text, mix, shingle_sets, slices

#: Bands and minima of each: a pair of similarity 0.85 shares none with chance 2.5e-6.
BANDS, ROWS = 22, 5
#: The setting for the lower threshold 0.8: chance 3e-6.
WIDE_BANDS, WIDE_ROWS = 24, 4
#: Chance at which a pair that reaches the threshold may be pruned by its signature, in each look.
MISS = 1e-7
#: Minima that are compared at once.
STEP = 15
#: Bits of the filter that picks the texts to read again, for each id, and the most of all, as a power of two (32 MB); for more ids than that allows a join picks them.
BITS_PER_ID, MOST_BITS = 16, 28
#: Members of a key that one task takes; two blocks meet in a task where there are more.
BLOCK = 2048

_rng = np.random.default_rng(77)
_MULTIPLY = _rng.integers(1, 1 << 62, 512, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_FLIP = _rng.integers(1, 1 << 62, 512, dtype=np.int64).astype(np.uint64)

CLASSES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_shingles", T.LongType(), False), T.StructField("k1", T.LongType(), False), T.StructField("k2", T.LongType(), False), T.StructField("keys", T.ArrayType(T.LongType(), False), False), T.StructField("signature", T.BinaryType(), False)])
SETS = T.StructType([T.StructField("rep", T.LongType()), T.StructField("shingles", T.BinaryType(), False)])


def minima(hashes: np.ndarray, counts: np.ndarray, n: int, first: int = 0) -> np.ndarray:
    """n minima of each non-empty set, by the hash functions from number `first` on."""
    starts = np.cumsum(counts) - counts
    full = counts > 0
    out = np.zeros((len(counts), n), np.uint64)
    for k in range(n):
        out[full, k] = np.minimum.reduceat((hashes ^ _FLIP[first + k]) * _MULTIPLY[first + k], starts[full]) if full.any() else 0
    return out


def _classes(size: int, bands: int, rows: int):
    """Class and band keys of each text."""

    def run(batches):
        for batch in batches:
            data, offsets, _ = buffers(batch.column(1))
            for i, j in slices(offsets):
                hashes, counts, n_words, whole = shingle_sets(data, offsets[i : j + 1], size)
                # a class is the sequence of words: its hash, and beside it its number of words and shingles
                k2 = (n_words << 32) ^ counts
                low = minima(hashes, counts, bands * rows).reshape(-1, bands, rows)
                key = np.zeros(low.shape[:2], np.uint64) + np.arange(bands, dtype=np.uint64)
                for r in range(rows):
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) + low[:, :, r])
                n_keys = np.concatenate([[0], np.cumsum(np.where(counts > 0, bands, 0))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(n_keys), pa.array(key[counts > 0].view(np.int64).ravel()))
                marks = low.reshape(len(counts), -1).astype(np.uint16)
                signatures = pa.array([marks[r].tobytes() if counts[r] else b"" for r in range(len(counts))], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(counts), pa.array(whole.view(np.int64)), pa.array(k2), lists, signatures], names=CLASSES.names)

    return run


def _sets(size: int):
    def run(batches):
        for batch in batches:
            data, offsets, _ = buffers(batch.column(1))
            for i, j in slices(offsets):
                hashes, counts, _, _ = shingle_sets(data, offsets[i : j + 1], size)
                ends, raw = np.cumsum(counts), hashes.tobytes()
                sets = [raw[8 * (e - c) : 8 * e] for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(sets, pa.binary())], names=SETS.names)

    return run


def least_matches(threshold: float, steps: list[int], miss: float = MISS) -> list[int]:
    """For each number of compared minima, the fewest matches at which a pair is not pruned.

    With a uniform prior the posterior of the similarity after m of n matches is Beta(m + 1, n - m + 1);
    its tail beyond the threshold is the chance of m matches or fewer among n + 1 at the threshold.
    """
    out = []
    for n in steps:
        tail, m = 0.0, 0
        while m <= n:
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= miss:
                break
            m += 1
        out.append(m)
    return out


class Verifier:
    """Pairs among the members of one key; all of them share the minima of the key's band, so the other ones are compared."""

    def __init__(self, numerator: int, minima_: int, denominator: int = 100):
        self.num, self.den = numerator, denominator
        self.steps = [*range(STEP, minima_, STEP), minima_]
        self.least = least_matches(numerator / denominator, self.steps)

    def links(self, reps: np.ndarray, size: np.ndarray, signatures: np.ndarray, sets: list[np.ndarray] | None = None, label: np.ndarray | None = None, side: np.ndarray | None = None) -> list[tuple[int, int]]:
        """A spanning forest of the pairs that survive, and, with sets, that link. With labels, pairs of one label are left out; with sides, pairs of one side."""
        order = np.lexsort((reps, size))
        reps, size, sig = reps[order], size[order], signatures[order]
        side = side[order] if side is not None else None
        n = len(reps)
        label = np.unique(reps if label is None else label[order], return_inverse=True)[1]
        found = []
        for i in range(n - 1):
            # |A & B| <= |A|, so 100 |A| >= num |B| must hold for the larger B
            stop = int(np.searchsorted(size, size[i] * self.den // self.num, "right"))
            alive = np.arange(i + 1, stop)
            alive = alive[label[alive] != label[i]]
            if side is not None:
                alive = alive[side[alive] != side[i]]
            same, before = np.zeros(len(alive), np.int64), 0
            for done, least in zip(self.steps, self.least, strict=True):
                if not len(alive):
                    break
                same += (sig[alive, before:done] == sig[i, before:done]).sum(1)
                before = done
                keep = same >= least
                alive, same = alive[keep], same[keep]
            for j in alive[np.argsort(-same, kind="stable")].tolist():
                if label[j] == label[i]:
                    continue
                if sets is None or self.linked(sets[order[i]], sets[order[j]]):
                    found.append((int(reps[i]), int(reps[j])))
                    label[label == label[j]] = label[i]
        return found

    def linked(self, a: np.ndarray, b: np.ndarray) -> bool:
        both = len(np.intersect1d(a, b, assume_unique=True))
        return self.den * both >= self.num * (len(a) + len(b) - both)


LINKS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
PAIRS = T.StructType([T.StructField("key", T.LongType()), *LINKS.fields])
#: Columns of the rows that meet in a task, which is named by the first three.
MEETING = ("key", "ci", "cj", "block", "band", "rep", "n_shingles", "signature", "label")


def _verify(numerator: int, bands: int, rows: int, exact: bool):
    """Rows (MEETING, and shingles if exact) sorted by key, ci, cj: (key, a, b) of each task's forest."""

    def run(batches):
        verifier = Verifier(numerator, (bands - 1) * rows)
        task, held = None, []

        def close():
            if len(held) < 2:
                return []
            block, band, reps, size, marks, label = (list(c) for c in list(zip(*held, strict=True))[:6])
            sig = np.frombuffer(b"".join(marks), np.uint16).reshape(len(held), bands, rows)
            sig = np.delete(sig, band[0], 1).reshape(len(held), -1)
            sets = [np.frombuffer(h[6], np.uint64) for h in held] if exact else None
            side = np.array(block) if task[1] != task[2] else None
            return [(task[0], *p) for p in verifier.links(np.array(reps), np.array(size), sig, sets, np.array(label) if exact else None, side)]

        def out(pairs):
            return pa.RecordBatch.from_arrays([pa.array([p[c] for p in pairs], pa.int64()) for c in range(3)], names=PAIRS.names)

        for batch in batches:
            made = []
            for row in zip(*(batch.column(c).to_pylist() for c in range(batch.num_columns)), strict=True):
                if row[:3] != task:
                    made += close()
                    task, held = row[:3], []
                held.append(row[3:])
            if made:
                yield out(made)
        if task is not None and (made := close()):
            yield out(made)

    return run


def _confirm(numerator: int):
    """Rows (hub, block, is_hub, rep, shingles) sorted so that the hub comes first: the pairs that link."""

    def run(batches):
        verifier = Verifier(numerator, 1)
        task, hub = None, []
        for batch in batches:
            made = []
            for a, block, is_hub, rep, raw in zip(*(batch.column(c).to_pylist() for c in range(4)), batch.column(4), strict=True):
                own = np.frombuffer(raw.as_py(), np.uint64)
                if (a, block) != task:
                    task, hub = (a, block), []
                if is_hub:
                    hub.append(own)
                elif any(verifier.linked(x, own) for x in hub):  # several, where a doc_id repeats
                    made.append((a, rep))
            yield pa.RecordBatch.from_arrays([pa.array([p[c] for p in made], pa.int64()) for c in range(2)], names=LINKS.names)

    return run


def maybe_in(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose doc_id may be among ids (doc_id, distinct): none of those is lost, a few others pass by chance.

    The ids are a bitmap of BITS_PER_ID bits each, in pieces of 4 KB, and it is broadcast: 32 MB at
    most. For more ids the rows are joined with them.
    """
    bits = max(16, (ids.count() * BITS_PER_ID - 1).bit_length())
    if bits > MOST_BITS:
        return rows.join(ids, "doc_id", "left_semi")
    value = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << bits))
    piece, place = F.shiftright(value, 15), value.bitwiseAND(F.lit(0x7FFF))
    bitmap = ids.select(piece.alias("piece"), place.alias("place")).groupBy("piece").agg(F.bitmap_construct_agg("place").alias("bits"))
    byte = F.conv(F.hex(F.substring("bits", (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    met = F.getbit(byte, place.bitwiseAND(F.lit(7)).cast("int")) == 1
    return rows.join(F.broadcast(bitmap), (piece == F.col("piece")) & met, "left_semi")


def _in_blocks(members: DataFrame) -> DataFrame:
    """Members (key, n, ...) for the signatures: in blocks, each with the member of least hash beside its own."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = members.withColumn("block", F.pmod(F.xxhash64("rep", F.lit(2)), blocks).cast("int"))
    hubs = members.where(F.col("n") > BLOCK).groupBy("key").agg(F.min_by(F.struct(*members.columns), F.xxhash64("rep", "h1", F.lit(4))).alias("x")).select("x.*")
    shared = hubs.withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return own.unionByName(shared).dropDuplicates(["key", "block", "rep", "h1"])


def _in_meetings(open_: DataFrame) -> DataFrame:
    """Members (key, n, rep, label, ...) for full sets, in tasks (ci, cj): all of a key in one, or, in a key with more than BLOCK, blocks of the members outside its largest component with each other and with those inside."""
    sizes = open_.groupBy("key", "label").agg(F.count("*").alias("m"))
    most = sizes.groupBy("key").agg(F.max_by("label", F.struct("m", "label")).alias("largest"), F.max("m").alias("inside"))
    dealt = open_.join(most, "key")
    outer = F.when(F.col("n") <= BLOCK, F.lit(1)).otherwise(F.ceil((F.col("n") - F.col("inside")) / BLOCK)).cast("int")
    inner = F.when(F.col("n") <= BLOCK, F.lit(0)).otherwise(F.ceil(F.col("inside") / BLOCK)).cast("int")
    draw = F.xxhash64("rep", F.lit(5))
    dealt = dealt.withColumn("outer", outer).withColumn("inner", inner)
    within = (F.col("n") > BLOCK) & (F.col("label") == F.col("largest"))
    dealt = dealt.withColumn("block", F.when(within, F.col("outer") + F.pmod(draw, F.col("inner"))).otherwise(F.pmod(draw, F.col("outer"))).cast("int"))
    others = F.when(within, F.sequence(F.lit(0), F.col("outer") - 1)).otherwise(F.sequence(F.lit(0), F.col("outer") + F.col("inner") - 1))
    return dealt.withColumn("other", F.explode(others)).withColumn("ci", F.least("block", "other")).withColumn("cj", F.greatest("block", "other"))


def near_duplicates(docs: DataFrame, size: int, numerator: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept; see the module's text. Two sets link at 100 * |A & B| >= numerator * |A | B|."""
    texts = id_text(docs)
    spark = docs.sparkSession
    # one pass over the texts; its small rows are read again for keys and for members
    classes = written(texts.mapInArrow(_classes(size, bands, rows), CLASSES))
    named = classes.where("n_shingles > 0 AND doc_id IS NOT NULL")
    # keys and signature depend on the class alone, so any row's will do
    reps = written(named.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("keys").alias("keys"), F.first("signature").alias("signature")))
    keyed = reps.select("rep", F.xxhash64("k1", "k2").alias("h1"), F.xxhash64("k2", "k1", F.lit(1)).alias("h2"), F.posexplode("keys").alias("band", "key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor("h1").alias("s1"), F.bit_xor("h2").alias("s2")).where("n > 1")
    keys = sizes.groupBy("n", "s1", "s2").agg(F.min("key").alias("key")).select("key", "n")
    # a doc_id that stands for several classes is a member by each
    members = written(keyed.select("rep", "key", "band", "h1").join(keys, "key"))
    marks = reps.select("rep", F.xxhash64("k1", "k2").alias("h1"), "n_shingles", "signature")
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def met(rows_: DataFrame, exact: bool) -> DataFrame:
        columns = [*MEETING, "shingles"] if exact else list(MEETING)
        dealt_ = rows_.select(*columns).repartition(n_parts, "key", "ci", "cj").sortWithinPartitions("key", "ci", "cj", "rep")
        return dealt_.mapInArrow(_verify(numerator, bands, rows, exact), PAIRS)

    def sets_of(ids: DataFrame) -> DataFrame:
        """Sets are made again, for documents that need them, instead of kept for all; the texts stay where they are."""
        return maybe_in(texts, ids).mapInArrow(_sets(size), SETS).where(F.length("shingles") > 0)

    signed = _in_blocks(members).join(marks, ["rep", "h1"]).withColumn("ci", F.col("block")).withColumn("cj", F.col("block")).withColumn("label", F.col("rep"))
    forest = written(met(signed, False))
    # the end with more pairs is the hub, so that most sets meet one other
    ends = forest.select("a", "b").distinct()
    degree = ends.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("d"))
    faced = ends.join(degree.withColumnRenamed("rep", "a").withColumnRenamed("d", "da"), "a").join(degree.withColumnRenamed("rep", "b").withColumnRenamed("d", "db"), "b")
    turned = F.col("db") > F.col("da")
    pairs = written(faced.select(F.when(turned, F.col("b")).otherwise(F.col("a")).alias("hub"), F.when(turned, F.col("a")).otherwise(F.col("b")).alias("rep")))
    hubs = pairs.groupBy("hub").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    spokes = pairs.join(hubs, "hub").select("hub", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("block"), F.lit(False).alias("is_hub"), "rep")
    meeting = spokes.unionByName(hubs.select("hub", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("is_hub"), F.col("hub").alias("rep")))
    wanted = pairs.select(F.explode(F.array("hub", "rep")).alias("doc_id")).distinct()
    met_sets = meeting.join(sets_of(wanted), "rep").select("hub", "block", "is_hub", "rep", "shingles").repartition(n_parts, "hub", "block").sortWithinPartitions("hub", "block", F.desc("is_hub"), "rep", "shingles")
    links = written(met_sets.mapInArrow(_confirm(numerator), LINKS).distinct())
    first = written(components(links))
    # keys whose forest did not hold, and keys dealt in blocks that are not in one component
    linked = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    failed = forest.join(linked, ["a", "b"], "left_anti").select("key").distinct()
    doubtful = failed.unionByName(keys.where(F.col("n") > BLOCK).select("key")).distinct()
    labelled = members.join(doubtful, "key", "left_semi").join(first.withColumnRenamed("node", "rep").withColumnRenamed("component", "label"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    labelled = written(labelled)
    apart = labelled.groupBy("key").agg((F.min("label") != F.max("label")).alias("apart")).where("apart").select("key")
    open_ = written(labelled.join(apart, "key", "left_semi"))
    more = _in_meetings(open_).join(marks, ["rep", "h1"]).join(sets_of(open_.select(F.col("rep").alias("doc_id")).distinct()), "rep")
    joined = components(links.unionByName(met(more, True).select("a", "b")))
    # members of a class follow their representative; a doc_id with rows in several classes joins them
    classed = named.select("doc_id", "n_shingles", "k1", "k2").join(reps.select("k1", "k2", "rep"), ["k1", "k2"]).select("doc_id", "n_shingles", "rep")
    classed = classed.join(joined.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    alone = classes.where("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return classed.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
