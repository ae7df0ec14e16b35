"""Removal of repeated byte strings, by a distributed merge sort of suffixes at chosen anchors.

A byte goes if a string of LENGTH bytes that covers it also starts earlier (in a smaller doc_id, or
earlier in the same document). Sorting every suffix would move each text a hundredfold, so a sparse
set is sorted that loses nothing:

1. Anchors. The anchor of a window of LENGTH bytes is its least K-byte gram by hash, the leftmost of
   equals. It depends on the window's bytes alone, so equal windows have equal anchors at equal
   distances. Neighbouring windows with one anchor make a segment (some 40 windows).
2. Copies of a whole segment, known by a 128-bit BLAKE2b digest, are sorted once: all but the first
   are repeats whole. One row for each segment is shuffled, and copies in a batch meet before that.
   A segment whose anchor no other segment has shares no window, and is done with.
3. The texts of the others, from the anchor to the right, are sorted: runs where they are,
   front-coded, exchanged by ranges and merged by loser trees that know common prefixes. What
   neighbours in the merged order share bounds what a segment shares with any other; the same is
   done to the left. A window needs both sides, so most drop out here.
4. The windows that both bounds allow are sorted by the same merge on all their bytes. Of each run
   of equal ones in the merged order the place that comes first stays, the others are repeats.

Ranges are as many as the session's shuffle partitions, cut by a sample that grows with them, and each
is a task of its own. A merge holds its runs compressed and one chunk of each decoded.

Hot strings (a licence line in a third of all documents) take no task of their own: an anchor with
more than HOT segments in one batch is dealt by segment, with one marker row to its own place, and
equal windows of one run travel as one.

Rows: null and empty texts have no bytes (digest of the empty string). A null doc_id has nothing
earlier or later: its bytes stay. Rows that repeat a doc_id are judged each by its own text: equal
bytes at the same position of two of them are one occurrence, of which none is the repeat. Other
columns are not read.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphwarden.llm.components import written
from graphwarden.llm.suffix_merge import front_code, merged
from graphwarden.llm.textbatch import BYTE_CODE, buffers, id_text, mix, powers, prefix_sums

LENGTH = 100
#: Bytes of an anchor gram.
GRAM = 20
#: Segments of one anchor in one batch beyond which it counts as hot.
HOT = 48
#: Bytes taken at once; windows of a longer document are taken in pieces that overlap.
PIECE = 1 << 19
#: Keys of the sample that sets the ranges, for each range.
SAMPLE = 32
#: Keys of one sorted run.
RUN = 100_000

NORMAL, SALTED, MARKER, REMOVED = 0, 1, 2, 3


def _longs(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.LongType(), False) for n in names]


#: route, digest (126 bits, the last two are the kind), doc and row (a document), span (start << 16 | anchor's distance << 8 | windows)
SEGMENTS = T.StructType(_longs("route", "d1", "d2", "doc", "row", "span"))
SPANS = T.StructType([*_longs("doc", "row", "span"), T.StructField("more", T.BooleanType(), False)])
TEXTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("row", T.LongType(), False), T.StructField("blob", T.BinaryType(), False)])
SIDES = T.StructType([*_longs("doc", "row", "anchor", "to_right"), T.StructField("right", T.BinaryType(), False), T.StructField("left", T.BinaryType(), False)])
#: A run of a range, or (known) repeats that were found before.
RUNS = T.StructType([T.StructField("part", T.IntegerType(), False), T.StructField("known", T.BooleanType(), False), T.StructField("run", T.BinaryType(), False)])
BOUNDED = T.StructType([*SIDES.fields, *_longs("bound")])
REPEATS = T.StructType(_longs("doc", "row", "span"))


def segments(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document row, first window, windows, anchor, anchor hash) of the segments of joined documents; positions count from the slice's start."""
    n = len(data)
    if n < LENGTH:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64))
    sums = prefix_sums(BYTE_CODE[data])
    _, down = powers(n + 1)
    grams = mix((sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1])
    low = (grams & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(grams), dtype=np.uint64)
    width, have = LENGTH - GRAM + 1, 1
    while 2 * have <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < width:
        low = np.minimum(low[: len(low) - (width - have)], low[width - have :])
    anchor = (low & np.uint64(0xFFFFFF)).astype(np.int64)  # of each window
    size = np.diff(offsets)
    ends = np.repeat(offsets[1:], size)[: len(anchor)]
    valid = np.arange(len(anchor)) + LENGTH <= ends
    first = valid.copy()
    first[1:] &= ~valid[:-1] | (anchor[1:] != anchor[:-1])
    last = valid.copy()
    last[:-1] &= ~valid[1:] | (anchor[1:] != anchor[:-1])
    s0, s1 = np.flatnonzero(first), np.flatnonzero(last)
    return np.searchsorted(offsets, s0, "right") - 1, s0, s1 - s0 + 1, anchor[s0], grams[anchor[s0]]


def _pieces(offsets: np.ndarray):
    """(rows i..j, from, to): slices of whole documents, and overlapping pieces of a long one."""
    n, i = len(offsets) - 1, 0
    while i < n:
        if offsets[i + 1] - offsets[i] > PIECE:
            for lo in range(int(offsets[i]), int(offsets[i + 1]) - LENGTH + 1, PIECE):
                yield i, i + 1, lo, min(lo + PIECE + LENGTH - 1, int(offsets[i + 1]))
            i += 1
            continue
        j = i
        while j < n and offsets[j + 1] - offsets[i] <= PIECE:
            j += 1
        yield i, j, int(offsets[i]), int(offsets[j])
        i = j


def _digests(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each range, as two columns; the second's last two bits are left free."""
    raw, blake = data.tobytes(), hashlib.blake2b
    joined = b"".join([blake(raw[s:e], digest_size=16).digest() for s, e in zip(start.tolist(), end.tolist(), strict=True)])
    pair = np.frombuffer(joined, np.uint64).reshape(-1, 2)
    return pair[:, 0], pair[:, 1] & ~np.uint64(3)


def _segmented(batches):
    for batch in batches:
        ids, own = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
        data, offsets, _ = buffers(batch.column(1))
        found = []
        for i, j, lo, hi in _pieces(offsets):
            row, s0, n, at, a = segments(data[lo:hi], np.clip(offsets[i : j + 1], lo, hi) - lo)
            d1, d2 = _digests(data[lo:hi], s0, s0 + n - 1 + LENGTH)
            span = ((s0 + lo - offsets[i + row]) << 16) | ((at - s0) << 8) | n
            found.append((a, d1, d2, ids[i + row].astype(np.int64), own[i + row].astype(np.int64), span))
        if not found or not sum(len(x[0]) for x in found):
            continue
        a, d1, d2, doc, row, span = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((row, span, doc, d2, d1, a))
        a, d1, d2, doc, row, span = (x[order] for x in (a, d1, d2, doc, row, span))
        # a row that is repeated has the same segments at the same places, each of which is one
        once = np.ones(len(a), bool)
        once[1:] = (a[1:] != a[:-1]) | (d1[1:] != d1[:-1]) | (d2[1:] != d2[:-1]) | (doc[1:] != doc[:-1]) | (span[1:] != span[:-1]) | (row[1:] != row[:-1])
        a, d1, d2, doc, row, span = (x[once] for x in (a, d1, d2, doc, row, span))
        new_a = np.ones(len(a), bool)
        new_a[1:] = a[1:] != a[:-1]
        new = new_a.copy()
        new[1:] |= (d1[1:] != d1[:-1]) | (d2[1:] != d2[:-1])
        first = np.flatnonzero(new)[np.cumsum(new) - 1]
        stays = (doc == doc[first]) & (span == span[first])  # the first place, in several rows where a doc_id repeats
        group = np.cumsum(new_a) - 1
        many = np.bincount(group, weights=new) > HOT
        hot = many[group] & stays
        route = np.where(hot, mix(a ^ mix(d1)), a)
        # repeats known in their batch go to any place and come out as they are
        route = np.where(stays, route, mix(mix(doc.view(np.uint64)) ^ span.view(np.uint64))).view(np.int64)
        kind = np.where(stays, np.where(hot, SALTED, NORMAL), REMOVED).astype(np.uint64)
        markers = a[new_a][many].view(np.int64)
        none = np.zeros(len(markers), np.int64)
        cols = ((route, markers), (d1.view(np.int64), none), ((d2 | kind).view(np.int64), none + MARKER), (doc, none), (row, none), (span, none))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names=SEGMENTS.names)


def _met(batches):
    """Rows sorted by route, digest, doc, span: repeats (more: false), and first segments whose anchor has others (more: true).

    A route is never held whole: what is carried on is its last segment's first place, and, while it
    has shown one segment alone, that segment's rows at that place.
    """
    last: tuple | None = None  # route, d1, d2, doc, span, whether the route has several
    pending: list[tuple[np.ndarray, ...]] = []

    def out(doc, row, span, more):
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(row), pa.array(span), pa.array(np.full(len(doc), more))], names=SPANS.names)

    for batch in batches:
        route, d1, d2, doc, row, span = (batch.column(c).to_numpy() for c in range(6))
        kind, d2 = d2 & 3, d2 >> 2
        known = kind == REMOVED
        if known.any():
            yield out(doc[known], row[known], span[known], False)
            route, d1, d2, doc, row, span, kind = (x[~known] for x in (route, d1, d2, doc, row, span, kind))
        if not len(route):
            continue
        goes_on = last is not None and route[0] == last[0]
        same_class = goes_on and (d1[0], d2[0]) == last[1:3]
        new_r = np.ones(len(route), bool)
        new_r[1:] = route[1:] != route[:-1]
        new = new_r.copy()
        new[1:] |= (d1[1:] != d1[:-1]) | (d2[1:] != d2[:-1])
        group, cls = np.cumsum(new_r) - 1, np.cumsum(new) - 1
        at = np.flatnonzero(new)
        f_doc, f_span = doc[at], span[at]
        if same_class:
            f_doc[0], f_span[0] = last[3:5]
        own = kind != MARKER
        stays = own & (doc == f_doc[cls]) & (span == f_span[cls])
        classes = np.bincount(group, weights=new)
        several = np.bincount(group, weights=~own | (kind == SALTED)) > 0
        if goes_on:
            classes[0] += 0 if same_class else 1
            several[0] |= last[5]
        several |= classes > 1
        again = own & ~stays
        if again.any():
            yield out(doc[again], row[again], span[again], False)
        if pending and goes_on and several[0]:
            yield from (out(*p, True) for p in pending)
        if not goes_on or several[0] or len(several) > 1:
            pending = []
        more = stays & several[group]
        if more.any():
            yield out(doc[more], row[more], span[more], True)
        if not several[-1]:
            wait = stays & (group == group[-1])
            pending.append((doc[wait], row[wait], span[wait]))
        last = (route[-1], d1[-1], d2[-1], f_doc[-1], f_span[-1], bool(several[-1]))


def _compressed(batches):
    import zstandard

    coder = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        blobs = [coder.compress((t.as_py() or "").encode()) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(blobs, pa.binary())], names=TEXTS.names)


def _sides(batches):
    """Rows (doc, row, blob, spans): each span's text from its anchor to the right, and reversed from the anchor's end to the left."""
    import zstandard

    coder = zstandard.ZstdDecompressor()
    for batch in batches:
        docs, rows = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for doc, row, blob, spans in zip(docs, rows, batch.column(2), batch.column(3), strict=True):
            text = coder.decompress(blob.as_py())
            span = spans.values.to_numpy()
            start, n = span >> 16, span & 255
            at = start + ((span >> 8) & 255)
            end = start + n - 1 + LENGTH
            right = [text[a:e] for a, e in zip(at.tolist(), end.tolist(), strict=True)]
            left = [text[s : a + GRAM][::-1] for s, a in zip(start.tolist(), at.tolist(), strict=True)]
            same = np.ones(len(span), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(doc * same), pa.array(row * same), pa.array(at), pa.array(0 * same), pa.array(right, pa.binary()), pa.array(left, pa.binary())], names=SIDES.names)


def _cuts(sample: list, parts: int) -> list:
    """The first keys of ranges 1, 2, ..., so that each range has about the same share of the sample."""
    ordered = sorted(sample)
    return sorted({ordered[len(ordered) * p // parts] for p in range(1, parts)}) if ordered else []


def _ranges(spark) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _sampled(rows: DataFrame, want: int) -> DataFrame:
    """About `want` rows, chosen by a hash."""
    one_of = rows.count() // want + 1
    return rows.where(F.pmod(F.xxhash64("doc", "row", "anchor"), F.lit(one_of)) == 0)


def _as_runs(keyed: Callable[..., Iterator[list[tuple]]], cuts: list, cut_of: Callable):
    """A mapInArrow function: rows of `keyed` (key, *payload), gathered, sorted and front-coded by range."""

    def run(batches):
        held: list[tuple] = []

        def dealt():
            held.sort()
            part_of = [bisect.bisect_right(cuts, cut_of(r)) for r in held]
            number, blobs, i = [], [], 0
            while i < len(held):
                j = bisect.bisect_right(part_of, part_of[i])
                number.append(part_of[i])
                blobs.append(front_code([r[0] for r in held[i:j]], [r[1:] for r in held[i:j]]))
                i = j
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), pa.array([False] * len(number)), pa.array(blobs, pa.binary())], names=RUNS.names)

        for rows in keyed(batches):
            held.extend(rows)
            if len(held) >= RUN:
                yield dealt()
        if held:
            yield dealt()

    return run


def bounded(sides: DataFrame, key: str) -> DataFrame:
    """sides with bound: the longest prefix of `key` that a row shares with any other's (its whole length next to the ends of a range)."""
    parts = _ranges(sides.sparkSession)
    k = SIDES.names.index(key)
    o = {4: 5, 5: 4}[k]
    sample = _sampled(sides, SAMPLE * parts).select(key, SIDES.names[o]).collect()  # SAMPLE rows of 300 bytes for each range
    cuts = _cuts([(bytes(r[0]), bytes(r[1])) for r in sample], parts)

    def keyed(batches):
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in range(6)]
            yield list(zip(cols[k], cols[o], *cols[:4], strict=True))

    def merge(batches):
        def out(rows):
            cols = [[r[c] for r in rows] for c in (3, 4, 5, 6, 0, 2, 1)]
            if k == 5:
                cols[4], cols[5] = cols[5], cols[4]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if i in (4, 5) else pa.int64()) for i, c in enumerate(cols)], names=BOUNDED.names)

        part, blobs = 0, []
        for batch in batches:
            blobs += batch.column(2).to_pylist()
            part = batch.column(0)[0].as_py() if batch.num_rows else part
        rows: list[list] = []
        first = True
        for key_, shared, payload in merged(blobs):
            if rows:
                rows[-1][1] = max(rows[-1][1], shared)
                if len(rows) >= 20_000:
                    kept = rows.pop()
                    yield out(rows)
                    rows = [kept]
            # the neighbour before the range's first row is elsewhere, so its bound is open
            rows.append([key_, len(key_) if first and part else shared, *payload])
            first = False
        if rows:
            if part < len(cuts):
                rows[-1][1] = len(rows[-1][0])
            yield out(rows)

    runs = sides.select(*SIDES.names).mapInArrow(_as_runs(keyed, cuts, lambda r: r[:2]), RUNS)
    return runs.repartitionById(parts, F.col("part")).mapInArrow(merge, BOUNDED)


def _allowed(right: bytes, left: bytes, bound: int, to_right: int) -> tuple[bytes, int, range]:
    """(text, bytes before the anchor, distances before the anchor of the windows that both bounds allow)."""
    # a window with d bytes before the anchor needs d <= bound - GRAM and LENGTH - d <= to_right
    least, most = max(0, LENGTH - min(to_right, len(right))), min(bound, len(left)) - GRAM
    text = left[: GRAM - 1 : -1] + right if len(left) > GRAM else right
    return text, len(left) - GRAM, range(least, min(most, LENGTH - GRAM) + 1)


def repeated_windows(both: DataFrame) -> DataFrame:
    """(doc, row, span) of windows that are equal to one at an earlier place."""
    parts = _ranges(both.sparkSession)
    sample = _sampled(both, SAMPLE * parts // 4 + 1).select("anchor", "right", "left", "bound", "to_right").collect()
    keys = []
    for r in sample:
        text, before, ds = _allowed(bytes(r[1]), bytes(r[2]), r[3], r[4])
        keys += [text[before - d : before - d + LENGTH] for d in ds if (d + r[0]) % 8 == 0]
    cuts = _cuts(keys, parts)

    def places(batches):
        for batch in batches:
            out = []
            cols = [batch.column(c).to_pylist() for c in range(7)]
            for doc, row, a, to_right, right, left, bound in zip(*cols, strict=True):
                text, before, ds = _allowed(right, left, bound, to_right)
                for d in ds:
                    w = text[before - d : before - d + LENGTH]
                    if len(w) == LENGTH:
                        out.append((w, doc, a - d, row))
                if len(out) >= RUN:
                    yield out
                    out = []
            yield out

    def runs(batches):
        for rows in places(batches):
            rows.sort()
            number, blobs, known = [], [], []
            keep: list[tuple] = []
            for r in rows:
                if keep and keep[-1][0] == r[0]:
                    if keep[-1] == r:
                        continue  # a repeated row
                    if keep[-1][1:3] != r[1:3]:
                        known.append((r[1], r[3], r[2]))
                        continue
                keep.append(r)
            part_of = [bisect.bisect_right(cuts, r[0]) for r in keep]
            i = 0
            while i < len(keep):
                j = bisect.bisect_right(part_of, part_of[i])
                number.append(part_of[i])
                blobs.append(front_code([r[0] for r in keep[i:j]], [r[1:] for r in keep[i:j]]))
                i = j
            flags = [False] * len(number)
            if known:
                number.append(known[0][0] % parts)
                flags.append(True)
                blobs.append(np.array(known, np.int64).tobytes())
            if number:
                yield pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), pa.array(flags), pa.array(blobs, pa.binary())], names=RUNS.names)

    def merge(batches):
        def out(rows):
            table = np.array(rows, np.int64).reshape(-1, 3)
            return pa.RecordBatch.from_arrays([pa.array(table[:, 0]), pa.array(table[:, 1]), pa.array((table[:, 2] << 16) | 1)], names=REPEATS.names)

        blobs = []
        for batch in batches:
            for known, blob in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if known:
                    yield out(np.frombuffer(blob, np.int64))
                else:
                    blobs.append(blob)
        late: list[tuple] = []
        first: list[tuple] = []  # (doc, start, row) of the earliest place of the window at hand
        for _, shared, place in merged(blobs):
            if shared < LENGTH or not first:
                first = [place]
            elif place[:2] == first[0][:2]:
                first.append(place)
            elif place[:2] < first[0][:2]:
                late += first
                first = [place]
            else:
                late.append(place)
            if len(late) >= 50_000:
                yield out([(d, r, s) for d, s, r in late])
                late = []
        if late:
            yield out([(d, r, s) for d, s, r in late])

    return both.mapInArrow(runs, RUNS).repartitionById(parts, F.col("part")).mapInArrow(merge, REPEATS)


RESULT = T.StructType([T.StructField("doc_id", T.LongType()), *_longs("n_bytes", "n_removed", "n_spans"), T.StructField("kept_sha256", T.StringType(), False)])


def _cover(n: int, span: np.ndarray) -> np.ndarray:
    """Which of n bytes the windows of `span` cover."""
    edge = np.zeros(n + 1, np.int32)
    start = span >> 16
    np.add.at(edge, start, 1)
    np.add.at(edge, start + (span & 255) - 1 + LENGTH, -1)
    return np.cumsum(edge[:-1]) > 0


def _kept(batches):
    import zstandard

    coder = zstandard.ZstdDecompressor()
    for batch in batches:
        rows = []
        for doc, blob, spans in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            text = coder.decompress(blob.as_py())
            if spans.is_valid:
                gone = _cover(len(text), spans.values.to_numpy())
                rest = np.frombuffer(text, np.uint8)[~gone].tobytes()
                n_spans = int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum())
                rows.append((doc, len(text), int(gone.sum()), n_spans, hashlib.sha256(rest).hexdigest()))
            else:
                rows.append((doc, len(text), 0, 0, hashlib.sha256(text).hexdigest()))
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(cols, (pa.int64(),) * 4 + (pa.string(),), strict=True)], names=RESULT.names)


def keyed_texts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc_id, text and row, which tells texts of one doc_id apart (0 where no doc_id repeats): all rows, and those to judge, where a row that is repeated stands once."""
    texts = id_text(docs)
    repeats = texts.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1")
    if repeats.isEmpty():
        texts = texts.withColumn("row", F.lit(0).cast("bigint"))
        return texts, texts.where("doc_id IS NOT NULL")
    row = F.conv(F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, 15), 16, 10)
    texts = texts.withColumn("row", row.cast("bigint"))
    return texts, texts.where("doc_id IS NOT NULL").dropDuplicates(["doc_id", "row"])


def repeated_spans(texts: DataFrame) -> DataFrame:
    """(doc, row, span): windows that start earlier elsewhere; texts: those to judge of keyed_texts()."""
    parts = _ranges(texts.sparkSession)
    rows = texts.mapInArrow(_segmented, SEGMENTS)
    met = rows.repartition(parts, "route").sortWithinPartitions("route", "d1", F.shiftright("d2", 2), "doc", "span", "row").mapInArrow(_met, SPANS)
    met = written(met)
    detail = met.where("more").groupBy("doc", "row").agg(F.collect_list("span").alias("spans"))  # a document's own segments
    blobs = texts.mapInArrow(_compressed, TEXTS).withColumnRenamed("doc_id", "doc")
    sides = blobs.join(detail, ["doc", "row"]).select("doc", "row", "blob", "spans").mapInArrow(_sides, SIDES)
    sides = written(sides)
    room = F.col("bound") + F.length("left") - GRAM >= LENGTH
    to_right = written(bounded(sides, "right").where(room).select("doc", "row", "anchor", F.col("bound").alias("to_right"), "right", "left"))
    both = written(bounded(to_right, "left").where(F.col("bound") - GRAM + F.col("to_right") >= LENGTH))
    return met.where("NOT more").select("doc", "row", "span").unionByName(repeated_windows(both))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    texts, judged = keyed_texts(docs)
    spans = repeated_spans(judged).groupBy("doc", "row").agg(F.collect_list("span").alias("spans"))  # a document's own windows
    blobs = texts.mapInArrow(_compressed, TEXTS).withColumnRenamed("row", "own")
    return blobs.join(spans, (F.col("doc_id") == F.col("doc")) & (F.col("own") == F.col("row")), "left").select("doc_id", "blob", "spans").mapInArrow(_kept, RESULT)
