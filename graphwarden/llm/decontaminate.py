"""Benchmark decontamination by the q-gram lemma.

A document leaks an item if a passage of the item occurs in it with at most `budget` edits. Texts are
compared as UTF-8 bytes, with case folded over all of Unicode and white space as single spaces (an
item without those at its ends). An item's passages are all its stretches of PASSAGE bytes (an item
shorter than that is its one passage); the budget is a tenth of the length, and little enough for
the bound below to be 1 at least. A stretch of fewer bytes than PASSAGE of a longer item is no leak.
Items with fewer than SHORTEST bytes have no budget: they leak where they stand word for word, not
as a part of longer words, and are searched for exactly.

Filter: an occurrence with k edits shares at least m - q + 1 - k * q of the passage's q-grams, all on
k + 1 neighbouring diagonals. Hits are counted in diagonal bands of twice that width, each overlapping
the next by half, so one band has them all. Bands that meet the bound are verified by an alignment
within the band.

Long items are cut into parts and long documents into tiles, which overlap by more than an occurrence;
equal parts, and equal tiles of a document, are looked at once. Hits are expanded for some
tiles and parts at a time, EXPANDED at most, so neither long texts of few letters nor a phrase that most items have
fills the memory. Items come in blocks of at most BLOCK_BYTES, each broadcast for one pass over
the documents.

Rows: null and empty texts leak nothing; null and blank items and null item_ids are left out; an
item_id that repeats leaks where any of its texts does; a null doc_id passes through; repeated
doc_ids are judged row by row; an empty benchmark leaks nothing. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphwarden.llm.textbatch import BYTE_CODE, IS_SPACE, LOWER, buffers, prefix_sums, range_hashes, slices

Q = 12
PASSAGE, SHORTEST = 80, 24
EDIT_SHARE = 10
#: Bytes of benchmark text in one broadcast.
BLOCK_BYTES = 8_000_000
#: Bytes of the largest part of an item and tile of a document, of the largest tile that is not cut further (more than twice the next), and by how much tiles overlap.
PART, TILE, SMALL, OVERLAP = 1024, 1 << 14, 512, 128
#: Bytes whose grams are made at once, and hits that are expanded at once.
GRAM_BYTES, EXPANDED = 1 << 18, 1 << 20
_BITS = 22

#: Bytes of words: letters, digits, and all beyond ASCII.
IN_WORD = np.zeros(256, bool)
IN_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def folded(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Joined texts with their case folded. A text may change its length by that; bytes that are not UTF-8 stay."""
    beyond = np.flatnonzero(raw >= 128)
    rows = np.unique(np.searchsorted(off, beyond, "right") - 1)
    if not len(rows):
        return LOWER[raw], off
    size = np.diff(off)
    parts, last = [], 0
    for r in rows.tolist():
        parts.append(LOWER[raw[last : off[r]]])
        last = off[r + 1]
        text = raw[off[r] : last].tobytes().decode("utf-8", "surrogateescape").casefold().encode("utf-8", "surrogateescape")
        parts.append(np.frombuffer(text, np.uint8))
        size[r] = len(text)
    parts.append(LOWER[raw[last:]])
    return np.concatenate(parts), np.concatenate([[0], np.cumsum(size)])


def normal(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Joined texts in the form that is compared."""
    raw, off = folded(data[offsets[0] : offsets[-1]], offsets - offsets[0])
    space = IS_SPACE[raw]
    keep = np.ones(len(raw), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    inside = off[:-1][off[:-1] < len(raw)]
    keep[inside] = True
    size = [np.count_nonzero(keep[a:b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
    return np.where(space, np.uint8(32), raw)[keep], np.concatenate([[0], np.cumsum(size, dtype=np.int64)])


def normal_text(text: str) -> bytes:
    raw = np.frombuffer(text.encode(), np.uint8)
    return normal(raw, np.array([0, len(raw)]))[0].tobytes()


def passages(n: int) -> list[tuple[int, int]]:
    """(start, length) of the passages of an item with n bytes."""
    m = length(n)
    return [(s, m) for s in range(n - m + 1)]


def length(n: int) -> int:
    """Bytes of each passage of an item with n bytes."""
    return min(n, PASSAGE)


def budget(m: int) -> int:
    return min(m // EDIT_SHARE, (m - Q) // Q) if m >= SHORTEST else 0


def bound(m: int) -> int:
    return m - Q + 1 - budget(m) * Q


def grams(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the Q bytes from each position (equal grams count as shared, so a collision costs a verification at most)."""
    if len(data) < Q:
        return np.zeros(0, np.uint64)
    eight = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, 8)).view(np.uint64).ravel()
    return eight[: len(data) - Q + 1] * np.uint64(0x9E3779B97F4A7C15) ^ (eight[Q - 8 :] * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(7))


def aligned(item: np.ndarray, starts: np.ndarray, m: int, text: np.ndarray, shift: int, width: int, most: int) -> bool:
    """Whether a passage of m bytes of the item, from one of `starts`, occurs in the text with at most `most` edits on diagonals shift..shift + width - 1 (text minus item positions).

    cost[s, d] is the least edits of the first i bytes from start s ending at text position start + i + shift + d.
    """
    n, far, base = len(text), most + 1, int(starts.min())
    steps = np.arange(width)
    # all cells of the band at once: text positions after the cell, and whether its two bytes differ
    part = item[base : int(starts.max()) + m]
    pos = base + shift + steps[None, :] + np.arange(len(part) + 1)[:, None]
    ok = (pos >= 0) & (pos <= n)
    at = pos[1:]
    inner = (at >= 1) & (at <= n)
    differs = np.where(inner, text[np.clip(at - 1, 0, n - 1)] != part[:, None], True).astype(np.int64)
    differs[at < 1] = far
    row = starts - base
    cost = np.where(ok[row], 0, far)  # a match may start anywhere
    for i in range(m):
        new = cost + differs[row + i]
        new[:, :-1] = np.minimum(new[:, :-1], cost[:, 1:] + 1)  # a byte of the passage has no partner
        out = ~ok[row + i + 1]
        new[out] = far
        new = np.minimum(np.minimum.accumulate(new - steps, axis=1) + steps, far)  # bytes of the text have none
        new[out] = far
        live = new.min(1) <= most
        if not live.any():
            return False
        cost, row = new[live], row[live]
    return True


def _cut(size: int, part: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Ranges of at most `part` bytes that overlap by `overlap`; the last is longer than that."""
    if size <= part:
        yield 0, size
        return
    for lo in range(0, size - overlap, part - overlap):
        yield lo, min(lo + part, size)


class Index:
    """The q-grams of the parts of a block of items, and the short items."""

    def __init__(self, items: list[tuple[int, bytes]]):
        self.ids = np.array([i for i, _ in items], np.int64)
        owners: dict[bytes, list[int]] = {}
        self.short: dict[int, dict[bytes, list[int]]] = {}
        for row, (_, text) in enumerate(items):
            text = text.strip(b" ")
            if len(text) >= SHORTEST:
                for lo, hi in _cut(len(text), PART, PASSAGE - 1):
                    owners.setdefault(text[lo:hi], []).append(row)
            elif text:
                self.short.setdefault(len(text), {}).setdefault(text, []).append(row)
        self.short_keys = {m: np.unique([self._key(x) for x in found]) for m, found in self.short.items()}
        self.texts = [np.frombuffer(t, np.uint8) for t in owners]
        self.owners = [sorted(set(rows)) for rows in owners.values()]
        grams_of = [grams(t) for t in self.texts]
        g = np.concatenate(grams_of) if grams_of else np.zeros(0, np.uint64)
        part = np.repeat(np.arange(len(grams_of)), [len(p) for p in grams_of])
        at = np.concatenate([np.arange(len(p)) for p in grams_of]) if grams_of else np.zeros(0, np.int64)
        order = np.lexsort((at, part, g))
        g, self.part, self.at = g[order], part[order], at[order]
        self.keys, first = np.unique(g, return_index=True)
        self.first = np.append(first, len(g))
        self.place = np.repeat(np.arange(len(self.keys)), np.diff(self.first)) * len(self.texts) + self.part  # of each posting, rising
        self.filter = np.zeros(1 << _BITS, bool)
        self.filter[self._slot(self.keys)] = True
        ms = {length(len(t)) for t in self.texts}
        self.least = min((bound(m) for m in ms), default=1)
        self.reach = max((budget(m) for m in ms), default=0) + 1  # neighbouring diagonals of one occurrence

    @staticmethod
    def _slot(g: np.ndarray) -> np.ndarray:
        return ((g * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _BITS)).astype(np.int64)

    @staticmethod
    def _key(text: bytes) -> np.uint64:
        raw = np.frombuffer(text, np.uint8)
        return range_hashes(prefix_sums(BYTE_CODE[raw]), np.array([0]), np.array([len(raw)]))[0]

    def leaks(self, data: np.ndarray, offsets: np.ndarray) -> set[tuple[int, int]]:
        """(document row, item row) of the joined documents."""
        text, off = normal(data, offsets)
        tiles, seen = [], set()
        for doc, (lo, hi) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
            if hi - lo <= TILE:
                tiles.append((doc, lo, hi))
                continue
            for a, b in _cut(hi - lo, TILE, OVERLAP):
                digest = (doc, hashlib.blake2b(text[lo + a : lo + b], digest_size=16).digest())
                if digest not in seen:
                    seen.add(digest)
                    tiles.append((doc, lo + a, lo + b))
        found: set[tuple[int, int]] = set()  # (document, part)
        exact: set[tuple[int, int]] = set()
        i = 0
        while i < len(tiles):
            j = i + 1
            while j < len(tiles) and tiles[j][2] - tiles[i][1] <= GRAM_BYTES:
                j += 1
            self._in_tiles(text, tiles[i:j], found)
            exact |= self._short_in_tiles(text, off, tiles[i:j])
            i = j
        return exact | {(doc, row) for doc, part in found for row in self.owners[part]}

    def _short_in_tiles(self, text: np.ndarray, off: np.ndarray, tiles: list[tuple[int, int, int]]) -> set[tuple[int, int]]:
        """(document, item) of short items that stand in the tiles and cut no word."""
        out: set[tuple[int, int]] = set()
        base, end = tiles[0][1], tiles[-1][2]
        if not self.short or end <= base:
            return out
        block = text[base:end]
        sums = prefix_sums(BYTE_CODE[block])
        for m, items in self.short.items():
            start = np.arange(max(0, len(block) - m + 1))
            for p in (base + start[np.isin(range_hashes(sums, start, start + m), self.short_keys[m])]).tolist():
                rows = items.get(text[p : p + m].tobytes())
                doc = int(np.searchsorted(off, p, "right")) - 1
                lo, hi = int(off[doc]), int(off[doc + 1])
                if rows is None or p + m > hi:
                    continue
                if not (p > lo and IN_WORD[text[p - 1]] and IN_WORD[text[p]]) and not (p + m < hi and IN_WORD[text[p + m]] and IN_WORD[text[p + m - 1]]):
                    out |= {(doc, row) for row in rows}
        return out

    def _in_tiles(self, text: np.ndarray, tiles: list[tuple[int, int, int]], found: set[tuple[int, int]]) -> None:
        """Add (document, part) of the tiles, which lie close together and in order."""
        base = tiles[0][1]
        g = grams(text[base : tiles[-1][2]])
        if not len(g) or not len(self.keys):
            return
        p = np.flatnonzero(self.filter[self._slot(g)])
        k = np.minimum(np.searchsorted(self.keys, g[p]), len(self.keys) - 1)
        hit = self.keys[k] == g[p]
        p, k = p[hit] + base, k[hit]
        hits = np.concatenate([[0], np.cumsum(self.first[k + 1] - self.first[k])])
        held, size, seen = [], 0, set()
        todo = tiles[::-1]
        while todo:
            doc, lo, hi = todo.pop()
            a, b = np.searchsorted(p, [lo, hi - Q + 1])
            if b - a < self.least:  # an occurrence has hits at so many positions
                continue
            n = int(hits[b] - hits[a])
            if n > EXPANDED and hi - lo > SMALL:
                for x, y in reversed(list(_cut(hi - lo, max(SMALL, (hi - lo) // 2 + OVERLAP), OVERLAP))):
                    digest = (doc, hashlib.blake2b(text[lo + x : lo + y], digest_size=16).digest())
                    if digest not in seen:
                        seen.add(digest)
                        todo.append((doc, lo + x, lo + y))
            elif n > EXPANDED:
                self._by_parts(text, (doc, lo, hi, int(a), int(b)), p, k, 0, len(self.texts), found)
            else:
                if size + n > EXPANDED:
                    self._expanded(text, held, p, k, self.first[k], self.first[k + 1], found)
                    held, size = [], 0
                held.append((doc, lo, hi, int(a), int(b)))
                size += n
        if held:
            self._expanded(text, held, p, k, self.first[k], self.first[k + 1], found)

    def _by_parts(self, text: np.ndarray, tile: tuple[int, int, int, int, int], p: np.ndarray, k: np.ndarray, lo: int, hi: int, found: set[tuple[int, int]]) -> None:
        """A small tile with very many hits, a range of parts at a time."""
        a, b = tile[3:]
        begin = np.searchsorted(self.place, k[a:b] * len(self.texts) + lo)
        end = np.searchsorted(self.place, k[a:b] * len(self.texts) + hi)
        if (end - begin).sum() > EXPANDED and hi - lo > 1:
            middle = (lo + hi) // 2
            self._by_parts(text, tile, p, k, lo, middle, found)
            self._by_parts(text, tile, p, k, middle, hi, found)
        else:
            self._expanded(text, [(*tile[:3], 0, b - a)], p[a:b], k[a:b], begin, end, found)

    def _expanded(self, text: np.ndarray, tiles: list[tuple[int, int, int, int, int]], p: np.ndarray, k: np.ndarray, begin: np.ndarray, end: np.ndarray, found: set[tuple[int, int]]) -> None:
        """Count the hits of tiles (document, from, to, first hit, end of hits) in bands, and verify those that meet the bound."""
        width = np.array([b - a for *_, a, b in tiles])
        which = np.concatenate([np.arange(a, b) for *_, a, b in tiles])
        tile = np.repeat(np.arange(len(tiles)), width)
        n = (end - begin)[which]
        post = np.repeat(begin[which] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        p, tile, part, at = np.repeat(p[which], n), np.repeat(tile, n), self.part[post], self.at[post]
        # a pair of tile and part with too few hits in all can have no band that meets the bound
        _, inverse, total = np.unique(tile * len(self.texts) + part, return_inverse=True, return_counts=True)
        many = total[inverse] >= self.least
        p, tile, part, at = p[many], tile[many], part[many], at[many]
        if not len(p):
            return
        diagonal = p - np.array([t[1] for t in tiles])[tile] - at
        low = int(diagonal.min())
        for half in (0, self.reach):
            band = (diagonal - low + half) // (2 * self.reach)
            order = np.lexsort((p, band, part, tile))
            d, i, b = tile[order], part[order], band[order]
            new = np.ones(len(d), bool)
            new[1:] = (d[1:] != d[:-1]) | (i[1:] != i[:-1]) | (b[1:] != b[:-1])
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(d))
            full = last - first >= self.least
            for lo, hi in zip(first[full].tolist(), last[full].tolist(), strict=True):
                doc, start, stop = tiles[int(d[lo])][:3]
                key = (doc, int(i[lo]))
                if key not in found and self._verified(text[start:stop], key[1], int(b[lo]) * 2 * self.reach + low - half, at[order[lo:hi]]):
                    found.add(key)

    def _verified(self, text: np.ndarray, part: int, shift: int, at: np.ndarray) -> bool:
        m = length(len(self.texts[part]))
        at = np.sort(at)
        starts = np.arange(len(self.texts[part]) - m + 1)
        hits = np.searchsorted(at, starts + m - Q, "right") - np.searchsorted(at, starts, "left")
        starts = starts[hits >= bound(m)]
        # neighbouring passages mostly agree, so a few are tried before all
        return any(len(x) and aligned(self.texts[part], x, m, text, shift, 2 * self.reach, budget(m)) for x in (starts[:: m // 4], starts))


def blocks(benchmark: DataFrame):
    """Blocks of (item_id, normal text), read in order of item_id."""
    rows = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL").distinct().orderBy("item_id", "text")
    part, size = [], 0
    for r in rows.toLocalIterator():
        text = normal_text(r.text)
        part.append((r.item_id, text))
        size += len(text)
        if size >= BLOCK_BYTES:
            yield part
            part, size = [], 0
    if part:
        yield part


def leaks(docs: DataFrame, benchmark: DataFrame, columns: list[str]) -> DataFrame:
    """The given columns of docs with item_ids: sorted ids of the items that each whole text leaks."""
    rows = docs.select(*[F.col(f"`{c}`") for c in columns], F.col("text").cast("string").alias("__text"), F.array().cast("array<bigint>").alias("item_ids"))
    schema = T.StructType(rows.schema.fields)
    spark = docs.sparkSession

    def scan(shared):
        def run(batches):
            for batch in batches:
                at_text, at_ids = batch.num_columns - 2, batch.num_columns - 1
                data, offsets, _ = buffers(batch.column(at_text))
                index = shared.value
                lists = batch.column(at_ids).to_pylist()
                for i, j in slices(offsets):
                    for d, item in index.leaks(data, offsets[i : j + 1]):
                        lists[i + d].append(int(index.ids[item]))
                ids = pa.array([sorted(set(x)) for x in lists], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(at_ids)), ids], names=schema.names)

        return run

    for part in blocks(benchmark):
        rows = rows.mapInArrow(scan(spark.sparkContext.broadcast(Index(part))), schema)
    return rows.drop("__text")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, contaminated, n_items, item_ids of every document."""
    rows = leaks(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), benchmark, ["doc_id"])
    return rows.select("doc_id", contaminated().alias("contaminated"), F.size("item_ids").cast("bigint").alias("n_items"), "item_ids")


def contaminated() -> Column:
    return F.size("item_ids") > 0
