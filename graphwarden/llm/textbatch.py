"""Arrow string columns as numpy buffers, and hashes over them.

Everything here works on one Arrow batch at a time, in slices of a few MB, so memory follows
the longest single document and not the batch or the partition.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text that one vectorised slice takes (a longer document is a slice of its own).
SLICE_BYTES = 1 << 18

U64 = np.uint64


def id_text(docs: DataFrame) -> DataFrame:
    """doc_id as bigint and text as string; every other column, whatever its name, is left out."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, valid) of a string column; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    n = len(column)
    valid = np.ones(n, bool) if not column.null_count else column.is_valid().to_numpy(zero_copy_only=False)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, n + 1 + column.offset)[column.offset :] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if column.null_count:
        keep = np.where(valid, np.diff(off), 0)
        if keep.sum() != off[-1] - off[0]:
            column = column.fill_null("")
            return buffers(column)[0], buffers(column)[1], valid
    return raw, off.astype(np.int64), valid


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES):
    """Ranges [i, j) of rows with about `limit` bytes, one row at least."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, j
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit integers."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(31)
    x *= U64(0x7FB5D329728EA185)
    x ^= x >> U64(27)
    x *= U64(0x81DADEF4BC2DD44D)
    x ^= x >> U64(33)
    return x


_rng = np.random.default_rng(20240607)
#: A random odd 64-bit integer for each byte, and the base of the rolling sums (fixed seed).
BYTE_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
BASE = U64(0x9E3779B97F4A7C15)
BASE_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse modulo 2**64, for i below n at least."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        out = []
        for base in (BASE, BASE_INVERSE):
            p = np.ones(size, U64)
            p[1:] = base
            out.append(np.multiply.accumulate(p))
        _powers[:] = out
    return _powers[0], _powers[1]


def prefix_sums(codes: np.ndarray) -> np.ndarray:
    """S with S[j] - S[i] = sum of codes[k] * BASE**k over i <= k < j."""
    up, _ = powers(len(codes) + 1)
    out = np.zeros(len(codes) + 1, U64)
    np.cumsum(codes * up[: len(codes)], out=out[1:])
    return out


def range_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each code range, the same wherever the range stands."""
    _, down = powers(len(sums))
    h = (sums[end] - sums[start]) * down[start]
    return mix(h + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


#: Bytes of `[\x20\x09-\x0D]`, and A-Z to a-z.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word `[^\\x20\\x09-\\x0D]+`; documents begin at `starts`, and no word crosses them."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ink = ~IS_SPACE[data]
    first = ink.copy()
    first[1:] &= ~ink[:-1]
    cut = starts[(starts > 0) & (starts < len(data))]
    first[cut] = ink[cut]
    last = ink.copy()
    last[:-1] &= ~ink[1:]
    last[cut - 1] = ink[cut - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


#: Bytes whose words are hashed at once; a piece ends at white space, so a longer word makes a longer piece.
WORD_BYTES = 1 << 20


def word_parts(data: np.ndarray, off: np.ndarray):
    """(piece of the joined documents, where it begins, start and end of its words): vectors over bytes are no longer than a piece."""
    lo = 0
    while lo < len(data):
        hi = min(lo + WORD_BYTES, len(data))
        while hi < len(data) and not IS_SPACE[data[hi]]:
            gap = np.flatnonzero(IS_SPACE[data[hi : hi + WORD_BYTES]])
            hi = hi + int(gap[0]) if len(gap) else min(hi + WORD_BYTES, len(data))
        inside = off[(off > lo) & (off < hi)] - lo
        yield data[lo:hi], lo, *words(data[lo:hi], np.concatenate([[0], inside]))
        lo = hi


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of the joined documents, and the word's document; a hash takes some 40 bytes a byte of text, so long texts go in pieces."""
    hashes, docs = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
    for piece, lo, ws, we in word_parts(data, off):
        hashes.append(range_hashes(prefix_sums(BYTE_CODE[piece]), ws, we))
        docs.append(np.searchsorted(off, ws + lo, "right") - 1)
    return np.concatenate(hashes), np.concatenate(docs)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct word shingles of each document, as sorted 64-bit hashes.

    Returns (hashes, counts, n_words, text_hash): the sets one after another, each set's size, each
    document's words, and a hash of its sequence of lower-case words. With fewer words than `size`,
    the whole sequence is the one shingle; a document without words has the empty set.
    """
    n_docs = len(offsets) - 1
    base = offsets[0]
    data = LOWER[data[base : offsets[-1]]]
    off = offsets - base
    h, doc = word_hashes(data, off)
    n_words = np.bincount(doc, minlength=n_docs).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(n_words)])
    seq = prefix_sums(h)
    whole = range_hashes(seq, first[:-1], first[1:])
    if len(h) >= size:
        at = np.arange(len(h) - size + 1)
        at = at[doc[at] == doc[at + size - 1]]
        sh, sh_doc = range_hashes(seq, at, at + size), doc[at]
    else:
        sh, sh_doc = np.zeros(0, U64), np.zeros(0, np.int64)
    short = np.flatnonzero((n_words > 0) & (n_words < size))
    if len(short):
        sh, sh_doc = np.concatenate([sh, whole[short]]), np.concatenate([sh_doc, short])
    order = np.lexsort((sh, sh_doc))
    sh, sh_doc = sh[order], sh_doc[order]
    if len(sh):
        new = np.ones(len(sh), bool)
        new[1:] = (sh[1:] != sh[:-1]) | (sh_doc[1:] != sh_doc[:-1])
        sh, sh_doc = sh[new], sh_doc[new]
    return sh, np.bincount(sh_doc, minlength=n_docs).astype(np.int64), n_words, whole
