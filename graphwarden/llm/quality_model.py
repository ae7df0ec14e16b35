"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics of whole texts are computed batch-wise in numpy. Trees are grown level by level on
binned statistics (second-order logistic loss) from a bounded sample of labelled rows, flattened to
arrays of a complete binary tree, and traversed for all rows of a batch at once.

Rows: null and empty texts have all statistics 0 and get a score like any other; labels that are null
are not learned from, and of several labels for one document the least counts, as does the least text of a
doc_id that repeats; without labels every score is 0.5. Repeated doc_ids are scored row by row, a null
doc_id passes through, texts of any length count whole, an empty table gives no rows. Other columns
are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphwarden.llm import textbatch
from graphwarden.llm.textbatch import BYTE_CODE, LOWER, buffers, id_text, prefix_sums, range_hashes, slices, word_parts

#: The bound of the training sample, in labelled rows (those with the least hash of doc_id).
SAMPLE_ROWS = 20_000
#: A text with a score of this at least is kept.
THRESHOLD = 0.3
TREES, DEPTH, BINS, RATE, L2, LEAST = 60, 4, 64, 0.2, 1.0, 8.0

#: Common words of several languages; what they share of a text is one of its statistics.
STOP_WORDS = (
    "the of and to in a is that for it was with as on be at by this have from or are not but what all were when we an he she they you"
    " der die das und ist von zu den mit sich des auf für nicht ein eine als auch dem"
    " le la les de des et est un une du que qui dans en pour pas sur au avec il elle"
    " el los las que y se del por con para una su al lo como más no"
).split()

FEATURES = ("bytes", "words", "word_length", "word_spread", "lines", "line_length", "upper", "lower", "digits", "symbols", "bangs", "bars", "stops", "high", "repeated_lines", "distinct_words", "top_word", "repeated_shingles", "space")


def _word_code(w: str) -> int:
    raw = np.frombuffer(w.encode(), np.uint8)
    return int(range_hashes(prefix_sums(BYTE_CODE[raw]), np.array([0]), np.array([len(raw)]))[0])


_STOPS = np.array(sorted({_word_code(w) for w in STOP_WORDS}), np.uint64)


#: Class of each byte, in the order of FEATURES' shares; 0 is any other.
_KIND = np.zeros(256, np.int32)
for _k, _bytes in enumerate((range(65, 91), range(97, 123), range(48, 58), b"#*$%&<>~^_={}\\[]@", b"!?", b"|", range(128, 256), (9, 10, 11, 12, 13, 32)), 1):
    _KIND[list(_bytes)] = _k


def _counts(doc: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each document: distinct hashes, the most frequent one's count, and members of hashes that occur twice or more."""
    distinct, top, repeated = np.zeros(n), np.zeros(n), np.zeros(n)
    if len(hashes):
        order = np.lexsort((hashes, doc))
        h, d = hashes[order], doc[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        at = np.flatnonzero(new)
        run = np.diff(np.append(at, len(h)))
        distinct = np.bincount(d[at], minlength=n).astype(float)
        np.maximum.at(top, d[at], run)
        repeated = np.bincount(d[at], weights=np.where(run > 1, run, 0), minlength=n)
    return distinct, top, repeated


def _lines(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Document and hash of each line that is not empty, in lower case."""
    if len(raw) > textbatch.WORD_BYTES:  # long texts line by line
        docs, hashes = [], []
        for d, (lo, hi) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
            own = [int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little") for x in LOWER[raw[lo:hi]].tobytes().split(b"\n") if x]
            hashes.append(np.array(own, np.uint64))
            docs.append(np.full(len(own), d))
        return np.concatenate(docs), np.concatenate(hashes)
    cut = np.flatnonzero(raw == 10)
    ls = np.unique(np.concatenate([off[:-1][np.diff(off) > 0], cut + 1]))
    ls = ls[ls < len(raw)]
    doc = np.searchsorted(off, ls, "right") - 1
    le = np.minimum(np.append(ls[1:], len(raw)), off[doc + 1])
    le = le - (raw[le - 1] == 10) if len(le) else le
    full = le > ls
    return doc[full], range_hashes(prefix_sums(BYTE_CODE[LOWER[raw]]), ls[full], le[full])


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """FEATURES of each document, one row each."""
    n = len(offsets) - 1
    raw = data[offsets[0] : offsets[-1]]
    off = offsets - offsets[0]
    size = np.diff(off).astype(float)

    kinds = np.zeros((n, 9), np.int64)
    hashes, docs, lengths = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    closing = np.zeros(256, bool)
    closing[list(b".,;:!?")] = True
    for piece, lo, ws, we in word_parts(raw, off):  # what is kept of a piece is its words' alone
        rows = np.arange(np.searchsorted(off, lo, "right") - 1, np.searchsorted(off, lo + len(piece), "left"))
        size_in = np.diff(np.clip(off[rows[0] : rows[-1] + 2], lo, lo + len(piece)))
        of = np.repeat(np.arange(len(rows), dtype=np.int32) * 9, size_in) + _KIND[piece]
        kinds[rows] += np.bincount(of, minlength=9 * len(rows)).reshape(-1, 9)
        low = LOWER[piece]
        # closing marks do not belong to the word
        end = we.copy()
        for _ in range(2):
            end = end - ((end - ws > 1) & closing[low[end - 1]] if len(end) else np.zeros(0, bool))
        hashes.append(range_hashes(prefix_sums(BYTE_CODE[low]), ws, end))
        docs.append(np.searchsorted(off, ws + lo, "right") - 1)
        lengths.append((we - ws).astype(float))
    h, doc, length = np.concatenate(hashes), np.concatenate(docs), np.concatenate(lengths)
    shares = kinds / np.maximum(size, 1)[:, None]
    upper, lower, digits, symbols, bangs, bars, high, space = shares[:, 1:].T
    n_words = np.bincount(doc, minlength=n).astype(float)
    mean = np.bincount(doc, weights=length, minlength=n) / np.maximum(n_words, 1)
    spread = np.sqrt(np.maximum(np.bincount(doc, weights=length**2, minlength=n) / np.maximum(n_words, 1) - mean**2, 0))
    stops = np.bincount(doc, weights=np.isin(h, _STOPS), minlength=n)
    distinct, top, _ = _counts(doc, h, n)
    if len(h) >= 3:
        at = np.arange(len(h) - 2)
        at = at[doc[at] == doc[at + 2]]
        seq = prefix_sums(h)
        _, _, again = _counts(doc[at], range_hashes(seq, at, at + 3), n)
        windows = np.bincount(doc[at], minlength=n)
    else:
        again = windows = np.zeros(n)
    ldoc, line = _lines(raw, off)
    lines, _, same = _counts(ldoc, line, n)
    n_lines = np.bincount(ldoc, minlength=n).astype(float)
    w1 = np.maximum(n_words, 1)
    return np.column_stack(
        [np.log1p(size), np.log1p(n_words), mean, spread, np.log1p(n_lines), n_words / np.maximum(n_lines, 1), upper, lower, digits, symbols, bangs, bars, stops / w1, high, same / np.maximum(n_lines, 1), distinct / w1, top / w1, again / np.maximum(windows, 1), space]
    ).astype(np.float32)


class BoostedTrees:
    """Boosted trees of one depth for a yes or no, as flat arrays."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH):
        self.depth = depth
        n, width = x.shape
        self.bias = 0.0
        inner = (1 << depth) - 1
        self.feature = np.zeros((0, inner), np.int32)
        self.threshold = np.zeros((0, inner), np.float32)
        self.leaf = np.zeros((0, 1 << depth), np.float32)
        if not n or y.min() == y.max():
            if n:
                self.bias = 4.0 if y[0] else -4.0
            return
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])).astype(np.float32) for f in range(width)]
        binned = np.column_stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)]).astype(np.int64)
        p = y.mean()
        self.bias = float(np.log(p / (1 - p)))
        raw = np.full(n, self.bias)
        feats, thrs, leaves = [], [], []
        columns = np.arange(width) * BINS
        for _ in range(trees):
            prob = 1 / (1 + np.exp(-raw))
            g, h = prob - y, prob * (1 - prob)
            node = np.zeros(n, np.int64)
            feature, threshold = np.zeros(inner, np.int32), np.full(inner, np.inf, np.float32)
            for level in range(depth):
                first, many = (1 << level) - 1, 1 << level
                key = ((node - first)[:, None] * (width * BINS) + columns + binned).ravel()
                shape = (many, width, BINS)
                gs = np.bincount(key, np.repeat(g, width), many * width * BINS).reshape(shape).cumsum(2)
                hs = np.bincount(key, np.repeat(h, width), many * width * BINS).reshape(shape).cumsum(2)
                ns = np.bincount(key, minlength=many * width * BINS).reshape(shape).cumsum(2)
                gt, ht, nt = gs[..., -1:], hs[..., -1:], ns[..., -1:]
                gain = gs**2 / (hs + L2) + (gt - gs) ** 2 / (ht - hs + L2) - gt**2 / (ht + L2)
                gain[(ns < LEAST) | (nt - ns < LEAST)] = 0
                best = gain.reshape(many, -1).argmax(1)
                worth = gain.reshape(many, -1).max(1) > 1e-6
                for v in np.flatnonzero(worth):
                    f, b = divmod(int(best[v]), BINS)
                    if b < len(edges[f]):
                        feature[first + v], threshold[first + v] = f, edges[f][b]
                node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
            at = node - inner
            gl, hl = np.bincount(at, g, 1 << depth), np.bincount(at, h, 1 << depth)
            leaf = -RATE * gl / (hl + L2)
            raw += leaf[at]
            feats.append(feature)
            thrs.append(threshold)
            leaves.append(leaf.astype(np.float32))
        self.feature, self.threshold, self.leaf = np.array(feats), np.array(thrs), np.array(leaves)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of yes for each row: all trees step down together, one level at a time."""
        n, t = len(x), len(self.feature)
        if not t:
            return np.full(n, 1 / (1 + np.exp(-self.bias)))
        tree = np.arange(t)[None, :]
        node = np.zeros((n, t), np.int64)
        row = np.arange(n)[:, None]
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[row, self.feature[tree, node]] > self.threshold[tree, node])
        raw = self.bias + self.leaf[tree, node - ((1 << self.depth) - 1)].astype(np.float64).sum(1)
        return 1 / (1 + np.exp(-raw))


_FLOATS = T.ArrayType(T.FloatType(), False)


def _statistics_frame(rows: DataFrame) -> DataFrame:
    """Rows of (text, label) as (x, label)."""

    def run(batches):
        for batch in batches:
            data, offsets, _ = buffers(batch.column(0))
            for i, j in slices(offsets):
                x = statistics(data, offsets[i : j + 1])
                flat = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1, dtype=np.int32) * len(FEATURES)), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([flat, batch.column(1)[i:j]], names=["x", "label"])

    return rows.mapInArrow(run, T.StructType([T.StructField("x", _FLOATS), T.StructField("label", T.IntegerType())]))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> BoostedTrees:
    """Fit on the labelled rows of `labels` (doc_id, label) whose texts are in `docs`, at most sample_rows of them."""
    picked = labels.where(F.col("doc_id").isNotNull() & F.col("label").isNotNull()).groupBy("doc_id").agg(F.min("label").cast("int").alias("label"))
    picked = picked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    # sample_rows ids at most, 12 bytes each: small enough to broadcast whatever the corpus
    rows = id_text(docs).join(F.broadcast(picked), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("text", "label")
    got = _statistics_frame(rows).collect()
    x = np.array([r.x for r in got], np.float32).reshape(len(got), len(FEATURES))
    y = np.array([r.label for r in got], float)
    order = np.lexsort((y, *x.T))  # the same trees however the rows arrive
    return BoostedTrees(x[order], y[order])


def score(docs: DataFrame, model: BoostedTrees, keep: list[str] | None = None) -> DataFrame:
    """doc_id (or the columns `keep`), score and predicted for each row."""
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").cast("string").alias("__text")) if keep else id_text(docs)
    fields = [f for f in rows.schema.fields][:-1]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*fields, T.StructField("score", T.DoubleType(), False), T.StructField("predicted", T.IntegerType(), False)])

    def run(batches):
        for batch in batches:
            data, offsets, _ = buffers(batch.column(batch.num_columns - 1))
            for i, j in slices(offsets):
                s = shared.value.score(statistics(data, offsets[i : j + 1]))
                own = [batch.column(c)[i:j] for c in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=schema.names)

    return rows.mapInArrow(run, schema)
