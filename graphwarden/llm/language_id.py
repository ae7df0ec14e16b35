"""Language identification by prediction by partial matching.

For each language a context tree over bytes (orders 0 to `order`) is counted on training texts and
then frozen. The code length of a byte in a language is that of the longest context seen there;
where the byte is new in a context, an escape (method C: d / (n + d) for d distinct followers in n)
goes to the next shorter one, at last to 1 of 256. A text's language is the one with the least code
length, and the score is its posterior for equal priors.

Training texts are a bounded sample: SAMPLE_TEXTS whole texts of each language, the ones with the least hash of
doc_id and text. Executors count them, and the driver gets counts alone. Every gram of the sample is kept for every
language: the trees grow with the sample, that is with the number of languages (labels are taken to be languages).

Languages are taken in blocks of BLOCK by name, each with its own union tree, so a node has places for the languages
of its block alone, whatever their number. Texts are scored as a walk through each union tree: the node of the bytes [i - k, i] is the child, by
byte i, of the node of [i - k, i - 1], so each byte takes one table step for each order and all
languages of the block are summed together. A long text is walked in pieces that carry `order` bytes over.

Rows: a null text, or one without a letter, is `und` with score 0 (also where nothing could be
learned). Ties go to the language that sorts first. Rows that repeat doc_id and text count once in
training and each get a prediction; a null doc_id passes through. Empty tables give no rows. Columns
other than doc_id, text (and lang, in training) are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphwarden.llm.textbatch import buffers, id_text, slices

#: The bound of the training sample: whole texts of each language.
SAMPLE_TEXTS = 400
#: Languages that share a union tree.
BLOCK = 8
#: Hash buckets in which a language's texts are ranked before they are ranked as one.
BUCKETS = 64
#: Tasks that count the sample, which is bounded: each gives its own grams once.
COUNT_TASKS = 8
#: Bytes of training text that are counted at once, and cells (bytes times languages) that are scored at once.
COUNT_BYTES, SCORE_CELLS = 1 << 20, 1 << 20
#: Bytes of training text that a task holds before it gives their counts.
HELD_BYTES = 1 << 25
#: Highest order of the contexts, in bytes.
ORDER = 3
UNKNOWN = "und"

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("lang_pred", T.StringType(), False), T.StructField("score", T.DoubleType(), False), T.StructField("bits", T.DoubleType(), False)])


COUNTS = T.StructType([T.StructField(n, T.LongType(), False) for n in ("lang", "k", "gram", "n")])


def training_sample(docs: DataFrame) -> tuple[list[str], DataFrame]:
    """The languages, and (lang: a number, text) of their sampled whole texts."""
    rows = docs.where(F.col("lang").isNotNull() & (F.length("text") > 0)).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.xxhash64("doc_id", F.col("text").cast("string")).alias("at"))
    # ids alone are ranked, first in buckets of which each task sends its first few on
    near = rows.select("lang", "at", F.dense_rank().over(Window.partitionBy("lang", F.pmod("at", F.lit(BUCKETS))).orderBy("at")).alias("rank")).where(F.col("rank") <= SAMPLE_TEXTS).select("lang", "at").distinct()
    first = near.withColumn("rank", F.dense_rank().over(Window.partitionBy("lang").orderBy("at"))).where(F.col("rank") <= SAMPLE_TEXTS)
    last = first.groupBy("lang").agg(F.max("at").alias("last")).collect()  # a row for each language
    langs = sorted(r.lang for r in last)
    limits = docs.sparkSession.createDataFrame([(r.lang, langs.index(r.lang), r.last) for r in last], "lang string, no long, last long")
    return langs, rows.join(F.broadcast(limits), "lang").where("at <= last").dropDuplicates(["lang", "at"]).select(F.col("no").alias("lang"), "text")


def counted(texts: list[bytes], order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order the grams of the texts (the last byte lowest), and how often each occurs."""
    own, cnt = [np.zeros(0, np.int64)] * (order + 1), [np.zeros(0, np.int64)] * (order + 1)
    parts = [(t[max(0, lo - order) : lo + COUNT_BYTES], min(lo, order)) for t in texts for lo in range(0, len(t), COUNT_BYTES)]  # with the bytes before each
    for i, j in slices(np.cumsum([0] + [len(t) for t, _ in parts]), COUNT_BYTES):
        raw = np.frombuffer(b"".join(t for t, _ in parts[i:j]), np.uint8).astype(np.int64)
        size = np.array([len(t) for t, _ in parts[i:j]])
        depth = np.arange(len(raw)) - np.repeat(np.cumsum(size) - size, size)
        fresh = depth >= np.repeat([h for _, h in parts[i:j]], size)
        gram = np.zeros(len(raw), np.int64)
        for k in range(order + 1):
            gram[k:] += raw[: len(raw) - k] << (8 * k)
            g, c = np.unique(gram[(depth >= k) & fresh], return_counts=True)
            own[k], at = np.unique(np.concatenate([own[k], g]), return_inverse=True)
            total = np.zeros(len(own[k]), np.int64)
            np.add.at(total, at, np.concatenate([cnt[k], c]))
            cnt[k] = total
    return list(zip(own, cnt, strict=True))


def train(docs: DataFrame, order: int = ORDER) -> "Forest":
    """Trees of the training sample of docs (doc_id, text, lang)."""
    langs, sample = training_sample(docs)

    def run(batches):
        held: dict[int, list[bytes]] = {}
        size = 0

        def told():
            for lang, texts in held.items():
                for k, (grams, n) in enumerate(counted(texts, order)):
                    same = np.ones(len(n), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(lang * same), pa.array(k * same), pa.array(grams), pa.array(n)], names=COUNTS.names)
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held.setdefault(lang, []).append(text.as_py().encode())
                size += len(held[lang][-1])
                if size >= HELD_BYTES:
                    yield from told()
                    size = 0
        yield from told()

    counts = sample.coalesce(COUNT_TASKS).mapInArrow(run, COUNTS).groupBy("lang", "k", "gram").agg(F.sum("n").alias("n"))
    if len(langs) > BLOCK:
        counts = counts.persist()  # read once for each block
    blocks = []
    for lo in range(0, len(langs), BLOCK):
        own = counts.where(F.col("lang").between(lo, lo + BLOCK - 1)).select(F.col("lang") - lo, "k", "gram", "n").toArrow()  # grams of BLOCK samples at most
        blocks.append(ByteTrees(langs[lo : lo + BLOCK], *(own.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in range(4)), order))
    counts.unpersist()
    return Forest(blocks, order)


class Forest:
    """The blocks of languages, in the order of their names."""

    def __init__(self, blocks: list["ByteTrees"], order: int = ORDER):
        self.blocks, self.order = blocks, order
        self.langs = [lang for b in blocks for lang in b.langs]

    def bits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code length of each document in each language."""
        return np.concatenate([np.zeros((len(offsets) - 1, 0)), *(b.bits(data, offsets) for b in self.blocks)], axis=1)


class ByteTrees:
    """Union tree of the languages' contexts with frozen costs.

    step[k][node * width + byte class] is a node of order k, 0 if none; seen[k][node] is the code
    length of its last byte in each language (escapes included where a language lacks it), and
    escape[k][node] what a language pays when the next byte is new there.
    """

    def __init__(self, langs: list[str], lang: np.ndarray, k_of: np.ndarray, gram: np.ndarray, n_of: np.ndarray, order: int = ORDER):
        """langs, and rows of (number of the language, order, gram, occurrences)."""
        self.langs, self.order = langs, order
        every = np.zeros(256, bool)
        every[gram[k_of == 0]] = True
        self.classes = np.zeros(256, np.int32)  # 0: a byte that no language has
        self.classes[every] = 1 + np.arange(every.sum())
        self.width = int(every.sum()) + 1
        n_lang = len(langs)
        key = np.zeros(len(gram), np.int64)
        for j in range(order + 1):
            key += np.where(k_of >= j, self.classes[(gram >> (8 * j)) & 255] * np.int64(self.width) ** j, 0)
        grams: list[list[np.ndarray]] = []
        counts: list[list[np.ndarray]] = []
        for j in range(n_lang):
            rows = [np.flatnonzero((lang == j) & (k_of == k)) for k in range(order + 1)]
            rows = [r[np.argsort(key[r])] for r in rows]
            grams.append([key[r] for r in rows])
            counts.append([n_of[r] for r in rows])
        self.step, self.seen, self.escape = [], [], []
        lower_keys, lower_seen = np.zeros(1, np.int64), np.full((1, n_lang), 8.0)
        shorter_seen = None
        for k in range(order + 1):
            keys = np.unique(np.concatenate([g[k] for g in grams])) if n_lang else np.zeros(0, np.int64)
            n = len(keys)
            context = keys // self.width  # the gram without its last byte: a node of order k - 1
            at_context = np.zeros(n, np.int64) if k == 0 else np.searchsorted(lower_keys, context)
            total = np.zeros((len(lower_keys), n_lang))
            kinds = np.zeros((len(lower_keys), n_lang))
            count = np.zeros((n, n_lang))
            for j in range(n_lang):
                at = np.searchsorted(keys, grams[j][k])
                count[at, j] = counts[j][k]
                np.add.at(total[:, j], at_context[at], counts[j][k])
                np.add.at(kinds[:, j], at_context[at], 1)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, np.log2((total + kinds) / np.maximum(kinds, 1)), 0.0)
                cost = np.log2((total + kinds)[at_context] / count)
            if k == 0:
                below = np.full((n, n_lang), 8.0)
            else:  # the gram without its first byte is a node of order k - 1 too
                below = lower_seen[np.searchsorted(lower_keys, keys % self.width**k)]
            seen = np.where(count > 0, cost, escape[at_context] + below)
            self.escape.append(self._padded(escape) if k else np.vstack([escape, escape]).astype(np.float32))
            self.seen.append(self._padded(seen))
            step = np.zeros((len(lower_keys) + 1) * self.width, np.int32)
            step[(at_context + 1) * self.width + keys % self.width] = 1 + np.arange(n)
            self.step.append(step)
            lower_keys, lower_seen = keys, seen

    @staticmethod
    def _padded(x: np.ndarray) -> np.ndarray:
        return np.vstack([np.zeros((1, x.shape[1])), x]).astype(np.float32)

    def bits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code length of each document in each language."""
        n, n_lang = len(offsets) - 1, len(self.langs)
        out = np.zeros((n, n_lang))
        if not n_lang:
            return out
        piece = max(1024, SCORE_CELLS // n_lang)
        for i, j in slices(offsets, piece):
            lo, hi = int(offsets[i]), int(offsets[j])
            if hi - lo <= piece:
                starts, full = offsets[i:j] - lo, np.diff(offsets[i : j + 1]) > 0
                if full.any():
                    out[i:j][full] = np.add.reduceat(self._costs(data[lo:hi], starts[full]), starts[full], axis=0, dtype=np.float64)
                continue
            for a in range(lo, hi, piece):  # one long document
                before = min(self.order, a - lo)
                out[i] += self._costs(data[a - before : min(a + piece, hi)], np.zeros(1, np.int64))[before:].sum(0, dtype=np.float64)
        return out

    def _costs(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Code length of each byte in each language; documents begin at `starts`."""
        cls = self.classes[data]
        cost = np.empty((len(data), len(self.langs)), np.float32)
        node = self.step[0][self.width + cls]
        cost[:] = np.where((node > 0)[:, None], self.seen[0][node], self.escape[0][1] + np.float32(8.0))
        for k in range(1, self.order + 1):
            before = np.zeros(len(data), np.int32)
            before[1:] = node[:-1]
            before[starts] = 0  # no context reaches into the document before
            node = self.step[k][before * self.width + cls]
            new = np.flatnonzero((node == 0) & (before > 0))
            if len(new):
                cost[new] += self.escape[k][before[new]]
            hit = np.flatnonzero(node)
            if 2 * len(hit) > len(node):
                np.copyto(cost, self.seen[k].take(node, 0), where=(node > 0)[:, None])
            else:
                cost[hit] = self.seen[k][node[hit]]
        return cost


_LETTER = regex.compile(r"\p{L}")


def predict(docs: DataFrame, trees: Forest) -> DataFrame:
    """doc_id, lang_pred, score and the least code length of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches):
        model = shared.value
        names = np.array([*model.langs, UNKNOWN], object)
        for batch in batches:
            data, offsets, _ = buffers(batch.column(1))
            texts = batch.column(1)
            for i, j in slices(offsets, 1 << 16):
                bits = model.bits(data, offsets[i : j + 1])
                letters = np.fromiter((bool(_LETTER.search(texts[r].as_py() or "")) for r in range(i, j)), bool, j - i)
                if not model.langs:
                    letters[:] = False
                    bits = np.zeros((j - i, 1))
                best = bits.argmin(1)
                least = bits.min(1)
                score = np.where(letters, 1.0 / np.exp2(np.maximum(least[:, None] - bits, -1000.0)).sum(1), 0.0)
                best = np.where(letters, best, len(names) - 1)
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(names[best].tolist(), pa.string()), pa.array(score), pa.array(np.where(letters, least, 0.0))], names=SCHEMA.names)

    return id_text(docs).mapInArrow(run, SCHEMA)


def identify(spark: SparkSession, docs: DataFrame, learn: DataFrame) -> DataFrame:
    """Learn from `learn` (doc_id, text, lang), predict `docs`."""
    return predict(docs, train(learn))
