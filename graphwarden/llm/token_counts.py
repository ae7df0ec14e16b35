"""Edit-aware token counts.

Each document has a segment tree over blocks of pre-tokens; a node holds the code points and tokens
below it. An edit finds its blocks by descending the tree, re-encodes the touched pre-tokens with
boundary context (two pre-tokens before, and after it as many as it takes until the new cut meets
an old one), and updates the sums on the paths to the root. Nothing else is encoded again.

Added tokens of the vocabulary are pre-tokens of their own, as in the library.

Rows: null and empty texts have no tokens, and edits of them act on the empty text; positions beyond
the end mean the end; repeated doc_ids are documents of their own; a null doc_id passes through.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from graphwarden.llm import bpe
from graphwarden.llm.packing import SLICE_CHARS
from graphwarden.llm.textbatch import id_text

#: Pre-tokens of a block, and the size at which a block that has grown makes the tree be built anew.
BLOCK, FULL = 32, 256
#: Pre-tokens of context that are encoded again before an edit, and that count as open at the end of a piece: a match
#: looks two code points ahead at most, and an added token that an edit makes or breaks holds three plain pre-tokens.
BEFORE = 6

Edit = tuple[int, int, str]


class TokenTree:
    """Pre-token counts of one text under edits."""

    def __init__(self, enc: bpe.Encoder, text: str, lengths: list[int], counts: list[int]):
        self.enc, self.text, self.reencoded = enc, text, 0
        self._build(lengths, counts)

    def _build(self, lengths: list[int], counts: list[int]) -> None:
        self.blocks = [(lengths[i : i + BLOCK], counts[i : i + BLOCK]) for i in range(0, len(lengths), BLOCK)] or [([], [])]
        self.size = 1 << (len(self.blocks) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.size), [0] * (2 * self.size)
        for b, (ln, ct) in enumerate(self.blocks):
            self.chars[self.size + b], self.tokens[self.size + b] = sum(ln), sum(ct)
        for v in range(self.size - 1, 0, -1):
            self.chars[v] = self.chars[2 * v] + self.chars[2 * v + 1]
            self.tokens[v] = self.tokens[2 * v] + self.tokens[2 * v + 1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    def _block_at(self, pos: int) -> tuple[int, int]:
        """The block with code point `pos` (the last with any, at the end), and where it starts."""
        v, start = 1, 0
        pos = min(pos, max(0, self.chars[1] - 1))
        while v < self.size:
            v *= 2
            if pos - start >= self.chars[v]:
                start += self.chars[v]
                v += 1
        return v - self.size, start

    def _update(self, b: int) -> None:
        v = self.size + b
        self.chars[v], self.tokens[v] = sum(self.blocks[b][0]), sum(self.blocks[b][1])
        while v > 1:
            v //= 2
            self.chars[v] = self.chars[2 * v] + self.chars[2 * v + 1]
            self.tokens[v] = self.tokens[2 * v] + self.tokens[2 * v + 1]

    def edit(self, start: int, stop: int, new: str) -> None:
        """Put `new` in place of text[start:stop]."""
        size = len(self.text)
        start = min(max(0, start), size)
        stop = min(max(start, stop), size)
        text = self.text[:start] + new + self.text[stop:]
        shift = len(new) - (stop - start)
        # pre-tokens from the first that can change
        first, at = self._block_at(start)
        while first > 0 and (at > start or self._ends_before(first, at, start) < BEFORE):
            first -= 1
            at -= self.chars[self.size + first]
        lo, skip = at, 0
        ends = []
        pos = at
        for n in self.blocks[first][0]:
            pos += n
            ends.append(pos)
        skip = max(0, sum(e <= start for e in ends) - BEFORE)
        if start == size and ends and ends[-1] == size:
            skip = max(0, len(ends) - 1 - BEFORE)
        lo = at + sum(self.blocks[first][0][:skip])
        # old pre-tokens after it, block by block, until the new cut meets an old one for good
        last, old_end = first, at + self.chars[self.size + first]
        while True:
            done = last + 1 >= len(self.blocks)
            if old_end >= stop or done:
                piece = text[lo : old_end + shift] if old_end >= stop else text[lo:]
                cut, new_counts = self.enc.few(piece)
                met = self._meet(first, last, at, skip, lo, cut, stop, shift, done)
                if met is not None:
                    break
            last += 1
            old_end += self.chars[self.size + last]
        upto, old_kept = met  # new pre-tokens that are taken, and the old ones of the blocks kept behind them
        counts = new_counts[:upto]
        bounds = [*cut, len(piece)]
        lengths = [bounds[i + 1] - bounds[i] for i in range(upto)]
        self.reencoded += bounds[upto]
        ln = self.blocks[first][0][:skip] + lengths + old_kept[0]
        ct = self.blocks[first][1][:skip] + counts + old_kept[1]
        self.text = text
        self.blocks[first] = (ln, ct)
        for b in range(first + 1, last + 1):
            self.blocks[b] = ([], [])
        if len(ln) > FULL:
            every = [([*x], [*y]) for x, y in self.blocks]
            self._build([n for x, _ in every for n in x], [n for _, y in every for n in y])
        else:
            for b in range(first, last + 1):
                self._update(b)

    def _ends_before(self, b: int, at: int, start: int) -> int:
        n = 0
        for x in self.blocks[b][0]:
            at += x
            n += at <= start
        return n

    def _meet(self, first, last, at, skip, lo, cut, stop, shift, done):
        """(new pre-tokens up to the meeting point, old pre-tokens behind it), or None if the piece is too short to tell."""
        old_ln = [n for b in range(first, last + 1) for n in self.blocks[b][0]]
        old_ct = [n for b in range(first, last + 1) for n in self.blocks[b][1]]
        pos, begins = at, []
        for n in old_ln:
            begins.append(pos)
            pos += n
        new = {c + lo - shift: i for i, c in enumerate(cut)}
        safe = len(cut) if done else len(cut) - BEFORE  # the last cuts may move when more text follows
        for k in range(skip, len(begins)):
            i = new.get(begins[k])
            if begins[k] >= stop and i is not None and i < safe:
                return i, (old_ln[k:], old_ct[k:])
        return (len(cut), ([], [])) if done else None


SCHEMA = T.StructType([T.StructField("doc_id", T.LongType())] + [T.StructField(n, T.LongType(), False) for n in ("n_chars", "n_pretokens", "n_tokens", "n_chars_edited", "n_tokens_edited", "n_reencoded")])


def trees(enc: bpe.Encoder, texts: list[str]) -> list[TokenTree]:
    """A tree for each text; the texts are encoded together, but for those with added tokens."""
    lengths = np.array([len(t) for t in texts], np.int64)
    rows, starts = enc.rows("".join(texts), lengths)
    ends = np.cumsum(lengths)
    doc = np.searchsorted(ends, starts, "right")
    first = np.searchsorted(doc, np.arange(len(texts) + 1))
    counts = enc.token_counts(rows).tolist()
    sizes = np.diff(np.append(starts, ends[-1] if len(ends) else 0)).tolist()
    out = []
    for d, t in enumerate(texts):
        own, n = sizes[first[d] : first[d + 1]], counts[first[d] : first[d + 1]]
        if any(x in t for x in enc.added):
            cut, n = enc.few(t)
            own = [b - a for a, b in zip(cut, [*cut[1:], len(t)], strict=True)]
        out.append(TokenTree(enc, t, own, n))
    return out


def revise(text: str) -> list[Edit]:
    """The stated edits of the query: the first line feed becomes a space, a note goes into the middle, the last 20 code points go."""
    n, feed = len(text), text.find("\n")
    edits = [(feed, feed + 1, " ")] if feed >= 0 else []
    return [*edits, (n // 2, n // 2, " [note: 2 words]"), (n + 16 - 20 if n > 20 else 0, n + 16, "")]


def count_tokens(docs: DataFrame, edits: Callable[[str], list[Edit]] = revise, vocabulary: str | None = None) -> DataFrame:
    """Tokens of every text, and after its edits (given one after another, each on the text as it then is)."""
    path = vocabulary or bpe.default_vocabulary()

    def run(batches):
        enc = bpe.encoder(path)
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1)
            i = 0
            while i < len(doc_ids):
                part, chars = [], 0
                while i + len(part) < len(doc_ids) and (not part or chars < SLICE_CHARS):
                    part.append(texts[i + len(part)].as_py() or "")
                    chars += len(part[-1])
                rows = []
                for doc_id, text, tree in zip(doc_ids[i : i + len(part)], part, trees(enc, part), strict=True):
                    before = (len(text), sum(len(x) for x, _ in tree.blocks), tree.n_tokens)
                    for e in edits(text):
                        tree.edit(*e)
                    rows.append((doc_id, *before, len(tree.text), tree.n_tokens, tree.reencoded))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=SCHEMA.names)
                i += len(part)

    return id_text(docs).mapInArrow(run, SCHEMA)
