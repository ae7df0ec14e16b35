"""Byte-level BPE over whole Arrow batches.

The vocabulary file is the one of the `tokenizers` library. A text falls into pre-tokens by
letters, numbers, other marks and white space; the ids of a pre-token never depend on its
neighbours. So each slice of text is cut by numpy, distinct pre-tokens are looked up by a hash,
and only pre-tokens not met before go through the merges. The file's added tokens are found in a
text before it is cut, the longest of those that begin at a place, as the library does by default;
each has its one id.
"""

from __future__ import annotations

import json

import numpy as np
import regex

from graphwarden.llm.textbatch import mix, prefix_sums, range_hashes

#: Fixed values of the byte-level scheme: the cut of texts, and the endings after an apostrophe.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3

#: Pre-tokens that one Python worker remembers before it starts anew (about 60 MB).
REMEMBERED = 400_000

_pattern = regex.compile(PATTERN)
_classes: np.ndarray | None = None


def char_classes() -> np.ndarray:
    """The class of every code point."""
    global _classes
    if _classes is None:
        table = np.zeros(0x110000, np.uint8)
        for lo, hi in ((0, 0xD800), (0xE000, 0x110000)):
            every = "".join(map(chr, range(lo, hi)))
            for what, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", SPACE)):
                for m in regex.finditer(what, every):
                    table[lo + m.start() : lo + m.end()] = kind
        _classes = table
    return _classes


def pretoken_starts(points: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin in joined texts (code points); `text_starts` are the non-empty texts' first points."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = char_classes()[points]
    edge = np.zeros(n, bool)
    edge[text_starts] = True
    start = edge.copy()
    start[1:] |= kind[1:] != kind[:-1]
    run = np.flatnonzero(start)
    run_end = np.append(run[1:], n)
    closes = np.zeros(n + 1, bool)
    closes[text_starts] = True
    closes[n] = True
    # the last white space before a text's next run stands alone, or goes with that run if it is U+0020
    inner = (kind[run] == SPACE) & ~closes[run_end]
    last = run_end[inner] - 1
    start[last] = True
    joined = last[points[last] == 0x20] + 1
    start[joined] = False
    # 's 't 're 've 'm 'll 'd where a match begins at the apostrophe
    mark = np.flatnonzero((points == 0x27) & start)
    for p in mark:
        tail = "".join(map(chr, points[p + 1 : p + 3].tolist()))
        if p + 1 < n and edge[p + 1]:
            continue
        if p + 2 < n and edge[p + 2]:
            tail = tail[:1]
        k = next((len(e) for e in ENDINGS if tail.startswith(e)), 0)
        if k:
            start[p + 1] = False
            if p + 1 + k < n:
                start[p + 1 + k] = True
    return np.flatnonzero(start)


class Encoder:
    """ids of whole texts, by the vocabulary file at `path`."""

    def __init__(self, path: str):
        import tiktoken

        file = json.load(open(path, encoding="utf-8"))
        model = file["model"]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(plain)]
        code = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
        vocab = {}
        for token, number in model["vocab"].items():
            if all(c in code for c in token):
                vocab[bytes(code[c] for c in token)] = number
        self.added = {}
        for token in file.get("added_tokens", ()):
            if token["lstrip"] or token["rstrip"] or token["single_word"] or token["normalized"]:
                raise ValueError(f"an added token that looks at its neighbours: {token['content']!r}")
            self.added[token["content"]] = token["id"]
            vocab.pop(token["content"].encode(), None)
        self._split = regex.compile("|".join(regex.escape(x) for x in sorted(self.added, key=len, reverse=True))) if self.added else None
        self._enc = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=vocab, special_tokens={})
        self._feed = vocab[b"\n"]
        self._forget()

    def _forget(self):
        self._keys = np.zeros(0, np.uint64)  # sorted hashes of known pre-tokens
        self._rows = np.zeros(0, np.int64)
        self._n = np.zeros(0, np.int64)
        self._at = np.zeros(0, np.int64)
        self._ids = np.zeros(0, np.uint32)

    def _learn(self, keys: np.ndarray, pieces: list[str]) -> None:
        """Remember the ids of new pre-tokens. All but white space stay whole between line feeds, so one call encodes them."""
        blank = np.fromiter(map(str.isspace, pieces), bool, len(pieces))
        order = np.argsort(blank, kind="stable")
        n = np.zeros(len(pieces), np.int64)
        parts = []
        if not blank.all():
            ids = np.array(self._enc.encode_ordinary("\n".join(p for p, b in zip(pieces, blank.tolist(), strict=True) if not b)), np.uint32)
            feeds = np.flatnonzero(ids == self._feed)
            n[~blank] = np.diff(np.concatenate([[-1], feeds, [len(ids)]])) - 1
            parts.append(ids[ids != self._feed])
        for i in np.flatnonzero(blank).tolist():
            parts.append(np.array(self._enc.encode_ordinary(pieces[i]), np.uint32))
            n[i] = len(parts[-1])
        at = np.empty(len(n), np.int64)
        at[order] = len(self._ids) + np.cumsum(n[order]) - n[order]
        where = np.searchsorted(self._keys, keys)
        self._rows = np.insert(self._rows, where, len(self._n) + np.arange(len(n)))
        self._keys = np.insert(self._keys, where, keys)
        self._n, self._at, self._ids = np.concatenate([self._n, n]), np.concatenate([self._at, at]), np.concatenate([self._ids, *parts])

    def rows(self, joined: str, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row of each pre-token in this encoder's memory, and where each begins; good until the next call. lengths: of the joined texts, in code points."""
        if len(self._keys) > REMEMBERED:
            self._forget()
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum(lengths)
        begin = (ends - lengths)[lengths > 0]
        starts = pretoken_starts(points, begin)
        if not len(starts):
            return starts, starts
        stops = np.append(starts[1:], len(points))
        h = range_hashes(prefix_sums(mix(points)), starts, stops)
        keys, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        at = np.searchsorted(self._keys, keys)
        new = np.ones(len(keys), bool)
        new[at < len(self._keys)] = self._keys[at[at < len(self._keys)]] != keys[at < len(self._keys)]
        if new.any():
            lo, hi = starts[first[new]].tolist(), stops[first[new]].tolist()
            self._learn(keys[new], [joined[i:j] for i, j in zip(lo, hi, strict=True)])
            at = np.searchsorted(self._keys, keys)
        return self._rows[at][inverse], starts

    def plain(self, text: str) -> list[tuple[int, int, int]]:
        """(start, end, id) of a text's parts: added tokens, and what lies between them with id -1."""
        if not any(x in text for x in self.added):
            return [(0, len(text), -1)]
        out, at = [], 0
        for m in self._split.finditer(text):
            if m.start() > at:
                out.append((at, m.start(), -1))
            out.append((m.start(), m.end(), self.added[m.group()]))
            at = m.end()
        if at < len(text):
            out.append((at, len(text), -1))
        return out

    def texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of whole texts, joined, and how many each has."""
        parts, owner, after = [], [], []  # plain parts, their texts, and the added tokens (text, plain parts before, id)
        for d, text in enumerate(texts):
            for lo, hi, added in self.plain(text):
                if added < 0:
                    parts.append(text[lo:hi])
                    owner.append(d)
                else:
                    after.append((d, len(parts), added))
        lengths = np.array([len(p) for p in parts], np.int64)
        rows, starts = self.rows("".join(parts), lengths)
        part = np.searchsorted(np.cumsum(lengths), starts, "right")
        own = np.bincount(part, weights=self.token_counts(rows), minlength=len(parts)).astype(np.int64)
        ids = self.ids(rows)
        counts = np.bincount(np.array(owner, np.int64), weights=own, minlength=len(texts)).astype(np.int64)
        if after:
            before = np.concatenate([[0], np.cumsum(own)])
            ids = np.insert(ids, before[[n for _, n, _ in after]], [i for _, _, i in after])
            counts += np.bincount([d for d, _, _ in after], minlength=len(texts))
        return ids, counts

    def few(self, text: str) -> tuple[list[int], list[int]]:
        """Where the pre-tokens of a short text begin, and how many tokens each has; an added token is one of its own."""
        starts, counts = [], []
        for lo, hi, added in self.plain(text):
            if added >= 0:
                starts.append(lo)
                counts.append(1)
                continue
            for m in _pattern.finditer(text[lo:hi]):
                starts.append(lo + m.start())
                counts.append(len(self._enc.encode_ordinary(m.group())))
        return starts, counts

    def token_counts(self, rows: np.ndarray) -> np.ndarray:
        return self._n[rows]

    def ids(self, rows: np.ndarray) -> np.ndarray:
        """The ids of those pre-tokens, joined."""
        n = self._n[rows]
        total = int(n.sum())
        begin = np.repeat(self._at[rows] - (np.cumsum(n) - n), n)
        return self._ids[begin + np.arange(total)]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each vocabulary in a worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))
