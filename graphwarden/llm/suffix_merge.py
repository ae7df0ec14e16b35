"""Sorted suffix runs: front coding, and merging by a loser tree that knows common prefixes."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import zstandard

#: Keys of one compressed chunk of a run; a run being read holds one chunk decoded.
CHUNK = 512

_coder = zstandard.ZstdCompressor(level=1)
_decoder = zstandard.ZstdDecompressor()


def common(a: bytes, b: bytes, start: int = 0) -> int:
    """Length of the common prefix of a and b, the first `start` bytes of which are known to agree."""
    end = min(len(a), len(b))
    if a[start:end] == b[start:end]:
        return end
    step = 8
    while a[start : start + step] == b[start : start + step]:
        start += step
    while a[start] == b[start]:
        start += 1
    return start


def front_code(keys: list[bytes], payload: list[tuple]) -> bytes:
    """A sorted run as one blob of compressed chunks: of each key only what its predecessor lacks."""
    chunks = []
    last = b""
    for i in range(0, len(keys), CHUNK):
        shared, rest = [], []
        for key in keys[i : i + CHUNK]:
            n = common(last, key)
            shared.append(n)
            rest.append(key[n:])
            last = key
        chunks.append(_coder.compress(pickle.dumps((shared, rest, payload[i : i + CHUNK]), protocol=5)))
    return pickle.dumps(chunks, protocol=5)


class Run:
    """A front-coded run being read: the key at hand and what it shares with the one before."""

    __slots__ = ("chunks", "next", "shared", "rest", "payload", "at", "key")

    def __init__(self, blob: bytes):
        self.chunks, self.next = pickle.loads(blob), 0
        self.shared = self.rest = self.payload = ()
        self.at, self.key = -1, b""

    def step(self) -> int:
        """Go to the next key; what it shares with the last one, or -1 at the end."""
        self.at += 1
        if self.at >= len(self.rest):
            if self.next >= len(self.chunks):
                self.key = None
                return -1
            self.shared, self.rest, self.payload = pickle.loads(_decoder.decompress(self.chunks[self.next]))
            self.chunks[self.next] = None
            self.next += 1
            self.at = 0
        n = self.shared[self.at]
        self.key = self.key[:n] + self.rest[self.at]
        return n


def merged(blobs: list[bytes]) -> Iterator[tuple[bytes, int, tuple]]:
    """(key, prefix shared with the key before, payload) of all runs in order.

    Every loser keeps the length it shares with the last key that came out. A challenger that shares
    more than it precedes it, one that shares less follows it, and only at a tie are bytes compared,
    from that length on. So no byte of a known common prefix is looked at again.
    """
    runs = [Run(b) for b in blobs]
    size = 1
    while size < len(runs):
        size *= 2
    # a player is (run number, shared with the last output); -1 shared: exhausted, loses to all
    players = [(i, runs[i].step() if i < len(runs) else -1) for i in range(size)]
    tree: list[tuple[int, int]] = [(-1, -1)] * size

    def play(a: tuple[int, int], b: tuple[int, int]) -> tuple[tuple[int, int], tuple[int, int]]:
        """(winner, loser)"""
        if a[1] != b[1]:
            return (a, b) if a[1] > b[1] else (b, a)
        if a[1] < 0:
            return a, b
        x, y = runs[a[0]].key, runs[b[0]].key
        n = common(x, y, a[1])
        if n == len(x) or (n < len(y) and x[n] < y[n]):
            return a, (b[0], n)
        return b, (a[0], n)

    def build(v: int) -> tuple[int, int]:
        if v >= size:
            return players[v - size]
        win, tree[v] = play(build(2 * v), build(2 * v + 1))
        return win

    winner = build(1)
    while winner[1] >= 0:
        run = runs[winner[0]]
        yield run.key, winner[1], run.payload[run.at]
        v = (winner[0] + size) // 2
        winner = (winner[0], run.step())
        while v:
            winner, tree[v] = play(winner, tree[v])
            v //= 2
