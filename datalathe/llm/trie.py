"""A compact trie of bigrams in Elias-Fano code.

Level 1 holds the contexts, level 2 the successors of each context. All
sequences are monotone: context ids, pointers into level 2, and successors
counted on from rank(context) * universe, so that a search for a successor is
relative to its context. Probabilities are 8-bit codes into a codebook. A trie
is one flat buffer that can be mapped into memory and is read in place."""

from __future__ import annotations

import numpy as np

MAGIC = 0x45465452494531
#: How many bits of a byte are set, and where its k-th one is.
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
COUNT = BITS.sum(axis=1, dtype=np.uint8)
PLACE = np.argsort(1 - BITS, axis=1, kind="stable").astype(np.uint8)


def _pad(parts: list[np.ndarray]) -> bytes:
    """Arrays one after another, each after its length in bytes, at multiples of eight."""
    out = []
    for p in parts:
        raw = np.ascontiguousarray(p).tobytes()
        out.append(np.array([len(raw)], "<u8").tobytes() + raw + b"\0" * (-len(raw) % 8))
    return b"".join(out)


class EliasFano:
    """A non-decreasing sequence of n integers below a universe: low bits packed, high bits in unary."""

    def __init__(self, head: np.ndarray, low: np.ndarray, high: np.ndarray, zeros: np.ndarray, ones: np.ndarray):
        self.n, self.bits = int(head[0]), int(head[1])
        self.low, self.high, self.zeros, self.ones = low, high, zeros, ones

    @staticmethod
    def parts(values: np.ndarray, universe: int) -> list[np.ndarray]:
        n = len(values)
        bits = max(0, (universe // max(1, n)).bit_length() - 1)
        values = values.astype(np.uint64)
        packed = np.zeros(0, np.uint8)
        if bits:  # a multiple of eight values ends at a byte
            planes = [(values[a:a + (1 << 16), None] >> np.arange(bits, dtype=np.uint64) & np.uint64(1)).astype(np.uint8) for a in range(0, n, 1 << 16)]
            packed = np.concatenate([np.packbits(x.reshape(-1), bitorder="little") for x in planes])
        low = np.frombuffer(packed.tobytes() + b"\0" * (-len(packed) % 8 + 8), "<u8")
        place = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        size = int(universe >> bits) + n + 2
        flags = np.zeros(-(-size // 64) * 64, np.uint8)
        flags[place] = 1
        high = np.frombuffer(np.packbits(flags, bitorder="little").tobytes(), "<u8")
        ones = np.concatenate(([0], np.cumsum(flags.reshape(-1, 64).sum(axis=1))))[:-1].astype("<u4")
        zeros = (np.arange(len(high)) * 64 - ones).astype("<u4")
        return [np.array([n, bits], "<u8"), low, high, zeros, ones]

    def _select(self, rank: np.ndarray, k: np.ndarray, flip: bool) -> np.ndarray:
        """Place of the k-th one (or zero) of the high bits."""
        out = np.empty(len(k), np.int64)
        for a in range(0, len(k), 1 << 15):
            own = k[a:a + (1 << 15)]
            word = np.searchsorted(rank, own, "right") - 1
            value = self.high[word]
            value = ~value if flip else value
            octets = value.astype("<u8").view(np.uint8).reshape(-1, 8)
            seen, rest, row = np.cumsum(COUNT[octets], axis=1, dtype=np.uint8), own - rank[word], np.arange(len(own))
            octet = (seen <= rest[:, None]).sum(axis=1)
            inside = octets[row, octet]
            out[a:a + (1 << 15)] = word * 64 + octet * 8 + PLACE[inside, rest - (seen[row, octet] - COUNT[inside])]
        return out

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self._select(self.ones, i, False) - i) << self.bits | self._low(i)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.int64)
        at = i * self.bits
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        value = self.low[word] >> shift
        value |= np.where(shift > 0, self.low[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), 0).astype(np.uint64)
        return (value & ((np.uint64(1) << np.uint64(self.bits)) - np.uint64(1))).astype(np.int64)

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Place of the first value >= x (n if there is none)."""
        top = x >> self.bits
        start = np.where(top > 0, self._select(self.zeros, np.maximum(top - 1, 0), True) - np.maximum(top - 1, 0), 0)
        end = self._select(self.zeros, top, True) - top  # values with a high part up to top
        want = x & ((1 << self.bits) - 1)
        live = np.flatnonzero(start < end)
        while len(live):
            live = live[self._low(start[live]) < want[live]]
            start[live] += 1
            live = live[start[live] < end[live]]
        return start


def quantise(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """8-bit codes and a codebook of the means of 256 equally wide bins, so no error exceeds a bin's width."""
    if not len(values):
        return np.zeros(0, np.uint8), np.zeros(256, "<f4")
    edges = np.linspace(values.min(), values.max(), 257)[1:-1]
    codes = np.searchsorted(edges, values, "left").astype(np.uint8)
    n = np.bincount(codes, minlength=256)
    return codes, (np.bincount(codes, values, 256) / np.maximum(n, 1)).astype("<f4")


class BigramTrie:
    """Reads a buffer made by ``build``: bytes, a memory map, or an Arrow buffer."""

    def __init__(self, buffer):
        data, at = np.frombuffer(buffer, np.uint8), 0

        def part(kind):
            nonlocal at
            n = int(data[at:at + 8].view("<u8")[0])
            out = data[at + 8:at + 8 + n].view(kind)
            at += 8 + n + -n % 8
            return out

        magic, self.universe = part("<u8").tolist()
        if magic != MAGIC:
            raise ValueError("not a trie")
        sequence = lambda: EliasFano(part("<u8"), part("<u8"), part("<u8"), part("<u4"), part("<u4"))
        self.contexts, self.pointers, self.words = sequence(), sequence(), sequence()
        self.backoff, self.backoff_book, self.codes, self.book = part(np.uint8), part("<f4"), part(np.uint8), part("<f4")

    @staticmethod
    def build(context: np.ndarray, word: np.ndarray, log_p: np.ndarray, log_backoff: np.ndarray, n_contexts: int, universe: int) -> bytes:
        """context, word: in order, without repeats; log_p for each; log_backoff for each distinct context."""
        own, size = np.unique(context, return_counts=True)
        rank = np.repeat(np.arange(len(own)), size)
        codes, book = quantise(log_p)
        backoff, backoff_book = quantise(log_backoff)
        return _pad([np.array([MAGIC, universe], "<u8"), *EliasFano.parts(own, max(1, n_contexts)),
                     *EliasFano.parts(np.concatenate(([0], np.cumsum(size))), len(word) + 1),
                     *EliasFano.parts(rank * universe + word, max(1, len(own)) * universe), backoff, backoff_book, codes, book])

    def query(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 probability of each bigram, and log10 backoff of its context; NaN where there is none."""
        log_p, backoff = np.full(len(word), np.nan), np.full(len(word), np.nan)
        if not self.contexts.n or not len(word):
            return log_p, backoff
        distinct, number = np.unique(context, return_inverse=True)
        rank = self.contexts.successor(distinct)
        there = rank < self.contexts.n
        there[there] = self.contexts.get(rank[there]) == distinct[there]
        begin, end = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
        begin[there], end[there] = self.pointers.get(rank[there]), self.pointers.get(rank[there] + 1)
        at = np.flatnonzero(there[number])
        backoff[at] = self.backoff_book[self.backoff[rank[number[at]]]]
        target = rank[number[at]] * self.universe + word[at]
        place = self.words.successor(target)
        inside = place < end[number[at]]
        inside[inside] = self.words.get(place[inside]) == target[inside]
        log_p[at[inside]] = self.book[self.codes[place[inside]]]
        return log_p, backoff
