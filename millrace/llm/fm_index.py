"""FM-index over word ids, in numpy: suffix order, wavelet matrix, backward search, sampled positions."""

from __future__ import annotations

import numpy as np

#: Every so many positions of a run keep their place in the text.
SAMPLE = 16


class Bits:
    """A bit vector with rank: 64-bit words and the ones before each."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before position i."""
        w = i >> 6
        return self.before[w] + np.bitwise_count(self.words[w] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)


class Wavelet:
    """Wavelet matrix: a bit vector for each bit of the symbols, highest first; zeros go left."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels, s = [], symbols
        for b in range(bits - 1, -1, -1):
            one = (s >> b & 1).astype(bool)
            self.levels.append((b, Bits(one), int(len(s) - one.sum())))
            s = np.concatenate([s[~one], s[one]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands before position i."""
        start, end = np.zeros_like(i), i
        for b, ones, zeros in self.levels:
            one = (symbol >> b & 1).astype(bool)
            s, e = ones.rank(start), ones.rank(end)
            start, end = np.where(one, zeros + s, start - s), np.where(one, zeros + e, end - e)
        return end - start

    def step(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at position i, and how often it stands before i."""
        symbol, start, at = np.zeros_like(i), np.zeros_like(i), i
        for b, ones, zeros in self.levels:
            one = ones.get(at).astype(bool)
            symbol |= one.astype(np.int64) << b
            s, e = ones.rank(start), ones.rank(at)
            start, at = np.where(one, zeros + s, start - s), np.where(one, zeros + e, at - e)
        return symbol, at - start


def suffix_order(text: np.ndarray, left: np.ndarray, bits: int) -> np.ndarray:
    """Suffix array by prefix doubling.

    ``text`` holds symbols from 1 and a 0 after each run; a suffix ends at its
    run's 0, ``left`` symbols on. Equal suffixes stand in order of position.
    Only groups that are not settled yet are sorted again.
    """
    n = len(text)
    deep = max(1, min(62 // bits, n))
    key, shifted = np.zeros(n, np.int64), text.astype(np.int64)
    for d in range(deep):
        part = np.zeros(n, np.int64)
        part[: n - d] = shifted[d:]
        key = key << bits | np.where(left >= d, part, 0)
    order = np.argsort(key, kind="stable")
    at = key[order]
    new = np.r_[True, at[1:] != at[:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    depth = deep
    # Places of the order whose group has several suffixes of which some go on beyond the depth.
    while True:
        group = rank[order]
        several = np.r_[group[1:] == group[:-1], False] | np.r_[False, group[1:] == group[:-1]]
        places = np.flatnonzero(several & (left[order] >= depth))
        if not len(places):
            return order
        suffix = order[places]
        g, follow = rank[suffix], rank[suffix + depth]
        o = np.lexsort((follow, g))
        suffix, g, follow = suffix[o], g[o], follow[o]
        order[places] = suffix
        new = np.r_[True, (g[1:] != g[:-1]) | (follow[1:] != follow[:-1])]
        rank[suffix] = np.maximum.accumulate(np.where(new, places, 0))
        depth *= 2


class FMIndex:
    """Index of runs of word ids (1 and up), each followed by a 0."""

    def __init__(self, text: np.ndarray, top: int):
        self.n, bits = len(text), max(1, int(top).bit_length())
        ends = np.flatnonzero(text == 0)
        run = np.zeros(self.n, np.int64)
        run[1:] = np.cumsum(text == 0)[:-1]
        left = ends[run] - np.arange(self.n)
        order = suffix_order(text, left, bits)
        self.first = np.zeros((1 << bits) + 1, np.int64)
        np.cumsum(np.bincount(text, minlength=1 << bits), out=self.first[1:])
        self.last = Wavelet(text[order - 1].astype(np.int64), bits)
        begins = np.zeros(self.n, bool)
        begins[np.r_[0, ends[:-1] + 1]] = True
        kept = begins | (np.arange(self.n) % SAMPLE == 0)  # a run's first place too, so that no walk leaves its run
        self.marked, self.places = Bits(kept[order]), order[kept[order]]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of the suffixes that begin with each phrase; a row of ``phrases`` is filled with 0 on the left."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for c in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[:, c].astype(np.int64)
            go = np.flatnonzero((symbol > 0) & (low < high))
            if len(go):
                s = symbol[go]
                both = self.last.rank(np.r_[s, s], np.r_[low[go], high[go]])
                low[go], high[go] = self.first[s] + both[: len(go)], self.first[s] + both[len(go) :]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in the text of the suffixes at ``rows``: each walks back to a sampled place."""
        out, at, who = np.empty(len(rows), np.int64), rows.copy(), np.arange(len(rows))
        steps = 0
        while len(who):
            stop = self.marked.get(at).astype(bool)
            out[who[stop]] = self.places[self.marked.rank(at[stop])] + steps
            at, who = at[~stop], who[~stop]
            if len(who):
                symbol, before = self.last.step(at)
                at = self.first[symbol] + before
            steps += 1
        return out
