"""A compressed full-text index over sequences of word ids: BWT in a wavelet matrix, searched backwards in bulk."""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)


class WaveletMatrix:
    """Rank of a symbol among the first ``pos`` entries: packed bits with a count every 64."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        self.n = len(symbols)
        self.bits, self.counts, self.zeros = [], [], []
        s = symbols
        for level in range(self.levels - 1, -1, -1):
            bit = (s >> level & 1).astype(bool)
            packed = np.packbits(np.pad(bit, (0, 64 - self.n % 64)), bitorder="little").view(np.uint64)
            self.bits.append(packed)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int32)])[:-1].astype(np.int32))
            self.zeros.append(int(self.n - bit.sum()))
            s = np.concatenate([s[~bit], s[bit]])

    def path(self, symbol: np.ndarray, pos: np.ndarray) -> np.ndarray:
        """Where the first ``pos`` entries equal to ``symbol`` end in the last level's order."""
        for k in range(self.levels):
            block = pos >> 6
            ones = self.counts[k][block] + np.bitwise_count(self.bits[k][block] & ((_ONE << (pos & 63).astype(np.uint64)) - _ONE)).astype(np.int64)
            up = (symbol >> (self.levels - 1 - k) & 1).astype(bool)
            pos = np.where(up, self.zeros[k] + ones, pos - ones)
        return pos

    def ones(self, level: int, pos: np.ndarray) -> np.ndarray:
        """Set bits among the first ``pos`` of a level."""
        block = pos >> 6
        return self.counts[level][block] + np.bitwise_count(self.bits[level][block] & ((_ONE << (pos & 63).astype(np.uint64)) - _ONE)).astype(np.int64)

    def report(self, a: np.ndarray, b: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two-dimensional range reporting: query number and symbol of each entry in places a to b with a symbol from low to high."""
        query, symbol = np.arange(len(a)), np.zeros(len(a), np.int64)
        for k in range(self.levels):
            half = 1 << (self.levels - 1 - k)
            one_a, one_b = self.ones(k, a), self.ones(k, b)
            zero = (b - one_b > a - one_a) & (symbol + half > low[query])
            one = (one_b > one_a) & (symbol + half < high[query])
            a = np.concatenate([(a - one_a)[zero], self.zeros[k] + one_a[one]])
            b = np.concatenate([(b - one_b)[zero], self.zeros[k] + one_b[one]])
            symbol = np.concatenate([symbol[zero], symbol[one] + half])
            query = np.concatenate([query[zero], query[one]])
        return np.repeat(query, b - a), np.repeat(symbol, b - a)


def sorted_suffixes(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` symbols (prefix doubling); ties in any order.

    Searches for patterns of at most ``depth`` symbols depend on no longer context.
    """
    n = len(text)
    rank = text.astype(np.int64)
    order = np.argsort(rank, kind="stable")
    done = 1
    while done < depth:
        nxt = np.zeros(n, np.int64)
        if done < n:
            nxt[: n - done] = rank[done:] + 1
        key = rank * (int(nxt.max()) + 1) + nxt
        order = np.argsort(key, kind="stable")
        step = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.append(False, step[1:] != step[:-1]))
        done *= 2
        if rank[order[-1]] == n - 1:
            break
    return order


class FMIndex:
    """Over ``text`` of ids below ``sigma``; id 0 stands between sequences and is in no pattern."""

    def __init__(self, text: np.ndarray, sigma: int, depth: int):
        order = sorted_suffixes(text, depth)
        self.n = len(text)
        self.wavelet = WaveletMatrix(text[order - 1].astype(np.int64), sigma)
        before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])[:-1]
        symbols = np.arange(sigma, dtype=np.int64)
        self.shift = before - self.wavelet.path(symbols, np.zeros(sigma, np.int64))

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix ranges of the patterns with ``symbol`` put before them."""
        ends = self.wavelet.path(np.concatenate([symbol, symbol]), np.concatenate([lo, hi])) + np.tile(self.shift[symbol], 2)
        return ends[: len(lo)], ends[len(lo) :]

    def longest(self, ids: np.ndarray, end: np.ndarray, stop: np.ndarray, least: int = 2) -> np.ndarray:
        """Matching statistics: for each ``end`` the first position, from ``stop`` on, whose run up to ``end`` occurs ``least`` times."""
        at = end.copy()
        lo, hi = np.zeros(len(end), np.int64), np.full(len(end), self.n, np.int64)
        live = np.flatnonzero(at > stop)
        while len(live):
            a, b = self.extend(ids[at[live] - 1], lo[live], hi[live])
            ok = b - a >= least
            live = live[ok]
            lo[live], hi[live] = a[ok], b[ok]
            at[live] -= 1
            live = live[at[live] > stop[live]]
        return at


def repeated_windows(index: FMIndex, ids: np.ndarray, start: np.ndarray, size: np.ndarray, window: int) -> np.ndarray:
    """For each sequence (``size`` ids from ``start``) a mask of 64 bits: which of its windows occur twice or more.

    From the right end the match is extended to the left as far as it occurs twice: the windows inside it do. Where it
    stops, before position p, the farthest end up to which the run from p still occurs twice is found by halving, and
    the search goes on from there.
    """
    mask = np.zeros(len(start), np.uint64)
    live = np.flatnonzero(size >= window)
    end = (start + size)[live]
    while len(live):
        first = start[live]
        at = index.longest(ids, end, first)
        n = end - at - window + 1
        has = n > 0
        w = (at - first)[has].astype(np.uint64)
        mask[live[has]] |= ((_ONE << n[has].astype(np.uint64)) - _ONE) << w
        more = at > first
        live, first, at, end = live[more], first[more], at[more], end[more]
        # ids[at - 1 : end] occurs too seldom; a window from at - 1 to the left ends before min(end, at - 1 + window + 1)
        pivot = at - 1
        good, bad = np.maximum(pivot, first + window - 1), np.minimum(end, pivot + window + 1)
        seek = np.flatnonzero(bad - good > 1)
        while len(seek):
            mid = (good[seek] + bad[seek]) // 2
            reach = index.longest(ids, mid, pivot[seek]) <= pivot[seek]
            good[seek[reach]], bad[seek[~reach]] = mid[reach], mid[~reach]
            seek = seek[bad[seek] - good[seek] > 1]
        go = good >= first + window
        live, end = live[go], good[go]
    return mask
