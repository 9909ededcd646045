"""A compressed FM-index over integer sequences: Burrows-Wheeler transform in a wavelet matrix.

Suffixes are ordered by their first ``depth`` symbols only, which is all that patterns of at most
depth symbols can tell apart.  Bit planes are packed, with a count for every 64 bits.
"""

from __future__ import annotations

import numpy as np

#: Positions of a streamed sequence that are matched in one go.
PIECE = 24


def depth_order(tokens: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions ordered by their first depth symbols (circular), and the rank of each position: equal for equal symbols."""
    rank = tokens.astype(np.int64)
    reach = 1
    while reach < depth:
        step = min(reach, depth - reach)
        pair = rank * np.int64(rank.max() + 1) + np.roll(rank, -step)
        _, rank = np.unique(pair, return_inverse=True)
        reach += step
    return np.argsort(rank, kind="stable"), rank


class WaveletMatrix:
    """Rank queries on a sequence of small integers, for many positions at once."""

    def __init__(self, values: np.ndarray, bits: int):
        self.bits, self.planes, self.counts, self.zeros = bits, [], [], []
        n = len(values)
        words = n // 64 + 1
        current = values
        for level in reversed(range(bits)):
            bit = (current >> level) & 1
            packed = np.zeros(words * 64, np.uint8)
            packed[:n] = bit
            plane = np.packbits(packed, bitorder="little").view(np.uint64)
            self.planes.append(plane)
            self.counts.append(np.concatenate(([0], np.cumsum(np.bitwise_count(plane)))).astype(np.int32))
            ones = bit.astype(bool)
            self.zeros.append(np.int32(n - ones.sum()))
            current = np.concatenate((current[~ones], current[ones]))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often symbol[i] stands before position at[i], plus where its block begins: see begin()."""
        for k in range(self.bits):
            word = at >> 6
            ones = self.counts[k][word] + np.bitwise_count(self.planes[k][word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))).astype(np.int32)
            up = ((symbol >> (self.bits - 1 - k)) & 1).astype(bool)
            at = np.where(up, self.zeros[k] + ones, at - ones)
        return at


class FmIndex:
    """Backward search for patterns of up to depth symbols.  Symbol 0 separates sequences and is in no pattern.

    lcp[i] is the number of symbols, up to depth, that the suffixes i - 1 and i of the order share; with it an interval
    can let go of the last symbols of its pattern, so streamed texts are matched with one search step for each symbol."""

    def __init__(self, tokens: np.ndarray, sigma: int, depth: int):
        self.depth, self.sigma = depth, sigma
        self.order, rank = depth_order(tokens, depth)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(tokens, minlength=sigma)))).astype(np.int32)
        self.matrix = WaveletMatrix(tokens[self.order - 1].astype(np.int32), max(1, int(sigma - 1).bit_length()))
        self.begin = self.matrix.rank(np.arange(sigma, dtype=np.int32), np.zeros(sigma, np.int32))
        self.lcp = shared_symbols(tokens, self.order, rank, depth)
        self._edges: dict[int, np.ndarray] = {}

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix intervals after one more symbol to the left."""
        both = self.matrix.rank(np.concatenate((symbol, symbol)), np.concatenate((low, high)))
        base = self.first[symbol] - self.begin[symbol]
        half = len(symbol)
        return base + both[:half], base + both[half:]

    def widen(self, low: np.ndarray, high: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the first length symbols of the patterns of some intervals."""
        edges = self._edges.get(length)
        if edges is None:
            edges = self._edges[length] = np.flatnonzero(self.lcp < length).astype(np.int32)
        return edges[np.searchsorted(edges, low, side="right") - 1], edges[np.searchsorted(edges, high, side="left")]

    def matching_statistics(self, tokens: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each position of the streamed sequences tokens[begins[k] : ends[k]] the length, up to depth, of the longest match that
        starts there and stays in its sequence, and the interval of its occurrences (low, high).  Symbols that the index does not know match nothing.

        Sequences are read from right to left, all at once, in pieces that overlap by what a match can reach."""
        found = np.zeros(len(tokens), np.int32), np.zeros(len(tokens), np.int32), np.zeros(len(tokens), np.int32)
        pieces = -(-(ends - begins) // PIECE)
        start = np.repeat(begins, pieces) + PIECE * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        stop = np.minimum(start + PIECE + self.depth - 1, np.repeat(ends, pieces))
        longest = np.argsort(start - stop, kind="stable")
        start, stop = start[longest], stop[longest]
        size = stop - start
        low, high, length = np.zeros(len(start), np.int32), np.full(len(start), len(self.order), np.int32), np.zeros(len(start), np.int32)
        for k in range(int(size.max(initial=0))):
            live = int(np.searchsorted(-size, -k, side="left"))
            place = stop[:live] - 1 - k
            self._extend(tokens[place], low[:live], high[:live], length[:live])
            own = place < start[:live] + PIECE
            for all_of, now in zip(found, (length, low, high)):
                all_of[place[own]] = now[:live][own]
        return found

    def _extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray, length: np.ndarray) -> None:
        """One symbol more to the left of each match, in place; a match loses symbols on its right until the symbol fits."""
        known = (symbol > 0) & (symbol < self.sigma)
        symbol = np.where(known, symbol, 0).astype(np.int32)
        a, b = self.step(symbol, low, high)
        missed = np.flatnonzero(~known | (a >= b))
        while len(missed):
            shorter = np.maximum(0, np.maximum(self.lcp[low[missed]], self.lcp[high[missed]]))
            gone = ~known[missed] | (length[missed] == 0)
            none = missed[gone]
            low[none] = a[none] = 0
            high[none] = b[none] = len(self.order)
            length[none] = -1
            missed, shorter = missed[~gone], shorter[~gone]
            for n in np.unique(shorter):
                at = missed[shorter == n]
                low[at], high[at] = self.widen(low[at], high[at], int(n))
                length[at] = n
            if len(missed):
                a[missed], b[missed] = self.step(symbol[missed], low[missed], high[missed])
                missed = missed[a[missed] >= b[missed]]
        low[:], high[:] = a, b
        length += 1
        over = np.flatnonzero(length > self.depth)
        if len(over):
            low[over], high[over] = self.widen(low[over], high[over], self.depth)
            length[over] = self.depth


def shared_symbols(tokens: np.ndarray, order: np.ndarray, rank: np.ndarray, depth: int) -> np.ndarray:
    """lcp of an order by depth symbols: of neighbours how many first symbols are equal; -1 before the first and after the last."""
    n = len(order)
    found = np.zeros(n + 1, np.int8)
    found[1:n], found[0], found[n] = depth, -1, -1
    differ = np.flatnonzero(rank[order[1:]] != rank[order[:-1]]) + 1
    for k in range(depth):
        same = tokens[(order[differ - 1] + k) % n] == tokens[(order[differ] + k) % n]
        found[differ[~same]] = k
        differ = differ[same]
        if not len(differ):
            break
    return found
