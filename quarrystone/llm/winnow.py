"""Content-defined routing of repeated strings.

Every window of fixed length has an anchor: the least of the hashes of its short grams.  Equal
windows have equal anchors wherever they stand, so whatever compares windows need only compare those
that share an anchor.  Consecutive windows with the same anchor form a run, and a run travels as one
segment: the symbols its windows cover.  Only anchors met more than once can hold repeated windows.
"""

from __future__ import annotations

import numpy as np

#: Longest run, in windows; longer ones (periodic texts) are cut, which loses nothing.
LONGEST_RUN = 512
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def gram_hashes(symbols: np.ndarray, gram: int) -> np.ndarray:
    """Hash of each run of gram symbols (uint64), by doubling."""
    n = len(symbols) - gram + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    done, have, power = None, 0, symbols.astype(np.uint64)
    factor, length, left = _BASE, 1, gram
    while left:
        if left & 1:
            if done is None:
                done, have = power, length
            else:
                m = len(symbols) - have - length + 1
                done = done[:m] * np.uint64(factor) + power[have : have + m]
                have += length
        left >>= 1
        if left:
            m = len(power) - length
            power = power[:m] * np.uint64(factor) + power[length : length + m]
            factor, length = factor * factor & _MASK, 2 * length
    h = done[:n]
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def sliding(values: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """best (np.minimum or np.maximum) of each width consecutive values, by doubling."""
    span, least = 1, values
    while 2 * span <= width:
        least = best(least[:-span], least[span:])
        span *= 2
    rest = width - span
    return best(least[:-rest], least[rest:]) if rest else least


def window_minima(symbols: np.ndarray, bounds: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gram hashes, the least of each window, and the windows that lie in one piece."""
    hashes = gram_hashes(symbols, gram)
    least = sliding(hashes, window - gram + 1, np.minimum)
    inside = np.ones(len(least), bool)
    for bound in bounds[1:-1]:
        inside[max(0, bound - window + 1) : bound] = False
    return hashes, least, np.flatnonzero(inside)


def anchor_places(symbols: np.ndarray, bounds: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Each place where an anchor stands, and the anchor.  Two windows that are equal, also within one run, have
    two places of their anchor, so an anchor with one place in all texts has no repeated window."""
    if len(symbols) < window:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    hashes, least, valid = window_minima(symbols, bounds, window, gram)
    width = window - gram + 1
    padded = np.zeros(len(least) + 2 * (width - 1), np.uint64)
    padded[valid + width - 1] = least[valid]
    at = np.flatnonzero(sliding(padded, width, np.maximum) == hashes)
    return at, hashes[at].view(np.int64)


def runs(symbols: np.ndarray, bounds: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and anchor of each run.

    symbols holds pieces one after another, piece k from bounds[k] to bounds[k + 1]; no window crosses a bound.
    """
    none = np.empty(0, np.int64)
    if len(symbols) < window:
        return none, none, none
    _, least, valid = window_minima(symbols, bounds, window, gram)
    if not len(valid):
        return none, none, none
    values = least[valid]
    fresh = np.ones(len(valid), bool)
    fresh[1:] = (values[1:] != values[:-1]) | (valid[1:] != valid[:-1] + 1)
    first = np.flatnonzero(fresh)
    length = np.diff(np.append(first, len(valid)))
    if length.max() > LONGEST_RUN:
        parts = -(-length // LONGEST_RUN)
        inside = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        ends = np.repeat(first + length, parts)
        first = np.repeat(first, parts) + inside * LONGEST_RUN
        length = np.minimum(LONGEST_RUN, ends - first)
    return valid[first], length, values[first].view(np.int64)
