"""Bidirectional FM-index over a delimited vocabulary, searched for words at one edit, many words at a time.

The text is every word with a delimiter before it, read as a ring.  An interval of suffix ranks
stands for all places that begin with a pattern; two synchronised intervals, of the text and of its
reverse, let a pattern grow to either side.
"""

from __future__ import annotations

import numpy as np

DELIMITER = "\n"
#: Symbols of one half matched by intervals; what is left of longer words is compared in the text.
REACH = 48


def suffix_ranks(symbols: np.ndarray) -> np.ndarray:
    """Starts of the ring's rotations in their order, by doubling the compared length."""
    n = len(symbols)
    rank = symbols.astype(np.int64)
    length = 1
    while True:
        key = rank * (int(rank.max()) + 1) + np.roll(rank, -length)
        order = np.argsort(key, kind="stable")
        new = np.concatenate(([0], np.cumsum(np.diff(key[order]) != 0)))
        rank = np.empty(n, np.int64)
        rank[order] = new
        length *= 2
        if new[-1] == n - 1 or length >= 2 * n:
            return order.astype(np.int32)


class Ranks:
    """Occurrence counts of the symbols before each suffix rank, bit by bit (a wavelet matrix)."""

    def __init__(self, symbols: np.ndarray, order: np.ndarray, n_symbols: int):
        current = symbols[order - 1]  # the symbol before each suffix; the ring closes at -1
        self.n_bits = max(1, int(n_symbols - 1).bit_length())
        self.zeros, self.total = [], []
        for bit in reversed(range(self.n_bits)):
            ones = (current >> bit & 1).astype(bool)
            self.zeros.append(np.concatenate(([0], np.cumsum(~ones))).astype(np.int32))
            self.total.append(int(self.zeros[-1][-1]))
            current = np.concatenate((current[~ones], current[ones]))
        counts = np.bincount(symbols, minlength=n_symbols)
        self.first = np.concatenate(([0], np.cumsum(counts)))[:n_symbols]
        every = np.arange(n_symbols)
        self.begin = np.zeros(n_symbols, np.int64)
        self.begin = self.one(np.zeros(n_symbols, np.int64), np.zeros(n_symbols, np.int64), every)[0] - self.first

    def one(self, low: np.ndarray, size: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, ...]:
        """Interval, size and number of smaller symbols after extending each interval by its symbol."""
        lo, hi, less = low.astype(np.int64), low.astype(np.int64) + size, np.zeros(len(low), np.int64)
        for level, bit in enumerate(reversed(range(self.n_bits))):
            ones = (symbol >> bit & 1).astype(bool)
            zl, zh = self.zeros[level][lo].astype(np.int64), self.zeros[level][hi].astype(np.int64)
            less += np.where(ones, zh - zl, 0)
            lo = np.where(ones, self.total[level] + lo - zl, zl)
            hi = np.where(ones, self.total[level] + hi - zh, zh)
        return self.first[symbol] + lo - self.begin[symbol], hi - lo, less

    def every(self, low: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
        """(row, symbol, interval, size, smaller symbols) of all symbols that occur in each interval."""
        row = np.arange(len(low))
        lo, hi = low.astype(np.int64), low.astype(np.int64) + size
        symbol = less = np.zeros(len(low), np.int64)
        for level in range(self.n_bits):
            zl, zh = self.zeros[level][lo].astype(np.int64), self.zeros[level][hi].astype(np.int64)
            zero, one = zh > zl, (hi - lo) > (zh - zl)
            row = np.concatenate((row[zero], row[one]))
            symbol = np.concatenate((symbol[zero] << 1, symbol[one] << 1 | 1))
            less = np.concatenate((less[zero], less[one] + (zh - zl)[one]))
            lo, hi = (np.concatenate((zl[zero], self.total[level] + (lo - zl)[one])),
                      np.concatenate((zh[zero], self.total[level] + (hi - zh)[one])))
        return row, symbol, self.first[symbol] + lo - self.begin[symbol], hi - lo, less


def one_edit(x: str, y: str) -> bool:
    """Whether one inserted, deleted or replaced code point turns one into the other."""
    if abs(len(x) - len(y)) > 1 or x == y:
        return False
    lo, hi = 0, min(len(x), len(y))
    while lo < hi:  # the longest common beginning
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if x[lo:mid] == y[lo:mid] else (lo, mid - 1)
    return x[lo + (len(x) >= len(y)):] == y[lo + (len(y) >= len(x)):]


class Vocabulary:
    """Index of distinct words; ``near`` finds, for other words, those at exactly one edit."""

    def __init__(self, words: list[str]):
        self.words = words
        codes = _codes(DELIMITER + DELIMITER.join(words))
        self.alphabet = np.unique(codes)  # the delimiter is the least
        symbols = np.searchsorted(self.alphabet, codes)
        self.order = suffix_ranks(symbols)
        self.delimiters = np.flatnonzero(symbols == 0)
        n = len(self.alphabet)
        self.left = Ranks(symbols, self.order, n)
        back = symbols[::-1]
        self.right = Ranks(back, suffix_ranks(back), n)
        self.length = len(symbols)

    def near(self, queries: list[str], errors_right: bool) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) numbers: words with one edit in the right half of the query, or in the left.

        The other half is matched exactly, from the middle outwards to its delimiter; then the
        pattern grows across the half with the edit, symbol by symbol, in all ways that occur.
        """
        codes = _codes(DELIMITER + "".join(q + DELIMITER for q in queries))
        symbols = np.searchsorted(self.alphabet, codes)
        symbols[self.alphabet[np.minimum(symbols, len(self.alphabet) - 1)] != codes] = -1  # not in the vocabulary
        lengths = np.fromiter(map(len, queries), np.int64, len(queries))
        starts = np.concatenate(([1], 1 + np.cumsum(lengths + 1)))[:-1]
        middle, ends = starts + lengths // 2, starts + lengths
        # the exact half grows towards its delimiter, the other one away from it
        if errors_right:
            inner, outer, step = self.left, self.right, 1
            at, last, open_, close = middle - 1, starts - 1, middle, ends
        else:
            inner, outer, step = self.right, self.left, -1
            at, last, open_, close = middle, ends, middle - 1, starts - 1
        query, low, other, size, cut = self._exact(inner, symbols, at, last, -step)
        found = self._across(outer, symbols, query, other, low, size, open_[query], close[query], step, cut)
        return self._words(*found, queries, errors_right)

    def _exact(self, ranks, symbols, at, last, step):
        """Intervals of the exact halves; ``cut`` marks those ended before their delimiter."""
        query, pos = np.arange(len(at)), at.copy()
        low = np.zeros(len(at), np.int64)
        other, size = low.copy(), np.full(len(at), self.length)
        done = []
        for _ in range(REACH + 1):
            low, size, less, alive = _step(ranks, low, size, symbols[pos])
            other = other + less
            ended = alive & (pos == last[query])
            done.append((query[ended], low[ended], other[ended], size[ended], np.zeros(ended.sum(), bool)))
            alive &= ~ended
            query, pos, low, other, size = query[alive], pos[alive] + step, low[alive], other[alive], size[alive]
        done.append((query, low, other, size, np.ones(len(query), bool)))
        return tuple(map(np.concatenate, zip(*done)))

    def _across(self, ranks, symbols, query, low, other, size, pos, close, step, cut):
        """(query, interval in the text, size, sure) after the half with the edit; unsure ones are compared there."""
        in_text = (lambda low, other: other) if ranks is self.right else (lambda low, other: low)
        # the pattern without an edit so far
        plain = (query[~cut], low[~cut], other[~cut], size[~cut], pos[~cut], close[~cut])
        edited = tuple(x[:0] for x in plain)
        done = [(query[cut], in_text(low, other)[cut], size[cut], np.zeros(cut.sum(), bool))]
        for _ in range(REACH + 2):
            if not len(plain[0]) and not len(edited[0]):
                break
            query, low, other, size, pos, close = edited
            low, size, less, alive = _step(ranks, low, size, symbols[pos])
            other = other + less
            ended = alive & (pos == close)
            done.append((query[ended], in_text(low, other)[ended], size[ended], np.ones(ended.sum(), bool)))
            alive &= ~ended
            moved = [x[alive] for x in (query, low, other, size, pos + step, close)]
            query, low, other, size, pos, close = plain
            row, symbol, new_low, new_size, less = ranks.every(low, size)
            new_other, here = other[row] + less, symbols[pos[row]]
            same = symbol == here
            on = same & (pos[row] != close[row])
            inserted = ~same & (symbol != 0)
            replaced = inserted & (pos[row] != close[row])
            # of equal neighbours the outermost is the one left out, and what is put in follows them
            left_out = (pos != close) & (symbols[pos] != symbols[pos + step * (pos != close)])
            grown = lambda keep, ahead: (query[row[keep]], new_low[keep], new_other[keep], new_size[keep],
                                         pos[row[keep]] + ahead, close[row[keep]])
            edited = tuple(map(np.concatenate, zip(
                moved, grown(inserted, 0), grown(replaced, step),
                [x[left_out] for x in (query, low, other, size, pos + step, close)])))
            plain = grown(on, step)
        for query, low, other, size, _, _ in (plain, edited):
            done.append((query, in_text(low, other), size, np.zeros(len(query), bool)))
        return tuple(map(np.concatenate, zip(*done)))

    def _words(self, query, low, size, sure, queries, errors_right):
        """Word numbers at the intervals of the text."""
        row = np.repeat(np.arange(len(query)), size)
        rank = low[row] + np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        word = np.searchsorted(self.delimiters, self.order[rank], side="right") - 1
        query, sure = query[row], sure[row]
        keep = sure.copy()
        for i in np.flatnonzero(~sure).tolist():
            x, y = queries[query[i]], self.words[word[i]]
            half = len(x) // 2
            exact = y.startswith(x[:half]) if errors_right else y.endswith(x[half:])
            keep[i] = exact and one_edit(x, y)
        pairs = np.unique(np.stack((query[keep], word[keep])), axis=1)
        return pairs[0], pairs[1]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


def _step(ranks: Ranks, low, size, symbol):
    """One symbol further; ``alive`` marks intervals that still hold something."""
    known = symbol >= 0
    low, size, less = ranks.one(low, size, np.maximum(symbol, 0))
    return low, size, less, known & (size > 0)
