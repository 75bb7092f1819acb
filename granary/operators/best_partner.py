"""The best n-gram precision that any other text gives each text, within one meeting of blocks.

The value of a pair is the geometric mean of the clipped precisions of its 1- to N-grams, each at least FLOOR. Pairs
that share no N-gram stay below FLOOR ** (1 / N), so pairs that share one are looked at first, and only texts
without any go on to shorter grams. Counts of shared N-grams alone bound a pair's value; the partner with the
highest bound is scored in full, then only those whose bound is above what that gave.
"""

from __future__ import annotations

import numpy as np

FLOOR = 1e-10
#: Cells of a table of bounds, and grams looked up, at once.
CELLS = 1 << 22


class Grams:
    """Word lists (hashes, flat, and their lengths) as counted n-grams: for each n the text, gram and count, by text."""

    def __init__(self, words: np.ndarray, size: np.ndarray, order: int):
        self.n, self.size = len(size), size
        owner = np.repeat(np.arange(len(size)), size)
        self.tables = []
        word = words.astype(np.uint64)
        gram = np.zeros(len(word), np.uint64)
        for n in range(1, order + 1):
            many = max(len(word) - n + 1, 0)
            with np.errstate(over="ignore"):
                gram = (gram[:many] ^ (gram[:many] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + word[n - 1 :][:many] * np.uint64(2 * n + 1)
            inside = owner[:many] == owner[n - 1 :][:many] if n > 1 else np.ones(many, bool)
            key, text = gram[inside], owner[:many][inside]
            lex = np.lexsort((key, text))
            key, text = key[lex], text[lex]
            new = np.append(True, (key[1:] != key[:-1]) | (text[1:] != text[:-1])) if len(key) else np.zeros(0, bool)
            count = np.diff(np.append(np.flatnonzero(new), len(key)))
            self.tables.append((text[new], key[new], count))

    def possible(self, n: int) -> np.ndarray:
        return np.maximum(self.size - (n - 1), 1)


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    ends = np.cumsum(size)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - size - start, size)


class _Index:
    """The other side's grams by gram, and by (text, gram)."""

    def __init__(self, grams: Grams):
        self.by_gram, self.codes = [], []
        for text, key, count in grams.tables:
            order = np.argsort(key, kind="stable")
            vocabulary, first = np.unique(key[order], return_index=True)
            self.by_gram.append((vocabulary, np.append(first, len(key)), text[order], count[order]))
            code = text * max(len(vocabulary), 1) + np.searchsorted(vocabulary, key)
            self.codes.append((code, count))  # sorted: tables lie by text, then gram

    def lookup(self, n: int, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        vocabulary = self.by_gram[n - 1][0]
        at = np.minimum(np.searchsorted(vocabulary, key), max(len(vocabulary) - 1, 0))
        return at, vocabulary[at] == key if len(vocabulary) else np.zeros(len(key), bool)


def _values(q: Grams, x: _Index, row: np.ndarray, partner: np.ndarray, order: int) -> np.ndarray:
    """Values of pairs, from the counts of all their shared grams."""
    logs = np.zeros(len(row))
    for n in range(1, order + 1):
        text, key, count = q.tables[n - 1]
        first = np.searchsorted(text, np.arange(q.n + 1))
        at, known = x.lookup(n, key)
        code, theirs = x.codes[n - 1]
        width = max(len(x.by_gram[n - 1][0]), 1)
        size = np.diff(first)[row]
        shared = np.zeros(len(row))
        part = (np.cumsum(size) - size) // CELLS
        begin = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(row) else np.zeros(0, np.int64)
        for lo, hi in zip(begin.tolist(), np.append(begin[1:], len(row)).tolist() if len(row) else [], strict=True):
            entry = _ranges(first[row[lo:hi]], size[lo:hi])
            pair = np.repeat(np.arange(lo, hi), size[lo:hi])
            entry, pair = entry[known[entry]], pair[known[entry]]
            asked = partner[pair] * width + at[entry]
            place = np.minimum(np.searchsorted(code, asked), max(len(code) - 1, 0))
            hit = code[place] == asked if len(code) else np.zeros(len(asked), bool)
            shared += np.bincount(pair[hit], np.minimum(count[entry[hit]], theirs[place[hit]]), len(row))
        logs += np.log(np.maximum(shared / q.possible(n)[row], FLOOR))
    return np.exp(logs / order)


def best(q: Grams, q_own: np.ndarray, x: Grams, x_own: np.ndarray, order: int) -> tuple[np.ndarray, int]:
    """(value, pairs scored): for each text of q the best value with a text of x that is not its own; 0 if they share no word."""
    index, value, scored = _Index(x), np.zeros(q.n), 0
    for n in range(order, 0, -1):
        open_ = value < FLOOR ** ((order - n) / order) if n < order else np.ones(q.n, bool)
        vocabulary, first, text, count = index.by_gram[n - 1]
        own_text, key, own_count = q.tables[n - 1]
        at, known = index.lookup(n, key)
        use = np.flatnonzero(known & open_[own_text]) if len(key) else np.zeros(0, np.int64)
        step = max(1, CELLS // max(x.n, 1))
        for lo in range(0, q.n, step):
            some = use[(own_text[use] >= lo) & (own_text[use] < lo + step)]
            if not len(some):
                continue
            size = first[at[some] + 1] - first[at[some]]
            posting = _ranges(first[at[some]], size)
            cell = np.repeat((own_text[some] - lo) * x.n, size) + text[posting]
            shared = np.bincount(cell, np.minimum(np.repeat(own_count[some], size), count[posting]))
            cell = np.flatnonzero(shared)
            row, partner = cell // x.n + lo, cell % x.n
            bound = np.exp((np.log(np.maximum(shared[cell] / q.possible(n)[row], FLOOR)) + (order - n) * np.log(FLOOR)) / order)
            other = q_own[row] != x_own[partner]
            row, partner, bound = row[other], partner[other], bound[other]
            if not len(row):
                continue
            order_ = np.lexsort((-bound, row))
            row, partner, bound = row[order_], partner[order_], bound[order_]
            top = np.append(True, row[1:] != row[:-1])
            for wave in (top, ~top):
                wave = np.flatnonzero(wave & (bound > value[row] * (1 + 1e-12)))
                np.maximum.at(value, row[wave], _values(q, index, row[wave], partner[wave], order))
                scored += len(wave)
    return value, scored
