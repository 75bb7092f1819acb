"""Top-k of weighted word matches over one shard of texts, without reading most postings.

Postings lie by word and text, with the largest impact of every word and, for each block of BLOCK texts, of every
word in the block. A few of a query's strongest words give candidates, whose exact scores give a first k-th
score. Words that together cannot reach it are not read as lists any more: a text must hold one of the others. What
those give a text, plus the largest impacts of the unread words, first in the shard, then in the text's block, bounds
its score; only texts whose bound reaches the k-th score look the unread words up.
"""

from __future__ import annotations

import numpy as np

#: Texts that share maxima; share of a query's postings that its first k-th score may cost; cells held at once.
BLOCK, TASTE, CELLS = 8, 0.1, 1 << 22
#: Scores this close count as ties, which the caller settles.
NOISE = 1e-8


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each range, one after another."""
    ends = np.cumsum(size)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - size - start, size)


def _found(keys: np.ndarray, values: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Values of the asked keys, 0 where there is none."""
    if not len(keys):
        return np.zeros(len(asked))
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return np.where(keys[at] == asked, values[at], 0.0)


class _Rows:
    """Words of some rows, strongest first: row, vocabulary entry, weight, and the most a word can add to a score."""

    def __init__(self, row: np.ndarray, at: np.ndarray, weight: np.ndarray, most: np.ndarray, n: int):
        order = np.lexsort((-most, row))
        self.row, self.at, self.weight, self.most, self.n = row[order], at[order], weight[order], most[order], n
        self.first = np.searchsorted(self.row, np.arange(n + 1))

    def before(self, values: np.ndarray) -> np.ndarray:
        """Sum of the values of a row's words up to each word, itself left out."""
        total = np.concatenate([[0], np.cumsum(values)])
        return total[:-1] - total[self.first[self.row]]

    def sums(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, values, self.n) if len(values) else np.zeros(self.n)


class Shard:
    """Postings of texts given as lists of word hashes: ``words`` flat, ``size`` of each text."""

    def __init__(self, words: np.ndarray, size: np.ndarray, block: int = BLOCK):
        self.block, self.n = block, max(len(size), 1)
        owner = np.repeat(np.arange(len(size)), size)
        # Copies and near copies mostly share their smallest hash, so they share blocks.
        least = np.full(len(size), np.iinfo(np.int64).max)
        np.minimum.at(least, owner, words)
        self.text = np.argsort(least, kind="stable")  # text of each place
        place = np.empty(len(size), np.int64)
        place[self.text] = np.arange(len(size))
        self.vocabulary, word = np.unique(words, return_inverse=True)
        self.posting, self.tf = np.unique(word * self.n + place[owner], return_counts=True)
        self.place = self.posting % self.n
        self.first = np.searchsorted(self.posting, np.arange(len(self.vocabulary) + 1) * self.n)
        self.n_blocks = -(-self.n // block)
        cell = self.posting // self.n * self.n_blocks + self.place // block
        self.start = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])) if len(cell) else np.zeros(0, np.int64)
        self.cell = cell[self.start]

    def top(self, norm: np.ndarray, row: np.ndarray, word: np.ndarray, weight: np.ndarray, n_rows: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, int]:
        """(row, text, score) of the k best texts of each row of words, ties with the last included: score is the sum of
        weight * tf / (tf + norm of the text). Also how many postings were read, and of how many."""
        at = np.minimum(np.searchsorted(self.vocabulary, word), max(len(self.vocabulary) - 1, 0))
        known = self.vocabulary[at] == word if len(self.vocabulary) else np.zeros(len(word), bool)
        row, at, weight = row[known], at[known], weight[known]
        if not len(row) or not k:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), 0, 0
        impact = self.tf / (self.tf + norm[self.text][self.place])
        largest, in_block = np.maximum.reduceat(impact, self.first[:-1]), np.maximum.reduceat(impact, self.start)
        most = np.maximum(weight, 0) * largest[at]  # a negative weight adds nothing where its word is missing
        parts, read, step = [], 0, max(1, CELLS // self.n)
        for lo in range(0, n_rows, step):
            use = (row >= lo) & (row < lo + step)
            if use.any():
                q = _Rows(row[use] - lo, at[use], weight[use], most[use], min(step, n_rows - lo))
                r, place, score, n = self._some(q, impact, in_block, k)
                parts.append((r + lo, self.text[place], score))
                read += n
        return *map(np.concatenate, zip(*parts, strict=True)), read, int((self.first[at + 1] - self.first[at]).sum())

    def _some(self, q: _Rows, impact: np.ndarray, in_block: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        size = self.first[q.at + 1] - self.first[q.at]
        # A taste: the strongest words' candidates, scored in full.
        taste = (q.before(size) + size <= TASTE * q.sums(size)[q.row]) | (np.arange(len(q.row)) == q.first[q.row])
        partial, hit, read = self._lists(q, taste, impact)
        r, place, _ = _best(hit // self.n, hit % self.n, partial[hit], k, exactly=True)
        score, n = self._complete(q, ~taste, r, place, partial[r * self.n + place], self.posting, impact, 1)
        limit = np.full(q.n, -np.inf)
        many = np.bincount(r, minlength=q.n)
        np.minimum.at(low := np.full(q.n, np.inf), r, score)
        limit[many >= k] = low[many >= k]
        # Words that together stay below the limit are looked up only.
        total = q.sums(q.most)
        rest = total[q.row] - q.before(q.most)  # what a word and all weaker ones can add
        unread = rest < limit[q.row] - NOISE
        partial, hit, m = self._lists(q, ~unread, impact)
        r, place = hit // self.n, hit % self.n
        may = q.sums(np.where(unread, q.most, 0))
        alive = partial[hit] + may[r] >= limit[r] - NOISE
        r, place = r[alive], place[alive]
        blocks, back = np.unique(r * self.n_blocks + place // self.block, return_inverse=True)
        bound, _ = self._complete(q, unread, blocks // self.n_blocks, blocks % self.n_blocks, np.zeros(len(blocks)), self.cell, in_block, self.block, most=True)
        alive = partial[r * self.n + place] + bound[back] >= limit[r] - NOISE
        r, place = r[alive], place[alive]
        score, last = self._complete(q, unread, r, place, partial[r * self.n + place], self.posting, impact, 1)
        return *_best(r, place, score, k), read + n + m + last

    def _lists(self, q: _Rows, use: np.ndarray, impact: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Sums over the lists of the words in use: by (row, place), which of these are touched, and postings read."""
        start, size = self.first[q.at[use]], self.first[q.at[use] + 1] - self.first[q.at[use]]
        posting = _ranges(start, size)
        at = np.repeat(q.row[use] * self.n, size) + self.place[posting]
        sums = np.bincount(at, np.repeat(q.weight[use], size) * impact[posting], q.n * self.n)
        return sums, np.flatnonzero(np.bincount(at, minlength=q.n * self.n)), len(posting)

    def _complete(self, q: _Rows, use: np.ndarray, row: np.ndarray, place: np.ndarray, score: np.ndarray, keys: np.ndarray, values: np.ndarray, block: int, most: bool = False) -> tuple[np.ndarray, int]:
        """Scores of (row, place) with the row's words in use added, looked up by key, and the number of lookups."""
        words = np.flatnonzero(use)
        first = np.searchsorted(q.row[words], np.arange(q.n + 1))
        size = np.diff(first)[row]
        entry = words[_ranges(first[row], size)]
        owner = np.repeat(np.arange(len(row)), size)
        value = _found(keys, values, q.at[entry] * (self.n if block == 1 else self.n_blocks) + place[owner])
        weight = np.maximum(q.weight[entry], 0) if most else q.weight[entry]
        return score + np.bincount(owner, weight * value, len(row)), len(entry)


def _best(row: np.ndarray, place: np.ndarray, score: np.ndarray, k: int, exactly: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k largest scores of each row; all that tie with the last but for rounding too, if not ``exactly`` k."""
    order = np.lexsort((-score, row))
    row, place, score = row[order], place[order], score[order]
    first = np.searchsorted(row, row)
    if exactly:
        keep = np.arange(len(row)) - first < k
    else:
        last = np.minimum(first + k - 1, np.searchsorted(row, row, "right") - 1)
        keep = score >= score[last] - NOISE if len(row) else np.zeros(0, bool)
    return row[keep], place[keep], score[keep]
