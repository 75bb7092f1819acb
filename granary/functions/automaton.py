"""Many patterns in many texts at once: a trie with failure links, walked by all texts of a batch in step."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes of a pattern that the trie holds; longer ones are found by their heads and read on from there.
HEAD = 256
#: Hits gathered before only the first of each text and state is kept.
GATHERED = 1 << 20


def text_bytes(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column without nulls."""
    flat = column.cast(pa.large_string()).combine_chunks()
    _, off, data = flat.buffers()
    offsets = np.frombuffer(off, np.int64, len(flat) + 1, flat.offset * 8)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8), offsets - offsets[0]


def _first(text: np.ndarray, state: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The smallest place of each (text, state)."""
    order = np.lexsort((at, state, text))
    text, state, at = text[order], state[order], at[order]
    new = np.append(True, (text[1:] != text[:-1]) | (state[1:] != state[:-1])) if len(text) else np.zeros(0, bool)
    return text[new], state[new], at[new]


class Automaton:
    """States of a trie over UTF-8 bytes with every transition filled in from the failure state.

    Built level by level: a state's failure state is where its parent's failure state goes by the same byte, and is
    less deep, so its transitions are complete. ``found`` tells whether a pattern ends in a state or in one of
    its failure states, ``link`` leads to the nearest of those.
    """

    def __init__(self, patterns: list[bytes]):
        self.patterns = patterns
        heads = sorted({p[:HEAD] for p in patterns if p})
        index = {h: i for i, h in enumerate(heads)}
        self.owners: list[list[int]] = [[] for _ in heads]
        for i, p in enumerate(patterns):
            if p:
                self.owners[index[p[:HEAD]]].append(i)
        size = np.array([len(h) for h in heads], np.int64)
        data = np.frombuffer(b"".join(heads), np.uint8)
        start = np.cumsum(size) - size
        used = np.unique(data)
        self.kind = np.zeros(256, np.int64)  # 0: a byte of no pattern
        self.kind[used] = np.arange(1, len(used) + 1)
        kinds, state, n = len(used) + 1, np.zeros(len(heads), np.int64), 1
        levels = []  # (first state, parents, bytes) of each depth
        for depth in range(int(size.max(initial=0))):
            live = np.flatnonzero(size > depth)
            edges, back = np.unique(state[live] * kinds + self.kind[data[start[live] + depth]], return_inverse=True)
            state[live] = n + back
            levels.append((n, edges // kinds, edges % kinds))
            n += len(edges)
        self.own = np.full(n, -1, np.int64)
        self.own[state] = np.arange(len(heads))
        self.next = np.zeros((n, kinds), np.int32)
        self.link = np.zeros(n, np.int64)
        fail = np.zeros(n, np.int64)
        for depth, (lo, parent, byte) in enumerate(levels):
            here = slice(lo, lo + len(parent))
            if depth:
                fail[here] = self.next[fail[parent], byte]
            back = fail[here]
            self.link[here] = np.where(self.own[back] >= 0, back, self.link[back])
            self.next[parent, byte] = np.arange(lo, lo + len(parent))
            self.next[here] = self.next[back]
        self.found = (self.own >= 0) | (self.link > 0)
        self.reach = int(size.max(initial=1)) - 1

    def first_ends(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, head, byte after it) of each head's first place in each text. Long texts are cut into lanes that
        overlap by the longest head, so the work is linear and no lane is longer than a few thousand steps."""
        span = int(np.clip(np.sqrt(len(data)), 4 * self.reach + 64, 1 << 14))
        many = -(-np.diff(offsets) // span)
        text = np.repeat(np.arange(len(offsets) - 1), many)
        begin = offsets[text] + (np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)) * span
        end = np.minimum(begin + span, offsets[text + 1])
        begin = np.maximum(begin - self.reach, offsets[text])
        order = np.argsort(begin - end, kind="stable")
        text, begin, steps = text[order], begin[order], (end - begin)[order]
        kind, state = self.kind[data], np.zeros(len(text), np.int64)
        kept, gathered, waiting = (np.zeros(0, np.int64),) * 3, [], 0
        for step in range(int(steps.max(initial=0))):
            n = int(np.searchsorted(-steps, -step, "left"))  # lanes longer than this
            state[:n] = self.next[state[:n], kind[begin[:n] + step]]
            hit = np.flatnonzero(self.found[state[:n]])
            if len(hit):
                gathered.append((text[hit], state[hit], begin[hit] + step + 1))
                waiting += len(hit)
                if waiting > GATHERED:
                    kept, gathered, waiting = _first(*map(np.concatenate, zip(kept, *gathered, strict=True))), [], 0
        text, state, at = _first(*map(np.concatenate, zip(kept, *gathered, strict=True)))
        parts = []
        while len(text):  # along the links, whose patterns end at the same byte
            own = self.own[state] >= 0
            parts.append((text[own], self.own[state[own]], at[own]))
            state = self.link[state]
            text, state, at = text[state > 0], state[state > 0], at[state > 0]
        return _first(*map(np.concatenate, zip(*parts, strict=True))) if parts else kept

    def places(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, pattern, first byte) of each pattern's first place in each text."""
        text, head, end = self.first_ends(data, offsets)
        out, raw = ([], [], []), None
        owned = np.array([len(o) for o in self.owners], np.int64)
        flat, first = np.array([i for o in self.owners for i in o], np.int64), np.cumsum(owned) - owned
        times = owned[head] if len(head) else np.zeros(0, np.int64)
        row = np.repeat(np.arange(len(text)), times)
        pattern = flat[np.repeat(first[head] if len(head) else head, times) + np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)] if len(row) else np.zeros(0, np.int64)
        size = np.array([len(p) for p in self.patterns], np.int64)
        place = end[row] - np.minimum(size[pattern], HEAD)
        text, ok = text[row], np.ones(len(row), bool)
        for i in np.flatnonzero(size[pattern] > HEAD).tolist():  # read on from the head
            raw = data.tobytes() if raw is None else raw
            place[i] = raw.find(self.patterns[pattern[i]], int(place[i]), int(offsets[text[i] + 1]))
            ok[i] = place[i] >= 0
        return text[ok], pattern[ok], place[ok]
