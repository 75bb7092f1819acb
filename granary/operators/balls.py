"""Exact top-k of inner products over vectors that lie in balls.

A row x of a ball with centre c and radius r has x.q <= c.q + r|q|, by the triangle inequality. Balls are visited in
order of that bound, and a query skips those whose bound stays below its k-th score so far.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Scores this close count as ties, which the caller settles.
NOISE = 1e-8


def matrix(column: pa.ChunkedArray | pa.Array, dim: int | None = None) -> np.ndarray:
    """Rows of equally long vectors."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten(), np.float64).reshape(len(flat), -1 if dim is None and len(flat) else dim or 0)


def nearest(pivots: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches (.., embedding) with the number of the nearest pivot as ``cell``."""
    half = (pivots * pivots).sum(axis=1) / 2

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("embedding"), pivots.shape[1])
            yield batch.append_column("cell", pa.array(np.argmin(half - x @ pivots.T, axis=1).astype(np.int32)))

    return kernel


def top(q: np.ndarray, own: np.ndarray, x: np.ndarray, ids: np.ndarray, cell: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query, row, score) of each query's k best rows of x whose id is not its own, ties with the last included; and how many pairs were multiplied."""
    order = np.argsort(cell, kind="stable")
    x, ids = x[order], ids[order]
    start = np.flatnonzero(np.append(True, np.diff(cell[order]) != 0)) if len(x) else np.zeros(0, np.int64)
    end = np.append(start[1:], len(x)) if len(x) else start
    centre = np.stack([x[a:b].mean(axis=0) for a, b in zip(start, end, strict=True)]) if len(start) else np.zeros((0, q.shape[1]))
    radius = np.array([np.sqrt(((x[a:b] - c) ** 2).sum(axis=1).max()) for a, b, c in zip(start, end, centre, strict=True)])
    bound = q @ centre.T + radius * np.sqrt((q * q).sum(axis=1))[:, None]
    best, parts, multiplied = np.full((len(q), k), -np.inf), [], 0
    for i in np.argsort(-bound.max(axis=0, initial=-np.inf), kind="stable"):
        alive = np.flatnonzero(bound[:, i] >= best[:, 0] - NOISE)
        if not len(alive):
            continue
        rows = slice(start[i], end[i])
        score = q[alive] @ x[rows].T
        multiplied += score.size
        score[own[alive][:, None] == ids[rows]] = -np.inf
        row, column = np.nonzero((score >= best[alive, :1] - NOISE) & (score > -np.inf))
        parts.append((alive[row], start[i] + column, score[row, column]))
        best[alive] = np.sort(np.concatenate([best[alive], score], axis=1), axis=1)[:, -k:]
    row, at, score = (np.concatenate(p) for p in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    keep = score >= best[row, 0] - NOISE
    return row[keep], order[at[keep]], score[keep], multiplied
