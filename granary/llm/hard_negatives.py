"""Hard negatives by an STR-packed R-tree over integer vectors.

Components become floor(scale * x), so scores are exact integers. Rows are packed by sort-tile-recursive
slabs: Spark cuts the table by quantiles of the two coordinates that vary most into tiles of about TILE rows,
a task cuts its tile on by one coordinate after another into leaves of LEAF rows. A seeded fraction is added
to the (integer) coordinate, so any number of equal vectors still spreads over slabs of equal size. Leaves, tiles
and groups of GROUP tiles have minimum bounding boxes. For a query vector each coordinate of a box gives an
interval of its part of the inner product; their sums bound every score in the box. A queue takes boxes best
first and drops those whose scores lie outside a query's window, or strictly below its k-th best so far, or
at it with only larger ids.

Two searches: the first k rows of an anchor's own label are its positives; for each positive the first k rows of
other labels with low * p <= 100 * score <= high * p are its negatives. Each search first visits the tile that
the anchor lies in, which gives most of the k-th scores, then every group of tiles whose box can still win. Blocks
of anchors meet groups of tiles; neither side passes the driver, and no pair of an anchor and a row is shuffled
but the best ones of a meeting.

Defined cases: rows with a null id, label or vector, a null or non-finite component, or one beyond 2**27 after
scaling (scores would leave 64 bits) take no part; shorter vectors count as continued by zeros; an empty vector
scores 0; of rows that share an id the one with the smallest label, then vector, stays; equal scores go by the
smaller id; fewer than k candidates are all taken; a negative positive score has an empty window; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

LEAF, TILE, GROUP = 64, 4096, 16
#: Tiles whose anchors are searched together, and anchors that one queue serves.
ANCHOR_TILES, SUB_BLOCK = 200, 512
LARGEST = 1 << 27
_FLOOR, _LAST = -(1 << 62), (1 << 63) - 1
_EXACT = float(1 << 53)
_WINDOWS = pa.list_(pa.struct([(c, pa.int64()) for c in ("name", "lo", "hi", "bar", "bar_id")]))
_REACHED = pa.schema([("anchor_id", pa.int64()), ("label", pa.int64()), ("q", pa.list_(pa.int32())), ("windows", _WINDOWS), ("block", pa.int64()), ("to", pa.int64())])
_FOUND = "anchor_id long, name long, id long, score long"
_FOUND_ARROW = pa.schema([(c, pa.int64()) for c in ("anchor_id", "name", "id", "score")])


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Count, sum and sum of squares of each coordinate; coordinate -1 counts rows."""
    for batch in batches:
        q = batch.column("q")
        values, at = q.flatten().to_numpy(zero_copy_only=False).astype(np.float64), _places(q)
        c = np.concatenate([[-1], np.arange(at.max() + 1 if len(at) else 0)])
        yield pa.RecordBatch.from_arrays(
            [pa.array(c), *(pa.array(np.concatenate([[float(len(batch))], np.bincount(at, w, len(c) - 1)])) for w in (values, values * values))], ["c", "total", "squares"]
        )


def _places(lists: pa.Array) -> np.ndarray:
    """Coordinate of each flattened value."""
    size = lists.value_lengths().to_numpy(zero_copy_only=False)
    return np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)


def _matrix(lists: pa.Array, dim: int) -> np.ndarray:
    """Rows of ``dim`` values, shorter lists continued by zeros."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    size = lists.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lists), dim), np.int64)
    out[np.repeat(np.arange(len(lists)), size), _places(lists)] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, label, q) of the rows that take part, one for each id."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) < LARGEST))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(finite)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("int")).alias("q"))
    repeated = rows.groupBy("vec_id").agg(F.count("*").alias("n")).where("n > 1").select("vec_id")
    if repeated.isEmpty():
        return rows
    one = rows.join(repeated, "vec_id", "left_semi").groupBy("vec_id").agg(F.min(F.struct("label", "q")).alias("r")).select("vec_id", "r.label", "r.q")
    return rows.join(repeated, "vec_id", "left_anti").unionByName(one)


def _slabs(df: DataFrame, keys: list[str], value: str, n: int, name: str) -> DataFrame:
    """``df`` with column ``name``: which of n slabs of equal size the value falls into, within the keys."""
    if n == 1:
        return df.withColumn(name, F.lit(0).cast("long"))
    shares = [i / n for i in range(1, n)]
    cuts = df.groupBy(*keys).agg(F.percentile_approx(value, shares, max(10_000, 100 * n)).alias("cuts"))
    met = df.join(cuts, keys) if keys else df.crossJoin(F.broadcast(cuts))  # without keys: one row
    return met.withColumn(name, F.size(F.filter("cuts", lambda c: c <= F.col(value))).cast("long")).drop("cuts")


def tiled(rows: DataFrame, scratch: Scratch, tile: int = TILE) -> tuple[DataFrame, int, int]:
    """(rows with their tile, number of tiles, dimensions)."""
    moments = {r["c"]: r for r in rows.select("q").mapInArrow(_moments, "c long, total double, squares double").groupBy("c").agg(F.sum("total").alias("total"), F.sum("squares").alias("squares")).collect()}  # a row for each coordinate
    n = moments.pop(-1)["total"] if moments else 0
    spread = sorted(moments, key=lambda c: (-(moments[c]["squares"] - moments[c]["total"] ** 2 / n), c))
    many = max(1, math.ceil(n / tile))
    across = math.ceil(math.sqrt(many)) if len(spread) > 1 else many
    down = math.ceil(many / across)
    for i, c in enumerate(spread[:2]):
        jitter = F.pmod(F.xxhash64("vec_id", F.lit(i)), F.lit(1 << 20)) / float(1 << 20)
        rows = rows.withColumn(f"v{i}", F.coalesce(F.get("q", F.lit(c)), F.lit(0)) + jitter)
    if spread:
        rows = _slabs(rows, [], "v0", across, "slab")
        rows = _slabs(rows, ["slab"], "v1", down, "part") if len(spread) > 1 else rows.withColumn("part", F.lit(0).cast("long"))
        rows = rows.select("vec_id", "label", "q", (F.col("slab") * down + F.col("part")).alias("tile"))
    else:
        rows = rows.withColumn("tile", F.lit(0).cast("long"))
    return scratch.save(rows), across * down, max(1, len(moments))


def str_order(x: np.ndarray, ids: np.ndarray, leaf: int = LEAF) -> list[np.ndarray]:
    """Row numbers of the leaves: halves by one coordinate after another, the most varied first, ties by id."""
    axes = np.argsort(-x.var(axis=0), kind="stable") if x.size else np.zeros(1, np.int64)
    out, todo = [], [(np.arange(len(x)), 0)]
    while todo:
        rows, level = todo.pop()
        if len(rows) <= leaf or not x.shape[1]:
            out.extend(rows[i : i + leaf] for i in range(0, len(rows), leaf))
            continue
        order = rows[np.lexsort((ids[rows], x[rows, axes[level % len(axes)]]))]
        half = leaf * math.ceil(len(rows) / leaf / 2)
        todo += [(order[:half], level + 1), (order[half:], level + 1)]
    return out


def _packer(dim: int, leaf: int):
    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        """A tile's rows in leaf order, and the boxes of its leaves."""
        x, ids, labels = _matrix(rows.column("q"), dim), rows.column("vec_id").to_numpy(), rows.column("label").to_numpy()
        leaves = str_order(x, ids, leaf)
        order, size = np.concatenate(leaves), [len(r) for r in leaves]
        lo, hi = (np.stack([f(x[r], axis=0) for r in leaves]).astype(np.int32) for f in (np.min, np.max))
        least = np.array([ids[r].min() for r in leaves])
        blobs = [a.tobytes() for a in (ids[order], labels[order], x[order].astype(np.int32), np.array(size, np.int64), lo, hi, least)]
        return pa.table(
            {"tile": [key[0].as_py()], **{c: pa.array([b], pa.binary()) for c, b in zip(("ids", "labels", "x", "sizes", "lo", "hi", "least"), blobs, strict=True)},
             "box_lo": [lo.min(axis=0).tolist()], "box_hi": [hi.max(axis=0).tolist()], "box_least": [int(least.min())]},
            schema=_TILE_ARROW,
        )

    return pack


_TILE_ARROW = pa.schema([("tile", pa.int64()), *((c, pa.binary()) for c in ("ids", "labels", "x", "sizes", "lo", "hi", "least")), ("box_lo", pa.list_(pa.int32())), ("box_hi", pa.list_(pa.int32())), ("box_least", pa.int64())])
_TILE = "tile long, ids binary, labels binary, x binary, sizes binary, lo binary, hi binary, least binary, box_lo array<int>, box_hi array<int>, box_least long"


class Requests:
    """Anchors with their windows: owner, name, lo, hi, and the bar (score, id) that results must beat."""

    def __init__(self, table: pa.Table, dim: int):
        self.ids, self.labels, self.q = table.column("anchor_id").to_numpy(), table.column("label").to_numpy(), _matrix(table.column("q"), dim)
        w = table.column("windows").combine_chunks()
        self.owner = np.repeat(np.arange(len(table)), w.value_lengths().to_numpy(zero_copy_only=False))
        flat = w.flatten()
        self.name, self.lo, self.hi, self.bar, self.bar_id = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("name", "lo", "hi", "bar", "bar_id"))

    def bounds(self, lo: np.ndarray, hi: np.ndarray, rows: slice = slice(None)) -> tuple[np.ndarray, np.ndarray]:
        """Smallest and largest possible score of anchors in boxes: each coordinate gives an interval."""
        up, down = np.maximum(self.q[rows], 0), np.minimum(self.q[rows], 0)
        return _product(up, lo) + _product(down, hi), _product(up, hi) + _product(down, lo)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products; by floating point where they fit."""
    size = (np.abs(a).max(initial=0) * float(np.abs(b).max(initial=0))) * max(a.shape[1], 1)
    if size < _EXACT:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a.astype(np.int64) @ b.T.astype(np.int64)


def search(r: Requests, tiles: list[dict], dim: int, k: int, same: bool) -> tuple[pa.Table, int, int]:
    """The k best of each window over the tiles that beat its bar; with how many (window, leaf) pairs were scored, of how many."""
    ids, labels = (np.concatenate([np.frombuffer(t[c], np.int64) for t in tiles]) for c in ("ids", "labels"))
    x, lo, hi = (np.concatenate([np.frombuffer(t[c], np.int32).reshape(-1, dim) for t in tiles]) for c in ("x", "lo", "hi"))
    ends = np.cumsum(np.concatenate([np.frombuffer(t["sizes"], np.int64) for t in tiles]))
    least = np.concatenate([np.frombuffer(t["least"], np.int64) for t in tiles])
    out, scored = [], 0
    for begin in range(0, len(r.ids), SUB_BLOCK):
        rows = slice(begin, begin + SUB_BLOCK)
        w = np.flatnonzero((r.owner >= begin) & (r.owner < begin + SUB_BLOCK))
        low, high, owner = *r.bounds(lo, hi, rows), r.owner[w] - begin
        best, best_id = np.full((len(w), k), _FLOOR), np.full((len(w), k), _LAST)
        bar, bar_id = r.bar[w].copy(), r.bar_id[w].copy()
        queue = [(-int(u), i) for i, u in enumerate(high.max(axis=0))] if len(w) else []
        heapq.heapify(queue)
        while queue:
            _, i = heapq.heappop(queue)
            top = high[owner, i]
            open_ = np.flatnonzero((top >= r.lo[w]) & (low[owner, i] <= r.hi[w]) & ((top > bar) | ((top == bar) & (least[i] < bar_id))))
            if not len(open_):
                continue
            scored += len(open_)
            leaf = slice(ends[i - 1] if i else 0, ends[i])
            asked, back = np.unique(owner[open_], return_inverse=True)
            s, at = _product(r.q[rows][asked], x[leaf])[back], w[open_]
            mine = labels[leaf] == r.labels[rows][owner[open_], None]
            ok = (mine if same else ~mine) & (s >= r.lo[at, None]) & (s <= r.hi[at, None]) & (ids[leaf] != r.ids[rows][owner[open_], None])
            ok &= (s > bar[open_, None]) | ((s == bar[open_, None]) & (ids[leaf] < bar_id[open_, None]))
            any_ = ok.any(axis=1)
            if any_.any():
                ok, hit = ok[any_], open_[any_]
                both = np.concatenate([best[hit], np.where(ok, s[any_], _FLOOR)], axis=1)
                both_id = np.concatenate([best_id[hit], np.where(ok, ids[leaf], _LAST)], axis=1)
                order = np.lexsort((both_id, -both), axis=1)[:, :k]
                best[hit], best_id[hit] = np.take_along_axis(both, order, 1), np.take_along_axis(both_id, order, 1)
                full = best[hit, -1] > _FLOOR
                bar[hit[full]], bar_id[hit[full]] = best[hit[full], -1], best_id[hit[full], -1]
        i, j = np.nonzero(best > _FLOOR)
        out.append(pa.table([r.ids[r.owner[w[i]]], r.name[w[i]], best_id[i, j], best[i, j]], schema=_FOUND_ARROW))
    return pa.concat_tables(out) if out else _FOUND_ARROW.empty_table(), scored, len(r.owner) * len(least)


def _meeting(dim: int, k: int, same: bool):
    def meet(requests: pa.Table, tiles: pa.Table) -> pa.Table:
        if not len(requests) or not len(tiles):
            return _FOUND_ARROW.empty_table()
        return search(Requests(requests, dim), tiles.to_pylist(), dim, k, same)[0]

    return meet


def _reaching(dim: int):
    def reach(requests: pa.Table, groups: pa.Table) -> pa.Table:
        """Requests for each group of tiles whose box can still win; a request has at least one window."""
        if not len(requests) or not len(groups):
            return _REACHED.empty_table()
        r = Requests(requests, dim)
        low, high = r.bounds(_matrix(groups.column("box_lo"), dim), _matrix(groups.column("box_hi"), dim))
        top, least = high[r.owner], groups.column("box_least").to_numpy()
        can = (top >= r.lo[:, None]) & (low[r.owner] <= r.hi[:, None]) & ((top > r.bar[:, None]) | ((top == r.bar[:, None]) & (least < r.bar_id[:, None])))
        row, column = np.nonzero(np.logical_or.reduceat(can, np.searchsorted(r.owner, np.arange(len(r.ids)))))
        return requests.take(pa.array(row)).append_column("to", groups.column("part").take(pa.array(column))).select(_REACHED.names).cast(_REACHED)

    return reach


def _copied(df: DataFrame, name: str, n: int) -> DataFrame:
    """Each row once for every number below n, in column ``name``."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))


def _floor_share(percent: int, score: str, sign: str = "") -> Column:
    """Floor of a percentage of an integer score, in integers."""
    part = f"({sign}{percent} * {score})"
    return F.expr(f"{part} div 100 - CASE WHEN {part} % 100 < 0 THEN 1 ELSE 0 END")


def best_first(requests: DataFrame, tiles: DataFrame, n_tiles: int, dim: int, k: int, same: bool, scratch: Scratch) -> DataFrame:
    """(anchor_id, name, id, score, rank): the first k rows of each request's windows."""
    columns = [f.name for f in requests.schema]
    home = requests.groupBy("tile").cogroup(tiles.groupBy("tile")).applyInArrow(_meeting(dim, k, same), _FOUND)
    home = scratch.save(home)
    order = Window.partitionBy("anchor_id", "name").orderBy(F.desc("score"), "id")
    if n_tiles > 1:
        bars = home.groupBy("anchor_id", "name").agg(F.count("*").alias("n"), F.min(F.struct("score", (-F.col("id")).alias("id"))).alias("b")).where(F.col("n") == k)
        bars = bars.groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "b"))).alias("bars"))
        bar = F.col("bars")
        raised = F.transform("windows", lambda w: F.struct(
            w["name"].alias("name"), w["lo"].alias("lo"), w["hi"].alias("hi"),
            F.coalesce(bar[w["name"]]["score"], w["bar"]).alias("bar"), F.coalesce(-bar[w["name"]]["id"], w["bar_id"]).alias("bar_id"),
        ))
        asking = requests.join(bars, "anchor_id", "left").withColumn("windows", raised).select(*columns).withColumn("block", F.floor(F.col("tile") / ANCHOR_TILES))
        # The upper level: boxes of groups of tiles, GROUP * TILE rows each, in chunks.
        n_groups, n_blocks, chunk = math.ceil(n_tiles / GROUP), math.ceil(n_tiles / ANCHOR_TILES), 1024
        sides = tiles.select(F.floor(F.col("tile") / GROUP).alias("part"), "box_least", F.posexplode(F.arrays_zip("box_lo", "box_hi")).alias("c", "b"))
        sides = sides.groupBy("part", "c").agg(F.min("b.box_lo").alias("lo"), F.max("b.box_hi").alias("hi"), F.min("box_least").alias("least"))
        boxes = sides.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("c", "lo", "hi"))).alias("s"), F.min("least").alias("box_least"))
        boxes = boxes.select("part", "box_least", F.col("s.lo").alias("box_lo"), F.col("s.hi").alias("box_hi"), F.floor(F.col("part") / chunk).alias("chunk"))
        boxes = _copied(boxes, "block", n_blocks)
        asking = _copied(asking, "chunk", math.ceil(n_groups / chunk))
        reached = asking.groupBy("block", "chunk").cogroup(boxes.groupBy("block", "chunk")).applyInArrow(
            _reaching(dim), "anchor_id long, label long, q array<int>, windows array<struct<name:long,lo:long,hi:long,bar:long,bar_id:long>>, block long, to long"
        )
        dealt = _copied(tiles.withColumn("to", F.floor(F.col("tile") / GROUP)), "block", n_blocks)
        away = reached.groupBy("block", "to").cogroup(dealt.groupBy("block", "to")).applyInArrow(_meeting(dim, k, same), _FOUND)
        home = home.unionByName(away).distinct()  # a group holds the home tile as well
    return scratch.save(home.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))


def hard_negatives(vectors: DataFrame, is_anchor: Column, k_positive: int = 5, k_negative: int = 5, low: int = 80, high: int = 100, scale: int = 256, tile: int = TILE, leaf: int = LEAF) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of vectors (vec_id, label, embedding)."""
    scratch = Scratch(vectors.sparkSession, "hard-negatives")
    rows, n_tiles, dim = tiled(quantised(vectors, scale), scratch, tile)
    tiles = scratch.save(rows.groupBy("tile").applyInArrow(_packer(dim, leaf), _TILE))
    anchors = rows.where(is_anchor).select(F.col("vec_id").alias("anchor_id"), "label", "q", "tile")

    def window(name: Column, lo: Column, hi: Column) -> Column:
        return F.struct(*(c.cast("long").alias(n) for n, c in (("name", name), ("lo", lo), ("hi", hi), ("bar", F.lit(_FLOOR)), ("bar_id", F.lit(_LAST)))))

    positives = best_first(anchors.withColumn("windows", F.array(window(F.lit(0), F.lit(_FLOOR), F.lit(-_FLOOR)))), tiles, n_tiles, dim, k_positive, True, scratch)
    # low * p <= 100 * n <= high * p, in integers
    w = window(F.col("id"), -_floor_share(low, "score", "-"), _floor_share(high, "score"))
    asked = positives.select("anchor_id", w.alias("w")).where("w.lo <= w.hi")
    asked = anchors.join(asked.groupBy("anchor_id").agg(F.collect_list("w").alias("windows")), "anchor_id").select(*anchors.columns, "windows")
    found = best_first(asked, tiles, n_tiles, dim, k_negative, False, scratch)
    return found.join(positives.select("anchor_id", F.col("id").alias("name"), F.col("score").alias("positive_score")), ["anchor_id", "name"]).select(
        "anchor_id", F.col("name").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
