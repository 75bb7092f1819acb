"""Items of JSON files that may be too large for one task: JSON lines, arrays over many lines, single objects.

Spark's text reader cuts files into splits of whole lines. Within JSON no string holds a line break, so every line
starts outside of strings, and how many brackets it opens less those it closes can be told from the line alone.
Sums of that over the splits of a file give the depth that each split starts with; then every split cuts its own
lines at the commas between elements, and only elements at the edges of splits are put together from parts. Any store
that Spark reads will do, and no file passes whole through a task.

A file is a document if its first line that is not blank leaves a bracket open and all its brackets balance; else its
lines are items of their own. Elements of a document may be broken in themselves, as long as brackets balance.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import saved

_TOKEN = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*"|[\[\]{},]')
_STEP = {"[": 1, "{": 1, "]": -1, "}": -1, ",": 0}


def _balance(line: str) -> int:
    return sum(_STEP.get(t, 0) for t in _TOKEN.findall(line))


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, split, balance, opens, starts) of each run of a split's lines; the last two of its first line that is not blank, else null."""
    for batch in batches:
        runs: dict[tuple[str, int], list] = {}
        for file, split, line in zip(*(batch.column(c).to_pylist() for c in ("file", "split", "value")), strict=True):
            run = runs.setdefault((file, split), [0, None, None])
            change = _balance(line)
            run[0] += change
            if run[1] is None and line.strip():
                run[1:] = change, line.lstrip()[0]
        yield pa.RecordBatch.from_pydict(
            {"file": [f for f, _ in runs], "split": [s for _, s in runs], "balance": [r[0] for r in runs.values()], "opens": [r[1] for r in runs.values()], "starts": [r[2] for r in runs.values()]},
            pa.schema([("file", pa.string()), ("split", pa.int64()), ("balance", pa.int64()), ("opens", pa.int64()), ("starts", pa.string())]),
        )


def split_line(line: str, depth: int, level: int) -> tuple[list[str], int]:
    """A line's text below ``level``, cut at the commas there, and the depth it ends with."""
    parts, kept, at = [], [], 0
    for m in _TOKEN.finditer(line):
        t = m.group()
        if t == "," and depth == level:
            parts.append("".join([*kept, line[at : m.start()]]))
            kept, at = [], m.end()
        elif t in _STEP:
            after = depth + _STEP[t]
            if min(depth, after) < level:  # a bracket around all elements
                if depth >= level:
                    kept.append(line[at : m.start()])
                at = m.end()
            depth = after
    if depth >= level:
        kept.append(line[at:])
    return [*parts, "".join(kept)], depth


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, split, n, item, whole) of the elements of each split in order; whole if both its ends are in the split."""
    now, depth, n, open_ = None, 0, 0, []
    schema = pa.schema([("file", pa.string()), ("split", pa.int64()), ("n", pa.int64()), ("item", pa.string()), ("whole", pa.bool_())])
    for batch in batches:
        out: list[tuple] = []

        def close(whole: bool, out: list[tuple] = out) -> None:
            out.append((*now, n, "\n".join(open_), whole and n > 0))

        for file, split, line, start, level in zip(*(batch.column(c).to_pylist() for c in ("file", "split", "value", "depth", "level")), strict=True):
            if now != (file, split):
                if now:
                    close(False)
                now, depth, n, open_ = (file, split), start, 0, []
            parts, depth = split_line(line, depth, level)
            for i, part in enumerate(parts):
                if i:
                    close(True)
                    n, open_ = n + 1, []
                open_.append(part)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * 5, schema, strict=True)], schema=schema)
    if now:
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((*now, n, "\n".join(open_), False), schema, strict=True)], schema=schema)


def json_items(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, split, n, item, is_line): the elements of documents, and the lines of all other files that are not blank, in
    the order of file, split and n. Empty elements are left out."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), "value")
    totals = lines.mapInArrow(_totals, "file string, split long, balance long, opens long, starts string").withColumn("part", F.monotonically_increasing_id())
    first = F.min(F.when(F.col("starts").isNotNull(), F.struct("split", "part", "opens", "starts"))).alias("first")
    totals = saved(totals.groupBy("file", "split").agg(F.sum("balance").alias("balance"), first), "splits")
    files = totals.groupBy("file").agg(F.sum("balance").alias("left"), F.min("first").alias("first"))
    files = files.select("file", (F.coalesce(F.col("first.opens"), F.lit(0)) > 0).alias("open"), "left", F.when(F.col("first.starts") == "[", 1).otherwise(0).alias("level"))
    before = F.sum("balance").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1))  # a row for each split
    starts = totals.select("file", "split", F.coalesce(before, F.lit(0)).alias("depth")).join(files.where("open AND left = 0"), "file").select("file", "split", "depth", F.col("level").cast("long").alias("level"))
    starts = saved(starts, "depths")
    # Joining may shuffle lines, so each split's are brought together and back into order.
    documents = lines.withColumn("i", F.monotonically_increasing_id()).join(starts, ["file", "split"]).repartition("file", "split").sortWithinPartitions("file", "split", "i")
    parts = saved(documents.select("file", "split", "value", "depth", "level").mapInArrow(_elements, "file string, split long, n long, item string, whole boolean"), "elements")
    # Elements at the edges of splits: the last of one and the first of the next are one.
    last = parts.groupBy("file", "split").agg(F.max("n").alias("last"))
    base = last.select("file", "split", F.coalesce(F.sum("last").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"), "last")
    edges = parts.where(~F.col("whole")).join(base, ["file", "split"]).groupBy("file", (F.col("base") + F.col("n")).alias("n")).agg(
        F.min("split").alias("split"), F.array_sort(F.collect_list(F.struct("split", "item"))).alias("p")
    ).select("file", "split", "n", F.array_join("p.item", "\n").alias("item"))
    inner = parts.where("whole").join(base, ["file", "split"]).select("file", "split", (F.col("base") + F.col("n")).alias("n"), "item")
    elements = inner.unionByName(edges).select("file", "split", "n", F.expr(r"trim(BOTH ' \n\r\t' FROM item)").alias("item"), F.lit(False).alias("is_line"))
    own = lines.withColumn("n", F.monotonically_increasing_id()).join(starts.select("file").distinct(), "file", "left_anti")
    return own.select("file", "split", "n", F.trim("value").alias("item"), F.lit(True).alias("is_line")).unionByName(elements).where("item <> ''")


def numbered(items: DataFrame, name: str, *order: str) -> DataFrame:
    """``items`` with a running number from 0 in column ``name``, file by file in the given order within a split."""
    within = F.row_number().over(Window.partitionBy("file", "split").orderBy(*order))  # a split's items
    counts = items.groupBy("file", "split").agg(F.count("*").alias("c"))
    before = counts.select("file", "split", (F.sum("c").over(Window.orderBy("file", "split")) - F.col("c")).alias("before"))  # a row for each split
    return items.withColumn("within", within).join(before, ["file", "split"]).withColumn(name, (F.col("before") + F.col("within") - 1).cast("long")).drop("within", "before")


def file_stem(file: str = "file", ending: str = r"\.json$"):
    """The name of a file without its folder and ending; paths come percent-encoded."""
    return F.regexp_replace(F.url_decode(F.replace(F.substring_index(file, "/", -1), F.lit("+"), F.lit("%2B"))), ending, "")
