"""Shared plumbing of the corpus operators: scratch tables and connected components.

Scratch tables go to the folder named by ``spark.checkpoint.dir``, which every executor and the
driver can reach, so a lost executor only costs the tasks it was running.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared scratch folder; a private one only if a local session names none (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors reach")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIRS:
        _OWN_DIRS[app] = tempfile.mkdtemp(prefix="granary-")
    return _OWN_DIRS[app]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with underscores added until no column of ``df`` is called so."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """64-bit digest of a row's id and text: rows with a null id, or sharing one, are told apart by it."""
    return F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")), F.col(id_col).isNull())


def without(docs: DataFrame, bad: DataFrame) -> DataFrame:
    """``docs`` less the rows whose row_key is in ``bad(doc_id)``, columns unchanged."""
    (key,) = fresh(docs, "row_key")
    gone = bad.select(F.col("doc_id").alias(key)).distinct()
    return docs.withColumn(key, row_key()).join(gone, key, "left_anti").select(*docs.columns)


class Scratch:
    """Parquet tables in the shared folder that cut lineage between the steps of one operator."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/granary/{name}-{uuid.uuid4().hex}"
        self._n = 0

    def save(self, df: DataFrame) -> DataFrame:
        self._n += 1
        path = f"{self.root}/t{self._n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def free(self, *tables: DataFrame) -> None:
        """Delete tables that no later plan reads."""
        jvm = self.spark._jvm
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t._scratch_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for every endpoint of ``edges(a, b)``: component = smallest node reachable.

    Each round hooks every node to its smallest neighbour, follows those pointers to their roots by
    doubling, and contracts the graph to the roots. Hooking is a map-side combined aggregate and
    pointers only fall, so hubs and long chains both take a logarithmic number of rounds.
    """
    live = scratch.save(
        edges.where("a <> b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )
    mapping = None  # node -> current root
    while not live.isEmpty():
        both = live.union(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = scratch.save(
            both.groupBy(F.col("a").alias("v")).agg(F.least(F.col("v"), F.min("b")).alias("p"))
        )
        while True:
            up = parent.select(F.col("v").alias("p"), F.col("p").alias("g"))
            jumped = scratch.save(
                parent.join(up, "p").select("v", F.col("g").alias("p"), (F.col("g") != F.col("p")).alias("moved"))
            )
            parent = jumped.drop("moved")
            if jumped.where("moved").isEmpty():
                break
        if mapping is None:
            mapping = parent.select(F.col("v").alias("node"), F.col("p").alias("component"))
        else:
            step = parent.select(F.col("v").alias("component"), F.col("p").alias("to"))
            mapping = scratch.save(
                mapping.join(step, "component", "left").select(
                    "node", F.coalesce("to", "component").alias("component")
                )
            )
        pa, pb = (parent.select(F.col("v").alias(c), F.col("p").alias(f"r{c}")) for c in "ab")
        live = scratch.save(
            live.join(pa, "a").join(pb, "b").where("ra <> rb")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
            .distinct()
        )
    if mapping is None:
        return live.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return mapping
