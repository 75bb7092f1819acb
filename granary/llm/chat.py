"""Chat formatting of reply trees.

Messages with parent pointers form trees. Iterative self-joins double every message's ancestor pointer,
which gives each leaf its depth and the score of its root-to-leaf path in a logarithmic number of
rounds, for chains as for stars; leaves are ranked per tree by score, and the saved pointer tables
enumerate the chosen paths. Only ids move in those joins; texts join once, on the chosen paths.

The template is ``<|im_start|>role\\ntext<|im_end|>\\n`` for each turn. Inside texts and roles a backslash
is doubled and ``<|`` becomes ``<\\|``, in roles a line feed becomes ``\\n``, so control strings in a text
stay text and unescaping is exact. The loss mask covers the assistant texts.

Defined cases: null text or role counts as empty; messages of a null tree are one tree whose id is null; a
null or unknown parent makes a root; a message without a node id is on no path; repeated (tree, node)
rows count once, the smallest (parent, role, text) staying; messages on or below a parent cycle have no
root and are on no path; null scores count 0; score ties go to the smaller leaf; texts of any length are
kept whole; no messages give no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

START, END = "<|im_start|>", "<|im_end|>\n"


def escape(c: Column) -> Column:
    return F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit("\n"), F.lit("\\n"))


def unescape(s: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], s, flags=re.S)


def reply_paths(messages: DataFrame, scratch: Scratch, top: int = 1) -> DataFrame:
    """(tree, leaf, branch, node, pos) of the ``top`` best root-to-leaf paths of each tree.

    ``messages`` has tree, node, parent, score; pos counts from the root.
    """
    ids = scratch.save(
        messages.where("tree IS NOT NULL AND node IS NOT NULL").groupBy("tree", "node")
        .agg(F.min("parent").alias("parent"), F.max(F.coalesce("score", F.lit(0.0))).alias("score"))
    )
    present = ids.select("tree", F.col("node").alias("parent"), F.lit(True).alias("known"))
    state = scratch.save(
        ids.join(present, ["tree", "parent"], "left")
        .select("tree", "node", F.when(F.col("known"), F.col("parent")).alias("up"), "score", F.lit(1).cast("long").alias("depth"))
    )
    leaves = state.select("tree", "node").join(state.where("up IS NOT NULL").select("tree", F.col("up").alias("node")), ["tree", "node"], "left_anti")
    most = ids.groupBy("tree").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    jumps = []
    for _ in range(max(1, int(most).bit_length())):
        live = state.where("up IS NOT NULL")
        if live.isEmpty():
            break
        jumps.append(live.select("tree", "node", "up"))
        far = state.select("tree", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("score").alias("s2"), F.col("depth").alias("d2"))
        state = scratch.save(
            live.join(far, ["tree", "up"]).select("tree", "node", F.col("up2").alias("up"), (F.col("score") + F.col("s2")).alias("score"), (F.col("depth") + F.col("d2")).alias("depth"))
            .unionByName(state.where("up IS NULL"))
        )
    rooted = leaves.join(state.where("up IS NULL"), ["tree", "node"])
    best = Window.partitionBy("tree").orderBy(F.desc("score"), "node")
    chosen = rooted.withColumn("branch", F.row_number().over(best)).where(F.col("branch") <= top)
    path = scratch.save(chosen.select("tree", F.col("node").alias("leaf"), "branch", "node", (F.col("depth") - 1).alias("pos")))
    for i, jump in enumerate(jumps):
        above = path.join(jump, ["tree", "node"]).select("tree", "leaf", "branch", F.col("up").alias("node"), (F.col("pos") - (1 << i)).alias("pos"))
        path = scratch.save(path.unionByName(above))
    return path


def format_conversations(messages: DataFrame, top: int = 1) -> DataFrame:
    """One row per chosen path: tree, leaf, branch, conversation, loss (code-point spans of assistant texts)."""
    scratch = Scratch(messages.sparkSession, "chat")
    kind = messages.schema["tree"].dataType
    # A null tree is a tree: ids travel with a sign in front, which no null has.
    named = F.when(F.col("tree").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("tree").cast("string")))
    messages = messages.select(named.alias("tree"), "node", "parent", "score", "role", "text")
    path = reply_paths(messages, scratch, top)
    texts = messages.groupBy("tree", "node").agg(F.min(F.struct("parent", "role", "text")).alias("m")).select("tree", "node", "m.role", "m.text")
    turns = path.join(texts, ["tree", "node"]).select(
        "tree", "leaf", "branch", "pos", F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n")).alias("head"), escape(F.col("text")).alias("body"),
        (F.col("role") == "assistant").alias("loss"),
    )
    branch = Window.partitionBy("tree", "leaf", "branch").orderBy("pos")
    end = F.sum(F.length("head") + F.length("body") + len(END)).over(branch) - len(END)
    turns = turns.withColumn("end", end.cast("long")).withColumn("start", F.col("end") - F.length("body"))
    listed = turns.groupBy("tree", "leaf", "branch").agg(F.array_sort(F.collect_list(F.struct("pos", "head", "body", "loss", "start", "end"))).alias("t"))
    place = F.transform(F.filter("t", lambda t: F.coalesce(t["loss"], F.lit(False))), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end")))
    text = F.array_join(F.transform("t", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "")
    tree = F.when(F.col("tree") != "", F.substring("tree", 2, 2**31 - 1)).cast(kind)
    return listed.select(tree.alias("tree"), "leaf", "branch", text.alias("conversation"), place.alias("loss"))


def parse_turns(conversation: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    out, at = [], 0
    while at < len(conversation):
        head = conversation.index("\n", at)
        end = conversation.index(END, head)
        out.append((unescape(conversation[at + len(START) : head]), unescape(conversation[head + 1 : end])))
        at = end + len(END)
    return out


READ_BACK = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(conversation: pd.Series, loss: pd.Series) -> pd.DataFrame:
    """Digests of what a formatted conversation and its loss mask hold."""
    rows = []
    for text, spans in zip(conversation, loss, strict=True):
        turns = parse_turns(text)
        told = "".join(f"{r}\n{t}\n" for r, t in turns)
        masked = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
        rows.append((len(turns), sha256(told.encode()).hexdigest(), len(masked), sha256(masked.encode()).hexdigest(), len(text)))
    return pd.DataFrame(rows, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def linear_messages(turns: DataFrame) -> DataFrame:
    """Messages of (conv_id, turn, role, text) rows: each turn replies to the one before it. Turns with equal
    numbers, and repeated rows, all stay, by role and text; turns without a number come first."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    node = F.row_number().over(order).cast("long")
    return turns.select("conv_id", "turn", "role", "text").withColumn("node", node).select(
        F.col("conv_id").alias("tree"), "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.lit(0.0).alias("score"), "role", "text"
    )
