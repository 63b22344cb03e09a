"""Operator 2 - chat formatting of reply trees, in DataFrame functions only.

Messages (tree, id, parent, role, text, score) form reply trees.  Paths from
root to leaf are enumerated by self-joins that double their reach: after
round k every leaf holds its ancestors nearer than 2^k, and the jump table
leads 2^k steps up.  So a chain of n turns takes log2(n) rounds, the rows are
the paths themselves, and only ids move; texts are joined once at the end.

Branches are ranked within their tree by mean score (ties: smaller leaf id)
in two steps, first within salted parts of a tree, then among the parts'
winners, so a tree with very many branches is never ranked in one task.

Template, one line per turn, roles and texts escaped::

    ### role: text</turn>

A backslash is put before each backslash, ``#`` and ``/`` (and before ``:`` in
roles), so neither ``###`` nor ``</turn>`` can arise inside a text, and
removing one backslash before those characters restores it.

Cases: null texts and roles are empty; a repeated id keeps one message (the
smallest by text and role); messages whose parent is missing are roots; those
on or below a reply cycle have no root and form no conversation; a message
with a null id is left out.  A null tree is one tree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnlab.llm.common import stage

END = "</turn>\n"
#: Parts that a tree's branches are dealt into before ranking.
SALTS = 64


def escape(c: Column, extra: str = "") -> Column:
    return F.regexp_replace(c, rf"([\\#/{extra}])", r"\\$1")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"\\([\\#/:])", "$1")


def reply_paths(messages: DataFrame) -> DataFrame:
    """(leaf, id, up): every message on the path of every leaf, ``up`` steps above it.

    ``messages`` needs id and parent; only paths that reach a root are kept.
    """
    ids = messages.select("id").where(F.col("id").isNotNull()).distinct()
    parents = messages.where(F.col("id").isNotNull()).groupBy("id").agg(F.min("parent").alias("parent"))
    # first messages have no parent: they stay out of the join, where null would be one hot key
    links = (parents.where(F.col("parent").isNotNull())
             .join(ids.select(F.col("id").alias("parent"), F.lit(True).alias("known")), "parent", "left")
             .select("id", F.when(F.col("known"), F.col("parent")).alias("above"))
             .unionByName(parents.where(F.col("parent").isNull()).select("id", F.col("parent").alias("above"))))
    jump = stage(links, "chat-links")
    parents = jump.where(F.col("above").isNotNull()).select(F.col("above").alias("id")).distinct()
    total, rounds = jump.count(), 0
    path = jump.join(parents, "id", "left_anti").select(F.col("id").alias("leaf"), "id", F.lit(0).cast("long").alias("up"))
    roots = jump.where(F.col("above").isNull()).select("id")
    while (1 << rounds) <= total and not jump.where(F.col("above").isNotNull()).isEmpty():
        lifted = (path.join(jump.where(F.col("above").isNotNull()), "id")
                  .select("leaf", F.col("above").alias("id"), (F.col("up") + (1 << rounds)).alias("up")))
        path = stage(path.unionByName(lifted), "chat-paths")
        above = jump.select(F.col("id").alias("above"), F.col("above").alias("higher"))
        jump = stage(jump.where(F.col("above").isNotNull()).join(above, "above", "left")
                     .select("id", F.col("higher").alias("above")), "chat-jumps")
        rounds += 1
    whole = path.join(roots, "id", "left_semi").select("leaf")
    return path.join(whole, "leaf", "left_semi")


def rank_branches(branches: DataFrame, per_tree: int = 1) -> DataFrame:
    """The ``per_tree`` best (tree, leaf, score) of each tree and their rank, from 1."""
    order = [F.col("score").desc_nulls_last(), F.col("leaf")]
    salted = branches.withColumn("salt", F.pmod(F.xxhash64("leaf"), F.lit(SALTS)))
    first = (salted.withColumn("rank", F.row_number().over(Window.partitionBy("tree", "salt").orderBy(*order)))
             .where(F.col("rank") <= per_tree).drop("rank", "salt"))
    return (first.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(*order)))
            .where(F.col("rank") <= per_tree))


def format_chats(messages: DataFrame, per_tree: int = 1, loss_role: str = "assistant") -> DataFrame:
    """(tree, leaf, rank, score, formatted, loss_spans) for each chosen branch.

    ``messages``: tree, id, parent, role, text, score; other columns are ignored.
    loss_spans are the code-point ranges (end exclusive) of the escaped texts
    of ``loss_role`` in ``formatted``, in order.
    """
    texts = (messages.where(F.col("id").isNotNull())
             .groupBy("id").agg(F.min(F.struct("parent", F.coalesce("text", F.lit("")).alias("text"),
                                               F.coalesce("role", F.lit("")).alias("role"), "tree", "score")).alias("m"))
             .select("id", F.col("m.parent").alias("parent"), F.col("m.text").alias("text"), F.col("m.role").alias("role"),
                     F.col("m.tree").alias("tree"), F.col("m.score").alias("score")))
    nodes = stage(texts, "chat-messages")
    paths = reply_paths(nodes.select("id", "parent"))
    scored = paths.join(nodes.select("id", "tree", "score"), "id")
    # decimals add up exactly in any order, so equal branches tie
    branches = scored.groupBy("leaf").agg(F.min("tree").alias("tree"),
                                          F.avg(F.col("score").cast("decimal(18,6)")).cast("double").alias("score"))
    chosen = rank_branches(branches, per_tree)
    turns = paths.join(chosen, "leaf").join(nodes.select("id", "role", "text"), "id")
    head = F.concat(F.lit("### "), escape(F.col("role"), ":"), F.lit(": "))
    turns = turns.select("leaf", "tree", "rank", "score", F.struct(
        (-F.col("up")).alias("at"), (F.col("role") == loss_role).alias("loss"), head.alias("head"),
        escape(F.col("text")).alias("body")).alias("turn"))
    chats = turns.groupBy("leaf").agg(F.first("tree").alias("tree"), F.first("rank").alias("rank"),
                                      F.first("score").alias("score"), F.sort_array(F.collect_list("turn")).alias("turns"))
    spans = F.aggregate(
        "turns",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")),
        lambda a, t: F.struct(
            (a["at"] + F.length(t["head"]) + F.length(t["body"]) + len(END)).alias("at"),
            F.when(t["loss"], F.concat(a["spans"], F.array(F.struct(
                (a["at"] + F.length(t["head"])).alias("start"),
                (a["at"] + F.length(t["head"]) + F.length(t["body"])).alias("end")))))
            .otherwise(a["spans"]).alias("spans")))
    formatted = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "")
    return chats.select("tree", "leaf", "rank", "score", formatted.alias("formatted"), spans["spans"].alias("loss_spans"))


def read_turns(formatted: str = "formatted") -> Column:
    """array<struct<role, text>> read back from a formatted conversation."""
    lines = F.filter(F.split(F.col(formatted), END, -1), lambda x: x != "")
    part = r"(?s)^### ((?:\\.|[^\\:])*): (.*)$"
    return F.transform(lines, lambda x: F.struct(unescape(F.regexp_extract(x, part, 1)).alias("role"),
                                                 unescape(F.regexp_extract(x, part, 2)).alias("text")))


def read_loss(formatted: str = "formatted", spans: str = "loss_spans") -> Column:
    """The text under the loss mask, unescaped, read back from a formatted conversation."""
    return F.array_join(F.transform(F.col(spans), lambda s: unescape(
        F.substring(F.col(formatted), s["start"] + 1, s["end"] - s["start"]))), "")


def chain(rows: DataFrame, tree: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Turn-numbered rows (tree, turn, role, text) as messages, each replying to the row before.

    Rows of equal turn follow each other by role, then text; repeated rows stay.
    """
    order = Window.partitionBy(tree).orderBy(F.col(turn), F.col("role"), F.col("text"))
    key = F.coalesce(F.col(tree).cast("string"), F.lit("null"))
    at = rows.select(F.col(tree).alias("tree"), key.alias("key"), "role", "text", F.row_number().over(order).alias("pos"))
    return at.select("tree", F.format_string("%s:%010d", "key", "pos").alias("id"),
                     F.when(F.col("pos") > 1, F.format_string("%s:%010d", F.col("key"), F.col("pos") - 1)).alias("parent"),
                     "role", "text", F.lit(0.0).alias("score"))
