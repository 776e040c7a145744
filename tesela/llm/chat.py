"""Reply trees: root-to-leaf paths by iterative self-joins, ranked by score, each formatted as one conversation.

Everything is DataFrame expressions.  A formatted conversation is, for each message of the path,
``<|im_start|>role\\ntext<|im_end|>\\n``; control strings inside roles and texts are escaped by one more backslash after ``<``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesela.llm.common import stash

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    """'<', backslashes, '|' get one more backslash, so no control string is left and unescape() restores the text."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    """A role also ends at the first line end, so line ends and backslashes in it are written as \\n and \\\\."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    halves = F.transform(F.split(unescape(role), r"\\\\", -1), lambda x: F.replace(x, F.lit("\\n"), F.lit("\n")))
    return F.array_join(halves, "\\")


def reply_paths(messages: DataFrame, branches: int | None = None) -> DataFrame:
    """Root-to-leaf paths of reply trees: (tree, leaf, branch int, path_score double, node, above long).

    messages: (tree string, node long, parent long, score double); tree and node together are unique, a root's parent is null or not
    among the nodes.  path_score: sum of the path's scores (null counts as 0).  branch: the path's rank in its tree by score, highest
    first, ties to the smaller leaf; branches keeps that many of each tree, None all.  above: steps from the node down to the leaf.

    Table k has each node's ancestor 2**k steps up, made by joining table k - 1 with itself, so a chain of n messages takes log2(n)
    rounds.  Leaves climb from the largest step to the smallest, adding scores up, and are ranked; only the paths of chosen leaves are
    written out, again doubling.  Nodes of a cycle, and leaves that reach one, have no root: they are not returned.
    """
    nodes = stash(messages.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score")))
    known = nodes.select("tree", F.col("node").alias("parent"), F.col("score").alias("gain"))
    # gain: the scores above the node, up to the ancestor's
    up = stash(nodes.filter(F.col("parent").isNotNull()).select("tree", "node", "parent").join(known, ["tree", "parent"]).select("tree", "node", F.col("parent").alias("to"), "gain"))
    parents, ups = up, []
    # a path is no longer than its tree has nodes
    most = nodes.groupBy("tree").count().agg(F.max("count")).first()[0] or 1
    while 1 << len(ups) < most and not up.isEmpty():
        ups.append(up)
        far = up.select("tree", F.col("node").alias("to"), F.col("to").alias("further"), F.col("gain").alias("more"))
        # a self-join doubles its plan, so each round starts from a table
        up = stash(up.join(far, ["tree", "to"]).select("tree", "node", F.col("further").alias("to"), (F.col("gain") + F.col("more")).alias("gain")))
    leaves = nodes.join(parents.select("tree", F.col("to").alias("node")), ["tree", "node"], "left_anti").select("tree", F.col("node").alias("leaf"), "node", F.col("score").alias("path_score"))
    for step in reversed(ups):
        climbed = leaves.join(step, ["tree", "node"], "left")
        leaves = climbed.select("tree", "leaf", F.coalesce("to", "node").alias("node"), (F.col("path_score") + F.coalesce("gain", F.lit(0.0))).alias("path_score"))
    rooted = leaves.join(parents.select("tree", "node"), ["tree", "node"], "left_anti")
    best = Window.partitionBy("tree").orderBy(F.col("path_score").desc(), "leaf")
    chosen = rooted.withColumn("branch", F.row_number().over(best))
    if branches is not None:
        chosen = chosen.filter(F.col("branch") <= branches)
    chosen = stash(chosen.select("tree", "leaf", "branch", "path_score"))
    paths = chosen.select("tree", "leaf", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("above"))
    for k, step in enumerate(ups):
        paths = stash(paths.unionByName(paths.join(step, ["tree", "node"]).select("tree", "leaf", F.col("to").alias("node"), (F.col("above") + (1 << k)).alias("above"))))
    return paths.join(chosen, ["tree", "leaf"])


def format_paths(messages: DataFrame, branches: int | None = None, learned_role: str = "assistant") -> DataFrame:
    """Format reply trees: (tree, leaf, branch int, path_score, n_turns long, formatted string, loss_spans).

    messages: those of reply_paths with role and text (null: empty) besides; branch and branches as there.  loss_spans: array of (start, end) in code
    points of formatted, half open, one for the text of each message of learned_role; control marks and escapes of others are outside.
    Empty tables give none; other columns of messages don't matter, whatever their names.
    """
    paths = reply_paths(messages, branches)
    empty = F.lit("")
    said = messages.select("tree", "node", escape_role(F.coalesce("role", empty)).alias("role"), escape(F.coalesce("text", empty)).alias("text"))
    turns = F.array_sort(F.collect_list(F.struct((-F.col("above")).alias("at"), F.col("role"), F.col("text"))))
    out = paths.join(said, ["tree", "node"]).groupBy("tree", "leaf", "branch", "path_score").agg(turns.alias("turns"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(F.lit(START), t.role, F.lit("\n"), t.text, F.lit(f"{END}\n"))), "")
    marks, head, tail = len(START) + 1 + len(END) + 1, len(START) + 1, len(END) + 1
    # running ends of the turns, and from each end back to its text
    ends = F.aggregate(
        "turns", F.array().cast("array<bigint>"),
        lambda a, t: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0).cast("long")) + marks + F.length(t.role) + F.length(t.text))),
    )
    spans = F.filter(
        F.zip_with("turns", "ends", lambda t, e: F.struct((e - tail - F.length(t.text)).alias("start"), (e - tail).alias("end"), (t.role == learned_role).alias("learned"))),
        lambda s: s.learned,
    )
    assert head + tail == marks
    return out.withColumn("ends", ends).select(
        "tree", "leaf", "branch", "path_score", F.size("turns").cast("long").alias("n_turns"), whole.alias("formatted"),
        F.transform(spans, lambda s: F.struct(s.start.alias("start"), s.end.alias("end"))).alias("loss_spans"),
    )


def parse_formatted(formatted: Column) -> Column:
    """Read a formatted conversation back: array of (role, text), unescaped."""
    parts = F.filter(F.split(formatted, r"<\|im_start\|>", -1), lambda p, i: i > 0)
    cut = F.transform(parts, lambda p: F.struct(F.instr(p, "\n").alias("line"), F.substring(p, F.lit(1), F.length(p) - len(END) - 1).alias("body")))
    return F.transform(
        cut,
        lambda c: F.struct(
            unescape_role(F.substring(c.body, F.lit(1), c.line - 1)).alias("role"),
            unescape(F.substring(c.body, c.line + 1, F.length(c.body))).alias("text"),
        ),
    )


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped span by span, with nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s.start + 1).cast("int"), (s.end - s.start).cast("int")))), "")


def linear_messages(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Conversations as reply trees in which each turn answers the one before.

    Rows of a conversation are ordered by turn (null first), then role and text; repeated rows stay repeated turns.  Null conversation
    ids form a conversation of their own.  tree: the id as a string, 'null' for null.
    """
    order = Window.partitionBy("tree").orderBy(F.col(turn).asc_nulls_first(), F.col(role).asc_nulls_first(), F.col(text).asc_nulls_first())
    rows = conversations.select(F.coalesce(F.col(conv).cast("string"), F.lit("null")).alias("tree"), F.col(conv).alias("conv_id"), F.col(turn), F.col(role), F.col(text))
    rows = rows.withColumn("node", F.row_number().over(order).cast("long"))
    return rows.select("tree", "conv_id", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.lit(0.0).alias("score"), F.col(role).alias("role"), F.col(text).alias("text"))
