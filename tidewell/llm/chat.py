"""Reply trees as training conversations.

Messages name the message that they reply to. Root-to-leaf paths are enumerated
by self-joins that double the distance each time, branches are ranked by score,
and each chosen path is formatted as one conversation with a loss mask over the
assistant's text. DataFrame functions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

# The control strings of the format.
USER, ASSISTANT, OTHER, ROLE_END = ("[INST]", "[/INST]"), ("<s>", "</s>"), ("[SYS]", "[/SYS]"), "[ROLE]"
_REST = r"(/?s>|/?INST\]|/?SYS\]|ROLE\])"
_TURN = r"(?s)\[INST\].*?\[/INST\]|<s>.*?</s>|\[SYS\].*?\[/SYS\]"


def escape(text: Column) -> Column:
    """Puts a backslash into each control string (and one more where there are some), so that none is left."""
    return F.regexp_replace(text, r"([<\[])(\\*)" + _REST, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _REST, "$1$2$3")


def branches(messages: DataFrame) -> DataFrame:
    """All pairs of a leaf and a message on its path: tree, leaf, node, dist (0 at the leaf), and the path's root.

    ``messages`` has tree, node and parent; a parent that isn't in the tree, or
    none, makes a root. After round k the pairs reach 2**k - 1 messages up, and
    the jump table leads 2**k up, so a tree of depth d needs log2(d) rounds.
    Each round's new pairs are written to the shared folder once. Messages on a cycle have no root
    and give no branch.
    """
    same_tree = lambda a, b: a["tree"].eqNullSafe(b["tree"])
    nodes = messages.select("tree", "node", "parent")
    known = nodes.select(F.col("tree").alias("_t"), F.col("node").alias("_n"))
    edges = (
        nodes.where("parent is not null")
        .join(known, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("parent") == F.col("_n")), "left_semi")
        .select("tree", "node", F.col("parent").alias("up"))
    )
    jump = materialize(edges, "jump")
    inner = jump.select(F.col("tree").alias("_t"), F.col("up").alias("_n"))
    leaves = nodes.join(inner, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("node") == F.col("_n")), "left_anti")
    rounds = [materialize(leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("dist")), "pairs")]
    pairs = rounds[0]
    most = messages.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    reach = 1
    while reach < most and not jump.isEmpty():
        j = jump.select(F.col("tree").alias("_t"), F.col("node").alias("_n"), "up")
        further = pairs.join(j, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("node") == F.col("_n")))
        rounds.append(materialize(further.select("tree", "leaf", F.col("up").alias("node"), (F.col("dist") + reach).alias("dist")), "pairs"))
        pairs = reduce(DataFrame.unionByName, rounds)
        a, b = jump.alias("a"), jump.select("tree", "node", "up").alias("b")
        jump = materialize(a.join(b, F.expr("a.tree <=> b.tree and a.up = b.node")).selectExpr("a.tree", "a.node", "b.up"), "jump")
        reach *= 2
    on_cycle = jump.select(F.col("tree").alias("_t"), F.col("node").alias("_n"))
    return pairs.join(on_cycle, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("leaf") == F.col("_n")), "left_anti")


def chosen_paths(messages: DataFrame, top: int | None = 1) -> DataFrame:
    """The ``top`` branches of each tree (all for None) with their messages: tree, leaf, branch_score, branch_rank, dist, role, text.

    A branch's score is the mean of its messages' scores, nulls left out; ties
    go to the longer branch, then to the smaller leaf.
    """
    pairs = branches(messages)
    facts = messages.select(F.col("tree").alias("_t"), F.col("node").alias("_n"), "role", "text", "score")
    met = pairs.join(facts, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("node") == F.col("_n"))).drop("_t", "_n")
    rank = "row_number() over (partition by tree order by branch_score desc nulls last, n desc, leaf)"
    ranked = met.groupBy("tree", "leaf").agg(F.avg("score").alias("branch_score"), F.count(F.lit(1)).alias("n")).selectExpr("*", f"{rank} as branch_rank")
    if top is not None:
        ranked = ranked.where(F.col("branch_rank") <= top)
    r = ranked.select(F.col("tree").alias("_t"), F.col("leaf").alias("_l"), "branch_score", "branch_rank")
    return met.join(r, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("leaf") == F.col("_l"))).drop("_t", "_l", "score")


def format_trees(messages: DataFrame, top: int | None = 1) -> DataFrame:
    """One row for each chosen branch: tree, leaf, branch_score, branch_rank, formatted, loss_spans.

    ``messages``: tree, node, parent, role, text, score; more columns are left
    out. A user's turn stands in [INST] marks, an assistant's in <s> marks, any
    other in [SYS] marks with its role before it. Control strings inside roles
    and texts are escaped reversibly. ``loss_spans`` are the assistant's texts
    in ``formatted``, as code points [start, end).

    Null roles and texts are empty. A tree may be null. Nodes must be unique in
    a tree; a repeated node's rows stand side by side on its path. No messages
    give no rows.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    user, assistant = role == "user", role == "assistant"
    head = F.when(user, F.lit(USER[0])).when(assistant, F.lit(ASSISTANT[0])).otherwise(F.concat(F.lit(OTHER[0]), escape(role), F.lit(ROLE_END)))
    foot = F.when(user, F.lit(USER[1])).when(assistant, F.lit(ASSISTANT[1])).otherwise(F.lit(OTHER[1]))
    turns = (
        chosen_paths(messages, top)
        .select("tree", "leaf", "branch_score", "branch_rank", "dist", head.alias("head"), escape(text).alias("body"), foot.alias("foot"), assistant.alias("learn"))
        .select("*", (F.length("head") + F.length("body") + F.length("foot")).cast("long").alias("n"), F.concat("head", "body", "foot").alias("turn"))
        .selectExpr("*", "sum(n) over (partition by tree, leaf order by dist desc, turn rows unbounded preceding) - n + length(head) as start")
    )
    packed = turns.groupBy("tree", "leaf").agg(
        F.first("branch_score").alias("branch_score"),
        F.first("branch_rank").alias("branch_rank"),
        F.sort_array(F.collect_list(F.struct("start", "turn", (F.col("start") + F.length("body")).alias("end"), "learn"))).alias("turns"),
    )
    return packed.select(
        "tree",
        "leaf",
        "branch_score",
        "branch_rank",
        F.array_join(F.transform("turns", lambda t: t["turn"]), "").alias("formatted"),
        F.transform(F.filter("turns", lambda t: t["learn"]), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"))).alias("loss_spans"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation as an array of (role, text)."""

    def one(turn: Column) -> Column:
        inner = lambda head, foot: turn.substr(F.lit(len(head) + 1), F.length(turn) - len(head) - len(foot))
        other = inner(*OTHER)
        cut = F.locate(ROLE_END, other)
        return F.when(turn.startswith(USER[0]), F.struct(F.lit("user").alias("role"), unescape(inner(*USER)).alias("text"))).when(
            turn.startswith(ASSISTANT[0]), F.struct(F.lit("assistant").alias("role"), unescape(inner(*ASSISTANT)).alias("text"))
        ).otherwise(F.struct(unescape(other.substr(F.lit(1), cut - 1)).alias("role"), unescape(other.substr(cut + len(ROLE_END), F.length(other))).alias("text")))

    return F.transform(F.regexp_extract_all(formatted, F.lit(_TURN), F.lit(0)), one)


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    at = lambda s: unescape(formatted.substr((s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))
    return F.array_join(F.transform(spans, at), "")
