"""Chat formatting: reply trees to conversations, by iterative self-joins that double their reach.

Nodes are (tree_id, node_id, parent_id, role, text, score). Each round joins every node's jump to the jump
of the node it reached, so the number of rounds is the logarithm of the depth; sums of scores come along.
The leaves of a tree are ranked by the mean score of their path (best first, then least node_id), and the
first `branches` of them are chosen; the same jumps, taken from the longest down, enumerate their paths.

A turn is written `<|turn|>` role `<|text|>` text `<|end|>`; in roles and texts a backslash is doubled and
`<|` becomes `<\\|`, so no control string is left and reading back is exact.

Null texts and roles count as empty, null scores as 0. A null tree_id is a tree like any other; a null node_id
is a node of its tree that none can reply to, as a null parent_id makes a root. A parent that isn't in its tree
makes a root. A node whose parents form a loop has no root, hence no path. Rows that repeat a node_id in a tree
count once; of turns of a conversation that tie in their number, the lesser role and text come first. A branch's
turns are put together in one value, as the format asks, so a conversation is bounded by what a value holds (2 GB);
texts of any length up to that are whole. An empty table gives no conversations; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stash

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
PIECE = "(?s)<\\|turn\\|>(.*?)<\\|text\\|>(.*?)<\\|end\\|>"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, "(?s)\\\\(.)", "$1")


def turns_as_tree(rows: DataFrame) -> DataFrame:
    """A plain conversation as a tree of one branch: each turn replies to the one before."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return rows.select(
        F.col("conv_id").alias("tree_id"), (F.row_number().over(order) - 1).cast("long").alias("node_id"), "role", "text"
    ).withColumns({"parent_id": F.when(F.col("node_id") > 0, F.col("node_id") - 1), "score": F.lit(0.0)})


def _keyed(nodes: DataFrame) -> DataFrame:
    """The ids in structs of one field: those are equal, in joins too, if both fields are null. A null parent_id stays null."""
    key = lambda c: F.struct(F.col(c).cast(nodes.schema["node_id"].dataType).alias("id"))
    return nodes.withColumns({"tree_id": F.struct(F.col("tree_id").alias("id")), "node_id": key("node_id"), "parent_id": F.when(F.col("parent_id").isNotNull(), key("parent_id"))})


def chosen_paths(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """tree_id, leaf_id, branch (rank from 1), node_id, depth (root: 0) of each node on a chosen path."""
    return _paths(_keyed(nodes), branches).withColumns({c: F.col(c)["id"] for c in ("tree_id", "leaf_id", "node_id")})


def _paths(nodes: DataFrame, branches: int) -> DataFrame:
    """The chosen paths of nodes with ids as of `_keyed`."""
    base = nodes.select("tree_id", "node_id", "parent_id", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")).dropDuplicates(["tree_id", "node_id"])
    ids = base.select("tree_id", F.col("node_id").alias("parent_id"), F.lit(True).alias("known"))
    columns = ["tree_id", "node_id", "to", "score", "reach"]
    jump = stash(
        base.join(ids, ["tree_id", "parent_id"], "left").select(
            "tree_id", "node_id", F.when(F.col("known"), F.col("parent_id")).alias("to"), "score", F.lit(1).cast("long").alias("reach")
        )
    )
    # Nodes whose jump has passed the root are done and join no more, so a long branch costs only itself.
    done, open_, levels, open_before = [jump.where(F.col("to").isNull())], jump.where(F.col("to").isNotNull()), [], None
    while True:
        still = open_.count()
        if not still or still == open_before:  # none left, or loops alone
            break
        open_before = still
        levels.append(open_.select("tree_id", "node_id", "to"))
        known = open_
        for part in done:
            known = known.unionByName(part)
        far = known.select("tree_id", F.col("node_id").alias("to"), F.col("to").alias("next"), F.col("score").alias("more"), F.col("reach").alias("further"))
        jump = stash(
            open_.join(far, ["tree_id", "to"]).select(
                "tree_id", "node_id", F.col("next").alias("to"), (F.col("score") + F.col("more")).alias("score"), (F.col("reach") + F.col("further")).alias("reach")
            )
        )
        done.append(jump.where(F.col("to").isNull()))
        open_ = jump.where(F.col("to").isNotNull())
    rooted = done[0].select(columns)
    for part in done[1:]:
        rooted = rooted.unionByName(part.select(columns))
    rooted = rooted.select("tree_id", "node_id", "score", (F.col("reach") - 1).alias("depth"))
    parents = done[0].limit(0).select("tree_id", "node_id") if not levels else levels[0].select("tree_id", F.col("to").alias("node_id"))
    leaves = rooted.join(parents, ["tree_id", "node_id"], "left_anti")
    rank = Window.partitionBy("tree_id").orderBy((F.col("score") / (F.col("depth") + 1)).desc(), "node_id")
    picked = leaves.withColumn("branch", F.row_number().over(rank)).where(F.col("branch") <= branches)
    paths = picked.select("tree_id", F.col("node_id").alias("leaf_id"), "branch", "node_id")
    for level in reversed(levels):
        above = paths.join(level, ["tree_id", "node_id"]).where(F.col("to").isNotNull())
        paths = stash(paths.unionByName(above.select("tree_id", "leaf_id", "branch", F.col("to").alias("node_id"))).distinct())
    return paths.join(rooted.select("tree_id", "node_id", "depth"), ["tree_id", "node_id"])


def format_reply_trees(nodes: DataFrame, branches: int = 1, loss_role: str = "assistant") -> DataFrame:
    """conv_id (the tree), branch, leaf_id, formatted, loss_spans (array of start, end in code points of `formatted`)."""
    nodes = _keyed(nodes)
    texts = nodes.select("tree_id", "node_id", "role", "text").dropDuplicates(["tree_id", "node_id"])
    turns = _paths(nodes, branches).join(texts, ["tree_id", "node_id"])
    head = F.concat(F.lit(TURN), escaped(F.col("role")), F.lit(TEXT))
    turns = turns.select("tree_id", "branch", "leaf_id", "depth", F.coalesce("role", F.lit("")).alias("role"), head.alias("head"), escaped(F.col("text")).alias("body"))
    piece = F.concat("head", "body", F.lit(END))
    order = Window.partitionBy("tree_id", "branch").orderBy("depth")
    before = F.coalesce(F.sum(F.length(piece)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    turns = turns.withColumn("piece", piece).withColumn("start", before + F.length("head")).withColumn("end", F.col("start") + F.length("body"))
    return (
        turns.groupBy("tree_id", "branch", "leaf_id")
        .agg(F.sort_array(F.collect_list(F.struct("depth", "piece", "role", "start", "end"))).alias("all"))
        .select(
            F.col("tree_id.id").alias("conv_id"), "branch", F.col("leaf_id.id").alias("leaf_id"),
            F.array_join(F.col("all.piece"), "").alias("formatted"),
            F.transform(F.filter("all", lambda t: t["role"] == loss_role), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"))).alias("loss_spans"),
        )
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """From `formatted` and `loss_spans` alone: roles, texts (arrays in turn order) and loss_text."""
    part = lambda k: F.transform(F.regexp_extract_all("formatted", F.lit(PIECE), F.lit(k)), unescaped)
    spans = F.transform("loss_spans", lambda s: F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))
    return formatted.withColumns({"roles": part(1), "texts": part(2), "loss_text": F.array_join(F.transform(spans, unescaped), "")})
