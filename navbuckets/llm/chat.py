"""7. Chat formatting over reply trees, with DataFrame functions only.

Nodes of a reply tree name their parents. Ancestors are found by iterated self-joins that
double their reach: round k joins each node's ancestor at distance 2**k with itself, so a
path of any depth needs logarithmically many joins; a second pass uses the same pointers to
enumerate every (leaf, ancestor) pair, whose number is the output's number of turns. Pointers
are written to the shared checkpoint folder round by round. Branches are ranked by the sum of
their scores, and each path is formatted as one conversation.

The template writes a turn as ``<turn role="R">TEXT</turn>``, turns on lines of their own.
Inside texts and roles ``&``, ``<`` and (roles) ``"`` are written as entities, so no text can
hold a control string, and reading undoes it exactly. The loss mask lists the spans (code
points of the formatted text, end exclusive) of the trained role's texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from navbuckets.llm.common import materialize

#: fixed values: the template
OPEN, MIDDLE, CLOSE, BETWEEN = '<turn role="', '">', "</turn>", "\n"
_ENTITIES = (("&", "&amp;"), ("<", "&lt;"), ('"', "&quot;"))


def escape(text: Column, quotes: bool = False) -> Column:
    for plain, entity in _ENTITIES[: 3 if quotes else 2]:
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def unescape(text: Column) -> Column:
    for plain, entity in reversed(_ENTITIES):
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return text


def linear_tree(turns: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text)`` rows as the nodes of one-branch trees: every turn answers the
    one before it. Repeated turns follow each other by role and text; null turns come first."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    n = F.row_number().over(order)
    return (turns.select("conv_id", "turn", "role", "text", n.cast("long").alias("node_id"))
            .select(F.col("conv_id").alias("tree_id"), "node_id",
                    F.when(F.col("node_id") > 1, F.col("node_id") - 1).alias("parent_id"), "role", "text",
                    F.lit(0.0).alias("score")))


def _key(tree: str, node: str) -> Column:
    """One join key of (tree, node); a null tree is a tree of its own."""
    return F.when(F.col(node).isNotNull(), F.to_json(F.struct(F.col(tree).alias("t"), F.col(node).alias("n"))))


def paths(nodes: DataFrame) -> DataFrame:
    """All (leaf, node, dist) of root-to-leaf paths of ``nodes(key, parent)``; ``dist`` counts up from
    the leaf. Nodes that hang on a cycle have no root and take no part."""
    known = nodes.select(F.col("key").alias("parent")).distinct()
    first = materialize(nodes.select("key", "parent").join(known, "parent", "left_semi"))
    total = nodes.count()
    ups = []
    up = first
    while up.limit(1).count():
        if 2 ** len(ups) > total:
            break
        ups.append(up)
        up = materialize(up.select("key", F.col("parent").alias("mid"))
                         .join(up.select(F.col("key").alias("mid"), "parent"), "mid").select("key", "parent"))
    leaves = nodes.select("key").join(first.select(F.col("parent").alias("key")).distinct(), "key", "left_anti")
    if ups and 2 ** len(ups) > total:  # what still has an ancestor so far away is under a cycle
        leaves = leaves.join(up.select("key").distinct(), "key", "left_anti")
    reach = leaves.select(F.col("key").alias("leaf"), F.col("key").alias("node"), F.lit(0).cast("long").alias("dist"))
    for k, up in enumerate(ups):
        further = (reach.join(up.select(F.col("key").alias("node"), "parent"), "node")
                   .select("leaf", F.col("parent").alias("node"), (F.col("dist") + 2**k).alias("dist")))
        reach = materialize(reach.union(further))
    return reach


def conversations(nodes: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """One row per root-to-leaf path of ``nodes(tree_id, node_id, parent_id, role, text, score)``:
    (tree_id, leaf_id, rank, score, n_turns, formatted, loss_spans).

    Null roles and texts are empty, a null score is 0; a parent that is missing makes its child a
    root; rows without a node id, and nodes under a cycle, are left out; of rows with the same
    (tree, node) the smallest stays. ``rank`` orders a tree's branches from the highest score,
    ties by leaf id. No nodes give no rows.
    """
    own = (nodes.where(F.col("node_id").isNotNull()).select(
        _key("tree_id", "node_id").alias("key"), _key("tree_id", "parent_id").alias("parent"), "tree_id", "node_id",
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
        .groupBy("key").agg(F.min(F.struct("parent", "tree_id", "node_id", "role", "text", "score")).alias("n"))
        .select("key", "n.*"))
    own = materialize(own)
    piece = F.concat(F.lit(OPEN), escape(F.col("role"), True), F.lit(MIDDLE), escape(F.col("text")), F.lit(CLOSE), F.lit(BETWEEN))
    turns = (paths(own).join(own.select(F.col("key").alias("node"), "role", "score", piece.alias("piece"),
                                        F.length(escape(F.col("text"))).cast("long").alias("size")), "node"))
    down = Window.partitionBy("leaf").orderBy(F.col("dist").desc())
    tail = len(CLOSE) + len(BETWEEN)
    end = F.sum(F.length("piece").cast("long")).over(down.rowsBetween(Window.unboundedPreceding, 0)) - tail
    spans = F.when(F.col("role") == trained_role, F.struct((F.col("end") - F.col("size")).alias("start"), "end"))
    path = (turns.withColumn("end", end).groupBy("leaf").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("dist")).alias("at"), "piece", spans.alias("span")))).alias("turns"),
        F.sum("score").alias("score")))
    joined = F.array_join(F.col("turns")["piece"], "")
    path = path.select("leaf", "score", F.size("turns").cast("long").alias("n_turns"),
                       F.substring(joined, F.lit(1), F.length(joined) - len(BETWEEN)).alias("formatted"),
                       F.filter(F.col("turns")["span"], lambda s: s.isNotNull()).alias("loss_spans"))
    best = Window.partitionBy("tree_id").orderBy(F.col("score").desc(), "leaf_id")
    named = path.join(own.select(F.col("key").alias("leaf"), "tree_id", F.col("node_id").alias("leaf_id")), "leaf")
    return named.select("tree_id", "leaf_id", F.row_number().over(best).alias("rank"), "score", "n_turns", "formatted", "loss_spans")


def read_turns(formatted: Column) -> Column:
    """The (role, text) turns of a formatted conversation."""
    pieces = F.split(formatted, F.lit("</turn>\\n?"), -1)  # the last piece is what follows the last turn
    body = F.slice(pieces, F.lit(1), F.size(pieces) - 1)

    def turn(p):
        role = F.substring_index(F.substring(p, F.lit(len(OPEN) + 1), F.length(p)), MIDDLE, 1)
        text = F.substring(p, F.length(role) + len(OPEN) + len(MIDDLE) + 1, F.length(p))
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    return F.transform(body, turn)


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(spans, lambda s: unescape(
        F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
