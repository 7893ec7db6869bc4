"""Chat formatting of reply trees.

Messages point at the one they answer.  Iterative self-joins walk from every message towards
its root, doubling the distance each time, so a path of n messages takes log2(n) joins.  Each
leaf ends one root-to-leaf path; the branches of a conversation are ranked by their score, and
each chosen path becomes one string with the spans of text to be learnt.

Template: ``<|im_start|>`` role, line feed, text, ``<|im_end|>``, line feed.  Control strings
inside roles and texts are escaped: ``<`` before ``|`` or a backslash gets a backslash after it,
which can be undone exactly and leaves no control string in a text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from docquarry.session import cut_lineage

START, END = "<|im_start|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("<\\"), F.lit("<\\\\"))
    return F.replace(text, F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    text = F.replace(text, F.lit("<\\|"), F.lit("<|"))
    return F.replace(text, F.lit("<\\\\"), F.lit("<\\"))


def escape_role(role: Column) -> Column:
    """As :func:`escape`; a line feed, which would end the role, is written ``<\\n``."""
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\n"))


def unescape_role(role: Column) -> Column:
    # "<\\n" of the original was written "<\\\\n", in which "<\\n" doesn't occur.
    return unescape(F.replace(role, F.lit("<\\n"), F.lit("\n")))


def paths(messages: DataFrame) -> DataFrame:
    """(tree, leaf, score, depth, node) for each message on each root-to-leaf path.

    ``messages``: tree, node, parent (null or unknown: a root), score; (tree, node) is unique.
    The score of a path is the sum of its messages' scores; null scores count as 0.  A message
    on a cycle reaches no root and is on no path.
    """
    m = messages.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).cast("double").alias("score"))
    known = m.select("tree", F.col("node").alias("parent"), F.lit(True).alias("__known"))
    up = m.join(known, ["tree", "parent"], "left").select(
        "tree", "node", F.when(F.col("__known"), F.col("parent")).alias("parent"), "score"
    )
    leaves = up.join(
        up.select("tree", F.col("parent").alias("node")).filter("node is not null").distinct(), ["tree", "node"], "left_anti"
    )
    up = cut_lineage(up, "chat-edges")
    # One row per node: the ancestor ``far`` some steps up (null: past the root, and the score is
    # that of the whole way).  Nodes that are past their root take no part in later rounds.
    jump = up.select("tree", "node", F.col("parent").alias("far"), F.lit(1).cast("long").alias("steps"), "score")
    done, open_ = [jump.filter("far is null")], jump.filter("far is not null")
    # leaf -> nodes on its path found so far
    reached = leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("depth"))
    found = [cut_lineage(reached, "chat-leaves")]
    longest = 2 * m.count()
    while True:
        state = open_.agg(F.count(F.lit(1)).alias("n"), F.max("steps").alias("s")).first()
        if not state["n"] or state["s"] > longest:  # what is left then runs in circles
            break
        step = open_.select("tree", "node", F.col("far").alias("__far"), F.col("steps").alias("__steps"))
        more = (
            reduce(DataFrame.unionByName, found)
            .join(step, ["tree", "node"])
            .select("tree", "leaf", F.col("__far").alias("node"), (F.col("depth") + F.col("__steps")).alias("depth"))
        )
        found.append(cut_lineage(more, "chat-paths"))
        second = reduce(DataFrame.unionByName, [*done, open_]).select(
            "tree", F.col("node").alias("far"), F.col("far").alias("__far"), F.col("steps").alias("__more"), F.col("score").alias("__score")
        )
        further = open_.join(second, ["tree", "far"]).select(
            "tree",
            "node",
            F.col("__far").alias("far"),
            (F.col("steps") + F.col("__more")).alias("steps"),
            (F.col("score") + F.col("__score")).alias("score"),
        )
        further = cut_lineage(further, "chat-jumps")
        done.append(further.filter("far is null"))
        open_ = further.filter("far is not null")
    reached = reduce(DataFrame.unionByName, found)
    total = reduce(DataFrame.unionByName, done).select("tree", F.col("node").alias("leaf"), F.col("score").alias("path_score"))
    length = F.max("depth").over(W.partitionBy("tree", "leaf"))
    return reached.join(total, ["tree", "leaf"]).select(
        "tree", "leaf", "path_score", (length - F.col("depth")).alias("place"), "node"
    )


def chat_format(messages: DataFrame, branches: int | None = 1, learn: str = "assistant") -> DataFrame:
    """One row per chosen path: tree, leaf, branch_rank, path_score, formatted, loss_spans.

    ``messages``: tree, node, parent, score, role, text.  ``branches``: how many paths of a tree
    are formatted, best score first, ties to the smaller leaf (None: all).  ``loss_spans``:
    start and length, in code points of ``formatted``, of each text of the role ``learn``.
    Null roles and texts are empty; rows of a null tree form one tree; an empty table gives none.
    """
    key = F.coalesce(F.concat(F.lit("v"), F.col("tree").cast("string")), F.lit("n"))  # joins must also find null trees
    messages = messages.select(F.col("tree").alias("__tree"), key.alias("tree"), "node", "parent", "score", "role", "text")
    on = paths(messages)
    ends = on.select("tree", "leaf", "path_score").distinct()
    rank = F.row_number().over(W.partitionBy("tree").orderBy(F.col("path_score").desc(), "leaf"))
    ends = ends.withColumn("branch_rank", rank)
    if branches is not None:
        ends = ends.filter(F.col("branch_rank") <= branches)
    body = messages.select(
        "tree",
        "__tree",
        "node",
        F.coalesce("role", F.lit("")).alias("role"),
        escape(F.coalesce("text", F.lit(""))).alias("__text"),
    ).withColumn("__head", F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n")))
    turns = (
        on.join(ends.drop("path_score"), ["tree", "leaf"])
        .join(body, ["tree", "node"])
        .withColumn("__whole", F.concat("__head", "__text", F.lit(END)))
    )
    # One conversation is one row by nature; its turns meet here and nowhere else.
    grouped = turns.groupBy("tree", "leaf", "branch_rank", "path_score").agg(
        F.first("__tree").alias("__tree"),
        F.sort_array(
            F.collect_list(
                F.struct(
                    "place",
                    F.col("__whole").alias("whole"),
                    F.char_length("__head").alias("head"),
                    F.char_length("__text").alias("size"),
                    (F.col("role") == learn).alias("learn"),
                )
            )
        ).alias("__t")
    )
    spans = F.aggregate(
        "__t",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
        lambda acc, x: F.struct(
            (acc["at"] + x["head"] + x["size"] + F.lit(len(END))).alias("at"),
            F.when(
                x["learn"],
                F.concat(acc["spans"], F.array(F.struct((acc["at"] + x["head"]).alias("start"), x["size"].alias("length")))),
            )
            .otherwise(acc["spans"])
            .alias("spans"),
        ),
    )["spans"]
    return grouped.select(
        F.col("__tree").alias("tree"),
        "leaf",
        "branch_rank",
        "path_score",
        F.concat_ws("", F.transform("__t", lambda x: x["whole"])).alias("formatted"),
        spans.alias("loss_spans"),
    )


def parse_turns(formatted: Column) -> Column:
    """array<struct<role, text>> read back from a formatted conversation, unescaped."""
    parts = F.filter(F.split(formatted, r"<\|im_start\|>", -1), lambda x: x != "")
    return F.transform(
        parts,
        lambda p: F.struct(
            unescape_role(F.substring_index(p, "\n", 1)).alias("role"),
            unescape(
                F.substr(
                    p,
                    F.char_length(F.substring_index(p, "\n", 1)) + 2,
                    F.char_length(p) - F.char_length(F.substring_index(p, "\n", 1)) - 1 - len(END),
                )
            ).alias("text"),
        ),
    )
