"""Reply trees to conversations: paths by self-joins, branches ranked by score, one text per path.

A node names its parent. Pointer doubling joins the table with itself: after round r a node knows
its ancestor 2^r steps up and the sum of scores on the way, so a tree of depth d needs log2(d) rounds
of plain joins. Leaves are ranked by the score of their path (mean or sum of its nodes' scores);
only the chosen ones are expanded, again by doubling: the set of (leaf, node) pairs is joined with
the table of each round. Its final size is the size of the output.

The template marks a turn as ``<s>role``, a line end, the text, a space, ``</s>`` and a line end. In a text a
control string gets one backslash more than stands before it, a role is URL-encoded; ``parsed`` undoes
both. The loss mask lists the code-point spans of the trained
roles' texts.

Skew: node keys are unique on one side of every join, so a popular parent is a skewed probe side, which
AQE splits. A path is one row by definition, so a path's own turns meet in one task.

Defined cases: a null text or role is empty, a null score counts 0. A parent that does not exist
makes a root; nodes in or below a cycle have no root and no path. Repeated node keys are an error of
the input; ``linear`` numbers the rows of a conversation by turn (nulls first), then role, text, so
repeated rows are turns of their own. A null conversation id is one conversation. Ties of
score go to the smaller leaf key. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import landed

CONTROL = r"</?s>|\[/?INST\]|<</?SYS>>"
OPEN, CLOSE = "<s>", " </s>\n"
TRAINED = ("assistant",)


def escaped(text: Column) -> Column:
    """Control strings in ``text`` with one more backslash before them."""
    return F.regexp_replace(text, f"(\\\\*)({CONTROL})", "$1\\\\$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, f"\\\\(\\\\*)({CONTROL})", "$1$2")


def linear(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as trees without branches."""
    tree = F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("null"))
    order = Window.partitionBy("tree").orderBy("turn", "role", "text")
    numbered = rows.withColumn("tree", tree).withColumn("node", F.row_number().over(order))
    return numbered.select(
        "tree",
        F.col("node").cast("long").alias("node"),
        F.when(F.col("node") > 1, F.col("node") - 1).cast("long").alias("parent"),
        "role",
        "text",
        F.char_length("text").cast("double").alias("score"),
    )


def paths(nodes: DataFrame, *, branches: int = 1, by: str = "mean") -> DataFrame:
    """(tree, leaf, rank, score, at, node) of the chosen branches; ``at`` counts from the root, 1.

    ``nodes`` has tree, node, parent and score; (tree, node) is unique.
    """
    if by not in ("mean", "sum"):
        raise ValueError("by is mean or sum")
    key = ["tree", "node"]
    known = nodes.select("tree", F.col("node").alias("parent"))
    start = (
        nodes.join(known.withColumn("found", F.lit(True)), ["tree", "parent"], "left")
        .select(
            *key,
            F.when(F.col("found"), F.col("parent")).alias("up"),
            F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("total"),
            F.lit(1).cast("long").alias("depth"),
        )
    )
    rounds = [landed(start, "reach")]
    size = rounds[0].count()
    while rounds[-1].where("up is not null").limit(1).count() and 2 ** (len(rounds) - 1) <= size:
        now = rounds[-1]
        far = now.select(
            "tree", F.col("node").alias("up"), F.col("up").alias("far"),
            F.col("total").alias("more"), F.col("depth").alias("deep"),
        )
        # Nodes that know their root are done.
        joined = now.where("up is not null").join(far, ["tree", "up"], "left").select(
            *key,
            F.col("far").alias("up"),
            (F.col("total") + F.coalesce("more", F.lit(0.0))).alias("total"),
            (F.col("depth") + F.coalesce("deep", F.lit(0))).alias("depth"),
        )
        rounds.append(landed(joined.unionByName(now.where("up is null")), "reach"))
    whole = rounds[-1].where("up is null").select(*key, "total", "depth")
    parents = rounds[0].where("up is not null").select("tree", F.col("up").alias("node")).distinct()
    leaves = whole.join(parents, key, "left_anti")
    score = F.col("total") / F.col("depth") if by == "mean" else F.col("total")
    order = Window.partitionBy("tree").orderBy(F.desc("score"), "node")
    chosen = (
        leaves.withColumn("score", score)
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= branches)
        .select("tree", F.col("node").alias("leaf"), "rank", "score", F.col("depth").alias("at"), "node")
    )
    chosen = landed(chosen, "paths")
    for k, jump in enumerate(rounds[:-1]):
        step = jump.where("up is not null").select(*key, "up")
        higher = chosen.join(step, key).select(
            "tree", "leaf", "rank", "score", (F.col("at") - 2**k).alias("at"), F.col("up").alias("node")
        )
        # Both sides are read again by the next round: unless landed, plans would double each time.
        chosen = landed(chosen.unionByName(higher), "paths")
    return chosen


def formatted(nodes: DataFrame, trained: tuple[str, ...] = TRAINED, **choice) -> DataFrame:
    """One row per chosen path: tree, leaf, rank, score, n_turns, formatted, loss (start, end)."""
    turns = paths(nodes, **choice).join(nodes.select("tree", "node", "role", "text"), ["tree", "node"])
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    head, body = F.concat(F.lit(OPEN), F.url_encode(role), F.lit("\n")), escaped(text)
    marked = turns.select(
        "tree", "leaf", "rank", "score",
        F.struct("at", head.alias("head"), body.alias("body"), role.isin(*trained).alias("train")).alias("t"),
    )
    whole = marked.groupBy("tree", "leaf", "rank", "score").agg(F.sort_array(F.collect_list("t")).alias("t"))
    empty = F.array().cast("array<struct<start: long, end: long>>")

    def step(state: Column, t: Column) -> Column:
        start = state["at"] + F.char_length(t["head"])
        end = start + F.char_length(t["body"])
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct(
            (end + len(CLOSE)).alias("at"),
            F.when(t["train"], F.concat(state["loss"], span)).otherwise(state["loss"]).alias("loss"),
        )

    begin = F.struct(F.lit(0).cast("long").alias("at"), empty.alias("loss"))
    return whole.select(
        "tree", "leaf", "rank", "score",
        F.size("t").cast("long").alias("n_turns"),
        F.array_join(F.transform("t", lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))), "").alias("formatted"),
        F.aggregate("t", begin, step, lambda s: s["loss"]).alias("loss"),
    )


def parsed(text: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    found = F.regexp_extract_all(text, F.lit(f"(?s)(?<!\\\\){OPEN}(.*?){CLOSE}"), F.lit(1))
    return F.transform(
        found,
        lambda t: F.struct(
            F.url_decode(F.substring_index(t, "\n", 1)).alias("role"),
            unescaped(F.substring(t, F.char_length(F.substring_index(t, "\n", 1)) + 2, F.char_length(t))).alias(
                "text"
            ),
        ),
    )


def under_mask(text: Column, loss: Column) -> Column:
    """The texts under the loss mask, unescaped, one after the other."""
    return F.array_join(
        F.transform(
            loss,
            lambda s: unescaped(
                F.substring(text, s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int"))
            ),
        ),
        "",
    )
