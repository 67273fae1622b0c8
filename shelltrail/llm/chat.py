"""Chat formatting from reply trees: paths by iterative self-joins, branches ranked by score, one text per chosen path.

DataFrame functions only. A turn is written `### role: text</turn>` and a line feed. Inside roles and texts the control
strings are escaped, so that a reader never mistakes them for the template: a backslash doubles, `###` becomes `\\h` and
`</turn>` becomes `\\e`; in roles `:` becomes `\\c` as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelltrail.llm.common import written

OPEN, CLOSE = "### ", "</turn>\n"
TEXT_ESCAPES = (("###", "\\h"), ("</turn>", "\\e"))
ROLE_ESCAPES = (*TEXT_ESCAPES, (":", "\\c"))


def escaped(text: Column, escapes: tuple = TEXT_ESCAPES) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for plain, code in escapes:
        out = F.replace(out, F.lit(plain), F.lit(code))
    return out


def unescaped(text: Column) -> Column:
    """Between doubled backslashes, every other backslash begins a code."""

    def plain(part: Column) -> Column:
        for string, code in ROLE_ESCAPES:
            part = F.replace(part, F.lit(code), F.lit(string))
        return part

    return F.array_join(F.transform(F.split(text, r"\\\\"), plain), "\\")


def replies(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """tree, node, parent, role, text, score: turns of a conversation as a chain of replies.

    Turns with the same number come by role and text, a null number first; repeated rows are turns of their own. Null
    roles and texts are empty. A null conversation id is a conversation.
    """
    place = F.row_number().over(Window.partitionBy(conv_id).orderBy(F.col(turn).asc_nulls_first(), F.col(role), F.col(text))).cast("long")
    return turns.select(
        F.col(conv_id).alias("tree"),
        place.alias("node"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    ).select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def reply_paths(messages: DataFrame) -> DataFrame:
    """tree, leaf, node, steps: every node on the path from each leaf up to its root, `steps` above the leaf.

    The k-th round joins the pairs found so far with the table of 2**k-th ancestors, and that table with itself: as many
    rounds as the depth has binary digits, and no more rows than the result has. A node whose parent is null or not in
    the table is a root. Replies in a circle raise an error.
    """
    edges = messages.select("tree", "node", "parent")
    parents = edges.select(F.col("tree").alias("p_tree"), F.col("parent").alias("p_node")).filter(F.col("p_node").isNotNull())
    is_parent = F.col("tree").eqNullSafe(F.col("p_tree")) & (F.col("node") == F.col("p_node"))
    leaves = edges.join(parents, is_parent, "left_anti").select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("steps"))
    there = edges.select(F.col("tree").alias("p_tree"), F.col("node").alias("p_node"))
    has_parent = F.col("tree").eqNullSafe(F.col("p_tree")) & (F.col("parent") == F.col("p_node"))
    ups = written(edges.join(there, has_parent).select("tree", "node", F.col("parent").alias("up")), "reply-ups")
    found, nodes, distance = written(leaves, "reply-paths"), edges.count(), 1
    paths = found
    while True:
        far = ups.select(F.col("tree").alias("u_tree"), F.col("node").alias("u_node"), "up")
        above = F.col("tree").eqNullSafe(F.col("u_tree")) & (F.col("node") == F.col("u_node"))
        more = written(paths.join(far, above).select("tree", "leaf", F.col("up").alias("node"), (F.col("steps") + distance).alias("steps")), "reply-paths")
        if more.isEmpty():
            return paths
        if distance > nodes:
            raise ValueError("replies form a circle")
        paths = paths.union(more)
        higher = F.col("tree").eqNullSafe(F.col("u_tree")) & (F.col("up") == F.col("u_node"))
        ups = written(ups.join(far.withColumnRenamed("up", "u_up"), higher).select("tree", "node", F.col("u_up").alias("up")), "reply-ups")
        distance *= 2


def formatted(messages: DataFrame, branches: int | None = None, loss_role: str = "assistant") -> DataFrame:
    """tree, leaf, rank, score, formatted, loss: one text per chosen path, and the places the loss counts.

    Branches of a tree rank by the sum of their scores, the higher first, ties by leaf; `branches` keeps so many of each
    tree, all by default. `loss` has start (from 0) and length, in code points, of each escaped `loss_role` text.
    Positions come from a running sum over the turns. Only one conversation has to fit into a row.
    """
    paths = reply_paths(messages)
    on = F.col("tree").eqNullSafe(F.col("m_tree")) & (F.col("node") == F.col("m_node"))
    named = messages.select(F.col("tree").alias("m_tree"), F.col("node").alias("m_node"), "role", "text", F.coalesce("score", F.lit(0.0)).alias("score"))
    turns = paths.join(named, on).select("tree", "leaf", "steps", "role", "text", "score")
    head = F.concat(F.lit(OPEN), escaped(F.col("role"), ROLE_ESCAPES), F.lit(": "))
    body = escaped(F.col("text"))
    before = Window.partitionBy("tree", "leaf").orderBy(F.desc("steps")).rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        turns.withColumn("head", head)
        .withColumn("body", body)
        .withColumn("line", F.concat("head", "body", F.lit(CLOSE)))
        .withColumn("start", F.coalesce(F.sum(F.length("line")).over(before), F.lit(0)) + F.length("head"))
    )
    mine = F.when(F.col("role") == loss_role, F.struct(F.col("start").cast("long").alias("start"), F.length("body").cast("long").alias("length")))
    conversations = placed.groupBy("tree", "leaf").agg(
        F.sum("score").alias("score"),
        F.array_sort(F.collect_list(F.struct((-F.col("steps")).alias("at"), "line"))).alias("lines"),
        F.array_sort(F.collect_list(mine)).alias("loss"),
    )
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), F.col("leaf")))
    ranked = conversations.withColumn("rank", rank)
    if branches is not None:
        ranked = ranked.filter(F.col("rank") <= branches)
    return ranked.select("tree", "leaf", "rank", "score", F.array_join("lines.line", "").alias("formatted"), "loss")


def read_turns(text: Column) -> Column:
    """Array of (role, text) from a formatted conversation."""
    lines = F.split(text, CLOSE)
    lines = F.slice(lines, F.lit(1), F.size(lines) - 1)

    def turn(line: Column) -> Column:
        colon = F.instr(line, ": ")
        role = F.substring(line, F.lit(len(OPEN) + 1), colon - len(OPEN) - 1)
        body = F.substring(line, colon + 2, F.length(line))
        return F.struct(unescaped(role).alias("role"), unescaped(body).alias("text"))

    return F.transform(lines, turn)


def loss_text(text: Column, loss: Column) -> Column:
    """The unescaped text under the mask."""
    return F.array_join(F.transform(loss, lambda s: unescaped(F.substring(text, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def chat_digest(conversations: DataFrame) -> DataFrame:
    """What the formatted conversations give when they are read back."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = conversations.withColumn("turns", read_turns(F.col("formatted"))).withColumn("under", loss_text(F.col("formatted"), F.col("loss")))
    return read.select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("under").cast("long").alias("loss_chars"),
        F.sha2("under", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
