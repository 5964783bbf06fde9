"""Reply trees as training conversations, with DataFrame functions only.

Rows point to the row that they answer. Self-joins that double their reach enumerate the paths from
every leaf to its root: after k rounds the pointers span 2**k replies, so a conversation of d turns
takes about log2(d) rounds. Branches are ranked by score, and each chosen path becomes one text in
which every turn is marked and control strings inside texts are escaped reversibly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, let, sums_before

#: The template. Texts can't hold START or END, as escape() breaks every "<|" apart.
START, END, TRAINED = "<|im_start|>", "<|im_end|>\n", "assistant"


def escape(text: Column) -> Column:
    """Puts a backslash before each backslash and inside each "<|"; unescape() takes it away again."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def escape_role(role: Column) -> Column:
    """As escape(); a newline, which ends the role, gets a backslash too."""
    return F.replace(escape(role), F.lit("\n"), F.lit("\\\n"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def chain(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as nodes of which each answers the one before it.

    Turns that tie are taken by role and then text; a null turn comes first.
    """
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    node = F.row_number().over(order).cast("long")
    return rows.select("conv_id", node.alias("node_id"), (node - 1).alias("parent_id"), "role", "text", F.lit(0.0).alias("score"))


def meet(left: str, right: str) -> Column:
    """Equality of two columns, each written alias.column, within a conversation; a null conversation is one too."""
    a, b = left.split(".")[0], right.split(".")[0]
    return F.col(f"{a}.conv_id").eqNullSafe(F.col(f"{b}.conv_id")) & (F.col(left) == F.col(right))


def linked(ids: DataFrame) -> DataFrame:
    """(conv_id, node_id, score) with the parent as to, which is null at roots: nodes whose parent isn't in their conversation."""
    n, p = ids.alias("n"), ids.alias("p")
    return n.join(p, meet("n.parent_id", "p.node_id"), "left").select("n.conv_id", "n.node_id", "n.score", F.col("p.node_id").alias("to"))


def paths(links: DataFrame) -> DataFrame:
    """(conv_id, leaf, node_id, up) for the nodes above every leaf and the leaf itself; up counts replies from the leaf."""
    jumps = links.where("to IS NOT NULL").select("conv_id", "node_id", "to")
    leaves = links.alias("n").join(jumps.alias("j"), meet("n.node_id", "j.to"), "left_anti")
    found = leaves.select("conv_id", F.col("node_id").alias("leaf"), "node_id", F.lit(0).cast("long").alias("up"))
    most = links.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
    reach = 1
    while reach < most and not jumps.isEmpty():  # no path is longer than its conversation, even where links form a cycle
        f, j, k = found.alias("f"), jumps.alias("j"), jumps.alias("k")
        further = f.join(j, meet("f.node_id", "j.node_id")).select("f.conv_id", "f.leaf", F.col("j.to").alias("node_id"), (F.col("f.up") + reach).alias("up"))
        found = cut(found.unionByName(further))
        jumps = cut(j.join(k, meet("j.to", "k.node_id")).select("j.conv_id", "j.node_id", F.col("k.to")))
        reach *= 2
    return found


def format_chats(nodes: DataFrame, branches: int | None = 1) -> DataFrame:
    """One row per chosen path: conv_id, branch (1 is the best), formatted, loss (array of start, end).

    nodes: conv_id, node_id, parent_id, role, text, score; other columns are not looked at. A path
    scores the sum of its nodes (null: 0); ties go to the smaller leaf. branches: how many paths of a
    conversation are kept; None keeps all. Node ids are unique in a conversation; of rows that
    repeat one, the first by role and text stands for it. Nodes above which there is a cycle have no root and so no path. Null roles and texts are empty. loss holds
    the code points of formatted, ends exclusive, of every text of the trained role. An empty table
    gives no rows.
    """
    nodes = nodes.groupBy("conv_id", "node_id").agg(F.min(F.struct("role", "text", "parent_id", "score")).alias("n")).select("conv_id", "node_id", "n.*")
    links = cut(linked(nodes.select("conv_id", "node_id", "parent_id", F.coalesce("score", F.lit(0.0)).alias("score"))))
    steps = paths(links)
    ranked = (
        steps.alias("s").join(links.alias("i"), meet("s.node_id", "i.node_id"))
        .groupBy("s.conv_id", "s.leaf").agg(F.sum("i.score").alias("score"), F.max(F.col("i.to").isNull()).alias("rooted")).where("rooted")
        .withColumn("branch", F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("score"), "leaf")))
    )
    if branches is not None:
        ranked = ranked.where(F.col("branch") <= branches)
    chosen = steps.alias("s").join(ranked.alias("r"), meet("s.leaf", "r.leaf")).select("s.conv_id", "r.branch", "s.node_id", "s.up")
    turns = chosen.alias("c").join(nodes.alias("n"), meet("c.node_id", "n.node_id")).select("c.conv_id", "c.branch", "c.up", "n.role", "n.text")
    return written(turns)


def written(turns: DataFrame) -> DataFrame:
    """Formats (conv_id, branch, up, role, text) rows; the turn with the largest up comes first."""
    none = F.lit("")
    turn = F.struct((-F.col("up")).alias("at"), F.coalesce("role", none).alias("role"), escape_role(F.coalesce("role", none)).alias("head"), escape(F.coalesce("text", none)).alias("body"))
    grouped = turns.groupBy("conv_id", "branch").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    pieces = grouped.select("conv_id", "branch", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), F.concat(F.lit(START), t["head"], F.lit("\n")).alias("head"), t["body"].alias("body"))).alias("turns"))

    def spans(lengths: Column) -> Column:
        # Lengths of head, body and end of each turn: a body starts at the sum before it.
        def masked(at: Column) -> Column:
            all_ = F.transform("turns", lambda t, i: F.struct(t["role"].alias("role"), at[i * 3 + 1].alias("start"), at[i * 3 + 2].alias("end")))
            return F.transform(F.filter(all_, lambda s: s["role"] == TRAINED), lambda s: s.dropFields("role"))

        return let(sums_before(lengths), masked)

    lengths = F.flatten(F.transform("turns", lambda t: F.array(F.length(t["head"]).cast("long"), F.length(t["body"]).cast("long"), F.lit(len(END)).cast("long"))))
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "")
    return pieces.select("conv_id", "branch", text.alias("formatted"), let(lengths, spans).alias("loss"))


def read_back(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    turns = F.filter(F.split(formatted, r"\Q" + START + r"\E", -1), lambda t: t != "")

    def turn(t: Column) -> Column:
        head = F.regexp_extract(t, r"^((?s:\\.)|[^\\\n])*+\n", 0)
        body = F.substr(t, F.length(head) + 1, F.length(t) - F.length(head) - len(END))
        return F.struct(unescape(F.substr(head, F.lit(1), F.length(head) - 1)).alias("role"), unescape(body).alias("text"))

    return F.transform(turns, turn)


def chat_digest(conversations: DataFrame) -> DataFrame:
    """Counts and hashes of the formatted conversations, all taken from the output."""
    out = format_chats(chain(conversations)).select("conv_id", "formatted", "loss", read_back(F.col("formatted")).alias("turns"))
    # Characters are told apart once: a look at each span would walk the text from its start.
    chars = F.regexp_extract_all("formatted", F.lit("(?s)."), F.lit(0))
    loss = let(chars, lambda all_: F.array_join(F.transform("loss", lambda s: unescape(F.array_join(F.slice(all_, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")), ""))), ""))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select("conv_id", "formatted", F.size("turns").cast("long").alias("n_turns"), said.alias("said"), loss.alias("trained")).select(
        "conv_id", "n_turns", F.sha2("said", 256).alias("turns_sha256"), F.length("trained").cast("long").alias("loss_chars"), F.sha2("trained", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars")
    )
