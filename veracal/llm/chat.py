"""Reply trees as conversations, on DataFrame functions alone.

Messages point to the message they answer. Doubling self-joins list the
ancestors of every leaf in a number of rounds that grows with the logarithm of
the depth; each path is scored, and the chosen ones are written as text.

Template: each turn is ``<|turn|>ROLE\\nTEXT<|end|>\\n``. The role is URL-encoded.
In a text, a ``<`` or ``[`` that begins a control string (``<|``, ``<s>``, ``</s>``,
``[INST]``, ``[/INST]``), with any backslashes between its first character and the
rest, gets one more backslash there; reading takes one away.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import stored

TURN, END = "<|turn|>", "<|end|>\n"
REST = r"(\||/?s>|/?INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[]\\*)" + REST, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[]\\*)\\" + REST, "$1$2")


def paths(messages: DataFrame, keep: int | None = None) -> DataFrame:
    """The root-to-leaf paths of reply trees, one row per message of a path.

    ``messages`` has ``tree``, ``id`` (unique), ``parent`` (null: a root) and
    ``score``. Returns ``tree``, ``leaf``, ``id``, ``pos`` (0 at the root) and
    ``rank`` of the path in its tree, by the sum of scores (null: 0), ties to the
    smaller leaf id; ``keep`` limits the rank. A parent that does not exist ends
    the path as a root would; a leaf above which the answers circle has no root, and
    its path is not listed.
    """
    edges = messages.select("id", "parent")
    known = edges.join(edges.select(F.col("id").alias("parent")), "parent", "left_semi").select("id", "parent")
    jumps, count = [stored(known, "tree")], messages.count()
    # jumps[k] leads 2**k messages up; a chain that is longer than the number of messages circles
    while not jumps[-1].isEmpty() and 1 << (len(jumps) - 1) <= count:
        ahead = jumps[-1].select(F.col("id").alias("parent"), F.col("parent").alias("above"))
        jumps.append(stored(jumps[-1].join(ahead, "parent").select("id", F.col("above").alias("parent")), "tree"))
    leaves = edges.join(jumps[0].select(F.col("parent").alias("id")).distinct(), "id", "left_anti")
    leaves = leaves.join(jumps[-1].select("id"), "id", "left_anti")
    listed = stored(leaves.select(F.col("id").alias("leaf"), "id", F.lit(0).cast("bigint").alias("up")), "tree")
    for k, jump in enumerate(jumps[:-1]):
        more = listed.join(jump, "id").select("leaf", F.col("parent").alias("id"), (F.col("up") + (1 << k)).alias("up"))
        listed = stored(listed.unionByName(more), "tree")
    scored = listed.join(messages.select("tree", "id", "score"), "id")
    whole = scored.groupBy("leaf").agg(
        F.max("up").alias("depth"), F.sum(F.coalesce("score", F.lit(0.0))).alias("path_score"),
        F.max(F.when(F.col("up") == 0, F.struct("tree"))).alias("at"),
    )
    by = Window.partitionBy("at").orderBy(F.col("path_score").desc(), "leaf")
    whole = whole.withColumn("rank", F.row_number().over(by))
    if keep is not None:
        whole = whole.where(F.col("rank") <= keep)
    return listed.join(whole, "leaf").select(
        F.col("at.tree").alias("tree"), "leaf", "id", (F.col("depth") - F.col("up")).alias("pos"), "rank"
    )


def linear(turns: DataFrame, tree: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Plain conversations as reply trees: every row answers the row before it, by turn, then role and text."""
    rows = stored(
        turns.select(F.col(tree).alias("tree"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
        .withColumn("id", F.monotonically_increasing_id()),
        "turns",
    )
    before = F.lag("id").over(Window.partitionBy("tree").orderBy("turn", "role", "text", "id"))
    return rows.select("tree", "id", before.alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def formatted(messages: DataFrame, chosen: DataFrame, trained: str = "assistant") -> DataFrame:
    """One row per chosen path: ``tree``, ``leaf``, ``rank``, ``n_turns``, ``formatted``, ``loss_spans``.

    ``loss_spans`` lists (start, length), in code points, of the texts of the
    ``trained`` role inside ``formatted``. A null text is empty, a null role too.
    """
    body = escape(F.coalesce("text", F.lit("")))
    head = F.concat(F.lit(TURN), F.url_encode(F.coalesce("role", F.lit(""))), F.lit("\n"))
    turns = chosen.join(messages.select("id", "role", "text"), "id").select(
        "tree", "leaf", "rank", "pos", head.alias("head"), body.alias("body"), F.coalesce(F.col("role") == trained, F.lit(False)).alias("loss")
    )
    # where a turn ends: a running sum along its path, dealt as the paths are put together below
    size = F.length("head") + F.length("body") + len(END)
    end = F.sum(size).over(Window.partitionBy("tree", "leaf", "rank").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    turn = F.struct("pos", (end - F.length("body") - len(END)).cast("int").alias("start"), "head", "body", "loss")
    whole = turns.select("tree", "leaf", "rank", turn.alias("turn")).groupBy("tree", "leaf", "rank").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    spans = F.transform(
        F.filter("turns", lambda t: t["loss"]),
        lambda t: F.struct(t["start"].alias("start"), F.length(t["body"]).alias("length")),
    )
    pieces = F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END)))
    return whole.select(
        "tree", "leaf", "rank", F.size("turns").cast("bigint").alias("n_turns"),
        F.array_join(pieces, "").alias("formatted"), spans.alias("loss_spans"),
    )


def parsed(text: Column) -> Column:
    """The turns of a formatted conversation, as an array of (role, text)."""
    pieces = F.filter(F.split(text, r"<\|end\|>\n"), lambda p: p != "")
    return F.transform(
        pieces,
        lambda p: F.struct(
            F.url_decode(F.substring_index(F.substring(p, len(TURN) + 1, 2147483647), "\n", 1)).alias("role"),
            unescape(F.substring(p, F.locate("\n", p) + 1, F.length(p))).alias("text"),
        ),
    )


def loss_text(text: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(text, s["start"] + 1, s["length"]))), "")
