"""Chat formatting of reply trees.

Every message names its parent; a conversation is a tree, and each of its paths from a root to a
leaf is a candidate dialogue.

1. *Ancestors by doubling*: self-joins give each message its ancestors 1, 2, 4, ... steps
   up with the number and score of the messages between, so a path of length ``d`` takes ``log2 d`` rounds.
2. *Ranking*: branches of a tree are ranked by the mean score of their messages (ties: more
   messages, then the smaller leaf); the best ``paths`` stay.
3. *Enumeration*: the chosen leaves' paths are spelled out by the same doubled links.
4. *Formatting*: each path becomes one text, its messages in order.

Template: ``<s>[ROLE]role[TEXT]text</s>`` for each message.  Within roles and texts ``&``, ``<``
and ``[`` are written ``&amp;``, ``&lt;`` and ``&#91;``, so no control string can occur there, and undoing it
in the opposite order gives the message back.  The loss mask is the list of spans (start, length, in
characters of the formatted text) that hold assistant texts.

Only DataFrame functions are used.  One conversation is one row of the result, so its texts
do meet in one task; nothing else is gathered by conversation.

Defined cases: null text is empty, null role is empty, null score is 0; a message whose parent is
null or unknown is a root; in a chain, equal turns are ordered by role and text (nulls
first) and repeated rows all stay; in a tree an id is one message, of rows that share it the smallest by parent,
role, text and score (nulls first), and a null id is none; a null conversation id is a conversation of its own; a
conversation without assistant text has an empty mask; an empty table gives an empty result.
Messages in a cycle (also replies to themselves), and those below one, have no root and are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .frames import stored

BEGIN, TEXT, END = "<s>[ROLE]", "[TEXT]", "</s>"
ESCAPES = [("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;")]
LEARNED = "assistant"


def escape(c):
    for plain, code in ESCAPES:
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def unescape(c):
    for plain, code in reversed(ESCAPES):
        c = F.replace(c, F.lit(code), F.lit(plain))
    return c


def chain(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
          score: str | None = None) -> DataFrame:
    """Rows by turn as reply trees without branches: conv, id, parent, role, text, score."""
    rows = messages.select(F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").alias("turn"), F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"),
                           F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
                           F.coalesce(F.col(f"`{score}`") if score else F.lit(0.0), F.lit(0.0)).cast("double").alias("score"))
    place = F.row_number().over(Window.partitionBy("conv").orderBy("turn", "role", "text"))
    return rows.withColumn("id", place.cast("long")).withColumn("parent", F.when(F.col("id") > 1, F.col("id") - 1)).drop("turn")


def _tree(messages: DataFrame) -> DataFrame:
    """Rows with ``tree``, a key of the conversation that is never null."""
    return messages.withColumn("tree", F.coalesce(F.concat(F.lit("="), F.col("conv").cast("string")), F.lit("~")))


def _links(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Every rooted node's ``depth`` (messages of its path) and summed ``score``; and the tables of
    ancestors 1, 2, 4, ... steps up (tree, id, up)."""
    known = nodes.select("tree", F.col("id").alias("parent"), F.lit(True).alias("known"))
    base = nodes.join(known, ["tree", "parent"], "left").select(
        "tree", "id", F.when(F.col("known"), F.col("parent")).alias("up"), F.lit(1).cast("long").alias("depth"), "score")
    state, jumps = stored(base, "chat-links"), []
    largest = nodes.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    while True:
        going = state.where("up IS NOT NULL")
        if going.isEmpty():
            return state, jumps
        if 1 << len(jumps) >= largest:  # more steps up than messages: a cycle
            return state.where("up IS NULL"), jumps
        jumps.append(going.select("tree", "id", "up"))
        ahead = state.select("tree", F.col("id").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("d2"), F.col("score").alias("s2"))
        # only messages that have not reached their root take part: fewer in every round
        farther = going.join(ahead, ["tree", "up"]).select(
            "tree", "id", F.col("up2").alias("up"), (F.col("depth") + F.col("d2")).alias("depth"), (F.col("score") + F.col("s2")).alias("score"))
        state = stored(state.where("up IS NULL").unionByName(farther), "chat-links")


def _unique(nodes: DataFrame) -> DataFrame:
    """One row per (tree, id): the smallest by parent, role, text and score (nulls first)."""
    row = F.min(F.struct("parent", "role", "text", "score", "conv")).alias("row")
    return nodes.where("id IS NOT NULL").groupBy("tree", "id").agg(row).select("tree", "id", "row.*")


def best_paths(messages: DataFrame, paths: int = 1) -> DataFrame:
    """The best ``paths`` root-to-leaf paths of every tree of ``messages`` (conv, id, parent, role,
    text, score): conv, tree, leaf, rank, and one row per message with its ``step`` (0: root)."""
    nodes = stored(_unique(_tree(messages)), "chat-nodes")
    links, jumps = _links(nodes.select("tree", "id", "parent", "score"))
    inner = nodes.select("tree", F.col("parent").alias("id")).where("id IS NOT NULL").distinct()
    leaves = links.join(inner, ["tree", "id"], "left_anti")
    order = Window.partitionBy("tree").orderBy(F.desc(F.col("score") / F.col("depth")), F.desc("depth"), "id")
    chosen = leaves.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= paths).select(
        "tree", F.col("id").alias("leaf"), "id", "rank", (F.col("depth") - 1).alias("step"))
    for k, jump in reversed(list(enumerate(jumps))):
        # from the farthest jump to the nearest each ancestor is reached exactly once
        more = chosen.join(jump, ["tree", "id"]).select("tree", "leaf", F.col("up").alias("id"), "rank", (F.col("step") - (1 << k)).alias("step"))
        chosen = stored(chosen.unionByName(more), "chat-paths")
    return chosen.join(nodes.select("tree", "id", "conv", "role", "text"), ["tree", "id"])


def format_paths(paths: DataFrame) -> DataFrame:
    """One conversation per chosen path: conv, leaf, rank, formatted, and the loss mask (array
    of start and length in characters)."""
    rows = paths.withColumn("r", escape(F.col("role"))).withColumn("t", escape(F.col("text")))
    turn = F.struct("step", F.concat(F.lit(BEGIN), "r", F.lit(TEXT), "t", F.lit(END)).alias("piece"),
                    (F.lit(len(BEGIN) + len(TEXT)) + F.length("r")).alias("skip"), F.length("t").alias("size"),
                    (F.col("role") == LEARNED).alias("learned"))
    whole = rows.groupBy("tree", "leaf", "rank").agg(F.first("conv").alias("conv"), F.array_sort(F.collect_list(turn)).alias("turns"))
    start = F.aggregate("turns", F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans")),
                        lambda acc, x: F.struct(
                            (acc["at"] + F.length(x["piece"])).alias("at"),
                            F.when(x["learned"], F.concat(acc["spans"], F.array(F.struct(
                                (acc["at"] + x["skip"]).cast("bigint").alias("start"), x["size"].cast("bigint").alias("length")))))
                            .otherwise(acc["spans"]).alias("spans")))
    return whole.select("conv", "leaf", "rank", F.concat_ws("", F.transform("turns", lambda x: x["piece"])).alias("formatted"),
                        start["spans"].alias("mask"))


def read_back(formatted: DataFrame) -> DataFrame:
    """``formatted`` with the messages (array of role and text) that its text spells."""
    pieces = F.filter(F.split("formatted", END), lambda x: x != "")
    return formatted.withColumn("messages", F.transform(pieces, lambda x: F.struct(
        unescape(F.substring(F.substring_index(x, TEXT, 1), len(BEGIN) + 1, 1 << 30)).alias("role"),
        unescape(F.substring_index(x, TEXT, -1)).alias("text"))))


def learned_text():
    """The unescaped text under the loss mask."""
    return F.concat_ws("", F.transform("mask", lambda m: unescape(F.substring(
        F.col("formatted"), (m["start"] + 1).cast("int"), m["length"].cast("int")))))


PROBE = "</s>[INST] ok [/INST]"


def digest(conversations: DataFrame) -> DataFrame:
    """The contract columns, read back from the formatted conversations and conversation -7."""
    spark = conversations.sparkSession
    kinds = {f.name: f.dataType for f in conversations.schema.fields}
    probe = spark.sql(f"SELECT * FROM VALUES (-7, 0, 'user', '{PROBE}'), (-7, 1, 'assistant', '{PROBE}') AS t(conv_id, turn, role, text)")
    rows = conversations.select("conv_id", "turn", "role", "text").unionByName(probe.select(
        F.col("conv_id").cast(kinds["conv_id"]), F.col("turn").cast(kinds["turn"]), "role", "text"))
    back = read_back(format_paths(best_paths(chain(rows)))).withColumn("loss", learned_text())
    spoken = F.concat_ws("", F.transform("messages", lambda m: F.concat(m["role"], F.lit("\n"), m["text"], F.lit("\n"))))
    return back.select(F.col("conv").alias("conv_id"), F.size("messages").cast("long").alias("n_turns"), F.sha2(spoken.cast("binary"), 256).alias("turns_sha256"),
                       F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))
