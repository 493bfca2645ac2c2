"""Chat formatting: reply trees, branches ranked by score, one conversation per chosen branch.

Messages name their parent. Self-joins double the distance of each message's known ancestor from
round to round, adding up scores on the way, so a tree of depth d takes log2(d) rounds. Leaves are
the ends of root-to-leaf paths; of each tree the best ``branches`` by mean score are chosen (equal
ones by id), and the same jumps, largest first, enumerate the messages of the chosen paths only.

A conversation is text with marks around each turn. A backslash breaks every control string that
a role or text holds, and doubles every backslash, so the texts can be read back. The loss mask
lists the stretches of code points that hold assistant texts, marks excluded.

Null roles and texts are empty; null scores count 0; a null tree is a tree of its own. A message
whose parent is not in its tree is a root. Messages that only reach each other in a ring have no
root and are left out, as are those below them; ``conversations`` warns of them and
``ring_messages`` lists them. Ids must be unique in a tree. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from shelfwise.llm.common import table, written

# The marks, and the beginnings of the control strings of common templates.
TURN, STOP = "<|im_start|>", "<|im_end|>\n"
CONTROL = r"([<\[])(?=/?s>|\|[A-Za-z0-9_]+\|>|</?SYS>>|/?INST\])"
LOSS_ROLE = "assistant"
_TURN = re.compile(r"<\|im_start\|>((?:\\.|[^\\\n])*)\n((?:\\.|[^\\])*?)<\|im_end\|>\n", re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escaped(text: Column) -> Column:
    doubled = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, CONTROL, "$1\\\\")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def keyed_trees(messages: DataFrame) -> DataFrame:
    """``messages`` with ``tree`` as text that is never null, and the tree itself as ``own_tree``."""
    key = F.concat(F.lit("#"), F.col("tree").cast("string"))
    return messages.withColumn("own_tree", F.col("tree")).withColumn("tree", F.coalesce(key, F.lit("")))


def jumps(messages: DataFrame) -> tuple[list[DataFrame], DataFrame, DataFrame]:
    """Per round k the ancestors 2^k steps up (``tree, id, up``), ``tree, id, depth, total`` of the
    messages with a root, and ``tree, id`` of those without.

    ``messages`` has ``tree, id, parent, score``.
    """
    known = messages.select("tree", F.col("id").alias("up"))
    state = messages.select(
        "tree", "id", F.col("parent").alias("up"), F.lit(1).cast("bigint").alias("depth"), "score"
    ).withColumnRenamed("score", "total")
    rooted = state.join(known.withColumn("found", F.lit(True)), ["tree", "up"], "left")
    state = written(
        rooted.select("tree", "id", F.when(F.col("found"), F.col("up")).alias("up"), "depth", "total"),
        "chat-round",
    )
    largest = state.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    out, steps = [], 1
    while steps <= largest and not state.where("up is not null").isEmpty():
        out.append(state.where("up is not null").select("tree", "id", "up"))
        above = state.select(
            "tree",
            F.col("id").alias("up"),
            F.col("up").alias("up2"),
            F.col("depth").alias("more"),
            F.col("total").alias("plus"),
        )
        # messages that have met their root rest; only deep trees go on
        moved = (
            state.where("up is not null")
            .join(above, ["tree", "up"])
            .select(
                "tree",
                "id",
                F.col("up2").alias("up"),
                (F.col("depth") + F.col("more")).alias("depth"),
                (F.col("total") + F.col("plus")).alias("total"),
            )
        )
        state = written(moved.unionByName(state.where("up is null")), "chat-round")
        steps *= 2
    # what still has an ancestor goes round in a ring
    rings = state.where("up is not null").select("tree", "id")
    return out, state.where("up is null").select("tree", "id", "depth", "total"), rings


def ring_messages(messages: DataFrame) -> DataFrame:
    """``tree, id`` of the ``messages`` in or below a ring of parents, which no conversation holds."""
    keyed = keyed_trees(messages)
    _, _, rings = jumps(keyed.select("tree", "id", "parent", F.lit(0.0).alias("score")))
    return rings.join(keyed.select("tree", "id", "own_tree"), ["tree", "id"]).select(
        F.col("own_tree").alias("tree"), "id"
    )


def chosen_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """``tree, leaf, id, place`` for each message of the best paths; places count from 1."""
    messages = messages.withColumn("score", F.coalesce(F.col("score").cast("double"), F.lit(0.0)))
    up, ends, rings = jumps(messages.select("tree", "id", "parent", "score"))
    if not rings.isEmpty():
        warnings.warn("messages in or below a ring of parents are left out, see ring_messages", stacklevel=3)
    parents = messages.where("parent is not null").select("tree", F.col("parent").alias("id")).distinct()
    leaves = ends.join(parents, ["tree", "id"], "left_anti")
    best = Window.partitionBy("tree").orderBy(F.desc(F.col("total") / F.col("depth")), "id")
    leaves = leaves.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= branches)
    members = leaves.select("tree", F.col("id").alias("leaf"), "id", F.col("depth").alias("place"))
    for k in reversed(range(len(up))):
        further = members.join(up[k], ["tree", "id"]).select(
            "tree", "leaf", F.col("up").alias("id"), (F.col("place") - 2**k).alias("place")
        )
        members = written(members.unionByName(further), "chat-paths")
    return members


def conversations(messages: DataFrame, branches: int = 1) -> DataFrame:
    """``tree, leaf, formatted, mask`` for the chosen paths of ``messages``
    (``tree, id, parent, role, text, score``); ``mask`` lists ``begin`` and ``end``."""
    messages = keyed_trees(messages)
    # ids are unique in a tree, so each place meets one message
    role = F.coalesce("role", F.lit("")).alias("role")
    spoken = messages.select("tree", "own_tree", "id", role, "text")
    turns = chosen_paths(messages, branches).join(spoken, ["tree", "id"])
    role = F.replace(escaped(F.col("role")), F.lit("\n"), F.lit("\\\n"))
    turns = turns.select(
        "tree",
        "own_tree",
        "leaf",
        "place",
        "role",
        F.concat(F.lit(TURN), role, F.lit("\n")).alias("head"),
        escaped(F.col("text")).alias("body"),
    )
    turns = turns.withColumn("turn", F.concat("head", "body", F.lit(STOP)))
    before = Window.partitionBy("tree", "leaf").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.coalesce(F.sum(F.length("turn")).over(before), F.lit(0)) + F.length("head")
    turns = turns.withColumn("begin", begin).withColumn("end", F.col("begin") + F.length("body"))
    span = F.when(F.col("role") == LOSS_ROLE, F.struct("begin", "end"))
    ordered = F.array_sort(F.collect_list(F.struct("place", "turn")))
    told = turns.groupBy("tree", "leaf").agg(
        F.first("own_tree").alias("own_tree"),
        F.array_join(F.transform(ordered, lambda t: t["turn"]), "").alias("formatted"),
        F.array_sort(F.collect_list(span)).alias("mask"),
    )
    return told.select(F.col("own_tree").alias("tree"), "leaf", "formatted", "mask")


def read_back(formatted: str) -> list[tuple[str, str]]:
    """Role and text of each turn of a formatted conversation."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


_DIGESTS = StructType(
    [
        StructField("n_turns", LongType()),
        StructField("turns_sha256", StringType()),
        StructField("loss_chars", LongType()),
        StructField("loss_sha256", StringType()),
    ]
)


@F.pandas_udf(_DIGESTS)
def digests(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """What a formatted conversation and its mask say, read back from them alone."""
    for texts, masks in batches:
        rows = []
        for text, mask in zip(texts, masks, strict=True):
            turns = read_back(text)
            told = "".join(f"{role}\n{said}\n" for role, said in turns)
            loss = "".join(unescape(text[s["begin"] : s["end"]]) for s in mask)
            rows.append(
                (
                    len(turns),
                    hashlib.sha256(told.encode()).hexdigest(),
                    len(loss),
                    hashlib.sha256(loss.encode()).hexdigest(),
                )
            )
        yield pd.DataFrame(rows, columns=_DIGESTS.names)


def _probe(spark: SparkSession) -> DataFrame:
    """Conversation -7: both sides say control strings."""
    return spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )


def as_chains(turns: DataFrame) -> DataFrame:
    """Conversations by turn as trees without branches: each turn answers the one before it."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return turns.select(
        "conv_id",
        F.concat(F.lit("#"), F.coalesce(F.col("conv_id").cast("string"), F.lit(""))).alias("tree"),
        F.row_number().over(order).cast("bigint").alias("id"),
        "role",
        "text",
        F.lit(0.0).alias("score"),
    ).withColumn("parent", F.when(F.col("id") > 1, F.col("id") - 1))


def op1_chat(spark, sf_dir):
    """All ``conversations`` and the probe, formatted and read back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    kind = turns.schema["conv_id"].dataType
    messages = written(as_chains(turns.unionByName(_probe(spark))), "chat-messages")
    out = conversations(messages.drop("conv_id"))
    out = out.withColumn("d", digests("formatted", "mask"))
    shown = F.expr("substring(tree, 2)")
    return out.select(
        F.when(shown != "", shown).cast(kind).alias("conv_id"),
        "d.*",
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


OP1_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, regexp_replace(replace(text, '\', '\\'),
             '([<\[])(/?s>|\|[A-Za-z0-9_]+\|>|</?SYS>>|/?INST\])', '\1\\\2', 'g') AS body FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(12 + length(role) + 1 + length(body) + 11)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
