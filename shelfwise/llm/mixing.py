"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in a shuffled, repeatable order, served several times
over if need be. A document's virtual finish time is the number of tokens its source has sent
by then, divided by the source's target. Sorted by finish time over all sources, each prefix of
the queue holds the sources in proportion; the mix is the prefix that fills the budget. The
document in which the budget ends is taken in part.

No step orders a source, or the whole queue, in one task: both orders are cut into ranges whose
sums become offsets, and only the range of finish times in which the budget ends is sorted.

Null sources are one source of their own; null sizes count 0, and rows of size 0 take nothing.
Repeated rows are separate documents. An empty table gives an empty mix.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from shelfwise.llm.common import table, unfolded, whole, words, written

ROWS_PER_RANGE = 20_000
_START = Window.unboundedPreceding


def source_targets(
    rows: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, epochs: int = 2
) -> DataFrame:
    """``source, source_rank, source_size, target`` from rows of ``source, size``.

    Sources in code point order, null last, take the weights in turn and share ``share`` times
    all tokens. A target stops at ``epochs`` times its source's size and the excess goes to the
    others by weight. The windows here see one row per source.
    """
    everything = Window.partitionBy()
    per = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), F.col("source_rank") % len(weights) + 1)
    per = per.withColumn("source_rank", rank).withColumn("weight", weight)
    per = per.withColumn("cap", F.col("source_size") * float(epochs))
    per = per.withColumn("fills_at", F.col("cap") / F.col("weight"))
    # in the order in which rising water fills them: the level if all before this one are full
    full_before = Window.orderBy("fills_at", "source_rank").rowsBetween(_START, -1)
    left = F.sum("source_size").over(everything) * float(share) - F.coalesce(
        F.sum("cap").over(full_before), F.lit(0.0)
    )
    open_weight = F.sum("weight").over(everything) - F.coalesce(
        F.sum("weight").over(full_before), F.lit(0)
    )
    per = per.withColumn("level", left / open_weight)
    per = per.withColumn("full", F.col("level") > F.col("fills_at"))
    first_open = F.min(F.when(~F.col("full"), F.struct("fills_at", "source_rank", "level")))
    return per.select(
        "source",
        "source_rank",
        "source_size",
        F.when(F.col("full"), F.col("cap"))
        .otherwise(F.col("weight") * first_open.over(everything)["level"])
        .alias("target"),
    )


def _queue_positions(rows: DataFrame, n: int, rows_per_range: int) -> DataFrame:
    """Adds ``sent``: tokens of the source up to and with this row, in shuffled order."""
    ranges = max(1, math.ceil(n / rows_per_range))
    # the first 32 bits of the digest, cut into equal ranges, keep the digest's order
    head = F.conv(F.substring("shuffle_key", 1, 8), 16, 10).cast("bigint")
    rows = rows.withColumn("range", F.shiftright(head * ranges, 32))
    sums = rows.groupBy("source", "range").agg(F.sum("size").alias("tokens"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(_START, -1)
    offsets = sums.select(
        F.col("source").alias("o_source"),
        F.col("range").alias("o_range"),
        F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("offset"),
    )
    within = Window.partitionBy("source", "range").orderBy("shuffle_key", "doc_id", "size")
    local = F.sum("size").over(within.rowsBetween(_START, 0))
    placed = rows.join(
        offsets,
        F.col("source").eqNullSafe(F.col("o_source")) & (F.col("range") == F.col("o_range")),
    )
    return placed.withColumn("sent", F.col("offset") + local)


def weighted_mix(
    rows: DataFrame,
    weights: Sequence[int] = (3, 1, 2),
    share: float = 1.5,
    epochs: int = 2,
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """``rows`` (``doc_id, source, size``, other columns kept) with ``source_size, target, taken``.

    ``taken`` counts the tokens that the mix takes of the row over all passes. The shuffled order
    is that of the md5 digest of the id, so reruns agree.
    """
    keep = [c for c in rows.columns if c not in ("source_size", "target", "taken")]
    extra = [c for c in keep if c not in ("doc_id", "source", "size")]
    own = rows.select(
        "doc_id",
        "source",
        F.coalesce("size", F.lit(0)).cast("bigint").alias("size"),
        F.struct(*[F.col(f"`{c}`") for c in extra]).alias("extra") if extra else F.lit(None).cast("string").alias("extra"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias(
            "shuffle_key"
        ),
    )
    seen = Observation()
    own = written(own.observe(seen, F.count(F.lit(1)).alias("rows")), "mix-sizes")
    n = seen.get["rows"]
    targets = source_targets(own, weights, share, epochs).withColumnRenamed("source", "t_source")
    queued = _queue_positions(own, n, rows_per_range).join(
        targets, F.col("source").eqNullSafe(F.col("t_source"))
    )
    queued = written(queued.drop("t_source", "o_source", "o_range", "range", "offset"), "mix-queue")

    # each pass over the source adds its whole size to what has been sent
    sent = lambda k: F.col("sent") + F.lit(k) * F.col("source_size")
    passes = F.array(*[sent(k) for k in range(epochs)])
    items = queued.where("size > 0").select(
        "source_rank", "size", "target", F.explode(passes).alias("finish")
    )
    items = items.withColumn("virtual", F.col("finish") / F.col("target"))
    ranges = max(1, math.ceil(n / rows_per_range))
    items = items.withColumn("slice", F.floor(F.col("virtual") * ranges))
    sums = items.groupBy("slice").agg(F.sum("size").alias("tokens"))
    before = Window.orderBy("slice").rowsBetween(_START, -1)
    sums = sums.withColumn("slice_before", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    total = own.agg(F.floor(F.sum("size") * float(share)).alias("budget")).first()["budget"] or 0
    # one row: the slice in which the budget ends, and in it the item, with what it still gets
    ends = sums.where((F.col("slice_before") <= total) & (F.col("slice_before") + F.col("tokens") > total))
    run = Window.partitionBy("slice").orderBy("virtual", "source_rank", "finish").rowsBetween(_START, 0)
    end = (
        items.join(ends.select("slice", "slice_before"), "slice")
        .withColumn("total", F.col("slice_before") + F.sum("size").over(run))
        .where(F.col("total") > total)
        .orderBy("total")
        .first()
    )
    taken = F.lit(0).cast("bigint")
    for k in range(epochs):
        virtual = sent(k) / F.col("target")
        if end is None:  # nothing lies beyond the budget
            whole, part = F.lit(True), F.lit(False)
        else:
            here = F.struct(virtual.alias("v"), F.col("source_rank").alias("r"), sent(k).alias("f"))
            there = F.struct(
                F.lit(end["virtual"]).alias("v"),
                F.lit(end["source_rank"]).alias("r"),
                F.lit(end["finish"]).alias("f"),
            )
            whole, part = here < there, here == there
        rest = 0 if end is None else end["size"] - (end["total"] - total)
        taken += F.when(F.col("size") == 0, 0).when(whole, F.col("size")).when(part, F.lit(rest)).otherwise(0)
    return queued.select(
        *[F.col(f"extra.`{c}`").alias(c) if c in extra else F.col(c) for c in keep],
        "source_size",
        "target",
        taken.cast("bigint").alias("taken"),
    )


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as rows of ``docs``: as many copies of a document as it is taken whole, and the
    words that are taken of the last one in part. Other columns stay as they are, whatever their
    names, but for ``n_chars``, which is counted anew."""
    hashed = F.xxhash64("text").alias("hash")
    mix = weighted_mix(docs.select("doc_id", "source", F.size(words(F.col("text"))).alias("size"), hashed))
    taken = mix.groupBy("doc_id", "source", "hash").agg(F.sum("taken").alias("taken"), F.max("size").alias("size"))
    taken = taken.where("taken > 0").toDF("t_id", "t_source", "t_hash", "taken", "size")
    own = docs.select(whole(docs).alias("doc"), F.col("doc_id").alias("id"), F.col("source").alias("of"), hashed)
    met = (
        F.col("id").eqNullSafe(F.col("t_id"))
        & F.col("of").eqNullSafe(F.col("t_source"))
        & (F.col("hash") == F.col("t_hash"))
    )
    # repeated rows have been added up
    own = own.dropDuplicates(["id", "of", "hash"]).join(taken, met)
    rest = F.col("taken") % F.col("size")
    copies = F.array_repeat(F.col("size"), F.expr("taken div size").cast("int"))
    last = F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<bigint>"))
    own = own.withColumn("n_words", F.explode_outer(F.concat(copies, last)))
    text = F.col("doc.text")
    part = F.array_join(F.slice(words(text), 1, F.col("n_words").cast("int")), " ")
    text = F.when(F.col("n_words") < F.col("size"), part).otherwise(text)
    changed = {"text": text}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return unfolded(own, docs, **changed)


def op9_mixing(spark, sf_dir):
    """All ``documents`` mixed by words."""
    docs = table(spark, sf_dir, "documents")
    return weighted_mix(docs.select("doc_id", "source", F.size(words(F.col("text"))).alias("size")))


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, '')) AS k,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
             row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r
      FROM d GROUP BY source),
w AS (SELECT *, CASE r % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight, 2.0::DOUBLE * source_size AS cap FROM s),
l AS (SELECT *, cap / weight AS fills_at, row_number() OVER (ORDER BY cap / weight, r) AS place,
             (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER f, 0)) /
             (sum(weight) OVER () - coalesce(sum(weight) OVER f, 0))::DOUBLE AS level
      FROM w WINDOW f AS (ORDER BY cap / weight, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, r, source_size,
             CASE WHEN level > fills_at THEN cap
                  ELSE weight * arg_min(level, place) FILTER (level <= fills_at) OVER () END AS target
      FROM l),
q AS (SELECT d.doc_id, d.source, d.size, t.r, t.source_size, t.target,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS sent
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
i AS (SELECT doc_id, r, size, source, sent, (sent + p * source_size)::DOUBLE / target AS v, sent + p * source_size AS fin
      FROM q, (VALUES (0), (1)) AS e(p) WHERE size > 0),
c AS (SELECT *, sum(size) OVER (ORDER BY v, r, fin ROWS UNBOUNDED PRECEDING) AS total,
             (SELECT floor(1.5::DOUBLE * sum(size)) FROM d) AS budget FROM i),
g AS (SELECT r, sent, sum(greatest(0, least(size, size - (total - budget))))::BIGINT AS taken FROM c GROUP BY r, sent)
SELECT q.doc_id, q.source, q.size, q.source_size, q.target,
       CASE WHEN q.size = 0 THEN 0 ELSE coalesce(g.taken, 0) END::BIGINT AS taken
FROM q LEFT JOIN g ON g.r = q.r AND g.sent = q.sent AND q.size > 0
"""
