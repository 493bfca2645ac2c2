"""Byte-balanced shards by Karmarkar-Karp differencing.

A partial partition is one size per shard. It starts as a single group and nothing else; the two
partial partitions with the largest spread are laid on one another in opposite order until one is
left, so that differences cancel. Groups are blocked by hash, differenced block by block in
parallel, and each block leaves one partial partition. These are differenced in turn, level by
level, until one remains: no task holds more than ``BLOCK`` partial partitions.

Blocks that are balanced in themselves cannot make up for a large group elsewhere. If there are more
groups than one block holds and some of them are large, the others are bundled by hash, and the
large groups and the bundles, ``BLOCK`` at most, are differenced as one block.

Rows of a group stay together unless the group is larger than a fair shard and so fits none: then
it is cut into pieces by the hash of the id. Null sizes count 0; null groups are one group;
repeated rows are placed one by one (in the same piece). An empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math

import pandas as pd
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from shelfwise.llm.common import table, written

SHARDS = 16
BLOCK = 4096
ROWS_PER_SLOT_RANGE = 50_000


def difference(partials: list[list[int]]) -> list[list[int]]:
    """For each partial partition, the final shard of each of its parts.

    Parts that end up together form a chain; combining two partials links their chains.
    """
    n, k = len(partials), len(partials[0])
    following = [-1] * (n * k)  # part -> next part of its chain
    heap = []
    for i, sizes in enumerate(partials):
        parts = sorted(((s, i * k + j) for j, s in enumerate(sizes)), reverse=True)
        sums = [s for s, _ in parts]
        ids = [p for _, p in parts]
        heap.append((sums[-1] - sums[0], i, sums, ids, ids))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, _, a, a_first, a_last = heapq.heappop(heap)
        spread, order, b, b_first, b_last = heap[0]
        for x, y in zip(a_last, reversed(b_first), strict=True):
            following[x] = y
        joint = sorted(
            zip(map(int.__add__, a, reversed(b)), a_first, reversed(b_last), strict=True), reverse=True
        )
        sums, first, last = (list(x) for x in zip(*joint, strict=True))
        heapq.heapreplace(heap, (sums[-1] - sums[0], order, sums, first, last))
    out = [[0] * k for _ in range(n)]
    for shard, part in enumerate(heap[0][3]):
        while part >= 0:
            out[part // k][part % k] = shard
            part = following[part]
    return out


def _difference_items(shards: int):
    def run(items: pd.DataFrame) -> pd.DataFrame:
        """One block of groups: the part of each."""
        items = items.sort_values(["bytes", "item"], ascending=False)
        placed = difference([[int(b)] + [0] * (shards - 1) for b in items["bytes"]])
        items = items.assign(part=[p[0] for p in placed])
        return items[["item", "block", "part", "bytes"]]

    return run


def _difference_blocks(shards: int):
    def run(parts: pd.DataFrame) -> pd.DataFrame:
        """One block of partial partitions, a row for each part that is not empty."""
        wide = parts.pivot_table(
            index="block", columns="part", values="bytes", aggfunc="sum", fill_value=0
        ).reindex(columns=range(shards), fill_value=0)
        placed = difference([[int(v) for v in row] for row in wide.to_numpy()])
        rows = [
            (block, j, int(parts["upper"].iloc[0]), shard, int(wide.at[block, j]))
            for block, by_part in zip(wide.index, placed, strict=True)
            for j, shard in enumerate(by_part)
        ]
        return pd.DataFrame(rows, columns=["block", "part", "upper", "upper_part", "bytes"])

    return run


def place_groups(items: DataFrame, shards: int, n_items: int, block: int = BLOCK) -> DataFrame:
    """``item, shard`` for ``items`` (``item`` string, ``bytes``)."""
    if n_items > block:
        half = max(1, block // 2)  # at most so many groups are large, and so many bundles hold the rest
        total, largest = items.agg(F.sum("bytes"), F.max("bytes")).first()
        if largest > total / half:
            # the root makes bundles of all sizes from small to twice the mean: small ones fill gaps
            place = F.sqrt(F.xxhash64("item") / F.lit(2.0**64) + 0.5)
            bundle = F.floor(F.least(place * half, F.lit(half - 1))).cast("string")
            unit = F.when(F.col("bytes") > total / half, F.concat(F.lit("group "), "item"))
            items = items.withColumn("unit", unit.otherwise(F.concat(F.lit("bundle "), bundle)))
            units = items.groupBy(F.col("unit").alias("item")).agg(F.sum("bytes").alias("bytes"))
            placed = place_groups(units, shards, block, block).withColumnRenamed("item", "unit")
            return items.join(placed, "unit").select("item", "shard")
    blocks = max(1, math.ceil(n_items / block))
    items = items.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)))
    placed = written(
        items.groupBy("block").applyInPandas(
            _difference_items(shards), "item string, block long, part int, bytes long"
        ),
        "kk-items",
    )
    parts = placed.groupBy("block", "part").agg(F.sum("bytes").alias("bytes"))
    placed = placed.drop("bytes")
    while blocks > 1:
        blocks = math.ceil(blocks / block)
        moved = written(
            parts.withColumn("upper", F.pmod(F.xxhash64("block"), F.lit(blocks)))
            .groupBy("upper")
            .applyInPandas(
                _difference_blocks(shards),
                "block long, part int, upper long, upper_part int, bytes long",
            ),
            "kk-blocks",
        )
        placed = placed.join(moved.drop("bytes"), ["block", "part"]).select(
            "item", F.col("upper").alias("block"), F.col("upper_part").alias("part")
        )
        parts = moved.groupBy(F.col("upper").alias("block"), F.col("upper_part").alias("part")).agg(
            F.sum("bytes").alias("bytes")
        )
    return placed.select("item", F.col("part").alias("shard"))


def with_slots(rows: DataFrame, n: int, shards: int) -> DataFrame:
    """Adds ``slot``, 0, 1, ... within each shard, without sorting a shard in one task."""
    ranges = max(1, math.ceil(n / shards / ROWS_PER_SLOT_RANGE))
    rows = rows.withColumn("range", F.pmod(F.xxhash64("doc_id"), F.lit(ranges)))
    counts = rows.groupBy("shard", "range").agg(F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "shard", "range", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset")
    )
    within = Window.partitionBy("shard", "range").orderBy("doc_id", "item")
    return (
        rows.withColumn("place", F.row_number().over(within))
        .join(offsets, ["shard", "range"])
        .withColumn("slot", F.col("offset") + F.col("place") - 1)
        .drop("range", "offset", "place")
    )


def balanced_shards(rows: DataFrame, shards: int = SHARDS, block: int = BLOCK) -> DataFrame:
    """``rows`` (``doc_id, size, grp`` and others) with ``shard, slot``."""
    seen = Observation()
    total = F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")
    own = written(
        rows.withColumn("size", F.coalesce("size", F.lit(0)).cast("bigint")).observe(
            seen, F.count(F.lit(1)).alias("rows"), total
        ),
        "shard-sizes",
    )
    n, limit = seen.get["rows"], max(1.0, seen.get["bytes"] / shards)
    grp = F.coalesce(F.col("grp").cast("string"), F.lit("null"))
    own = own.withColumn("item", grp)
    # a group beyond the limit is cut; there are fewer than ``shards`` such groups
    large = own.groupBy("item").agg(F.sum("size").alias("b")).where(F.col("b") > limit)
    pieces = large.select("item", F.ceil(F.col("b") / limit).alias("pieces"))
    own = own.join(pieces, "item", "left").withColumn(
        "item",
        F.when(F.col("pieces").isNull(), F.col("item")).otherwise(
            F.concat_ws("/", "item", F.pmod(F.xxhash64("doc_id"), F.col("pieces")))
        ),
    )
    counted = Observation()
    items = written(
        own.groupBy("item")
        .agg(F.sum("size").alias("bytes"))
        .observe(counted, F.count(F.lit(1)).alias("items")),
        "shard-groups",
    )
    placed = place_groups(items, shards, counted.get["items"], block)
    out = with_slots(own.join(placed, "item"), n, shards)
    return out.select(*rows.columns, "shard", "slot")


def op4_sharding(spark, sf_dir):
    """All ``documents`` in 16 shards of nearly equal bytes, equal texts together unless their bytes
    exceed a fair shard."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.md5(text).alias("grp"),
    )
    return balanced_shards(rows).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
