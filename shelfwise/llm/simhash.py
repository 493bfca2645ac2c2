"""SimHash near-duplicates with tables of distances to pivots.

The fingerprint takes the majority, bit by bit, of the XXH64 hashes of all word shingles. Two
fingerprints link if at most ``RADIUS`` bits differ. By the triangle inequality the distances of a
linked pair to any reference fingerprint differ by no more than that, so a table of distances to
many pivots discards pairs by their largest coordinate difference; survivors are verified.

Distances to pivots alone cannot spread rows over tasks, as they are much alike for all
fingerprints. Rows are therefore dealt by pairs of bit blocks: ``RADIUS`` bits touch at most four
of six blocks, so linked fingerprints agree on at least two and meet in one of 15 deals. A deal
value with more than ``CELL`` distinct fingerprints is cut into chunks, and every two chunks meet
in a cell of their own. A cell returns links that span its groups, not all pairs, so close copies
cost one link each.

Null and blank texts have fingerprint 0 and are linked like any other. Repeated rows share
fingerprint and component. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from shelfwise.llm.common import table, unfolded, whole, written
from shelfwise.llm.components import components

SHINGLE, SEED, RADIUS = 4, 42, 4
CELL = 2048
SMALL_CELL = 24
HASHES_AT_ONCE = 50_000
_EDGES = [0, 11, 22, 33, 44, 54, 64]
_BLOCKS = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(_EDGES, _EDGES[1:], strict=False)]
DEALS = [a | b for a, b in combinations(_BLOCKS, 2)]
# Walsh functions: 32 references, any two of them 32 bits apart
PIVOTS = np.array(
    [sum((bin(i & j).count("1") & 1) << i for i in range(64)) for j in range(1, 64, 2)], dtype=np.uint64
)


def fingerprint(text: str | None) -> int:
    """64-bit SimHash of the whole text."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and the six ASCII blanks only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.array([len(w) + 1 for w in words])) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(SHINGLE, len(words))
    n = len(words) - width + 1
    first, last, digest = starts[:n].tolist(), ends[width - 1 :].tolist(), xxhash.xxh64_intdigest
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, HASHES_AT_ONCE):
        to = at + HASHES_AT_ONCE
        hashes = [digest(joined[a:b], SEED) for a, b in zip(first[at:to], last[at:to], strict=True)]
        bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8), bitorder="little")
        ones += bits.reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<i8")[0])


@F.pandas_udf(LongType())
def fingerprints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([fingerprint(t) for t in texts], dtype="int64")


class PivotTable:
    """Distances of some fingerprints to all pivots."""

    def __init__(self, marks: np.ndarray):
        self.marks = marks
        self.distances = np.bitwise_count(marks[None, :] ^ PIVOTS[:, None]).astype(np.int8)

    def linked(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of positions ``(a[i], b[i])`` whose fingerprints link."""
        for to_pivot in self.distances:
            near = np.abs(to_pivot[a] - to_pivot[b]) <= RADIUS
            a, b = a[near], b[near]
            if not len(a):
                return a, b
        near = np.bitwise_count(self.marks[a] ^ self.marks[b]) <= RADIUS
        return a[near], b[near]


def spanning_links(marks: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect whatever is connected among ``marks``: one fewer than each group has."""
    pivots = PivotTable(marks)
    left, queue, out = np.arange(len(marks)), [], []
    while len(left):
        if not queue:
            queue, left = [left[0]], left[1:]
        node = queue.pop()
        _, found = pivots.linked(np.full(len(left), node), left)
        if len(found):
            left = np.setdiff1d(left, found, assume_unique=True)
            queue += found.tolist()
            out += [(node, f) for f in found.tolist()]
    return out


def _links_of_cells(cell: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within cells, which are runs of equal numbers in ``cell``."""
    begins = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    sizes = np.diff(np.append(begins, len(cell)))
    a, b = [], []
    small = np.repeat((sizes > 1) & (sizes <= SMALL_CELL), sizes)
    marks_s, cell_s = marks[small], cell[small]
    pivots = PivotTable(marks_s)
    for step in range(1, SMALL_CELL):
        at = np.flatnonzero(cell_s[step:] == cell_s[:-step])
        if not len(at):
            break
        x, y = pivots.linked(at, at + step)
        a.append(marks_s[x])
        b.append(marks_s[y])
    for begin, size in zip(begins.tolist(), sizes.tolist(), strict=True):
        if size > SMALL_CELL:
            own = marks[begin : begin + size]
            links = np.array(spanning_links(own), dtype=np.int64).reshape(-1, 2)
            a.append(own[links[:, 0]])
            b.append(own[links[:, 1]])
    none = np.zeros(0, dtype=np.uint64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def _cell_links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by cell; a cell that the batch cuts off waits for the next batch."""
    keys = ["deal", "value", "one", "two"]
    waiting: pd.DataFrame | None = None

    def links(rows: pd.DataFrame) -> pd.DataFrame:
        same = (rows[keys].to_numpy()[1:] == rows[keys].to_numpy()[:-1]).all(axis=1)
        cell = np.concatenate([[0], np.cumsum(~same)])
        a, b = _links_of_cells(cell, rows["mark"].to_numpy().view(np.uint64))
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    for batch in batches:
        if not len(batch):
            continue
        rows = batch if waiting is None else pd.concat([waiting, batch], ignore_index=True)
        open_cell = (rows[keys] == rows[keys].iloc[-1]).all(axis=1)
        waiting = rows[open_cell]
        if not open_cell.all():
            yield links(rows[~open_cell])
    if waiting is not None:
        yield links(waiting)


def links_between(marks: DataFrame, cell: int = CELL) -> DataFrame:
    """Links ``a, b`` that connect all fingerprints that link; ``mark`` must be distinct."""
    deals = F.array(
        *[
            F.struct(F.lit(k).alias("deal"), F.col("mark").bitwiseAND(F.lit(_signed(m))).alias("value"))
            for k, m in enumerate(DEALS)
        ]
    )
    dealt = marks.select("mark", F.inline(deals))
    full = dealt.groupBy("deal", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cell)
    full = full.select("deal", "value", F.ceil(F.col("n") / cell).alias("chunks"))
    chunks = F.coalesce(F.col("chunks"), F.lit(1))
    dealt = (
        dealt.join(full, ["deal", "value"], "left")
        .withColumn("chunk", F.pmod(F.xxhash64("mark"), chunks))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), chunks - 1)))
        .select(
            "mark",
            "deal",
            "value",
            F.least("chunk", "other").alias("one"),
            F.greatest("chunk", "other").alias("two"),
        )
    )
    keys = ["deal", "value", "one", "two"]
    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(_cell_links, "a long, b long")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def with_components(rows: DataFrame) -> DataFrame:
    """``rows`` (``doc_id, mark`` and others) with ``root``, one value for each component, and
    ``component_id``, the smallest id in it."""
    marks = rows.groupBy("mark").agg(F.min("doc_id").alias("least_id"))
    marks = written(marks, "simhash-marks")
    found = components(links_between(marks.select("mark")))
    marks = marks.join(found, marks["mark"] == found["node"], "left").select(
        "mark", "least_id", F.coalesce("root", "mark").alias("root")
    )
    least = marks.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return rows.join(marks.join(least, "root").select("mark", "root", "component_id"), "mark")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The document of smallest id (null first) of each component, other columns kept."""
    hashed = F.xxhash64("text").alias("hash")
    marks = docs.select("doc_id", hashed, fingerprints(F.col("text")).alias("mark"))
    groups = with_components(written(marks, "simhash-docs"))
    first = groups.groupBy("root").agg(F.min(F.struct("doc_id", "hash")).alias("at"))
    first = first.select(F.col("at.doc_id").alias("f_id"), F.col("at.hash").alias("f_hash"))
    own = docs.select(whole(docs).alias("doc"), F.col("doc_id").alias("id"), hashed)
    met = F.col("id").eqNullSafe(F.col("f_id")) & (F.col("hash") == F.col("f_hash"))
    # repeated rows have one id and text: one of them stays
    return unfolded(own.join(first, met, "left_semi").dropDuplicates(["id", "hash"]), docs)


def hex_mark(mark: Column) -> Column:
    return F.lpad(F.lower(F.hex(mark)), 16, "0")


def op6_simhash(spark, sf_dir):
    """Fingerprint and near-duplicate component of every whole text of ``documents``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", fingerprints(F.col("text")).alias("mark"))
    docs = written(docs, "simhash-docs")
    return with_components(docs).select("doc_id", hex_mark(F.col("mark")).alias("fingerprint"), "component_id")
