"""What several operators need: reading the tables, words, and written intermediate tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.session import cut_lineage

# The six ASCII blanks that end a word, everything else belongs to one.
BLANKS = " \t\n\x0b\f\r"
WORD_GAP = "[\\x20\\x09-\\x0D]+"
BATCH_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # Python workers get batches bounded in bytes, not only in rows
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The maximal runs of non-blank characters; none for null or blank text."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, WORD_GAP))


def whole(docs: DataFrame) -> Column:
    """All columns of ``docs`` as one, so that columns added beside it meet no others of their name."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns])


def unfolded(rows: DataFrame, docs: DataFrame, doc: str = "doc", **changed: Column) -> DataFrame:
    """The columns of ``docs`` out of ``doc``, with other values for those ``changed``."""
    own = [changed.get(c, F.col(doc).getField(c)).alias(c) for c in docs.columns]
    return rows.select(*own)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def written(df: DataFrame, label: str) -> DataFrame:
    """A copy in the shared folder; a retried task rereads it instead of computing it anew."""
    return cut_lineage(df, f"llm-{label}")


class Remembered:
    """Two generations of a dictionary: what is used stays, the rest goes, size is bounded."""

    def __init__(self, size: int):
        self.size, self.young, self.old = size // 2, {}, {}

    def missing(self, keys: Iterable[str]) -> list[str]:
        """The keys that are not known; the others are safe until the next call."""
        if len(self.young) > self.size:
            self.old, self.young = self.young, {}
        young, old, out = self.young, self.old, []
        for k in keys:
            if k not in young:
                if k in old:
                    young[k] = old[k]
                else:
                    out.append(k)
        return out
