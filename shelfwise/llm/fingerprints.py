"""Threshold-scaled document fingerprints.

A fingerprint keeps every shingle hash below a fixed fraction of the hash range, one in ``ONE_IN``,
whatever the length of the text. So its size follows the text, fingerprints of parts merge into
that of the whole, and a short text can be looked for in a long one. Beside the hashes stands a
digest of the whole set of shingles. It decides only where neither of two texts has a hash below
the threshold: then they are like (1) if their sets are equal, else unlike (0).

An estimate of likeness J over a union of u shingles has a standard deviation of about
sqrt(J (1 - J) ONE_IN / u): at J = 1/2 some 0.1 for 100 shingles, 0.05 for 400, 0.03 for 1,600.
A text of n shingles has no hash at all once in (4/3)^n times.

DataFrame operations only. Shingles are ``SHINGLE`` words; a shorter text is one shingle of all
its words; null and blank texts have an empty fingerprint, like another such text (1) and unlike
any other (0). Very long texts are taken whole. Other columns of the documents are not read. Repeated
rows have equal results. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import let, table, words, written
from shelfwise.operators.ordered import number_rows

SHINGLE = 5
ONE_IN = 4
ROWS_PER_RANGE = 200_000
_LEAST_HASH = -(1 << 63)
_BOUND = _LEAST_HASH + (1 << 64) // ONE_IN - 1


def sketch(text: Column) -> Column:
    """Struct of ``whole``, a digest of all distinct hashes, and ``hashes``, those up to the
    threshold, ascending. ``whole`` is null for a text without words."""

    def hashed(w: Column) -> Column:
        by_place = F.transform(
            F.sequence(F.lit(0), F.size(w) - SHINGLE),
            lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(SHINGLE)]),
        )
        return (
            F.when(F.size(w) >= SHINGLE, by_place)
            .when(F.size(w) > 0, F.array(F.xxhash64(w)))
            .otherwise(F.array().cast("array<bigint>"))
        )

    def kept(hashes: Column) -> Column:
        whole = F.when(F.size(hashes) > 0, F.xxhash64(hashes))
        return F.struct(whole.alias("whole"), F.filter(hashes, lambda h: h <= _BOUND).alias("hashes"))

    return let(let(words(text), lambda w: F.sort_array(F.array_distinct(hashed(w)))), kept)


def merged(a: Column, b: Column) -> Column:
    """The fingerprint of two texts together, from theirs (shingles across the seam left out)."""
    x, y = a["whole"], b["whole"]
    both = F.when(x.eqNullSafe(y) | y.isNull(), x).when(x.isNull(), y)
    both = both.otherwise(F.xxhash64(F.least(x, y), F.greatest(x, y)))
    hashes = F.sort_array(F.array_union(a["hashes"], b["hashes"]))
    return F.struct(both.alias("whole"), hashes.alias("hashes"))


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of common shingles among all of both."""

    def ratio(both: Column) -> Column:
        return both / (F.size(a["hashes"]) + F.size(b["hashes"]) - both)

    same = a["whole"].eqNullSafe(b["whole"])
    some = F.size(a["hashes"]) + F.size(b["hashes"]) > 0
    common = F.size(F.array_intersect(a["hashes"], b["hashes"]))
    return F.when(same, 1.0).when(some, let(common, ratio)).otherwise(0.0).cast("double")


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the first text's shingles that the second holds; 1 for a text without
    words, 0 for a text of other shingles without a hash below the threshold."""
    sure = a["whole"].isNull() | a["whole"].eqNullSafe(b["whole"])
    common = F.size(F.array_intersect(a["hashes"], b["hashes"]))
    return F.when(sure, 1.0).when(F.size(a["hashes"]) > 0, common / F.size(a["hashes"])).otherwise(0.0).cast("double")


def as_text(s: Column) -> Column:
    """The digest and the hashes in hexadecimal, the digest first; empty for a text without words."""
    digits = lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")
    return F.when(s["whole"].isNull(), F.lit("")).otherwise(
        F.concat_ws(":", digits(s["whole"]), F.array_join(F.transform(s["hashes"], digits), ""))
    )


def _row_key() -> Column:
    """One key for rows of equal id and text; null and empty text are alike here."""
    shown = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    return F.md5(F.concat_ws("/", shown, F.sha2(F.col("text").cast("binary"), 256)).cast("binary"))


def neighbours(docs: DataFrame) -> DataFrame:
    """``key, before_key, before_half``: each different row of ``docs`` (``key, doc_id, n_chars``)
    and the one before it in descending order of id, in a ring; nulls last."""
    rows = docs.groupBy("key").agg(F.max("doc_id").alias("doc_id"), F.max("n_chars").alias("n_chars"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("key")]
    ranked = written(number_rows(rows, order, "rank", "total", ROWS_PER_RANGE), "fingerprint-order")
    before = ranked.select(
        F.col("key").alias("before_key"),
        F.floor(F.col("n_chars") / 2).cast("int").alias("before_half"),
        (F.col("rank") % F.col("total") + 1).alias("rank"),
    )
    return ranked.join(before, "rank").select("key", "before_key", "before_half")


def compared(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (``doc_id, text``): fingerprints of the text and of the edited text.

    Every text goes through one shuffle by row key, used twice, and the part that its predecessor
    takes over through a second one. The first shuffle carries no fingerprints: they are as cheap
    to compute on both sides of it as to move.
    """
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    own = own.select(_row_key().alias("key"), "doc_id", "text")
    ring = neighbours(own.select("key", "doc_id", F.length("text").alias("n_chars")))
    given = (
        own.join(ring.withColumnRenamed("key", "r_key"), F.col("key") == F.col("r_key"))
        .withColumn("own", sketch(F.col("text")))
        .groupBy(F.col("before_key").alias("to_key"))
        .agg(
            F.first(
                F.struct(
                    F.col("doc_id").alias("id"), F.expr("left(text, before_half)").alias("part"), F.col("own")
                )
            ).alias("next")
        )
    )
    n = F.length("text")
    edited = F.concat(F.left(F.col("text"), (n - F.floor(n / 2)).cast("int")), F.col("next.part"))
    both = own.join(given, F.col("key") == F.col("to_key")).select(
        "doc_id", "text", "next", edited.alias("edited")
    )
    both = both.withColumn("own", sketch(F.col("text"))).withColumn("other", sketch(F.col("edited")))
    return both.select(
        "doc_id",
        n.cast("bigint").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("other")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other")).alias("near_edited"),
        likeness(F.col("own"), F.col("next.own")).alias("near_next"),
        F.col("next.id").alias("next_id"),
    )


def op5_fingerprints(spark, sf_dir):
    """Fingerprints of every whole text of ``documents``, of its edited text and of the next."""
    return compared(table(spark, sf_dir, "documents"))
