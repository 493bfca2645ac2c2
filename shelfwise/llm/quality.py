"""Quality rules: counts per text, and lines that too many documents of a host share.

Lines are normalised (blanks at the ends off, lower case, digits alike) and hashed. A line that
more than ``LINE_LIMIT`` different texts of one host hold is removed from all of them; a document
that keeps less than ``MIN_LEFT`` of its words is rejected. Exact copies count as one text, so a
clean text that was copied often is not mistaken for boilerplate.

DataFrame operations only. Null text has no words and fails the base rules, as does blank text;
a null host is a host of its own. Repeated rows get the same verdict. An empty table gives no
rows. Words inside a document are handled as arrays in its own row; only line hashes are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import BLANKS, let, table, words, written

MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
LINE_LIMIT = 20
MIN_LEFT = 0.3
WINDOW = 3
# Fixed value: the characters counted as symbols.
SYMBOLS = "#*$%&|<>"


def repeated_words(w: Column, window: int = WINDOW) -> Column:
    """Words of array ``w`` that lie in a window of words found twice or more in it."""

    def covered(windows: Column) -> Column:
        last = F.size(windows) - 1
        again = F.filter(
            windows,
            lambda x, i: ((i > 0) & (F.get(windows, i - 1)["h"] == x["h"]))
            | ((i < last) & (F.get(windows, i + 1)["h"] == x["h"])),
        )
        places = F.sort_array(F.transform(again, lambda x: x["p"]))
        # each window adds what the one before it has not covered
        return F.aggregate(
            places,
            F.struct(F.lit(-window).alias("at"), F.lit(0).alias("n")),
            lambda acc, p: F.struct(
                p.alias("at"), (acc["n"] + F.least(F.lit(window), p - acc["at"])).alias("n")
            ),
            lambda acc: acc["n"],
        )

    def hashed(i: Column) -> Column:
        return F.struct(
            F.xxhash64(*[F.get(w, i + k) for k in range(window)]).alias("h"), i.alias("p")
        )

    windows = F.transform(F.sequence(F.lit(0), F.size(w) - window), hashed)
    found = F.when(F.size(w) >= window, let(F.array_sort(windows), covered)).otherwise(F.lit(0))
    return found.cast("bigint")


def _has_word(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS)) != ""


def _lines(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), _has_word)


def _removed_words(docs: DataFrame, limit: int) -> DataFrame:
    """``host, text_hash, removed``: words in lines above the limit, per host and different text."""
    normal = F.translate(F.lower(F.btrim(F.col("line"), F.lit(BLANKS))), "123456789", "000000000")
    lines = (
        # outer: a plain explode would test the array first and so build it twice
        docs.select("host", "text_hash", F.posexplode_outer(_lines(F.col("text"))).alias("pos", "line"))
        .where("line is not null")
        .select(
            "host",
            "text_hash",
            "pos",
            F.xxhash64(normal).alias("line_hash"),
            F.size(words(F.col("line"))).alias("n"),
        )
        .distinct()  # copies of a text fall together
    )
    lines = written(lines, "quality-lines")
    frequent = (
        lines.select("host", "line_hash", "text_hash")
        .distinct()
        .groupBy("host", "line_hash")
        .agg(F.count(F.lit(1)).alias("texts"))
        .where(F.col("texts") > limit)
        .select(F.col("host").alias("f_host"), F.col("line_hash").alias("f_hash"))
    )
    met = F.col("host").eqNullSafe(F.col("f_host")) & (F.col("line_hash") == F.col("f_hash"))
    return lines.join(frequent, met).groupBy("host", "text_hash").agg(F.sum("n").alias("removed"))


def judge(docs: DataFrame, host: str = "source", limit: int = LINE_LIMIT) -> DataFrame:
    """Counts and verdict for each row of ``docs`` (``doc_id, text`` and the host column)."""
    own = docs.select(
        "doc_id",
        F.col(host).alias("host"),
        "text",
        F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))).alias("text_hash"),
    )
    text = F.coalesce("text", F.lit(""))
    worded = _lines(F.col("text"))
    counts = own.select("doc_id", "host", "text_hash", "text", words(F.col("text")).alias("w")).select(
        "doc_id",
        "host",
        "text_hash",
        F.size("w").cast("bigint").alias("n_words"),
        F.length(F.array_join("w", "")).cast("bigint").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        let(worded, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
        repeated_words(F.col("w")).alias("n_repeat_words"),
    )
    counts = written(counts, "quality-counts")
    removed = _removed_words(own, limit).select(
        F.col("host").alias("r_host"), F.col("text_hash").alias("r_hash"), "removed"
    )
    met = F.col("host").eqNullSafe(F.col("r_host")) & (F.col("text_hash") == F.col("r_hash"))
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words")
    )
    left = F.col("n_words") - F.coalesce("removed", F.lit(0))
    return counts.join(removed, met, "left").select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (left >= F.col("n_words") * MIN_LEFT)).alias("kept"),
    )


def op3_quality(spark, sf_dir):
    """Counts and verdict for every whole text of ``documents``, by source."""
    return judge(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, row_number() OVER () AS row FROM documents),
w AS (SELECT row, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
p AS (SELECT row, w, unnest(range(1, len(w) - 1)) AS i FROM w),
g AS (SELECT row, i, count(*) OVER (PARTITION BY row, w[i], w[i + 1], w[i + 2]) AS n FROM p),
r AS (SELECT row, count(DISTINCT j) AS n_repeat_words
      FROM (SELECT row, unnest([i, i + 1, i + 2]) AS j FROM g WHERE n > 1) GROUP BY row),
l AS (SELECT row, source, text, line, sum(1) OVER (PARTITION BY row, line) AS same,
             lower(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS low,
             len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n
      FROM (SELECT row, source, text, unnest(string_split(text, chr(10))) AS line FROM d)
      WHERE trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> ''),
u AS (SELECT row, count(*) - count(DISTINCT line) AS n_dup_lines FROM l GROUP BY row),
f AS (SELECT source, translate(low, '123456789', '000000000') AS norm FROM l
      GROUP BY 1, 2 HAVING count(DISTINCT text) > 20),
x AS (SELECT l.row, sum(l.n) AS removed FROM l JOIN f ON l.source IS NOT DISTINCT FROM f.source
        AND translate(l.low, '123456789', '000000000') = f.norm GROUP BY l.row),
c AS (SELECT d.doc_id, len(w.w)::BIGINT AS n_words, len(array_to_string(w.w, ''))::BIGINT AS word_chars,
             len(regexp_extract_all(d.text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
             coalesce(u.n_dup_lines, 0)::BIGINT AS n_dup_lines,
             coalesce(r.n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(x.removed, 0) AS removed
      FROM d JOIN w USING (row) LEFT JOIN u USING (row) LEFT JOIN r USING (row) LEFT JOIN x USING (row)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND n_words - removed >= 0.3::DOUBLE * n_words AS kept
FROM b
"""
