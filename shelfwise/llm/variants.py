"""Spelling variants: words one edit apart, found by pivotal grams.

The bigrams of a word are put in one order for all words, rarest first. Its prefix is the first
``GRAMS`` of them with their positions (and what ties with the last). One edit destroys at most
two neighbouring bigrams, so of two disjoint bigrams of a word at least one is also in a word one
edit away, at most one place further. Dynamic programming chooses these two pivots out of the
prefix so that the words sharing them are fewest. Of two near words, the one whose prefix ends
earlier in the order has a pivot in the other's prefix: pivots meet the prefixes of words whose
prefix ends no earlier, at the positions and lengths that one edit allows. The words that meet are
compared exactly.

A replaced letter leaves positions as they are, an inserted or deleted one moves them by one if it
stands before; so bigram, position and length are the key of the join, and a frequent bigram is
spread over as many keys. Large keys are split by the join at run time.

A word's form is its near word of largest count, if that is ``RATIO`` times its own. Counts grow
with each step, so forms have no rings, and pointer doubling finds the last one in a few rounds.

Texts are whole and null texts have no words. A null id is written as empty text. Repeated rows
count as often as they occur. Other columns are ignored. Ties go to the word first in code-point
order. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from shelfwise.llm.common import table, written

EDITS, GRAM = 1, 2
GRAMS = GRAM * EDITS + 1  # so many bigrams hold two that are disjoint
MIN_CHARS, MIN_COUNT, RATIO = 6, 5, 5
DELETE_EVERY = 199
# The letters of a run, and the letters that are lower-cased
RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SIGNED = "word string, n long, len int, last int, gram int, pos int, pivot boolean"


# -- words ----------------------------------------------------------------------------


def runs(text: Column) -> Column:
    """All maximal runs of letters, A-Z lower-cased."""
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(RUN), F.lit(0))


def word_counts(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """``word, n``: the runs of ``docs`` (``doc_id, text``), some of them with a letter deleted as
    their hash with the id says."""
    own = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    long = F.filter(runs(F.col("text")), lambda w: F.length(w) >= min_chars)
    # outer: a plain explode would test the array first and so build it twice
    rows = docs.select(own.alias("own"), F.explode_outer(long).alias("run")).where("run is not null")
    h = F.crc32(F.concat("own", F.lit(":"), "run").cast("binary"))
    rows = rows.select("run", h.alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.col("h") % DELETE_EVERY == 0, shorter).otherwise(F.col("run"))
    words = rows.select(word.alias("word")).where(F.length("word") >= min_chars)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


# -- pivotal grams --------------------------------------------------------------------


def gram_order(words: DataFrame) -> dict[str, tuple[int, int]]:
    """Rank and count of each bigram, rarest first: at most the square of the alphabet's size."""
    places = F.sequence(F.lit(1), F.length("word") - (GRAM - 1))
    grams = words.select(F.explode_outer(F.transform(places, lambda i: F.substring("word", i, F.lit(GRAM)))).alias("gram"))
    rows = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).collect()
    ordered = sorted((r["n"], r["gram"]) for r in rows)
    return {gram: (rank, n) for rank, (n, gram) in enumerate(ordered)}


def prefix_of(word: str, order: dict[str, tuple[int, int]]) -> list[tuple[int, int]]:
    """``(rank, position)`` of the word's first ``GRAMS`` bigrams and of all that tie with the last."""
    placed = sorted((order[word[i : i + GRAM]][0], i) for i in range(len(word) - GRAM + 1))
    end = placed[min(GRAMS, len(placed)) - 1][0]
    return [p for p in placed if p[0] <= end]


def pivots_of(prefix: list[tuple[int, int]], cost: np.ndarray, n: int = EDITS + 1) -> set[tuple[int, int]]:
    """The ``n`` disjoint bigrams of ``prefix`` with the least cost in all.

    ``best[k]`` is the cheapest choice of k bigrams among those that end before the present one.
    """
    by_place = sorted(prefix, key=lambda p: p[1])
    best: list[list[tuple[int, tuple]]] = [[(0, ())] + [(-1, ())] * n]
    for i, (rank, pos) in enumerate(by_place):
        before = i
        while before and by_place[before - 1][1] > pos - GRAM:
            before -= 1
        row = list(best[-1])
        for k in range(1, n + 1):
            spent, chosen = best[before][k - 1]
            if spent >= 0 and (row[k][0] < 0 or spent + int(cost[rank]) < row[k][0]):
                row[k] = (spent + int(cost[rank]), (*chosen, (rank, pos)))
        best.append(row)
    return set(best[-1][n][1])


def signatures(words: DataFrame, order: dict[str, tuple[int, int]]) -> DataFrame:
    """A row for each prefix bigram of each word; ``last`` is the rank the prefix ends with."""
    cost = np.zeros(len(order), dtype=np.int64)
    for rank, n in order.values():
        cost[rank] = n
    shared = words.sparkSession.sparkContext.broadcast((order, cost))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ranks, costs = shared.value
        for batch in batches:
            rows = []
            for word, n in zip(batch["word"], batch["n"].tolist(), strict=True):
                prefix = prefix_of(word, ranks)
                pivots = pivots_of(prefix, costs)
                rows += [(word, n, len(word), prefix[-1][0], *p, p in pivots) for p in prefix]
            yield pd.DataFrame(rows, columns=["word", "n", "len", "last", "gram", "pos", "pivot"])

    return words.select("word", "n").mapInPandas(run, _SIGNED)


def near_pairs(words: DataFrame) -> DataFrame:
    """``a, a_n, b, b_n``: pairs of ``words`` (``word, n``) one edit apart, each once."""
    signed = written(signatures(words, gram_order(words)), "variants-grams")
    # where a kept bigram can stand in a word as long, one letter longer or one shorter
    moves = [(0, 0), (1, 0), (1, 1), (-1, 0), (-1, -1)]
    reach = F.array(*[F.struct(F.lit(d).alias("longer"), F.lit(m).alias("moved")) for d, m in moves])
    pivots = signed.where("pivot").select(
        F.col("word").alias("x"),
        F.col("n").alias("x_n"),
        F.col("last").alias("x_last"),
        "gram",
        "pos",
        "len",
        F.inline(reach),
    )
    pivots = pivots.select(
        "x", "x_n", "x_last", "gram", (F.col("pos") + F.col("moved")).alias("pos"), (F.col("len") + F.col("longer")).alias("len")
    )
    prefixes = signed.select(
        F.col("word").alias("y"), F.col("n").alias("y_n"), F.col("last").alias("y_last"), "gram", "pos", "len"
    )
    met = pivots.join(prefixes, ["gram", "pos", "len"]).where("x_last <= y_last and x <> y")
    near = met.where(F.levenshtein("x", "y", EDITS) == EDITS)
    x, y = F.struct(F.col("x").alias("word"), F.col("x_n").alias("n")), F.struct(F.col("y").alias("word"), F.col("y_n").alias("n"))
    ordered = near.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()
    return ordered.select(
        F.col("a.word").alias("a"), F.col("a.n").alias("a_n"), F.col("b.word").alias("b"), F.col("b.n").alias("b_n")
    )


# -- forms ----------------------------------------------------------------------------


def roots_of(forms: DataFrame) -> DataFrame:
    """``word, root``: from each word of ``forms`` (``word, form``) along the forms to the last."""
    ways = written(forms.select("word", F.col("form").alias("root")), "variants-ways")
    while True:
        further = ways.select(F.col("word").alias("root"), F.col("root").alias("next"))
        seen = Observation()
        ways = written(
            ways.join(further, "root", "left")
            .select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().cast("long").alias("moved"))
            .observe(seen, F.coalesce(F.sum("moved"), F.lit(0)).alias("moved"))
            .select("word", "root"),
            "variants-ways",
        )
        if not seen.get["moved"]:
            return ways


def variants(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of ``docs`` (``doc_id, text``)."""
    if min_chars <= GRAMS:
        raise ValueError(f"words of {GRAMS} letters or fewer have no two disjoint bigrams")
    words = written(word_counts(docs, min_chars, min_count), "variants-words")
    pairs = written(near_pairs(words), "variants-pairs")
    both = pairs.select(F.col("a").alias("word"), "a_n", F.col("b").alias("near"), F.col("b_n").alias("near_n")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("b_n").alias("a_n"), F.col("a").alias("near"), F.col("a_n").alias("near_n"))
    )
    first = F.min(F.struct((-F.col("near_n")).alias("minus"), "near"))
    found = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.first("a_n").alias("own_n"), first.alias("first"))
    large = -F.col("first.minus") >= RATIO * F.col("own_n")
    found = found.select(
        "word",
        "n_near",
        F.when(large, F.col("first.near")).alias("form"),
        F.when(large, -F.col("first.minus")).alias("form_n"),
    )
    found = written(found, "variants-forms")
    roots = roots_of(found.where("form is not null").select("word", "form"))
    out = words.join(found, "word", "left").join(roots, "word", "left")
    return out.select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form_n"
    )


def op11_variants(spark, sf_dir):
    """Spelling variants among all words of ``documents``."""
    return variants(table(spark, sf_dir, "documents"))
