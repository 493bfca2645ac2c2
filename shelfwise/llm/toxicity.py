"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a text: how dense words of a learned lexicon are, how near they stand to second-person
words, capitals, punctuation, and rates of obfuscated spelling. The lexicon holds words and word
beginnings (``stem*``) that labelled toxic texts have and others hardly have. Lexicon, trees and
calibration learn from three separate parts of a bounded sample: about ``TRAIN_ROWS`` labelled
rows of lowest id hash, the only bound here. Scoring reads every whole text.

Null and empty texts have all features 0 and are scored like any other. Labels that are null are
ignored; of several labels of an id the highest holds. Without rows of both classes in each part
the score is the share of toxic labels, 0 if there are none. Repeated rows are scored alike.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm.common import Remembered, id_remainder, table, written

TRAIN_ROWS = 12_000
LEXICON_WORDS = 1_000
MIN_TEXTS, MIN_SHARE = 4, 0.75
STEMS = (4, 5, 6)
NEAR = 5
TREES, DEPTH = 20, 3
THRESHOLD = 0.3
FOLDS, HELD_OUT = 4, 2
PARTS = ("lexicon", "lexicon", "trees", "trees", "calibration")
TOKENS_KEPT = 400_000

# Second-person words of the languages, and letters that digits and signs stand for.
SECOND_PERSON = frozenset(
    "you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine sie ihr "
    "euch tú ti usted ustedes vosotros tus su sus".split()
)
LOOKS_LIKE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})

FEATURES = [
    "lexicon_rate",
    "lexicon_hits",
    "near_second_person",
    "second_person_rate",
    "obfuscated_hits",
    "mixed_word_rate",
    "stretched_word_rate",
    "shouted_rate",
    "capitalised_rate",
    "exclamation_rate",
    "question_rate",
    "sign_run_rate",
    "words_log",
]
_HIT, _SECOND, _SHOUT, _CAPITAL, _MIXED, _STRETCHED, _DISGUISED = (1 << k for k in range(7))
_STRETCH, _SIGN_RUN, _EDGES = re.compile(r"(.)\1\1"), re.compile(r"[!?]{2,}"), re.compile(r"^[\W\d_]+|[\W\d_]+$")
_LEFT, _RIGHT = re.compile(r"^[\W\d_]+"), re.compile(r"[\W\d_]+$")


class TokenFlags:
    """What each distinct token is; known tokens are remembered up to a bound."""

    def __init__(self, lexicon: frozenset[str]):
        self.lexicon, self.known = lexicon, Remembered(TOKENS_KEPT)

    def _listed(self, word: str) -> bool:
        lexicon = self.lexicon
        return word in lexicon or any(word[:n] + "*" in lexicon for n in STEMS if len(word) > n)

    @staticmethod
    def _disguises(token: str) -> set[str]:
        """What a token can stand for: its edges may be letters in disguise or mere punctuation."""
        left, right = _LEFT.sub("", token), _RIGHT.sub("", token)
        plain = {t.translate(LOOKS_LIKE) for t in (token, left, right, _RIGHT.sub("", left))}
        return {w for t in plain for w in (t, "".join(filter(str.isalpha, t))) if w}

    def _flags(self, token: str) -> int:
        core = _EDGES.sub("", token)
        word = core.lower()
        flags = 0
        if word and self._listed(word):
            flags |= _HIT
        elif not token.isalpha() and any(map(self._listed, self._disguises(token.lower()))):
            flags |= _DISGUISED
        if word in SECOND_PERSON:
            flags |= _SECOND
        if len(core) > 1 and core.isupper():
            flags |= _SHOUT
        if core[:1].isupper():
            flags |= _CAPITAL
        if core and not core.isalpha() and any(map(str.isalpha, core)):
            flags |= _MIXED
        if _STRETCH.search(word):
            flags |= _STRETCHED
        return flags

    def features(self, text: str) -> list[float]:
        tokens = text.split()
        n = max(len(tokens), 1)
        for t in self.known.missing(set(tokens)):
            self.known.young[t] = self._flags(t)
        flags = np.fromiter(map(self.known.young.__getitem__, tokens), dtype=np.uint8, count=len(tokens))
        total = lambda flag: int(np.count_nonzero(flags & flag))
        hits, seconds = np.flatnonzero(flags & (_HIT | _DISGUISED)), np.flatnonzero(flags & _SECOND)
        near = 0
        if len(hits) and len(seconds):
            after = np.searchsorted(seconds, hits)
            gap = np.minimum(
                np.abs(seconds[np.minimum(after, len(seconds) - 1)] - hits),
                np.abs(hits - seconds[np.maximum(after - 1, 0)]),
            )
            near = np.count_nonzero(gap <= NEAR) / len(hits)
        return [
            len(hits) / n,
            float(len(hits)),
            float(near),
            len(seconds) / n,
            float(total(_DISGUISED)),
            total(_MIXED) / n,
            total(_STRETCHED) / n,
            total(_SHOUT) / n,
            total(_CAPITAL) / n,
            text.count("!") / n,
            text.count("?") / n,
            len(_SIGN_RUN.findall(text)) / n,
            float(np.log1p(len(tokens))),
        ]


def features_of(spark: SparkSession, lexicon: frozenset[str]):
    """A column function: text to its ``FEATURES``."""
    shared = spark.sparkContext.broadcast(lexicon)

    @F.pandas_udf("array<double>")
    def features(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = TokenFlags(shared.value)
        for texts in batches:
            yield pd.Series([own.features(t or "") for t in texts], dtype=object)

    return features


def training_sample(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """``text, label, part`` of about ``rows`` labelled documents, written once."""
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("double").alias("label"))
        .where(id_remainder(F.col("doc_id"), FOLDS) != HELD_OUT)
        .withColumn("key", F.xxhash64("doc_id"))
    )
    share = min(1.0, rows / max(known.count(), 1))
    chosen = known.where(F.col("key") / F.lit(2.0**64) + 0.5 <= share)
    part = F.element_at(F.array(*map(F.lit, PARTS)), F.pmod("key", F.lit(len(PARTS))).cast("int") + 1)
    # about ``rows`` rows of 24 bytes, whatever the table's size
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    # a document may stand in the table several times: learn from it once
    sample = sample.groupBy("doc_id", "label", "key").agg(F.max("text").alias("text"))
    return written(sample.select("text", "label", part.alias("part")), "toxicity-sample")


def learn_lexicon(rows: DataFrame, limit: int = LEXICON_WORDS) -> frozenset[str]:
    """Words and word beginnings typical of toxic texts, the most frequent ``limit`` of them."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)")))
    word = F.col("word")
    keys = [word] + [F.when(F.length(word) > n, F.concat(F.left(word, F.lit(n)), F.lit("*"))) for n in STEMS]
    seen = (
        rows.select("label", F.monotonically_increasing_id().alias("row"), F.explode(words).alias("word"))
        .select("label", "row", F.explode(F.array(*keys)).alias("key"))
        .where("key is not null")
        .distinct()
        .groupBy("key")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("toxic"))
        .where((F.col("n") >= MIN_TEXTS) & (F.col("toxic") >= F.col("n") * MIN_SHARE))
    )
    return frozenset(r["key"] for r in seen.orderBy(F.desc("toxic"), "key").limit(limit).collect())


def scored(docs: DataFrame, labels: DataFrame, text: Column, rows: int = TRAIN_ROWS) -> DataFrame:
    """``docs`` with ``score``, learned from ``labels`` (``doc_id, toxic``) of these documents.

    A column ``score`` that they have gives way to it.
    """
    spark = docs.sparkSession
    docs = docs.drop("score")
    sample = training_sample(docs, labels, rows)
    present = {(r["part"], r["label"]): r["count"] for r in sample.groupBy("part", "label").count().collect()}
    if not all(present.get((p, x)) for p in PARTS for x in (0.0, 1.0)):
        toxic = sum(n for (_, x), n in present.items() if x == 1.0)
        return docs.withColumn("score", F.lit(toxic / max(sum(present.values()), 1)))
    lexicon = learn_lexicon(sample.where(F.col("part") == "lexicon"))
    features = features_of(spark, lexicon)
    known = sample.where(F.col("part") != "lexicon").select("part", "label", features(F.col("text")).alias("f"))
    known = written(known, "toxicity-features").withColumn("features", array_to_vector("f")).coalesce(4)
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=7).fit(
        known.where(F.col("part") == "trees")
    )
    margin = vector_to_array("rawPrediction")[1]
    held = trees.transform(known.where(F.col("part") == "calibration")).select(
        "label", margin.alias("margin")
    )
    calibration = IsotonicRegression(featuresCol="margin", predictionCol="calibrated").fit(held)

    out = docs.withColumn("_row", F.struct(*docs.columns)).select(
        "_row", array_to_vector(features(text)).alias("features")
    )
    out = trees.transform(out).select("_row", margin.alias("margin"))
    out = calibration.transform(out)
    score = F.least(F.greatest(F.col("calibrated"), F.lit(0.0)), F.lit(1.0))
    return out.select("_row.*", score.alias("score"))


def op10_toxicity(spark, sf_dir):
    """Toxicity of every whole text of ``documents``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scored(docs, table(spark, sf_dir, "labels"), F.col("text"))
    return out.select(
        "doc_id",
        (id_remainder(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
