"""Collocations by stripes: each prefix keys a counter of the words that follow it.

The stripe of a prefix of k words holds how often each next word follows, and how often none does
(the piece ends). Tasks build stripes from large batches of text, the shuffle brings the stripes of
a prefix together, and they are merged elementwise. One merged stripe gives the extensions of the
prefix (phrases of k + 1 words), its total (how often the prefix itself occurs) and the largest
extension (whether a longer phrase subsumes the prefix).

Stripes of single words come first. A longer phrase is frequent only if both phrases of one word
less are, so stripes of longer prefixes take in only such windows: a Bloom filter of fixed size
tells tasks which phrases are frequent. What it lets through by mistake is counted and then falls
under the limit, so the filter saves work and never changes a result.

A prefix that makes up more than a ``HOT_SHARE`` of all words has its stripe cut into ``PARTS`` by
the hash of the next word; parts merge on their own. There are fewer than 1 / ``HOT_SHARE`` such
prefixes, so their list is bounded. For single words it comes from a sample, which decides the
layout only; for longer prefixes their counts are known.

Texts are whole; a batch takes a whole piece at least, so memory is bounded unless a single piece
without any separator is very long. Null texts are empty, a null language is ``und``. Repeated rows
count as often as they occur. Other columns are ignored. Ties are ordered by the phrase's bytes.
An empty table gives no rows. Counts must stay under 10 ** 15.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.common import table, written

MIN_COUNT, MAX_WORDS, TOP = 10, 3, 2000
SUBSUMED_PCT, SCALE = 50, 1_000_000
UNKNOWN_LANG = "und"
BATCH_BYTES = 8 << 20
HOT_SHARE, PARTS, SAMPLE_SHARE = 1 / 2000, 64, 0.01
FILTER_BITS = 1 << 26
# What ends a piece, and the blanks between its words
SEPARATORS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
PIECE_END = b"\n"  # in no word, as it ends a piece
_TABLE = bytes(
    10 if c in SEPARATORS else 32 if c in BLANKS else c + 32 if 65 <= c <= 90 else c for c in range(256)
)
_STRIPE = "lang string, prefix binary, part int, nexts binary, counts binary"
_STRIPE_COLUMNS = ["lang", "prefix", "part", "nexts", "counts"]
_PHRASE = "lang string, prefix binary, next binary, a long, total long, whole boolean"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    """A frame of plain objects: no column becomes one of pandas' own string types."""
    return pd.DataFrame(rows, columns=columns, dtype=object)


# -- words ----------------------------------------------------------------------------


class Tokens:
    """Word codes of a batch in order, -1 between pieces; ``words`` in order of first use."""

    def __init__(self, texts: list[bytes]):
        data = b"\n".join(texts).translate(_TABLE).replace(b"\n", b" \n ")
        codes, words = pd.factorize(np.array([*data.split(b" "), PIECE_END, b""], dtype=object))
        # the two added at the end make sure that both have a code
        keep = codes != codes[-1]
        ends = codes == codes[-2]
        self.words = words
        self.codes = np.where(ends, -1, codes)[keep].astype(np.int64)

    def hashes(self) -> np.ndarray:
        return np.array([xxhash.xxh64_intdigest(w) for w in self.words.tolist()], dtype=np.uint64)


def phrase_hashes(words: list[np.ndarray]) -> np.ndarray:
    """A hash of each phrase from the hashes of its words."""
    out = np.zeros(len(words[0]), dtype=np.uint64)
    for w in words:
        out = (out ^ w) * _MIX
        out ^= out >> np.uint64(29)
    return out


def _batches(rows: Iterator[pd.DataFrame]) -> Iterator[tuple[str, list[bytes]]]:
    """Texts of one language, some ``BATCH_BYTES`` at a time."""
    waiting: dict[str, list[bytes]] = {}
    size: dict[str, int] = {}
    for batch in rows:
        for lang, text in zip(batch["lang"], batch["text"], strict=True):
            for part in _cut(text):
                waiting.setdefault(lang, []).append(part)
                size[lang] = size.get(lang, 0) + len(part) + 64
                if size[lang] >= BATCH_BYTES or sum(size.values()) >= 2 * BATCH_BYTES:
                    full = max(size, key=size.get)
                    del size[full]
                    yield full, waiting.pop(full)
    yield from waiting.items()


def _cut(text: bytes) -> Iterator[bytes]:
    """A very long text, cut at line ends or full stops."""
    at = 0
    while len(text) - at > BATCH_BYTES:
        ends = [e for s in (b"\n", b".") if (e := text.find(s, at + BATCH_BYTES // 2, at + BATCH_BYTES)) >= 0]
        cut = min(ends) if ends else next((i for i in range(at + BATCH_BYTES, len(text)) if text[i] in SEPARATORS), -1)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut + 1
    yield text[at:]


# -- stripes --------------------------------------------------------------------------


class Filter:
    """A Bloom filter with two places for each phrase."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def places(hashes: np.ndarray) -> np.ndarray:
        top = np.uint64(FILTER_BITS - 1)
        return np.concatenate([hashes & top, (hashes >> np.uint64(32)) & top])

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        at = self.places(hashes)
        found = (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1
        return found.reshape(2, -1).all(axis=0)


def _stripes_of(tokens: Tokens, k: int, known: Filter | None, lang: str) -> tuple[np.ndarray, ...]:
    """Distinct (prefix of ``k`` words, next) of a batch with counts, sorted by prefix: the place of
    one occurrence of the prefix, the next's code (-1: the piece ends), the count."""
    codes, n = np.append(tokens.codes, -1), len(tokens.words) + 1
    windows = [codes[i : len(codes) - k + i] for i in range(k + 1)]
    good = reduce(np.logical_and, [w >= 0 for w in windows[:k]])
    if k > 1:
        good &= windows[k] >= 0
    at = np.flatnonzero(good)
    if known is not None and len(at):
        seed = np.uint64(xxhash.xxh64_intdigest(lang.encode()))
        h = tokens.hashes() ^ seed
        for shift in (0, 1):  # the phrase without its last word, and without its first
            found = known.holds(phrase_hashes([h[windows[i + shift][at]] for i in range(k)]))
            at = at[found]
    # prefixes get numbers word by word, so that a pair of numbers fits 64 bits
    prefix = windows[0][at]
    for i in range(1, k):
        _, prefix = np.unique(prefix * n + windows[i][at], return_inverse=True)
    keys, first, counts = np.unique(prefix * n + windows[k][at] + 1, return_index=True, return_counts=True)
    return keys // n, at[first], keys % n - 1, counts


def _stripe_rows(tokens: Tokens, k: int, known: Filter | None, hot: frozenset, lang: str) -> pd.DataFrame:
    prefix, place, after, counts = _stripes_of(tokens, k, known, lang)
    if not len(prefix):
        return _frame([], _STRIPE_COLUMNS)
    begins = np.flatnonzero(np.append(True, prefix[1:] != prefix[:-1]))
    cuts = [*begins.tolist(), len(prefix)]
    names = np.append(tokens.words, PIECE_END)[after]
    heads = [tokens.words[tokens.codes[place[begins] + i]].tolist() for i in range(k)]
    heads = heads[0] if k == 1 else [b" ".join(h) for h in zip(*heads, strict=True)]
    counts = counts.astype("<i8")
    out = []
    for head, a, b in zip(heads, cuts, cuts[1:], strict=False):
        if (lang, head) in hot:
            part = np.array([xxhash.xxh32_intdigest(w) % PARTS for w in names[a:b].tolist()])
            for p in np.unique(part).tolist():
                own = np.flatnonzero(part == p) + a
                out.append((lang, head, p, b" ".join(names[own].tolist()), counts[own].tobytes()))
        else:
            out.append((lang, head, 0, b" ".join(names[a:b].tolist()), counts[a:b].tobytes()))
    return _frame(out, _STRIPE_COLUMNS)


def stripes(docs: DataFrame, k: int, hot: frozenset, known: Filter | None = None) -> DataFrame:
    """Partial stripes of ``docs`` (``lang, text``, as bytes) for prefixes of ``k`` words."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((hot, known.bits if known else None))

    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hot_here, bits = shared.value
        own = None if bits is None else Filter(bits)
        for lang, texts in _batches(rows):
            yield _stripe_rows(Tokens(texts), k, own, hot_here, lang)

    return docs.select("lang", "text").mapInPandas(run, _STRIPE)


class Merged:
    """The merged stripes of the keys in a batch, sorted by key."""

    def __init__(self, rows: pd.DataFrame):
        keys = list(zip(rows["lang"], rows["prefix"], rows["part"], strict=True))
        new = [True, *(x != y for x, y in zip(keys, keys[1:], strict=False))]
        self.keys = [k for k, n in zip(keys, new, strict=True) if n]
        stripe = np.cumsum(new) - 1
        counts = [np.frombuffer(c, dtype="<i8") for c in rows["counts"]]
        owner = np.repeat(stripe, [len(c) for c in counts])
        codes, self.words = pd.factorize(np.array(b" ".join(rows["nexts"]).split(b" "), dtype=object))
        pairs, place = np.unique(owner * len(self.words) + codes, return_inverse=True)
        # whole numbers throughout: float weights would round large counts
        self.counts = np.zeros(len(pairs), dtype=np.int64)
        np.add.at(self.counts, place, np.concatenate(counts))
        self.owner, self.after = pairs // len(self.words), pairs % len(self.words)

    def rows(self, which: int) -> pd.DataFrame:
        """One merged stripe as a partial one, to be merged with what follows."""
        own = self.owner == which
        nexts = b" ".join(self.words[self.after[own]].tolist())
        row = (*self.keys[which], nexts, self.counts[own].astype("<i8").tobytes())
        return _frame([row], _STRIPE_COLUMNS)

    def phrases(self, stripes_: int, least: int) -> pd.DataFrame:
        """Of the first ``stripes_``: frequent extensions, and a row with the total of each."""
        size = np.bincount(self.owner, minlength=len(self.keys))
        total = np.zeros(len(self.keys), dtype=np.int64)
        np.add.at(total, self.owner, self.counts)
        last = self.words == PIECE_END
        good = (self.counts >= least) & (self.owner < stripes_) & ~last[self.after]
        of = np.append(self.owner[good], np.flatnonzero((size > 0) & (np.arange(len(size)) < stripes_)))
        n = int(good.sum())
        heads = [self.keys[i] for i in of.tolist()]
        return pd.DataFrame(
            {
                "lang": pd.Series([h[0] for h in heads], dtype=object),
                "prefix": pd.Series([h[1] for h in heads], dtype=object),
                "next": pd.Series([*self.words[self.after[good]].tolist(), *[None] * (len(of) - n)], dtype=object),
                "a": np.append(self.counts[good], np.zeros(len(of) - n, dtype=np.int64)),
                "total": total[of],
                "whole": np.arange(len(of)) >= n,
            }
        )


def _merge(least: int):
    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: list[pd.DataFrame] = []
        size = 0
        for batch in rows:
            if not len(batch):
                continue
            waiting.append(batch)
            size += int(batch["nexts"].str.len().sum())
            if size >= BATCH_BYTES:
                merged = Merged(pd.concat(waiting, ignore_index=True))
                # the last stripe may go on in the next batch
                yield merged.phrases(len(merged.keys) - 1, least)
                waiting = [merged.rows(len(merged.keys) - 1)]
                size = int(waiting[0]["nexts"].str.len().sum())
                size = 0 if size >= BATCH_BYTES // 2 else size
        if waiting:
            merged = Merged(pd.concat(waiting, ignore_index=True))
            yield merged.phrases(len(merged.keys), least)

    return run


def merged(partial: DataFrame, least: int) -> DataFrame:
    """Frequent extensions ``lang, prefix, next, a``, and with ``whole`` the ``total`` of each
    part of each prefix."""
    keys = ["lang", "prefix", "part"]
    return partial.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(_merge(least), _PHRASE)


# -- phrases --------------------------------------------------------------------------


def _filter_of(phrases: DataFrame, k: int) -> Filter:
    """A Bloom filter of the phrases ``lang, phrase`` of ``k`` words: tasks make parts of it, and
    these are laid over one another by place."""
    span = 1 << 16  # bytes of the filter in a row

    def bits(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
        seen = False
        for batch in rows:
            if not len(batch):
                continue
            seen = True
            langs, lang_of = np.unique(batch["lang"].to_numpy(dtype=object), return_inverse=True)
            seeds = np.array([xxhash.xxh64_intdigest(x.encode()) for x in langs], dtype=np.uint64)[lang_of]
            words = [p.split(b" ") for p in batch["phrase"]]
            hashes = [
                np.array([xxhash.xxh64_intdigest(w[i]) for w in words], dtype=np.uint64) ^ seeds for i in range(k)
            ]
            at = Filter.places(phrase_hashes(hashes))
            np.bitwise_or.at(own, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        for i in range(0, len(own), span) if seen else ():
            yield pd.DataFrame({"at": [i], "bits": [own[i : i + span].tobytes()]})

    def laid(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        both = np.bitwise_or.reduce([np.frombuffer(b, dtype=np.uint8) for b in rows["bits"]])
        return pd.DataFrame({"at": [key[0]], "bits": [both.tobytes()]})

    parts = phrases.select("lang", "phrase").mapInPandas(bits, "at long, bits binary")
    rows = parts.groupBy("at").applyInPandas(laid, "at long, bits binary").collect()  # FILTER_BITS in all
    out = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
    for r in rows:
        out[r["at"] : r["at"] + span] = np.frombuffer(r["bits"], dtype=np.uint8)
    return Filter(out)


def _hot_words(docs: DataFrame) -> frozenset:
    """Words of a sample that make up a ``HOT_SHARE`` or more of it, so fewer than its inverse."""
    word = F.explode(F.split(F.lower(F.col("text").cast("string")), "[.,;:!?\\x09-\\x0D ]+"))
    counted = docs.sample(SAMPLE_SHARE, seed=1).select("lang", word.alias("w")).groupBy("lang", "w").count()
    counted = counted.withColumn("all", F.sum("count").over(Window.partitionBy()))
    rows = counted.where(F.col("count") >= HOT_SHARE * F.col("all")).select("lang", "w").collect()
    return frozenset((r["lang"], r["w"].encode()) for r in rows)


def phrase_counts(docs: DataFrame, max_words: int = MAX_WORDS, least: int = MIN_COUNT) -> list[DataFrame]:
    """``docs`` (``lang, text``) to the phrases of 1, 2 .. ``max_words`` words: ``lang, phrase`` (bytes),
    ``f`` and ``longest``, the count of the most frequent longer phrase they begin. Phrases of one
    word are all there, longer ones from ``least`` occurrences on."""
    own = docs.select(
        F.coalesce("lang", F.lit(UNKNOWN_LANG)).alias("lang"),
        F.coalesce("text", F.lit("")).cast("binary").alias("text"),
    )
    out, hot, known = [], _hot_words(own), None
    for k in range(1, max_words):
        found = written(merged(stripes(own, k, hot, known), least), "stripes")
        by_prefix = found.groupBy("lang", F.col("prefix").alias("phrase"))
        longest = F.coalesce(F.max("a"), F.lit(0)).alias("longest")
        if k == 1:
            totals = F.sum(F.when(F.col("whole"), F.col("total"))).alias("f")
            out.append(by_prefix.agg(totals, longest))
        else:
            largest = by_prefix.agg(longest)
            out[-1] = out[-1].join(largest, ["lang", "phrase"], "left").withColumn(
                "longest", F.coalesce("longest", F.lit(0))
            )
        phrases = found.where("not whole").select(
            "lang", F.concat("prefix", F.lit(b" "), "next").alias("phrase"), F.col("a").alias("f")
        )
        out.append(phrases)
        if k + 1 < max_words:
            known = _filter_of(phrases, k + 1)
            total = phrases.groupBy().agg(F.sum("f").alias("all"))
            large = phrases.join(total).where(F.col("f") >= HOT_SHARE * F.col("all"))
            hot = frozenset((r["lang"], bytes(r["phrase"])) for r in large.collect())
    out[-1] = out[-1].withColumn("longest", F.lit(0).cast("bigint"))
    return out


def collocations(
    docs: DataFrame, max_words: int = MAX_WORDS, least: int = MIN_COUNT, top: int = TOP
) -> DataFrame:
    """The ``top`` phrases of each language by their lowest-scoring cut."""
    counts = phrase_counts(docs, max_words, least)
    totals = counts[0].groupBy("lang").agg(F.sum("f").alias("n"))
    scored = []
    for size in range(2, max_words + 1):
        own = counts[size - 1].withColumn("words", F.split(F.col("phrase").cast("string"), " "))
        for k in range(1, size):
            left = F.array_join(F.slice("words", 1, k), " ").cast("binary")
            right = F.array_join(F.slice("words", k + 1, size - k), " ").cast("binary")
            own = own.withColumns({f"left_{k}": left, f"right_{k}": right})
        cuts = []
        for k in range(1, size):
            for side, words in (("left", k), ("right", size - k)):
                part = counts[words - 1].select("lang", F.col("phrase").alias(f"{side}_{k}"), F.col("f").alias(f"{side}_{k}_f"))
                own = own.join(part, ["lang", f"{side}_{k}"])
            l, r = (F.col(f"{side}_{k}_f") for side in ("left", "right"))
            square = F.expr("cast(f as decimal(15,0)) * cast(f as decimal(15,0)) * cast(1000000 as decimal(7,0))")
            own = own.withColumns({f"s_{k}": square, f"p_{k}": l.cast("decimal(15,0)") * r.cast("decimal(15,0)")})
            score = F.expr(f"s_{k} div p_{k}")
            cuts.append(F.struct(score.alias("score"), F.lit(k).alias("k"), l.alias("l"), r.alias("r")))
        cut = F.least(*cuts) if len(cuts) > 1 else cuts[0]
        if size < max_words:
            # a longer phrase that this one ends; what it begins is its stripe's largest extension
            longer = counts[size].select("lang", "phrase", "f")
            tail = F.regexp_replace(F.col("phrase").cast("string"), "^[^ ]* ", "").cast("binary")
            ended = longer.groupBy("lang", tail.alias("phrase")).agg(F.max("f").alias("ended"))
            own = own.join(ended, ["lang", "phrase"], "left")
            inside = F.greatest("longest", F.coalesce("ended", F.lit(0)))
            own = own.where(100 * inside < SUBSUMED_PCT * F.col("f"))
        scored.append(own.select("lang", F.col("phrase").cast("string").alias("phrase"), F.col("f").alias("a"), cut.alias("cut")))
    every = reduce(DataFrame.unionByName, scored).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    best = every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.join(totals, "lang").select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )


def op13_collocations(spark, sf_dir):
    """The first 2000 collocations of two and three words in each language of ``documents``."""
    return collocations(table(spark, sf_dir, "documents"))
