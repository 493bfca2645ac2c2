"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over a bounded sample of labelled text. A text is
cut greedily into phrases, each the longest match with a language's sample; a symbol that the
sample lacks ends a phrase and belongs to it. A text in the language needs few, long phrases. The
entropy estimate is phrases * log2(sample length) / text length, and the lowest wins; equal ones
go to the first language in code point order.

Texts are whole, lower-cased, with every run of non-letters as one blank. They are parsed in
stretches of ``STRETCH`` symbols, so that numpy follows thousands of stretches at once through
the automaton. Its transitions are sparse: one cell each in a double array, whatever the number of
letters, so Han or Hangul labels take no more room than Latin ones.

Learning uses at most ``SAMPLE_DOCS`` distinct texts (about; those of lowest hash) and
``SAMPLE_SYMBOLS`` symbols per language, as evenly from all of these texts as their lengths allow.
This bounds the model: an automaton over n symbols has at most 3 n transitions, and ``MAX_CELLS``
cells are asserted. Other columns of the documents pass through, whatever their names. Null text and text without letters
give ``und`` and score 0, as does any text if no labelled text exists. Repeated rows are
predicted alike; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import id_remainder, table

SAMPLE_DOCS = 200
SAMPLE_SYMBOLS = 30_000
STRETCH = 512
SPARE = 4  # characters read of a sampled text for each that its share asks for: runs of blanks shrink
NEAR_CELLS = 16  # so far back free cells are looked for
MAX_CELLS = 8 * SAMPLE_SYMBOLS
PIECE_CHARS = 2_000_000
FOLDS, HELD_OUT = 5, 0
UNDETERMINED = "und"
_OTHER, _BLANK = 0, 1  # symbols: a letter no sample has, any run of non-letters


_TO = (1 << 32) - 1  # lower half of a cell: where the transition leads; upper half: whose it is


def suffix_automaton(symbols: np.ndarray, alphabet: int) -> np.ndarray:
    """Transitions as one array of cells: that of a state for a symbol is at ``state + symbol``, if
    the upper half of the cell names the state; the lower half is the next state.

    The start is state 0, which no transition leads to.
    """
    moves: list[dict[int, int]] = [{}]
    length, link = [0], [-1]
    last = 0
    for c in symbols.tolist():
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                clone = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    return _cells(moves, alphabet)


def _cells(moves: list[dict[int, int]], alphabet: int) -> np.ndarray:
    """Places the states, those with most transitions first, where all their cells are free.

    Every state has a number of its own, so the owner of a cell is known by it.
    """
    room = sum(map(len, moves)) + len(moves) + 2 * alphabet + 2
    free = bytearray(b"\x01") * room  # grows as needed
    taken: set[int] = set()
    place = [0] * len(moves)
    low = 0  # where to look for a free cell
    by_size = sorted(range(1, len(moves)), key=lambda i: -len(moves[i]))
    single = False
    for state in [0, *by_size]:
        wanted = sorted(moves[state])
        if state and len(wanted) == 1 and not single:
            single, low = True, free.find(1)
        first = wanted[0] if wanted else 0
        cell = first if state == 0 else max(low, first + 1)
        while True:
            base = cell - first
            if base + alphabet >= len(free):
                free.extend(b"\x01" * (len(free) + alphabet))
            if base not in taken and all(free[base + c] for c in wanted):
                break
            cell = free.find(1, cell + 1) if wanted else cell + 1
            if cell < 0:
                cell = len(free)
        place[state] = base
        taken.add(base)
        for c in wanted:
            free[base + c] = 0
        # states of several symbols leave gaps, which those of one symbol fill in order
        low = max(low, cell - NEAR_CELLS)
    size = max(place) + alphabet + 1
    if size > MAX_CELLS + 4 * alphabet:
        raise ValueError(f"an automaton of {size} cells over {alphabet} symbols")
    out = np.full(size, -1 << 32, dtype=np.int64)
    for state, to in enumerate(moves):
        for c, target in to.items():
            out[place[state] + c] = place[state] << 32 | place[target]
    return out


def next_states(cells: np.ndarray, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """Where each state's symbol leads; 0 if there is no such transition."""
    found = cells[states + symbols]
    return np.where(found >> 32 == states, found & _TO, 0)


def count_phrases(cells: np.ndarray, symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Phrases of each stretch ``symbols[starts[i]:ends[i]]``."""
    order = np.argsort(starts - ends, kind="stable")  # longest first: the active ones lead
    at, sizes = starts[order], (ends - starts)[order]
    state = np.zeros(len(order), dtype=np.int64)
    phrases = np.zeros(len(order), dtype=np.int32)
    active = len(order)
    for step in range(int(sizes[0]) if len(sizes) else 0):
        while active and sizes[active - 1] <= step:
            active -= 1
        c = symbols[at[:active] + step]
        to = next_states(cells, state[:active], c)
        ended = np.flatnonzero(to == 0)
        phrases[ended] += 1
        to[ended] = next_states(cells, 0, c[ended])
        state[:active] = to
    phrases += state != 0
    out = np.empty_like(phrases)
    out[order] = phrases
    return out


@dataclass
class Model:
    """Automata of the languages in code point order, over one common alphabet."""

    letters: str
    languages: list[str]
    automata: list[np.ndarray]
    sizes: list[int]

    def symbol_table(self) -> np.ndarray:
        codes = np.full(0x110000, _BLANK, dtype=np.int32)
        codes[[i for i in range(0x110000) if chr(i).isalpha()]] = _OTHER
        codes[[ord(x) for x in self.letters]] = np.arange(2, 2 + len(self.letters))
        return codes


def symbols_of(texts: list[str], codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts in a row, and where each text begins (and the last ends)."""
    lowered = [t.lower() for t in texts]
    points = np.frombuffer("\n".join(lowered).encode("utf-32-le"), dtype=np.uint32)
    symbols = codes[points]
    begins = np.cumsum([0] + [len(t) + 1 for t in lowered])
    keep = np.ones(len(symbols), dtype=bool)
    blank = symbols == _BLANK
    keep[1:] = ~(blank[1:] & blank[:-1])
    before = np.concatenate([[0], np.cumsum(keep)])
    # the line break after each text is a blank of its own and stays outside it
    return symbols[keep], before[np.minimum(begins, len(symbols))]


def even_sample(symbols: np.ndarray, begins: np.ndarray, size: int) -> np.ndarray:
    """At most ``size`` symbols, as many from each text as from any other that has so many; a
    blank ends each stretch."""
    ends = begins[1:]
    lengths = np.diff(begins)
    share, left = 0, size - len(lengths)
    for rank, length in enumerate(np.sort(lengths).tolist()):
        share = left // (len(lengths) - rank)
        if length > share:
            break
        share = length
        left -= length
    blank = np.array([_BLANK], dtype=symbols.dtype)
    stretches = [
        part for b, e in zip(begins, ends, strict=False) if e > b for part in (symbols[b : min(e, b + share)], blank)
    ]
    joined = np.concatenate([*stretches, blank])
    keep = np.ones(len(joined), dtype=bool)
    keep[1:] = (joined[1:] != _BLANK) | (joined[:-1] != _BLANK)
    return joined[keep][:size]


def train(samples: dict[str, list[str]]) -> Model:
    """``samples``: language to texts, in the order in which they are used."""
    languages = sorted(samples)
    letters = sorted({c for texts in samples.values() for t in texts for c in t.lower() if c.isalpha()})
    model = Model("".join(letters), [], [], [])
    codes = model.symbol_table()
    for language in languages:
        symbols = even_sample(*symbols_of(samples[language], codes), SAMPLE_SYMBOLS)
        if len(symbols):
            model.languages.append(language)
            model.automata.append(suffix_automaton(symbols, len(letters) + 2))
            model.sizes.append(len(symbols))
    return model


def _entropies(model: Model, texts: list[str], codes: np.ndarray):
    symbols, begins = symbols_of(texts, codes)
    sizes = np.diff(begins)
    stretches = -(-sizes // STRETCH)
    of = np.repeat(np.arange(len(texts)), stretches)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(stretches) - stretches, stretches)
    starts = begins[of] + nth * STRETCH
    ends = np.minimum(starts + STRETCH, begins[of + 1])
    lettered = np.bincount(of, np.add.reduceat(symbols != _BLANK, starts) if len(of) else None, len(texts))
    out = [
        np.bincount(of, count_phrases(a, symbols, starts, ends), len(texts)) * math.log2(n + 1)
        for a, n in zip(model.automata, model.sizes, strict=True)
    ]
    return np.array(out) / np.maximum(sizes, 1), lettered > 0


def predict(model: Model, texts: list[str], codes: np.ndarray) -> tuple[list[str], list[float]]:
    """Language and score of each text; the score is the runner-up's share of both entropies."""
    names, scores = [], []
    first = 0
    while first < len(texts):
        last, chars = first, 0
        while last < len(texts) and (last == first or chars + len(texts[last]) <= PIECE_CHARS):
            chars += len(texts[last])
            last += 1
        if model.languages:
            entropy, lettered = _entropies(model, texts[first:last], codes)
            ranked = np.sort(entropy, axis=0)
            best = entropy.argmin(axis=0)
            total = ranked[0] + ranked[1] if len(ranked) > 1 else None
            score = ranked[1] / np.maximum(total, 1e-12) if total is not None else np.ones(len(best))
            names += [model.languages[b] if x else UNDETERMINED for b, x in zip(best, lettered, strict=True)]
            scores += [float(s) if x else 0.0 for s, x in zip(score, lettered, strict=True)]
        else:
            names += [UNDETERMINED] * (last - first)
            scores += [0.0] * (last - first)
        first = last
    return names, scores


def sample_texts(labelled: DataFrame, docs: int = SAMPLE_DOCS) -> dict[str, list[str]]:
    """About ``docs`` distinct texts per language, lowest hash first; rows of ``lang, text``."""
    rows = labelled.where(F.col("lang").isNotNull() & (F.col("text") != "")).select(
        "lang", "text", F.xxhash64("text").alias("key")
    )
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("key").alias("n"))
    share = F.least(F.lit(1.0), F.lit(float(docs)) / F.col("n"))
    enough = F.least(F.lit(SAMPLE_SYMBOLS), F.ceil(F.lit(SPARE * SAMPLE_SYMBOLS) / F.least("n", F.lit(docs))))
    # hashes are even over 64 bits, so a bound on them takes that share of the texts
    position = F.col("key") / F.lit(2.0**64) + 0.5
    bound = counts.select(F.col("lang").alias("b_lang"), share.alias("share"), enough.cast("int").alias("enough"))
    # one small row for each automaton that the model broadcasts; without the hint all texts of a
    # language would meet in one task
    bound = F.broadcast(bound)
    few = (
        rows.join(bound, F.col("lang") == F.col("b_lang"))
        .where(position <= F.col("share"))
        .groupBy("lang", "key")
        .agg(F.min(F.left("text", F.col("enough"))).alias("text"))
    )
    out: dict[str, list[str]] = {}
    for row in sorted(few.collect(), key=lambda r: (r["lang"], r["key"])):
        out.setdefault(row["lang"], []).append(row["text"])
    return out


def identifier(spark, model: Model):
    """A column function: text to struct of ``lang, score``."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def identify(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codes = shared.value.symbol_table()
        for texts in batches:
            names, scores = predict(shared.value, ["" if t is None else t for t in texts], codes)
            yield pd.DataFrame({"lang": names, "score": scores})

    return identify


def identify_languages(docs: DataFrame, labelled: DataFrame, text: Column) -> Column:
    """Struct of ``lang, score`` for ``text``, learned from ``labelled`` (``lang, text``)."""
    return identifier(docs.sparkSession, train(sample_texts(labelled)))(text)


def with_language(docs: DataFrame) -> DataFrame:
    """The documents whose language can be told, learned from their own labels.

    ``lang`` is the language found, whatever the label was: a null label is filled and a differing
    one replaced.
    """
    held_out = id_remainder(F.col("doc_id"), FOLDS) == HELD_OUT
    model = train(sample_texts(docs.where(~held_out).select("lang", "text")))
    # not deterministic in name only: else the filter would identify every text a second time
    identify = identifier(docs.sparkSession, model).asNondeterministic()
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    found = docs.select(whole.alias("doc"), identify("text").alias("found")).where(F.col("found.lang") != UNDETERMINED)
    own = [F.col("found.lang") if c == "lang" else F.col("doc").getField(c) for c in docs.columns]
    return found.select(*[c.alias(n) for c, n in zip(own, docs.columns, strict=True)])


def op7_language(spark, sf_dir):
    """The language of every whole text of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    held_out = id_remainder(F.col("doc_id"), FOLDS) == HELD_OUT
    found = identify_languages(docs, docs.where(~held_out).select("lang", "text"), F.col("text"))
    return docs.select("doc_id", held_out.alias("held_out"), found.alias("found")).select(
        "doc_id", "held_out", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score")
    )
