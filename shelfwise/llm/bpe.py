"""BPE encoding and decoding by speculation and verification.

Greedy longest match proposes the tokens of each distinct word. A sequence of tokens is the result
of merging exactly if that holds for each two neighbours, so numpy tests every adjacent pair of
all words at once: it takes the merges of both tokens back, latest first, and looks for a merge
across the boundary that would have come earlier. Only words with a failing pair are merged step
by step.

The vocabulary is a file of the ``tokenizers`` library: BPE over byte characters with a word-end
suffix. Text is cut at blanks and line ends, which no word holds; the ids of words and pieces are
remembered in dictionaries of bounded size, which a Python worker keeps between tasks. Texts are whole; null counts as empty; empty text gives
no ids, and no ids decode to empty text. Repeated rows are encoded alike.
"""

from __future__ import annotations

import heapq
import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shelfwise.llm.common import Remembered, table

WORDS_KEPT, PIECES_KEPT = 400_000, 300_000
BATCH_CHARS = 1_000_000
HEAP_FROM = 64
WORD_END = "</w>"
# Fixed value: the words of the pattern that the vocabulary file holds, in printable ASCII.
PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
PLAIN_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")
_NEVER = 1 << 40


class Vocabulary:
    """Tokens, their merges, and which tokens merging can reach."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            text = f.read()
        file, parts = json.loads(text), Tokenizer.from_str(text)
        # the library's own normal form and word pattern: Unicode versions differ elsewhere
        self.normalizer, self.splitter = parts.normalizer, parts.pre_tokenizer
        # printable ASCII needs neither, if the file has the expected pattern
        steps = file["pre_tokenizer"].get("pretokenizers", [])
        self.plain = any(step.get("pattern") == {"Regex": PATTERN} for step in steps)
        ids: dict[str, int] = file["model"]["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in file["model"]["merges"]]
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        size = max([*ids.values(), *self.special.values()]) + 1
        self.names = np.full(size, "", dtype=object)
        for name, i in [*ids.items(), *self.special.items()]:
            self.names[i] = name
        # merge k joins left[k] and right[k]; made_by is the merge a token comes from, -1 if none
        self.left = np.array([ids[a] for a, _ in merges], dtype=np.int64)
        self.right = np.array([ids[b] for _, b in merges], dtype=np.int64)
        self.result = np.array([ids[a + b] for a, b in merges], dtype=np.int64)
        self.made = self.result.tolist()
        self.made_by = np.full(size, -1, dtype=np.int64)
        self.made_by[self.result[::-1]] = np.arange(len(merges))[::-1]
        keys = self.left * size + self.right
        self.key_order = np.argsort(keys, kind="stable")
        self.keys = keys[self.key_order]
        self.size = size
        self.rank = {(a, b): k for k, (a, b) in enumerate(zip(self.left.tolist(), self.right.tolist(), strict=True))}
        self.proposed = self._reachable(ids)
        # the longest token that begins with three given characters
        self.reach: dict[str, int] = {}
        for name in self.proposed:
            size_of = len(name.removesuffix(WORD_END))
            self.reach[name[:3]] = max(size_of, self.reach.get(name[:3], 2))

    def _reachable(self, ids: dict[str, int]) -> dict[str, int]:
        """Tokens that merging makes out of their own text; others must not be proposed."""
        intact = self.compatible(self.left, self.right, np.arange(len(self.left)))
        good = self.made_by < 0
        for k, token in enumerate(self.result.tolist()):
            if self.made_by[token] == k:
                good[token] = intact[k] and good[self.left[k]] and good[self.right[k]]
        return {t: i for t, i in ids.items() if good[i]}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair, ``_NEVER`` if there is none."""
        keys = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.key_order[at], _NEVER)

    def compatible(self, left: np.ndarray, right: np.ndarray, before: np.ndarray | int = _NEVER):
        """Whether no merge crosses the boundary between two tokens earlier than ``before``."""
        good = np.ones(len(left), dtype=bool)
        open_ = np.arange(len(left))
        a, b = left.astype(np.int64), right.astype(np.int64)
        bound = np.broadcast_to(np.asarray(before, dtype=np.int64), len(left)).copy()
        while len(open_):
            crossed = self.ranks(a, b) < bound
            good[open_[crossed]] = False
            made_a, made_b = self.made_by[a], self.made_by[b]
            go_on = ~crossed & ((made_a >= 0) | (made_b >= 0))
            open_, a, b = open_[go_on], a[go_on], b[go_on]
            made_a, made_b = made_a[go_on], made_b[go_on]
            # take the later merge back; of two equal ones the right one came later
            undo_a = made_a > made_b
            bound = np.where(undo_a, made_a, made_b + 1)
            a = np.where(undo_a, self.right[made_a], a)
            b = np.where(undo_a, b, self.left[made_b])
        return good

    def propose(self, word: str) -> list[int]:
        """Greedy longest match over byte characters; the last token carries the word end."""
        out, at, n = [], 0, len(word)
        while at < n:
            end = min(n, at + self.reach.get(word[at : at + 3], 2))
            while True:
                token = self.proposed.get(word[at:end] + WORD_END if end == n else word[at:end])
                if token is not None:
                    break
                end -= 1
            out.append(token)
            at = end
        return out

    def merge(self, word: str) -> list[int]:
        """Exact merging: the pair of lowest rank first, the leftmost of equal ones."""
        tokens = [self.proposed[c] for c in word[:-1]] + [self.proposed[word[-1] + WORD_END]]
        if len(tokens) > HEAP_FROM:
            return self._merge_long(tokens)
        rank = self.rank
        ranks = [rank.get(p, _NEVER) for p in zip(tokens, tokens[1:], strict=False)]
        while ranks and (r := min(ranks)) < _NEVER:
            i = ranks.index(r)
            tokens[i : i + 2] = [self.made[r]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank.get((tokens[i - 1], tokens[i]), _NEVER)
            if i < len(ranks):
                ranks[i] = rank.get((tokens[i], tokens[i + 1]), _NEVER)
        return tokens

    def _merge_long(self, tokens: list[int]) -> list[int]:
        """The same with a heap of pairs and linked neighbours, for long words."""
        after = [*range(1, len(tokens)), -1]
        before = list(range(-1, len(tokens) - 1))
        heap = [
            (r, i, p[0], p[1])
            for i, p in enumerate(zip(tokens, tokens[1:], strict=False))
            if (r := self.rank.get(p)) is not None
        ]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if tokens[i] != a or j < 0 or tokens[j] != b:
                continue  # one of the two has been merged meanwhile
            tokens[i] = self.made[r]
            tokens[j] = -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (s := self.rank.get((tokens[x], tokens[y]))) is not None:
                    heapq.heappush(heap, (s, x, tokens[x], tokens[y]))
        return [t for t in tokens if t >= 0]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of distinct words of byte characters: propose, verify all pairs, mend the rest."""
        out = [self.propose(w) for w in words]
        sizes = np.array([len(t) for t in out], dtype=np.int64)
        flat = np.array([i for t in out for i in t], dtype=np.int64)
        owner = np.repeat(np.arange(len(words)), sizes)
        if len(flat) > 1:
            inner = owner[1:] == owner[:-1]
            bad = ~self.compatible(flat[:-1][inner], flat[1:][inner])
            for w in np.unique(owner[1:][inner][bad]).tolist():
                out[w] = self.merge(words[w])
        return out


class Encoder:
    """Encodes texts, remembering the ids of words and of pieces between blanks."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.words, self.pieces = Remembered(WORDS_KEPT), Remembered(PIECES_KEPT)
        special = "|".join(re.escape(s) for s in sorted(vocabulary.special, key=len, reverse=True))
        self.special = re.compile(f"({special})") if special else None

    def _split(self, piece: str) -> list[str]:
        if self.vocabulary.plain and piece.isascii() and piece.isprintable():
            return PLAIN_WORD.findall(piece.lower())
        normal = self.vocabulary.normalizer.normalize_str(piece)
        return [w for w, _ in self.vocabulary.splitter.pre_tokenize_str(normal)]

    def _learn(self, pieces: list[str]) -> None:
        split = [self._split(p) for p in pieces]
        new = self.words.missing({w for words in split for w in words})
        known = self.words.young
        for w, ids in zip(new, self.vocabulary.encode_words(new), strict=True):
            known[w] = struct.pack(f"<{len(ids)}I", *ids)
        for p, words in zip(pieces, split, strict=True):
            self.pieces.young[p] = known[words[0]] if len(words) == 1 else b"".join([known[w] for w in words])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        out: list[bytes] = []
        first = 0
        while first < len(texts):
            last, chars, parts = first, 0, []
            while last < len(texts) and (last == first or chars + len(texts[last]) <= BATCH_CHARS):
                text = texts[last]
                chars += len(text)
                cut = self.special.split(text) if self.special and "<|" in text else [text]
                parts.append([p if k % 2 else p.replace("\n", " ").split(" ") for k, p in enumerate(cut)])
                last += 1
            self._learn(self.pieces.missing({p for doc in parts for run in doc[::2] for p in run}))
            known = self.pieces.young
            for doc in parts:
                out.append(
                    b"".join(
                        struct.pack("<I", self.vocabulary.special[run])
                        if k % 2
                        else b"".join(map(known.__getitem__, run))
                        for k, run in enumerate(doc)
                    )
                )
            first = last
        return out


_kept: dict[str, Encoder] = {}


def _encoder_of(shared, path: str) -> Encoder:
    """This worker's encoder; what it has learned stays between tasks."""
    if path not in _kept:
        _kept[path] = Encoder(shared.value)
    return _kept[path]


def decode(ids: bytes | None, names: np.ndarray) -> str:
    """Token names joined by a blank, special tokens included; the file states no decoder."""
    return " ".join(names[np.frombuffer(ids or b"", dtype="<u4")].tolist())


def encoder(spark: SparkSession, path: str):
    """A column function: text to its ids as little-endian unsigned 32-bit integers."""
    shared = spark.sparkContext.broadcast(Vocabulary(path))

    @F.pandas_udf("binary")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = _encoder_of(shared, path)
        for texts in batches:
            yield pd.Series(own.encode(["" if t is None else t for t in texts]), dtype=object)

    return encode


def decoder(spark: SparkSession, path: str):
    """A column function: ids to text."""
    shared = spark.sparkContext.broadcast(Vocabulary(path).names)

    @F.pandas_udf("string")
    def to_text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for ids in batches:
            yield pd.Series([decode(b, shared.value) for b in ids], dtype=object)

    return to_text


def round_trip(docs: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """``key, ids, decoded`` of each row's ``text``: encoded, and the ids decoded again.

    Both in one Python worker, and given back in small batches, so that memory stays bounded
    however many rows a batch has.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(path))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = _encoder_of(shared, path)
        for batch in batches:
            texts = ["" if t is None else t for t in batch["text"]]
            at = 0
            while at < len(texts):
                to, chars = at, 0
                while to < len(texts) and (to == at or chars + len(texts[to]) <= BATCH_CHARS):
                    chars += len(texts[to])
                    to += 1
                ids = own.encode(texts[at:to])
                decoded = [decode(b, own.vocabulary.names) for b in ids]
                yield pd.DataFrame({"key": batch["key"].iloc[at:to].array, "ids": ids, "decoded": decoded})
                at = to

    # the key travels as text: a null among integers would turn pandas' column into floats
    kind = docs.schema[key].dataType
    rows = docs.select(F.col(key).cast("string").alias("key"), "text")
    out = rows.mapInPandas(run, "key string, ids binary, decoded string")
    return out.select(F.col("key").cast(kind).alias(key), "ids", "decoded")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Per document: id, number of tokens, and digests of the ids and of the decoded text."""
    return round_trip(docs, path).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op2_bpe(spark, sf_dir):
    """Every whole text of ``documents``, encoded and decoded with a public vocabulary."""
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
