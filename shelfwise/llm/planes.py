"""Token ids as byte or bit planes: a file format, a Spark data source for it, and an encoder.

Ids are cut into blocks of ``BLOCK_IDS``. A block is transposed: plane k holds byte k (or bit k)
of every id, so the nearly constant high planes shrink to nothing. Each plane is compressed with
zstandard on its own. A file ends with its chunk index (place and plane sizes of every block) and
its document table (ids and lengths), so any span of ids can be read without the rest.

``df.write.format("idplanes").save(path)`` takes ``doc_id long, ids binary`` (little-endian
unsigned 32-bit ids), or with a tokenizer ``doc_id long, text string``, in the order of partitions
and rows, and ``spark.read.format("idplanes")``
gives ``doc_id, start, ids`` back, ``start`` counting the ids of all documents before. Tasks
write files of their own names; the job's commit writes ``_index.json``, which alone makes files
count, so retried and lost tasks leave nothing that a reader sees. Tasks and index are written
through pyarrow's file systems: the path must be one that every executor reaches.

Null texts count as empty, and an empty document holds the end id only. Null ids come first.
Rows of equal id are told apart by the hash of their text; equal rows stand next to each other.
Texts are whole: a very long one is encoded in segments cut where no token can cross. A document's
ids must fit a Spark value (2 GB). Other columns are ignored. An empty table gives an index
without files and no rows.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    InputPartition,
    WriterCommitMessage,
)
from tokenizers import Tokenizer

from shelfwise.llm.common import table
from shelfwise.session import new_place

MAGIC = b"IDPLANE1"
BLOCK_IDS = 1 << 16
FILE_IDS = 1 << 26
LEVEL = 3
BATCH_BYTES = 4 << 20
INDEX = "_index.json"
VOCABULARY, END_ID = "byte_bpe_50k.json", 0

# -- blocks ---------------------------------------------------------------------------


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """The planes of a block: 4 of bytes or 32 of bits, least significant first."""
    octets = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    if kind == "bytes":
        return [p.tobytes() for p in octets.T]
    bits = np.unpackbits(octets, axis=1, bitorder="little")
    return [p.tobytes() for p in np.packbits(bits.T, axis=1, bitorder="little")]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    rows = np.array([np.frombuffer(p, dtype=np.uint8) for p in planes])
    if len(planes) == 4:
        return np.ascontiguousarray(rows.T).view("<u4").reshape(-1)
    bits = np.unpackbits(rows, axis=1, count=n, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u4").reshape(-1)


# -- files ----------------------------------------------------------------------------


def place_of(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path behind a URI or an absolute path."""
    return fs.FileSystem.from_uri(path)


class PlaneWriter:
    """One file: blocks as they fill up, then document table and chunk index."""

    def __init__(self, out, kind: str):
        self.out, self.kind, self.at = out, kind, len(MAGIC)
        self.pack = zstandard.ZstdCompressor(level=LEVEL)
        self.open_ids: list[bytes] = []
        self.open_bytes = self.n_ids = 0
        self.doc_ids: list[int | None] = []
        self.lengths: list[int] = []
        self.chunks: list[list[int]] = []
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.doc_ids.append(doc_id)
        self.lengths.append(len(ids) // 4)
        self.n_ids += len(ids) // 4
        self.open_ids.append(ids)
        self.open_bytes += len(ids)
        if self.open_bytes >= 16 * BLOCK_IDS * 4:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.open_ids), dtype="<u4")
        full = len(ids) if last else len(ids) // BLOCK_IDS * BLOCK_IDS
        for begin in range(0, full, BLOCK_IDS):
            block = ids[begin : min(begin + BLOCK_IDS, full)]
            packed = [self.pack.compress(p) for p in to_planes(block, self.kind)]
            self.out.write(b"".join(packed))
            self.chunks.append([self.at, len(block), *map(len, packed)])
            self.at += sum(map(len, packed))
        rest = ids[full:].tobytes()
        self.open_ids, self.open_bytes = [rest], len(rest)

    def close(self) -> None:
        self._flush(True)
        known = np.array([d is not None for d in self.doc_ids], dtype=np.uint8)
        parts = [
            np.array(self.chunks, dtype="<i8").tobytes(),
            np.array([d or 0 for d in self.doc_ids], dtype="<i8").tobytes(),
            np.packbits(known).tobytes(),
            np.array(self.lengths, dtype="<i8").tobytes(),
        ]
        packed = [self.pack.compress(p) for p in parts]
        head = {"kind": self.kind, "chunks": len(self.chunks), "docs": len(self.doc_ids), "sizes": [*map(len, packed)]}
        tail = json.dumps(head).encode()
        self.out.write(b"".join(packed) + tail + struct.pack("<I", len(tail)) + MAGIC)
        self.out.close()


class PlaneFile:
    """One file: its tables, and any span of its ids."""

    def __init__(self, system: fs.FileSystem, path: str):
        self.file = system.open_input_file(path)
        size = self.file.size()
        end = self.file.read_at(12, size - 12)
        if end[4:] != MAGIC:
            raise ValueError(f"{path} is no complete file of id planes")
        (n,) = struct.unpack("<I", end[:4])
        head = json.loads(self.file.read_at(n, size - 12 - n))
        unpack = zstandard.ZstdDecompressor().decompress
        at, parts = size - 12 - n - sum(head["sizes"]), []
        for part in head["sizes"]:
            parts.append(unpack(self.file.read_at(part, at)))
            at += part
        self.kind, self.docs = head["kind"], head["docs"]
        self.chunks = np.frombuffer(parts[0], dtype="<i8").reshape(head["chunks"], -1)
        self.doc_ids = np.frombuffer(parts[1], dtype="<i8")
        self.known = np.unpackbits(np.frombuffer(parts[2], dtype=np.uint8), count=self.docs).astype(bool)
        self.lengths = np.frombuffer(parts[3], dtype="<i8")
        self.begins = np.concatenate([[0], np.cumsum(self.chunks[:, 1])]) if self.docs else np.zeros(1, dtype=np.int64)

    def block(self, k: int) -> np.ndarray:
        at, n, *sizes = self.chunks[k].tolist()
        data, unpack, planes = self.file.read_at(sum(sizes), at), zstandard.ZstdDecompressor().decompress, []
        for s in sizes:
            planes.append(unpack(data[:s]))
            data = data[s:]
        return from_planes(planes, n)

    def span(self, begin: int, end: int) -> np.ndarray:
        """The ids from ``begin`` to ``end``; only their blocks are read."""
        if end <= begin:
            return np.zeros(0, dtype="<u4")
        first = int(np.searchsorted(self.begins, begin, side="right")) - 1
        last = int(np.searchsorted(self.begins, end, side="left"))
        ids = np.concatenate([self.block(k) for k in range(first, last)])
        return ids[begin - self.begins[first] : end - self.begins[first]]


def index_of(path: str) -> dict:
    """The written index: kind, and each file with its first id and numbers of ids and documents."""
    system, root = place_of(path)
    with system.open_input_stream(f"{root}/{INDEX}") as f:
        return json.loads(f.read())


def read_span(path: str, start: int, n: int) -> np.ndarray:
    """``n`` ids from position ``start`` of the whole collection, fewer at its end."""
    system, root = place_of(path)
    parts = [np.zeros(0, dtype="<u4")]
    for f in index_of(path)["files"]:
        begin, end = max(start, f["start"]), min(start + n, f["start"] + f["ids"])
        if begin < end:
            parts.append(PlaneFile(system, f"{root}/{f['name']}").span(begin - f["start"], end - f["start"]))
    return np.concatenate(parts)


# -- data source ----------------------------------------------------------------------


@dataclass
class Written(WriterCommitMessage):
    """Files of a task, in order."""

    partition: int
    files: list[dict]


class IdPlanesWriter(DataSourceArrowWriter):
    def __init__(self, path: str, kind: str, file_ids: int, overwrite: bool, tokenizer: str | None, end: bytes):
        """With ``tokenizer``, the text of its file, the second column is text to be encoded."""
        self.path, self.kind, self.file_ids, self.tokenizer, self.end = path, kind, file_ids, tokenizer, end
        system, root = place_of(path)
        if not overwrite and system.get_file_info(f"{root}/{INDEX}").type != fs.FileType.NotFound:
            raise ValueError(f"{path} holds id planes already")

    def rows(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, bytes]]:
        """Ids of each document; texts are encoded some ``BATCH_CHARS`` at a time."""
        own = encoder_of(self.tokenizer) if self.tokenizer else None
        docs, texts, chars = [], [], 0
        for batch in batches:
            for doc_id, cell in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if own is None:
                    yield doc_id, (cell or b"") + self.end
                    continue
                docs.append(doc_id)
                texts.append(cell or "")
                chars += len(texts[-1])
                if chars >= BATCH_CHARS:
                    yield from zip(docs, (b + self.end for b in own.encode(texts)), strict=True)
                    docs, texts, chars = [], [], 0
        if texts:
            yield from zip(docs, (b + self.end for b in own.encode(texts)), strict=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = place_of(self.path)
        system.create_dir(root, recursive=True)
        partition = TaskContext.get().partitionId()
        files, writer = [], None

        def close() -> None:
            writer.close()
            files.append({"name": name, "ids": writer.n_ids, "docs": len(writer.doc_ids)})

        for doc_id, ids in self.rows(iterator):
            if writer is None:
                name = f"part-{partition:05}-{len(files):05}-{uuid.uuid4().hex[:12]}.idp"
                writer = PlaneWriter(system.open_output_stream(f"{root}/{name}"), self.kind)
            writer.add(doc_id, ids)
            if writer.n_ids >= self.file_ids:
                close()
                writer = None
        if writer is not None:
            close()
        return Written(partition, files)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = place_of(self.path)
        system.create_dir(root, recursive=True)
        files, start = [], 0
        for m in sorted((m for m in messages if m is not None), key=lambda m: m.partition):
            for f in m.files:
                files.append(f | {"start": start})
                start += f["ids"]
        with system.open_output_stream(f"{root}/{INDEX}") as out:
            out.write(json.dumps({"kind": self.kind, "ids": start, "files": files}).encode())
        # what earlier versions and lost attempts left is in no index
        named = {f["name"] for f in files}
        for info in system.get_file_info(fs.FileSelector(root)):
            if info.base_name.endswith(".idp") and info.base_name not in named:
                system.delete_file(info.path)

    def abort(self, messages: list[Written | None]) -> None:
        system, root = place_of(self.path)
        for m in messages:
            for f in m.files if m is not None else []:
                system.delete_file(f"{root}/{f['name']}")


@dataclass
class FilePart(InputPartition):
    name: str
    start: int


class IdPlanesReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[FilePart]:
        return [FilePart(f["name"], f["start"]) for f in index_of(self.path)["files"]]

    def read(self, partition: FilePart) -> Iterator[pa.RecordBatch]:
        system, root = place_of(self.path)
        # a source without files still gets one empty partition
        if partition is None or getattr(partition, "name", None) is None:
            return
        own = PlaneFile(system, f"{root}/{partition.name}")
        ends = np.cumsum(own.lengths)
        first = 0
        while first < own.docs:
            begin = int(ends[first - 1]) if first else 0
            last = max(first + 1, int(np.searchsorted(ends, begin + BATCH_BYTES // 4, side="right")))
            ids = own.span(begin, int(ends[last - 1])).tobytes()
            begins = np.concatenate([[begin], ends[first : last - 1]])
            cuts = ((begins - begin) * 4).tolist() + [len(ids)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(own.doc_ids[first:last], mask=~own.known[first:last]),
                    pa.array(begins + partition.start),
                    pa.array([ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], type=pa.binary()),
                ],
                names=["doc_id", "start", "ids"],
            )
            first = last


class IdPlanes(DataSource):
    """Options: ``path``; ``planes`` = ``bytes`` or ``bits``; ``file_ids``, ids after which a new
    file begins; ``tokenizer``, a file of the ``tokenizers`` library, if texts are written instead of
    ids (read here, on the driver); ``end_id``, put after each document."""

    @classmethod
    def name(cls) -> str:
        return "idplanes"

    def schema(self) -> str:
        return "doc_id long, start long, ids binary"

    def reader(self, schema) -> IdPlanesReader:
        return IdPlanesReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> IdPlanesWriter:
        own, tokenizer = self.options, None
        if "tokenizer" in own:
            with open(own["tokenizer"], encoding="utf-8") as f:
                tokenizer = f.read()
        kinds = [f.dataType.simpleString() for f in schema.fields]
        if kinds != ["bigint", "string" if tokenizer else "binary"]:
            raise ValueError("id planes take doc_id long and ids binary, or text string with a tokenizer")
        kind = own.get("planes", "bytes")
        if kind not in ("bytes", "bits"):
            raise ValueError(f"planes must be bytes or bits, not {kind}")
        end = struct.pack("<I", int(own["end_id"])) if "end_id" in own else b""
        return IdPlanesWriter(own["path"], kind, int(own.get("file_ids", FILE_IDS)), overwrite, tokenizer, end)


def _write(rows: DataFrame, path: str, options: dict) -> None:
    rows.sparkSession.dataSource.register(IdPlanes)
    rows.write.format("idplanes").options(**options).mode("overwrite").save(path)


def write_ids(rows: DataFrame, path: str, planes: str = "bytes", file_ids: int = FILE_IDS) -> None:
    """Write ``doc_id, ids`` in the order that ``rows`` has."""
    own = rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), "ids")
    _write(own, path, {"planes": planes, "file_ids": file_ids})


def write_texts(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int = END_ID,
    planes: str = "bytes",
    file_ids: int = FILE_IDS,
) -> None:
    """Encode ``doc_id, text`` and write the ids, in the order that ``docs`` has."""
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    _write(own, path, {"planes": planes, "file_ids": file_ids, "tokenizer": tokenizer, "end_id": end_id})


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, ids`` of every written document."""
    spark.dataSource.register(IdPlanes)
    return spark.read.format("idplanes").load(path)


# -- encoding -------------------------------------------------------------------------

PIECES_KEPT = 800_000
BATCH_CHARS, SEGMENT = 4_000_000, 1_000_000
WORDS_AT_ONCE = 4000
_CUT = re.compile(r"(?=[ \n][\w!-~])")  # no token crosses the place before such a blank
_SIMPLE = re.compile(r"[ -~\nÀ-ÿ]*")
# Fixed value: the byte-level word pattern, for characters that _SIMPLE allows
_L = "A-Za-zÀ-ÖØ-öø-ÿ"
_WORD = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[0-9]+| ?[^\s{_L}0-9]+|\s+(?!\S)|\s+")
# a blank, full stop or comma (or the mark _pieces uses) at which a text must not simply be cut
_ODD = re.compile(rf"[ \n.,\0](?:(?<=[ \n])(?![\w!-~])|(?<=[.,])(?<![{_L}0-9][.,])|(?<=\0))")


class PieceEncoder:
    """The ids that the library gives, with the ids of pieces of text remembered.

    A text is cut at single blanks and after words, where no token crosses; a piece that is new is
    cut by the word pattern, and only new words go to the library, many at a time on lines of their
    own. What does not fit the simple rules goes to the library in larger pieces or whole.
    """

    def __init__(self, text: str):
        """``text`` is the tokenizer's file."""
        self.tokenizer = Tokenizer.from_str(text)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        file = json.loads(text)
        self.special = [t["content"] for t in file["added_tokens"]]
        steps = file["pre_tokenizer"]
        line = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.line = line[0]
        self.plain = (
            file["normalizer"] is None
            and steps["type"] == "ByteLevel"
            and steps["use_regex"]
            and not steps["add_prefix_space"]
            and len(line) == 1
        )
        # what is used stays: pieces of the older generation go over to the young one when they recur
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _library(self, texts: list[str]) -> list[bytes]:
        coded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in coded]

    def _learn_words(self, words: list[str]) -> None:
        blank = [w for w in words if not w.strip()]
        self.known.update(zip(blank, self._library(blank), strict=True))
        lines = [w for w in words if w.strip()]
        for at in range(0, len(lines), WORDS_AT_ONCE):
            part = lines[at : at + WORDS_AT_ONCE]
            packed = self._library(["\n".join(part)])[0]
            ends = np.flatnonzero(np.frombuffer(packed, dtype="<u4") == self.line) * 4
            begins = [0, *(ends + 4).tolist()]
            coded = [packed[a:b] for a, b in zip(begins, [*ends.tolist(), len(packed)], strict=True)]
            self.known.update(zip(part, coded, strict=True))

    def _learn(self, pieces: list[str]) -> None:
        known = self.known
        rest = [p for p in pieces if not _SIMPLE.fullmatch(p)]
        known.update(zip(rest, self._library(rest), strict=True))
        split = {p: words for p in pieces if len(words := _WORD.findall(p)) > 1 and p not in known}
        words = {w for several in split.values() for w in several} | {p for p in pieces if p not in split}
        self._learn_words([w for w in words if w not in known])
        for p, several in split.items():
            known[p] = b"".join([known[w] for w in several])

    def _segments(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > SEGMENT and (cut := _CUT.search(text, at + SEGMENT)):
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:]

    def _marked(self, segment: str) -> str:
        """The segment with a mark at each cut."""
        if _ODD.search(segment):
            return "\0".join(_CUT.split(segment))
        return segment.replace(" ", "\0 ").replace("\n", "\0\n\0").replace(".", "\0.").replace(",", "\0,")

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text; ``texts`` of ``BATCH_CHARS`` or so."""
        out: list[bytes] = [b""] * len(texts)
        owner: list[int] = []
        marked: list[str] = []
        for i, text in enumerate(texts):
            if not self.plain or "\0" in text or any(s in text for s in self.special):
                out[i] = self._library([text])[0]
                continue
            for segment in self._segments(text):
                owner.append(i)
                marked.append(self._marked(segment))
        if not owner:
            return out
        cut = pc.split_pattern(pa.array(marked, type=pa.string()), "\0")
        pieces = cut.values.dictionary_encode()
        names = pieces.dictionary.to_pylist()
        if len(self.known) > PIECES_KEPT // 2:
            self.known, self.older = {}, self.known
        found = list(map(self.known.get, names))
        new = [p for p, f in zip(names, found, strict=True) if f is None]
        again = {p: f for p, f in zip(new, map(self.older.get, new), strict=True) if f is not None}
        self.known.update(again)
        self._learn([p for p in new if p not in again])
        found = list(map(self.known.__getitem__, names))
        # copy each piece's ids to the places of its occurrences, all at once
        ids = np.frombuffer(b"".join(found), dtype="<u4")
        size = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
        begin = np.cumsum(size) - size
        code = pieces.indices.to_numpy()
        ends = np.cumsum(size[code])
        shift = begin[code] - (ends - size[code])
        flat = ids[np.repeat(shift, size[code]) + np.arange(ends[-1])].tobytes()
        bounds = np.append(0, ends)[cut.offsets.to_numpy()] * 4
        for i, a, b in zip(owner, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            out[i] = out[i] + flat[a:b] if out[i] else flat[a:b]
        return out


_kept: dict[int, PieceEncoder] = {}


def encoder_of(tokenizer: str) -> PieceEncoder:
    """This worker's encoder; what it has learned stays between tasks."""
    key = hash(tokenizer)
    if key not in _kept:
        _kept.clear()
        _kept[key] = PieceEncoder(tokenizer)
    return _kept[key]


def in_id_order(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` range-partitioned and sorted by id, then by hash of the text."""
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("hash"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("hash")]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")


def op12_planes(spark, sf_dir):
    """Every whole text of ``documents`` as ids in files of byte planes, read back from them."""
    import public_tokenizers

    docs = in_id_order(table(spark, sf_dir, "documents"))
    path = new_place(spark, "llm-planes")
    write_texts(docs, path, public_tokenizers.path(VOCABULARY))
    return read_ids(spark, path).select(
        "doc_id",
        "start",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
    )
