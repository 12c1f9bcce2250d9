r"""Byte-level BPE encoding and decoding of whole texts.

Encoding follows overlapping chunks. A text is cut into chunks of ``CHUNK`` characters, each with
``OVERLAP`` more behind it. Every chunk is pre-tokenised and its pieces are encoded where the chunk lies, whichever task that
is; its first cut is a guess. The pattern looks only ahead, so once two neighbours share one boundary inside their overlap,
their boundaries agree from there on (and it looks behind a piece only to see whether white space ends): that place joins them. A chunk
owns the pieces between the place where it joins its predecessor and the place where its successor joins it. Only packed ids and
the boundaries in the overlaps travel on: a text's own parts are concatenated by chunk number. Where neighbours
share no boundary (a pre-token longer than the overlap), the bytes that the ids stand for are pre-tokenised again from the
last safe place before the later chunk.

A text of one chunk has no neighbours, so its pieces are encoded where it is read and nothing of it is shuffled.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_width, small_batches, trimmed

CHUNK = 16_384
OVERLAP = 512
LOOKAHEAD = 8  # characters behind a piece that can change where it ends, at most (contractions have three)
PIECES_KEPT = 120_000  # encoded pieces that a task remembers at most
LONGEST_KEPT = 64  # characters; longer pieces are not remembered
WIDTHS = {2: "H", 4: "I"}  # bytes of an id, as struct names them


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Encoder:
    """Pieces to packed ids. Remembers short pieces up to a fixed number."""

    _made: dict[tuple[str, str, int], "Encoder"] = {}

    @classmethod
    def of(cls, ranks_path: str, pattern: str, width: int = 4) -> "Encoder":
        """One for all tasks that a Python worker runs one after the other."""
        if (ranks_path, pattern, width) not in cls._made:
            cls._made = {(ranks_path, pattern, width): cls(read_ranks(ranks_path), pattern, width)}
        return cls._made[ranks_path, pattern, width]

    def __init__(self, ranks: dict[bytes, int], pattern: str, width: int = 4):
        if max(ranks.values()) >= (1 << 8 * width) - 2:  # the two highest are kept for marks
            raise ValueError(f"ranks do not fit into {width} bytes")
        self.width, self.code = width, WIDTHS[width]
        self.merge = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.seen: dict[str, bytes] = {}
        self.find = regex.compile(pattern).findall

    def packed(self, pieces: list[str]) -> list[bytes]:
        """The packed ids of each piece."""
        seen = self.seen
        try:
            return [seen[p] for p in pieces]
        except KeyError:
            pass
        if len(seen) > PIECES_KEPT:
            seen.clear()
        out = []
        for p in pieces:
            got = seen.get(p)
            if got is None:
                ids = self.merge(p)
                got = struct.pack(f"<{len(ids)}{self.code}", *ids)
                if len(p) <= LONGEST_KEPT:
                    seen[p] = got
            out.append(got)
        return out

    def pieces(self, text: str) -> tuple[list[bytes], np.ndarray]:
        """Packed ids of the pieces of ``text``, and the boundaries before, between and behind them."""
        found = self.find(text)
        return self.packed(found), np.concatenate([[0], np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))])

    def whole(self, text: str) -> bytes:
        """A text in one pass of tiktoken, which finds the same pieces."""
        return np.array(self.merge(text), f"<u{self.width}").tobytes()


def _encode_rows(ranks_path: str, pattern: str, width: int, whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(ranks_path, pattern, width)
        encode = encoder.whole if whole else lambda text: b"".join(encoder.packed(encoder.find(text)))
        for batch in batches:
            ids = pa.array([encode(t or "") for t in batch.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["row", "ids"])

    return trimmed(run)


class Edges:
    """Boundaries near an end of a chunk: places in the text, and how many bytes of packed ids lie before each."""

    def __init__(self, places: np.ndarray, offsets: np.ndarray):
        self.places, self.offsets = places, offsets

    def told(self) -> list[int]:
        return [*self.places.tolist(), *self.offsets.tolist()]

    @classmethod
    def read(cls, told: list[int]) -> "Edges":
        half = np.array(told, np.int64).reshape(2, -1)
        return cls(half[0], half[1])


def _edges(base: int, packed: list[bytes], cut: np.ndarray, chunk: int, overlap: int) -> tuple[Edges, Edges]:
    """A chunk's boundaries in the overlap with the chunk before, and those from the last one that lies before its successor on.

    Places within ``LOOKAHEAD`` of the end are none, as what is behind the end may change the pieces there.
    """
    offsets = np.concatenate([[0], np.cumsum(np.fromiter(map(len, packed), np.int64, len(packed)))])
    head = cut < overlap
    first = int(np.searchsorted(cut, chunk, side="right")) - 1
    stop = max(1, int(np.searchsorted(cut, cut[-1] - LOOKAHEAD, side="right")))
    tail = slice(min(first, stop - 1), stop)
    return Edges(base + cut[head], offsets[head]), Edges(base + cut[tail], offsets[tail])


def _encode_chunks(ranks_path: str, pattern: str, chunk: int, overlap: int, width: int):
    """Chunk rows to their own packed ids and edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(ranks_path, pattern, width)
        for batch in batches:
            ids, heads, tails = [], [], []
            for k, text in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
                packed, cut = encoder.pieces(text)
                head, tail = _edges(k * chunk, packed, cut, chunk, overlap)
                ids.append(b"".join(packed))
                heads.append(head.told())
                tails.append(tail.told())
            found = [pa.array(ids, pa.binary()), *[pa.array(x, pa.list_(pa.int64())) for x in (heads, tails)]]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(3)), *found], names=["row", "chunk", "is_last", "ids", "head", "tail"])

    return trimmed(run)


class Stitcher:
    """The chunks of one text after another: the ids that each owns, up to the place where the next one joins it."""

    def __init__(self, encoder: Encoder, known: list[bytes], chunk: int, overlap: int):
        self.encoder, self.known, self.chunk, self.overlap = encoder, known, chunk, overlap
        self.done: list[bytes] = []
        self.ids, self.tail, self.start, self.end = b"", None, 0, 0

    def text(self, ids: bytes) -> str:
        return b"".join([self.known[i] for i in np.frombuffer(ids, f"<u{self.encoder.width}").tolist()]).decode()

    def add(self, k: int, ids: bytes, head: Edges, tail: Edges) -> None:
        base, start = k * self.chunk, 0
        if self.tail is None:
            self.done = []
        else:
            _, mine, its = np.intersect1d(self.tail.places, head.places, return_indices=True)
            if len(mine):
                self.done.append(self.ids[self.start : self.tail.offsets[mine[0]]])
                start = int(head.offsets[its[0]])
            else:
                # the text from the last safe place on, through this chunk, is cut into pieces again
                safe, at = int(self.tail.places[-1]), max(self.start, int(self.tail.offsets[-1]))
                self.done.append(self.ids[self.start : at])
                before = self.text(self.ids[at:])
                packed, cut = self.encoder.pieces(before + self.text(ids)[safe + len(before) - base :])
                head, tail = _edges(safe, packed, cut, base + self.chunk - safe, 0)
                ids = b"".join(packed)
        self.ids, self.tail, self.start = ids, tail, start

    def finish(self) -> bytes:
        self.done.append(self.ids[self.start :])
        self.tail = None
        return b"".join(self.done)


def _stitch_chunks(ranks_path: str, pattern: str, chunk: int, overlap: int, width: int):
    """The encoded chunks of texts in order to whole packed ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stitcher = Stitcher(Encoder.of(ranks_path, pattern, width), known_bytes(ranks_path), chunk, overlap)
        for batch in batches:
            rows, out = [], []
            for j, (k, last, ids, head, tail) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(1, 6)), strict=True)):
                stitcher.add(k, ids, Edges.read(head), Edges.read(tail))
                if last:
                    rows.append(j)
                    out.append(stitcher.finish())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(out, pa.binary())], names=["row", "ids"])

    return trimmed(run)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.make_valid_utf8(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    return docs.select(F.struct(F.col(f"`{id_col}`").alias("id"), F.monotonically_increasing_id().alias("n")).alias("row"), text.alias("text"))


def _told(rows: DataFrame, id_col: str, width: int) -> DataFrame:
    return rows.select(F.col("row.id").alias(id_col), (F.octet_length("ids") / width).cast("long").alias("n_tokens"), "ids")


def encode(
    docs: DataFrame,
    ranks_path: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
    width: int = 4,
) -> DataFrame:
    """Token ids of every text: ``id_col``, ``n_tokens`` long, ``ids`` binary (little-endian unsigned, ``width`` bytes each: 2 or 4).

    A null text is empty; an empty one has no ids; invalid UTF-8 is read as U+FFFD. Rows that repeat an id keep one result each; an
    empty table gives an empty result; other columns are ignored. ``ranks_path`` must be readable on
    the executors. Special tokens are not known: their strings are ordinary text.
    """
    spark, rows = small_batches(docs.sparkSession), _rows(docs, id_col, text_col)
    size = F.length("text")
    shape = rows.schema["row"].dataType.simpleString()
    short = rows.where(size <= chunk).mapInArrow(_encode_rows(ranks_path, pattern, width, False), f"row {shape}, ids binary")
    last = F.floor((size - 1) / chunk).cast("int")
    numbered = rows.where(size > chunk).select("row", "text", last.alias("last"), F.explode(F.sequence(F.lit(0), last)).alias("chunk"))
    part = F.substring(F.col("text"), F.col("chunk") * chunk + 1, F.lit(chunk + overlap))
    cut = numbered.select("row", "chunk", (F.col("chunk") == F.col("last")).alias("is_last"), part.alias("text")).repartition(shuffle_width(spark), "row", "chunk")
    encoded = cut.mapInArrow(_encode_chunks(ranks_path, pattern, chunk, overlap, width), f"row {shape}, chunk int, is_last boolean, ids binary, head array<long>, tail array<long>")
    ordered = encoded.repartition(shuffle_width(spark), "row").sortWithinPartitions("row", "chunk")
    whole = ordered.mapInArrow(_stitch_chunks(ranks_path, pattern, chunk, overlap, width), f"row {shape}, ids binary")
    return _told(short.unionByName(whole), id_col, width)


def encode_whole(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """What ``encode`` returns, with every text in one piece in the task that reads it: for texts that are written on at once and need no splitting."""
    small_batches(docs.sparkSession)
    rows = _rows(docs, id_col, text_col)
    return _told(rows.mapInArrow(_encode_rows(ranks_path, pattern, width, True), f"row {rows.schema['row'].dataType.simpleString()}, ids binary"), id_col, width)


@lru_cache(maxsize=2)
def known_bytes(ranks_path: str) -> list[bytes]:
    """The bytes of every id."""
    ranks = read_ranks(ranks_path)
    known = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        known[rank] = token
    return known


def _decode_rows(ranks_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = known_bytes(ranks_path)
        for batch in batches:
            k = batch.schema.get_field_index("ids")
            texts = [None if x is None else b"".join([known[i] for i in np.frombuffer(x, "<u4").tolist()]) for x in batch.column(k).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], names=[*batch.schema.names, "decoded"])

    return trimmed(run)


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """Adds ``decoded`` binary, the bytes of all ``ids`` in order. Null ids give null, no ids give no bytes."""
    small_batches(encoded.sparkSession)
    rest = encoded.drop("decoded")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema)
    return rest.mapInArrow(_decode_rows(ranks_path), f"{schema}, decoded binary")
