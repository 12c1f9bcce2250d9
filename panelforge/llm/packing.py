"""Harmonic packing: documents into training sequences of a fixed number of tokens.

A document (its ids and an end mark) is first cut into full sequences. What remains, shorter than the capacity C,
belongs to a reciprocal class: with a length in (C/(k+1), C/k] a bin of class k takes exactly k pieces, so a bin needs
no search for a place and its count alone tells when it is full. Lengths that would leave more than ``slack`` of
such a bin empty are cut: the longest length that does not is split off and the rest is classified again, which
takes one to three pieces as a rule, since the rest is much shorter each time.

Every task packs the documents that it reads on its own, in their order: no shuffle, and at most k - 1 pieces wait in
each class, less than one sequence of ids a class. When a task has read its last document, the pieces in bins that
have not reached their count are laid end to end in full sequences, and what is left of these is cut at powers of two,
which need no padding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .tokenfiles import byte_level

CAPACITY = 1024
SLACK = 1 / 64  # of a bin that may stay empty
FLUSH = 1 << 21  # ids that a task gathers before it hands on rows
SEQUENCES = 33  # bits for the number of a sequence within its task


def cuts(capacity: int, slack: float) -> np.ndarray:
    """By length up to ``capacity``: the longest length, not above it, whose bins are full but for ``slack``."""
    sizes = np.arange(capacity + 1)
    left = np.zeros(capacity + 1, np.int64)
    left[1:] = capacity % sizes[1:]
    return np.maximum.accumulate(np.where(left <= slack * capacity, sizes, 0))


class Packer:
    """One task's bins. ``rows`` gathers a row for each piece of finished sequences."""

    def __init__(self, capacity: int, slack: float, first: int):
        self.capacity, self.cuts = capacity, cuts(capacity, slack).tolist()
        self.number, self.bins, self.rows, self.held = first, {}, [], 0

    def add(self, doc, ids: np.ndarray) -> None:
        at, n = 0, len(ids)
        while at < n:
            size = self.cuts[min(n - at, self.capacity)]
            count = self.capacity // size
            bin_ = self.bins.setdefault(count, [])
            bin_.append((doc, at, ids[at : at + size].copy(), n))  # a copy, so that the document's ids are not kept
            if len(bin_) == count:
                self.close(self.bins.pop(count), count)
            at += size

    def close(self, pieces: list, count: int | None) -> None:
        offset = 0
        for doc, start, ids, n in pieces:
            self.rows.append((doc, start, len(ids), ids.tobytes(), n, self.number, offset, count))
            offset += len(ids)
        self.held += offset
        self.number += 1

    def finish(self) -> None:
        """The waiting pieces, those of large classes first, in full sequences, and the rest in powers of two."""
        waiting = [p for count in sorted(self.bins) for p in self.bins[count]]
        left = sum(len(p[2]) for p in waiting)
        self.bins, room, open_ = {}, 0, []
        for doc, start, ids, n in waiting:
            at = 0
            while at < len(ids):
                if not room:
                    room = self.capacity if left >= self.capacity else 1 << (left.bit_length() - 1)
                take = min(room, len(ids) - at)
                open_.append((doc, start + at, ids[at : at + take], n))
                at, room, left = at + take, room - take, left - take
                if not room:
                    self.close(open_, None)
                    open_ = []


_SCHEMA = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, bin_count int"


def _pack(path: str, pattern: str, special: bool, end_id: int, capacity: int, slack: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer, kind = byte_level(path, pattern, special).encode, None, None

        def batch_of() -> pa.RecordBatch:
            docs, start, length, ids, total, sequence, offset, count = zip(*packer.rows, strict=True)
            packer.rows, packer.held = [], 0
            longs = [pa.array(x, pa.int64()) for x in (start, length, total, sequence, offset)]
            return pa.RecordBatch.from_arrays(
                [pa.array(docs, kind), longs[0], longs[1], pa.array(ids, pa.binary()), *longs[2:], pa.array(count, pa.int32())],
                names=["doc", *(c.split()[0] for c in _SCHEMA.split(", "))],
            )

        for batch in batches:
            kind = batch.column(1).type
            for n, doc, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if packer is None:
                    packer = Packer(capacity, slack, (n >> SEQUENCES) << SEQUENCES)  # the task's number in the high bits, as in n
                packer.add(doc, np.append(encode(text), np.uint32(end_id)).astype("<u4", copy=False))
                if packer.held >= FLUSH:
                    yield batch_of()
        if packer:
            packer.finish()
            if packer.rows:
                yield batch_of()

    return run


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 0,
    capacity: int = CAPACITY,
    slack: float = SLACK,
    special: bool = True,
) -> DataFrame:
    """The pieces of all rows of ``docs`` and their places in sequences of at most ``capacity`` ids (a power of two).

    ``id_col``, start (ids of the document before the piece), length, ids (binary, little-endian unsigned 32-bit), doc_tokens
    (with the end mark ``end_id``), sequence_id, offset (in the sequence, without gaps from 0) and bin_count: the fixed number of
    pieces of the class's bins, null for sequences of pieces that were left over. Sequences shorter than ``capacity`` are to be
    padded, unless their length is a power of two.

    A null or empty text is its end mark only; invalid UTF-8 is read as U+FFFD; a text of any length is packed whole. Rows
    without an id and rows that repeat one are documents of their own, copies too. An empty table gives an empty result;
    other columns are ignored, whatever their names. Sequence numbers follow from the partitions in which ``docs`` is
    read; read from storage, a lost task gives the same pieces again. ``special``: whether the strings of special tokens
    inside texts become their ids, as they do in ``tokenizers`` unless told otherwise.
    """
    if capacity & (capacity - 1):
        raise ValueError("the capacity must be a power of two")
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.make_valid_utf8(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    rows = docs.select(F.monotonically_increasing_id().alias("n"), F.col(f"`{id_col}`").alias("doc"), text.alias("text"))
    packed = rows.mapInArrow(_pack(tokenizer_path, pattern, special, end_id, capacity, slack), f"doc {kind}, {_SCHEMA}")
    return packed.withColumnRenamed("doc", id_col)


def sequences(pieces: DataFrame, capacity: int = CAPACITY, pad_id: int = 0) -> DataFrame:
    """Whole sequences of ``pack``: sequence_id, n_tokens (without padding), n_pieces, ids (binary, padded with ``pad_id`` to
    ``capacity`` unless their length is a power of two). A sequence has at most ``capacity`` pieces."""
    found = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.count("*").alias("n_pieces"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    ids = F.aggregate("parts", F.lit(b""), lambda whole, part: F.concat(whole, part["ids"]))
    n = F.col("n_tokens")
    room = F.when(n.bitwiseAND(n - 1) == 0, F.lit(0)).otherwise(F.lit(capacity) - n)
    pad = F.unhex(F.repeat(F.lit(pad_id.to_bytes(4, "little").hex()), room.cast("int")))
    return found.select("sequence_id", "n_tokens", "n_pieces", F.concat(ids, pad).alias("ids"))
