"""Training-order materialisation: token ids as fixed-stride shards in a keyed random order.

Takes any table of binary ids of fixed width, such as that of ``bpe.encode``; the two highest ids of
the width mark the end of a text and padding. Without ids, a text's UTF-8 bytes are taken (which
never have the two highest values). Each partition of the scan concatenates its texts and cuts
sequences of fixed length. Sequences have dense numbers: the partition's offset, from a first pass that sums lengths
only, plus a running count. A keyed Feistel network with cycle-walking permutes 0..N-1, so every
number gets a slot of its own without a sort of random numbers. Slots are dealt by range (compressed on the
way), aligned to shards, and sorted; each shard is one file of records of equal length, so slot s is the record
``s % per_shard`` of file ``s // per_shard`` and reading can resume anywhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shuffle_width, small_batches

HEADER = np.dtype([("doc_id", "<i8"), ("start", "<i8"), ("n_tokens", "<u4"), ("n_docs", "<u4")])
LENGTH, PER_SHARD = 2048, 4096


class Feistel:
    """A keyed permutation of 0..n-1: four rounds on the smallest even number of bits, walking on until below n."""

    def __init__(self, n: int, key: int, rounds: int = 4):
        self.n = n
        self.half = np.uint64(max(1, ((max(1, n - 1)).bit_length() + 1) // 2))
        self.mask = np.uint64((1 << int(self.half)) - 1)
        self.keys = np.random.default_rng(key).integers(0, 2**63, rounds, dtype=np.uint64)

    def _mix(self, x: np.ndarray, key: np.uint64) -> np.ndarray:
        x = (x + key) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        return (x ^ (x >> np.uint64(29))) & self.mask

    def _once(self, x: np.ndarray) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for key in self.keys:
            left, right = right, left ^ self._mix(right, key)
        return (left << self.half) | right

    def __call__(self, numbers: np.ndarray) -> np.ndarray:
        x = self._once(np.asarray(numbers, dtype=np.uint64))
        while (out := x >= np.uint64(self.n)).any():
            x[out] = self._once(x[out])
        return x.astype(np.int64)


@dataclass(frozen=True)
class Layout:
    path: str
    sequences: int
    length: int
    per_shard: int
    width: int = 1  # bytes of an id

    @property
    def stride(self) -> int:
        return HEADER.itemsize + self.length * self.width + 1  # the writer ends a record with a newline


def _cut(offsets: dict[int, int], counts: dict[int, int], total: int, key: int, length: int, width: int):
    size = length * width
    end_mark, pad = ((1 << 8 * width) - 1).to_bytes(width, "little"), ((1 << 8 * width) - 2).to_bytes(width, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, pack = Feistel(total, key), zstandard.ZstdCompressor(level=6).compress
        held, starts, number, mine = bytearray(), [], None, None  # starts: (place in held, doc_id, place in the document), places in bytes

        def record(n: int) -> bytes:
            inside = [s for s in starts if s[0] < n]
            first = inside[0]
            head = np.array([(first[1], first[2] // width, n // width, len(inside))], HEADER).tobytes()
            body = bytes(held[:n])
            # what goes on behind the cut
            at, doc, place = inside[-1]
            starts[: len(inside)] = [] if any(s[0] == n for s in starts) or n >= len(held) else [(n, doc, place + n - at)]
            starts[:] = [(p - n, d, q) for p, d, q in starts]
            del held[:n]
            return head + body + pad * ((size - n) // width)

        def batch_of(rows: list[bytes]) -> pa.RecordBatch:
            nonlocal number
            slots = order(np.arange(number, number + len(rows)))
            number += len(rows)
            return pa.RecordBatch.from_arrays([pa.array(slots, pa.int64()), pa.array([pack(r) for r in rows], pa.binary())], names=["slot", "record"])

        for batch in batches:
            rows = []
            for part, doc, ids in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if number is None:
                    number, mine = offsets.get(part), part
                if number is None or part != mine:
                    raise ValueError(f"partition {part} is not as the first pass read it")
                starts.append((len(held), -1 if doc is None else doc, 0))
                held += (ids or b"") + end_mark
                while len(held) >= size:
                    rows.append(record(size))
            if rows:
                yield batch_of(rows)
        if held:
            yield batch_of([record(len(held))])
        if number is not None and number != offsets[mine] + counts[mine]:  # other sequences than were numbered: slots would overlap or be missing
            raise ValueError(f"partition {mine} gave {number - offsets[mine]} sequences, and {counts[mine]} when the first pass read it")

    return run


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        yield batch.set_column(2, "record", pa.array([unpack(r) for r in batch.column(2).to_pylist()], pa.binary()))


def materialise(
    docs: DataFrame,
    path: str,
    key: int = 2024,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    per_shard: int = PER_SHARD,
    width: int = 1,
) -> Layout:
    """Write the ids of all rows of ``docs`` as shards below ``path``, in the order that ``key`` gives.

    ``text_col`` holds packed ids of ``width`` bytes (little-endian), or texts, whose bytes are ids of width 1.
    ``docs`` has to be read from storage: its partitions must be the same in both passes. One that gives another number of
    sequences than the first pass counted stops the job, rather than leave slots doubled or empty. A null or
    empty text is just its end mark; a null id is stored as -1; repeated rows are all written; an
    empty table has no shards; other columns are ignored. The ids of a text stay in order inside a
    sequence, and its header tells the first document, where in it the sequence starts, how many ids
    are no padding and how many documents it touches.
    """
    spark = small_batches(docs.sparkSession)
    ids = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    scan = docs.select(F.shiftright(F.monotonically_increasing_id(), 33).cast("long").alias("part"), F.col(id_col).cast("long").alias("doc"), ids.alias("ids"))
    sums = scan.groupBy("part").agg(F.sum((F.length("ids") / width).cast("long") + 1).alias("n")).orderBy("part").collect()  # one row for each partition
    counts = [-(-r["n"] // length) for r in sums]
    parts_read = [r["part"] for r in sums]
    offsets = dict(zip(parts_read, np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(int).tolist() if counts else [], strict=True))
    layout = Layout(path, sum(counts), length, per_shard, width)
    shards = max(1, -(-layout.sequences // per_shard))
    parts = min(shuffle_width(spark), shards)
    made = scan.mapInArrow(_cut(offsets, dict(zip(parts_read, counts, strict=True)), layout.sequences, key, length, width), "slot long, record binary") if counts else spark.createDataFrame([], "slot long, record binary")
    placed = made.withColumn("shard", F.floor(F.col("slot") / per_shard).cast("int"))
    dealt = placed.repartitionById(parts, F.floor(F.col("shard").cast("long") * parts / shards).cast("int"))
    ordered = dealt.select("shard", "slot", "record").mapInArrow(_unpacked, "shard int, slot long, record binary").sortWithinPartitions("shard", "slot")
    ordered.select("shard", F.col("record").cast("string").alias("value")).write.partitionBy("shard").option("lineSep", "\n").text(path)
    return layout


def _read(stride: int, per_shard: int, first: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = np.frombuffer(content.as_buffer(), np.uint8).reshape(-1, stride)
                skip = max(0, first - shard * per_shard)
                for lo in range(skip, len(raw), 512):
                    part = raw[lo : lo + 512]
                    head = np.ascontiguousarray(part[:, : HEADER.itemsize]).view(HEADER).ravel()
                    body = np.ascontiguousarray(part[:, HEADER.itemsize : -1])
                    ids = [row[: n * width].tobytes() for row, n in zip(body, head["n_tokens"].tolist(), strict=True)]
                    slots = shard * per_shard + np.arange(lo, lo + len(part))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(slots, pa.int64()),
                            pa.array(np.full(len(part), shard), pa.int32()),
                            pa.array(head["doc_id"].astype(np.int64)),
                            pa.array(head["start"].astype(np.int64)),
                            pa.array(head["n_docs"].astype(np.int64)),
                            pa.array(head["n_tokens"].astype(np.int64)),
                            pa.array(ids, pa.binary()),
                        ],
                        names=["slot", "shard", "doc_id", "start", "n_docs", "n_tokens", "ids"],
                    )

    return run


def read_shards(spark: SparkSession, layout: Layout, first: int = 0) -> DataFrame:
    """Sequences from slot ``first`` on: slot, shard, first document, where in it, documents, ids that are no padding.

    Shards before the one of ``first`` are not read.
    """
    schema = "slot long, shard int, doc_id long, start long, n_docs long, n_tokens long, ids binary"
    if not layout.sequences:
        return spark.createDataFrame([], schema)
    files = spark.read.format("binaryFile").load(layout.path).where(F.col("shard") >= first // layout.per_shard)
    return files.select(F.col("shard").cast("int"), "content").mapInArrow(_read(layout.stride, layout.per_shard, first, layout.width), schema)
