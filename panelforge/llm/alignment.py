"""Alignment of two tokenizers' tokens by the bytes they cover, and links between their ids over a corpus.

A text is encoded by both. The cumulative ends of A's tokens are the keys of a dictionary to their indices, as are B's;
the ends in both key sets, sorted, cut the two id lists into groups that cover the same bytes. Every A token of a group is
linked with every B token of it.

Counting goes over blocks, not over links. A task gives each run of documents with about ``BLOCK`` distinct links a block
number and writes the documents' links packed (a link is one number, A's id times B's vocabulary plus B's id). A block's
distinct links, with the number of its documents that hold them, are summed over the corpus; the sums and each A id's highest
go back to the blocks that asked, where every document looks its links up. So a link that all documents
hold is one row a block, nothing is keyed by a document's text, and no table of links is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, free_name, small_batches, table
from .tokenfiles import byte_level, sentence_pieces

BLOCK = 1 << 19  # distinct links of documents after which a block ends
FLUSH = 1 << 21  # tokens of the rows that a task gathers before it hands them on
_COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def shared_ends(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cumulative ends of two token lists to the places where both have an end: how many tokens of each lie before them."""
    index_a, index_b = (dict(zip(ends.tolist(), range(1, len(ends) + 1), strict=True)) for ends in (a, b))
    both = sorted(index_a.keys() & index_b.keys())
    return tuple(np.fromiter(map(index.__getitem__, both), np.int64, len(both)) for index in (index_a, index_b))


def linked(a: np.ndarray, b: np.ndarray, cuts_a: np.ndarray, cuts_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The occurrence pairs of all groups: A's ids and B's. Groups are the slices that end at ``cuts_a`` and ``cuts_b``."""
    per_a, per_b = np.diff(cuts_a, prepend=0), np.diff(cuts_b, prepend=0)
    width = np.repeat(per_b, per_a)  # for each A token, how many B tokens it meets
    first = np.repeat(cuts_b - per_b, per_a)
    step = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
    return np.repeat(a, width), b[np.repeat(first, width) + step]


class GroupText:
    """Writes groups as ``a1,a2|b1;a3|b2,b3``: each id has two spellings, with the mark inside a list and the one behind it."""

    def __init__(self, size_a: int, size_b: int):
        self.size_a, self.size_b = size_a, size_b
        self.words = [f"{i}{mark}" for size, marks in ((size_a, ",|"), (size_b, ",;")) for mark in marks for i in range(size)]

    def __call__(self, a: np.ndarray, b: np.ndarray, cuts_a: np.ndarray, cuts_b: np.ndarray) -> str:
        if not len(a):
            return ""
        per_a, per_b = np.diff(cuts_a, prepend=0), np.diff(cuts_b, prepend=0)
        place_a = np.arange(len(a)) + np.repeat(cuts_b - per_b, per_a)
        place_b = np.arange(len(b)) + np.repeat(cuts_a, per_b)
        word_a, word_b = a.astype(np.int64), b + 2 * self.size_a
        word_a[cuts_a - 1] += self.size_a
        word_b[cuts_b - 1] += self.size_b
        order = np.empty(len(a) + len(b), np.int64)
        order[place_a], order[place_b] = word_a, word_b
        return "".join(map(self.words.__getitem__, order.tolist()))[:-1]


def _align(path_a: str, pattern: str, path_b: str, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = byte_level(path_a, pattern, False), sentence_pieces(path_b)
        bytes_a, bytes_b, length_a, length_b = one.pieces, two.pieces, one.lengths(), two.lengths()
        write = GroupText(one.size, two.size)
        kind = np.dtype("<u4" if one.size * two.size <= 1 << 32 else "<u8")
        number, room, rows, held, kind_of_id = None, 0, [], 0, None

        def batch_of() -> pa.RecordBatch:
            doc, block_, *counts, groups, links, times = zip(*rows, strict=True)
            longs = [pa.array(x, pa.int64()) for x in (block_, *counts)]
            return pa.RecordBatch.from_arrays(
                [pa.array(doc, kind_of_id), *longs, pa.array(groups, pa.string()), pa.array(links, pa.binary()), pa.array(times, pa.binary())],
                names=["doc", "block", *_COUNTS, "groups", "links", "times"],
            )

        for batch in batches:
            kind_of_id = batch.column(1).type
            for n, doc, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                whole = b"" if not text else b" " + text.encode()
                a, b = one.encode(" " + text) if text else (), two.encode(text) if text else ()
                if b"".join(map(bytes_a.__getitem__, a)) != whole or b"".join(map(bytes_b.__getitem__, b)) != whole:
                    a, b = (), ()
                a, b = np.array(a, np.int64), np.array(b, np.int64)
                cuts_a, cuts_b = shared_ends(np.cumsum(length_a[a]), np.cumsum(length_b[b]))
                of_a, of_b = linked(a, b, cuts_a, cuts_b)
                links, times = np.unique(of_a * two.size + of_b, return_counts=True)
                if room <= 0:
                    number, room = n, block
                room -= max(1, len(links))
                rows.append((doc, number, len(a), len(b), len(cuts_a), len(of_a), write(a, b, cuts_a, cuts_b), links.astype(kind).tobytes(), times.astype("<u4").tobytes()))
                held += len(a) + len(b)
                if held >= FLUSH:
                    yield batch_of()
                    rows, held = [], 0
            if rows:
                yield batch_of()
                rows, held = [], 0

    return run


def align(docs: DataFrame, path_a: str, pattern: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """Each row's alignment: ``id_col``, block, n_a, n_b, n_groups, n_links (long), groups (text), links and times (binary).

    ``path_a`` is a byte-level file of ``tokenizers``, which encodes a space and the text; ``path_b`` a sentencepiece file, which puts
    that space before the text itself. Special tokens' strings are ordinary text. Null and empty texts, and texts whose tokens of
    either kind do not spell the space and the text (a normalising vocabulary), have no tokens and empty groups. Invalid UTF-8 is read as
    U+FFFD. Texts are aligned whole. Rows without an id and rows that repeat one stay rows of their own; an empty table gives an empty
    result; other columns are ignored. ``links`` are the distinct links (little-endian, 4 bytes each where both
    vocabularies allow it, else 8), ``times`` their occurrences (4 bytes each).
    """
    small_batches(docs.sparkSession)
    text = F.make_valid_utf8(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    rows = docs.select(F.monotonically_increasing_id().alias("n"), F.col(f"`{id_col}`").alias("doc"), text.alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc {kind}, block long, {', '.join(f'{c} long' for c in _COUNTS)}, groups string, links binary, times binary"
    return rows.mapInArrow(_align(path_a, pattern, path_b, block), schema).withColumnRenamed("doc", id_col)


def _block_links(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def batch_of() -> pa.RecordBatch:
            links, docs = np.unique(np.concatenate([np.frombuffer(x, f"<u{width}") for x in held]), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(links), now)), pa.array(links.astype(np.int64)), pa.array(docs.astype(np.int64))], names=["block", "link", "docs"])

        for batch in batches:
            for block, links in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if block != now and held:
                    yield batch_of()
                    held = []
                now = block
                held.append(links)
        if held:
            yield batch_of()

    return run


def _look_up(width: int, names: list[str]):
    def run(docs: pa.Table, sums: pa.Table) -> pa.Table:
        order = np.argsort(known := sums.column("link").to_numpy())
        known, total, best = known[order], sums.column("total").to_numpy()[order], sums.column("best").to_numpy()[order]
        n_best, count_sum = [], []
        for links, times in zip(docs.column("links").to_pylist(), docs.column("times").to_pylist(), strict=True):
            times = np.frombuffer(times, "<u4").astype(np.int64)
            at = np.searchsorted(known, np.frombuffer(links, f"<u{width}").astype(np.int64))
            n_best.append(int(times[total[at] == best[at]].sum()))
            count_sum.append(int((times * total[at]).sum()))
        kept = docs.select(names)
        return kept.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(count_sum, pa.int64()))

    return run


def score_links(aligned: DataFrame, size_a: int, size_b: int) -> DataFrame:
    """``aligned`` without block, links and times, with ``n_best`` and ``count_sum`` (long).

    A link's count is how many documents of the whole table hold it. ``count_sum`` adds the counts over a document's link
    occurrences; ``n_best`` are those whose count is the highest of their A id's links, ties included. ``size_a`` and ``size_b``
    are the sizes of the vocabularies. ``aligned`` is written in the shared folder once, without ``groups`` unless it still has them.
    """
    width = 4 if size_a * size_b <= 1 << 32 else 8
    held, held_path = table(aligned, "aligned")
    found = held.select("block", "links").mapInArrow(_block_links(width), "block long, link long, docs long")
    asked, asked_path = table(found, "block-links")
    sums = asked.groupBy("link").agg(F.sum("docs").alias("total")).withColumn("a", F.floor(F.col("link") / size_b))
    highest = sums.groupBy("a").agg(F.max("total").alias("best"))
    scored = sums.join(highest.hint("merge"), "a").select("link", "total", "best")
    told = asked.select("block", "link").join(scored.hint("merge"), "link")
    names = [c for c in aligned.columns if c not in ("block", "links", "times")]
    added = [free_name(c, names) for c in ("n_best", "count_sum")]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.select(*names).schema)
    both = held.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_look_up(width, names), f"{fields}, n_best long, count_sum long")
    out, _ = table(both.toDF(*names, *added), "link-scores")
    forget(aligned.sparkSession, [held_path, asked_path])
    return out
