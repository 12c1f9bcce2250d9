"""Vocabulary files of byte-level and sentencepiece tokenizers, read once in each Python worker.

The merges of a byte-level file are given to tiktoken as ranks, which yields the ids that ``tokenizers`` makes of the
file, several times faster. Files must be readable on the executors.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import sentencepiece
import tiktoken


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: visible Latin-1 stands for itself, the others follow from U+0100."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}


@dataclass(frozen=True)
class Vocabulary:
    """``encode`` turns a text into ids; ``pieces`` are the bytes of every id (no bytes for ids that stand for no text)."""

    encode: object
    pieces: list[bytes]

    @property
    def size(self) -> int:
        return len(self.pieces)

    def lengths(self) -> np.ndarray:
        return np.array([len(p) for p in self.pieces], np.int64)


@lru_cache(maxsize=2)
def byte_level(path: str, pattern: str, special: bool) -> Vocabulary:
    """A byte-level BPE file of ``tokenizers``; ``encode`` gives a uint32 array. With ``special`` the strings of special
    tokens inside texts become their ids, without it they are ordinary text."""
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    split = told.get("pre_tokenizer") or {}
    if told["model"]["type"] != "BPE" or told.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        raise ValueError(f"{path} is no plain byte-level BPE tokenizer")
    added = {t["content"]: t["id"] for t in told["added_tokens"]}
    letters = byte_letters()
    ranks = {bytes(letters[c] for c in token): i for token, i in told["model"]["vocab"].items() if token not in added}
    merge = tiktoken.Encoding("merges", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added).encode_to_numpy
    allowed = set(added) if special else set()
    pieces = [b""] * (max([*ranks.values(), *added.values()]) + 1)
    for token, i in ranks.items():
        pieces[i] = token
    for token, i in added.items():
        pieces[i] = token.encode()
    return Vocabulary(lambda text: merge(text, allowed_special=allowed, disallowed_special=()), pieces)


@lru_cache(maxsize=2)
def sentence_pieces(path: str) -> Vocabulary:
    """A sentencepiece file; ``encode`` gives a list of ids. U+2581 stands for a space and <0xHH> for a byte."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = []
    for i in range(model.get_piece_size()):
        text = model.id_to_piece(i)
        if model.is_byte(i):
            pieces.append(bytes([int(text[3:-1], 16)]))
        elif model.is_control(i) or model.is_unknown(i):
            pieces.append(b"")
        else:
            pieces.append(text.replace("▁", " ").encode())
    return Vocabulary(model.encode, pieces)
