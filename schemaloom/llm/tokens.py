"""Byte-level BPE of a public vocabulary file."""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np
import tiktoken

#: Fixed value: the pattern of byte-level BPE vocabularies that splits a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Runs of so much white space are left to ``tokenizers``, as the other encoder's pattern would run out of stack.
RUN = 10_000


class ByteBpe:
    """Encodes like ``Tokenizer.from_file(path).encode(text, add_special_tokens=False)``.

    A text is encoded by ranks in one call, which is faster than a look-up per word where most words are
    rare. Texts with longer runs of white space around a space, or with a special token written out, are
    left to ``tokenizers``.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            described = json.load(f)
        self.vocabulary: dict[str, int] = described["model"]["vocab"]
        self.special = [t["content"] for t in described.get("added_tokens", [])]
        self.runs = re.compile(r" (?:\s|\Z)")
        self.long_runs = re.compile(rf"\s{{{RUN}}}")
        self.by_ranks = self._by_ranks().encode_ordinary

    def _by_ranks(self) -> tiktoken.Encoding:
        """The same vocabulary by ranks: ids are the ranks of the merges."""
        printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
        character = {b: chr(b) for b in printed}
        character |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in character)}
        byte = {c: b for b, c in character.items()}
        ranks = {bytes(byte[c] for c in p): i for p, i in self.vocabulary.items() if p not in self.special}
        return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.empty(0, np.uint32)
        long_run = len(text) >= RUN and self.long_runs.search(text)
        if long_run or self.runs.search(text) or any(token in text for token in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self.by_ranks(text), np.uint32)

    def ends_with(self, characters: str, *more: int) -> np.ndarray:
        """By id: whether the piece ends with one of the ASCII characters; also true for the ids ``more``."""
        written = {c: chr(256 + ord(c)) if c == "\n" else c for c in characters}  # as byte-level BPE writes them
        table = np.zeros(max([*self.vocabulary.values(), *more]) + 1, bool)
        for piece, i in self.vocabulary.items():
            table[i] = piece.endswith(tuple(written.values()))
        table[list(more)] = True
        return table


@lru_cache(maxsize=2)
def byte_bpe(path: str) -> ByteBpe:
    """One encoder per worker and vocabulary."""
    return ByteBpe(path)
