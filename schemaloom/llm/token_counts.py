"""Counts the tokens of texts under a unigram model, with one trie for all pre-tokens of a task."""

from __future__ import annotations

import gc
import math
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from schemaloom.llm.common import free_name, with_fields

#: sentencepiece writes a space so; pre-tokens start with it.
MARK = "▁"
#: Pre-tokens whose counts, and trie nodes that a task keeps; when full, they start anew.
KEPT = 600_000
NODES = 300_000


class Unigram:
    """Log probabilities of a vocabulary's pieces.

    The public vocabulary orders its pieces by rank; Zipf's law gives piece number r the weight 1 / r. A
    character without a piece becomes its UTF-8 bytes' pieces.
    """

    def __init__(self, pieces: list[str], byte_piece: float | None = None):
        total = math.log(sum(1 / (r + 1) for r in range(len(pieces))))
        self.scores = {p: -math.log(r + 1) - total for r, p in enumerate(pieces)}
        #: The pieces as a trie of (children, score or None).
        self.root: list = [{}, None]
        for piece, score in self.scores.items():
            place = self.root
            for c in piece:
                place = place[0].setdefault(c, [{}, None])
            place[1] = score
        #: Bytes are the last resort: each costs more than any piece.
        self.byte = -math.log(len(pieces) + 1) - total - 10.0 if byte_piece is None else byte_piece

    @classmethod
    def from_file(cls, path: str) -> Unigram:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        return cls([model.id_to_piece(i) for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))])


class Trie:
    """Pre-tokens in a trie; each node holds the forward score and the token count of its prefix once.

    The forward score of a prefix is the best, over its last piece, of the score of what is before plus
    the piece's. A node also holds the pieces that are begun but not ended there (score and count where
    they began, place in the vocabulary's trie), so that a child costs one step per such piece. A node is
    [children, score, count, begun].
    """

    def __init__(self, model: Unigram):
        self.model = model
        self.root: list = [{}, 0.0, 0, ()]
        self.nodes = 1
        self.terminal: dict[str, int] = {}

    def add(self, word: str) -> int:
        """Insert a pre-token (behind the word mark); its number of tokens is stored as the terminal count."""
        if self.nodes >= NODES:
            self.root, self.nodes = [{}, 0.0, 0, ()], 1
        if len(self.terminal) >= KEPT:
            self.terminal.clear()
        node = self.root
        for c in MARK + word:
            below = node[0]
            if below is None:
                below = node[0] = {}
            child = below.get(c)
            node = self._grow(node, c) if child is None else child
        n = self.terminal[word] = node[2]
        return n

    def _grow(self, parent: list, c: str) -> list:
        n_bytes = 1 if c < "\x80" else len(c.encode("utf-8", "surrogatepass"))
        best, count = parent[1] + n_bytes * self.model.byte, parent[2] + n_bytes
        begun = []
        for score, n, place in (*parent[3], (parent[1], parent[2], self.model.root)):
            place = place[0].get(c)
            if place is not None:
                if place[1] is not None:
                    total = score + place[1]
                    if total > best or total == best and n + 1 < count:
                        best, count = total, n + 1
                if place[0]:
                    begun.append((score, n, place))
        node = parent[0][c] = [None, best, count, tuple(begun)]
        self.nodes += 1
        return node


@lru_cache(maxsize=2)
def worker_trie(vocabulary: str) -> Trie:
    """One trie per worker and vocabulary, which the worker's tasks share; its size is bounded."""
    return Trie(Unigram.from_file(vocabulary))


def count_tokens(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``docs`` with n_words and n_tokens of ``text`` (underscores in front if the names are taken).

    Pre-tokens are the runs between white space, each with a leading word mark. Each task counts its own
    distinct pre-tokens and sums over its rows: nothing is shuffled, a lost task only reads its part
    again, and memory is bounded by emptying the trie. A null or empty text has 0 words and 0 tokens.
    """
    words, tokens = free_name(docs, "n_words"), free_name(docs, "n_tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = worker_trie(vocabulary)
        gc.disable()  # a trie has no cycles, and its many nodes make each collection long
        try:
            for batch in batches:
                n_words, n_tokens = [], []
                for text in batch["text"]:
                    found = (text.as_py() or "").split()
                    known = trie.terminal.get
                    total = 0
                    for w in found:
                        n = known(w)
                        total += trie.add(w) if n is None else n
                    n_words.append(len(found))
                    n_tokens.append(total)
                yield pa.record_batch(
                    [*batch.columns, pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())],
                    [*batch.schema.names, words, tokens],
                )
        finally:
            gc.enable()

    return docs.mapInArrow(run, with_fields(docs.schema, **{words: "long", tokens: "long"}))
