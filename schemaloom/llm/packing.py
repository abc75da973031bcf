"""Packs token ids into sequences of a fixed length, in order, by dynamic programming over cuts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from schemaloom.llm.tokens import byte_bpe

LENGTH = 2048
END = 1
#: What a cut costs, in tokens of padding: at a document's end, a sentence's end, elsewhere.
CUT = (0, 8, 64)
#: Where no boundary comes for so many tokens, a cut is allowed after each such stretch.
STRETCH = 128
#: Tokens that are cut at once; the rest of a block goes on to the next.
BLOCK = 1 << 18

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def choose_cuts(at: np.ndarray, cost: np.ndarray, length: int = LENGTH) -> list[int]:
    """Cheapest cuts among the places ``at`` (ascending, from 0, no gap above ``length``).

    A window between cuts holds at most ``length`` tokens and costs its padding; a cut costs
    ``cost``. With g(j) = cost + padding + j, g(j) is cost(j) + length + the least g(i) with
    at[j] - at[i] <= length, which a monotone queue gives in constant time per place. The last cut is
    the cheapest place within the last ``length`` tokens.
    """
    places, costs = at.tolist(), cost.tolist()
    n = len(places)
    g, back = [0] * n, [0] * n
    queue, values, head = [0], [0], 0
    for j in range(1, n):
        p = places[j]
        while places[queue[head]] < p - length:
            head += 1
        back[j] = queue[head]
        value = g[j] = costs[j] + length + values[head]
        while len(queue) > head and values[-1] > value:
            queue.pop()
            values.pop()
        queue.append(j)
        values.append(value)
    end = places[-1]
    j = min((i for i in range(n) if places[i] > end - length), key=lambda i: (g[i] - places[i], -i))
    cuts = []
    while j:
        cuts.append(places[j])
        j = back[j]
    return cuts[::-1]


def cut_places(sentence_end: np.ndarray, doc_ends: np.ndarray, stretch: int = STRETCH) -> tuple[np.ndarray, np.ndarray]:
    """Places where a window may be cut and their costs, for a run of tokens."""
    total = len(sentence_end)
    kind = np.full(total + 1, -1, np.int8)
    kind[np.flatnonzero(sentence_end) + 1] = 1
    kind[doc_ends] = 0
    kind[0] = 0
    if kind[total] < 0:
        kind[total] = 2
    at = np.flatnonzero(kind >= 0)
    gaps = np.diff(at)
    wide = np.flatnonzero(gaps > stretch)
    if len(wide):
        more = np.concatenate([np.arange(at[i] + stretch, at[i + 1], stretch) for i in wide])
        kind[more] = 2
        at = np.flatnonzero(kind >= 0)
    return at, np.asarray(CUT)[kind[at]]


def powers(n: int) -> list[int]:
    """n as a sum of falling powers of two."""
    return [1 << i for i in range(n.bit_length() - 1, -1, -1) if n >> i & 1]


class Packer:
    """Cuts the stream of one partition; holds one block of tokens and one open sequence."""

    def __init__(self, sentence_end: np.ndarray, length: int, sequence: int):
        self.sentence_end, self.length, self.sequence = sentence_end, length, sequence
        self.docs: list[tuple] = []  # doc_id, ids, where ids start in the document, tokens of the document
        self.held = 0

    def add(self, doc_id, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(ids), BLOCK):
            part = ids[at : at + BLOCK]
            self.docs.append((doc_id, part, at, len(ids)))
            self.held += len(part)
            if self.held >= BLOCK:
                yield self.flush(False)

    def flush(self, last: bool) -> pa.RecordBatch:
        ids = np.concatenate([d[1] for d in self.docs])
        lengths = np.array([len(d[1]) for d in self.docs])
        ends = np.cumsum(lengths)
        starts = ends - lengths
        whole = np.array([d[2] + len(d[1]) == d[3] for d in self.docs])
        at, cost = cut_places(self.sentence_end[ids], ends[whole])
        cuts = [0, *choose_cuts(at, cost, self.length)]
        if last:
            cuts += (cuts[-1] + np.cumsum(powers(len(ids) - cuts[-1]))).tolist()
        cuts = np.array(cuts)
        stop = cuts[-1]
        edges = np.unique(np.concatenate([cuts, starts[starts < stop]]))
        begin, size = edges[:-1], np.diff(edges)
        doc = np.searchsorted(starts, begin, "right") - 1
        window = np.searchsorted(cuts, begin, "right") - 1
        first = np.array([d[2] for d in self.docs])
        offsets = ((edges - edges[0]) * 4).astype(np.int32)
        binary = pa.Array.from_buffers(
            pa.binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(ids[:stop].astype("<u4").tobytes())]
        )
        out = pa.record_batch(
            [
                pa.array([self.docs[i][0] for i in doc], pa.int64()),
                pa.array(begin - starts[doc] + first[doc], pa.int64()),
                pa.array(size, pa.int64()),
                binary,
                pa.array([self.docs[i][3] for i in doc], pa.int64()),
                pa.array(self.sequence + window, pa.int64()),
                pa.array(begin - cuts[window], pa.int64()),
            ],
            ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
        )
        self.sequence += len(cuts) - 1
        rest, done = [], int(stop)
        for (doc_id, part, at_doc, tokens), a, b in zip(self.docs, starts.tolist(), ends.tolist()):
            if b > done:
                skip = max(done - a, 0)
                rest.append((doc_id, part[skip:], at_doc + skip, tokens))
        self.docs, self.held = rest, len(ids) - done
        return out


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END) -> DataFrame:
    """Pieces of ``docs(doc_id, text)`` packed into sequences of at most ``length`` tokens.

    A document is its ids (little-endian unsigned 32-bit in ``ids``) and the id ``end``; a null text is
    an empty one, which is the id ``end`` alone. Each partition is packed in the order of its rows, so
    nothing is shuffled and a lost task packs the same rows again; sequence ids start with the number
    of the partition. Cuts fall at document or sentence ends, or after a long stretch without any.
    What a partition has left at its end goes into sequences whose lengths are powers of two, which
    need no padding. Repeated rows are packed as often as they come; null ids are kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(tokenizer)
        packer = Packer(bpe.ends_with(".!?\n", end), length, TaskContext.get().partitionId() << 40)
        closing = np.array([end], np.uint32)
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                yield from packer.add(doc_id, np.concatenate([bpe.encode(text.as_py() or ""), closing]))
        if packer.docs:
            yield packer.flush(True)

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)
