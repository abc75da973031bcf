"""External suffix sorting by induction, with common-prefix lengths.

``sorted_suffixes`` sorts the suffixes of one shard. Suffixes are queued by their first symbol in
monotone queues that keep order of arrival and move to disk beyond a bound; a queue entry carries the
suffix and its common-prefix length with the entry before it. Popping a suffix pushes the one that
starts a symbol earlier, so that each pass sorts one type of suffixes from the other. The substrings
between turning points are sorted as tuples; their names form a shorter text, which is sorted by the
same function.
"""

from __future__ import annotations

import os
import tempfile
from collections import defaultdict

import numpy as np

#: Bytes of queue entries, and of one array, that stay in memory.
IN_MEMORY = 256 << 20
#: Entries that one bucket of symbols should hold where the alphabet is large.
BUCKET = 1 << 12
MIDDLE = 1 << 31


class Scratch:
    """Arrays and queue files of one shard; large ones live in a folder that goes when it is closed."""

    def __init__(self, in_memory: int = IN_MEMORY):
        self.in_memory = in_memory
        self.folder = tempfile.TemporaryDirectory(prefix="induced-")
        self.files = 0

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.folder.cleanup()

    def path(self) -> str:
        self.files += 1
        return os.path.join(self.folder.name, str(self.files))

    def empty(self, n: int, dtype) -> np.ndarray:
        if n * np.dtype(dtype).itemsize <= self.in_memory:
            return np.empty(n, dtype)
        return np.memmap(self.path(), dtype, "w+", shape=(n,))


class Queue:
    """A monotone priority queue: entries by bucket of their key, in order of arrival within a bucket."""

    def __init__(self, scratch: Scratch):
        self.scratch = scratch
        self.parts: dict[int, list[np.ndarray]] = defaultdict(list)
        self.on_disk: dict[int, list[tuple[str, int]]] = defaultdict(list)
        self.held = 0

    def push(self, bucket: int, entries: np.ndarray) -> None:
        self.parts[bucket].append(entries)
        self.held += entries.nbytes
        if self.held > self.scratch.in_memory:
            self._spill()

    def _spill(self) -> None:
        path = self.scratch.path()
        with open(path, "wb") as f:
            for bucket, parts in self.parts.items():
                at = f.tell()
                for part in parts:
                    f.write(part.tobytes())
                self.on_disk[bucket].append((path, at, f.tell() - at))
        self.parts.clear()
        self.held = 0

    def pop(self, bucket: int) -> np.ndarray:
        """All entries of a bucket as rows (suffix, common prefix with the entry before)."""
        found = []
        for path, at, size in self.on_disk.pop(bucket, ()):
            found.append(np.fromfile(path, np.int64, size // 8, offset=at).reshape(-1, 2))
        for part in self.parts.pop(bucket, ()):
            found.append(part)
            self.held -= part.nbytes
        return np.concatenate(found) if found else np.empty((0, 2), np.int64)


def symbol_types(text: np.ndarray, scratch: Scratch) -> tuple[np.ndarray, np.ndarray]:
    """(falling, turning): suffixes larger than the next one, and the left-most rising ones."""
    n = len(text)
    falling = scratch.empty(n, bool)
    change = np.flatnonzero(text[1:] != text[:-1])
    ends = np.append(change, n - 1)
    down = np.append(text[change] > text[change + 1], False)
    starts = np.append(0, change + 1)
    falling[:] = np.repeat(down, ends - starts + 1)
    turning = np.flatnonzero(~falling[1:] & falling[:-1]) + 1
    return falling, turning


def run_lengths(text: np.ndarray, scratch: Scratch) -> np.ndarray:
    """How often a suffix's first symbol repeats at its start."""
    n = len(text)
    ends = np.append(np.flatnonzero(text[1:] != text[:-1]), n - 1)
    starts = np.append(0, ends[:-1] + 1)
    runs = scratch.empty(n, np.int32)
    runs[:] = np.repeat(ends + 1, ends - starts + 1) - np.arange(n)
    return runs


def least_between(prefixes: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """For each chosen entry but the first, the least common prefix since the chosen one before."""
    bounds = chosen[:-1] + 1
    return np.minimum.reduceat(prefixes[: chosen[-1] + 1], bounds) if len(bounds) else np.empty(0, np.int64)


def induce_by_symbol(text, keys, seeds, wanted, runs, cap, scratch) -> tuple[np.ndarray, np.ndarray]:
    """Order of the seeds and all suffixes induced from them, in the order of ``keys`` (one per symbol).

    ``seeds`` are rows (suffix, common prefix with the seed before) in order; ``wanted`` says of a suffix
    whether it is to be induced. Within a symbol, induced suffixes come before seeds. Every symbol is a
    bucket; what a bucket pushes to itself comes in waves of longer and longer runs of the symbol.
    """
    queue = Queue(scratch)
    n_keys = int(keys.max()) + 1
    by_key = keys[text[seeds[:, 0]]]
    bounds = np.searchsorted(by_key, np.arange(n_keys + 1))
    size = len(seeds) + int(np.count_nonzero(wanted))
    order, prefix = scratch.empty(size, np.int64), scratch.empty(size, np.int32)
    filled = 0
    symbols = np.empty(n_keys, np.int64)
    symbols[keys] = np.arange(len(keys))
    for key in range(n_keys):
        waves = []
        wave = queue.pop(key)
        while len(wave):
            waves.append(wave)
            before = wave[:, 0] - 1
            own = np.flatnonzero((before >= 0) & wanted[before] & (text[before] == symbols[key]))
            if not len(own):
                break
            child = np.stack([before[own], np.zeros(len(own), np.int64)], axis=1)
            child[1:, 1] = np.minimum(least_between(wave[:, 1], own) + 1, cap)
            wave = child
        waves.append(seeds[bounds[key] : bounds[key + 1]].copy())
        waves = [w for w in waves if len(w)]
        if not waves:
            continue
        for last, wave in zip(waves, waves[1:]):  # runs of the symbol of different length meet
            wave[0, 1] = min(runs[last[-1, 0]], runs[wave[0, 0]], cap)
        waves[0][0, 1] = 0
        bucket = np.concatenate(waves)
        order[filled : filled + len(bucket)], prefix[filled : filled + len(bucket)] = bucket.T
        filled += len(bucket)
        before = bucket[:, 0] - 1
        chosen = np.flatnonzero((before >= 0) & wanted[before] & (text[before] != symbols[key]))
        if len(chosen):
            to = keys[text[before[chosen]]]
            by = np.argsort(to, kind="stable")
            at = np.flatnonzero(np.diff(to[by], prepend=-1))
            for a, b in zip(at, np.append(at[1:], len(by))):
                own = chosen[by[a:b]]
                child = np.stack([before[own], np.ones(len(own), np.int64)], axis=1)
                child[1:, 1] = np.minimum(least_between(bucket[:, 1], own) + 1, cap)
                queue.push(int(to[by[a]]), child)
    return order[:filled], prefix[:filled]


def induce_by_range(text, keys, seeds, wanted, scratch) -> np.ndarray:
    """The order that ``induce_by_symbol`` gives, for large alphabets and without common prefixes.

    A bucket is a range of keys. Within it, entries are sorted by key and by the place of the suffix
    they were induced from; that is repeated with the places found until they stay, which takes as many
    rounds as a chain of suffixes inside one range is long.
    """
    queue = Queue(scratch)
    n_keys = int(keys.max()) + 1
    # Ranges hold about BUCKET entries each, so that a frequent symbol has a range of its own.
    many = np.zeros(n_keys, np.int64)
    many[keys] = np.bincount(text, minlength=len(keys))
    before_key = np.cumsum(many) - many
    bucket_of = np.cumsum(np.append(True, before_key[1:] // BUCKET != before_key[:-1] // BUCKET)) - 1
    n_buckets = int(bucket_of[-1]) + 1
    bounds = np.searchsorted(bucket_of[keys[text[seeds]]], np.arange(n_buckets + 1))
    size = len(seeds) + int(np.count_nonzero(wanted))
    order = scratch.empty(size, np.int64)
    filled = 0
    for bucket in range(n_buckets):
        first = queue.pop(bucket)[:, 0]
        own = seeds[bounds[bucket] : bounds[bucket + 1]]
        fixed = np.concatenate([first, own])
        if not len(fixed):
            continue
        # A sort key: the symbol, whether it is a seed, and the place in its own order (below 2**31).
        ranks = np.concatenate([np.arange(len(first)) - len(first), np.arange(len(own))]) + MIDDLE
        ranks += (2 * keys[text[fixed]] + np.repeat([0, 1], [len(first), len(own)])) << 32
        found = fixed[np.argsort(ranks)]
        while True:
            before = found - 1
            good = np.flatnonzero((before >= 0) & wanted[before])
            child_keys = keys[text[before[good]]]
            inside = bucket_of[child_keys] == bucket
            good, child_keys = good[inside], child_keys[inside]
            if not len(good):
                break
            both = np.concatenate([fixed, before[good]])
            again = both[np.argsort(np.concatenate([ranks, ((2 * child_keys) << 32) + good + MIDDLE]))]
            if len(again) == len(found) and (again == found).all():
                break
            found = again
        order[filled : filled + len(found)] = found
        filled += len(found)
        before = found - 1
        good = before[(before >= 0) & wanted[before]]
        to = bucket_of[keys[text[good]]]
        later = to > bucket
        good, to = good[later], to[later]
        by = np.argsort(to, kind="stable")
        at = np.flatnonzero(np.diff(to[by], prepend=-1))
        for a, b in zip(at, np.append(at[1:], len(by))):
            rows = good[by[a:b]]
            queue.push(int(to[by[a]]), np.stack([rows, np.zeros(len(rows), np.int64)], axis=1))
    return order[:filled]


def shared_prefixes(text: np.ndarray, left: np.ndarray, right: np.ndarray, cap: int) -> np.ndarray:
    """Common-prefix lengths of pairs of suffixes, up to ``cap``."""
    n = len(text)
    out = np.zeros(len(left), np.int64)
    alive = np.arange(len(left))
    for d in range(cap):
        a, b = left[alive] + d, right[alive] + d
        inside = (a < n) & (b < n)
        alive, a, b = alive[inside], a[inside], b[inside]
        alive = alive[text[a] == text[b]]
        if not len(alive):
            break
        out[alive] = d + 1
    return out


def name_substrings(text: np.ndarray, falling: np.ndarray, turning: np.ndarray) -> tuple[np.ndarray, int]:
    """Ranks of the substrings from each turning point to the next one; equal substrings have one rank.

    Symbols are compared with their types, of which falling ones are smaller; so no substring is the
    beginning of another. As many symbols as fit into a sort key are compared at a time.
    """
    n = len(text)
    lengths = np.append(np.diff(turning), n - turning[-1] - 1) + 1
    bits = max(int(2 * int(text.max()) + 1).bit_length(), 1)
    per_key = max(1, 62 // bits)
    ranks = np.zeros(len(turning), np.int64)
    open_ones = np.arange(len(turning))
    done = 0
    while len(open_ones):
        key = np.zeros(len(open_ones), np.int64)
        at, left = turning[open_ones] + done, lengths[open_ones] - done
        for i in range(per_key):
            inside = left > i
            place = at[inside] + i
            key <<= bits
            key[inside] += 2 * text[place].astype(np.int64) + ~falling[place]
        by = np.lexsort((key, ranks[open_ones])) if done else np.argsort(key, kind="stable")
        group, key = ranks[open_ones[by]], key[by]
        new_group = np.append(True, group[1:] != group[:-1])
        new = new_group | np.append(True, key[1:] != key[:-1])
        # A group of one rank keeps the places from its rank on; each part takes its first place.
        first = np.maximum.accumulate(np.where(new_group, np.arange(len(by)), 0))
        part = np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))
        ranks[open_ones[by]] = group + part - first
        done += per_key
        size = np.diff(np.append(np.flatnonzero(new), len(by)))
        alone = np.repeat(size == 1, size)
        rest = open_ones[by][~alone]
        open_ones = rest[lengths[rest] > done]
    used = np.unique(ranks)
    return np.searchsorted(used, ranks), len(used)


def suffix_order(text: np.ndarray, cap: int, scratch: Scratch, small: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """Sorted suffixes of ``text``, whose last symbol is its only 0; with common prefixes if ``small``.

    ``small`` says that the alphabet is that of bytes, so that each symbol is a bucket of its own.
    """
    n = len(text)
    if n == 1:
        return np.zeros(1, np.int64), np.zeros(1, np.int32)
    falling, turning = symbol_types(text, scratch)
    up = np.arange(int(text.max()) + 1)
    down = up[::-1].copy()
    runs = run_lengths(text, scratch) if small else None
    rising = ~falling
    last = np.array([n - 1])

    def both_passes(seeds: np.ndarray, prefixes: np.ndarray | None) -> tuple[np.ndarray, np.ndarray | None]:
        if not small:
            order = induce_by_range(text, up, seeds, falling, scratch)
            order = np.concatenate([order[falling[order]][::-1], last])
            return induce_by_range(text, down, order, rising_but_last, scratch)[::-1], None
        rows = np.stack([seeds, prefixes], axis=1)
        order, prefix = induce_by_symbol(text, up, rows, falling, runs, cap, scratch)
        keep = np.flatnonzero(falling[order])
        back = np.zeros((len(keep), 2), np.int64)
        back[:, 0] = order[keep][::-1]
        if len(keep) > 1:
            back[1:, 1] = least_between(prefix, keep)[::-1]
        back = np.concatenate([back, [[n - 1, 0]]])
        order, prefix = induce_by_symbol(text, down, back, rising_but_last, runs, cap, scratch)
        return order[::-1], np.concatenate([[0], prefix[1:][::-1]])

    rising_but_last = rising.copy()
    rising_but_last[n - 1] = False
    names, distinct = name_substrings(text, falling, turning)
    if distinct < len(turning):
        below, _ = suffix_order(names, cap, scratch, False)
        ordered = turning[below]
    else:
        ordered = scratch.empty(len(turning), np.int64)
        ordered[names] = turning
    prefixes = np.zeros(len(ordered), np.int64)
    if small and len(ordered) > 1:
        prefixes[1:] = shared_prefixes(text, ordered[:-1], ordered[1:], cap)
    return both_passes(ordered, prefixes)


def sorted_suffixes(data: np.ndarray, cap: int, scratch: Scratch) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, common prefix of each with the one before, up to ``cap``) of an array of bytes."""
    text = scratch.empty(len(data) + 1, np.int16)
    text[:-1] = data
    text[:-1] += 1
    text[-1] = 0
    order, prefix = suffix_order(text, cap, scratch, True)
    return order[1:], np.concatenate([[0], prefix[2:]]) if len(data) else prefix[1:]
