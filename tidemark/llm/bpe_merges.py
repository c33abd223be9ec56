"""Ranked pair merges over many distinct words at once, in numpy."""

from __future__ import annotations

import heapq

import numpy as np

#: Longer words are merged one by one with a heap, in n log n steps.
LONG_WORD = 256
NONE = np.int64(1 << 40)


class PairTable:
    """Rank and merged id of a pair of ids; lower ranks merge first."""

    def __init__(self, first, second, ranks, merged, size: int):
        self.size = np.int64(size)
        keys = np.asarray(first, np.int64) * self.size + np.asarray(second, np.int64)
        self.ranks, self.merged = np.asarray(ranks, np.int64), np.asarray(merged, np.int64)
        self.bits = max(4, int(np.ceil(np.log2(max(len(keys), 1)))) + 3)
        self.levels: list[tuple[np.uint64, np.ndarray, np.ndarray]] = []
        left = np.arange(len(keys))
        multiplier = 0x9E3779B97F4A7C15
        while len(left):
            odd = np.uint64(multiplier)
            slots = self._slot(keys[left], odd)
            _, at = np.unique(slots, return_index=True)
            held = np.full(1 << self.bits, -1, np.int64)
            index = np.zeros(1 << self.bits, np.int32)
            held[slots[at]] = keys[left[at]]
            index[slots[at]] = left[at]
            self.levels.append((odd, held, index))
            left = np.delete(left, at)
            multiplier = (multiplier * 0xBF58476D1CE4E5B9 + 2) % (1 << 64) | 1

    def _slot(self, keys: np.ndarray, odd: np.uint64) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * odd) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Index of each pair in the table, -1 where it does not merge."""
        keys = first * self.size + second
        found = np.full(len(keys), -1, np.int64)
        for odd, held, index in self.levels:
            slots = self._slot(keys, odd)
            hit = held[slots] == keys
            found[hit] = index[slots[hit]]
        return found


def _merge_long(ids: np.ndarray, table: PairTable) -> np.ndarray:
    """One long word: a heap of candidate pairs over a linked list."""
    n = len(ids)
    token, after, before = ids.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n

    def lookup(i: int) -> int:
        j = after[i]
        return -1 if j >= n else int(table.find(np.array([token[i]]), np.array([token[j]]))[0])

    start = table.find(ids[:-1], ids[1:])
    heap = [(int(table.ranks[at]), i, token[i], token[i + 1], int(at)) for i, at in enumerate(start) if at >= 0]
    heapq.heapify(heap)
    while heap:
        _, i, a, b, at = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or token[i] != a or token[j] != b:
            continue
        token[i], alive[j], after[i] = int(table.merged[at]), False, after[j]
        if after[i] < n:
            before[after[i]] = i
        for k in (before[i], i):
            if k >= 0 and (found := lookup(k)) >= 0:
                heapq.heappush(heap, (int(table.ranks[found]), k, token[k], token[after[k]], found))
    return np.array([t for t, keep in zip(token, alive, strict=True) if keep], np.int64)


def merge_words(ids: np.ndarray, lengths: np.ndarray, table: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """Merge every word until no pair of it has a rank.

    ``ids`` holds the words one after the other, ``lengths`` their sizes; the
    result has the same form. In each round every word merges its pair of
    lowest rank, the leftmost of equals.
    """
    words = len(lengths)
    owner = np.repeat(np.arange(words), lengths)
    ids = ids.astype(np.int64)
    done_ids, done_owner = [], []
    for w in np.flatnonzero(lengths > LONG_WORD):
        part = owner == w
        merged = _merge_long(ids[part], table)
        done_ids.append(merged)
        done_owner.append(np.full(len(merged), w))
        ids, owner = ids[~part], owner[~part]
    while len(ids):
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        rank = np.full(len(ids), NONE)
        inside = np.flatnonzero(owner[:-1] == owner[1:])
        found = table.find(ids[inside], ids[inside + 1])
        hit = found >= 0
        rank[inside[hit]] = table.ranks[found[hit]]
        which = np.full(len(ids), -1, np.int64)
        which[inside[hit]] = found[hit]
        best = np.minimum.reduceat(rank, starts)
        sizes = np.diff(np.r_[starts, len(ids)])
        over = best == NONE
        if over.any():
            part = np.repeat(over, sizes)
            done_ids.append(ids[part])
            done_owner.append(owner[part])
        at_best = np.flatnonzero((rank == np.repeat(best, sizes)) & (rank < NONE))
        # the leftmost of a word's best pairs
        place = at_best[np.r_[True, owner[at_best][1:] != owner[at_best][:-1]]] if len(at_best) else at_best
        ids[place] = table.merged[which[place]]
        keep = ~np.repeat(over, sizes)
        keep[place + 1] = False
        ids, owner = ids[keep], owner[keep]
    if not done_ids:
        return np.empty(0, np.int64), np.zeros(words, np.int64)
    all_ids, all_owner = np.concatenate(done_ids), np.concatenate(done_owner)
    order = np.argsort(all_owner, kind="stable")
    return all_ids[order], np.bincount(all_owner, minlength=words)
