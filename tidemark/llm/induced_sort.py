"""Suffix arrays by induced sorting, and permuted common prefixes, for one shard.

Positions are classed S (smaller than the suffix to their right) or L; the
leftmost S positions (LMS) cut the text into substrings, which an induction
pass sorts and names. Names of neighbouring substrings are joined recursively
to longer ones, until all differ or they reach as far as is asked, which sorts
the LMS suffixes. A last pass induces the whole array from these. The passes
are linear and work on whole buckets in numpy.
"""

from __future__ import annotations

import numpy as np


def _classes(text: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the one to its right; the last symbol is."""
    n = len(text)
    step = np.sign(text[1:].astype(np.int64) - text[:-1])  # 1: smaller, -1: larger, 0: as the next
    step = np.append(step, 1)
    at = np.where(step != 0, np.arange(n), n)
    following = np.minimum.accumulate(at[::-1])[::-1]
    return step[following] > 0


def _induce(text: np.ndarray, small: np.ndarray, lms: np.ndarray, symbols: int) -> np.ndarray:
    """Suffix array from LMS positions in the order of their suffixes (or first symbols)."""
    n = len(text)
    sa = np.full(n, -1, np.int64)
    counts = np.bincount(text, minlength=symbols)
    end = np.cumsum(counts)
    start = end - counts
    head = start.copy()
    first = text[lms]
    order = np.argsort(first, kind="stable")
    by_symbol = lms[order]
    limits = np.searchsorted(first[order], np.arange(symbols + 1))

    # numpy sorts 16-bit keys by radix
    keys = text.astype(np.uint16) if symbols <= 1 << 16 else text

    def append(found: np.ndarray) -> None:
        marks = keys[found]
        order = np.argsort(marks, kind="stable")
        marks, found = marks[order], found[order]
        many = np.bincount(marks, minlength=symbols)
        place = np.arange(len(found)) - (np.cumsum(many) - many)[marks]
        sa[head[marks] + place] = found
        head[:] += many

    for c in range(symbols):
        done = start[c]
        while done < head[c]:
            upto = head[c]
            before = sa[done:upto] - 1
            done = upto
            before = before[before >= 0]
            append(before[~small[before]])
        batch = by_symbol[limits[c] : limits[c + 1]] - 1
        batch = batch[batch >= 0]
        append(batch[~small[batch]])

    tail = end.copy()

    def prepend(found: np.ndarray) -> None:
        marks = keys[found]
        order = np.argsort(marks, kind="stable")
        marks, found = marks[order], found[order]
        many = np.bincount(marks, minlength=symbols)
        place = np.arange(len(found)) - (np.cumsum(many) - many)[marks]
        sa[tail[marks] - 1 - place] = found
        tail[:] -= many

    for c in range(symbols - 1, -1, -1):
        done = end[c]
        if c == 0:  # the closing symbol stands alone
            tail[0], sa[0] = 0, n - 1
        while done > tail[c]:
            upto = tail[c]
            before = sa[upto:done][::-1] - 1
            done = upto
            before = before[before >= 0]
            prepend(before[small[before]])
        before = sa[start[c] : head[c]][::-1] - 1
        before = before[before >= 0]
        prepend(before[small[before]])
    return sa


def _names(text: np.ndarray, lms: np.ndarray, ordered: np.ndarray) -> tuple[np.ndarray, int]:
    """Names of the LMS substrings in text order, by their sorted order."""
    limit = np.append(lms[1:], len(text) - 1)
    size = np.zeros(len(text), np.int64)
    size[lms] = limit - lms + 1
    a, b = ordered[:-1], ordered[1:]
    same = size[a] == size[b]
    active = np.flatnonzero(same)
    offset = 0
    while len(active):
        differ = text[a[active] + offset] != text[b[active] + offset]
        same[active[differ]] = False
        active = active[~differ]
        offset += 1
        active = active[offset < size[a[active]]]
    name = np.zeros(len(text), np.int64)
    name[ordered[1:]] = np.cumsum(~same)
    return name[lms], int((~same).sum()) + 1


def _order_names(names: np.ndarray, distinct: int, reach: int | None) -> np.ndarray:
    """Order of the suffixes of a text of names.

    Names of neighbours are joined to names twice as long, recursively, until
    all differ or they reach far enough; a name stands for two symbols at least.
    """
    joined = 1
    while distinct < len(names) and (reach is None or 2 * joined < reach):
        after = np.zeros_like(names)
        after[:-joined] = names[joined:] + 1
        pairs = names * np.int64(len(names) + 1) + after
        order = np.argsort(pairs, kind="stable")
        new = np.r_[False, pairs[order][1:] != pairs[order][:-1]]
        names = np.empty_like(names)
        names[order] = np.cumsum(new)
        distinct = int(new.sum()) + 1
        joined *= 2
    return np.argsort(names, kind="stable")


def suffix_array(text: np.ndarray, symbols: int, reach: int | None = None) -> np.ndarray:
    """``text`` ends with its only 0, the smallest symbol; symbols are below ``symbols``.

    With ``reach``, suffixes that share so many symbols may stand in any order.
    """
    if len(text) < 3:
        return np.arange(len(text) - 1, -1, -1)
    small = _classes(text)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    rough = _induce(text, small, lms, symbols)
    is_lms = np.zeros(len(text), bool)
    is_lms[lms] = True
    names, distinct = _names(text, lms, rough[is_lms[rough]])
    return _induce(text, small, lms[_order_names(names, distinct, reach)], symbols)


def common_prefixes(text: np.ndarray, sa: np.ndarray, starts: np.ndarray, cap: int) -> np.ndarray:
    """For each of ``starts``: symbols shared with the suffix before it in ``sa``, up to ``cap``.

    In text order (permuted); ``text`` has ``cap + 4`` symbols more than any start needs.
    """
    before = np.full(len(text), -1, np.int64)
    before[sa[1:]] = sa[:-1]
    left, right = starts, before[starts]
    shared = np.zeros(len(starts), np.int64)
    words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(text.astype(np.uint16), 4)).view(np.uint64)[:, 0]
    active = np.flatnonzero(right >= 0)
    ended = []
    while len(active):
        reach = shared[active]
        # suffixes near the end share less than a word there
        inside = np.maximum(left[active], right[active]) + reach < len(words)
        ended.append(active[~inside])
        active, reach = active[inside], reach[inside]
        equal = words[left[active] + reach] == words[right[active] + reach]
        ended.append(active[~equal])
        active = active[equal]
        shared[active] = np.minimum(shared[active] + 4, cap)
        active = active[shared[active] < cap]
    active = np.concatenate(ended) if ended else active
    for _ in range(3):
        reach = shared[active]
        active = active[(reach < cap) & (np.maximum(left[active], right[active]) + reach < len(text))]
        reach = shared[active]
        active = active[text[left[active] + reach] == text[right[active] + reach]]
        shared[active] += 1
    return shared
