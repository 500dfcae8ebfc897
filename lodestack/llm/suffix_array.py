"""Suffix arrays of byte strings by induced sorting, and their permuted longest common prefixes, in whole-array steps.

A text is a row of strings, each closed by a 0; bytes count from 1. The closing zeros differ from one
another (they are ordered by place), so no common prefix goes beyond a string's end. Scans over the
array that induced sorting makes one entry at a time are made here bucket by bucket: what a bucket's
entries induce is put into later buckets at once, and what falls into the same bucket follows in
another round, which keeps the order of the scan.
"""

from __future__ import annotations

import numpy as np


def joined(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The text of ``strings``, and where each begins."""
    sizes = np.array([len(s) for s in strings], "i8")
    starts = np.concatenate(([0], np.cumsum(sizes + 1)))[:-1]
    text = np.zeros(int(sizes.sum()) + len(strings), "i2")
    inside = np.ones(len(text), bool)
    inside[starts + sizes] = False
    text[inside] = np.frombuffer(b"".join(strings), "u1").astype("i2") + 1
    return text, starts


def smaller_types(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one; zeros are."""
    step = np.sign(np.diff(t, append=np.int16(-1)))
    step[t == 0] = 1
    # A suffix in a run of equal bytes is as the run's last one.
    at = np.where(step != 0, np.arange(len(t)), len(t))
    return step[np.minimum.accumulate(at[::-1])[::-1]] > 0


def _deal(buckets: list[list[np.ndarray]], places: np.ndarray, chars: np.ndarray) -> None:
    """Appends places to the buckets of their characters, in order."""
    if len(places) == 0:
        return
    order = np.argsort(chars, kind="stable")
    places, chars = places[order], chars[order]
    cuts = np.flatnonzero(np.diff(chars)) + 1
    for part, c in zip(np.split(places, cuts), chars[np.concatenate(([0], cuts))].tolist(), strict=True):
        buckets[c].append(part)


def _drain(bucket: list[np.ndarray], c: int, t: np.ndarray, buckets: list[list[np.ndarray]], later) -> np.ndarray:
    """All entries of a bucket, with what they induce into it; what they induce into ``later`` buckets is dealt."""
    done = 0
    while done < len(bucket):
        now = np.concatenate(bucket[done:])
        done = len(bucket)
        p = now[now > 0] - 1
        ch = t[p]
        on = later(ch)
        _deal(buckets, p[on], ch[on])
        same = p[ch == c]
        if len(same):
            bucket.append(same)
    return np.concatenate(bucket) if bucket else np.zeros(0, "i8")


def induced(t: np.ndarray, lms: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """From leftmost-smaller suffixes by first character, in order: all larger-type and smaller-type ones by first character, in order."""
    k = len(lms)
    buckets: list[list[np.ndarray]] = [[] for _ in range(k)]
    larger = [np.zeros(0, "i8")] * k
    for c in range(k):
        if c:
            larger[c] = _drain(buckets[c], c, t, buckets, lambda ch, c=c: ch > c)
        p = lms[c][lms[c] > 0] - 1
        _deal(buckets, p, t[p])
    buckets = [[] for _ in range(k)]
    smaller = [np.zeros(0, "i8")] * k
    smaller[0] = lms[0]
    for c in range(k - 1, 0, -1):
        smaller[c] = _drain(buckets[c], c, t, buckets, lambda ch, c=c: (ch < c) & (ch > 0))[::-1]
        x = larger[c][::-1]
        p = x[x > 0] - 1
        ch = t[p]
        on = (ch < c) & (ch > 0)
        _deal(buckets, p[on], ch[on])
    return larger, smaller


def _by_char(t: np.ndarray, places: np.ndarray, k: int) -> list[np.ndarray]:
    buckets: list[list[np.ndarray]] = [[] for _ in range(k)]
    _deal(buckets, places, t[places])
    return [np.concatenate(b) if b else np.zeros(0, "i8") for b in buckets]


def _names(t: np.ndarray, order: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Names of leftmost-smaller substrings given in order (each from its place to ``end``): equal ones have one name, zeros are never equal."""
    a, b = order[:-1], order[1:]
    size = end[:-1] - a
    equal = size == (end[1:] - b)
    left, k = np.flatnonzero(equal), 0
    while len(left):
        x, y = t[a[left] + k], t[b[left] + k]
        off = (x != y) | (x == 0)
        equal[left[off]] = False
        k += 1
        left = left[~off & (size[left] >= k)]
    return np.concatenate(([0], np.cumsum(~equal)))


def suffix_order(names: np.ndarray) -> np.ndarray:
    """Ranks of the suffixes of a row of names; names that are not unique are named again in pairs of twice the reach."""
    reach = 1
    while len(names) and names.max() + 1 < len(names):
        after = np.full(len(names), -1, "i8")
        after[: max(0, len(names) - reach)] = names[reach:]
        key = names * (len(names) + 1) + after + 1
        order = np.argsort(key, kind="stable")
        key = key[order]
        out = np.empty(len(names), "i8")
        out[order] = np.concatenate(([0], np.cumsum(key[1:] != key[:-1])))
        names, reach = out, 2 * reach
    return names


def suffix_array(t: np.ndarray) -> np.ndarray:
    """The places of all suffixes of ``t`` (see ``joined``; it ends with 0) in order."""
    if len(t) == 0:
        return np.zeros(0, "i8")
    small = smaller_types(t)
    is_lms = small & ~np.concatenate(([True], small[:-1]))
    is_lms |= t == 0
    lms, k = np.flatnonzero(is_lms), int(t.max()) + 1
    # Sorting by substrings: any order within a first character induces that of the whole substrings.
    _, smaller = induced(t, _by_char(t, lms, k))
    order = np.concatenate(smaller)
    order = order[is_lms[order]]
    nth = np.cumsum(is_lms) - 1
    end = np.append(lms[1:], len(t) - 1)[nth[order]]
    names = np.empty(len(lms), "i8")
    names[nth[order]] = _names(t, order, end)
    lms = lms[np.argsort(suffix_order(names), kind="stable")]
    larger, smaller = induced(t, _by_char(t, lms, k))
    return np.concatenate([x for pair in zip(larger, smaller, strict=True) for x in pair])


def common_prefixes(t: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each place, the common prefix of its suffix with the one before it in the array.

    Where the bytes before both are equal, it is one less than that of the place before; only the others are compared.
    """
    before = np.full(len(t), -1, "i8")
    before[sa[1:]] = sa[:-1]
    at = np.arange(len(t))
    prev = np.concatenate(([0], t[:-1]))
    # No byte before, or a zero, is equal to none.
    free = (before <= 0) | (at == 0) | (prev == 0) | (prev != np.where(before > 0, prev[before], -1))
    out = np.zeros(len(t), "i8")
    left = np.flatnonzero(free & (before >= 0))
    while len(left):
        n = out[left]
        x = t[left + n]
        left = left[(x == t[before[left] + n]) & (x != 0)]
        out[left] += 1
    first = np.maximum.accumulate(np.where(free, at, 0))
    return np.maximum(out[first] - (at - first), 0)


def repeated_starts(strings: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """All places (string, start) whose ``length`` bytes also start at another place of ``strings``, in order."""
    t, starts = joined(strings)
    sa = suffix_array(t)
    common = common_prefixes(t, sa)
    hit = common >= length
    after = hit[sa[1:]]
    hit[sa[:-1][after]] = True
    at = np.flatnonzero(hit)
    which = np.searchsorted(starts, at, "right") - 1
    return which, at - starts[which]
