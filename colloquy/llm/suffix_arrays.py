"""Suffix arrays of byte strings by induced sorting, and their permuted common prefixes.

Suffixes are classified, the substrings between leftmost-smaller places are
sorted and named, and the string of names is sorted the same way, until all names
differ (Nong, Zhang and Chan 2009). Over bytes the scans that induce an array run
bucket by bucket: all suffixes of a bucket that are in place push their
predecessors into later buckets at once, and runs of one sign take one round for
each repetition.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np


def _smaller(text: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than the one after them; the last sign must be the least and unique."""
    step = (text[1:] > text[:-1]).astype(np.int8) - (text[1:] < text[:-1])
    at = np.where(step != 0, np.arange(len(step), dtype=np.int32), np.int32(len(step)))
    at = np.minimum.accumulate(at[::-1])[::-1]
    out = np.ones(len(text), bool)
    out[:-1] = np.append(step, 1)[at] > 0
    return out


def _induce(text: np.ndarray, smaller: np.ndarray, sorted_lms: np.ndarray) -> np.ndarray:
    """The order of all suffixes that follows from an order of the leftmost-smaller ones."""
    n = len(text)
    size = np.bincount(text)
    end = np.cumsum(size)
    head = (end - size).tolist()
    array = np.full(n, -1, np.int32)

    def place(preds: np.ndarray, at: list[int], way: int) -> None:
        """Append suffixes to the fronts (way 1) or backs (way -1) of their buckets, in the order given."""
        if not len(preds):
            return
        values = text[preds]
        order = np.argsort(values, kind="stable")
        preds, values = preds[order], values[order]
        cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(preds)]
        for v, a, b in zip(values[cuts[:-1]].tolist(), cuts[:-1], cuts[1:], strict=True):
            if way > 0:
                array[at[v] : at[v] + b - a] = preds[a:b]
                at[v] += b - a
            else:
                array[at[v] - b + a : at[v]] = preds[a:b][::-1]
                at[v] -= b - a

    lms_tail = end.tolist()
    place(sorted_lms[::-1], lms_tail, -1)
    signs = np.flatnonzero(size).tolist()
    starts = (end - size).tolist()
    ends = end.tolist()
    # Larger suffixes, from the front.
    for c in signs:
        done = starts[c]
        while done < head[c]:
            here = array[done : head[c]]
            done = head[c]
            preds = here[here > 0] - 1
            place(preds[~smaller[preds]], head, 1)
        here = array[lms_tail[c] : ends[c]]
        preds = here[here > 0] - 1
        place(preds[~smaller[preds]], head, 1)
    # Smaller suffixes, from the back; they overwrite the seeds.
    back = end.tolist()
    for c in reversed(signs):
        done = ends[c]
        while done > back[c]:
            here = array[back[c] : done][::-1]
            done = back[c]
            preds = here[here > 0] - 1
            place(preds[smaller[preds]], back, -1)
        here = array[starts[c] : head[c]][::-1]
        preds = here[here > 0] - 1
        place(preds[smaller[preds]], back, -1)
    return array


def _induce_large(size: list[int], larger_before: list[int], smaller_before: list[int], sorted_lms: list[tuple[int, int]]) -> list[int]:
    """The same for a string of names, most of which stand alone in their bucket: sign by sign.

    For each place, ``larger_before`` has the sign before it if the suffix there
    is a larger one, else -1, and ``smaller_before`` the other way round; an entry
    after the last stands for places of the array that are not filled yet.
    """
    n = len(larger_before) - 1
    tail = list(itertools.accumulate(size))
    head, back = [0, *tail[:-1]], tail.copy()
    array = [n] * n
    for i, c in reversed(sorted_lms):
        p = back[c] = back[c] - 1
        array[p] = i
    for i in array:  # entries placed ahead of the scan are read when it gets there
        c = larger_before[i]
        if c >= 0:
            p = head[c]
            array[p] = i - 1
            head[c] = p + 1
    for i in reversed(array):
        c = smaller_before[i]
        if c >= 0:
            p = tail[c] = tail[c] - 1
            array[p] = i - 1
    return array


def _substring_ranks(text: np.ndarray, start: np.ndarray, size: np.ndarray, signs: int) -> np.ndarray:
    """Ranks of substrings over a large alphabet, sign by sign; only those with equals so far are looked at again.

    Where a leftmost-smaller substring ends inside a longer one, the longer one
    goes on with a larger suffix there, which comes first.
    """
    rank, open_, depth = np.zeros(len(start), np.int64), np.arange(len(start)), 0
    while len(open_):
        inside = size[open_] > depth
        sign = np.full(len(open_), signs, np.int64)
        sign[inside] = text[start[open_[inside]] + depth]
        key = rank[open_] * (signs + 1) + sign
        order = np.argsort(key, kind="stable")
        key, place = key[order], np.arange(len(order))
        head, new = np.ones(len(order), bool), np.ones(len(order), bool)
        new[1:] = key[1:] != key[:-1]
        group = key // (signs + 1)
        head[1:] = group[1:] != group[:-1]
        first = np.maximum.accumulate(np.where(new, place, 0))
        rank[open_[order]] = group + first - np.maximum.accumulate(np.where(head, place, 0))
        alone = new & np.append(new[1:], True)
        open_ = open_[order[~alone & (size[open_[order]] > depth)]]
        depth += 1
    return rank


def _same(text: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the substrings of ``size`` signs from ``a`` and from ``b`` are equal, for each pair."""
    out, open_ = np.ones(len(a), bool), np.arange(len(a))
    for k in range(64):
        open_ = open_[size[open_] > k]
        if not len(open_):
            return out
        equal = text[a[open_] + k] == text[b[open_] + k]
        out[open_[~equal]] = False
        open_ = open_[equal]
    for i in open_.tolist():
        out[i] = np.array_equal(text[a[i] : a[i] + size[i]], text[b[i] : b[i] + size[i]])
    return out


#: Alphabets up to this size are induced bucket by bucket, larger ones sign by sign; the method is the same.
SMALL_ALPHABET = 1024


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of ``text`` in order; the last sign must be the least and unique."""
    n = len(text)
    if n <= 2:
        return np.arange(n)[::-1].copy()
    signs = int(text.max()) + 1
    if signs <= 2**15:
        text = text.astype(np.int16)  # which numpy sorts by radix
    smaller = _smaller(text)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    if signs <= SMALL_ALPHABET:
        induced = functools.partial(_induce, text, smaller)
    else:
        sizes = np.bincount(text, minlength=signs).tolist()
        before = [np.concatenate([[-1], np.where(kind[:-1], text[:-1], -1), [-1]]).tolist() for kind in (~smaller, smaller)]

        def induced(order: np.ndarray) -> np.ndarray:
            return np.array(_induce_large(sizes, *before, list(zip(order.tolist(), text[order].tolist(), strict=True))))

    if len(lms) < 2:
        return induced(lms)
    # Sort the substrings between leftmost-smaller places, name them, and sort the string of names.
    stop = np.append(lms[1:] + 1, n)
    if signs > SMALL_ALPHABET:
        name = _substring_ranks(text, lms, stop - lms, signs)
        if len(np.unique(name)) == len(lms):
            return induced(lms[np.argsort(name)])
        name = np.unique(name, return_inverse=True)[1]
        return induced(lms[suffix_array(name)])
    rough = induced(lms)
    number = np.full(n, -1, np.int64)
    number[lms] = np.arange(len(lms))
    ordered = number[rough]
    ordered = ordered[ordered >= 0]
    size = (stop - lms)[ordered]
    differs = np.ones(len(ordered), bool)
    alike = np.flatnonzero(size[1:] == size[:-1])
    differs[alike + 1] = ~_same(text, lms[ordered[alike + 1]], lms[ordered[alike]], size[alike])
    if differs.all():
        return induced(lms[ordered])
    name = np.empty(len(lms), np.int64)
    name[ordered] = np.cumsum(differs) - 1
    return induced(lms[suffix_array(name)])


def permuted_common_prefixes(text: np.ndarray, array: np.ndarray) -> np.ndarray:
    """For each place of ``text``, in text order: how many signs its suffix has in common with the one before it in the array.

    Where the signs before a suffix and before its neighbour are equal, the
    common prefix is one less than that of the place before. At all other places
    signs are compared, and those comparisons are few in all (Kärkkäinen,
    Manzini and Puglisi 2009).
    """
    n = len(text)
    out = np.zeros(n, array.dtype)
    if n < 2:
        return out
    before = np.empty(n, array.dtype)
    before[array[1:]] = array[:-1]
    before[array[0]] = -1
    own = np.ones(n, bool)
    own[1:] = (before[1:] < 1) | (text[before[1:] - 1] != text[:-1])
    at = np.flatnonzero(own)
    at = at[before[at] >= 0]
    open_, other, length = at, before[at], 0
    while len(open_) > 256:
        inside = (open_ + length < n) & (other + length < n)
        inside[inside] = text[open_[inside] + length] == text[other[inside] + length]
        out[open_[~inside]] = length
        open_, other, length = open_[inside], other[inside], length + 1
    for i, j in zip(open_.tolist(), other.tolist(), strict=True):  # few are left, so each is compared in growing stretches
        k, step, most = length, 64, n - max(i, j)
        while k < most:
            a, b = text[i + k : i + min(k + step, most)], text[j + k : j + min(k + step, most)]
            wrong = np.flatnonzero(a != b)
            if len(wrong):
                k += int(wrong[0])
                break
            k, step = k + len(a), step * 2
        out[i] = k
    place = np.arange(n, dtype=array.dtype)
    last = np.maximum.accumulate(np.where(own, place, 0))
    return np.where(before < 0, 0, out[last] - (place - last)).astype(array.dtype)
