"""Similarity of short texts in percent, as Arrow functions.

Two texts are compared by their longest common subsequence: a substitution
costs as much as a removal and an insertion.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, one machine word operation for each character of ``b`` and 64 of ``a``."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    rest = full
    for c in b:
        hit = rest & places.get(c, 0)
        rest = (rest + hit | rest - hit) & full
    return len(a) - rest.bit_count()


def indel_ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 100.0 if total == 0 else 200.0 * common_subsequence(a, b) / total


def _prefix_scores(part: str, body: str) -> float:
    """The best ``indel_ratio`` of ``part`` with a beginning of ``body`` that is shorter than it, all in one pass."""
    places: dict[str, int] = {}
    for i, c in enumerate(part):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(part)) - 1
    rest, best = full, 0.0
    for n, c in enumerate(body[: len(part) - 1], 1):
        hit = rest & places.get(c, 0)
        rest = (rest + hit | rest - hit) & full
        best = max(best, 200.0 * (len(part) - rest.bit_count()) / (len(part) + n))
    return best


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class _Stretches:
    """Longest common subsequences of a part with stretches of its length, many stretches at once: bits stand for places of the part, 64 to a word."""

    def __init__(self, part: str, body: str) -> None:
        self.part, self.body = part, body
        self.size, of = len(part), _codes(part)
        known = np.unique(of)
        self.words = (self.size + 63) // 64
        self.places = np.zeros((len(known) + 1, self.words), np.uint64)
        row, at = np.searchsorted(known, of), np.arange(self.size)
        np.bitwise_or.at(self.places, (row, at // 64), np.uint64(1) << (at % 64).astype(np.uint64))
        text = _codes(body)
        self.text = np.minimum(np.searchsorted(known, text), len(known) - 1)
        self.text[known[self.text] != text] = len(known)  # a character that the part lacks
        self.full = np.full(self.words, ~np.uint64(0))
        if self.size % 64:
            self.full[-1] = np.uint64((1 << self.size % 64) - 1)

    def common(self, starts: np.ndarray) -> np.ndarray:
        if len(starts) < FEW * self.words:
            return np.array([common_subsequence(self.part, self.body[k : k + self.size]) for k in starts.tolist()], np.int64)
        if self.words == 1:
            return self._common_of_word(starts)
        rest = [np.full(len(starts), f) for f in self.full]
        for k in range(self.size):
            row = self.text[starts + k]
            carry = None
            for w in range(self.words):
                hit = rest[w] & self.places[row, w]
                up = rest[w] + hit
                over = up < hit
                if carry is not None:
                    up += carry
                    over |= up < carry
                rest[w] = (up | rest[w] ^ hit) & self.full[w]
                carry = over.astype(np.uint64)
        return self.size - sum(np.bitwise_count(r).astype(np.int64) for r in rest)


    def _common_of_word(self, starts: np.ndarray) -> np.ndarray:
        """The same for parts of up to 64 characters: one word, no carry, four operations for a character."""
        held = self.places[self.text, 0]
        rest = np.full(len(starts), self.full[0])
        hit, up = np.empty_like(rest), np.empty_like(rest)
        even = len(starts) > 2 and (step := int(starts[1] - starts[0])) > 0 and bool((np.diff(starts) == step).all())
        for k in range(self.size):
            row = held[starts[0] + k : starts[-1] + k + 1 : step] if even else held[starts + k]
            np.bitwise_and(rest, row, out=hit)
            np.add(rest, hit, out=up)
            np.bitwise_xor(rest, hit, out=rest)
            np.bitwise_or(rest, up, out=rest)
        return self.size - np.bitwise_count(rest & self.full[0]).astype(np.int64)


#: Every how many places a stretch is looked at first, at least; of long parts every eighth of their length.
STEP = 8
#: So few stretches for each word of a part are quicker one by one.
FEW = 16


def partial_score(a: str, b: str) -> float:
    """The best ``indel_ratio`` of the shorter text with any stretch of the longer of at most its length.

    Stretches at the ends, shorter than the part, take one pass each. A stretch one
    place further has at most one character more in common, so of the others every
    ``STEP``-th tells which of those between can still be the best; the likeliest go first.
    """
    part, body = (a, b) if len(a) <= len(b) else (b, a)
    if not part:
        return 100.0 if not body else 0.0
    if part in body:
        return 100.0
    stretches, last = _Stretches(part, body), len(body) - len(part)
    first = max(STEP, len(part) // 8)
    seen = np.unique(np.append(np.arange(0, last + 1, first), last))
    common = stretches.common(seen)
    best = int(common.max())
    for step in (STEP, 1) if first > STEP else (1,):
        rest = np.setdiff1d(np.arange(0, last + 1, step), seen, assume_unique=True)
        left = np.searchsorted(seen, rest) - 1
        most = np.minimum(common[left] + rest - seen[left], common[left + 1] + seen[left + 1] - rest) if len(rest) else rest
        rest, most = rest[most > best], most[most > best]
        order = np.argsort(-most, kind="stable")
        rest, most = rest[order], most[order]
        at, size, new = 0, 8, []
        while at < len(rest) and most[at] > best:
            here = rest[at : at + size][most[at : at + size] > best]
            new.append((here, stretches.common(here)))
            best = max(best, int(new[-1][1].max()))
            at, size = at + size, size * 8
        if step > 1 and new:
            seen, common = (np.concatenate([x, *(n[k] for n in new)]) for k, x in enumerate((seen, common)))
            order = np.argsort(seen)
            seen, common = seen[order], common[order]
    ends = max(_prefix_scores(part, body), _prefix_scores(part[::-1], body[: -len(part) : -1]))
    return max(200.0 * best / (2 * len(part)), ends)


@F.pandas_udf(T.DoubleType())
def label_score(a: pd.Series, b: pd.Series) -> pd.Series:
    """Score of two labels whatever the order of their words."""
    tidy = [" ".join(sorted(x.split())) for x in a], [" ".join(sorted(x.split())) for x in b]
    return pd.Series([indel_ratio(x, y) for x, y in zip(*tidy, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def quote_score(part: pd.Series, body: pd.Series) -> pd.Series:
    return pd.Series([partial_score(x, y) for x, y in zip(part, body, strict=True)], dtype="float64")
