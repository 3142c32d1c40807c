"""Quality rules on repetition, from suffix arrays over the words of each text.

All suffixes of a slice of texts are sorted by prefix doubling; signs are
numbered by row and word, so that no match leaves its text. Common prefixes of
neighbours in the array bound the intervals of suffixes that share a prefix. The
deepest such interval that holds a suffix is the longer of its two common
prefixes: the longest substring that begins there and occurs elsewhere too. Every
maximal repeated substring is covered by them, so the union of these spans (of at
least ``min_repeat`` words) and the longest of them are limited.

A text of any length is one slice; what is held beside it are some 32-bit and
64-bit numbers for each of its words and a few bits for each byte.

Edge cases: a null text counts as empty (no words, fails the base rules), texts
of one word have no repeats, repeated rows are rows of their own, extra columns
are ignored, an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from colloquy.llm.suffix_arrays import permuted_common_prefixes
from colloquy.llm.textscan import SPACE, STRETCH, pieces, range_codes, shingles, words

LEAST_WORDS = 50
MOST_REPEAT_WORDS = 50  # percent
MIN_REPEAT = 10
MOST_COVERED = 0.3
LONGEST_REPEAT = 200

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def _ranks(key: np.ndarray) -> np.ndarray:
    """Ranks of keys: the place of the first equal one in sorted order."""
    order = np.argsort(key)
    new = np.ones(len(order), bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    out = np.empty(len(order), np.int32)
    out[order] = np.maximum.accumulate(np.where(new, np.arange(len(order), dtype=np.int32), np.int32(0)))
    return out


def _pairs(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Two numbers of 31 bits as one; ``low`` may be -1."""
    return (high.astype(np.int64) << 32) + low + 1


def _sorted_suffixes(signs: np.ndarray) -> np.ndarray:
    """The suffix array of a string over ranks. Suffixes alone in their rank are sorted; only the others are looked at again."""
    n = len(signs)
    rank, width, open_ = signs.copy(), 1, np.arange(n, dtype=np.int32)
    while True:
        count = np.bincount(rank[open_], minlength=n)
        open_ = open_[count[rank[open_]] > 1]
        del count
        if not len(open_):
            break
        second = np.where(open_ + width < n, rank[np.minimum(open_ + width, n - 1)], np.int32(-1))
        key = _pairs(rank[open_], second)
        del second
        order = np.argsort(key).astype(np.int32)
        key, place = key[order], np.arange(len(order), dtype=np.int32)
        # A rank is the place of its first suffix, so a finer rank stays inside the places of the coarser one.
        new, head = np.ones(len(order), bool), np.ones(len(order), bool)
        new[1:] = key[1:] != key[:-1]
        head[1:] = key[1:] >> 32 != key[:-1] >> 32
        finer = np.maximum.accumulate(np.where(new, place, np.int32(0))) - np.maximum.accumulate(np.where(head, place, np.int32(0)))
        rank[open_[order]] = (key >> 32).astype(np.int32) + finer
        width *= 2
    out = np.empty(n, np.int32)
    out[rank] = np.arange(n, dtype=np.int32)
    return out


def repeats(tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each word: length in words of the longest substring that begins there and also begins elsewhere in its row."""
    n = len(tokens)
    if n == 0:
        return np.zeros(0, np.int32)
    row = np.repeat(np.arange(len(first) - 1, dtype=np.int32), np.diff(first))
    signs = _ranks(_pairs(row, _ranks(tokens)))  # rows share no sign
    array = _sorted_suffixes(signs)
    common = permuted_common_prefixes(signs, array)
    out = common.copy()
    out[array[:-1]] = np.maximum(out[array[:-1]], common[array[1:]])
    return out


def covered(length: np.ndarray) -> np.ndarray:
    """Words inside the union of the spans ``[i, i + length[i])``."""
    place = np.arange(len(length), dtype=np.int32)
    return np.maximum.accumulate(place + length) > place if len(length) else place > 0


def _per_row(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int32)])[first])


def measure(data: np.ndarray, off: np.ndarray, min_repeat: int = MIN_REPEAT) -> dict[str, np.ndarray]:
    """Counts for each row of a slice of texts."""
    start, end, first = words(data, off)
    token = range_codes(data, start, end)
    n_words = np.diff(first)
    row = np.repeat(np.arange(len(n_words), dtype=np.int32), n_words)
    letters, symbols = np.zeros(len(n_words), np.int64), np.zeros(len(n_words), np.int64)
    newlines = [np.zeros(0, np.int64)]
    for a in range(0, len(data), STRETCH):
        part = data[a : a + STRETCH]
        of = np.searchsorted(off, np.array([a, a + len(part) - 1]), "right") - 1
        cuts = np.clip(off[of[0] : of[1] + 1] - a, 0, None)
        some = np.flatnonzero(np.diff(np.append(cuts, len(part))))
        letters[of[0] + some] += np.add.reduceat(~SPACE[part] & ((part & 0xC0) != 0x80), cuts[some], dtype=np.int64)
        symbols[of[0] + some] += np.add.reduceat(_SYMBOL[part], cuts[some], dtype=np.int64)
        newlines.append(a + np.flatnonzero(part == 10))

    # Lines: from each row's start and after each newline, up to the next newline or the row's end.
    newline = np.concatenate(newlines)
    begins = np.unique(np.concatenate([off[:-1], newline + 1]))
    begins = begins[begins < len(data)]
    line_row = np.searchsorted(off, begins, "right") - 1
    stop = np.minimum(np.append(newline, len(data))[np.searchsorted(newline, begins)], off[line_row + 1])
    has_word = np.searchsorted(start, stop) > np.searchsorted(start, begins)
    begins, stop, line_row = begins[has_word], stop[has_word], line_row[has_word]
    code = range_codes(data, begins, stop)
    order = np.lexsort((code, line_row))
    same = np.zeros(len(order), bool)
    same[1:] = (code[order[1:]] == code[order[:-1]]) & (line_row[order[1:]] == line_row[order[:-1]])
    dup_lines = np.bincount(line_row[order], weights=same, minlength=len(n_words)).astype(np.int64)
    del start, end, newline, newlines, begins, stop, line_row, code, order, same

    # Windows of three words that occur twice or more in their row.
    twin = np.zeros(len(row) + 3, bool)
    long = np.flatnonzero(n_words >= 3)
    if len(long):
        window, at = shingles(token, first, 3)
        place = np.arange(len(window), dtype=np.int32) + np.repeat((first[:-1] - at[:-1]).astype(np.int32), np.diff(at))
        key = _pairs(row[place], _ranks(window))
        del window
        order = np.argsort(key)
        equal = np.zeros(len(order) + 1, bool)
        equal[1:-1] = key[order[1:]] == key[order[:-1]]
        found = place[order[equal[1:] | equal[:-1]]]
        for k in range(3):
            twin[found + k] = True
        del key, order, equal, place, found
    length = repeats(token, first)
    longest = np.zeros(len(n_words), np.int64)
    np.maximum.at(longest, row, length)
    return {
        "n_words": n_words,
        "word_chars": letters,
        "n_symbols": symbols,
        "n_dup_lines": dup_lines,
        "n_repeat_words": _per_row(twin[: len(row)], first),
        "n_covered_words": _per_row(covered(np.where(length >= min_repeat, length, 0)), first),
        "longest_repeat": longest,
    }


def repetition_rules(docs: DataFrame, min_repeat: int = MIN_REPEAT, most_covered: float = MOST_COVERED, longest_repeat: int = LONGEST_REPEAT) -> DataFrame:
    """doc_id, the counts of ``measure``, base_failed and kept for every row of ``docs``."""
    kind = dict(docs.dtypes)["doc_id"]
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    extra = ["n_covered_words", "longest_repeat"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, off in pieces(batches):
            m = measure(data, off, min_repeat)
            failed = (m["n_words"] < LEAST_WORDS) | (100 * m["n_repeat_words"] > MOST_REPEAT_WORDS * m["n_words"])
            repetitive = (m["n_covered_words"] > most_covered * m["n_words"]) | (m["longest_repeat"] > longest_repeat)
            out = [part.column(0), *(pa.array(m[c], pa.int64()) for c in counts), pa.array(failed), pa.array(~failed & ~repetitive), *(pa.array(m[c], pa.int64()) for c in extra)]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", *counts, "base_failed", "kept", *extra])

    schema = f"doc_id {kind}, {', '.join(f'{c} long' for c in counts)}, base_failed boolean, kept boolean, n_covered_words long, longest_repeat long"
    return docs.select("doc_id", "text").mapInArrow(run, schema)
