"""Occurrences of benchmark texts in documents, by Wu-Manber search over words.

Texts are lower-cased (A-Z) and cut into words, the runs of digits, letters and
code points from U+0080 on. A window is ``WINDOW`` consecutive words of an item; an
item of fewer words is one window. The windows of one class of lengths share three
tables: a shift table says for the hash of a block of two words how far the end of
any window is from it, so that most places of a document are never looked at; a
block with shift 0 leads to a bucket of the windows that end in it (in the first
``m`` words, the least length of the class); those are compared word by word, and
byte by byte in the end. Documents are scanned in stretches side by side.

The windows travel to the tasks as text, in shards of bounded size. One shard is the
usual case and needs no shuffle at all; with more of them each is searched for on
its own, and what documents hold is put together by document.

Edge cases: null and empty texts have no words and hit nothing, an item without
words is no window, items that repeat an item_id count once, items without an
item_id count as one whose id is the empty string, repeated documents each get
their row, a document may be of any length, extra columns are ignored, an empty
table on either side gives no hits (or no rows).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.rows import row_key
from colloquy.llm.storage import spool
from colloquy.llm.textscan import fold, mix, pieces, range_codes, words

WINDOW = 10
#: Least lengths of the classes of windows: a short window must not hold back the shifts of long ones.
CLASSES = (1, 2, 5, WINDOW)
#: Bytes of benchmark text that a task searches for at once.
SHARD_BYTES = 8 << 20
PIECE_WORDS = 4096
STRETCH = 256
COMPARE = 1 << 18

_PLAIN = np.full(256, 0x20, np.uint8)
for _i in (*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)):
    _PLAIN[_i] = _i
_PLAIN[0x41:0x5B] = np.arange(0x61, 0x7B)


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers from each start on, and whose they are."""
    of = np.repeat(np.arange(len(sizes)), sizes)
    return np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[of], of


def _block(codes: np.ndarray, last: np.ndarray, size: int, mask: int) -> np.ndarray:
    """Hashes of the blocks of ``size`` words that end at ``last``."""
    h = mix(codes[last])
    return ((fold(h, codes[last - 1]) if size == 2 else h) & np.uint64(mask)).astype(np.int64)


@dataclass
class Windows:
    """Different windows of a shard: their words (codes and places in ``data``) and the items that have them."""

    data: np.ndarray
    codes: np.ndarray
    start: np.ndarray
    end: np.ndarray
    at: np.ndarray
    size: np.ndarray
    items: list[list[str]]


def windows_of(items: list[tuple[str, bytes]], window: int = WINDOW) -> Windows:
    """Windows of (item_id, words joined by blanks)."""
    data = np.frombuffer(b" ".join(t for _, t in items), np.uint8)
    sizes = np.array([len(t) + 1 for _, t in items], np.int64)
    off = np.minimum(np.concatenate([[0], np.cumsum(sizes)]), len(data))
    start, end, first = words(data, off)
    raw, seen, at, size, holders = data.tobytes(), {}, [], [], []
    for k, (item, _) in enumerate(items):
        a, n = int(first[k]), int(first[k + 1] - first[k])
        if n == 0:
            continue
        for i in range(a, a + max(1, n - window + 1)):
            w = min(window, n)
            where = seen.setdefault(raw[start[i] : end[i + w - 1]], len(at))
            if where == len(at):
                at.append(i)
                size.append(w)
                holders.append({item})
            else:
                holders[where].add(item)
    return Windows(data, range_codes(data, start, end), start, end, np.array(at, np.int64), np.array(size, np.int64), [sorted(h) for h in holders])


class Search:
    """The tables of one class of windows."""

    def __init__(self, of: Windows, mine: np.ndarray, least: int) -> None:
        self.of, self.least, self.block = of, least, min(2, least)
        self.mask = (1 << max(10, int(len(mine) * least * 16).bit_length())) - 1
        farthest = least - self.block + 1
        self.shift = np.full(self.mask + 1, farthest, np.uint8)
        for j in range(self.block, least + 1):
            h = _block(of.codes, of.at[mine] + j - 1, self.block, self.mask)
            np.minimum.at(self.shift, h, least - j)
        order = np.argsort(h, kind="stable")  # the blocks at ``least`` words
        self.bucket, first, self.count = np.unique(h[order], return_index=True, return_counts=True)
        self.first, self.window = first, mine[order]

    def ends(self, codes: np.ndarray, first: np.ndarray) -> Iterator[np.ndarray]:
        """Places of words at which the least length of a window may end."""
        n = np.diff(first)
        stretches = np.maximum(0, -(-(n - self.least + 1) // STRETCH))
        k, row = _ragged(np.zeros(len(n), np.int64), stretches)
        pos = first[row] + self.least - 1 + k * STRETCH
        stop = np.minimum(pos + STRETCH, first[row + 1])
        while len(pos):
            step = self.shift[_block(codes, pos, self.block, self.mask)]
            if (hit := pos[step == 0]).size:
                yield hit
            pos = pos + np.maximum(step, 1)
            on = pos < stop
            pos, stop = pos[on], stop[on]

    def find(self, data: np.ndarray, codes: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(first word, window) of occurrences."""
        found = list(self.ends(codes, first))
        if not found:
            return
        pos = np.concatenate(found)
        h = _block(codes, pos, self.block, self.mask)
        b = np.minimum(np.searchsorted(self.bucket, h), len(self.bucket) - 1)
        pos, b = pos[self.bucket[b] == h], b[self.bucket[b] == h]
        total, a = np.cumsum(self.count[b]), 0
        while a < len(pos):  # a bucket is never cut, so a step holds COMPARE pairs or one place
            to = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + COMPARE, "right")))
            entry, of = _ragged(self.first[b[a:to]], self.count[b[a:to]])
            yield self._same(data, codes, start, end, first, pos[a:to][of] - self.least + 1, self.window[entry])
            a = to

    def _same(self, data: np.ndarray, codes: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray, at: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = self.of
        size = w.size[window]
        fits = at + size <= first[np.searchsorted(first, at, "right")]
        at, window, size = at[fits], window[fits], size[fits]
        for k in range(WINDOW if not len(size) else int(size.max())):
            here = np.minimum(k, size - 1)
            on = codes[at + here] == w.codes[w.at[window] + here]
            at, window, size = at[on], window[on], size[on]
        # Equal codes: now the bytes of the words.
        mine, of = _ragged(at, size)
        theirs, _ = _ragged(w.at[window], size)
        long = end[mine] - start[mine]
        same = long == w.end[theirs] - w.start[theirs]
        x, word = _ragged(start[mine], np.where(same, long, 0))
        y, _ = _ragged(w.start[theirs], np.where(same, long, 0))
        same[word[data[x] != w.data[y]]] = False
        held = np.ones(len(at), bool)
        held[of[~same]] = False
        return at[held], window[held]


def searches(of: Windows) -> list[Search]:
    out = []
    for least, more in zip(CLASSES, (*CLASSES[1:], 1 << 62), strict=True):
        mine = np.flatnonzero((of.size >= least) & (of.size < more))
        if len(mine):
            out.append(Search(of, mine, least))
    return out


def scan(tables: list[Search], data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[list[str]]]:
    """For each text: its number of words, the spans of words hit (merged, from 0, end exclusive) and the items with occurring windows."""
    data = _PLAIN[data]
    start, end, first = words(data, off)
    n = len(first) - 1
    spans: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    items: list[list[str]] = [[] for _ in range(n)]
    if tables and len(start):
        codes = range_codes(data, start, end)
        change, met = np.zeros(len(start) + 1, np.int64), set()
        for t in tables:
            for at, window in t.find(data, codes, start, end, first):
                np.add.at(change, at, 1)
                np.add.at(change, at + t.of.size[window], -1)
                row = np.searchsorted(first, at, "right") - 1
                met.update(zip(row.tolist(), window.tolist(), strict=True))
        hit = np.concatenate([[False], np.cumsum(change)[:-1] > 0, [False]])
        edge = np.zeros(len(start) + 1, bool)
        edge[first] = True  # a row's end parts spans
        begins = np.flatnonzero(hit[1:] & (~hit[:-1] | edge))
        ends = np.flatnonzero(hit[:-1] & (~hit[1:] | edge))
        for row, a, b in zip((np.searchsorted(first, begins, "right") - 1).tolist(), begins.tolist(), ends.tolist(), strict=True):
            spans[row].append((a - int(first[row]), b - int(first[row])))
        held: dict[int, set[str]] = {}
        for row, window in met:
            held.setdefault(row, set()).update(tables[0].of.items[window])
        for row, ids in held.items():
            items[row] = sorted(ids)
    return np.diff(first), spans, items


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def item_texts(items: DataFrame, piece_words: int = PIECE_WORDS) -> DataFrame:
    """(item_id string, words binary): the words of items joined by blanks, long items in pieces that share all but one word of a window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, off in pieces(batches):
            plain = _PLAIN[data]
            start, end, first = words(plain, off)
            ids, texts = [], []
            for k, item in enumerate(part.column(0).to_pylist()):
                a, to = int(first[k]), int(first[k + 1])
                while a < to:
                    b = min(to, a + piece_words + WINDOW - 1)
                    ids.append(item)
                    texts.append(b" ".join(plain[start[i] : end[i]].tobytes() for i in range(a, b)))
                    a = to if b == to else a + piece_words
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(texts, pa.binary())], ["item_id", "words"])

    ids = F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id")
    return items.select(ids, "text").mapInArrow(run, "item_id string, words binary").distinct()


def _scanned(docs: DataFrame, shard: list[tuple[str, bytes]]) -> DataFrame:
    """The columns of ``docs`` but text, with n_words, spans and items of one shard."""
    given = docs.sparkSession.sparkContext.broadcast(shard)  # at most about SHARD_BYTES, see contaminated_spans
    kept = [c for c in docs.columns if c != "text"]
    made: list[list[Search]] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            made.append(searches(windows_of(given.value)))
        for part, data, off in pieces(batches):
            n_words, spans, items = scan(made[0], data, off)
            arrays = [part.column(part.schema.get_field_index(c)) for c in kept]
            rows = [[{"start": a, "end": b} for a, b in row] for row in spans]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(n_words, pa.int64()), pa.array(rows, _SPANS), pa.array(items, pa.list_(pa.string()))], [*kept, "n_words", "spans", "items"])

    types = dict(docs.dtypes)
    fields = ", ".join(f"`{c}` {types[c]}" for c in kept)
    return docs.mapInArrow(run, f"{fields}, n_words long, spans array<struct<start:long,end:long>>, items array<string>")


def _merged(spans: str) -> str:
    """Spans that overlap, as one; ``spans`` is an array in order."""
    joined = "concat(slice(done, 1, size(done) - 1), array(named_struct('start', element_at(done, -1).start, 'end', greatest(element_at(done, -1).end, s.end))))"
    apart = "size(done) = 0 or element_at(done, -1).end < s.start"
    return f"aggregate({spans}, slice({spans}, 1, 0), (done, s) -> case when {apart} then concat(done, array(s)) else {joined} end)"


def contaminated_spans(docs: DataFrame, items: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, n_words, spans (of words hit) and items (ids in string order) for every row of ``docs``."""
    texts = spool(item_texts(items), "items")
    total = texts.agg(F.sum(F.length("words") + 8)).first()[0] or 0
    shards = max(1, math.ceil(total / shard_bytes))
    # Pieces are dealt by hash, so a shard holds about an even share of them.
    dealt = texts.withColumn("shard", F.pmod(F.xxhash64("item_id", "words"), F.lit(shards)))

    def shard(k: int) -> list[tuple[str, bytes]]:
        return [(r.item_id, bytes(r.words)) for r in dealt.where(F.col("shard") == k).select("item_id", "words").collect()]

    if shards == 1:
        return _scanned(docs.select("doc_id", "text"), shard(0))
    keyed = docs.select("doc_id", row_key().alias("row_key"), "text")
    parts = [spool(_scanned(keyed, shard(k)) if k == 0 else _scanned(keyed, shard(k)).where("size(spans) > 0"), "hits") for k in range(shards)]
    every = parts[0].where("size(spans) > 0")
    for p in parts[1:]:
        every = every.unionByName(p)
    # Rows that repeat have the same hits, and one of them stands for all.
    found = every.dropDuplicates(["row_key", "spans", "items"]).groupBy("row_key").agg(
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("_spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("_items")
    )
    found = found.select("row_key", F.expr(_merged("_spans")).alias("spans"), F.col("_items").alias("items"))
    none = parts[0].select("doc_id", "row_key", "n_words", F.slice("spans", 1, 0).alias("_s"), F.slice("items", 1, 0).alias("_i"))
    joined = none.join(found.hint("merge"), "row_key", "left")
    return joined.select("doc_id", "n_words", F.coalesce("spans", "_s").alias("spans"), F.coalesce("items", "_i").alias("items"))


def decontaminate(docs: DataFrame, items: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated for every row of ``docs``."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    rows = contaminated_spans(docs, items, shard_bytes).withColumn("n_hit", hit)
    digest = F.sha2(F.concat_ws(",", "items"), 256)
    return rows.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
