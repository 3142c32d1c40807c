"""Large JSON documents, a list of objects or an object with lists, read by many tasks; a file may hold several of a kind, one behind the other.

Spark reads such a file (``multiLine``) whole in one task. Here it is read in pieces that
end with a closing brace, in splits as Spark splits any text. What a split must know
about all before it comes in three small tables, a row or less for a split: whether it
begins inside a string (from the parity of quotes), how deep (from sums of brackets),
and under which keys of the document. With these every split finds the items that begin
in it; the few that reach over its end are put together by file.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_REST = re.compile(r'(?:[^"\\]|\\.)*', re.S)
_STRING = re.compile(r'"(?:[^"\\]|\\.)*("|\Z)', re.S)
_MARK = re.compile(r'[{}\[\]]|" *"(?=\s*:)')
#: Keys of documents whose lists hold items: under the first level, or under two.
DATASET = (("collected",),)
BUNDLE = (("collected_data",), ("coded_data",), ("codebook", "codes"))


def outside_strings(piece: str, inside: bool) -> tuple[str, bool]:
    """``piece`` with blanks for what strings hold, and whether its end is inside one."""
    if inside:
        end = _REST.match(piece).end()
        if end == len(piece):
            return " " * end, True
        bare, still = outside_strings(piece[end + 1 :], False)
        return " " * (end + 1) + bare, still
    still = False

    def blank(m: re.Match) -> str:
        nonlocal still
        still = not m[1]
        return '"' + " " * (len(m[0]) - 2) + '"' if m[1] else " " * len(m[0])

    return _STRING.sub(blank, piece), still


def _change(bare: str, inside: bool) -> int:
    """How much deeper the document is after a piece and the brace behind it."""
    return bare.count("{") + bare.count("[") - bare.count("]") - bare.count("}") - (not inside)


class _Split:
    """A split as it is read; what a pass wants of it goes to ``out``."""

    def __init__(self, file: str, block: int, inside: bool, depth: int, keys: tuple[str | None, str | None], listed: bool) -> None:
        self.at, self.inside, self.depth, self.keys, self.listed = (file, block), inside, depth, list(keys), listed
        self.first, self.row, self.held, self.open, self.continues, self.total = None, 0, [], None, False, 0
        self.out: list[tuple] = []

    def read_depth(self, piece: str) -> None:
        bare, self.inside = outside_strings(piece, self.inside)
        self.total += _change(bare, self.inside)
        if self.first is None and (found := re.search(r"[^\s\ufeff]", bare)):
            self.first = found[0]

    def end_depth(self) -> None:
        self.out.append((*self.at, self.total, self.first or ""))

    def read_keys(self, piece: str) -> None:
        bare, self.inside = outside_strings(piece, self.inside)
        if not self.listed and self.depth - bare.count("]") - bare.count("}") <= 2:
            depth = self.depth
            for m in _MARK.finditer(bare):
                if m[0] in "{[":
                    depth += 1
                elif m[0] in "}]":
                    depth -= 1
                elif depth in (1, 2):
                    self.out.append((*self.at, self.row, depth, piece[m.start() + 1 : m.end() - 1]))
                    self.row += 1
        self.depth += _change(bare, self.inside)

    def end_keys(self) -> None:
        pass

    def item_depth(self, paths: tuple[tuple[str, ...], ...]) -> int | None:
        """How deep the document is between items where we are."""
        if self.listed:
            return 1
        here = tuple(k for k in self.keys if k is not None)
        return next((len(p) + 1 for p in paths if here[: len(p)] == p), None)

    def begin_items(self, paths: tuple[tuple[str, ...], ...]) -> None:
        level = self.item_depth(paths)
        if level is not None and self.depth > level:
            self.open, self.continues = level, True

    def read_items(self, piece: str, paths: tuple[tuple[str, ...], ...]) -> None:
        bare, inside = outside_strings(piece, self.inside)
        start = 0
        if self.open is None:
            depth = self.depth
            for m in _MARK.finditer(bare):
                if m[0] == "{" and depth == self.item_depth(paths):
                    self.open, start = depth, m.start()
                    break
                if m[0] in "{[":
                    depth += 1
                elif m[0] in "}]":
                    depth -= 1
                elif not self.listed and depth in (1, 2):
                    self.keys[depth - 1 :] = [piece[m.start() + 1 : m.end() - 1], *([None] * (2 - depth))]
        self.inside = inside
        self.depth += _change(bare, inside)
        if self.open is not None:
            self.held.append(piece[start:] + "}")
            if self.depth == self.open:
                self.end_items(False)

    def end_items(self, is_open: bool = True) -> None:
        if self.open is not None and (self.held or self.continues):
            name = "" if self.listed else self.keys[self.open - 2]
            self.out.append((*self.at, self.row, name, "".join(self.held), self.continues, is_open))
        self.row, self.held, self.open, self.continues = self.row + 1, [], None, False


#: Bytes of pieces that are taken out of a batch at once: Python texts take several times their room, and so do what is made of them.
SLICE_BYTES = 2_000_000


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    rows = max(1, int(batch.num_rows * SLICE_BYTES / max(batch.nbytes, 1)))
    for first in range(0, batch.num_rows, rows):
        yield batch.slice(first, rows)


def _each(read: Callable[[_Split, str], None], end: Callable[[_Split], None], names: list[tuple[str, pa.DataType]], begin: Callable[[_Split], None] | None = None):
    """A pass over (file, block, piece, inside, depth, key1, key2, listed), split by split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split: _Split | None = None
        done: list[tuple] = []

        def batch() -> pa.RecordBatch:
            nonlocal done
            rows, done = done + (split.out if split else []), []
            if split:
                split.out = []
            columns = zip(*rows, strict=True) if rows else [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, names, strict=True)], [n for n, _ in names])

        for b in (part for whole in batches for part in _slices(whole)):
            for file, block, piece, inside, depth, one, two, listed in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if split is None or split.at != (file, block):
                    if split:
                        end(split)
                        done += split.out
                    split = _Split(file, block, bool(inside), depth or 0, (one, two), bool(listed))
                    if begin:
                        begin(split)
                read(split, piece)
            yield batch()
        if split:
            end(split)
            yield batch()

    return run


def json_items(spark: SparkSession, paths: list[str] | str, keys: tuple[tuple[str, ...], ...] = DATASET) -> DataFrame:
    """(file, block, row, name, item): the objects in the lists under ``keys``, or in the document itself if that is a list (name is empty), as texts with their place."""
    text = spark.read.option("lineSep", "}").text(paths)
    pieces = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("piece"))
    nothing = {"depth": F.lit(0), "key1": F.lit(None).cast("string"), "key2": F.lit(None).cast("string"), "listed": F.lit(False)}
    shape = ["file", "block", "piece", "inside", "depth", "key1", "key2", "listed"]
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    string, number, flag = pa.string(), pa.int64(), pa.bool_()

    plain = F.regexp_replace("piece", r"(?s)\\.", "")
    quotes = pieces.groupBy("file", "block").agg(F.sum(F.length(plain) - F.length(F.replace(plain, F.lit('"')))).alias("n"))
    # The tables that are broadcast have a row for each split: a hundred bytes for what is 128 MB by default.
    inside = quotes.select("file", "block", (F.coalesce(F.sum("n").over(before), F.lit(0)) % 2 == 1).alias("inside"))
    known = pieces.join(F.broadcast(inside), ["file", "block"], "left")

    change = known.withColumns(nothing).select(shape).mapInArrow(_each(_Split.read_depth, _Split.end_depth, [("file", string), ("block", number), ("change", number), ("first", string)]), "file string, block long, change long, first string")
    root = F.first("first").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, 0))
    depths = change.select("file", "block", F.coalesce(F.sum("change").over(before), F.lit(0)).alias("depth"), (root == "[").alias("listed"))
    known = known.join(F.broadcast(depths), ["file", "block"], "left")

    events = known.withColumns({k: nothing[k] for k in ("key1", "key2")}).select(shape).mapInArrow(
        _each(_Split.read_keys, _Split.end_keys, [("file", string), ("block", number), ("row", number), ("level", number), ("key", string)]), "file string, block long, row long, level long, key string"
    )
    place = W.partitionBy("file").orderBy("block", "row")
    first = F.last(F.when(F.col("level") == 1, F.struct("block", "row", "key")), True).over(place)
    second = F.last(F.when(F.col("level") == 2, F.struct("block", "row", "key")), True).over(place)
    paths_at = events.select("file", "block", "row", first.alias("one"), second.alias("two"))
    current = F.when((F.col("two.block") > F.col("one.block")) | ((F.col("two.block") == F.col("one.block")) & (F.col("two.row") > F.col("one.row"))), F.col("two.key"))
    last = paths_at.groupBy("file", "block").agg(F.max_by(F.struct(F.col("one.key").alias("key1"), current.alias("key2")), "row").alias("at_end"))
    ends = depths.select("file", "block").join(last, ["file", "block"], "left").select("file", "block", F.last("at_end", True).over(before).alias("path"))
    known = known.join(F.broadcast(ends.select("file", "block", "path.key1", "path.key2")), ["file", "block"], "left")

    fields = [("file", string), ("block", number), ("row", number), ("name", string), ("item", string), ("continues", flag), ("open", flag)]
    found = known.select(shape).mapInArrow(
        _each(lambda s, p: s.read_items(p, keys), _Split.end_items, fields, lambda s: s.begin_items(keys)), "file string, block long, row long, name string, item string, continues boolean, open boolean"
    )
    whole = found.where("not continues and not open").select("file", "block", "row", "name", "item")
    torn = found.where("continues or open")
    begins = F.max(F.when(~F.col("continues"), F.struct("block", "row"))).over(W.partitionBy("file").orderBy("block", "row"))
    parts = F.array_sort(F.collect_list(F.struct("block", "row", "name", "item")))
    joined = torn.withColumn("_begin", begins).groupBy("file", "_begin").agg(parts.alias("p"))
    item = F.array_join(F.transform("p", lambda x: x["item"]), "")
    return whole.unionByName(joined.select("file", F.col("_begin.block").alias("block"), F.col("_begin.row").alias("row"), F.col("p")[0]["name"].alias("name"), item.alias("item")))


def as_lines(items: DataFrame, path: str) -> None:
    """Write items as JSON lines, in a folder for each name. Line breaks stand between tokens only, never in strings, so blanks do as well."""
    line = F.regexp_replace("item", r"[\r\n]+", " ").alias("value")
    items.select(F.when(F.col("name") == "", "items").otherwise(F.col("name")).alias("name"), line).write.partitionBy("name").text(path)
