"""Self-join of documents on the Jaccard similarity of their word shingles.

Candidates come from a MinHash LSH forest. Each of ``TREES`` prefix tries holds
one label of ``DEPTH`` minimum hashes for every distinct text; a node is a tree
and a prefix. Matching begins at whole labels. Texts under one node are compared
by sketches of their signatures, and from the similarity of what it met each text
knows what share of such partners its matches can find. Where that is less than
``recall``, its prefix is shortened by one and it matches again, until the share
is reached; a text that met nobody goes on until a partner right at the threshold
would have been found with ``recall``. What is alone under that shortest prefix
is set aside before all this.

What meets in a node and looks alike is joined to candidate sets; texts whose
signatures are too far apart to be at the threshold do not join them. Every set
gets its shingles once and is verified exactly, all against all in blocks of
bounded size, but for pairs whose sizes alone rule a link out. The blocks of a large
set travel whole and compressed; what leaves a task is one row per text and pair of
blocks, never a pair of texts.

Copies (equal word sequences, by 128 bits) stand for one text from the start.
Results: one row per document with its class (the documents that chains of links
join) and its number of links, that is, of other texts with similarity at least
``threshold``.

Edge cases: a null or wordless text has no shingles and is a class of its own,
a text of fewer than ``size`` words has one shingle, documents with null doc_ids
take part (a class of such documents alone has a null class_id), repeated rows
are copies, a pair right at the threshold is linked, of several rows that could
lead a class the least doc_id leads, extra columns are ignored, an empty table
gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.components import components
from colloquy.llm.rows import row_key
from colloquy.llm.storage import spool
from colloquy.llm.textscan import pieces, range_codes, shingles, words

SHINGLE = 5
THRESHOLD = 0.8
TREES = 32
DEPTH = 8
RECALL = 0.9999
#: Texts of a node that one task compares, and nodes' worth of them in one task.
NODE = 2_048
#: Texts and shingles in one block of exact verification.
BLOCK = 512
BLOCK_SHINGLES = 400_000
#: Hashes of each tree, by their low byte, with which signatures are compared.
SKETCH = 4
#: A sketch's estimate is this many standard errors below the threshold once in a billion pairs at the threshold.
ERRORS = 6.0
_SEEDS = np.random.default_rng(20_250_101).integers(1, 2**32, (2, TREES * DEPTH), dtype=np.uint32)


def found_share(similarity: float, length: int, trees: int = TREES) -> float:
    """Share of the pairs of a similarity that meet under a prefix of ``length`` hashes in some trie."""
    return 1 - (1 - similarity**length) ** trees


def shortest_prefix(threshold: float, recall: float) -> int:
    """The longest prefix with which a text that met nobody has found a partner at the threshold with ``recall``."""
    return next((n for n in range(DEPTH, 1, -1) if found_share(threshold, n) >= recall), 1)


def least_estimate(threshold: float, hashes: int = TREES * SKETCH) -> float:
    """What the sketches of a pair at the threshold agree in at least."""
    return threshold - ERRORS * math.sqrt(threshold * (1 - threshold) / hashes)


# -- signatures ----------------------------------------------------------------------------------


def _scan(data: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, list[bytes | None]]:
    """Shingle codes, their offsets, and the key of each text's word sequence (none without words)."""
    start, end, first = words(data, off)
    codes, at = shingles(range_codes(data, start, end), first, size)
    cuts, raw = off.tolist(), data.tobytes()
    keys = [xxhash.xxh3_128_digest(b" ".join(raw[a:b].split())) if some else None for a, b, some in zip(cuts[:-1], cuts[1:], (np.diff(first) > 0).tolist(), strict=True)]
    return codes, at, keys


def signatures(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, row_key, key (of the word sequence; null without words), labels (16 bits for each minimum hash), sketch."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scale, flip = _SEEDS[0] | np.uint32(1), _SEEDS[1]
        for part, data, off in pieces(batches):
            codes, at, keys = _scan(data, off, size)
            some = np.diff(at) > 0
            least = np.zeros((len(some), TREES * DEPTH), np.uint16)
            if some.any():
                short = (codes >> np.uint64(32)).astype(np.uint32)
                for j in range(TREES * DEPTH):
                    least[some, j] = np.minimum.reduceat((short ^ flip[j]) * scale[j], at[:-1][some]).astype(np.uint16)
            # The low bits of the minimum name the shingle that has it; the high bits are small for every text.
            labels = pa.FixedSizeBinaryArray.from_buffers(pa.binary(least.shape[1] * 2), len(some), [None, pa.py_buffer(least.tobytes())]).cast(pa.binary())
            low = np.ascontiguousarray(least.reshape(len(some), TREES, DEPTH)[:, :, :SKETCH]).astype(np.uint8).reshape(len(some), -1)
            sketch = pa.array([x.tobytes() for x in low], pa.binary())
            yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(keys, pa.binary()), labels, sketch], ["doc_id", "row_key", "key", "labels", "sketch"])

    return docs.select("doc_id", row_key().alias("row_key"), "text").mapInArrow(run, f"doc_id {kind}, row_key binary, key binary, labels binary, sketch binary")


# -- the forest ----------------------------------------------------------------------------------


def _members(texts: DataFrame, length: int) -> DataFrame:
    """(id, node, tail): the nodes at ``length`` that several texts share, with what is left of the label. Texts that are alone there meet nobody at any length."""
    label = lambda t, a, b: F.substring("labels", t * (2 * DEPTH) + 2 * a + 1, F.lit(2 * (b - a)))
    nodes = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.struct(F.xxhash64(t, label(t, 0, length)).alias("node"), label(t, length, DEPTH).alias("tail")))
    under = texts.select("id", F.explode(nodes).alias("t")).select("id", "t.*")
    # A table of its own, so that Spark can split a node that very many texts share.
    shared = spool(under.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").select("node"), "nodes")
    return spool(under.join(shared, "node"), "members")


def _matches(members: DataFrame, sketches: DataFrame, seen: DataFrame | None, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Matches (u, v, similarity) under nodes where an open text takes part, and the sets of texts under them.

    ``members`` is id, node, open. Nodes with the same texts as one of ``seen``,
    or as one another, count once. A node's texts are compared with its least one
    (v); a text that is too far from it matches the nearest text close enough to
    it, and the least of those that hang together without it.
    """
    held = F.bit_xor(F.xxhash64("id")).alias("held")
    sets = members.groupBy("node").agg(F.min("id").alias("lead"), F.count("*").alias("n"), held, F.max("open").alias("open")).where("n > 1 and open")
    sets = sets.groupBy("lead", "n", "held").agg(F.min("node").alias("node"))
    if seen is not None:
        sets = sets.join(seen, ["lead", "n", "held"], "left_anti")
    sets = spool(sets, "sets")

    # A large node is dealt to several tasks, which all have its least text.
    inside = members.join(sets, "node").withColumn("parts", F.ceil(F.col("n") / NODE).cast("int"))
    own = F.when(F.col("id") == F.col("lead"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")))
    inside = inside.select("id", "node", "open", "lead", "parts", F.explode(own).alias("part"))
    shares = max(1, -(-sets.where(F.col("n") <= NODE).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] // NODE))
    task = F.when(F.col("parts") == 1, F.pmod("node", F.lit(shares))).otherwise(F.xxhash64("node", "part"))
    least = least_estimate(threshold)

    def compare(table: pa.Table) -> pa.Table:
        node, ids, lead, parts = (table.column(c).to_numpy() for c in ("node", "id", "lead", "parts"))
        active = table.column("open").to_numpy(zero_copy_only=False)
        sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(len(node), TREES * SKETCH)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def alike(i: int, others: np.ndarray) -> np.ndarray:
            return ((sketch[others] == sketch[i]).mean(axis=1) - 1 / 256) / (1 - 1 / 256)  # low bytes agree by chance too

        order = np.argsort(node, kind="stable")
        for one in np.split(order, np.flatnonzero(np.diff(node[order])) + 1):
            first = one[ids[one] == lead[one]][0]
            one = one[one != first]
            share = alike(first, one)
            near = share >= least
            told = near & (active[one] | active[first])  # of two texts that are done nothing new is learnt
            out.append((ids[one[told]], np.full(told.sum(), ids[first]), share[told]))
            far = one[~near]
            if not len(far):
                continue
            if parts[first] > 1:  # what else is near it may be in another task, so it stays a candidate
                out.append((ids[far], np.full(len(far), ids[first]), np.full(len(far), threshold)))
                continue
            root = np.arange(len(far))
            best = np.zeros(len(far))
            for k, i in enumerate(far.tolist()):
                share = alike(i, one[near])
                if not active[i]:
                    share = np.where(active[one[near]], share, 0)
                if len(share) and share.max() >= least:
                    out.append((ids[[i]], ids[one[near][[share.argmax()]]], share[[share.argmax()]]))
                share = alike(i, far[:k])
                share[~(active[i] | active[far[:k]]) | (share < least)] = 0
                if share.any():
                    best[k] = share.max()
                    joined = np.unique(root[np.flatnonzero(share)])
                    root[np.isin(root, joined) | (np.arange(len(far)) == k)] = joined[0]
            apart = np.flatnonzero(root != np.arange(len(far)))
            out.append((ids[far[apart]], ids[far[root[apart]]], np.where(best[apart] > 0, best[apart], threshold)))
        u, v, s = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table({"u": u, "v": v, "similarity": s})

    dealt = inside.withColumn("task", task).join(sketches, "id")
    found = dealt.groupBy("task").applyInArrow(compare, "u long, v long, similarity double")
    return spool(found.groupBy("u", "v").agg(F.max("similarity").alias("similarity")), "matches"), sets.select("lead", "n", "held")


def candidate_sets(texts: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(node, root): texts (id, labels, sketch) that meet in the forest, joined to sets."""
    shortest = shortest_prefix(threshold, recall)
    members, sketches = _members(texts, shortest), texts.select("id", "sketch")
    closed, seen, matches = None, None, None
    for length in range(DEPTH, shortest - 1, -1):
        here = members.select("id", F.xxhash64("node", F.substring("tail", 1, 2 * (length - shortest))).alias("node"))
        here = here.withColumn("open", F.lit(True)) if closed is None else here.join(closed, "id", "left").select("id", "node", F.coalesce("open", F.lit(True)).alias("open"))
        met, sets = _matches(here, sketches, seen, threshold)
        seen, matches = (sets, met) if seen is None else (seen.union(sets), matches.union(met))
        if length > shortest:
            # A match stands for 1 / share partners of its similarity.
            share = 1 - F.pow(1 - F.pow(F.greatest("similarity", F.lit(threshold)), length), TREES)
            pairs = matches.groupBy("u", "v").agg(F.max("similarity").alias("similarity")).withColumn("stands_for", 1 / share)
            both = pairs.select(F.col("u").alias("id"), "stands_for").union(pairs.select("v", "stands_for"))
            reached = both.groupBy("id").agg((F.count("*") / F.sum("stands_for")).alias("share")).where(F.col("share") >= recall)
            closed = reached.select("id", F.lit(False).alias("open"))
    # A text hangs together with all it matched; one link each and those between what it matched say the same with fewer rows.
    met = matches.groupBy("u").agg(F.min("v").alias("least"), F.collect_set("v").alias("all"))  # at most a few for each trie
    edges = met.select("u", F.col("least").alias("v")).union(met.select(F.explode("all").alias("u"), "least").where("u <> least").distinct())
    return components(edges)


# -- exact verification --------------------------------------------------------------------------


def _verify(key: np.ndarray, side: np.ndarray, across: bool, sets: list[np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of each text and the least text that it hangs together with, over pairs within a block or across two."""
    n = len(key)
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n), sizes)
    _, shingle, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[shingle] > 1
    owner, shingle = owner[shared], shingle[shared]
    order = np.argsort(shingle, kind="stable")
    owner, shingle = owner[order], shingle[order]
    _, shingle = np.unique(shingle, return_inverse=True)
    common = np.zeros((n, n), np.float32)
    width = 4096
    for a in range(0, int(shingle[-1]) + 1 if len(shingle) else 0, width):
        lo, hi = np.searchsorted(shingle, [a, a + width])
        here = np.zeros((n, width), np.float32)
        here[owner[lo:hi], shingle[lo:hi] - a] = 1
        common += here @ here.T
    linked = common >= threshold * (sizes[:, None] + sizes[None, :] - common) - 1e-6
    np.fill_diagonal(linked, False)
    if across:
        linked &= side[:, None] != side[None, :]
    root = np.arange(n)
    while True:  # the least index over neighbours, followed to its end
        to = np.minimum(root, np.where(linked, root[None, :], n).min(axis=1, initial=n))
        to = np.minimum(to, to[to])
        if (to == root).all():
            return linked.sum(axis=1), key[root]
        root = to


def _planned(sets: DataFrame, sizes: DataFrame, threshold: float, block: int, block_shingles: int) -> tuple[DataFrame, DataFrame]:
    """The members (id, root, band, own) and the plan (root, parts, whole, texts) of sets. ``sizes`` is id, n (different shingles).

    A set that fits a block is verified as a whole. A larger one is dealt into classes
    of size (number of shingles) whose ends differ by the threshold, so that links lead
    to the same or the next class (band) only, and each class into blocks (own).
    """
    members = sets.select(F.col("node").alias("id"), "root").join(sizes, "id")
    members = members.withColumn("band", F.floor(F.log("n") / (-math.log(threshold) * (1 + 1e-9))).cast("int"))

    def parts(n: Column, m: Column) -> Column:
        return F.least(n, F.greatest(F.ceil(n / block), F.ceil(m / block_shingles))).cast("int")

    bands = members.groupBy("root", "band").agg(F.count("*").alias("texts"), F.sum("n").alias("shingles"))
    bands = bands.withColumn("entry", F.struct("band", parts(F.col("texts"), F.col("shingles")).alias("parts")))
    plan = bands.groupBy("root").agg(F.map_from_entries(F.collect_list("entry")).alias("parts"), parts(F.sum("texts"), F.sum("shingles")).alias("whole"), F.sum("texts").alias("texts"))
    plan = spool(plan, "plan")
    dealt = members.join(plan.select("root", "parts", "whole"), "root")
    return dealt.select("id", "root", "band", "whole", F.pmod(F.xxhash64("id"), F.col("parts")[F.col("band")]).cast("int").alias("own")), plan


def _packed(texts: DataFrame) -> DataFrame:
    """(root, band, own, ids, sizes, shingles): a row for each block of ``texts`` (with id, shingles). Near copies have most shingles in common, so a block is compressed as one."""

    def run(table: pa.Table) -> pa.Table:
        raw = table.column("shingles").to_pylist()
        whole = zstandard.ZstdCompressor(level=3).compress(b"".join(raw))
        one = table.slice(0, 1).select(["root", "band", "own"])
        lists = {"ids": (table.column("id").to_pylist(), pa.int64()), "sizes": ([len(x) // 8 for x in raw], pa.int32())}
        for name, (values, kind) in lists.items():
            one = one.append_column(name, pa.array([values], pa.list_(kind)))
        return one.append_column("shingles", pa.array([whole], pa.binary()))

    return texts.groupBy("root", "band", "own").applyInArrow(run, "root long, band int, own int, ids array<long>, sizes array<int>, shingles binary")


def _units(blocks: DataFrame, plan: DataFrame) -> DataFrame:
    """The rows of ``blocks`` with unit, second, across: every two blocks whose texts can be linked meet in one unit, as every block does with itself."""
    own, band = F.col("own"), F.col("band")

    def units(other: Column, low: Column, first, second, is_second, across) -> Column:
        some = F.when(other > 0, F.sequence(F.lit(0), other - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(some, lambda o: F.struct(F.xxhash64("root", low, first(o), second(o)).alias("unit"), is_second(o).alias("second"), across(o).alias("across")))

    yes, no = F.lit(True), F.lit(False)
    within = units(F.col("parts")[band], 2 * band, lambda o: F.least(own, o), lambda o: F.greatest(own, o), lambda o: own > o, lambda o: own != o)
    above = units(F.coalesce(F.col("parts")[band + 1], F.lit(0)), 2 * band + 1, lambda o: own, lambda o: o, lambda o: no, lambda o: yes)
    below = units(F.coalesce(F.col("parts")[band - 1], F.lit(0)), 2 * band - 1, lambda o: o, lambda o: own, lambda o: yes, lambda o: yes)
    met = blocks.join(plan.select("root", "parts"), "root").withColumn("u", F.explode(F.concat(within, above, below)))
    return met.select("ids", "sizes", "shingles", "u.*")


def classes(docs: DataFrame, size: int = SHINGLE, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """doc_id, row_key, class_id, n_links, class_rows, lead (the row_key that leads the class) for every row of ``docs``."""
    signed = spool(signatures(docs, size), "signatures")
    texts = signed.where("key is not null").groupBy("key").agg(*(F.first(c).alias(c) for c in ("labels", "sketch")), F.min("row_key").alias("row_key"))
    texts = spool(texts.withColumn("id", F.monotonically_increasing_id()), "texts")
    sets = spool(candidate_sets(texts.select("id", "labels", "sketch"), threshold, recall), "sets")

    # Candidates grow with the corpus, so they are shuffled at every size and never broadcast.
    members = texts.join(sets.select(F.col("node").alias("id")), "id", "left_semi").select("id", "key", "row_key")
    texts_of = docs.select(row_key().alias("row_key"), "text").join(members.hint("merge"), "row_key").select("id", "key", "text")

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, off in pieces(batches):
            codes, at, keys = _scan(data, off, size)
            own = [k == m for k, m in zip(keys, part.column(1).to_pylist(), strict=True)]
            raw = [np.unique(codes[a:b]).tobytes() if ok else b"" for a, b, ok in zip(at[:-1], at[1:], own, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(raw, pa.binary())], ["id", "shingles"]).filter(pa.array(own, pa.bool_()))

    found = spool(texts_of.mapInArrow(shingled, "id long, shingles binary").dropDuplicates(["id"]), "shingles")
    sizes = found.select("id", (F.octet_length("shingles") / 8).cast("long").alias("n"))
    dealt, plan = _planned(sets, sizes, threshold, block, block_shingles)
    shares = max(1, -(-plan.where("whole = 1").agg(F.coalesce(F.sum("texts"), F.lit(0))).first()[0] // block))

    def verify(table: pa.Table) -> pa.Table:
        roots, ids, raw = table.column("root").to_numpy(), table.column("id").to_numpy(), table.column("shingles").to_pylist()
        links, to = np.zeros(len(ids), np.int64), ids.copy()
        order = np.argsort(roots, kind="stable")
        for one in np.split(order, np.flatnonzero(np.diff(roots[order])) + 1):
            links[one], to[one] = _verify(ids[one], np.zeros(len(one), bool), False, [np.frombuffer(raw[i], np.uint64) for i in one], threshold)
        return pa.table({"id": ids, "links": links, "to": to})

    def verify_blocks(table: pa.Table) -> pa.Table:
        ids, side, held = [], [], []
        for row in table.to_pylist():
            data = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["shingles"]), np.uint64)
            held += np.split(data, np.cumsum(row["sizes"])[:-1])
            ids += row["ids"]
            side += [row["second"]] * len(row["ids"])
        ids = np.array(ids, np.int64)
        links, to = _verify(ids, np.array(side), table.column("across")[0].as_py(), held, threshold)
        return pa.table({"id": ids, "links": links.astype(np.int64), "to": to})

    result = "id long, links long, to long"
    small = dealt.where("whole = 1").select("id", "root", F.pmod("root", F.lit(shares)).alias("task"))
    checked = small.join(found, "id").groupBy("task").applyInArrow(verify, result)
    # A large set is shuffled as blocks: for k texts the square of k / BLOCK rows, and never a text by itself.
    blocks = spool(_packed(dealt.where("whole > 1").select("id", "root", "band", "own").join(found, "id")), "blocks")
    checked = checked.unionByName(_units(blocks, plan).groupBy("unit").applyInArrow(verify_blocks, result))
    checked = spool(checked, "links")
    joined = components(checked.where("id <> to").select(F.col("id").alias("u"), F.col("to").alias("v")))
    links = checked.groupBy("id").agg(F.sum("links").alias("n_links")).where("n_links > 0")
    # Tables of their own, so that Spark can split the partition of a text or class that very many rows share.
    name = texts.select(F.col("id").alias("root"), F.col("key").alias("root_key"))
    known = links.join(joined, links.id == joined.node).select("id", "n_links", "root").join(name, "root").join(texts.select("id", "key"), "id")
    known = spool(known.select("key", "n_links", "root_key"), "known")
    rows = signed.select("doc_id", "row_key", "key").join(known.hint("merge"), "key", "left")
    rows = spool(rows.select("doc_id", "row_key", F.coalesce("root_key", "key").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links")), "rows")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row_key"))
    ends = spool(rows.where("root is not null").groupBy("root").agg(first.alias("lead"), F.count("*").alias("class_rows")), "classes")
    return rows.join(ends.hint("merge"), "root", "left").select(
        "doc_id",
        "row_key",
        F.when(F.col("lead").isNull(), F.col("doc_id")).otherwise(F.col("lead.doc_id")).alias("class_id"),
        "n_links",
        F.coalesce("class_rows", F.lit(1)).alias("class_rows"),
        F.coalesce("lead.row_key", "row_key").alias("lead"),
    )


def near_classes(docs: DataFrame, **options: float) -> DataFrame:
    """doc_id, class_id (the least doc_id of the class), n_links, class_rows for every row of ``docs``."""
    return classes(docs, **options).select("doc_id", "class_id", "n_links", "class_rows")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that lead their class, with their own columns; of equal rows one stays."""
    leads = classes(docs).where(F.col("row_key") == F.col("lead")).select("lead").distinct()
    keyed = docs.select(F.struct("*").alias("row"), row_key().alias("id"))
    return keyed.join(leads.hint("merge"), F.col("id") == F.col("lead"), "left_semi").dropDuplicates(["id"]).select("row.*")
