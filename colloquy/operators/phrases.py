"""Phrases of any number, found in one pass over each text, and n-grams that recur without being among them.

``code_by_phrases`` takes its codebook as a table. Of a small one, tasks get an
automaton over characters (Aho-Corasick) that meets every phrase at once; the plan is the
same for ten phrases and for ten thousand. A large one stays a table, and stretches of
texts that may be in it are joined with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions import clean
from colloquy.operators.coding import QUOTE_CHARS, lowered
from colloquy.shared import shared_path

#: Characters of phrases that an automaton may have; it takes some 50 bytes for each.
SHARD_CHARS = 2_000_000
_HITS = "array<struct<code:string,hits:int,place:int>>"


def phrase_table(codebook: DataFrame, code: str = "code", keywords: str = "keywords") -> DataFrame:
    """(code, phrase) from comma-separated keywords: trimmed, in lower case, without quotation marks and blanks."""
    one = F.explode(F.split(F.regexp_replace(lowered(F.col(keywords)), '"', ""), ",")).alias("phrase")
    return codebook.select(F.col(code).alias("code"), one).withColumn("phrase", F.trim("phrase")).where("phrase <> ''").distinct()


def _found(rows: DataFrame, phrases: list[tuple[str, list[str]]]) -> DataFrame:
    """``rows`` with what the phrases find in ``_low`` put behind ``_hits``."""
    given = rows.sparkSession.sparkContext.broadcast(phrases)  # at most about SHARD_CHARS characters
    made: list[ahocorasick.Automaton] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            built = ahocorasick.Automaton()
            for k, (phrase, _) in enumerate(given.value):
                built.add_word(phrase, k)
            built.make_automaton()
            made.append(built)
        for b in batches:
            low, before = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("_low", "_hits"))
            after = []
            for text, hits in zip(low, before, strict=True):
                first: dict[int, int] = {}
                for end, k in made[0].iter(text) if text else ():
                    if k not in first:
                        first[k] = end - len(given.value[k][0]) + 2
                codes: dict[str, list[int]] = {}
                for k, place in first.items():
                    for code in given.value[k][1]:
                        at = codes.setdefault(code, [0, place])
                        at[0] += 1
                        at[1] = min(at[1], place)
                after.append(hits + [{"code": c, "hits": n, "place": p} for c, (n, p) in codes.items()])
            at = b.schema.get_field_index("_hits")
            yield b.set_column(at, b.schema.field(at), pa.array(after, b.schema.field(at).type))

    return rows.mapInArrow(run, rows.schema)


def phrase_hits(posts: DataFrame, phrases: DataFrame, text: str = "text", shard_chars: int = SHARD_CHARS) -> DataFrame:
    """``posts`` with ``_hits``: for each code with a phrase in the text the number of its phrases there and the place of the first.

    A table of up to ``shard_chars`` characters is an automaton in each task; a larger one
    is joined with what a filter of fixed size lets through.
    """
    codes = phrases.where("phrase <> ''").groupBy("phrase").agg(F.array_sort(F.collect_set("code")).alias("codes"))
    total = codes.agg(F.sum(F.length("phrase") + 1)).first()[0] or 0
    rows = posts.withColumn("_low", lowered(F.coalesce(F.col(text), F.lit(""))))
    if total > shard_chars:
        return _joined(rows, codes)
    rows = rows.withColumn("_hits", F.array().cast(_HITS))
    of = [(r.phrase, list(r.codes)) for r in codes.collect()]
    return (_found(rows, of) if of else rows).drop("_low")


# Phrases and stretches of texts meet on hashes: sums of characters times powers of an odd
# number, so that one running sum of a text gives the hash of any stretch of it.
_BASE, _MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
#: Bits of the filter for each phrase, how many of them it sets, and the most bits of a filter (32 MB).
_BITS, _PROBES, _MOST_BITS = 16, 3, 1 << 28
#: Longer phrases are first looked for by a beginning, as long as the power of two below.
_WHOLE = 16
_ROWS_AT_ONCE = 256


class _Hashes:
    """Hashes of stretches of one running text."""

    def __init__(self, texts: list[str]) -> None:
        import numpy as np

        of = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        up, down = (np.full(len(of) + 1, b, np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
        up[0] = down[0] = 1
        self.back = np.cumprod(down, dtype=np.uint64)  # products and sums are modulo 2 ** 64
        self.sums = np.zeros(len(of) + 1, np.uint64)
        np.cumsum((of + np.uint64(1)) * np.cumprod(up, dtype=np.uint64)[:-1], dtype=np.uint64, out=self.sums[1:])

    def of(self, starts, sizes):
        """Hashes of stretches; ``sizes`` is a number or one for each start."""
        import numpy as np

        h = (self.sums[starts + sizes] - self.sums[starts]) * self.back[starts] + np.uint64(_MIX) * np.asarray(sizes).astype(np.uint64)
        for _ in range(2):
            h = (h ^ h >> np.uint64(32)) * np.uint64(_MIX)
        return h ^ h >> np.uint64(29)


def _bits(hashes, bits: int, probe: int):
    import numpy as np

    step = (hashes >> np.uint64(21) | hashes << np.uint64(43)) | np.uint64(1)
    return ((hashes + np.uint64(probe) * step) & np.uint64(bits - 1)).astype(np.int64)


def _beginning(size: int) -> int:
    return size if size <= _WHOLE else 1 << (size.bit_length() - 1)


def _filter(codes: DataFrame, bits: int) -> bytes:
    """A Bloom filter of phrases and their beginnings. Each task makes its own and hands it on in pieces; pieces are laid over each other."""
    import numpy as np

    piece = min(bits // 8, _CHUNK)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(bits // 8, np.uint8)
        for b in batches:
            some = b.column(0).to_pylist()
            sizes = np.array([len(p) for p in some], np.int64)
            starts = np.concatenate(([0], np.cumsum(sizes)[:-1])) if some else sizes
            hashes = _Hashes(some)
            for n in (sizes, np.array([_beginning(len(p)) for p in some], np.int64)):
                of = hashes.of(starts, n)
                for k in range(_PROBES):
                    at = _bits(of, bits, k)
                    np.bitwise_or.at(held, at >> 3, (1 << (at & 7)).astype(np.uint8))
        flat = held.reshape(-1, piece)
        used = np.flatnonzero(flat.any(1))
        for k in used:
            yield pa.RecordBatch.from_arrays([pa.array([int(k)], pa.int32()), pa.array([flat[k].tobytes()], pa.binary())], ["piece", "bits"])

    def lay(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(piece, np.uint8)
        for b in pdf["bits"]:
            total |= np.frombuffer(b, np.uint8)
        return pd.DataFrame({"piece": [pdf["piece"].iloc[0]], "bits": [total.tobytes()]})

    made = bytearray(bits // 8)
    for r in codes.select("phrase").mapInArrow(build, "piece int, bits binary").groupBy("piece").applyInPandas(lay, "piece int, bits binary").toLocalIterator():
        made[r.piece * piece : (r.piece + 1) * piece] = r.bits
    return bytes(made)


def _met(rows: DataFrame, made: bytes, sizes: list[int]) -> DataFrame:
    """(_key, phrase, place): stretches of ``_low`` that may be phrases of ``sizes``, each with its first place in a text."""
    import numpy as np

    given = rows.sparkSession.sparkContext.broadcast(made)  # at most _MOST_BITS bits, however many phrases there are
    longer: dict[int, list[int]] = {}
    for n in sizes:
        longer.setdefault(_beginning(n), []).append(n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.frombuffer(given.value, np.uint8)

        def known(hashes: _Hashes, starts, size: int):
            of = hashes.of(starts, size)
            for k in range(_PROBES):
                at = _bits(of, len(held) * 8, k)
                ok = (held[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
                starts, of = starts[ok], of[ok]
            return starts

        for batch in batches:
            for first in range(0, batch.num_rows, _ROWS_AT_ONCE):
                b = batch.slice(first, _ROWS_AT_ONCE)
                keys, texts = b.column(0), b.column(1).to_pylist()
                ends = np.cumsum([len(t) for t in texts])
                hashes, every = _Hashes(texts), np.arange(ends[-1])
                left = np.repeat(ends, [len(t) for t in texts]) - every
                places: dict[tuple[int, str], int] = {}
                for start, more in longer.items():
                    begun = known(hashes, every[left >= start], start)
                    for size in more:
                        at = begun[left[begun] >= size]
                        at = at if size == start else known(hashes, at, size)
                        of = np.searchsorted(ends, at, "right")
                        for i, k in zip(of.tolist(), (at - ends[of]).tolist(), strict=True):
                            k += len(texts[i])
                            places.setdefault((i, texts[i][k : k + size]), k + 1)
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array([i for i, _ in places], pa.int32())), pa.array([p for _, p in places], pa.string()), pa.array(places.values(), pa.int32())], ["_key", "phrase", "place"]
                )

    return rows.select("_key", "_low").mapInArrow(run, "_key binary, phrase string, place int")


def _joined(rows: DataFrame, codes: DataFrame) -> DataFrame:
    """``rows`` with ``_hits`` from a table of phrases of any length: one pass over the texts, whose candidates are joined with the table, exactly.

    The filter only decides what is joined. Hits are put together by a digest of the
    text, so copies share theirs.
    """
    path = shared_path(rows.sparkSession, "phrases")
    codes.write.parquet(path)
    codes = rows.sparkSession.read.schema(codes.schema).parquet(path)
    n = codes.count()
    sizes = sorted(r.n for r in codes.select(F.length("phrase").alias("n")).distinct().collect())  # as many as there are lengths of phrases
    made = _filter(codes, min(_MOST_BITS, max(1 << 16, 1 << (_BITS * n - 1).bit_length())))
    keyed = rows.withColumn("_key", F.unhex(F.sha2("_low", 256)))
    real = _met(keyed, made, sizes).join(codes, "phrase").select("_key", "phrase", "place", F.explode("codes").alias("code"))
    once = real.repartition("_key").groupBy("_key", "code", "phrase").agg(F.min("place").alias("place"))
    of = once.groupBy("_key", "code").agg(F.count("*").cast("int").alias("hits"), F.min("place").alias("place"))
    hits = of.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("code", "hits", "place"))).alias("_hits"))
    full = keyed.drop("_low").join(hits, "_key", "left").drop("_key")
    return full.withColumn("_hits", F.coalesce("_hits", F.array().cast(_HITS)))


def code_by_phrases(posts: DataFrame, phrases: DataFrame, text: str = "text", evidence: bool = True, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """``posts`` with ``deductive_codes`` as ``coding.code_by_rules`` gives them, codes in their order as text; ``phrases`` is (code, phrase).

    A phrase counts wherever the text in lower case holds it. Null texts hold none; a
    phrase of several codes counts for each, one that is repeated counts once.
    """
    level = lambda h: F.when(h["hits"] >= 3, "HIGH").when(h["hits"] == 2, "MED").otherwise("LOW")
    quote = lambda h: F.substring(F.col(text), h["place"], F.lit(QUOTE_CHARS)) if evidence else F.lit(None).cast("string")
    rows = phrase_hits(posts, phrases, text, shard_chars)
    made = F.transform(F.array_sort("_hits"), lambda h: F.struct(h["code"].alias("code"), quote(h).alias("evidence_quote"), level(h).alias("confidence")))
    return rows.withColumn("deductive_codes", made).drop("_hits")


# -- n-grams ---------------------------------------------------------------------------------------


#: Counters of a sketch and how many of them an n-gram has. A sketch is as large whatever it counts.
WIDTH, ROWS = 1 << 20, 3
_CHUNK = 1 << 14
_SALT = "colloquy"


def _tokens(text: str) -> Column:
    return F.filter(F.split(clean.normalised_text(F.col(text)), " "), lambda w: F.length(w) > 2)


def _ngrams(size: int, tokens: str = "_t") -> Column:
    """Distinct n-grams of a text, as texts."""
    every = F.transform(F.sequence(F.lit(1), F.size(tokens) - size + 1), lambda i: F.array_join(F.slice(tokens, i, size), " "))
    return F.when(F.size(tokens) >= size, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))


def _cells(gram: Column) -> list[Column]:
    return [F.pmod(F.xxhash64(gram, F.lit(f"{_SALT}{k}")), F.lit(WIDTH)).cast("int") for k in range(ROWS)]


def count_sketch(grams: DataFrame, most: int) -> list[bytes]:
    """A count-min sketch of column ``gram`` (a row for each post that has it), one byte a counter, which stops at ``most`` (at most 255).

    Each task makes its own and hands it on in pieces; pieces are added up. A counter is
    never less than the true count of what it stands for, up to ``most``.
    """
    import numpy as np

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((ROWS, WIDTH), np.int64)
        for b in batches:
            for k in range(ROWS):
                held[k] += np.bincount(b.column(k).to_numpy(), minlength=WIDTH)
        flat = np.minimum(held, most).astype(np.uint8).reshape(-1, _CHUNK)
        used = np.flatnonzero(flat.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array([flat[i].tobytes() for i in used], pa.binary())], ["chunk", "counters"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(_CHUNK, np.int64)
        for c in pdf["counters"]:
            total += np.frombuffer(c, np.uint8)
        return pd.DataFrame({"chunk": [pdf["chunk"].iloc[0]], "counters": [np.minimum(total, most).astype(np.uint8).tobytes()]})

    rows = grams.select(*(c.alias(f"c{k}") for k, c in enumerate(_cells(F.col("gram")))))
    made = rows.mapInArrow(build, "chunk int, counters binary").groupBy("chunk").applyInPandas(add, "chunk int, counters binary")
    flat = [bytes(_CHUNK)] * (ROWS * WIDTH // _CHUNK)
    for r in made.collect():  # ROWS * WIDTH bytes, whatever was counted
        flat[r.chunk] = bytes(r.counters)
    return [b"".join(flat[k * WIDTH // _CHUNK : (k + 1) * WIDTH // _CHUNK]) for k in range(ROWS)]


def _frequent(df: DataFrame, sketch: list[bytes], grams: list[str], least: int) -> DataFrame:
    """Rows of ``df`` all whose ``grams`` (columns) the sketch allows at least ``least`` posts."""
    import numpy as np

    given = df.sparkSession.sparkContext.broadcast(sketch)  # ROWS * WIDTH bytes
    cells = {f"_c{i}_{k}": c for i, g in enumerate(grams) for k, c in enumerate(_cells(F.col(g)))}
    names, kept = list(cells), df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [np.frombuffer(s, np.uint8) for s in given.value]
        for b in batches:
            ok = np.ones(b.num_rows, bool)
            for name in names:
                ok &= rows[int(name[-1])][b.column(b.schema.get_field_index(name)).to_numpy()] >= least
            yield b.select(kept).filter(pa.array(ok))

    return df.withColumns(cells).mapInArrow(run, df.schema)


def recurring_ngrams(posts: DataFrame, key: str, text: str = "text", sizes: tuple[int, ...] = (2, 3, 4), least_posts: int = 3) -> DataFrame:
    """(phrase, size, n_posts, first_post): n-grams of ``sizes`` words in at least ``least_posts`` posts, words of one or two letters left out.

    An n-gram recurs only if both n-grams of one word less inside it do. Level by level a
    sketch of fixed size counts what the level before allows, and only n-grams that
    every sketch allows are shuffled and counted exactly; nothing that recurs is lost.
    """
    path = shared_path(posts.sparkSession, "tokens")  # every pass reads them again
    tokens = posts.select(F.col(key).alias("_key"), _tokens(text).alias("_t"))
    tokens.write.parquet(path)
    tokens = posts.sparkSession.read.schema(tokens.schema).parquet(path)
    most = min(255, least_posts)
    sketches: dict[int, list[bytes]] = {}
    found = None

    def allowed(size: int) -> DataFrame:
        """(_key, gram, _head, _tail) of a size, as far as the sketches of smaller sizes allow."""
        rows = tokens.select("_key", F.explode(_ngrams(size)).alias("gram"))
        if size == 1:
            return rows
        ends = rows.withColumns({"_head": F.regexp_replace("gram", " [^ ]+$", ""), "_tail": F.regexp_replace("gram", "^[^ ]+ ", "")})
        return _frequent(ends, sketches[size - 1], ["_head", "_tail"], most)

    for size in range(1, max(sizes) + 1):
        sketches[size] = count_sketch(allowed(size), most)
        if size in sizes:
            rows = _frequent(allowed(size).select("_key", "gram"), sketches[size], ["gram"], most)
            counted = rows.groupBy(F.col("gram").alias("phrase")).agg(F.lit(size).alias("size"), F.count("*").alias("n_posts"), F.min("_key").alias("first_post")).where(F.col("n_posts") >= least_posts)
            found = counted if found is None else found.unionByName(counted)
    return found


def emergent_ngrams(posts: DataFrame, known: DataFrame, key: str, text: str = "text", codes: str = "deductive_codes", sizes: tuple[int, ...] = (2, 3, 4), least_posts: int = 3, most_codes: int = 1) -> DataFrame:
    """Recurring n-grams of posts with few codes that are not among the ``known`` (phrase)."""
    rows = recurring_ngrams(posts.where(F.size(codes) <= most_codes), key, text, sizes, least_posts)
    return rows.join(known.select("phrase").distinct(), "phrase", "left_anti")


def unsafe_entities(found: DataFrame, safe: DataFrame, entity: str = "entity", name: str = "name") -> DataFrame:
    """Rows of ``found`` whose entity is no safe name, whatever its case; the names are a table of any length."""
    names = safe.select(lowered(F.col(name)).alias("_name")).distinct()
    return found.join(names, lowered(F.col(entity)) == F.col("_name"), "left_anti")
