"""Toxicity by gradient-boosted trees over dense features, calibrated by isotonic regression.

Fitting uses a sample of labelled rows of at most ``sample_rows``; rows whose
crc32(doc_id as text) mod 4 is 2 are never among them. The sample gives the
lexicon (words, and stems of 4 to 6 letters, that mark label 1 far beyond
chance), most of it the trees, and the rest the calibration. Only the text
enters a score: densities of lexicon words, plain and disguised, how close they
stand to a second-person word, capitals, punctuation and disguise rates.

Edge cases: a null text counts as empty and gets a score too, labels without a
text or value are left out, a doc_id labelled more than once has its highest
label, with too few labels for trees the score follows the lexicon density
alone (0 for all without a lexicon), terms with the same evidence are taken in
alphabetical order, repeated rows are rows of their own, extra columns are
ignored, an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.llm.storage import spool
from colloquy.llm.textscan import pieces, range_codes, shingles, words

SAMPLE_ROWS = 20_000
MOST_TERMS = 2_000
EVIDENCE = 12.0
FOLDS = 5
TOXIC_FROM = 0.3
NEAR_WORDS = 5
STEMS = (4, 5, 6)

# Second-person words.
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split()

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MARK = np.zeros(256, bool)
_MARK[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
_SHOUT = np.zeros(256, bool)
_SHOUT[[33, 63]] = True
_DISGUISE = _LOWER.copy()
for _a, _b in zip("013457@$!", "oieastasi", strict=True):
    _DISGUISE[ord(_a)] = ord(_b)
_SIGN = np.zeros(256, bool)
_SIGN[[ord(c) for c in "013457@$!"]] = True

FEATURES = ("log_words", "hits", "density", "best_weight", "disguised", "near_second_person", "second_person_rate", "capitals", "capital_words", "marks", "shouts", "disguise_rate", "mean_word")


@dataclass(frozen=True)
class Model:
    lexicon: dict[str, float]
    trees: GBTClassificationModel | None
    levels: tuple[tuple[float, float], ...]


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


# -- features, in tasks --------------------------------------------------------------------------


def _lowered(data: np.ndarray) -> np.ndarray:
    low = _LOWER[data]
    if len(low) > 1:  # capitals of the Latin-1 letters are the second byte after 0xC3
        at = np.flatnonzero((low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[1:] != 0x97)) + 1
        low[at] += 32
    return low


def _codes(texts: list[str]) -> np.ndarray:
    """The codes of these strings."""
    raw = [t.encode() for t in texts]
    off = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    return range_codes(np.frombuffer(b"".join(raw), np.uint8), off[:-1], off[1:])


class Lexicon:
    """Terms by byte length of what is compared: whole words, and stems (written with a final ``*``)."""

    def __init__(self, terms: dict[str, float]):
        whole = [t for t in terms if not t.endswith("*")]
        self.tables = [(0, *self._table(whole, [terms[t] for t in whole]))]
        stems = [t for t in terms if t.endswith("*")]
        for size in sorted({len(t[:-1].encode()) for t in stems}):
            same = [t for t in stems if len(t[:-1].encode()) == size]
            self.tables.append((size, *self._table([t[:-1] for t in same], [terms[t] for t in same])))

    @staticmethod
    def _table(texts: list[str], weights: list[float]) -> tuple[np.ndarray, np.ndarray]:
        codes = _codes(texts) if texts else np.zeros(0, np.uint64)
        order = np.argsort(codes)
        return codes[order], np.array(weights, float)[order]

    def weights(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The weight of the heaviest term for each word, or 0."""
        out = np.zeros(len(start))
        for size, codes, weight in self.tables:
            if not len(codes):
                continue
            at = np.arange(len(start)) if size == 0 else np.flatnonzero(end - start >= size)
            code = range_codes(data, start[at], end[at] if size == 0 else start[at] + size)
            found = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
            hit = codes[found] == code
            out[at[hit]] = np.maximum(out[at[hit]], weight[found[hit]])
        return out


def _runs(mask: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of ``mask``, which no row boundary joins."""
    return words(np.where(mask, 97, 32).astype(np.uint8), off)


def features(data: np.ndarray, off: np.ndarray, lexicon: Lexicon, second: np.ndarray) -> np.ndarray:
    n = len(off) - 1
    low = _lowered(data)
    start, end, first = _runs(_LETTER[data], off)
    row = np.repeat(np.arange(n), np.diff(first))
    weight = lexicon.weights(low, start, end)
    code = range_codes(low, start, end)
    you = second[np.minimum(np.searchsorted(second, code), len(second) - 1)] == code
    near = np.zeros(len(row), bool)
    hit = np.flatnonzero(weight > 0)
    for step in range(-NEAR_WORDS, NEAR_WORDS + 1):
        to = hit + step
        ok = (to >= 0) & (to < len(row))
        ok[ok] = (row[to[ok]] == row[hit[ok]]) & you[to[ok]]
        near[hit[ok]] = True

    # Disguised words: letters with digits or signs among them that stand for letters.
    s, e, f = _runs(_LETTER[data] | _SIGN[data], off)
    signs = np.concatenate([[0], np.cumsum(_SIGN[data])])
    letters = np.concatenate([[0], np.cumsum(_LETTER[data])])
    mixed = (signs[e] > signs[s]) & (letters[e] - letters[s] >= 2)
    inner = mixed & ~(_SIGN[data[e - 1]] & (signs[e] - signs[s] == 1)) if len(e) else mixed  # "word!" is no disguise
    ds, de, drow = s[inner], e[inner], np.repeat(np.arange(n), np.diff(f))[inner]
    disguised = lexicon.weights(_DISGUISE[low], ds, de) > 0

    def per_row(rows: np.ndarray, values: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(rows, weights=values, minlength=n)[:n]

    def bytes_per_row(mask: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(mask)])[off])

    n_words, n_bytes = np.maximum(np.diff(first), 1), np.maximum(np.diff(off), 1)
    hits = per_row(row, (weight > 0).astype(float)) + per_row(drow, disguised.astype(float))
    best = np.zeros(n)
    np.maximum.at(best, row, weight)
    capital = np.concatenate([[0], np.cumsum(_UPPER[data])])
    shouted = (capital[end] - capital[start] == end - start) & (end - start > 1)
    n_letters = np.maximum(bytes_per_row(_LETTER[data]), 1)
    return np.stack(
        [
            np.log1p(np.diff(first)),
            np.log1p(hits),
            hits / n_words,
            best,
            per_row(drow, disguised.astype(float)),
            per_row(row, near.astype(float)),
            per_row(row, you.astype(float)) / n_words,
            bytes_per_row(_UPPER[data]) / n_letters,
            per_row(row, shouted.astype(float)) / n_words,
            bytes_per_row(_MARK[data]) / n_bytes,
            bytes_per_row(_SHOUT[data]) / n_bytes,
            per_row(drow) / n_words,
            n_letters / n_words,
        ],
        axis=1,
    )


def features_of(text: Column, lexicon: dict[str, float]) -> Column:
    """An array of ``FEATURES``; only the text goes to Python."""

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        terms, second = Lexicon(lexicon), np.sort(_codes(SECOND_PERSON))
        for column in columns:
            batch = pa.RecordBatch.from_arrays([column], ["text"])
            parts = [features(data, off, terms, second) for _, data, off in pieces([batch])]
            x = np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(FEATURES)), pa.array(x.ravel()))

    return F.arrow_udf(run, T.ArrayType(T.DoubleType()))(text)


# -- fitting -------------------------------------------------------------------------------------


def labelled_sample(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, text, toxic, part (0 to 9) of at most about ``sample_rows`` labelled rows that are not held out."""
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = sample_rows / max(1, known.count())
    bucket = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000))
    chosen = known.where(bucket < int(1_000_000 * min(1.0, share))).withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(10)))
    # The sample's size is bounded by ``sample_rows``, so it can be sent to every task.
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def sample_terms(sample: DataFrame) -> DataFrame:
    """(toxic, part, terms) of the sample; of texts with the same least shingle hash one stays, since near copies would make their rare words look telling."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, off in pieces(batches):
            start, end, first = words(data, off)
            hashes, at = shingles(range_codes(data, start, end), first, 5)
            some = np.diff(at) > 0
            sketch = np.zeros(len(some), np.uint64)
            if some.any():
                sketch[some] = np.minimum.reduceat(hashes, at[:-1][some])
            terms = []
            for text in part.column(2).to_pylist():
                found = set(re.findall(r"[^\W\d_]{3,}", (text or "").lower()))
                terms.append([*found, *{w[:k] + "*" for w in found for k in STEMS if len(w) >= k}])
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sketch.view(np.int64)), pa.array(terms, pa.list_(pa.string()))], ["toxic", "part", "sketch", "terms"])

    kinds = dict(sample.dtypes)
    rows = sample.select("toxic", "part", "text").mapInArrow(run, f"toxic {kinds['toxic']}, part {kinds['part']}, sketch long, terms array<string>")
    return rows.dropDuplicates(["sketch"])


def learn_lexicon(rows: DataFrame) -> dict[str, float]:
    """Terms of documents with label 1, by how far their share of label 1 exceeds chance."""
    total = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("p")).first()
    lexicon: dict[str, float] = {}
    if not 0 < total.p < total.n:
        return lexicon
    rate = total.p / total.n
    counts = rows.select("toxic", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("toxic").alias("p"), F.count("*").alias("n")).where("p >= 3")
    share = F.col("p") / F.col("n")
    no = F.when(F.col("n") > F.col("p"), (F.col("n") - F.col("p")) * F.log((1 - share) / (1 - rate))).otherwise(0.0)
    scored = counts.where(share > min(5 * rate, (1 + rate) / 2)).withColumn("evidence", F.col("p") * F.log(share / rate) + no)
    # At most MOST_TERMS rows reach the driver, whatever the size of the input.
    best = scored.where(F.col("evidence") >= EVIDENCE).orderBy(F.desc("evidence"), "term").limit(MOST_TERMS)
    for r in best.select("term", F.log((F.col("p") + 0.5) / (F.col("n") - F.col("p") + 0.5) * (1 - rate) / rate).alias("w")).collect():
        lexicon[r.term] = r.w
    return lexicon


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Each fold of the sample meets the lexicon of the other folds, so the trees see words as new texts bring them; the model's own lexicon comes from all."""
    sample = spool(labelled_sample(docs, labels, sample_rows), "labelled")
    terms = spool(sample_terms(sample), "terms")
    others = [learn_lexicon(terms.where(f"part % {FOLDS} <> {i}")) for i in range(FOLDS)]
    parts = [sample.where(f"part % {FOLDS} = {i}").select("toxic", "part", features_of(F.col("text"), lexicon).alias("features")) for i, lexicon in enumerate(others)]
    lexicon = learn_lexicon(terms)
    rows = spool(reduce(DataFrame.unionByName, parts), "features")
    rows = rows.select(F.col("toxic").cast("double").alias("label"), "part", array_to_vector("features").alias("vector")).coalesce(4)
    fit, rest = rows.where("part < 7"), rows.where("part >= 7")
    counts = {r.label: r["count"] for r in fit.groupBy("label").count().collect()}
    fewer = min(counts.get(0.0, 0), counts.get(1.0, 0))
    if fewer < 2:
        return Model(lexicon, None, ())
    leaf = max(1, min(10, fewer // 4))  # leaves of a few rows would follow noise
    trees = GBTClassifier(featuresCol="vector", labelCol="label", maxIter=20, maxDepth=3, stepSize=0.3, seed=7, minInstancesPerNode=leaf).fit(fit)
    graded = trees.transform(rest).select("label", vector_to_array("probability")[1].alias("p"))
    if graded.agg(F.count_distinct("label")).first()[0] < 2:
        return Model(lexicon, trees, ())
    iso = IsotonicRegression(featuresCol="p", labelCol="label").fit(graded)
    return Model(lexicon, trees, tuple(zip((float(x) for x in iso.boundaries), (float(x) for x in iso.predictions), strict=True)))


def _calibrated(p: Column, levels: tuple[tuple[float, float], ...]) -> Column:
    """Linear between the steps of the isotonic fit. A little of the raw probability keeps the order of equal steps."""
    if not levels:
        return p
    value = F.lit(levels[-1][1])
    for (x0, y0), (x1, y1) in zip(reversed(levels[:-1]), reversed(levels[1:]), strict=True):
        value = F.when(p < x1, y0 + (p - x0) * ((y1 - y0) / (x1 - x0)) if x1 > x0 else F.lit(y0)).otherwise(value)
    value = F.when(p <= levels[0][0], levels[0][1]).otherwise(value)
    return 0.98 * value + 0.02 * p


def _scored(rows: DataFrame, key: str, model: Model) -> DataFrame:
    """(key, score) of rows with features."""
    if model.trees is None:
        hits = F.col("features")[FEATURES.index("hits")]
        value = hits / (hits + 1)
    else:
        rows = model.trees.transform(rows.withColumn("vector", array_to_vector("features")))
        value = _calibrated(vector_to_array("probability")[1], model.levels)
    return rows.select(key, F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)).alias("score"))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    rows = _scored(docs.select("doc_id", features_of(F.col("text"), model.lexicon).alias("features")), "doc_id", model)
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))


def clean_documents(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that are not toxic, with their own columns."""
    rows = docs.select(F.struct("*").alias("row"), features_of(F.col("text"), model.lexicon).alias("features"))
    return _scored(rows, "row", model).where(F.col("score") < TOXIC_FROM).select("row.*")
