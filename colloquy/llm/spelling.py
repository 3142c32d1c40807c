"""Spelling variants: words that differ by one inserted, deleted or replaced letter, found in a frequency-vector trie.

Words are the letter runs of all documents, counted by Spark. Each word has a vector:
how many of its letters fall into each of ``GROUPS`` letter groups. The trie arranges
the words by these counts, one group a level. One edit makes at most one count larger
by one and at most one smaller by one, so a depth-first search for a word goes from
every node to the children with its own count and, while that budget of one each is
not spent, with one more and one less. The words at the leaves it reaches are compared
letter by letter.

The trie is never in one place. Level by level Spark counts the words under each
node; nodes of more than ``MEMBERS`` words are entered, the others become subtrees, and
a word goes with what is left of its budgets to all subtrees that it may reach.
Subtrees (and parts of one that still is too large at the last level, or that very many
words visit) are searched in tasks of bounded size, which answer with one row for each
word that visits, not with pairs.

Edge cases: null and empty texts have no words; in the text that decides about a
deletion, a null doc_id is the empty string; repeated rows count as often as they are
there; words may be of any length; of forms with equal counts the smallest by code
points is taken; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.storage import spool

LEAST_LENGTH, LEAST_COUNT, RATIO, ONE_IN = 6, 5, 5, 199
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GROUPS = 16
MEMBERS, VISITORS = 20_000, 60_000
#: States that one step of the search holds.
STATES = 1 << 16
#: Words longer than this are compared one by one.
WIDTH = 64

# Frequent letters are dealt first, forth and back, so that groups are about equally full; letters with accents follow by code point.
_GROUP = np.arange(256) % GROUPS
for _i, _c in enumerate("etaoinsrhldcumfpgwybvkxjqz"):
    _GROUP[ord(_c)] = _i % GROUPS if _i < GROUPS else 2 * GROUPS - 1 - _i


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): letter runs, some with a letter left out, of enough letters and occurrences."""
    low = F.translate(F.coalesce(F.col("text"), F.lit("")), UPPER, LOWER)
    # Shorter runs can't become words; a run is maximal, whatever its least length.
    runs = F.regexp_extract_all(low, F.lit(f"[a-zÀ-ÿ]{{{least_length},}}"), F.lit(0))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"), F.explode(runs).alias("_run"))
    h = F.crc32(F.concat_ws(":", "_id", "_run").cast("binary"))
    at = (h % F.length("_run")).cast("int")
    without = F.concat(F.substring(F.col("_run"), F.lit(1), at), F.substring(F.col("_run"), at + 2, F.length("_run")))
    word = F.when(h % ONE_IN == 0, without).otherwise(F.col("_run"))
    counted = rows.select(word.alias("word")).where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= least_count)


def letters(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """One byte for each letter, and where each word starts (one more entry at the end)."""
    raw = [w.encode("latin-1") for w in words.to_pylist()]
    off = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(w) for w in raw], out=off[1:])
    return np.frombuffer(b"".join(raw), np.uint8), off


def vectors(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Counts of letter groups, one row for each word."""
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    return np.bincount(row * GROUPS + _GROUP[data], minlength=(len(off) - 1) * GROUPS).reshape(-1, GROUPS)


def with_vectors(words: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            v = vectors(*letters(b.column(0)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.FixedSizeListArray.from_arrays(pa.array(v.ravel().astype(np.int32)), GROUPS).cast(pa.list_(pa.int32()))], ["word", "n", "vector"])

    return words.select("word", "n").mapInArrow(run, "word string, n long, vector array<int>")


def visits(words: DataFrame, members: int = MEMBERS) -> DataFrame:
    """(node, depth, size, word, n, more, less): the subtrees that each word goes to, with what it has spent; size is the number of words under the node, and those that spent nothing are these words."""
    state = spool(with_vectors(words).select(F.lit("").alias("node"), "word", "n", "vector", F.lit(0).alias("more"), F.lit(0).alias("less")), "roots")
    done = None
    for depth in range(GROUPS + 1):
        own = (F.col("more") == 0) & (F.col("less") == 0)
        sizes = spool(state.where(own).groupBy("node").agg(F.count("*").alias("size")), "nodes")
        here = state.join(sizes.hint("merge"), "node")
        small = F.lit(depth == GROUPS) | (F.col("size") <= members)
        found = here.where(small).select("node", F.lit(depth).alias("depth"), "size", "word", "n", "more", "less")
        done = found if done is None else done.unionByName(found)
        if depth == GROUPS or sizes.where(~small).isEmpty():
            return done
        mine = F.element_at("vector", depth + 1)
        step = lambda d: F.struct((mine + d).alias("count"), (F.col("more") + max(d, 0)).alias("more"), (F.col("less") + max(-d, 0)).alias("less"))
        ways = F.array_compact(F.array(step(0), F.when(F.col("more") == 0, step(1)), F.when((F.col("less") == 0) & (mine > 0), step(-1))))
        entered = here.where(~small).select("node", "word", "n", "vector", F.explode(ways).alias("_to"))
        state = spool(entered.select(F.concat_ws(",", "node", F.col("_to.count").cast("string")).alias("node"), "word", "n", "vector", "_to.more", "_to.less"), "states")
    return done


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    of = np.repeat(np.arange(len(sizes)), sizes)
    return np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[of], of


def near(a: bytes, b: bytes) -> bool:
    """Whether one inserted, deleted or replaced letter makes one word of the other."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    short, most = min(len(a), len(b)), max(len(a), len(b))
    ahead = next((i for i in range(short) if a[i] != b[i]), short)
    behind = next((i for i in range(short - ahead) if a[-1 - i] != b[-1 - i]), short - ahead)
    return ahead + behind >= most - 1


class Letters:
    """Words as they are compared: left and right aligned."""

    def __init__(self, words: pa.Array) -> None:
        self.data, self.off = letters(words)
        self.size = np.diff(self.off)
        self.left, self.right = (np.zeros((len(self.size), WIDTH), np.uint8) for _ in range(2))
        place, row = _ragged(np.zeros(len(self.size), np.int64), np.where(self.size <= WIDTH, self.size, 0))
        self.left[row, place] = self.data[self.off[row] + place]
        self.right[row, place] = self.data[self.off[row + 1] - 1 - place]

    def raw(self, i: int) -> bytes:
        return self.data[self.off[i] : self.off[i + 1]].tobytes()


def verified(a: Letters, i: np.ndarray, b: Letters, j: np.ndarray) -> np.ndarray:
    """Which of the pairs (i, j) are near."""
    la, lb = a.size[i], b.size[j]
    out = np.abs(la - lb) <= 1
    plain = np.flatnonzero(out & (la <= WIDTH) & (lb <= WIDTH))
    short, most = np.minimum(la, lb)[plain], np.maximum(la, lb)[plain]

    def shared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        apart = x[i[plain]] != y[j[plain]]
        return np.minimum(np.where(apart.any(1), apart.argmax(1), WIDTH), short)

    ahead, behind = shared(a.left, b.left), shared(a.right, b.right)
    out[plain] = (ahead + behind >= most - 1) & ~((ahead == most) & (short == most))
    for k in np.flatnonzero(out & ((la > WIDTH) | (lb > WIDTH))).tolist():
        out[k] = near(a.raw(int(i[k])), b.raw(int(j[k])))
    return out


def search(members: pa.Array, counts: np.ndarray, depth: int, visitors: pa.Array, more: np.ndarray, less: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each visitor the number of near members and the best of them (largest count, then smallest word) with its count; 0 near: -1.

    The trie of ``members`` below ``depth`` is held as sorted vectors: a node is a number
    for each level, its children stand together in a sorted list of (node, count).
    """
    w, q = Letters(members), Letters(visitors)
    vec = vectors(w.data, w.off)
    order = np.lexsort(vec[:, ::-1].T) if len(vec) else np.zeros(0, np.int64)
    vec = vec[order]
    node, levels = np.zeros(len(vec), np.int64), {}
    for k in range(depth, GROUPS):
        children, node = np.unique(node << 32 | vec[:, k], return_inverse=True)
        levels[k] = children
    leaf = np.searchsorted(node, np.arange(node[-1] + 2 if len(node) else 1))
    mine = vectors(q.data, q.off)
    rank = np.empty(len(w.size), np.int64)
    rank[np.array(sorted(range(len(w.size)), key=w.raw), np.int64)] = np.arange(len(w.size))

    n_near, best, best_n = np.zeros(len(q.size), np.int64), np.full(len(q.size), -1), np.zeros(len(q.size), np.int64)
    every = np.arange(len(q.size))
    stack = [(depth, every[a : a + STATES], np.zeros(len(every[a : a + STATES]), np.int64), more[a : a + STATES], less[a : a + STATES]) for a in range(0, len(every), STATES)]
    while stack:
        k, who, at, up, down = stack.pop()
        if k == GROUPS:
            size = leaf[at + 1] - leaf[at]
            total, a = np.cumsum(size), 0
            while a < len(who):
                to = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + STATES, "right")))
                place, of = _ragged(leaf[at[a:to]], size[a:to])
                i, j = who[a:to][of], order[place]
                ok = verified(q, i, w, j)
                i, j = i[ok], j[ok]
                n_near += np.bincount(i, minlength=len(n_near))
                o = np.lexsort((rank[j], -counts[j], i))
                i, j = i[o], j[o]
                lead = np.flatnonzero(np.diff(i, prepend=-1) != 0)
                i, j = i[lead], j[lead]
                better = (best[i] < 0) | (counts[j] > best_n[i]) | ((counts[j] == best_n[i]) & (rank[j] < rank[best[i]]))
                best[i[better]], best_n[i[better]] = j[better], counts[j[better]]
                a = to
            continue
        found = []
        for d in (0, 1, -1):
            can = (up == 0 if d > 0 else down == 0) if d else np.ones(len(who), bool)
            count = mine[who, k] + d
            can &= count >= 0
            key = at[can] << 32 | count[can]
            child = np.minimum(np.searchsorted(levels[k], key), len(levels[k]) - 1)
            there = levels[k][child] == key
            found.append((who[can][there], child[there], up[can][there] + (d > 0), down[can][there] + (d < 0)))
        joined = [np.concatenate(x) for x in zip(*found, strict=True)]
        for a in range(0, len(joined[0]), STATES):
            stack.append((k + 1, *(x[a : a + STATES] for x in joined)))
    return n_near, best, best_n


def near_words(words: DataFrame, members: int = MEMBERS, visitors: int = VISITORS) -> DataFrame:
    """(word, n_near, best_n, best): words with near ones, their number, and the most frequent of them."""
    rows = spool(visits(words, members), "visits")
    load = rows.groupBy("node").agg(F.max("size").alias("_size"), F.count("*").alias("_visits"))
    load = spool(load.select("node", F.ceil(F.col("_size") / members).alias("parts"), F.ceil(F.col("_visits") / visitors).alias("shifts")), "loads")
    rows = rows.join(load.hint("merge"), "node")
    part, shift = F.pmod(F.xxhash64("word"), "parts"), F.pmod(F.xxhash64("word", F.lit(1)), "shifts")
    each = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    own = rows.where("more = 0 and less = 0").select("node", "depth", part.alias("part"), F.explode(each("shifts")).alias("shift"), "word", "n", F.lit(True).alias("member"), "more", "less")
    guests = rows.select("node", "depth", F.explode(each("parts")).alias("part"), shift.alias("shift"), "word", "n", F.lit(False).alias("member"), "more", "less")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf["member"]], pdf[~pdf["member"]]
        counts = a["n"].to_numpy(np.int64)
        n_near, best, best_n = search(pa.array(a["word"].tolist(), pa.string()), counts, int(pdf["depth"].iloc[0]), pa.array(b["word"].tolist(), pa.string()), b["more"].to_numpy(np.int64), b["less"].to_numpy(np.int64))
        hit = np.flatnonzero(n_near)
        return pd.DataFrame({"word": b["word"].to_numpy()[hit], "n_near": n_near[hit], "best_n": best_n[hit], "best": a["word"].to_numpy()[best[hit]]})

    found = own.unionByName(guests).groupBy("node", "part", "shift").applyInPandas(run, "word string, n_near long, best_n long, best string")
    first = F.min(F.struct((-F.col("best_n")).alias("minus"), "best"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), first.alias("_first")).select("word", "n_near", (-F.col("_first.minus")).alias("best_n"), F.col("_first.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): every round doubles the way that each word has gone along its forms."""
    links = spool(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        went = spool(links.join(ahead.hint("merge"), "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_on")), "forms")
        links = went.select("word", "root")
        if went.where("_on").isEmpty():
            return links


def group_variants(docs: DataFrame, members: int = MEMBERS, visitors: int = VISITORS) -> DataFrame:
    """word, form, root, n, n_near and form_n for every word of ``docs``."""
    words = spool(word_counts(docs), "words")
    found = near_words(words, members, visitors)
    known = spool(words.join(found.hint("merge"), "word", "left"), "near")
    is_form = F.col("best_n") >= RATIO * F.col("n")
    known = known.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n"))
    last = roots(known.where("form is not null"))
    return known.join(last.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
