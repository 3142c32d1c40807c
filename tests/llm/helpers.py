"""Tables with every awkward case, and plain versions of what the operators compute."""

import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, digest string, score double, row string"
LONG = "many words in one very long text " * 4000

EDGE_TEXTS = [
    (1, "alpha beta gamma delta epsilon zeta eta theta"),
    (2, "alpha beta gamma delta epsilon zeta eta theta"),
    (3, "alpha  beta\tgamma delta\nepsilon zeta eta theta"),
    (3, "alpha  beta\tgamma delta\nepsilon zeta eta theta"),
    (4, None),
    (5, ""),
    (6, " \n\t"),
    (None, "a document without an id but with words in it"),
    (None, None),
    (7, LONG),
    (8, "é 😀 ß\u0000x"),
    (9, "one"),
    (None, "another document without an id, quite unlike the first"),
]


def edge_rows():
    return [(i, t, None if n % 3 == 0 else "en", None if n % 4 == 0 else f"src{n % 3}", None, "k", "d", 0.5, "r") for n, (i, t) in enumerate(EDGE_TEXTS)]


def edge_docs(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return WORD.findall(text or "")


def shingles(ws, size=5):
    return frozenset(tuple(ws[i : i + size]) for i in range(max(1, len(ws) - size + 1))) if ws else frozenset()


def near_classes(rows, threshold=0.8):
    """(doc_id, class_id, n_links, class_rows) by comparing all texts that share a shingle."""
    by_words = {}
    for i, t in rows:
        by_words.setdefault(tuple(words(t)), []).append(i)
    texts = [w for w in by_words if w]
    sets = [shingles(list(w)) for w in texts]
    holders = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    links = []
    for i, s in enumerate(sets):
        common = Counter(j for x in s for j in holders[x] if j != i)
        links.append({j for j, k in common.items() if k >= threshold * (len(s) + len(sets[j]) - k) - 1e-9})
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, to in enumerate(links):
        for j in to:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    members = {}
    for i, w in enumerate(texts):
        members.setdefault(find(i), []).extend(by_words[w])
    out = [(x, x, 0, 1) for x in by_words.get((), [])]
    for i, w in enumerate(texts):
        of = members[find(i)]
        least = min((x for x in of if x is not None), default=None)
        out += [(x, x if least is None else least, len(links[i]), len(of)) for x in by_words[w]]
    return out


def in_order(rows):
    return sorted(tuple("" if v is None else f"{v:.9f}" if isinstance(v, float) else f"{v:>20}" if isinstance(v, int) and not isinstance(v, bool) else str(v) for v in r) for r in rows)
