"""Quotes from anywhere in any text, against a plain version."""

import random
import re
import time

import pytest

import __spark_entry__ as entry
from colloquy.functions import similarity
from colloquy.functions.similarity import indel_ratio, partial_score
from colloquy.operators import verify
from colloquy.plans import texts

TEXTS = [None, "", "Hi.", "Été à l'école,\nligne deux… 3 œufs", "1. First-rate, it's “so”", "a\n\nb", "日本語だけ", "x" * 200, "It's a well-known fact: 42 cafés\nsell crème brûlée — daily. " * 9, "…", "Straße\tund Äpfel. " * 20]
PLAIN = str.maketrans("’‘“”—–é ", "''\"\"--e ")


def plain(text):
    low = text.lower().translate(PLAIN).replace("…", "...").replace("æ", "ae").replace("œ", "oe")
    return re.sub(r"[ \t\n\x0b\f\r]+", " ", re.sub(r"[^a-z0-9 \t\n\x0b\f\r'.-]", " ", low)).strip(" ")


def holds(quote, text):
    if not quote or not text:
        return not quote
    body = plain(text)
    return all(body and partial_score(p, body) >= 90 for p in (p.strip(" ") for p in plain(quote).split("...")) if p)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    own = [(10_000 + 10 * i + k, t) for i, t in enumerate(TEXTS) for k in range(5)]
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame(own, "doc_id long, text string")).cache()


def test_all_quotes(docs):
    rows = texts.quoted(docs)
    found = {r.doc_id: r.verified for r in verify.verify_quotes(rows, "doc_id", "quote", "text").collect()}
    assert found == {r.doc_id: holds(r.quote, r.text) for r in rows.collect()}


def test_all_coded_rows(docs):
    rows = texts.coded_quotes(docs)
    found = {r.doc_id: (list(r.codes_clean), r.quarantine_reason) for r in verify.clean_rows(rows, "doc_id", "codes", "quotes", "text").collect()}
    never = "zzqq 0123456789 never said"
    for r in rows.collect():
        good = ["PUSH-01"] if r.doc_id % 4 == 0 else []  # the document's own words, or none, are always in it
        if r.doc_id % 4 == 0 and holds(never, r.text):
            good.append("PULL-02")
        want = [None if good else "unverifiable_quote", "hallucinated_label", None if holds(never, r.text) else "unverifiable_quote", None][r.doc_id % 4]
        if r.doc_id % 4 != 2:
            assert sorted(found[r.doc_id][0]) == sorted(good), r
        assert found[r.doc_id][1] == want, r


@pytest.mark.parametrize("name", ["quotes_of_all", "quarantine_of_all"])
def test_every_document_has_a_row(spark, sf_dir, name):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert sorted(r.doc_id for r in entry.queries()[name](spark, sf_dir).collect()) == sorted(r.doc_id for r in docs.collect())


def test_parts_are_trimmed(spark):
    """A space before an ellipsis is no part of the quote."""
    rows = [(1, "It began. Then it went on and on, and so it came to an end.", "It began. … came to an end."), (2, "short", "… …")]
    found = verify.verify_quotes(spark.createDataFrame(rows, "k int, body string, quote string"), "k", "quote", "body").collect()
    assert sorted((f.k, f.verified) for f in found) == [(1, True), (2, True)]


def every_stretch(a, b):
    part, body = (a, b) if len(a) <= len(b) else (b, a)
    if not part:
        return 100.0 if not body else 0.0
    n = len(part)
    return max(indel_ratio(part, body[max(0, end - n) : min(end, len(body))]) for end in range(1, len(body) + n))


@pytest.mark.parametrize("seed", range(5))
def test_partial_score_against_every_stretch(seed):
    r = random.Random(seed)
    letters = ["ab", "abcdef ", "aé日😀x"][seed % 3]
    some = lambda n: "".join(r.choice(letters) for _ in range(n))
    for n, m in [(0, 0), (0, 3), (1, 1), (1, 40), (7, 8), (9, 9), (63, 70), (64, 300), (65, 200), (130, 131), (129, 400)]:
        a, b = some(n), some(m)
        if n > 5 and r.random() < 0.5:
            at = r.randint(0, m - n)
            b = b[:at] + a[: n // 2] + r.choice(letters) + a[n // 2 + 1 :] + b[at + n :]
        assert partial_score(a, b) == partial_score(b, a) == every_stretch(a, b), (a, b)


def test_a_foreign_quote_in_a_long_text_is_quick():
    r = random.Random(1)
    words = ["".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 9))) for _ in range(3000)]
    body, part = " ".join(r.choice(words) for _ in range(17_000))[:100_000], " ".join(r.choice(words) for _ in range(40))[:128]
    partial_score(part, body)
    began = time.process_time()
    score = partial_score(part, body)
    assert time.process_time() - began < 0.3 and 50 < score < 90


def test_changed_passages_against_plain_scores(spark, sf_dir):
    """Scores under the threshold may be 0, for they are not worked out where too few 3-grams are shared."""
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    five = lambda text: {tuple(w[i : i + 5]) for w in [text.split(" ")] for i in range(max(1, len(w) - 4))}
    held, want = [(i, t, five(t)) for i, t in docs], {}
    for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect():
        half = len(r.text) // 2
        part = r.text[:half] + " changed " + r.text[half + 8 :]
        mine = five(part)
        for i, text, grams in held:
            if mine & grams:
                want[i, r.item_id] = partial_score(plain(part), plain(text))
    found = {(r.doc_id, r.item_id): r.score for r in entry.queries()["fuzzy_quotes"](spark, sf_dir).collect()}
    assert want and found.keys() == want.keys()
    for k, score in found.items():
        assert score == pytest.approx(want[k], abs=1e-6) or score == 0 and want[k] < 90
    assert any(score > 90 for score in found.values())


def test_capitals_are_as_long_as_their_text(spark):
    """A sharp s has one capital here, so a quote in capitals is found where its words are."""
    body = "größe ßüß maße ǰ straße " * 12
    row = texts.quoted(spark.createDataFrame([(4, body)], "doc_id long, text string")).first()
    assert len(row.quote) == 60 and "ẞ" in row.quote and "SS" not in row.quote
    checked = verify.verify_quotes(spark.createDataFrame([row]), "doc_id", "quote", "text").first()
    assert checked.verified


def test_few_stretches_of_a_changed_passage_are_looked_at(monkeypatch):
    """Of a long part in a long text every eighth of its length, and then only where the best can still be."""
    r = random.Random(2)
    body = "".join(r.choice("etaoin shrdlu") for _ in range(20_000))
    part = body[7001:7201] + " changed " + body[7210:7401]
    seen = []
    given = similarity._Stretches.common
    monkeypatch.setattr(similarity._Stretches, "common", lambda self, starts: seen.append(len(starts)) or given(self, starts))
    assert partial_score(part, body) == max(indel_ratio(part, body[k : k + 400]) for k in range(6990, 7010))
    assert sum(seen) < len(body) / 16
