"""Phrases as a table against phrases as a plan, and recurring n-grams against a count of all."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from colloquy.operators import coding, phrases
from tests.test_quotes import plain


def random_rules(r, n):
    some = lambda: "".join(r.choice("abcé ") for _ in range(r.randint(1, 6))).strip() or "a"
    return {f"C{k:02}": tuple(dict.fromkeys(some() for _ in range(r.randint(1, 4)))) for k in range(n)}


@pytest.mark.parametrize("shard_chars", [phrases.SHARD_CHARS, 25])
def test_table_equals_rules(spark, shard_chars):
    r = random.Random(1)
    rules = random_rules(r, 12)
    texts = ["".join(r.choice("abcÉé A\n") for _ in range(r.randint(0, 60))) for _ in range(80)] + [None, "", "İstanbul abc ABC", "x" * 100]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    table = spark.createDataFrame([(c, p) for c, of in rules.items() for p in of] + [("C00", rules["C00"][0]), ("C99", "")], "code string, phrase string")
    for evidence in (True, False):
        want = coding.code_by_rules(docs, rules, evidence=evidence).select("id", "deductive_codes").collect()
        found = phrases.code_by_phrases(docs, table, evidence=evidence, shard_chars=shard_chars)
        assert found.columns == ["id", "text", "deductive_codes"]
        assert {x.id: x.deductive_codes for x in found.collect()} == {x.id: x.deductive_codes for x in want}
    assert phrases.code_by_phrases(docs, table.limit(0)).where(F.size("deductive_codes") > 0).count() == 0


def test_evidence_begins_at_the_phrase(spark):
    """A letter that becomes longer in lower case shifts nothing."""
    docs = spark.createDataFrame([(1, "İİİ and then the phrase")], "id int, text string")
    for df in (coding.code_by_rules(docs, {"C": ("the phrase",)}), phrases.code_by_phrases(docs, spark.createDataFrame([("C", "the phrase")], "code string, phrase string"))):
        assert df.first().deductive_codes[0].evidence_quote == "the phrase"


def test_plan_does_not_grow_with_the_table(spark):
    docs = spark.createDataFrame([(1, "some text")], "id int, text string")
    sizes = []
    for n in (10, 10_000):
        table = spark.range(n).select(F.lit("C").alias("code"), F.concat(F.lit("phrase "), "id").alias("phrase"))
        sizes.append(len(phrases.code_by_phrases(docs, table)._jdf.queryExecution().optimizedPlan().toString()))
    assert abs(sizes[0] - sizes[1]) < 50


def test_phrase_table(spark):
    book = spark.createDataFrame([("A", ' One, "two words" ,, ONE'), ("B", "two words")], "code string, keywords string")
    assert sorted(map(tuple, phrases.phrase_table(book).collect())) == [("A", "one"), ("A", "two words"), ("B", "two words")]


def ngrams(docs, sizes, least):
    n, first = Counter(), {}
    for i, t in docs:
        words = [w for w in plain(t or "").split(" ") if len(w) > 2]
        for size in sizes:
            for g in {" ".join(words[k : k + size]) for k in range(len(words) - size + 1)}:
                n[g, size] += 1
                first[g] = min(i, first.get(g, i))
    return sorted((g, size, k, first[g]) for (g, size), k in n.items() if k >= least)


@pytest.mark.parametrize(("width", "least"), [(1 << 20, 3), (1 << 15, 2), (1 << 14, 70)])
def test_ngrams_against_a_count_of_all(spark, monkeypatch, width, least):
    monkeypatch.setattr(phrases, "WIDTH", width)
    r = random.Random(least)
    words = [f"word{k}" for k in range(30)] + ["a", "of", "It's", "Élan"]
    docs = [(i, " ".join(r.choice(words[: r.choice([3, 10, 34])]) for _ in range(r.randint(0, 30)))) for i in range(320)] + [(900, None), (901, "")]
    found = phrases.recurring_ngrams(spark.createDataFrame(docs, "id int, text string"), "id", sizes=(1, 2, 3, 5), least_posts=least)
    want = ngrams(docs, (1, 2, 3, 5), least)
    assert want and sorted(map(tuple, found.collect())) == want


def test_rare_ngrams_are_not_shuffled(spark):
    docs = spark.createDataFrame([(i, f"alpha beta gamma own{i} mine{i} self{i}") for i in range(200)], "id int, text string")
    grams = docs.select(phrases._tokens("text").alias("_t")).select(F.explode(phrases._ngrams(2)).alias("gram"))
    kept = phrases._frequent(grams, phrases.count_sketch(grams, 3), ["gram"], 3)
    assert {x.gram for x in kept.collect()} == {"alpha beta", "beta gamma"}


def test_known_phrases_and_coded_posts_are_left_out(spark):
    rows = [(i, "alpha beta gamma", [] if i < 3 else ["x", "y"]) for i in range(6)]
    posts = spark.createDataFrame(rows, "id int, text string, deductive_codes array<string>")
    found = phrases.emergent_ngrams(posts, spark.createDataFrame([("alpha beta",)], "phrase string"), "id", sizes=(2, 3))
    assert sorted(map(tuple, found.collect())) == [("alpha beta gamma", 3, 3, 0), ("beta gamma", 2, 3, 0)]


def test_unsafe_entities(spark):
    found = spark.createDataFrame([("Anna",), ("FDA",), ("fda",)], "entity string")
    rows = phrases.unsafe_entities(found, spark.createDataFrame([("Fda",)], "name string"))
    assert [x.entity for x in rows.collect()] == ["Anna"]


def test_a_large_table_is_joined_in_one_pass(spark):
    """Phrases of all lengths, with beginnings in common, in copies and empty texts; texts are neither written nor read again for a part of the table."""
    r = random.Random(5)
    texts = ["".join(r.choice("ab é") for _ in range(r.choice([0, 5, 40, 300]))) for _ in range(60)]
    texts += texts[:20] + [None, "ſtraße 😀 a", "İ" * 40]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    some = [t[k : k + n].lower() for t in texts if t for n in (1, 2, 15, 16, 17, 31, 32, 33, 70, 200) for k in [r.randrange(len(t))] if t[k : k + n]]
    rules = {f"C{k}": tuple(dict.fromkeys(some[k::5] + [f"never {k} {j}" for j in range(30)])) for k in range(5)}
    table = spark.createDataFrame([(c, p) for c, of in rules.items() for p in of], "code string, phrase string")
    found = phrases.code_by_phrases(docs, table, shard_chars=100)
    want = coding.code_by_rules(docs, rules).select("id", "deductive_codes").collect()
    assert {x.id: x.deductive_codes for x in found.collect()} == {x.id: x.deductive_codes for x in want}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert not any("hits-" in f for f in found.inputFiles())
