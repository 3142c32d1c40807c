from collections import Counter
import itertools
"""Operators on small rows with awkward values, and against plain versions."""

import math
import random
from types import SimpleNamespace

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from colloquy.config import ARCHETYPES, CODES, DIMENSIONS
from colloquy.functions import clean, jsonx
from colloquy.functions.similarity import common_subsequence, indel_ratio, partial_score
from colloquy.operators import agreement, audit, coding, emergent, fuzzy, linking, profile, sampling, tables, verify
from colloquy.plans import coded as coded_plans
from colloquy.shared import shared_folder


def values(spark, expression, rows, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], f"i int, x {kind}")
    return [r.y for r in df.select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()]


# -- cleaning ------------------------------------------------------------------------------------


def test_scores(spark):
    assert values(spark, clean.score, ["1525.0", "nan", "inf", "x", "", "-3.9", None, "1e3"]) == [1525, 0, 0, 0, 0, -3, 0, 1000]


def test_flags_and_ratios(spark):
    assert values(spark, clean.flag, ["true", "TRUE ", "", None, "yes"]) == [True, True, False, False, False]
    assert values(spark, clean.ratio, ["0.12345678", " ", "x", None]) == [0.123457, None, None, None]


def test_text_fields(spark):
    assert values(spark, clean.text_field, ["NaN", "None", "null", "  ", " a ", None, "nan x"]) == [None, None, None, None, "a", None, "nan x"]


def test_dates(spark):
    assert values(spark, clean.utc_seconds, ["1970-01-02", "2024-02-30", "x", None, "2024-01-01 10:00"]) == [86400.0, 0.0, 0.0, 0.0, 0.0]


def test_bands(spark):
    rows = [-0.1, 0.0, 0.19, 0.20, 0.40, 0.41, 0.80, 0.81, float("nan"), None]
    assert values(spark, clean.agreement_band, rows, "double") == ["Poor", "Slight", "Slight", "Fair", "Fair", "Moderate", "Substantial", "Almost perfect", "N/A", "N/A"]


def test_categories(spark):
    rows = [["PUSH-01", "PUSH-02"], ["PULL-01"], ["MOOR-F-01", "MOOR-I-02"], ["PUSH-01", "PULL-01"], ["EMER-01"]]
    assert values(spark, clean.category, rows, "array<string>") == ["Push", "Pull", "Mooring", "Mixed", "Unknown"]
    assert values(spark, clean.overall_confidence, [["HIGH", "LOW"], ["MED", "HIGH"], ["odd"], []], "array<string>") == ["LOW", "MED", "HIGH", "N/A"]


def test_cells_round_ties_to_even(spark):
    df = spark.createDataFrame([(49, 400), (3, 4), (0, 0)], "n int, t int")
    assert [r.c for r in df.select(clean.cell(F.col("n"), F.col("t")).alias("c")).collect()] == ["49 (12.2%)", "3 (75.0%)*", "0 (0.0%)*"]


def test_filler(spark):
    rows = ["thanks!", "😀😀", "Me too.", "a real sentence", "", None]
    assert values(spark, lambda x: clean.only_filler(F.lit(""), x), rows) == [True, True, True, False, True, True]


def test_normalised_text(spark):
    rows = ["“Curly” – it’s … Æther cœur é x", None, "A\n\tB"]
    assert values(spark, clean.normalised_text, rows) == ["curly - it's ... aether coeur e x", "", "a b"]


def test_fenced_json(spark):
    rows = ['x ```json\n{"a":1}\n``` y', '```\n[1]\n```', "nothing", None]
    assert values(spark, clean.fenced_json, rows) == ['{"a":1}', "[1]", "{}", "{}"]


def test_pseudonyms_and_fingerprints(spark):
    assert values(spark, clean.pseudonymous, ["[deleted]", "a" * 32, "anon_1", "Jane", None]) == [True, True, True, False, True]
    assert clean.fingerprint({"a": 1, "b": 2}) == clean.fingerprint({"b": 2, "a": 1}) != clean.fingerprint({"a": 2, "b": 1})


# -- JSON ----------------------------------------------------------------------------------------


def test_code_lists_of_mixed_shape(spark):
    rows = [None, "[]", "bad json", "{}", '[{"code":"PUSH-01","confidence":null},"x",null,3]']
    assert [[c.code for c in v] for v in values(spark, jsonx.parse_codes, rows)] == [[], [], [], [], ["PUSH-01"]]
    assert values(spark, lambda x: jsonx.all_low(jsonx.parse_codes(x)), rows) == [False] * 5


def test_pairs(spark):
    df = spark.createDataFrame([(["a", "b"], ["x"]), (["a"], ["x", "y"]), (["a"], None), ([], ["x"])], "c array<string>, q array<string>")
    found = [[tuple(p) for p in r.p] for r in df.select(jsonx.paired(F.col("c"), F.col("q")).alias("p")).collect()]
    assert found == [[("a", "x"), ("b", "")], [("a", "x")], [("a", "")], []]


# -- similarity ----------------------------------------------------------------------------------


def plain_subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            row[j], last = (last + 1 if x == y else max(row[j], row[j - 1])), row[j]
    return row[-1]


def test_similarity():
    r = random.Random(1)
    for _ in range(400):
        a, b = ("".join(r.choice("abc ") for _ in range(r.randint(0, 14))) for _ in range(2))
        assert common_subsequence(a, b) == plain_subsequence(a, b)
        short, long = sorted((a, b), key=len)
        windows = [long[max(0, s) : s + len(short)] for s in range(1 - len(short), len(long))]
        want = max((indel_ratio(short, w) for w in windows), default=0.0) if short else 100.0 * (not long)
        assert partial_score(a, b) == pytest.approx(max(want, 100.0 * bool(short and short in long)))


def test_early_rejection_loses_nothing(spark):
    r = random.Random(2)
    rows = []
    for i in range(300):
        body = "".join(r.choice("abcdefgh ") for _ in range(120))
        at, part = r.randint(0, 60), None
        part = list(body[at : at + r.randint(5, 50)])
        for _ in range(r.randint(0, 6)):
            part[r.randrange(len(part))] = r.choice("abcdefghz")
        rows.append((i, "".join(part), body))
    scored = verify.score_parts(spark.createDataFrame(rows, "i int, part string, body_norm string")).collect()
    for x in scored:
        want = partial_score(x.part, x.body_norm)
        assert (x.score >= 90) == (want >= 90)


def test_quotes(spark):
    rows = [(1, "", "body"), (2, None, ""), (3, "x", ""), (4, "the quick…lazy dog", "The quick brown fox and the lazy dog"), (5, "not in there at all", "The quick brown fox"), (6, "…", "body"), (7, "quick browm fox", "The quick brown fox")]
    found = {r.k: r.verified for r in verify.verify_quotes(spark.createDataFrame(rows, "k int, q string, b string"), "k", "q", "b").collect()}
    assert found == {1: True, 2: True, 3: False, 4: True, 5: False, 6: True, 7: True}


def test_quarantine(spark):
    rows = [
        (1, '["PUSH-01","PUSH-99"]', '["quick brown"]', "The quick brown fox"),
        (2, '["[EMPTY]", null]', "[]", "x"),
        (3, '["PUSH-99"]', '["quick"]', "quick"),
        (4, '["PUSH-01"]', '["absent words here"]', "The quick brown fox"),
        (5, '["push-01"]', "[]", None),
        (6, "bad", None, "x"),
        (7, '["EMER-03"]', '["quick","spare"]', "quick"),
    ]
    found = {r.k: (r.codes_clean, r.quarantine_reason) for r in verify.clean_rows(spark.createDataFrame(rows, "k int, c string, q string, b string"), "k", "c", "q", "b").collect()}
    assert found == {1: (["PUSH-01"], None), 2: ([], None), 3: ([], "hallucinated_label"), 4: ([], "unverifiable_quote"), 5: (["PUSH-01"], None), 6: ([], None), 7: (["EMER-03"], None)}


def sequential_labels(rows, threshold=85.0):
    leaders, out = [], {}
    tidy = lambda s: " ".join(sorted(s.split()))
    for label in rows:
        best = None
        if label not in leaders:
            for at, other in enumerate(leaders):
                a, b = tidy(label), tidy(other)
                score = indel_ratio(a, b)
                if score >= threshold:
                    key = (score, -len(other), -at)
                    best = max(best or (key, other), (key, other))
        if best:
            out[label] = best[1]
        else:
            out[label] = label
            if label not in leaders:
                leaders.append(label)
    return out


def test_labels_equal_the_sequential_form(spark):
    r = random.Random(3)
    base = ["tolerance break", "natural focus", "sleep quality", "price concern"]
    for _ in range(4):
        rows = []
        for _ in range(40):
            words = list(r.choice(base))
            for _ in range(r.randint(0, 3)):
                words[r.randrange(len(words))] = r.choice("abcdes ")
            rows.append(" ".join("".join(words).split()))
        df = spark.createDataFrame([(x, i) for i, x in enumerate(rows)], "label string, seq int")
        found = {x.label: x.canonical for x in fuzzy.canonical_labels(df, "label", "seq").collect()}
        assert found == sequential_labels(rows)


# -- raters --------------------------------------------------------------------------------------


def test_kappa_of_known_counts(spark):
    counts = spark.createDataFrame([("a", "b", "c", 50, 25, 30, 20), ("a", "b", "d", 0, 0, 0, 0), ("a", "b", "e", 10, 10, 10, 10), ("a", "b", "f", 10, 2, 9, 2)], "left string, right string, code string, n long, pos1 long, pos2 long, both long")
    rows = {r.code: r for r in agreement.kappa(counts).collect()}
    assert rows["c"].kappa == pytest.approx(0.4) and rows["c"].n_pos == 35 and rows["c"].status == "estimable"
    assert [rows[c].status for c in "def"] == ["zero overlap", "constant margin", "low presence (<5)"]
    assert all(rows[c].kappa is None for c in "def")


def test_texts_without_codes_count(spark):
    ratings = spark.createDataFrame([("a", 1, ["X"]), ("a", 2, []), ("b", 1, ["X"]), ("b", 2, []), ("b", 3, ["X"])], "rater string, id int, codes array<string>")
    pairs, codes = spark.createDataFrame([("a", "b")], "left string, right string"), spark.createDataFrame([("X",), ("Y",)], "code string")
    rows = {r.code: (r.n, r.pos1, r.pos2, r.both) for r in agreement.pair_counts(ratings, pairs, codes).collect()}
    assert rows == {"X": (2, 1, 1, 1), "Y": (2, 0, 0, 0)}


# -- profiles ------------------------------------------------------------------------------------

CODED = "post_id string, community string, tertile int, n int, deductive_codes array<struct<code:string,evidence_quote:string,confidence:string>>"


def coded(spark, rows):
    return spark.createDataFrame([(p, c, t, n, [(x, "q", "LOW") for x in codes]) for p, c, t, n, codes in rows], CODED)


def test_profile(spark):
    rows = [("t3_1", "A", 1, 10, ["PUSH-01", "PULL-01"]), ("t3_1", "A", 1, 10, ["PUSH-02"]), ("t3_2", "A", 1, 10, ["PUSH"]), ("t3_3", "A", 3, 10, ["ODD-1"]), ("t1_4", "B", 2, 10, [])]
    df = coded(spark, rows)
    found = {r.community: r for r in profile.community_profile(profile.post_flags(df, "post_id", "community"), "community").collect()}
    a, b = found["A"], found["B"]
    assert (a.total, a.PUSH_count, a.PULL_count, a.NONE_count, a.PUSH_01, a.PUSH_02, a.dominant) == (3, 2, 1, 1, 1, 1, "PUSH")
    assert (b.total, b.NONE_count, b.dominant) == (1, 1, "N/A")
    combos = {r.combination: (r.A, r.total) for r in profile.cooccurrence(df, "community", ["A", "B"]).collect()}
    assert len(combos) == 16 and combos["PUSH+PULL"] == (1, 1) and combos["NONE"] == (2, 3)  # a bare name is no code here
    assert profile.stratum(df, "submissions_only").count() == 4
    assert profile.subcode_frequency(profile.post_flags(df, "post_id", "community")).count() == len(CODES)


def test_sensitivity_flags(spark):
    rows = [(f"a{i}", "A", 1, 100, ["PUSH-01"] if i < 5 else []) for i in range(10)] + [(f"b{i}", "A", 3, 100, ["MOOR-I-01"] if i < 3 else []) for i in range(10)]
    flags = profile.post_flags(coded(spark, rows), "post_id", "community", extra=("tertile", "n"))
    found = {r.tertile: r for r in profile.tertile_sensitivity(flags, "community", "tertile", "n").collect()}
    assert found[1].flag_push_bias and found[1].flag_moor_lower and found[1].flag_low_confidence and found[1].flag_body_length
    assert found[3].flag_push_bias and not found[3].flag_low_confidence and not found[3].flag_body_length


def test_golden_coordinates(spark):
    """Published counts and the coordinates that follow from them."""
    rows = [("Nootropics", 105, 13, 29, 23, 0.381, 21.9), ("Decaf", 107, 40, 48, 32, 0.091, 29.9), ("NooTopics", 87, 4, 29, 26, 0.758, 29.9), ("r/Supplements", 13364, 2960, 4074, 2812, 0.158, 21.0), ("StackAdvice", 0, 0, 0, 0, None, None)]
    df = spark.createDataFrame(rows, "community string, n long, push long, pull long, mooring long, wx double, wy double")
    kinds = spark.createDataFrame(list(ARCHETYPES.items()), "community string, archetype string")
    for r in profile.with_archetype(profile.coordinates(df), kinds, "community").collect():
        assert (r.x is None and r.wx is None) or (round(r.x, 3) == r.wx and round(r.y, 1) == r.wy)
    lower = df.limit(1).withColumn("community", F.lit("nootropics"))
    with pytest.raises(Exception, match="no archetype"):
        profile.with_archetype(lower, kinds, "community").collect()


def test_no_python_in_profiles(spark, sf_dir):
    plan = coded_plans.community_profile(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_profile_reads_only_what_it_needs(spark, tmp_path):
    path = str(tmp_path / "coded")
    coded(spark, [("t3_1", "A", 1, 10, ["PUSH-01"])]).withColumn("raw_response", F.lit("secret")).write.parquet(path)
    flags = profile.post_flags(spark.read.parquet(path), "post_id", "community")
    assert "raw_response" not in profile.community_profile(flags, "community")._jdf.queryExecution().executedPlan().toString()


# -- samples -------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(3))
def test_thirds_equal_ntile(spark, seed):
    """Ties, nulls, a community without a name, and keys that are texts."""
    r = random.Random(seed)
    rows = [(i, f"t3_{r.choice('xyz')}{i}", r.choice(["a", "b", None]), r.choice([0, 0, 0, 5, None, r.randint(0, 1000)])) for i in range(r.choice([5, 400, 3000]))]
    df = spark.createDataFrame(rows, "k long, name string, c string, v long")
    for key in ("k", "name"):
        want = df.withColumn("tertile", F.ntile(3).over(Window.partitionBy("c").orderBy(F.desc("v"), key))).select("k", "tertile").collect()
        assert sorted(map(tuple, sampling.thirds(df, "c", "v", key).select("k", "tertile").collect())) == sorted(map(tuple, want))


def test_cells_round_like_python(spark):
    r = random.Random(5)
    rows = [(n, total) for total in (64, 200, 400, 2000, 4000, *(r.randint(1, 5000) for _ in range(200))) for n in {0, 1, 5, 25, 107, total, *(r.randint(0, total) for _ in range(30))} if n <= total]
    found = spark.createDataFrame(rows, "n long, total long").select("n", "total", clean.cell(F.col("n"), F.col("total")).alias("cell"), clean.percent_text(F.col("n"), F.col("total")).alias("pct")).collect()
    for x in found:
        share = x.n * 100.0 / x.total
        assert (x.cell, x.pct) == (f"{x.n} ({share:.1f}%)" + "*" * (x.n < 10), f"{share:.2f}%")


def test_constant_caps_limit_groups_early(spark):
    df = spark.range(1000).select("id", (F.col("id") % 3).alias("c"))
    plan = sampling.best_of_community(df, "c", [F.desc("id")], 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_review_sample(spark):
    df = spark.range(200).select("id", (F.col("id") % 2).alias("batch"), (F.col("id") == 7).alias("flagged"))
    first = sampling.review_sample(df, "batch", "id", "flagged", 1).collect()
    assert len(first) == 40 and any(r.id == 7 and r.place == 1 for r in first)
    assert sorted(map(tuple, first)) == sorted(map(tuple, sampling.review_sample(df.repartition(3), "batch", "id", "flagged", 1).collect()))


# -- tables, joins, privacy ----------------------------------------------------------------------


def test_resume_is_not_hidden_by_a_null(spark):
    collected = spark.createDataFrame([("a",), ("b",)], "reddit_id string")
    coded_ = spark.createDataFrame([("a",), (None,)], "reddit_id string")
    assert [r.reddit_id for r in linking.uncoded(collected, coded_).collect()] == ["b"]


def test_upsert_and_insert(spark):
    now = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", 3, 0), ("b", 4, 1), ("c", 5, 2), ("c", 6, 3)], "k string, v int, seq int")
    assert sorted(map(tuple, tables.upsert(now, new, ["k"], "seq").collect())) == [("a", 1), ("b", 4), ("c", 6)]
    assert sorted(map(tuple, tables.with_inserts(now, new, ["k"], "seq").collect())) == [("a", 1), ("b", 2), ("c", 5)]
    empty = now.where("false")
    assert tables.upsert(now, new.where("false"), ["k"], "seq").count() == 2 and tables.with_inserts(empty, new, ["k"], "seq").count() == 2


def test_observed_counts(spark):
    df, seen = tables.observed(spark.range(10), "rows", n=F.count("*"), even=F.count_if(F.col("id") % 2 == 0))
    df.write.format("noop").mode("overwrite").save()
    assert seen.get == {"n": 10, "even": 5}


def test_codes_pass_over_what_is_no_number(spark):
    book = spark.createDataFrame([("EMER-09",), ("EMER-x",), ("PUSH-99",)], "code string")
    new = spark.createDataFrame([(1,), (2,)], "seq int")
    assert [r.code for r in tables.next_codes(book, new, "seq").orderBy("seq").collect()] == ["EMER-10", "EMER-11"]


def test_no_export_has_a_forbidden_column(spark):
    df = spark.createDataFrame([(1, "secret", "x")], "post_id int, Text string, raw_prompt string")
    assert audit.without_forbidden(df).columns == ["post_id"] and audit.forbidden_columns(df) == ["Text", "raw_prompt"]


def test_privacy_verdicts(spark):
    rows = [("a", ["fine"], "{}"), ("b", ["ask u/some_name"], "{}"), ("c", ["fine"], '{"x":{"author_id":1}}'), ("d", None, "{}")]
    good, bad = audit.accepted_and_rejected(spark.createDataFrame(rows, "post_id string, evidence_quotes array<string>, details string"), "evidence_quotes")
    assert {r.post_id for r in good.collect()} == {"a", "d"} and {r.post_id: r.violations for r in bad.collect()}["b"] == ["USERNAME"]


def test_breaker_flags(spark):
    long = "x" * 300
    rows = [("short", ["PUSH-01"]), (long, []), (long, ["PUSH-01"])]
    df = spark.createDataFrame([(b, [(c, "q", "low") for c in codes]) for b, codes in rows], "text string, deductive_codes array<struct<code:string,evidence_quote:string,confidence:string>>")
    found = [r.circuit_breaker_flags for r in coding.assemble(df, "text", F.lit("A_keyword")).collect()]
    assert found == [["SHORT_FORM_BODY", "ALL_LOW_CONFIDENCE"], ["NO_CODES_LONG_BODY"], ["ALL_LOW_CONFIDENCE"]]


def test_entities(spark):
    rows = [["we met John there, with Modafinil and Kratom's"], ["see https://x.example/a or u/some_name"], [], None]
    found = values(spark, coding.entity_candidates, rows, "array<string>")
    assert found[0] == ["John"] and found[1] == ["https://x.example/a", "u/some_name"] and not found[2]


def test_theme_catalogue(spark):
    rows = [(1, "sleep", "p1", "A", "", "q1", "o1", "PUSH"), (2, "slep", "p2", "B", "def", "", "o2", "PULL"), (3, "lonely", "p3", "A", "d", "q", "o", "PULL")]
    df = spark.createDataFrame(rows, "seq int, label string, post string, community string, definition string, evidence_quote string, partial_overlap_with string, distinct_dimension string")
    canon = spark.createDataFrame([("sleep", "sleep"), ("slep", "sleep"), ("lonely", "lonely")], "label string, canonical string")
    (r,) = emergent.theme_catalogue(df, canon, "label", "community", "post", "seq").collect()
    assert (r.canonical, r.frequency, r.n_posts, r.communities, r.definition, r.evidence_quote, r.partial_overlap_with, r.distinct_dimension) == ("sleep", 2, 2, "A, B", "def", "q1", "o1", "PUSH")
    assert emergent.theme_catalogue(df.where("label = 'lonely'"), canon, "label", "community", "post", "seq").count() == 0


def test_dimensions():
    assert len(CODES) == 24 and DIMENSIONS == ("PUSH", "PULL", "MOOR-F", "MOOR-I")
    assert math.isclose(indel_ratio("", ""), 100.0)


# -- numbers, gates, labels near the threshold, the shared folder --------------------------------


def test_numbers_follow_the_order(spark):
    r = random.Random(3)
    rows = r.sample(range(10**6), 5000)
    found = tables.numbered(spark.createDataFrame([(x,) for x in rows], "x long").repartition(7), "x", "place").collect()
    assert {(f.x, f.place) for f in found} == {(x, i + 1) for i, x in enumerate(sorted(rows))}
    assert tables.numbered(spark.createDataFrame([], "x long"), "x", "place").count() == 0


def test_gates(spark):
    df = spark.createDataFrame([(1, None), (2, "a")], "k long, x string")
    assert {(g.gate, g.value, g.passed) for g in audit.gates(df, F.col("x").isNull()).collect()} == {("fallback_leaks", 1, False), ("rows", 2, True)}
    with pytest.raises(ValueError, match="export: fallback_leaks$"):
        audit.require_gates(df, F.col("x").isNull(), "export")
    with pytest.raises(ValueError, match="rows$"):
        audit.require_gates(df.where("false"), F.lit(False), "export")
    audit.require_gates(df, F.lit(False), "export")


def some_labels(r, n):
    words = ["a", "ab", "cue", "loss", "of", "focus", "energy", "crash", "cost", "costs"]
    return sorted({" ".join(r.choice(words) for _ in range(r.randint(1, 3))) for _ in range(n)} | {"a", "b", "ab", "abc", "abcd", "abcde", "abcdf", ""})


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("metric", ["indel", "levenshtein"])
@pytest.mark.parametrize("threshold", [20.0, 50.0, 70.0, 80.0, 85.0, 92.0, 100.0])
def test_no_similar_pair_is_missed(spark, threshold, metric):
    r = random.Random(int(threshold))
    labels = some_labels(r, 120)
    tidy = {x: " ".join(sorted(x.split())) for x in labels}

    def score(a, b):
        if metric == "indel":
            return indel_ratio(a, b)
        return (1 - edit_distance(a, b) / max(len(a), len(b))) * 100 if a or b else 100.0

    want = {(a, b) for a in labels for b in labels if a != b and score(tidy[a], tidy[b]) >= threshold}
    df = spark.createDataFrame([(x,) for x in [*labels, None]], "label string")
    assert {(f.a, f.b) for f in fuzzy.similar_pairs(df, threshold, metric).collect()} == want
    pairs = [(c.a, c.b) for c in fuzzy.label_candidates(df, threshold, metric).collect()]
    assert len(pairs) == len({tuple(sorted(p)) for p in pairs})


def test_segments_bring_fewer_labels_together_than_bigrams(spark):
    """Labels of three invented words: those that share any of their rarer bigrams are many times those that share a segment."""
    r = random.Random(4)
    syllables = ["ka", "lo", "mi", "ten", "ru", "sha", "vor", "qui", "zel", "pa"]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(2, 4)))
    labels = sorted({" ".join(sorted(word() for _ in range(3))) for _ in range(400)})
    grams = {x: {x[i : i + 2] for i in range(len(x) - 1)} for x in labels}
    uses = Counter(g for of in grams.values() for g in of)
    offered = {x: set(sorted(of, key=lambda g: (uses[g], g))[: max(1, len(of) - math.ceil(0.4 * len(x) - 1) + 1)]) for x, of in grams.items()}
    bigrams = sum(bool(offered[a] & offered[b]) for a, b in itertools.combinations(labels, 2))
    found = fuzzy.label_candidates(spark.createDataFrame([(x,) for x in labels], "label string"), 85.0).count()
    assert found < bigrams / 2


def test_thresholds_must_ask_for_something(spark):
    with pytest.raises(ValueError, match="over 0"):
        fuzzy.similar_pairs(spark.createDataFrame([("a",)], "label string"), 0.0)


def test_a_cluster_must_name_its_shared_folder():
    class Context:
        def __init__(self, master):
            self.master, self.folder = master, None

        def getCheckpointDir(self):  # noqa: N802
            return self.folder

        def setCheckpointDir(self, folder):  # noqa: N802
            self.folder = folder

    def session(master, folder=None):
        return SimpleNamespace(sparkContext=Context(master), conf=SimpleNamespace(get=lambda key, default: folder))

    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            shared_folder(session(master))
        assert shared_folder(session(master, "hdfs:///x/")) == "hdfs:///x"
    local = session("local[4]")
    assert shared_folder(local) == shared_folder(local)


def test_thirds_read_the_same_bounds_twice(spark):
    """Quantiles depend on the order of merging, so no two parts of a plan may compute them each for itself."""
    df = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v"), F.lit("c").alias("c"))
    made = sampling.thirds(df, "c", "v", "k")
    assert "percentile" not in made._jdf.queryExecution().optimizedPlan().toString()
    assert Counter(r.tertile for r in made.collect()) == {1: 334, 2: 333, 3: 333}
