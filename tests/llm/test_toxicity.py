import zlib

import pytest
from pyspark.sql import functions as F

from colloquy.llm import toxicity

from .helpers import edge_docs, empty_docs

INSULTS = "idiot moron stupid scum loser trash pathetic worthless disgusting clown dumb bastard jerk idiota estupido estúpido imbécil basura connard idiote imbécile minable trottel dummkopf abschaum versager".split()
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def scored(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.score(docs, toxicity.train(docs, labels)).join(labels, "doc_id", "left").collect()
    return docs, rows


def test_held_out_rows_are_those_of_the_fold(scored):
    docs, rows = scored
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_held_out_accuracy(scored):
    rows = [r for r in scored[1] if r.held_out and r.toxic is not None]
    bad, good = [r.score for r in rows if r.toxic], [r.score for r in rows if not r.toxic]
    auc = sum((b > g) + 0.5 * (b == g) for b in bad for g in good) / (len(bad) * len(good))
    assert auc > 0.8
    assert sum(r.predicted == r.toxic for r in rows) / len(rows) > 0.9


def test_only_the_text_counts(spark, scored):
    docs, rows = scored
    model = toxicity.Model(dict.fromkeys(INSULTS, 3.0), None, ())
    plain = toxicity.score(docs, model)
    changed = docs.withColumns({"lang": F.lit("xx"), "source": F.lit("y"), "n_chars": F.lit(0)})
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, toxicity.score(changed, model).collect()))


@pytest.mark.parametrize("text", ["You are an idiot", "you are an 1d10t", "YOU ARE AN IDIOT!", "IDIOT", "Espèce d'idiote, tu es minable"])
def test_lexicon_words_are_found(spark, text):
    model = toxicity.Model(dict.fromkeys(INSULTS, 3.0), None, ())
    rows = toxicity.score(spark.createDataFrame([(1, text), (2, "What a fine day!")], "doc_id long, text string"), model).collect()
    by = {r.doc_id: r.score for r in rows}
    assert by[1] > 0.3 > by[2]


@pytest.mark.parametrize("labels", [[], [(1, 1, 1)], [(1, 1, 1), (1, 1, 0), (2, 1, 0), (99, 0, 1), (None, 1, 1), (3, 1, None)]])
def test_edge_cases(spark, labels):
    docs = edge_docs(spark)
    model = toxicity.train(docs, spark.createDataFrame(labels, LABELS))
    assert toxicity.score(docs, model).count() == docs.count()
    clean = toxicity.clean_documents(docs, model)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    assert toxicity.score(empty_docs(spark), model).count() == 0
    toxicity.train(empty_docs(spark), spark.createDataFrame(labels, LABELS))


def test_features_named_like_columns(spark, scored):
    docs = scored[0].limit(50).withColumns({"features": F.lit(1), "prediction": F.lit("p"), "score": F.lit(2)})
    model = toxicity.Model({"idiot": 3.0}, None, ())
    assert toxicity.clean_documents(docs, model).columns == docs.columns


def test_the_sample_is_bounded(spark):
    labels = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    sample = toxicity.labelled_sample(docs, labels, 1_000)
    assert 800 < sample.count() < 1_200
    assert sample.where("crc32(cast(cast(doc_id as string) as binary)) % 4 = 2").count() == 0


def test_the_lexicon_comes_from_the_fitting_rows_alone(spark):
    schema = "toxic int, part int, terms array<string>"
    rows = [(int(i % 5 == 0), i % 10, ["zorvel", "plain"] if i % 5 == 0 else ["plain"]) for i in range(200)]
    assert set(toxicity.learn_lexicon(spark.createDataFrame(rows, schema))) == {"zorvel"}
    assert toxicity.learn_lexicon(spark.createDataFrame([], schema)) == {}
