"""Whole paths: from coded posts to report files, from files to tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.config import CODES, DIMENSIONS
from colloquy.operators import agreement, audit, coding, linking, reports, sampling, tables
from colloquy.operators.report_tables import report_tables
from colloquy.plans.coded import _SOURCES, CODED, RULES, coded_documents, with_thirds
from colloquy.plans.registry import query, table
from colloquy.plans.texts import _ratings, dealt, scratch
from colloquy.sources import readers, writers


_SUMS = {
    "community_profile": ("PUSH_count", "MOOR_count"),
    "tertile_sensitivity": ("PULL_count", "total"),
    "emergent_catalogue": ("frequency", "n_posts"),
    "cooccurrence": ("total", "src1"),
    "subcode_frequency": ("n_posts", "pct"),
    "code_heatmap": ("PUSH-01", "MOOR-I-02"),
}
_SQL_PUSH = " + ".join(f"sum({c.replace('-', '_')})" for c in CODES)


@query(
    CODED + ", s AS (SELECT source, count(*) AS n FROM documents GROUP BY source), " + f"k AS (SELECT count(*)::DOUBLE AS n, sum(PUSH_any)::DOUBLE AS push, sum(PULL_any)::DOUBLE AS pull, sum(MOOR_any)::DOUBLE AS moor, sum(PUSH_01)::DOUBLE AS push_01, sum(MOOR_I_02)::DOUBLE AS moor_i_02, ({_SQL_PUSH})::DOUBLE AS codes FROM posts) "
    "SELECT 'community_profile' AS name, (SELECT count(*) FROM s) AS n, push AS first, moor AS second FROM k "
    "UNION ALL SELECT 'tertile_sensitivity', (SELECT count(*) FROM (SELECT DISTINCT source, tertile FROM posts)), pull, n FROM k "
    "UNION ALL SELECT 'emergent_catalogue', count(*), sum(n)::DOUBLE, sum(n)::DOUBLE FROM s WHERE n > 1 "
    "UNION ALL SELECT 'cooccurrence', 16, (SELECT count(*) FROM posts WHERE source IN (" + ", ".join(repr(x) for x in _SOURCES) + "))::DOUBLE, (SELECT count(*) FROM posts WHERE source = 'src1')::DOUBLE "
    "UNION ALL SELECT 'subcode_frequency', 24, codes, round(codes * 100 / n, 6) FROM k UNION ALL SELECT 'code_heatmap', (SELECT count(*) FROM s), push_01, moor_i_02 FROM k"
)
def report_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All report tables written as CSV; rows and sums of two columns from the files. Each source brings up one theme, named too unlike the others to merge."""
    posts = with_thirds(coded_documents(spark, sf_dir, False))
    themes = posts.select(
        F.sha2("source", 256).alias("label"), F.col("source").alias("community"), F.col("doc_id").alias("post"), F.col("doc_id").alias("seq"), F.lit("d").alias("definition"), F.lit("q").alias("evidence_quote"), F.lit("").alias("partial_overlap_with"), F.lit("PUSH").alias("distinct_dimension")
    )
    made = report_tables(posts, themes, "doc_id", "source", "tertile", "n_chars", _SOURCES)
    path = scratch(spark, "report")
    writers.write_tables(made, path)
    out = None
    for name, columns in _SUMS.items():
        file = spark.read.option("header", True).csv(f"{path}/{name}")
        held = [c if c in file.columns else c.replace("-", "_") for c in columns]
        sums = file.agg(F.lit(name).alias("name"), F.count("*").alias("n"), *(F.round(F.sum(F.col(f"`{c}`").cast("double")), 6).alias(a) for c, a in zip(held, ("first", "second"), strict=True)))
        out = sums if out is None else out.unionByName(sums)
    return out


_SQL_RATED = (
    "WITH b AS (SELECT l.quality = 1 AS x1, l.toxic = 1 AS x2, d.n_chars > 400 AS y1, d.lang = 'de' AS y2 FROM labels l JOIN documents d USING (doc_id)), "
    "n AS (SELECT * FROM (SELECT 'PUSH-01' AS code, count(*) AS n, count(*) FILTER (x1) AS pos1, count(*) FILTER (y1) AS pos2, count(*) FILTER (x1 AND y1) AS both_pos FROM b UNION ALL "
    "SELECT 'PULL-02', count(*), count(*) FILTER (x2), count(*) FILTER (y2), count(*) FILTER (x2 AND y2) FROM b UNION ALL "
    "SELECT 'NONE', count(*), count(*) FILTER (NOT (x1 OR x2)), count(*) FILTER (NOT (y1 OR y2)), count(*) FILTER (NOT (x1 OR x2 OR y1 OR y2)) FROM b)), "
    f"a AS (SELECT c.code, c.code[-3] <> '-' AS is_dimension, (SELECT max(n) FROM n) AS n, coalesce(pos1, 0) AS pos1, coalesce(pos2, 0) AS pos2, coalesce(both_pos, 0) AS both_pos FROM (SELECT unnest({[*CODES, *DIMENSIONS, 'NONE']}) AS code) c "
    "LEFT JOIN (SELECT * FROM n UNION ALL SELECT left(code, 4), n, pos1, pos2, both_pos FROM n WHERE code <> 'NONE') m USING (code)), "
    "k AS (SELECT *, least(pos1, pos2) >= 5 AND pos1 < n AND pos2 < n AS ok, (n - pos1 - pos2 + 2 * both_pos)::DOUBLE / n AS po, (pos1::DOUBLE * pos2 + (n - pos1)::DOUBLE * (n - pos2)) / (n::DOUBLE * n) AS pe FROM a) "
)


@query(_SQL_RATED + "SELECT CASE WHEN is_dimension THEN 'dimensions' ELSE 'codes' END AS name, code, n, pos1, pos2, CASE WHEN ok THEN round((po - pe) / (1 - pe), 9) END AS kappa FROM k")
def kappa_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kappa by code and by dimension for a pair of raters, from the two files it is written to in report order."""
    ratings = _ratings(spark, sf_dir).withColumn("codes", F.transform("codes", lambda c: F.when(c == "GOOD", "PUSH-01").when(c == "TOXIC", "PULL-02").otherwise(c)))
    ratings = ratings.withColumn("codes", F.array_union("codes", F.array_distinct(F.transform("codes", lambda c: F.regexp_replace(c, "-[0-9]+$", "")))))
    pairs = spark.createDataFrame([("people", "rule")], "left string, right string")
    codes = spark.createDataFrame([(c,) for c in (*CODES, *DIMENSIONS, "NONE")], "code string")
    made = writers.kappa_tables(agreement.kappa(agreement.pair_counts(ratings, pairs, codes)), DIMENSIONS)
    path = scratch(spark, "kappa")
    writers.write_tables(made, path)
    files = [readers.read_csv(spark, f"{path}/{name}").withColumn("name", F.lit(name)) for name in made]
    return files[0].unionByName(files[1]).select("name", "code", *(F.col(c).cast("long").alias(c) for c in ("n", "pos1", "pos2")), F.round(F.col("kappa").cast("double"), 9).alias("kappa"))


@query("SELECT event_id FROM events WHERE event_id % 3 IN (0, 2)")
def machine_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of machine A: marked so, or not marked."""
    n = F.col("event_id") % 3
    rows = table(spark, sf_dir, "events").select("event_id", F.when(n == 0, '{"machine_partition":"A"}').when(n == 1, '{"machine_partition":"B"}').otherwise("{}").alias("extra_metadata"))
    return coding.partition_of(rows, "A").select("event_id")


@query("SELECT 'collected' AS part, doc_id AS key, md5(text) AS digest FROM documents UNION ALL SELECT 'coded', doc_id, md5(quality || '/' || toxic) FROM labels UNION ALL SELECT 'codebook', r_regionkey, md5(r_name) FROM region")
def bundle_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions saved as JSON bundles, for each source one for about 8 million characters, read into their three tables."""
    docs, labels, codes = (table(spark, sf_dir, t) for t in ("documents", "labels", "region"))
    none = lambda df, name: F.array().cast(f"array<{df.select(F.struct('*').alias('r')).schema['r'].dataType.simpleString()}>").alias(name)
    book = lambda c: F.struct(c.alias("codes")).alias("codebook")
    empty_codes = book(none(codes, "codes"))
    by_source = dealt(docs, "source", F.coalesce(F.length("text"), F.lit(0)) + 100, 8_000_000)
    collected = by_source.groupBy("source", "bundle").agg(F.collect_list(F.struct(*docs.columns)).alias("collected_data")).select("collected_data", none(labels, "coded_data"), empty_codes)
    coded = dealt(labels.withColumn("_all", F.lit(0)), "_all", F.lit(1), 10_000).groupBy("bundle").agg(F.collect_list(F.struct(*labels.columns)).alias("coded_data")).select(none(docs, "collected_data"), "coded_data", empty_codes)
    rest = codes.agg(F.collect_list(F.struct(*codes.columns)).alias("codes")).select(none(docs, "collected_data"), none(labels, "coded_data"), book(F.col("codes")))
    path = scratch(spark, "bundles")
    collected.unionByName(coded).unionByName(rest).write.option("maxRecordsPerFile", 1).json(path)
    read = readers.read_bundle(spark, path)
    shown = {"collected": ("doc_id", F.col("text")), "coded": ("doc_id", F.concat_ws("/", "quality", "toxic")), "codebook": ("r_regionkey", F.col("r_name"))}
    rows = [read[part].select(F.lit(part).alias("part"), F.col(key).cast("long").alias("key"), F.md5(value).alias("digest")) for part, (key, value) in shown.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("SELECT p_partkey AS zotero_key, CASE WHEN p_partkey % 3 = 0 THEN 'v2' ELSE 'v1' END AS title FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 = 0")
def reference_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References that come again replace what is stored."""
    keys = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("zotero_key"))
    stored = keys.where("zotero_key % 2 = 0").withColumn("title", F.lit("v1"))
    return tables.upsert(stored, keys.where("zotero_key % 3 = 0").withColumns({"title": F.lit("v2"), "seq": F.col("zotero_key")}), ["zotero_key"], "seq")


@query("SELECT doc_id, lang, toxic FROM labels JOIN documents USING (doc_id)")
def coded_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of coded rows; rows that were never collected drop out."""
    labels = table(spark, sf_dir, "labels")
    ghosts = labels.withColumn("doc_id", F.col("doc_id") + 10**9)
    found = linking.with_collected(labels.unionByName(ghosts), table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return found.where("lang is not null").select("doc_id", "lang", "toxic")


@query("SELECT p_partkey % 10 AS collection, p_partkey AS zotero_key, CASE WHEN p_partkey % 2 = 0 THEN 'old' ELSE 'new' END AS notes FROM part")
def reference_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of references to collections: each comes again, some twice, and those that are there stay as they are."""
    keys = table(spark, sf_dir, "part").select((F.col("p_partkey") % 10).alias("collection"), F.col("p_partkey").alias("zotero_key"))
    stored = keys.where("zotero_key % 2 = 0").withColumn("notes", F.lit("old"))
    again = keys.withColumns({"notes": F.lit("new"), "seq": F.col("zotero_key")})
    twice = again.unionByName(again.where("zotero_key % 3 = 0").withColumns({"notes": F.lit("second"), "seq": F.col("seq") + 10**9}))
    return tables.with_inserts(stored, twice, ["collection", "zotero_key"], "seq").select("collection", "zotero_key", "notes")


@query("SELECT doc_id, count(*) AS n FROM (SELECT doc_id FROM documents UNION ALL SELECT doc_id FROM documents WHERE doc_id % 3 = 0) GROUP BY doc_id")
def coded_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coded rows appended to their table in two runs; nothing looks whether they are there."""
    path = scratch(spark, "coded")
    coded = coded_documents(spark, sf_dir, False).select("doc_id", F.transform("deductive_codes", lambda c: c["code"]).alias("ppm_subcodes"))
    writers.append_coded(coded, path)
    writers.append_coded(coded.where("doc_id % 3 = 0"), path)
    return spark.read.parquet(path).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("SELECT doc_id, row_number() OVER (ORDER BY length(coalesce(text, '')), doc_id) AS turn FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def processing_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turn of each document that is not coded yet, the shortest first. A parallel job needs no order, so it is a column."""
    rows = linking.uncoded(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")
    placed = tables.numbered(rows.select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("size")), F.struct("size", "doc_id"), "turn")
    return placed.select("doc_id", "turn")


@query("SELECT 'fallback_leaks' AS gate, count(*) FILTER (text IS NULL AND doc_id % 2 = 0) AS value, count(*) FILTER (text IS NULL AND doc_id % 2 = 0) = 0 AS passed FROM documents UNION ALL SELECT 'rows', count(*), count(*) > 0 FROM documents UNION ALL SELECT 'rows_of_none', 0, false")
def export_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gates of an export: rows that fell back to raw values, and that there are rows. The last line is an export without rows."""
    docs = table(spark, sf_dir, "documents")
    leaked = F.col("text").isNull() & (F.col("doc_id") % 2 == 0)
    none = audit.gates(docs.where("false"), leaked).where("gate = 'rows'").withColumn("gate", F.lit("rows_of_none"))
    return audit.gates(docs, leaked).unionByName(none)


@query("SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 75")
def head_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows of a table in its order."""
    return sampling.head(table(spark, sf_dir, "documents"), 75, "doc_id").select("doc_id", "source")


_CATEGORY = "CASE WHEN h_PUSH_01 > 0 THEN 'Push' WHEN h_PULL_01 > 0 THEN 'Pull' ELSE 'NONE' END"
_LEVEL = "CASE WHEN greatest(h_PUSH_01, h_PULL_01) >= 3 THEN 'HIGH' WHEN greatest(h_PUSH_01, h_PULL_01) = 2 THEN 'MED' ELSE 'LOW' END"


@query(
    CODED + ", l AS (SELECT * FROM labels JOIN documents USING (doc_id)) "
    "SELECT 'A_periods' AS name, count(DISTINCT lang) AS n, count(*)::DOUBLE AS total FROM documents UNION ALL SELECT 'A_communities', count(DISTINCT source), count(*) FROM documents "
    f"UNION ALL SELECT 'C_categories', count(DISTINCT {_CATEGORY}), count(*) FROM posts UNION ALL SELECT 'C_confidences', count(DISTINCT {_LEVEL}), count(*) FROM posts "
    "UNION ALL SELECT 'C_top_codes', (sum(PUSH_01) > 0)::INT + (sum(PULL_01) > 0)::INT, sum(PUSH_01) + sum(PULL_01) FROM posts UNION ALL SELECT 'D_sample', 20, sum(doc_id) FROM (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 20) "
    "UNION ALL SELECT 'E_agreement', 3, round((avg(((quality = 1) = (n_chars > 400))::INT) + avg(((toxic = 1) = (lang = 'de'))::INT)) * 1.5, 6) FROM l "
    "UNION ALL SELECT 'F_quality', 2, count(*) FILTER (n_chars < 200) + count(*) FILTER (lang = 'en') FROM documents UNION ALL SELECT 'G_literature', 1, count(*) FROM part"
)
def appendix_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The data of all appendices written as CSV; rows and the sum of a column from the files."""
    docs = table(spark, sf_dir, "documents")
    rules = {c: r for c, r in RULES.items() if c in ("PUSH-01", "PULL-01")}
    codes = coding.code_by_rules(docs, rules, evidence=False).select("doc_id", F.transform("deductive_codes", lambda c: c["code"]).alias("codes"), F.transform("deductive_codes", lambda c: c["confidence"]).alias("levels"))
    category = F.when(F.array_contains("codes", "PUSH-01"), "Push").when(F.array_contains("codes", "PULL-01"), "Pull").otherwise("NONE")
    level = F.when(F.array_contains("levels", "HIGH"), "HIGH").when(F.array_contains("levels", "MED"), "MED").otherwise("LOW")
    coded = codes.select("doc_id", "codes", category.alias("category"), level.alias("confidence"))
    pairs, names = spark.createDataFrame([("people", "rule")], "left string, right string"), spark.createDataFrame([("GOOD",), ("TOXIC",)], "code string")
    parts = table(spark, sf_dir, "part")
    references = parts.select(F.col("p_partkey").alias("zotero_key"), F.split("p_name", " ").alias("keywords"))
    links = parts.select((F.col("p_partkey") % 10).alias("collection_hash"), F.col("p_partkey").alias("zotero_key"))
    made = reports.appendix_tables(docs, coded, agreement.pair_counts(_ratings(spark, sf_dir), pairs, names), references, links, "lang", "source", "doc_id", "codes", "doc_id", {"short": F.col("n_chars") < 200, "english": F.col("lang") == "en"})
    path = scratch(spark, "appendices")
    writers.write_tables(made, path)
    sums = {"D_sample": "doc_id", "E_agreement": "agreement", "G_literature": "n_links"}
    files = [readers.read_csv(spark, f"{path}/{name}").agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.round(F.sum(F.col(sums.get(name, "n")).cast("double")), 6).alias("total")) for name in made]
    out = files[0]
    for f in files[1:]:
        out = out.unionByName(f)
    return out
