"""Documents as posts: coded by phrases, profiled by source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.config import CODES, DIMENSION_OF, DIMENSIONS, SAFE_ENTITIES
from colloquy.functions import clean, jsonx
from colloquy.operators import coding, phrases, profile, sampling
from colloquy.plans.registry import ORACLES, SQL_NORM, query, table
from colloquy.shared import shared_path as scratch

RULES = {
    "PUSH-01": ("heed", "haed", "ndst"),
    "PUSH-04": ("loser", "scum", "trash"),
    "PULL-01": ("thing", "tion ", "oner"),
    "PULL-06": ("keit", "schaft", "ungen"),
    "MOOR-F-01": ("license", "copyright"),
    "MOOR-I-02": ("password", "token", "akia"),
    "MOOR-I-05": ("eau", "eux", "aux"),
}


def coded_documents(spark: SparkSession, sf_dir: str, evidence: bool = True) -> DataFrame:
    """The documents with deductive_codes; queries that only count codes need no evidence."""
    return coding.code_by_rules(table(spark, sf_dir, "documents"), RULES, evidence=evidence)


def with_thirds(rows: DataFrame) -> DataFrame:
    """Posts with their third by length; texts are left behind before rows are dealt out."""
    return sampling.thirds(rows.drop("text"), "source", "n_chars", "doc_id")


def _hits(code: str) -> str:
    return "(" + " + ".join(f"CASE WHEN contains(low, '{p}') THEN 1 ELSE 0 END" for p in RULES[code]) + ")"


def _name(code: str) -> str:
    return code.replace("-", "_")


#: One row per document with hits of each rule (h_<code>) and the third of its source.
CODED = (
    "WITH base AS (SELECT *, lower(coalesce(text, '')) AS low, ntile(3) OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS tertile FROM documents), "
    + "coded AS (SELECT *, " + ", ".join(f"{_hits(c)} AS h_{_name(c)}" for c in RULES) + " FROM base), "
    + "flags AS (SELECT *, "
    + ", ".join(f"({' OR '.join(f'h_{_name(c)} > 0' for c in RULES if DIMENSION_OF[c] == d)})::INT AS {_name(d)}_any" for d in DIMENSIONS)
    + ", " + ", ".join(f"(h_{_name(c)} > 0)::INT AS {_name(c)}" if c in RULES else f"0 AS {_name(c)}" for c in CODES)
    + ", (" + " AND ".join(f"h_{_name(c)} <= 1" for c in RULES) + " AND (" + " OR ".join(f"h_{_name(c)} > 0" for c in RULES) + "))::INT AS all_low FROM coded), "
    + "posts AS (SELECT *, greatest(MOOR_F_any, MOOR_I_any) AS MOOR_any, 1 - greatest(PUSH_any, PULL_any, MOOR_F_any, MOOR_I_any) AS NONE_any FROM flags) "
)
_DIMS = ("PUSH", "PULL", "MOOR_F", "MOOR_I", "MOOR", "NONE")
_COUNTS = ", ".join(f"sum({d}_any)::BIGINT AS {d}_count" for d in _DIMS)
_PCTS = ", ".join(f"sum({d}_any) * 100.0::DOUBLE / count(*) AS {d}_pct" for d in _DIMS)
_DOMINANT = (
    "CASE WHEN greatest(sum(PUSH_any), sum(PULL_any), sum(MOOR_F_any), sum(MOOR_I_any)) = 0 THEN 'N/A' "
    + " ".join(f"WHEN sum({_name(d)}_any) = greatest(sum(PUSH_any), sum(PULL_any), sum(MOOR_F_any), sum(MOOR_I_any)) THEN '{d}'" for d in DIMENSIONS)
    + " END AS dominant"
)


@query(CODED + f"SELECT source, count(*) AS total, {_COUNTS}, {_PCTS}, {', '.join(f'sum({_name(c)})::BIGINT AS {_name(c)}' for c in CODES)}, {_DOMINANT} FROM posts GROUP BY source")
def community_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.community_profile(profile.post_flags(coded_documents(spark, sf_dir, False), "doc_id", "source"), "source")


@query(
    CODED
    + f", cells AS (SELECT source, tertile, count(*) AS total, {_COUNTS}, {_PCTS}, sum(all_low) AS low, coalesce(avg(n_chars), 0.0) AS mean_length FROM posts GROUP BY source, tertile), "
    + "r AS (SELECT *, coalesce(max(CASE WHEN tertile = 1 THEN PUSH_count / total END) OVER w, 0) AS p1, coalesce(max(CASE WHEN tertile = 3 THEN PUSH_count / total END) OVER w, 0) AS p3, "
    + "coalesce(max(CASE WHEN tertile = 1 THEN MOOR_I_count / total END) OVER w, 0) AS m1, coalesce(max(CASE WHEN tertile = 3 THEN MOOR_I_count / total END) OVER w, 0) AS m3 FROM cells WINDOW w AS (PARTITION BY source)) "
    + f"SELECT source, tertile::INT AS tertile, total, {', '.join(f'{d}_count, {d}_pct' for d in _DIMS)}, p1 > p3 + 0.2::DOUBLE AS flag_push_bias, m3 > m1 + 0.15::DOUBLE AS flag_moor_lower, "
    + "low / total > 0.3::DOUBLE AS flag_low_confidence, low / total > 0.3::DOUBLE AND mean_length < 150 AS flag_body_length FROM r"
)
def tertile_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = with_thirds(profile.post_flags(coded_documents(spark, sf_dir, False), "doc_id", "source", extra=("n_chars",)))
    return profile.tertile_sensitivity(flags, "source", "tertile", "n_chars")


_SOURCES = [f"src{i}" for i in range(20)]
_COMBO = "coalesce(nullif(concat_ws('+', " + ", ".join(f"CASE WHEN {_name(d)}_any = 1 THEN '{d}' END" for d in DIMENSIONS) + "), ''), 'NONE')"


@query(
    CODED
    + f", c AS (SELECT {_COMBO} AS combination, source FROM posts), f AS (SELECT unnest([{', '.join(repr(x) for x in profile._combinations())}]) AS combination, unnest(range(16)) AS place) "
    + f"SELECT f.place::INT AS place, f.combination, {', '.join(f'''count(*) FILTER (source = '{s}') AS {s}''' for s in _SOURCES)}, count(*) FILTER (source IN ({', '.join(repr(s) for s in _SOURCES)})) AS total FROM f LEFT JOIN c USING (combination) GROUP BY ALL"
)
def dimension_cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.cooccurrence(coded_documents(spark, sf_dir, False), "source", _SOURCES)


@query(CODED + " UNION ALL ".join(f"SELECT '{c}' AS code, coalesce(sum({_name(c)}), 0)::BIGINT AS n_posts, coalesce(sum({_name(c)}) * 100.0::DOUBLE / nullif(count(*), 0), 0.0) AS pct FROM posts" for c in CODES))
def subcode_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.subcode_frequency(profile.post_flags(coded_documents(spark, sf_dir, False), "doc_id", "source"))


@query(ORACLES["subcode_frequency"].replace("AS pct", "AS share").replace(CODED, CODED + ", f AS (") + ") SELECT code, format('{:.2f}%', share) AS shown FROM f")
def code_percentages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of each code as it is printed."""
    sums = profile.subcode_frequency(profile.post_flags(coded_documents(spark, sf_dir, False), "doc_id", "source"))
    total = table(spark, sf_dir, "documents").agg(F.count("*").alias("total"))
    return sums.join(total).select("code", clean.percent_text(F.col("n_posts"), F.col("total")).alias("shown"))  # one row beside


@query(CODED + f"SELECT source, {', '.join(f'sum({_name(c)})::BIGINT AS {_name(c)}' for c in CODES)} FROM posts GROUP BY source")
def code_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = coded_documents(spark, sf_dir, False)
    return profile.code_heatmap(profile.post_flags(coded, "doc_id", "source"), "source", coded.select("source").distinct())


def _dimension_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(DIMENSION_OF.items()), "code string, dimension string")


@query(
    CODED
    + ", long AS (" + " UNION ALL ".join(f"SELECT doc_id, '{c}' AS code, '{DIMENSION_OF[c]}' AS dimension, h_{_name(c)} AS h FROM posts WHERE h_{_name(c)} > 0" for c in RULES)
    + " UNION ALL SELECT doc_id, NULL, NULL, 0 FROM posts WHERE NONE_any = 1) "
    + "SELECT code, dimension, count(*) AS n_rows, count(*) FILTER (h >= 3) AS n_high FROM long GROUP BY code, dimension"
)
def exploded_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = coded_documents(spark, sf_dir, False).withColumn("codes", F.transform("deductive_codes", lambda c: c["code"]))
    rows = jsonx.explode_codes(coded, _dimension_table(spark))
    level = F.filter("deductive_codes", lambda c: c["code"] == F.col("code"))[0]["confidence"]
    return rows.groupBy("code", "dimension").agg(F.count("*").alias("n_rows"), F.count_if(F.when(F.col("code").isNotNull(), level == "HIGH")).alias("n_high"))


_FIRST = ", ".join(
    f"substr(text, least({', '.join(f'''nullif(instr(low, '{p}'), 0)''' for p in RULES[c])}), 60) AS q_{_name(c)}" for c in RULES
)


@query(CODED + "SELECT doc_id, code, quote FROM (" + " UNION ALL ".join(f"SELECT doc_id, '{c}' AS code, q_{_name(c)} AS quote, h_{_name(c)} AS h FROM (SELECT doc_id, h_{_name(c)}, {_FIRST.split(', substr')[i] if i == 0 else 'substr' + _FIRST.split(', substr')[i]} FROM posts)" for i, c in enumerate(RULES)) + ") WHERE h > 0")
def rule_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coded_documents(spark, sf_dir).select("doc_id", F.inline("deductive_codes")).select("doc_id", "code", F.col("evidence_quote").alias("quote"))


_N_CODES = "(" + " + ".join(f"(h_{_name(c)} > 0)::INT" for c in RULES) + ")"
_HEADS = "(greatest(PUSH_any) + PULL_any + MOOR_any)"
_ANY = lambda level: "(" + " OR ".join(f"h_{_name(c)} {level}" for c in RULES) + ")"


@query(
    CODED
    + f"SELECT doc_id, CASE WHEN {_N_CODES} = 0 THEN 'NONE' WHEN {_HEADS} > 1 THEN 'Mixed' WHEN PUSH_any = 1 THEN 'Push' WHEN PULL_any = 1 THEN 'Pull' ELSE 'Mooring' END AS ppm_category, "
    + f"CASE WHEN {_ANY('= 1')} THEN 'LOW' WHEN {_ANY('= 2')} THEN 'MED' WHEN {_ANY('> 2')} THEN 'HIGH' ELSE 'N/A' END AS confidence, {_N_CODES}::BIGINT AS n_codes, "
    + f"concat_ws(',', CASE WHEN length(coalesce(text, '')) < 100 THEN 'SHORT_FORM_BODY' END, CASE WHEN {_N_CODES} = 0 AND length(text) > 250 THEN 'NO_CODES_LONG_BODY' END, CASE WHEN all_low = 1 THEN 'ALL_LOW_CONFIDENCE' END) AS flags FROM posts"
)
def coded_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = coding.assemble(coded_documents(spark, sf_dir), "text", F.lit("A_keyword"))
    shown = F.array_join(F.array_remove("circuit_breaker_flags", "PII_ENTITY_MATCH"), ",")
    return rows.select("doc_id", "ppm_category", "confidence", F.size("ppm_subcodes").cast("long").alias("n_codes"), shown.alias("flags"))


@query(
    CODED + "SELECT count(*) AS n_initial, count(*) FILTER (k) AS n_kept, count(*) FILTER (k AND doc_id % 2 = 0) AS n_posts, count(*) FILTER (k AND doc_id % 2 = 1) AS n_replies, count(*) - count(*) FILTER (k) AS n_excluded "
    "FROM (SELECT *, lang <> 'fr' AND doc_id % 3 <> 0 AND source <> 'src1' AND doc_id % 5 <> 0 AS k FROM posts)"
)
def eligible_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = _runs(spark, sf_dir)
    return profile.filter_counts(coded, profile.stratum(profile.eligible(coded), "full_corpus"))


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coded_documents(spark, sf_dir).select(
        F.concat(F.when(F.col("doc_id") % 2 == 0, "t3_").otherwise("t1_"), F.col("doc_id")).alias("post_id"),
        F.when(F.col("lang") != "fr", "llama3").otherwise("other").alias("model"),
        F.when(F.col("doc_id") % 3 == 0, "None").otherwise("A").alias("machine_partition"),
        F.when(F.col("source") == "src1", "json_endpoint").alias("data_source"),
        F.when(F.col("doc_id") % 5 == 0, "unverifiable_quote").alias("quarantine_reason"),
    )


@query(ORACLES["eligible_counts"].replace(" FROM (SELECT *", ", count(*) FILTER (k) AS n_written FROM (SELECT *"))
def eligible_on_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same counts, taken while the posts that count are filtered and written."""
    path = scratch(spark, "eligible")
    counts = profile.write_eligible(_runs(spark, sf_dir), path)
    return spark.read.parquet(path).agg(*(F.lit(n).cast("long").alias(c) for c, n in counts.items()), F.count("*").alias("n_written"))


@query(CODED + "SELECT source, count(*) AS n, sum(PUSH_any)::BIGINT AS push, sum(PULL_any)::BIGINT AS pull, sum(MOOR_any)::BIGINT AS mooring, (sum(PULL_any) - sum(PUSH_any))::DOUBLE / nullif(sum(PULL_any) + sum(PUSH_any), 0) AS x, 100.0::DOUBLE * sum(MOOR_any) / count(*) AS y FROM posts GROUP BY source")
def coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = profile.post_flags(coded_documents(spark, sf_dir, False), "doc_id", "source")
    counts = flags.groupBy("source").agg(F.count("*").alias("n"), *(F.sum(f"{d}_any").cast("long").alias(n) for d, n in (("PUSH", "push"), ("PULL", "pull"), ("MOOR", "mooring"))))
    return profile.coordinates(counts)


@query(
    CODED + ", p AS (SELECT (sum(PULL_any) - sum(PUSH_any))::DOUBLE / nullif(sum(PULL_any) + sum(PUSH_any), 0) AS x, 100.0::DOUBLE * sum(MOOR_any) / count(*) AS y FROM posts GROUP BY source) "
    "SELECT CASE WHEN y >= (SELECT median(y) FROM p) THEN 'high' ELSE 'low' END || '_' || CASE WHEN x > 0 THEN 'right' ELSE 'left' END AS quadrant, count(*) AS n_points, (SELECT median(y) FROM p) AS median_y FROM p GROUP BY 1"
)
def quadrants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.quadrants(coordinates(spark, sf_dir))


@query("SELECT source, CASE WHEN source IN ('src0', 'src1', 'src2') THEN 'first' ELSE 'other' END AS archetype, count(*) AS n FROM documents GROUP BY 1, 2")
def archetypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    points = docs.groupBy("source").agg(F.count("*").alias("n"))
    kinds = docs.select("source").distinct().withColumn("archetype", F.when(F.col("source").isin("src0", "src1", "src2"), "first").otherwise("other"))
    return profile.with_archetype(points.withColumn("source", F.concat(F.lit("r/"), F.col("source"))), kinds, "source").withColumn("source", F.regexp_replace("source", "^r/", ""))


_NGRAMS = (
    CODED + f", few AS (SELECT doc_id, {SQL_NORM.format('text')} AS norm FROM (SELECT doc_id, coalesce(text, '') AS text FROM posts WHERE {_N_CODES} <= 1)), t AS (SELECT doc_id, list_filter(string_split(norm, ' '), lambda w: length(w) > 2) AS t FROM few), "
    "g AS (SELECT doc_id, size, unnest(list_transform(range(1, len(t) - size + 2), lambda i: array_to_string(t[i:i + size - 1], ' '))) AS phrase FROM t, (SELECT unnest({sizes}) AS size) WHERE len(t) >= size), "
    "n AS (SELECT phrase, size, count(DISTINCT doc_id) AS n_posts, min(doc_id) AS first_post FROM g GROUP BY 1, 2 HAVING count(DISTINCT doc_id) >= 3) "
)
_KNOWN = ", ".join(f"'{p}'" for r in RULES.values() for p in r)


@query(_NGRAMS.replace("{sizes}", "[2]") + f"SELECT phrase, n_posts, first_post FROM n WHERE phrase NOT IN ({_KNOWN})")
def emergent_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coding.emergent_phrases(coded_documents(spark, sf_dir, False), [p for r in RULES.values() for p in r], "doc_id")


@query(_NGRAMS.replace("{sizes}", "[2, 3, 4, 5]") + "SELECT phrase, size::INT AS size, n_posts, first_post FROM n WHERE phrase NOT IN (SELECT DISTINCT lower(p_name) FROM part)")
def emergent_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases of two to five words that recur in posts with few codes; the names of parts are known already."""
    known = table(spark, sf_dir, "part").select(F.lower("p_name").alias("phrase"))
    return phrases.emergent_ngrams(coded_documents(spark, sf_dir, False), known, "doc_id", sizes=(2, 3, 4, 5))


#: A codebook with a phrase from every document and every benchmark passage, dealt to seven codes.
_BOOK = (
    "book AS (SELECT 'P' || (doc_id % 7) AS code, lower(substring(text, 3, 12)) AS phrase FROM documents WHERE length(text) >= 14 UNION SELECT 'Q' || (item_id % 3), lower(substring(text, 20, 12)) FROM benchmark), "
    "d AS (SELECT doc_id, text, lower(coalesce(text, '')) AS low FROM documents), "
    "h AS (SELECT doc_id, text, code, count(*) AS n, min(instr(low, phrase)) AS place FROM d JOIN (SELECT DISTINCT * FROM book WHERE phrase <> '') ON contains(low, phrase) GROUP BY ALL) "
)


def phrase_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where(F.length("text") >= 14)
    own = docs.select(F.concat(F.lit("P"), F.col("doc_id") % 7).alias("code"), coding.lowered(F.substring("text", 3, 12)).alias("phrase"))
    return own.union(table(spark, sf_dir, "benchmark").select(F.concat(F.lit("Q"), F.col("item_id") % 3), coding.lowered(F.substring("text", 20, 12))))


@query("WITH " + _BOOK + "SELECT doc_id, code, substr(text, place, 60) AS quote, CASE WHEN n >= 3 THEN 'HIGH' WHEN n = 2 THEN 'MED' ELSE 'LOW' END AS confidence FROM h")
def phrase_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents coded by a table with as many phrases as there are documents."""
    coded = phrases.code_by_phrases(table(spark, sf_dir, "documents"), phrase_book(spark, sf_dir))
    return coded.select("doc_id", F.inline("deductive_codes")).select("doc_id", "code", F.col("evidence_quote").alias("quote"), "confidence")


@query("WITH " + _BOOK + ", e AS (SELECT unnest(regexp_extract_all(substr(text, place, 60), '[A-Z][a-z]{3,}')) AS entity, doc_id FROM h) SELECT entity, count(*) AS n, min(doc_id) AS first_doc FROM e WHERE lower(entity) NOT IN (SELECT DISTINCT lower(string_split(text, ' ')[1]) FROM benchmark WHERE text IS NOT NULL) GROUP BY 1")
def unsafe_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capitalised words in the evidence that are not in a table of safe names (here the first words of benchmark passages)."""
    quotes = phrase_codes(spark, sf_dir).select("doc_id", F.explode(F.regexp_extract_all("quote", F.lit("[A-Z][a-z]{3,}"), F.lit(0))).alias("entity"))
    safe = table(spark, sf_dir, "benchmark").select(F.split("text", " ")[0].alias("name"))
    return phrases.unsafe_entities(quotes, safe).groupBy("entity").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


@query(
    CODED + ", f AS (SELECT doc_id, source, (length(coalesce(text, '')) < 100 OR (NONE_any = 1 AND length(text) > 250) OR all_low = 1) AS flagged FROM posts), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY flagged DESC, CASE WHEN flagged THEN doc_id END NULLS LAST, md5('11:' || doc_id), doc_id)::INT AS place, count(*) OVER (PARTITION BY source) AS n FROM f) "
    "SELECT doc_id, source, flagged, place FROM r WHERE place <= least(greatest(n // 5, 1), 20)"
)
def review_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = coding.assemble(coded_documents(spark, sf_dir), "text", F.lit("A_keyword"))
    flags = F.array_remove("circuit_breaker_flags", "PII_ENTITY_MATCH")  # names have no SQL
    flagged = rows.select("doc_id", "source", (F.size(flags) > 0).alias("flagged"))
    return sampling.review_sample(flagged, "source", "doc_id", "flagged", seed=11)


@query(
    CODED + "SELECT doc_id, source = 'src3' AND (length(coalesce(text, '')) < 100 OR (NONE_any = 1 AND length(text) > 250) OR all_low = 1) AS researcher_override, "
    "CASE WHEN source = 'src3' AND (length(coalesce(text, '')) < 100 OR (NONE_any = 1 AND length(text) > 250) OR all_low = 1) THEN 'checked' END AS override_notes FROM posts"
)
def override_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = coding.assemble(coded_documents(spark, sf_dir), "text", F.lit("A_keyword")).withColumn("circuit_breaker_flags", F.array_remove("circuit_breaker_flags", "PII_ENTITY_MATCH"))
    notes = table(spark, sf_dir, "documents").where("source = 'src3'").select("source", F.lit("checked").alias("note")).distinct()
    return coding.apply_overrides(rows, notes, "source", "doc_id").select("doc_id", "researcher_override", "override_notes")


_QUOTED = ", ".join(f"CASE WHEN h_{_name(c)} > 0 THEN q_{_name(c)} END" for c in RULES)
_SAFE = ", ".join("'" + e.replace("'", "''") + "'" for e in SAFE_ENTITIES)


@query(
    CODED + f", quotes AS (SELECT doc_id, unnest([{_QUOTED}]) AS quote FROM (SELECT doc_id, {', '.join(f'h_{_name(c)}' for c in RULES)}, {_FIRST} FROM posts)), "
    # A mark behind a small letter or comma and a blank stands for the look-behind.
    + r"found AS (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(quote, '([a-z,] )', '\1' || chr(1), 'g'), '\x01[A-Z][A-Za-z-]{2,}(?:''s)?|\bu/[A-Za-z0-9_]{3,20}\b|(?i:https?://\S+|\bwww\.\S+)')) AS e FROM quotes WHERE quote IS NOT NULL), "
    + "bare AS (SELECT doc_id, regexp_replace(replace(e, chr(1), ''), '''s$', '') AS entity FROM found) "
    + f"SELECT entity, count(DISTINCT doc_id) AS n, min(doc_id) AS first_doc FROM bare WHERE lower(entity) NOT IN ({_SAFE}) GROUP BY entity"
)
def entity_tripwire(spark: SparkSession, sf_dir: str) -> DataFrame:
    quotes = coded_documents(spark, sf_dir).withColumn("quotes", F.transform("deductive_codes", lambda c: c["evidence_quote"]))
    return quotes.select("doc_id", F.explode(coding.entity_candidates(F.col("quotes"))).alias("entity")).groupBy("entity").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))
