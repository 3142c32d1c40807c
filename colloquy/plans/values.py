"""Cleaning and JSON on texts derived from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.config import CODES, COMMUNITY_IDS, DIMENSIONS, FILLER_PHRASES
from colloquy.functions import clean, jsonx
from colloquy.operators import audit, coding
from colloquy.plans.registry import ORACLES, SQL_NORM, query, table
from colloquy.shared import shared_path as scratch
from colloquy.sources.readers import named_community


def _pick(n: Column, *texts: str | None) -> Column:
    """One of several texts by the remainder of a number."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for i, t in enumerate(texts):
        out = out.when(F.pmod(n, F.lit(len(texts))) == i, F.lit(t))
    return out


def _sql_pick(n: str, *texts: str | None) -> str:
    quoted = ["NULL" if t is None else "'" + t.replace("'", "''") + "'" for t in texts]
    return f"CASE {n} % {len(texts)} " + " ".join(f"WHEN {i} THEN {t}" for i, t in enumerate(quoted)) + " END"


_SCORES = ("1525.0", "nan", None, "x", "", "-3.9", "12", " 7 ", "1e3")
_FLAGS = ("true", "TRUE ", "", "false", None, " True", "yes")
_RATIOS = ("0.98765432", " ", "x", None, "1", "0.5")


@query(
    f"SELECT event_id, coalesce(TRY_CAST(trunc(TRY_CAST(CASE WHEN s IN ('nan') THEN NULL ELSE trim(s) END AS DOUBLE)) AS INTEGER), 0) AS score, coalesce(lower(trim(b)) = 'true', false) AS nsfw, round(TRY_CAST(trim(r) AS DOUBLE), 6) AS ratio "
    f"FROM (SELECT event_id, {_sql_pick('event_id', *_SCORES)} AS s, {_sql_pick('event_id', *_FLAGS)} AS b, {_sql_pick('event_id', *_RATIOS)} AS r FROM events)"
)
def clean_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(n, _pick(n, *_SCORES).alias("s"), _pick(n, *_FLAGS).alias("b"), _pick(n, *_RATIOS).alias("r"))
    return rows.select("event_id", clean.score(F.col("s")).alias("score"), clean.flag(F.col("b")).alias("nsfw"), clean.ratio(F.col("r")).alias("ratio"))


_TEXTS = ("NaN", " kept ", "None", "null", "  ", "a\tb", None, "\n", "nan?")
_LINKS = ("//r/a", "/r/b/c", "plain", "", None)


@query(
    rf"SELECT event_id, CASE WHEN x NOT IN ('', 'NaN', 'nan', 'None', 'none', 'null', 'NULL') THEN x END AS text, regexp_replace(l, '^/+', '') AS permalink FROM (SELECT event_id, regexp_replace({_sql_pick('event_id', *_TEXTS)}, '^\s+|\s+$', '', 'g') AS x, {_sql_pick('event_id', *_LINKS)} AS l FROM events)"
)
def clean_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    return table(spark, sf_dir, "events").select(n, clean.text_field(_pick(n, *_TEXTS)).alias("text"), clean.permalink(_pick(n, *_LINKS)).alias("permalink"))


@query(
    "SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 0.0 ELSE epoch(o_orderdate::DATE::TIMESTAMP) END AS seconds, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day, "
    "CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE year(o_orderdate)::INT END AS year, CASE WHEN o_orderkey % 4 < 3 THEN (o_orderkey % 4)::INT END AS tertile FROM orders"
)
def clean_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose key ends in 0 carry a date that does not exist."""
    n = F.col("o_orderkey")
    day = F.when(n % 10 == 0, "2024-02-30").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    rows = table(spark, sf_dir, "orders").select(n, clean.utc_seconds(day).alias("seconds"), clean.tertile(_pick(n, "0", "1", "2", "x")).alias("tertile"))
    return rows.select(n, "seconds", clean.iso_date(F.col("seconds")).alias("day"), clean.year_of(F.col("seconds")).alias("year"), "tertile")


@query(
    "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 't3_' || c_custkey WHEN c_custkey % 3 = 1 THEN 't3_' || c_custkey ELSE 't3_t1_' || c_custkey END AS full_id, "
    "CASE WHEN c_custkey % 3 = 2 THEN 't1_' || c_custkey ELSE c_custkey::VARCHAR END AS bare_id, CASE c_custkey % 3 WHEN 0 THEN 'submission' WHEN 2 THEN 'comment' END AS kind FROM customer"
)
def id_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("c_custkey")
    key = F.concat(_pick(n, "t3_", "", "t1_"), n)
    return table(spark, sf_dir, "customer").select(n, clean.with_prefix(key).alias("full_id"), clean.without_prefix(key).alias("bare_id"), clean.kind_of(key).alias("kind"))


@query(
    r"SELECT doc_id, length(coalesce(text, ''))::INT AS body_length, CASE WHEN length(text) > 80 THEN left(text, 80) || '…' ELSE text END AS shown, "
    r"len(regexp_extract_all(text, '\S+'))::INT AS n_words, (length(text) - length(replace(text, ' ', '')) + 1)::INT AS n_parts FROM documents"
)
def text_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", clean.body_length(t).alias("body_length"), clean.shortened(t, 80).alias("shown"), clean.word_count(t).alias("n_words"), clean.space_parts(t).alias("n_parts"))


_RAW_CODES = ("PUSH-01", " [EMPTY] ", "none", "push-03", "EMER-04", "PUSH-99", "", "emergent x", "NONE", " MOOR-I-06 ")


@query(
    f"SELECT event_id, length(t) > 0 AND (upper(t) IN ('NONE', {', '.join(repr(c) for c in CODES)}) OR starts_with(upper(t), 'EMER-') OR starts_with(upper(t), 'EMERGENT')) AS valid, lower(t) NOT IN ('[empty]', 'empty', 'none', '') AS filled, "
    f"lower(m) IN ('1', '1.0', 'x', 'true', 'yes') AS marked FROM (SELECT event_id, trim({_sql_pick('event_id', *_RAW_CODES)}) AS t, trim({_sql_pick('event_id', '1', '1.0', 'X', ' yes', '0', '', 'TRUE')}) AS m FROM events)"
)
def code_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(n, _pick(n, *_RAW_CODES).alias("c"), _pick(n, "1", "1.0", "X", " yes", "0", "", "TRUE").alias("m"))
    return rows.select(n, clean.valid_code(F.col("c")).alias("valid"), (F.size(clean.filled_codes(F.array("c"))) == 1).alias("filled"), clean.marked(F.col("m")).alias("marked"))


@query(
    "SELECT event_id, CASE WHEN k IS NULL THEN 'N/A' WHEN k < 0 THEN 'Poor' WHEN k < 0.2::DOUBLE THEN 'Slight' WHEN k <= 0.4::DOUBLE THEN 'Fair' WHEN k <= 0.6::DOUBLE THEN 'Moderate' WHEN k <= 0.8::DOUBLE THEN 'Substantial' ELSE 'Almost perfect' END AS band "
    "FROM (SELECT event_id, CASE WHEN user_id % 13 > 0 THEN (((value * 100)::BIGINT % 131) - 30)::DOUBLE / 100 END AS k FROM events)"
)
def agreement_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of events, brought between -0.3 and 1, as kappas; some have none."""
    k = F.when(F.col("user_id") % 13 > 0, (F.round(F.col("value") * 100).cast("long") % 131 - 30).cast("double") / 100).otherwise(F.lit(float("nan")))
    return table(spark, sf_dir, "events").select("event_id", clean.agreement_band(k).alias("band"))


@query(
    "SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN true ELSE true END AS stored, sha256(c_name) AS pseudonym, "
    "left(sha256('{\"c_custkey\":' || c_custkey || ',\"c_name\":\"' || c_name || '\",\"c_nationkey\":' || c_nationkey || '}'), 16) AS fingerprint FROM customer"
)
def pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("c_custkey")
    author = F.when(n % 5 == 0, F.lit("[deleted]")).when(n % 5 == 1, F.col("c_name")).when(n % 5 == 2, F.sha2("c_name", 256)).when(n % 5 == 3, F.concat(F.lit("anon_"), n))
    return table(spark, sf_dir, "customer").select(n, clean.pseudonymous(author).alias("stored"), clean.pseudonym(F.col("c_name"), "hash").alias("pseudonym"), clean.row_fingerprint("c_custkey", "c_name", "c_nationkey").alias("fingerprint"))


@query("SELECT doc_id, sha256(" + SQL_NORM.format("text") + ") AS norm_hash, length(" + SQL_NORM.format("text") + ")::INT AS norm_length FROM documents")
def normalised_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    norm = clean.normalised_text(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(norm, 256).alias("norm_hash"), F.length(norm).alias("norm_length"))


_FILLERS = ", ".join(f"'{p}'" for p in FILLER_PHRASES)


@query(
    r"WITH d AS (SELECT doc_id, doc_id % 8 = 5 AS filler, ['thanks', 'Me too', 'so true', 'no comment'][doc_id // 8 % 4 + 1] AS phrase, text FROM documents), "
    r"t AS (SELECT doc_id, CASE WHEN filler THEN repeat(phrase || '! ', CASE WHEN phrase = 'no comment' THEN 8 ELSE 1 END) || repeat('!?', 30) ELSE text END AS text FROM d) "
    r"SELECT doc_id, CASE WHEN length(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g')) < 40 THEN 'skipped_short_form' "
    rf"WHEN trim(regexp_replace(regexp_replace(lower(text), '[^\p{{L}}\p{{M}}\p{{N}}_\s]', '', 'g'), '\s+', ' ', 'g')) IN ('', {_FILLERS}) THEN 'skipped_filler_content' "
    r"WHEN length(regexp_replace(text, '[^\x00-\x7F]', '', 'g'))::DOUBLE / length(' ' || text) < 0.7 THEN 'skipped_non_latin' ELSE 'code' END AS route FROM t"
)
def routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, every eighth with a stock phrase and a run of marks in place of its text."""
    n = F.col("doc_id")
    phrase = F.get(F.array(*(F.lit(p) for p in ("thanks", "Me too", "so true", "no comment"))), F.floor(n / 8) % 4)
    filler = F.concat(F.expr("repeat(concat(phrase, '! '), case when phrase = 'no comment' then 8 else 1 end)"), F.lit("!?" * 30))
    docs = table(spark, sf_dir, "documents").withColumn("phrase", phrase).withColumn("text", F.when(n % 8 == 5, filler).otherwise(F.col("text")))
    return coding.route(docs, None, "text").select("doc_id", "route")


@query(r"SELECT conv_id, turn, regexp_matches(text, 'https?://|www\.') AS identifying, length(regexp_replace(text, '[^\x00-\x7F]', '', 'g'))::DOUBLE / nullif(length(text), 0) AS ascii_share FROM conversations")
def turn_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", coding.identifying(F.col("text")).alias("identifying"), clean.ascii_share(F.col("text")).alias("ascii_share"))


@query("SELECT event_id, format('{:d} ({:.1f}%)', (event_id % 40)::INT, (event_id % 40) * 100.0 / 64) || CASE WHEN event_id % 40 < 10 THEN '*' ELSE '' END AS cell FROM events")
def display_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of counts of 64; an eighth of the percentages are ties at the shown digit, which go to the even one."""
    return table(spark, sf_dir, "events").select("event_id", clean.cell(F.col("event_id") % 40, F.lit(64)).alias("cell"))


_IDS = [*COMMUNITY_IDS, "t5_other", None]


@query(
    "SELECT doc_id, coalesce(nullif((CASE WHEN doc_id % 3 = 0 THEN source WHEN doc_id % 3 = 1 THEN '' END), ''), CASE doc_id % 8 " + " ".join(f"WHEN {i} THEN '{COMMUNITY_IDS.get(k, k)}'" for i, k in enumerate(_IDS) if k) + " END) AS community FROM documents"
)
def community_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The name that is given, or the one that belongs to the id, or the id."""
    key = F.get(F.array(*map(F.lit, _IDS)), (F.col("doc_id") % len(_IDS)).cast("int"))
    name = F.when(F.col("doc_id") % 3 == 0, F.col("source")).when(F.col("doc_id") % 3 == 1, "")
    return table(spark, sf_dir, "documents").select("doc_id", named_community(None, name, key).alias("community"))


# -- JSON ----------------------------------------------------------------------------------------

_SQL_CODES = "[" + ", ".join(f"'{c}'" for c in CODES) + "]"
_SQL_LISTS = (
    f"WITH c AS (SELECT *, {_SQL_CODES}[user_id % 24 + 1] AS c1, {_SQL_CODES}[event_id % 24 + 1] AS c2, ['LOW', 'MED', 'HIGH'][user_id % 3 + 1] AS conf FROM events), "
    "r AS (SELECT event_id, CASE event_id % 7 WHEN 1 THEN '[]' WHEN 2 THEN 'bad ' || event_type WHEN 3 THEN props WHEN 4 THEN '[{\"code\":\"' || c1 || '\",\"evidence_quote\":\"' || event_type || '\",\"confidence\":\"' || conf || '\"},\"x\",null]' "
    "WHEN 5 THEN '[{\"code\":\"' || c1 || '\",\"confidence\":\"' || conf || '\"},{\"code\":\"' || c2 || '\",\"confidence\":\"LOW\"}]' WHEN 6 THEN '[\"' || c1 || '\",\" ' || lower(c2) || ' \",\"' || c1 || '\"]' END AS raw FROM c), "
    "j AS (SELECT event_id, raw, CASE WHEN json_valid(raw) THEN json_type(raw) END AS kind FROM r), "
    "i AS (SELECT event_id, unnest(json_extract(raw, '$[*]')) AS item FROM j WHERE kind = 'ARRAY'), "
    "g AS (SELECT event_id, count(*) FILTER (json_type(item) = 'OBJECT') AS n_codes, coalesce(bool_and(item->>'$.confidence' = 'LOW') FILTER (json_type(item) = 'OBJECT'), false) AS all_low, "
    "list_sort(list_distinct(list(upper(trim(CASE json_type(item) WHEN 'OBJECT' THEN item->>'$.code' ELSE item->>'$' END))) FILTER (json_type(item) <> 'NULL'))) AS names FROM i GROUP BY event_id), "
    "f AS (SELECT event_id, coalesce(n_codes, 0)::INT AS n_codes, coalesce(all_low, false) AS all_low, coalesce(names, []) AS names, CASE WHEN kind IS NULL THEN '[]' ELSE raw END AS list FROM j LEFT JOIN g USING (event_id)) "
)
_SQL_NAMED = "list_filter(['PUSH', 'PULL', 'MOOR-F', 'MOOR-I'], lambda d: len(list_filter(names, lambda c: starts_with(c, d))) > 0)"


@query(
    _SQL_LISTS
    + f"SELECT event_id, n_codes, all_low, array_to_string(names, ',') AS codes, list_has_any(names, list_filter({_SQL_CODES}, lambda c: starts_with(c, 'PUSH'))) AS push, "
    + f"array_to_string(list_sort(list_concat(names, {_SQL_NAMED}, CASE WHEN list_has_any(names, {_SQL_CODES}) THEN [] ELSE ['NONE'] END)), ',') AS with_none, list FROM f"
)
def json_code_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of codes in every shape they are found in, made of the events' own values."""
    n, book = F.col("event_id"), F.array(*(F.lit(c) for c in CODES))
    rows = table(spark, sf_dir, "events").withColumns({"c1": F.get(book, F.col("user_id") % 24), "c2": F.get(book, n % 24), "conf": F.get(F.array(F.lit("LOW"), F.lit("MED"), F.lit("HIGH")), F.col("user_id") % 3)})
    one, two, plain = '[{"code":"%s","evidence_quote":"%s","confidence":"%s"},"x",null]', '[{"code":"%s","confidence":"%s"},{"code":"%s","confidence":"LOW"}]', '["%s"," %s ","%s"]'
    raw = F.when(n % 7 == 1, "[]").when(n % 7 == 2, F.concat(F.lit("bad "), "event_type")).when(n % 7 == 3, F.col("props")).when(n % 7 == 4, F.format_string(one, "c1", "event_type", "conf"))
    raw = raw.when(n % 7 == 5, F.format_string(two, "c1", "conf", "c2")).when(n % 7 == 6, F.format_string(plain, "c1", F.lower("c2"), "c1"))
    rows = rows.select("event_id", raw.alias("raw"))
    # Columns of their own, so that no list is parsed again for every column made of it.
    rows = rows.withColumns({"parsed": jsonx.parse_codes(F.col("raw")), "names": F.array_sort(jsonx.code_set(F.col("raw")))})
    parsed, names = F.col("parsed"), F.col("names")
    return rows.select(
        "event_id",
        F.size(parsed).alias("n_codes"),
        jsonx.all_low(parsed).alias("all_low"),
        F.array_join("names", ",").alias("codes"),
        jsonx.in_dimension(names, tuple(c for c in CODES if c.startswith("PUSH"))).alias("push"),
        F.array_join(F.array_sort(jsonx.with_dimensions(names, CODES, DIMENSIONS)), ",").alias("with_none"),
        jsonx.json_list_or_empty(F.col("raw")).alias("list"),
    )


@query("SELECT event_id, (props->>'$.k')::INT AS k, (props->>'$.k') = '7' AS is_seven FROM events")
def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), jsonx.json_is(F.col("props"), "$.k", "7").alias("is_seven"))


@query(
    "WITH c AS (SELECT p_partkey, string_split(p_name || ' ' || lower(p_type), ' ') AS codes, CASE WHEN p_size % 3 > 0 THEN list_slice(string_split(p_brand || ' ' || p_type || ' spare more', ' '), 1, p_size % 5) ELSE [] END AS quotes, "
    "CASE p_size % 4 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'LOW' WHEN 2 THEN 'MED' ELSE 'LOW' END AS confidence FROM part) "
    "SELECT p_partkey, array_to_string(list_transform(range(1, len(codes) + 1), lambda i: codes[i] || '=' || coalesce(quotes[i], '')), ',') AS pairs, confidence FROM c"
)
def paired_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of a part's name as codes with up to four words as quotes, both as JSON; the last of its confidences counts."""
    size = F.col("p_size")
    words = F.split(F.concat_ws(" ", "p_brand", "p_type", F.lit("spare more")), " ")
    quotes = F.when(size % 3 > 0, F.to_json(F.slice(words, F.lit(1), (size % 5).cast("int"))))
    first = F.split("p_name", " ")[0]
    given = F.when(size % 4 == 1, F.format_string('[{"code":"%s","confidence":"HIGH"},{"code":"%s","confidence":"LOW"}]', first, first)).when(size % 4 == 2, F.format_string('[{"code":"%s","confidence":"MED"},{"code":"other","confidence":"LOW"}]', first))
    given = given.when(size % 4 == 3, F.format_string('[7,{"code":"%s","confidence":"LOW"}]', first)).otherwise("no list")
    rows = table(spark, sf_dir, "part").select("p_partkey", first.alias("first"), F.to_json(F.split(F.concat_ws(" ", "p_name", F.lower("p_type")), " ")).alias("codes"), quotes.alias("quotes"), given.alias("given"))
    pairs = F.transform(jsonx.paired(jsonx.json_items(F.col("codes")), jsonx.json_items(F.col("quotes"))), lambda p: F.concat_ws("=", p["code"], p["quote"]))
    return rows.select("p_partkey", F.array_join(pairs, ",").alias("pairs"), jsonx.confidence_of(F.col("first"), jsonx.parse_codes(F.col("given"))).alias("confidence"))


_THEMES = '[{"label":" %s ","definition":"%s"},{"label":"  "},"bare",{"definition":"%s"},{"label":"%s"}]'


@query(
    "WITH t AS (SELECT p_partkey, '[{\"label\":\" ' || p_name || ' \",\"definition\":\"' || p_brand || '\"},{\"label\":\"  \"},\"bare\",{\"definition\":\"' || p_type || '\"},{\"label\":\"' || p_type || '\"}]' AS raw FROM part WHERE p_size % 3 <> 1), "
    "i AS (SELECT p_partkey, unnest(json_extract(raw, '$[*]')) AS item FROM t) "
    "SELECT p_partkey, trim(item->>'$.label') AS label, coalesce(trim(item->>'$.definition'), '') AS definition FROM i WHERE json_type(item) = 'OBJECT' AND trim(coalesce(item->>'$.label', '')) <> ''"
)
def exploded_themes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of themes of a part's own words: labelled, blank, without a label, and a bare text."""
    raw = F.when(F.col("p_size") % 3 != 1, F.format_string(_THEMES, "p_name", "p_brand", "p_type", "p_type")).when(F.col("p_size") % 2 == 0, "null")
    rows = table(spark, sf_dir, "part").select("p_partkey", raw.alias("raw")).withColumn("themes", jsonx.parse_themes(F.col("raw"))).select("p_partkey", "themes")
    return jsonx.explode_themes(rows).select("p_partkey", "label", "definition")


@query(
    "SELECT p_type AS category, phrase, min(p_partkey) AS first_part FROM (SELECT p_type, p_partkey, unnest([split_part(p_name, ' ', 1), split_part(p_name, ' ', 2), lower(p_brand)]) AS phrase FROM part WHERE p_size <> 1) GROUP BY ALL"
)
def codebook_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.split("p_name", " ")
    include = F.concat(words[0], F.lit(', "'), words[1], F.lit('" ,'), F.upper("p_brand"))
    book = table(spark, sf_dir, "part").select(F.col("p_type").alias("category"), F.when(F.col("p_size") == 1, "[Reserved]").otherwise(F.col("p_name")).alias("name"), F.col("p_partkey").alias("seq"), include.alias("include"))
    return jsonx.phrases(book).select("category", "phrase", F.col("place.seq").alias("first_part"))


@query("SELECT DISTINCT unnest(string_split(p_name, ' ')) AS keyword FROM part")
def sorted_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jsonx.sorted_keywords(table(spark, sf_dir, "part").select(F.split("p_name", " ").alias("keywords")))


@query(
    "WITH d AS (SELECT event_id, '{\"' || ['note', 'author_id', 'k', 'Body'][user_id % 4 + 1] || '\":' || CASE event_id % 3 WHEN 0 THEN props WHEN 1 THEN '{\"' || event_type || '\":{\"text\":1}}' ELSE '\"the text of it\"' END || '}' AS details FROM events) "
    "SELECT event_id, list_has_any(list_transform(list_concat(json_keys(details), coalesce(json_keys(details->json_keys(details)[1]), []), coalesce(flatten(list_transform(json_keys(details->json_keys(details)[1]), lambda k: coalesce(json_keys(details->json_keys(details)[1]->k), []))), [])), lambda k: lower(k)), "
    "['body', 'text', 'author', 'author_id', 'username', 'selftext']) AS forbidden FROM d"
)
def forbidden_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Details with a key named by the user, and the event's own object, a deeper one or a text under it."""
    n = F.col("event_id")
    key = F.get(F.array(*(F.lit(k) for k in ("note", "author_id", "k", "Body"))), F.col("user_id") % 4)
    inner = F.when(n % 3 == 0, F.col("props")).when(n % 3 == 1, F.format_string('{"%s":{"text":1}}', "event_type")).otherwise('"the text of it"')
    rows = table(spark, sf_dir, "events").select(n, "event_type", F.format_string('{"%s":%s}', key, inner).alias("details"))
    return rows.select(n, jsonx.forbidden_in_json(rows).alias("forbidden"))


@query("SELECT event_id, event_type, '{\"user_id\":' || user_id || '}' AS details FROM events")
def spilled_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jsonx.spilled(table(spark, sf_dir, "events").select("event_id", "event_type", "user_id"), ("event_id", "event_type"))


@query("SELECT vec_id, len(embedding)::INT AS n, label FROM embeddings")
def flattened_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = jsonx.flattened(table(spark, sf_dir, "embeddings"))
    return flat.select("vec_id", F.json_array_length("embedding").alias("n"), "label")


@query(
    "WITH m AS (SELECT event_id, CASE user_id % 4 WHEN 0 THEN 'so:\n```json\n' || props || '\n```' WHEN 1 THEN ' ' || props WHEN 2 THEN 'the ' || event_type ELSE '```\n' || left(props, length(props) - 1) || '\n```' END AS answer FROM events), "
    "i AS (SELECT event_id, trim(CASE WHEN contains(answer, '```') THEN regexp_extract(answer, '```(?:json)?([^`]*)```', 1) ELSE answer END, ' ' || chr(10)) AS inner_text FROM m) "
    "SELECT event_id, CASE WHEN json_valid(inner_text) THEN inner_text ELSE '{}' END AS parsed FROM i"
)
def model_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that hold the event's own object in a block, bare, not at all, or cut off."""
    n = F.col("user_id") % 4
    answer = F.when(n == 0, F.concat(F.lit("so:\n```json\n"), "props", F.lit("\n```"))).when(n == 1, F.concat(F.lit(" "), "props")).when(n == 2, F.concat(F.lit("the "), "event_type"))
    answer = answer.otherwise(F.concat(F.lit("```\n"), F.substring("props", F.lit(1), F.length("props") - 1), F.lit("\n```")))
    return table(spark, sf_dir, "events").select("event_id", clean.fenced_json(answer).alias("parsed"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '{\"corpus_layer\":\"A_keyword\",\"tertile\":2,\"nsfw\":false}' ELSE '{\"corpus_layer\":\"A_keyword\",\"tertile\":2,\"parent_id\":\"' || source || '\"}' END AS meta FROM documents")
def packed_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("doc_id") % 2 == 0, "submission").otherwise("comment")
    meta = {"corpus_layer": F.lit("A_keyword"), "tertile": F.lit(2), "nsfw": F.lit(False), "parent_id": F.col("source")}
    return table(spark, sf_dir, "documents").select("doc_id", clean.post_metadata(kind, meta).alias("meta"))


# -- privacy -------------------------------------------------------------------------------------


@query(
    "SELECT 'text' AS field, 'LONG_TEXT' AS kind, count(*) AS n_flags, min(doc_id) AS first_key FROM documents WHERE length(text) > 500 HAVING count(*) > 0 UNION ALL "
    "SELECT 'note', 'USERNAME', count(*), min(doc_id) FROM documents WHERE doc_id % 50 = 7 HAVING count(*) > 0"
)
def privacy_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return audit.privacy_scan(docs.select("doc_id", "text", F.when(F.col("doc_id") % 50 == 7, "as u/some_name says").otherwise("plain").alias("note")), "doc_id")


@query(
    "WITH r AS (SELECT CASE WHEN turn % 5 = 1 THEN 'see u/' || role || turn || ' there' ELSE text END AS quote, '{\"' || CASE WHEN length(text) % 7 = 0 THEN 'author_id' ELSE role END || '\":' || turn || '}' AS details FROM conversations), "
    "v AS (SELECT regexp_matches(quote, '\\bu/[A-Za-z0-9_]{3,20}\\b') OR list_has_any(json_keys(details), ['body', 'text', 'author', 'author_id', 'username', 'selftext']) OR contains(quote, 'author_id') AS bad FROM r) "
    "SELECT count(*) FILTER (NOT bad) AS n_written, count(*) FILTER (bad) AS n_failed FROM v"
)
def privacy_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.write_summary(_judged(spark, sf_dir))


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as evidence; some name a user, some details an author."""
    quote = F.when(F.col("turn") % 5 == 1, F.concat(F.lit("see u/"), "role", "turn", F.lit(" there"))).otherwise(F.col("text"))
    details = F.format_string('{"%s":%d}', F.when(F.length("text") % 7 == 0, "author_id").otherwise(F.col("role")), "turn")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array(quote).alias("evidence_quotes"), details.alias("details"))
    return audit.privacy_verdict(rows, "evidence_quotes")


@query(ORACLES["privacy_gate"].replace(" FROM v", ", count(*) FILTER (NOT bad) AS n_rows FROM v"))
def audit_on_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that break no rule are written, and the same counts taken by the tasks that write them."""
    path = scratch(spark, "audit")
    counts = audit.write_audited(_judged(spark, sf_dir), path)
    return spark.read.parquet(path).agg(*(F.lit(n).cast("long").alias(c) for c, n in counts.items()), F.count("*").alias("n_rows"))


@query(
    "SELECT * FROM (VALUES ('doc_id', 'bigint', false), ('text', 'string', true), ('lang', 'string', false), ('source', 'string', false), ('n_chars', 'bigint', false)) v(\"column\", \"type\", forbidden), (SELECT count(*) AS n_rows, 0::BIGINT AS n_nulls FROM documents)"
)
def schema_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.profile_schema(table(spark, sf_dir, "documents"))


@query(
    "SELECT 'missing_columns' AS \"check\", 1::BIGINT AS value, false AS passed UNION ALL SELECT 'forbidden_columns', 0, true UNION ALL SELECT 'rows', count(*), count(*) > 0 FROM events UNION ALL "
    "SELECT 'null_keys', 0, true UNION ALL SELECT 'bad_json_props', 0, true UNION ALL SELECT 'filled_json_props', count(*), true FROM events"
)
def export_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.validate_export(table(spark, sf_dir, "events"), ("event_id", "session_id"), ("props",), "event_id")


@query("SELECT 'has_session' AS rule, count(*) FILTER (user_id % 10 = 0) AS n FROM events UNION ALL SELECT 'positive_value', count(*) FILTER (NOT coalesce(value > 0, false)) FROM events")
def rule_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    return audit.violations(rows, {"has_session": F.col("user_id") % 10 != 0, "positive_value": F.col("value") > 0})
