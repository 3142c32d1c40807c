"""Changes of tables, joins, samples and reports on the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.config import Caps, QualityGate
from colloquy.operators import layout, linking, reports, sampling, tables
from colloquy.plans.registry import query, table
from colloquy.shared import shared_path as scratch

# -- changes -------------------------------------------------------------------------------------


def _current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0")


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with an even key twice, with two names; ``seq`` orders them."""
    base = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0")
    first = base.withColumns({"c_name": F.concat("c_name", F.lit("/1")), "seq": F.col("c_custkey") * 2})
    return first.unionByName(base.withColumns({"c_name": F.concat("c_name", F.lit("/2")), "seq": F.col("c_custkey") * 2 + 1}))


@query("SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT c_custkey, c_name || '/1', c_nationkey FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 3 = 0")
def insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.with_inserts(_current(spark, sf_dir), _changes(spark, sf_dir), ["c_custkey"], "seq").select("c_custkey", "c_name", "c_nationkey")


@query("SELECT count(*) FILTER (c_custkey % 3 = 0) AS inserted, count(*) * 2 - count(*) FILTER (c_custkey % 3 = 0) AS skipped, 0::BIGINT AS errors FROM customer WHERE c_custkey % 2 = 0")
def insert_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.insert_stats(_current(spark, sf_dir), _changes(spark, sf_dir), ["c_custkey"], "seq")


@query("SELECT count(*) FILTER (c_custkey % 3 = 0) AS inserted, count(*) * 2 - count(*) FILTER (c_custkey % 3 = 0) AS skipped, 0::BIGINT AS errors, count(*) FILTER (c_custkey % 3 = 0) AS n_written FROM customer WHERE c_custkey % 2 = 0")
def insert_counts_on_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same counts, taken by the tasks that write the new rows, beside a count of what was written."""
    path = scratch(spark, "inserted")
    counts = tables.insert_observed(_current(spark, sf_dir), _changes(spark, sf_dir), ["c_custkey"], "seq", path)
    return spark.read.parquet(path).agg(*(F.lit(n).cast("long").alias(c) for c, n in counts.items()), F.count("*").alias("n_written"))


@query("SELECT c_custkey, c_name || CASE WHEN c_custkey % 2 = 0 THEN '/2' ELSE '' END AS c_name FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey % 2 = 0")
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.upsert(_current(spark, sf_dir), _changes(spark, sf_dir), ["c_custkey"], "seq").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name || CASE WHEN c_custkey % 2 = 0 THEN '/2' ELSE '' END AS c_name, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 3 = 0 THEN 'new' ELSE 'old' END AS first_seen FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey % 2 = 0")
def upsert_keeping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An upsert that leaves the time of the first entry alone."""
    old = _current(spark, sf_dir).withColumn("first_seen", F.lit("old"))
    new = _changes(spark, sf_dir).withColumn("first_seen", F.lit("new"))
    return tables.upsert(old, new, ["c_custkey"], "seq", keep=("first_seen",)).select("c_custkey", "c_name", "first_seen")


@query("SELECT event_id, user_id FROM events WHERE user_id <> 7 OR event_id % 2 = 0")
def session_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.col("user_id").cast("string").alias("session_id"))
    return tables.prune(rows, rows.where("event_id % 2 = 0"), ["event_id"], "7").select("event_id", F.col("session_id").cast("long").alias("user_id"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN 'edited' ELSE p_name END AS name FROM part WHERE NOT (p_partkey % 7 = 0 AND p_partkey % 5 <> 0 AND p_partkey > 20)")
def codebook_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth part is renamed, every seventh deleted unless it is a default (key up to 20); edits without a name change nothing."""
    parts = table(spark, sf_dir, "part")
    book = parts.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("definition"))
    changed = book.where("id % 5 = 0").withColumns({"name": F.lit("edited"), "deleted": F.lit(False)})
    blank = book.where("id % 5 = 1").withColumns({"name": F.lit(" "), "deleted": F.lit(False)})
    gone = book.where("id % 7 = 0 and id % 5 <> 0").withColumn("deleted", F.lit(True))
    edits = changed.unionByName(blank).unionByName(gone).withColumn("seq", F.col("id"))
    return tables.edit_codebook(book, edits, "seq", tuple(range(21))).select("id", "name")


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'approved' ELSE 'pending' END AS status FROM events")
def status_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.lit("pending").alias("status"))
    return tables.set_status(rows, rows.where("event_id % 4 = 0"), "approved", "event_id")


@query("SELECT 't3_' || c_custkey AS reddit_id FROM customer WHERE c_custkey % 6 <> 0")
def delete_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.concat(F.lit("t3_"), "c_custkey").alias("reddit_id"), "c_custkey")
    gone = rows.where("c_custkey % 6 = 0").select(F.when(F.col("c_custkey") % 4 == 0, F.col("reddit_id")).otherwise(F.col("c_custkey").cast("string")).alias("reddit_id"))
    return tables.delete_ids(rows, gone, "reddit_id", "t3_").select("reddit_id")


@query("SELECT event_id FROM events WHERE user_id <> 3")
def delete_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.col("user_id").cast("string").alias("session_id"))
    return tables.delete_session(tables.delete_session(rows, "3"), "").select("event_id")


@query("SELECT o_orderkey, CASE WHEN o_custkey = 5 AND row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1 THEN 'named' END AS label, o_orderkey % 2 = 0 AS is_test FROM orders")
def latest_run_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = F.struct(F.lit(None).cast("string").alias("label"), (F.col("o_orderkey") % 2 == 0).alias("is_test"))
    runs = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("session_id"), F.col("o_orderdate").alias("started_at"), extra.alias("extra"))
    return tables.update_latest_run(runs, 5, "o_orderkey", label="named").select("o_orderkey", "extra.*")


@query(
    "SELECT user_id AS job_id, arg_max(event_type, event_id) FILTER (event_type <> 'click') AS status, max(event_id) AS items_collected, "
    "strftime(max(ts) FILTER (event_type = 'purchase'), '%Y-%m-%d %H:%M:%S') AS completed_at FROM events GROUP BY user_id"
)
def run_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as state changes of one job per user; a click carries no status."""
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), F.col("ts").alias("at"), F.when(F.col("event_type") == "click", "").otherwise(F.col("event_type")).alias("status"),
        F.col("event_id").alias("items_collected"), F.lit(None).cast("string").alias("error_message"),
    )
    out = tables.run_states(rows, ("purchase",))
    return out.select("job_id", "status", "items_collected", F.date_format("completed_at", "yyyy-MM-dd HH:mm:ss").alias("completed_at"))


@query("SELECT 'import' AS action, user_id AS session_id, '{\"event_id\":' || event_id || ',\"event_type\":\"' || event_type || '\"}' AS details FROM events")
def audit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.audit_rows(table(spark, sf_dir, "events"), "import", F.col("user_id"), ["event_id", "event_type"], F.col("ts")).drop("timestamp")


@query("SELECT 'EMER-' || CASE WHEN n < 10 THEN '0' ELSE '' END || n AS code, s_suppkey FROM (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) + 12 AS n FROM supplier)")
def next_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = table(spark, sf_dir, "region").select(F.when(F.col("r_regionkey") == 0, "EMER-12").when(F.col("r_regionkey") == 1, "EMER-x").otherwise("EMER-03").alias("code"))
    return tables.next_codes(book, table(spark, sf_dir, "supplier").select("s_suppkey"), "s_suppkey")


@query("SELECT 'EMER-' || CASE WHEN n < 10 THEN '0' ELSE '' END || n AS code, 'theme ' || item_id AS name, left(text, 200) AS examples FROM (SELECT *, row_number() OVER (ORDER BY item_id) AS n FROM benchmark WHERE item_id % 2 = 0)")
def approved_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark")
    candidates = items.select("item_id", F.concat(F.lit("theme "), "item_id").alias("name"), F.lit("d").alias("definition"), F.col("text").alias("evidence"), F.when(F.col("item_id") % 2 == 0, "approved").otherwise("pending").alias("status"))
    empty = items.where("false").select(F.lit("").alias("code"))
    return tables.approve_candidates(empty, candidates, "item_id").drop("definition")


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'api' WHEN 1 THEN 'api' ELSE 'upload' END AS data_source, 0::INT AS flag, NULL::VARCHAR AS note FROM events")
def migrated_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, "PRAW").when(F.col("event_id") % 3 == 2, "upload").alias("data_source"))
    return tables.ensure_columns(tables.remap_source(rows, ("PRAW", "praw"), "api"), {"flag": 0, "note": "null:string", "data_source": "x"})


@query("SELECT user_id, min(event_id) AS event_id FROM events GROUP BY user_id")
def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.first_of(table(spark, sf_dir, "events"), ["user_id"], "event_id").select("user_id", "event_id")


@query("SELECT user_id, event_type, max(event_id) AS event_id FROM events GROUP BY ALL")
def dedup_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.last_of(table(spark, sf_dir, "events"), ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.latest(table(spark, sf_dir, "events"), ["user_id"], "ts", "event_id").select("user_id", "event_id", "event_type")


@query("SELECT event_id, value FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 100")
def newest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.newest(table(spark, sf_dir, "events"), 100, "ts", "event_id", F.col("event_type") == "error").select("event_id", "value")


# -- joins ---------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, o_orderpriority AS tertile, o_orderkey IS NOT NULL AS has_post FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 4 <> 0) ON l_orderkey = o_orderkey")
def reply_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = table(spark, sf_dir, "orders").where("o_orderkey % 4 <> 0").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("tertile"))
    return linking.enrich_replies(table(spark, sf_dir, "lineitem"), posts, "l_orderkey", ["tertile"]).select("l_orderkey", "l_linenumber", "tertile", "has_post")


@query("SELECT DISTINCT l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 4 <> 0)")
def orphan_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = table(spark, sf_dir, "orders").where("o_orderkey % 4 <> 0").select(F.col("o_orderkey").alias("l_orderkey"))
    return linking.orphans(table(spark, sf_dir, "lineitem"), posts, "l_orderkey")


@query("SELECT c.conv_id, c.turn, p.role AS layer FROM conversations c JOIN conversations p ON c.conv_id = p.conv_id AND p.turn = 0 WHERE c.turn > 0")
def corpus_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    posts = turns.where("turn = 0").select("conv_id", F.col("role").alias("layer"))
    return linking.replies_in_corpus(turns.where("turn > 0").select("conv_id", "turn"), posts, "conv_id", "layer")


@query("SELECT count(*) FILTER (turn > 0) AS n_replies, count(DISTINCT conv_id) FILTER (turn > 0) AS posts_with_replies, count(DISTINCT conv_id) FILTER (turn = 0) AS n_posts, round(count(DISTINCT conv_id) FILTER (turn > 0)::DOUBLE / count(DISTINCT conv_id) FILTER (turn = 0), 3) AS share FROM conversations")
def reply_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return sampling.coverage(turns.where("turn > 0"), turns.where("turn = 0").select("conv_id").distinct(), "conv_id")


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def uncoded_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null among the coded ids hides nothing."""
    labels = table(spark, sf_dir, "labels").select("doc_id")
    return linking.uncoded(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), labels.unionByName(labels.select(F.lit(None).cast("long").alias("doc_id")).distinct()), "doc_id")


@query("SELECT d.doc_id, l.quality, d.n_chars FROM labels l JOIN documents d USING (doc_id) ORDER BY d.doc_id DESC LIMIT 50")
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linking.for_review(table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents"), "doc_id", "doc_id", 50).select("doc_id", "quality", "n_chars")


@query("SELECT c_custkey, c_name, o_orderkey FROM (SELECT o_custkey AS c_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1) JOIN customer USING (c_custkey)")
def newest_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratings = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return linking.rated_texts(ratings, table(spark, sf_dir, "customer"), "c_custkey", "o_orderdate", "o_orderkey").select("c_custkey", "c_name", "o_orderkey")


@query("SELECT c_custkey, coalesce(n_name, c_nationkey::VARCHAR) AS n_name FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) ON c_nationkey = n_nationkey")
def named_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "nation").where("n_nationkey < 20").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return linking.named(table(spark, sf_dir, "customer"), names, "c_nationkey", "n_name").select("c_custkey", "n_name")


@query("SELECT p_partkey AS code, coalesce(used, 0) AS used, p_size + coalesce(used, 0) AS frequency FROM part LEFT JOIN (SELECT l_partkey, count(*) AS used FROM lineitem GROUP BY 1) ON p_partkey = l_partkey")
def code_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("code"), F.col("p_size").alias("frequency"))
    return linking.code_usage(book, table(spark, sf_dir, "lineitem").select(F.array("l_partkey").alias("codes")), "codes")


@query("SELECT l_orderkey, l_linenumber, s_name FROM lineitem LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey % 2 = 0) ON l_suppkey = s_suppkey")
def linked_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = table(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").withColumnRenamed("s_suppkey", "l_suppkey")
    return linking.linked_references(table(spark, sf_dir, "lineitem"), refs, "l_suppkey").select("l_orderkey", "l_linenumber", "s_name")


@query("SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def used_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return linking.used_references(table(spark, sf_dir, "part").select("p_partkey"), used, "p_partkey")


@query("SELECT event_id FROM events WHERE event_id % 5 <> 0")
def new_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id")
    return linking.new_items(rows, rows.where("event_id % 5 = 0"), "event_id")


@query("SELECT event_id, CASE WHEN user_id % 2 = 0 THEN event_type END AS title, CASE WHEN user_id % 2 = 1 THEN value END AS value FROM events")
def posts_and_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    posts = rows.where("user_id % 2 = 0").select("event_id", F.col("event_type").alias("title"))
    return posts.unionByName(rows.where("user_id % 2 = 1").select("event_id", "value"), allowMissingColumns=True)


@query("SELECT c_nationkey AS key FROM customer UNION SELECT s_nationkey FROM supplier")
def distinct_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("key")).union(table(spark, sf_dir, "supplier").select("s_nationkey")).distinct()


@query("SELECT doc_id AS key FROM documents INTERSECT SELECT doc_id FROM labels")
def shared_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key")).intersect(table(spark, sf_dir, "labels").select("doc_id"))


# -- samples -------------------------------------------------------------------------------------

_GATE = QualityGate(score=1500, length=600, lenient_score=300, lenient_length=100, lenient=("src1", "src2"))
_GROUPS = {"a": "heed|thing", "b": "idiot|clown", "c": "eau"}


@query("SELECT doc_id, (n_chars >= 1500 AND length(trim(text)) >= 600) OR (source IN ('src1', 'src2') AND n_chars >= 300 AND length(trim(text)) >= 100) AS passes FROM documents")
def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", sampling.quality_gate(F.col("n_chars"), F.col("text"), F.col("source"), _GATE).alias("passes"))


@query("SELECT doc_id, concat_ws(',', " + ", ".join(f"CASE WHEN regexp_matches(lower(text), '{p}') THEN '{n}' END" for n, p in _GROUPS.items()) + ") AS groups FROM documents")
def keyword_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = sampling.matched_groups(F.lit(None).cast("string"), F.col("text"), _GROUPS)
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(groups, ",").alias("groups"))


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderdate BETWEEN DATE '1996-01-01' AND DATE '1997-06-30'")
def in_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.in_scope(table(spark, sf_dir, "orders"), ["1-URGENT", "2-HIGH"], "1996-01-01", "1997-06-30", "o_orderpriority", "o_orderdate").select("o_orderkey")


_ORDER = "o_totalprice DESC, o_orderkey"
_LAYER = (
    "SELECT o_orderkey, tertile::INT AS tertile, rank::INT AS rank, '{layer}' AS corpus_layer FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority, tertile ORDER BY " + _ORDER + ") AS rank FROM "
    "(SELECT *, ntile(3) OVER (PARTITION BY o_orderpriority ORDER BY " + _ORDER + ") AS tertile FROM {rows})) WHERE rank <= CASE tertile WHEN 1 THEN {a} WHEN 2 THEN {b} ELSE {c} END"
)


@query(
    "WITH gated AS (SELECT * FROM orders WHERE o_totalprice > 100000), a AS (" + _LAYER.format(layer="A_keyword", rows="(SELECT * FROM gated WHERE o_orderstatus = 'F')", a=20, b=20, c=20) + "), "
    "b AS (" + _LAYER.format(layer="B_emergent", rows="(SELECT * FROM gated WHERE o_orderkey NOT IN (SELECT o_orderkey FROM a))", a=17, b=16, c=17) + ") SELECT * FROM a UNION ALL SELECT * FROM b"
)
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sampling.layered_sample(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderkey", "o_totalprice", F.col("o_totalprice") > 100000, F.col("o_orderstatus") == "F", Caps())
    return rows.select("o_orderkey", "tertile", "rank", "corpus_layer")


@query("SELECT o_orderkey, rank::INT AS rank FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY " + _ORDER + ") AS rank FROM orders) WHERE rank <= 35")
def quota_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.best_of_community(table(spark, sf_dir, "orders"), "o_orderpriority", [F.desc("o_totalprice"), F.asc("o_orderkey")]).select("o_orderkey", "rank")


@query("SELECT o_orderpriority, tertile::INT AS tertile, min(o_totalprice) AS least_score, max(o_totalprice) AS most_score, count(*) AS pool FROM (SELECT *, ntile(3) OVER (PARTITION BY o_orderpriority ORDER BY " + _ORDER + ") AS tertile FROM orders) GROUP BY 1, 2")
def tertile_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sampling.thirds(table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice", "o_orderkey")
    return sampling.tertile_ranges(rows, "o_orderpriority", "o_totalprice")


@query("SELECT event_id, ntile(3) OVER (PARTITION BY event_type ORDER BY user_id DESC, event_id)::INT AS tertile FROM events")
def tertiles_at_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few communities with few distinct values: exact thirds without a task that holds a community."""
    return sampling.thirds(table(spark, sf_dir, "events"), "event_type", "user_id", "event_id").select("event_id", "tertile")


@query("SELECT 0::INT AS step, 'raw' AS stage, count(*) AS n_rows, NULL::BIGINT AS change FROM orders UNION ALL SELECT 1, 'gated', count(*) FILTER (o_totalprice > 100000), count(*) FILTER (o_totalprice > 100000) - count(*) FROM orders UNION ALL SELECT 2, 'final', count(*) FILTER (o_totalprice > 300000), count(*) FILTER (o_totalprice > 300000) - count(*) FILTER (o_totalprice > 100000) FROM orders")
def stage_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return sampling.stage_reconciliation([("raw", o), ("gated", o.where("o_totalprice > 100000")), ("final", o.where("o_totalprice > 300000"))])


# -- reports -------------------------------------------------------------------------------------


@query("SELECT event_type, count(*) AS n, count(*) * 100.0::DOUBLE / (SELECT count(*) FROM events) AS pct FROM events GROUP BY 1")
def distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.distribution(table(spark, sf_dir, "events"), "event_type")


@query("SELECT 'lang' AS field, lang AS value, count(*) AS n FROM documents GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY 2")
def distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.distributions(table(spark, sf_dir, "documents"), ["lang", "source"])


@query("SELECT p_name, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_name LIMIT 15")
def top_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.top(table(spark, sf_dir, "part"), "p_name", 15)


@query("SELECT value, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS value FROM part) GROUP BY 1 ORDER BY n DESC, value LIMIT 10")
def top_themes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.top_of_array(table(spark, sf_dir, "part").select(F.split("p_name", " ").alias("themes")), "themes", 10)


@query(
    "SELECT lang, n_collected, n_coded, n_with_codes, target, least(1.0, coalesce(n_collected / nullif(target, 0), 0.0))::DOUBLE AS done, greatest(0, target - n_collected)::BIGINT AS remaining, n_with_codes * 100.0::DOUBLE / n_collected AS with_codes_pct FROM "
    "(SELECT lang, count(*) AS n_collected, count(quality) AS n_coded, coalesce(sum(quality), 0)::BIGINT AS n_with_codes, CASE lang WHEN 'en' THEN 500 WHEN 'fr' THEN 100000 ELSE 0 END::INT AS target FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1)"
)
def collection_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, F.array(F.lit("q"))).otherwise(F.array().cast("array<string>")).alias("codes"))
    return reports.progress(table(spark, sf_dir, "documents").select("doc_id", "lang"), coded, "doc_id", "lang", "codes", {"en": 500, "fr": 100_000})


@query("SELECT o_orderpriority, " + ", ".join(f"count(*) FILTER (year(o_orderdate) = {y}) AS \"{y}\"" for y in range(1995, 2000)) + " FROM orders GROUP BY 1")
def temporal_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.temporal_matrix(table(spark, sf_dir, "orders").withColumn("year", F.year("o_orderdate")), "o_orderpriority", "year", list(range(1995, 2000)))


@query("SELECT event_type, min(event_id) AS first_at, max(event_id) AS last_at, count(*) AS n FROM events GROUP BY 1")
def date_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.date_range(table(spark, sf_dir, "events"), "event_type", "event_id")


@query("SELECT count(*) AS total_items, count(*) FILTER (event_id % 6 = 0) AS nsfw_items, count(*) FILTER (event_id % 6 IN (1, 2)) AS removed_items, count(*) FILTER (event_id % 6 = 3) AS non_english_items FROM events")
def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id") % 6
    meta = F.to_json(F.struct((n == 0).alias("nsfw"), F.when(n == 1, "removed").when(n == 2, "author_deleted").alias("content_status"), F.when(n == 3, "likely_non_english").alias("language_flag")))
    return reports.quality_counts(table(spark, sf_dir, "events").select(meta.alias("meta")), "meta")


@query("SELECT total, condition, n, n * 100.0::DOUBLE / greatest(total, 1) AS pct FROM (SELECT count(*) AS total, unnest(['short', 'english', 'piped']) AS condition, unnest([count(*) FILTER (n_chars < 200), count(*) FILTER (lang = 'en'), count(*) FILTER (contains(text, '|'))]) AS n FROM documents)")
def quality_appendix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.quality_appendix(table(spark, sf_dir, "documents"), {"short": F.col("n_chars") < 200, "english": F.col("lang") == "en", "piped": F.contains("text", F.lit("|"))})


@query(
    "WITH i AS (SELECT user_id AS session_id, count(*) AS n_items, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS communities, min(event_id) AS first_at, max(event_id) AS last_at FROM events WHERE event_id % 2 = 0 GROUP BY 1), "
    "c AS (SELECT user_id AS session_id, count(*) AS n_coded FROM events WHERE event_type = 'purchase' GROUP BY 1), r AS (SELECT o_custkey AS session_id, max(o_orderkey) AS started_at, arg_max(o_orderpriority, (o_orderkey, o_orderpriority)) AS label, arg_max(o_orderstatus, (o_orderkey, o_orderpriority)) AS status FROM orders GROUP BY 1) "
    "SELECT session_id, coalesce(n_items, 0) AS n_items, coalesce(n_coded, 0) AS n_coded, coalesce(communities, '') AS communities, first_at, last_at, started_at, label, status FROM (SELECT session_id FROM i UNION SELECT session_id FROM r) LEFT JOIN i USING (session_id) LEFT JOIN c USING (session_id) LEFT JOIN r USING (session_id)"
)
def session_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumnRenamed("user_id", "session_id")
    runs = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("session_id"), F.col("o_orderkey").alias("started_at"), F.col("o_orderpriority").alias("label"), F.col("o_orderstatus").alias("status"))
    return reports.session_stats(events.where("event_id % 2 = 0"), events.where("event_type = 'purchase'"), runs, "event_type", "event_id")


@query("SELECT p_type AS category, count(*) AS n_codes, sum(p_size)::BIGINT AS frequency FROM part GROUP BY 1 UNION ALL SELECT 'NONE', 0, 0 UNION ALL SELECT 'ALL', count(*), sum(p_size)::BIGINT FROM part")
def codebook_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    kinds = parts.select(F.col("p_type").alias("category")).distinct()
    kinds = kinds.unionByName(kinds.select(F.lit("NONE").alias("category")).distinct())
    return reports.codebook_statistics(parts.select(F.col("p_type").alias("category"), F.col("p_size").cast("long").alias("frequency")), kinds)


@query("SELECT (SELECT count(*) FROM part) AS n_references, count(*) AS n_links, count(DISTINCT l_suppkey) AS n_collections, (SELECT count(DISTINCT k) FROM (SELECT unnest(string_split(p_name, ' ')) AS k FROM part)) AS n_keywords FROM lineitem")
def literature_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = table(spark, sf_dir, "part").select(F.split("p_name", " ").alias("keywords"))
    return reports.literature_counts(refs, table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("collection_hash")), "keywords")


# -- layout --------------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_orderpriority, count(*) AS n_lines, round(sum(l_extendedprice), 2) AS total FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2")
def layout_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and their lines, both stored in buckets of the order: neither the join nor the sums by order shuffle."""
    n = layout.buckets_for(table(spark, sf_dir, "lineitem"), 8)
    orders = layout.store(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", F.date_trunc("year", "o_orderdate").cast("date").alias("year")), "o_orderkey", "year", n)
    lines = layout.store(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice", F.date_trunc("year", "l_shipdate").cast("date").alias("year")), "l_orderkey", "year", n)
    joined = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.groupBy("o_orderkey", "o_orderpriority").agg(F.count("*").alias("n_lines"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderdate BETWEEN DATE '1996-01-01' AND DATE '1997-06-30'")
def layout_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scope of ``in_scope`` from a table stored by month: other months are not opened."""
    rows = table(spark, sf_dir, "orders").withColumn("month", F.date_trunc("month", "o_orderdate").cast("date"))
    stored = layout.store(rows, "o_orderkey", "month", layout.buckets_for(rows, 4))
    return layout.scope(stored, "month", "o_orderdate", "o_orderpriority", ["1-URGENT", "2-HIGH"], "1996-01-01", "1997-06-30").select("o_orderkey")


@query("WITH d AS (SELECT date_trunc('month', o_orderdate) AS month, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, month LIMIT 5) SELECT o_orderkey FROM orders WHERE date_trunc('month', o_orderdate) IN (SELECT month FROM d)")
def layout_busiest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of the five busiest months: the join with them prunes the months that are read (dynamic partition pruning)."""
    rows = table(spark, sf_dir, "orders").withColumn("month", F.date_trunc("month", "o_orderdate").cast("date"))
    stored = layout.store(rows, "o_orderkey", "month", layout.buckets_for(rows, 4))
    busiest = stored.groupBy("month").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "month").limit(5)
    return stored.join(busiest.select("month"), "month").select("o_orderkey")
