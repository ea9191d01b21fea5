"""Named queries over the driver's tables, each with its DuckDB equivalent.

The tables hold no surveys, so the operators are applied to columns that play the
parts: an order is a response, its key a score, a line a question, a return flag a
category, an event a delivered version of its user.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as fn
from ..operators import metrics, upsert, validation, versions
from ..schemas import QUESTION_COLUMNS
from ..sources.store import bundle, unbundle

CUTOFF, WATERMARK = "2024-01-20 00:00:00", "2024-01-15 12:00:00"
LINE_ORDER = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
SCORED = "SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN 'NPS' ELSE 'CSAT' END AS metric, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 11 ELSE 1 + o_orderkey % 5 END AS score FROM orders"
SHARE = "round(100.0::DOUBLE * {} / nullif({}, 0), 6)"
SIGNED = "sum(CASE WHEN score >= 9 THEN 1 WHEN score <= 6 THEN -1 ELSE 0 END)"

QUERIES = {}
ORACLES = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    """Register a query under its name, with its DuckDB equivalent if it has one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def long_rank(c: Column) -> Column:
    return c.cast("long")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    is_nps = F.col("o_orderkey") % 3 != 0
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(is_nps, "NPS").otherwise("CSAT").alias("metric"), F.when(is_nps, F.col("o_orderkey") % 11).otherwise(F.col("o_orderkey") % 5 + 1).alias("score")
    )


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_returnflag").alias("category"))


# -- validation ------------------------------------------------------------------

EVENT_REASONS = """SELECT event_id, CASE WHEN nullif(event_type, 'error') IS NULL THEN 'missing:event_type'
  WHEN NOT value BETWEEN 0 AND 100 THEN 'invalid_value' END AS reason FROM events"""


def assessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.nullif("event_type", F.lit("error")).alias("event_type"), "value")
    return rows.withColumn("reason", event_type_reason(rows))


def event_type_reason(rows: DataFrame) -> Column:
    lacking = validation.missing_fields(rows, ["event_type"])
    return validation.first_failure((lacking.isNotNull(), F.concat(F.lit("missing:"), lacking)), (~F.col("value").between(0, 100), "invalid_value"))


@query(EVENT_REASONS)
def required_and_range_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assessed(spark, sf_dir).select("event_id", "reason")


@query(f"SELECT reason, count(*) AS n FROM ({EVENT_REASONS}) WHERE reason IS NOT NULL GROUP BY reason")
def quarantine_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = assessed(spark, sf_dir)
    _, rejected = validation.split_by_reason(rows.drop("reason"), event_type_reason(rows))
    return rejected.groupBy("reason").agg(F.count("*").alias("n"))


# -- versions --------------------------------------------------------------------

LATEST = "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"


@query(LATEST)
def latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", "ts")
    return versions.latest(rows, ["user_id"], [F.desc("ts"), F.desc("event_id")]).drop("ts")


@query(f"SELECT * FROM ({LATEST}) WHERE event_type <> 'error'")
def tombstone_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_version(spark, sf_dir).filter("event_type <> 'error'")


COPIES = f"""SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {", ".join(LINE_ORDER)})::BIGINT AS copy_rank FROM lineitem"""


@query(f"SELECT *, CASE WHEN copy_rank = 1 THEN 'representative' ELSE 'repeated_snapshot' END AS status FROM ({COPIES})")
def copy_rank_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = versions.ranked(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], [F.asc(c) for c in LINE_ORDER], "copy_rank")
    status = F.when(F.col("copy_rank") == 1, "representative").otherwise("repeated_snapshot")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", long_rank(F.col("copy_rank")).alias("copy_rank"), status.alias("status"))


@query("""SELECT o_custkey, o_orderkey, CASE WHEN row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1
  THEN 'selected_current' ELSE 'superseded_version' END AS status FROM orders""")
def version_rank_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = versions.ranked(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], "place")
    return rows.select("o_custkey", "o_orderkey", F.when(F.col("place") == 1, "selected_current").otherwise("superseded_version").alias("status"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_partkey) > 1")
def version_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.conflicting_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], "l_partkey")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  min(l_partkey) OVER (PARTITION BY l_orderkey, l_linenumber) <> max(l_partkey) OVER (PARTITION BY l_orderkey, l_linenumber) AS conflict FROM lineitem""")
def event_conflict_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return rows.withColumn("conflict", versions.varies(F.col("l_partkey"), "l_orderkey", "l_linenumber"))


@query("""SELECT c_custkey, CASE WHEN k.o_custkey IS NULL THEN 'ok' ELSE 'has_rejected_history' END AS quality_status
  FROM customer LEFT JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 450000) k ON c_custkey = k.o_custkey""")
def quality_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rejected = table(spark, sf_dir, "orders").filter("o_totalprice > 450000").select("o_custkey").distinct()
    joined = table(spark, sf_dir, "customer").join(rejected, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select("c_custkey", F.when(F.col("o_custkey").isNull(), "ok").otherwise("has_rejected_history").alias("quality_status"))


@query(f"""WITH c AS ({COPIES}), x AS (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_partkey) > 1),
  s AS (SELECT CASE WHEN x.l_orderkey IS NOT NULL THEN 'quarantined' WHEN copy_rank = 1 THEN 'selected_current' ELSE 'repeated_snapshot' END AS status
        FROM c LEFT JOIN x ON c.l_orderkey = x.l_orderkey AND c.l_linenumber = x.l_linenumber)
  SELECT status, count(*) AS n FROM s GROUP BY status""")
def audit_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = ["l_orderkey", "l_linenumber"]
    # one exchange and one sort serve the conflict and the copies
    rows = versions.ranked(table(spark, sf_dir, "lineitem"), key, [F.asc(c) for c in LINE_ORDER], "copy").withColumn("conflict", versions.varies(F.col("l_partkey"), *key))
    status = F.when(F.col("conflict"), "quarantined").when(F.col("copy") == 1, "selected_current").otherwise("repeated_snapshot")
    return rows.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


# -- merges ----------------------------------------------------------------------

TARGET = f"SELECT user_id, ts, event_id FROM events WHERE ts <= TIMESTAMP '{CUTOFF}' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"
BATCH = f"SELECT user_id, ts, event_id FROM events WHERE ts > TIMESTAMP '{CUTOFF}' - INTERVAL 5 MINUTE QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id")
    order = [F.desc("ts"), F.desc("event_id")]
    start = F.expr(f"timestamp_ntz'{CUTOFF}' - INTERVAL 5 MINUTES")
    return versions.latest(rows.filter(F.col("ts") <= F.expr(f"timestamp_ntz'{CUTOFF}'")), ["user_id"], order), versions.latest(rows.filter(F.col("ts") > start), ["user_id"], order)


@query(f"""WITH t AS ({TARGET}), s AS ({BATCH}) SELECT coalesce(t.user_id, s.user_id) AS user_id,
  CASE WHEN t.user_id IS NULL OR s.ts > t.ts THEN s.event_id ELSE t.event_id END AS event_id FROM t FULL OUTER JOIN s ON t.user_id = s.user_id""")
def upsert_newer_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    target, batch = sides(spark, sf_dir)
    return upsert.newer_wins(target, batch, "user_id", "ts").select("user_id", "event_id")


@query(f"""WITH t AS ({TARGET}), s AS ({BATCH}) SELECT count(*) FILTER (t.user_id IS NULL) AS inserted, count(*) FILTER (s.ts > t.ts) AS updated,
  count(*) - count(*) FILTER (t.user_id IS NULL) - count(*) FILTER (s.ts > t.ts) AS replayed_or_unchanged FROM s LEFT JOIN t ON s.user_id = t.user_id""")
def upsert_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upsert.upsert_statistics(*sides(spark, sf_dir), "user_id", "ts")


HALF = "o_totalprice < 200000"  # two sides that overlap and cover all orders
OVERLAP = "o_totalprice >= 150000 OR o_totalprice IS NULL"


@query(f"SELECT o_orderkey, o_custkey, CASE WHEN {HALF} THEN 'target' ELSE 'batch' END AS origin FROM orders")
def insert_only_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders")
    target, batch = (rows.filter(side).select("o_orderkey", "o_custkey", F.lit(name).alias("origin")) for side, name in ((HALF, "target"), (OVERLAP, "batch")))
    return target.unionByName(upsert.absent(batch, target, ["o_orderkey"]))


@query(f"SELECT o_orderkey FROM orders WHERE ({HALF}) AND ({OVERLAP}) AND o_orderpriority <> '5-LOW'")
def receipt_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders")
    batch = rows.filter(OVERLAP).select("o_orderkey", F.when(F.col("o_orderpriority") == "5-LOW", "same").otherwise("other").alias("content"))
    target = rows.filter(HALF).select("o_orderkey", F.lit("same").alias("content"))
    return upsert.collisions(batch, target, "o_orderkey", "content")


@query("SELECT l_orderkey, l_linenumber, count(*) AS \"count\" FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upsert.duplicate_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def fk_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upsert.orphans(table(spark, sf_dir, "orders").select("o_orderkey"), members(spark, sf_dir), ["o_orderkey"])


# -- incremental reads -----------------------------------------------------------

WINDOW = f"ts > TIMESTAMP '{WATERMARK}' - INTERVAL 5 MINUTE AND ts <= TIMESTAMP '{CUTOFF}'"


def window(spark: SparkSession, sf_dir: str) -> tuple[Column, Column]:
    return F.col("ts") > F.expr(f"timestamp_ntz'{WATERMARK}' - INTERVAL 5 MINUTES"), F.col("ts") <= F.expr(f"timestamp_ntz'{CUTOFF}'")


@query(f"SELECT event_id, user_id, event_type FROM events WHERE {WINDOW}")
def incremental_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    low, high = window(spark, sf_dir)
    return table(spark, sf_dir, "events").filter(low & high).select("event_id", "user_id", "event_type")


@query(f"""SELECT available, read, greatest(0, available - read) AS avoided, CASE WHEN available = 0 THEN 0.0 ELSE round(100.0::DOUBLE * greatest(0, available - read) / nullif(available, 0), 1) END AS reduction_pct
  FROM (SELECT count(*) FILTER (ts <= TIMESTAMP '{CUTOFF}') AS available, count(*) FILTER ({WINDOW}) AS read FROM events)""")
def read_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    low, high = window(spark, sf_dir)
    counts = table(spark, sf_dir, "events").agg(F.count_if(high).alias("available"), F.count_if(low & high).alias("read"))
    avoided, share = metrics.read_reduction(F.col("available"), F.col("read"))
    return counts.select("available", "read", avoided.alias("avoided"), share.alias("reduction_pct"))


@query("SELECT event_type, epoch_us(max(ts)) AS watermark_us FROM events GROUP BY event_type")
def high_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    tops = table(spark, sf_dir, "events").groupBy("event_type").agg(F.max("ts").alias("top"))
    return tops.select("event_type", F.unix_micros(F.col("top").cast("timestamp")).alias("watermark_us"))


@query("SELECT event_id, user_id FROM events ORDER BY ts, event_id LIMIT 250 OFFSET 500")
def ordered_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").orderBy("ts", "event_id").offset(500).limit(250).select("event_id", "user_id")


# -- published tables ------------------------------------------------------------


@query("SELECT DISTINCT l_orderkey, l_returnflag AS category, l_linestatus AS subcategory FROM lineitem")
def category_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("category"), F.col("l_linestatus").alias("subcategory")).distinct()


PIVOT = "SELECT l_orderkey, " + ", ".join(f"max(CASE WHEN l_linenumber = {i} THEN l_quantity END) AS {c}" for i, c in enumerate(QUESTION_COLUMNS.values(), 1)) + " FROM lineitem GROUP BY l_orderkey"


@query(PIVOT)
def question_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").pivot("l_linenumber", list(range(1, 6))).agg(F.max("l_quantity"))
    return rows.withColumnsRenamed({str(i): c for i, c in enumerate(QUESTION_COLUMNS.values(), 1)})


@query(f"""WITH p AS ({PIVOT}), c AS (SELECT l_orderkey, count(*) AS category_count FROM (SELECT DISTINCT l_orderkey, l_returnflag FROM lineitem) GROUP BY 1)
  SELECT o_orderkey, o_orderstatus, p.* EXCLUDE (l_orderkey), coalesce(category_count, 0)::INT AS category_count
  FROM orders LEFT JOIN p ON o_orderkey = p.l_orderkey LEFT JOIN c ON o_orderkey = c.l_orderkey""")
def responses_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = members(spark, sf_dir).distinct().groupBy("o_orderkey").agg(F.count("*").cast("int").alias("category_count"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    pivot = question_pivot(spark, sf_dir).withColumnRenamed("l_orderkey", "o_orderkey")
    return orders.join(pivot, "o_orderkey", "left").join(counts, "o_orderkey", "left").fillna(0, ["category_count"])


FAN = f"""SELECT r.o_orderkey, r.metric, r.score, c.category, q.l_linenumber FROM ({SCORED}) r
  LEFT JOIN (SELECT DISTINCT l_orderkey, l_returnflag AS category FROM lineitem) c ON r.o_orderkey = c.l_orderkey
  LEFT JOIN (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) q ON r.o_orderkey = q.l_orderkey"""


def fanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber").distinct()
    return metrics.fan_out(scored(spark, sf_dir), members(spark, sf_dir).distinct(), questions, ["o_orderkey"])


@query(f"SELECT o_orderkey, count(*) AS n FROM ({FAN}) GROUP BY o_orderkey")
def fanout_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fanned(spark, sf_dir).groupBy("o_orderkey").agg(F.count("*").alias("n"))


def summary_sql(rows: str) -> str:
    return f"""SELECT count(*) AS rows, count(*) FILTER (metric = 'NPS') AS nps_responses,
  {SHARE.format(SIGNED + " FILTER (metric = 'NPS')", "count(*) FILTER (metric = 'NPS')")} AS nps, count(*) FILTER (metric = 'CSAT') AS csat_responses,
  {SHARE.format("count(*) FILTER (metric = 'CSAT' AND score >= 4)", "count(*) FILTER (metric = 'CSAT')")} AS csat_top2_pct FROM ({rows})"""


@query(f"SELECT 'response' AS grain, * FROM ({summary_sql(SCORED)}) UNION ALL SELECT 'joined', * FROM ({summary_sql(FAN)})")
def fanout_metric_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    right, wrong = metrics.summary(scored(spark, sf_dir)), metrics.summary(fanned(spark, sf_dir))
    return right.select(F.lit("response").alias("grain"), "*").unionByName(wrong.select(F.lit("joined").alias("grain"), "*"))


# -- metrics ---------------------------------------------------------------------


@query(f"SELECT {SHARE.format(SIGNED, 'count(*)')} AS nps, count(*) AS n FROM ({SCORED}) WHERE metric = 'NPS'")
def nps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).filter("metric = 'NPS'").agg(metrics.nps(F.col("score")).alias("nps"), F.count("*").alias("n"))


@query(f"SELECT {SHARE.format('count(*) FILTER (score >= 4)', 'count(*)')} AS csat_top2_pct, count(*) AS n FROM ({SCORED}) WHERE metric = 'CSAT'")
def csat_top2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).filter("metric = 'CSAT'").agg(metrics.top_two(F.col("score")).alias("csat_top2_pct"), F.count("*").alias("n"))


@query(f"""SELECT count(*) AS n, {SHARE.format(SIGNED, "count(*)")} AS nps FROM ({SCORED}) r
  WHERE metric = 'NPS' AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = r.o_orderkey AND l_returnflag = 'R')""")
def nps_exists_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = metrics.with_member(scored(spark, sf_dir).filter("metric = 'NPS'"), members(spark, sf_dir).filter("category = 'R'"), ["o_orderkey"])
    return some.agg(F.count("*").alias("n"), metrics.nps(F.col("score")).alias("nps"))


@query(f"""WITH m AS (SELECT DISTINCT l_orderkey, l_returnflag AS category FROM lineitem)
  SELECT category, count(*) AS category_responses, {SHARE.format(SIGNED, "count(*)")} AS category_nps FROM ({SCORED}) r JOIN m ON r.o_orderkey = m.l_orderkey WHERE metric = 'NPS' GROUP BY category""")
def nps_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.by_member(scored(spark, sf_dir), members(spark, sf_dir), ["o_orderkey"], "category")


# -- functions -------------------------------------------------------------------


@query("SELECT doc_id, length(trim(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g'))) AS n, sha256(trim(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g'))) AS content FROM documents")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = fn.clean_text(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.length(clean).cast("long").alias("n"), fn.digest(clean).alias("content"))


@query("SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events")
def json_field_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    payload = F.try_parse_json("props")
    return table(spark, sf_dir, "events").withColumn("v", payload).select("event_id", F.expr("try_variant_get(v, '$.k', 'bigint')").alias("k"))


@query("""SELECT o_orderkey, sha256('{"key":' || o_orderkey || ',"priority":"' || o_orderpriority || '","status":"' || o_orderstatus || '"}') AS payload_hash FROM orders""")
def payload_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = fn.json_object({"status": fn.json_string(F.col("o_orderstatus")), "key": F.col("o_orderkey").cast("string"), "priority": fn.json_string(F.col("o_orderpriority"))})
    return table(spark, sf_dir, "orders").select("o_orderkey", fn.digest(whole).alias("payload_hash"))


@query("SELECT event_id, strftime(date_trunc('second', ts) - INTERVAL 5 MINUTE, '%Y-%m-%dT%H:%M:%SZ') AS overlap, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS instant FROM events")
def instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").select("event_id", fn.iso_seconds(fn.overlap_start(ts)).alias("overlap"), fn.iso_micros(ts).alias("instant"))


@query("SELECT 'nation' AS dataset, count(*) AS n, sum(n_nationkey)::BIGINT AS total FROM nation UNION ALL SELECT 'region', count(*), sum(r_regionkey)::BIGINT FROM region")
def bundle_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    whole = bundle({"nation": nation, "region": region})
    out = None
    for name, schema, key in (("nation", nation.schema, "n_nationkey"), ("region", region.schema, "r_regionkey")):
        part = unbundle(whole, name, schema).agg(F.lit(name).alias("dataset"), F.count("*").alias("n"), F.sum(key).cast("long").alias("total"))
        out = part if out is None else out.unionByName(part)
    return out
