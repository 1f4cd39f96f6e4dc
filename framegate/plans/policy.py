"""Uploads, devices, tokens, retention and quotas."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framegate.operators import policy
from framegate.plans.base import DAY_US, EV, query
from framegate.sources import captures, images, store
from framegate.sources.tables import events, load, shared_folder

WEEK_S = 7 * 86_400
AS_OF_US = 1_706_745_600_000_000  # 2024-02-01
RULES_SQL = "CASE WHEN length(html) > 3000 THEN 'too large' WHEN html NOT LIKE '<%' THEN 'not an image' WHEN length(url) < 24 THEN 'too small' WHEN page_id % 50 = 0 THEN 'too many pixels' END"


@query(f"SELECT page_id, {RULES_SQL} AS violation FROM pages")
def validate_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = load(spark, sf_dir, "pages")
    rules = (
        ("too large", F.length("html") > 3000), ("not an image", ~F.col("html").startswith("<")), ("too small", F.length("url") < 24),
        ("too many pixels", F.col("page_id") % 50 == 0),
    )
    good, bad = images.validate_items(pages, rules)
    return good.select("page_id", F.lit(None).cast("string").alias("violation")).unionByName(bad.select("page_id", "violation"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def read_capture_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captures.read_capture_log(load(spark, sf_dir, "events"), "props", "k long").select("event_id", "record.k")


@query("""SELECT p_partkey, round(w * h / 1e6, 6) AS megapixels, w * h >= 12000000 AS meets_requirement
  FROM (SELECT p_partkey, coalesce(CASE WHEN p_partkey % 5 > 0 THEN p_size * 100 END, p_size * 90, 0) AS w, coalesce(CAST(floor(p_retailprice * 3) AS INT), 0) AS h FROM (SELECT *, CAST(p_size AS BIGINT) AS _s FROM part))""")
def device_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = load(spark, sf_dir, "part").select(
        "p_partkey", F.when(F.col("p_partkey") % 5 > 0, F.col("p_size") * 100).alias("mw"), F.floor(F.col("p_retailprice") * 3).cast("int").alias("mh"),
        (F.col("p_size") * 90).alias("sw"), F.lit(None).cast("int").alias("sh"),
    )
    return captures.device_eligibility(df, "mw", "mh", "sw", "sh").select("p_partkey", F.round("megapixels", 6).alias("megapixels"), "meets_requirement")


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first signup of each user as a stored token."""
    ev = events(spark, sf_dir).filter("event_type = 'signup'")
    return ev.groupBy("user_id").agg(F.min("us").alias("created_us"))


STORED = f"{EV}, stored AS (SELECT user_id, min(us) AS created_us FROM ev WHERE event_type = 'signup' GROUP BY user_id), asked AS (SELECT * FROM ev WHERE event_type = 'purchase')"
FOUND = f"coalesce(us - created_us BETWEEN 0 AND {WEEK_S * 1_000_000}, false)"


@query(f"WITH {STORED} SELECT event_id, {FOUND} AS found FROM asked LEFT JOIN stored USING (user_id)")
def token_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = events(spark, sf_dir).filter("event_type = 'purchase'")
    return policy.token_lookup(asked, stored(spark, sf_dir), "user_id", "us", "created_us", WEEK_S).select("event_id", "found")


@query("SELECT doc_id FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id)")
def orphan_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.orphan_index(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"), "doc_id")


@query(f"""WITH {EV}, seen AS (SELECT DISTINCT user_id FROM ev WHERE event_type = 'view')
  SELECT user_id, count(e.event_id) FILTER (WHERE event_type = 'click') AS results, count(e.event_id) FILTER (WHERE event_type = 'click' AND k >= 20) AS successes,
         count(e.event_id) FILTER (WHERE event_type = 'purchase') AS downloads FROM seen LEFT JOIN ev e USING (user_id) GROUP BY user_id""")
def capture_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir)
    results = ev.filter("event_type = 'click'").withColumn("success", F.col("k") >= 20)
    return policy.capture_lineage(ev.filter("event_type = 'view'").select("user_id").distinct(), results, ev.filter("event_type = 'purchase'"), "user_id")


@query(f"""WITH {EV} SELECT event_id, {AS_OF_US} - us > {WEEK_S * 1_000_000} AS expired, greatest(0.0, (us + {WEEK_S * 1_000_000} - {AS_OF_US}) / 1000000.0) AS time_remaining,
  greatest(1, CAST(floor(greatest(0.0, (us + {WEEK_S * 1_000_000} - {AS_OF_US}) / 1000000.0)) AS INT)) AS ttl_seconds FROM ev""")
def ttl_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.ttl_status(events(spark, sf_dir), "us", AS_OF_US, WEEK_S).select("event_id", "expired", "time_remaining", "ttl_seconds")


@query(f"""WITH {EV} SELECT CASE WHEN {AS_OF_US} - us <= {WEEK_S * 1_000_000} THEN 'live' ELSE 'evicted' END AS part, count(*) AS items FROM ev GROUP BY 1""")
def ttl_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    live, evicted = policy.ttl_sweep(events(spark, sf_dir), "us", AS_OF_US, WEEK_S)
    parts = live.select(F.lit("live").alias("part")).unionAll(evicted.select(F.lit("evicted").alias("part")))
    return parts.groupBy("part").agg(F.count("*").alias("items"))


SWEEPS = (AS_OF_US - 10 * DAY_US, AS_OF_US)
_GONE = "us < {at} - " + str(WEEK_S * 1_000_000)
_SWEPT = "SELECT {k} AS sweep, us // " + str(DAY_US) + " AS day, count(*) FILTER (WHERE " + _GONE + ") AS evicted, count(*) FILTER (WHERE NOT (" + _GONE + ")) AS kept FROM {rows} GROUP BY ALL HAVING evicted > 0"


def _store(spark: SparkSession, sf_dir: str) -> store.TokenStore:
    """All events as items of a new store, their ids as tokens."""
    made = store.TokenStore(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}", "event_id", "us", WEEK_S)
    made.put(events(spark, sf_dir).select("event_id", "us", "event_type"))
    return made


@query(f"""WITH {EV}, left_ AS (SELECT * FROM ev WHERE NOT ({_GONE.format(at=SWEEPS[0])}))
  {_SWEPT.format(k=1, at=SWEEPS[0], rows="ev")} UNION ALL {_SWEPT.format(k=2, at=SWEEPS[1], rows="left_")}""")
def ttl_sweep_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store by day is swept twice: what each sweep evicted and left of the days it touched."""
    items = _store(spark, sf_dir)
    first, second = (items.sweep(at).withColumn("sweep", F.lit(k)) for k, at in enumerate(SWEEPS, 1))
    return first.unionByName(second)


@query(f"""WITH {EV}, gone AS (SELECT count(*) FILTER (WHERE {_GONE.format(at=AS_OF_US)}) AS n, count(*) AS n_all FROM ev)
  SELECT 1 AS run, n AS cleaned, n_all - n AS tokens FROM gone UNION ALL SELECT 2, 0, n_all - n FROM gone""")
def orphan_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After a sweep the index is cleaned twice: how many tokens each run took and left."""
    items = _store(spark, sf_dir)
    items.sweep(AS_OF_US)
    runs = [(k, items.clean_index(), items.index().count()) for k in (1, 2)]
    return spark.createDataFrame(runs, "run int, cleaned long, tokens long")


@query(f"WITH {EV} SELECT event_type, count(*) AS items FROM ev WHERE {AS_OF_US} - us <= {WEEK_S * 1_000_000} GROUP BY event_type")
def store_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.store_stats(events(spark, sf_dir), "event_type", "us", AS_OF_US, WEEK_S)


ADMITTED = f"row_number() OVER (PARTITION BY event_type, user_id, us // {DAY_US} ORDER BY us, event_id) <= 2"


@query(f"WITH {EV} SELECT event_id, {ADMITTED} AS admitted FROM ev")
def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.rate_limit(events(spark, sf_dir), "event_type", "user_id", "us", "event_id", 2, DAY_US).select("event_id", "admitted")


@query(f"""WITH {EV} SELECT event_id, count(*) OVER (PARTITION BY event_type, user_id ORDER BY us RANGE BETWEEN {DAY_US - 1} PRECEDING AND CURRENT ROW) <= 2 AS admitted FROM ev""")
def rate_limit_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.rate_limit(events(spark, sf_dir), "event_type", "user_id", "us", "event_id", 2, DAY_US, sliding=True).select("event_id", "admitted")


@query(f"""WITH {EV} SELECT event_id, CASE WHEN k % 3 = 0 THEN 'f' || k WHEN k >= 10 THEN CAST(user_id AS VARCHAR) ELSE 'unknown' END AS client FROM ev""")
def client_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    peer = F.when(k >= 10, F.col("user_id").cast("string"))
    forwarded = F.concat(F.lit("f"), k.cast("string"), F.lit(", proxy"))
    return events(spark, sf_dir).select("event_id", policy.client_key(peer, forwarded, k % 3 == 0).alias("client"))


@query(f"""WITH {STORED}, limited AS (SELECT *, {ADMITTED} AS admitted FROM asked)
  SELECT event_id, CASE WHEN k = 0 THEN 422 WHEN NOT admitted THEN 429 WHEN NOT {FOUND} THEN 404 ELSE 200 END AS download,
         CASE WHEN NOT admitted THEN 429 WHEN k < 3 THEN 500 WHEN value <= 10 THEN 400 WHEN k > 90 THEN 500 ELSE 200 END AS process
  FROM limited LEFT JOIN stored USING (user_id)""")
def request_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = events(spark, sf_dir).filter("event_type = 'purchase'")
    asked = policy.rate_limit(asked, "event_type", "user_id", "us", "event_id", 2, DAY_US)
    df = policy.token_lookup(asked, stored(spark, sf_dir), "user_id", "us", "created_us", WEEK_S)
    k, token = F.col("k"), F.when(F.col("k") > 0, F.col("user_id").cast("string")).otherwise("")
    return df.select(
        "event_id", policy.download_outcome(token, F.col("admitted"), F.col("found")).alias("download"),
        policy.process_outcome(F.col("admitted"), k >= 3, F.col("value") > 10, k <= 90).alias("process"),
    )


@query("SELECT o_orderkey, sha256(CAST(o_orderkey AS VARCHAR) || chr(31) || o_orderstatus) AS result_key FROM orders")
def result_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys under which write_results appends."""
    return load(spark, sf_dir, "orders").select("o_orderkey", captures.result_key(F.col("o_orderkey"), F.col("o_orderstatus")).alias("result_key"))


@query("""SELECT day, CAST(o_orderkey AS VARCHAR) AS item_id, sha256(CAST(o_orderkey AS VARCHAR) || chr(31) || o_orderstatus) AS result_key, length(o_orderpriority) AS payload_bytes
  FROM (SELECT *, strftime(o_orderdate, '%Y-%m') AS day FROM orders)""")
def write_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results and payload are written after a run that broke off half-way, written again as
    by a repeated run, and read back: every key once."""
    path = f"{shared_folder(spark)}/results-{uuid.uuid4().hex}"
    rows = load(spark, sf_dir, "orders").select(
        F.date_format("o_orderdate", "yyyy-MM").alias("day"), F.col("o_orderkey").cast("string").alias("item_id"),
        captures.result_key(F.col("o_orderkey"), F.col("o_orderstatus")).alias("result_key"), F.encode("o_orderpriority", "UTF-8").alias("payload"),
    )
    results, payload = rows.select("result_key", "item_id", "day"), rows.select("result_key", "payload", "day")
    captures.write_results(results.filter("item_id % 2 = 0"), payload.filter("hash(result_key) % 2 = 0"), "result_key", "day", path)
    for _ in range(2):
        captures.write_results(results, payload, "result_key", "day", path)
    held, sizes = (spark.read.schema(df.schema).parquet(f"{path}/{t}") for df, t in ((results, "results"), (payload, "payload")))
    return held.join(sizes, ["result_key", "day"]).select("day", "item_id", "result_key", F.octet_length("payload").cast("long").alias("payload_bytes"))
