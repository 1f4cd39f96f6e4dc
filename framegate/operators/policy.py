"""Retention, quotas, request outcomes, and the joins behind them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framegate.presets import TTL_SECONDS

MICROS = 1_000_000


def ttl_status(df: DataFrame, created_us: str, as_of_us: int, ttl_s: int = TTL_SECONDS) -> DataFrame:
    """expired (strictly older than the time to live), time_remaining and ttl_seconds (at
    least 1) as of a given time."""
    left = (F.col(created_us) + ttl_s * MICROS - as_of_us) / MICROS
    return df.withColumns(
        {
            "expired": (F.lit(as_of_us) - F.col(created_us)) > ttl_s * MICROS,
            "time_remaining": F.greatest(F.lit(0.0), left),
            "ttl_seconds": F.greatest(F.lit(1), F.floor(F.greatest(F.lit(0.0), left)).cast("int")),
        }
    )


def ttl_sweep(df: DataFrame, created_us: str, as_of_us: int, ttl_s: int = TTL_SECONDS) -> tuple[DataFrame, DataFrame]:
    """(live, evicted); a row without a creation time is evicted."""
    age = F.lit(as_of_us) - F.col(created_us)
    live = F.coalesce(age <= ttl_s * MICROS, F.lit(False))
    return df.filter(live), df.filter(~live)


def store_stats(df: DataFrame, backend: str, created_us: str, as_of_us: int, ttl_s: int = TTL_SECONDS) -> DataFrame:
    live, _ = ttl_sweep(df, created_us, as_of_us, ttl_s)
    return live.groupBy(backend).agg(F.count("*").alias("items"))


def token_lookup(requests: DataFrame, store: DataFrame, token: str, us: str, created_us: str, ttl_s: int = TTL_SECONDS) -> DataFrame:
    """Each request with its stored item's creation time, and found: it existed and was not
    expired. Tokens are unique in the store."""
    held = store.select(F.col(token).alias("_token"), F.col(created_us).alias("stored_us"))
    age = F.col(us) - F.col("stored_us")
    out = requests.join(held, requests[token] == F.col("_token"), "left").drop("_token")
    return out.withColumn("found", F.coalesce((age >= 0) & (age <= ttl_s * MICROS), F.lit(False)))


def orphan_index(index: DataFrame, store: DataFrame, token: str) -> DataFrame:
    """Tokens of the index without an item in the store."""
    return index.select(token).join(store.select(token), token, "left_anti")


def capture_lineage(captures: DataFrame, results: DataFrame, downloads: DataFrame, key: str) -> DataFrame:
    """Each capture with its number of results, of successful ones and of downloads. Sides
    are aggregated before they are joined, so the captures do not fan out."""
    made = results.groupBy(key).agg(F.count("*").alias("results"), F.count_if("success").alias("successes"))
    got = downloads.groupBy(key).agg(F.count("*").alias("downloads"))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("results", "successes", "downloads")}
    return captures.join(made, key, "left").join(got, key, "left").withColumns(zero)


def client_key(peer: Column, forwarded: Column, trusted: Column) -> Column:
    """The peer's address; the first forwarded one only where the proxy is trusted;
    'unknown' where there is none."""
    first = F.trim(F.element_at(F.split(forwarded, ","), 1))
    told = F.when(trusted & (F.length(first) > 0), first)
    return F.coalesce(told, F.when(F.length(peer) > 0, peer), F.lit("unknown"))


def rate_limit(df: DataFrame, route: str, client: str, us: str, tie: str, n: Column | int, window_us: int, sliding: bool = False) -> DataFrame:
    """admitted: among the first n of its route and client in the aligned window; every
    request counts. sliding: at most n in the window_us up to and including the request."""
    if sliding:
        span = Window.partitionBy(route, client).orderBy(us).rangeBetween(-window_us + 1, 0)
        return df.withColumn("admitted", F.count("*").over(span) <= n)
    start = F.col(us) - F.pmod(F.col(us), F.lit(window_us))
    nth = F.row_number().over(Window.partitionBy(route, client, "_start").orderBy(us, tie))
    return df.withColumn("_start", start).withColumn("admitted", nth <= n).drop("_start")


def download_outcome(token: Column, admitted: Column, found: Column) -> Column:
    """422 for a bad token, then 429, 404 and 200."""
    size = F.coalesce(F.length(token), F.lit(0))
    return F.when((size == 0) | (size > 128), 422).when(~admitted, 429).when(~found, 404).otherwise(200)


def process_outcome(admitted: Column, loaded: Column, valid: Column, succeeded: Column) -> Column:
    """429, 500 while models are not loaded, 400 for a bad upload, 500 for a failed stage."""
    return F.when(~admitted, 429).when(~loaded, 500).when(~valid, 400).when(~succeeded, 500).otherwise(200)
