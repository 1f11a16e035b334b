"""Recorded answers of external services as tables: pages, searches, caches, providers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hopweave import dictionaries as D
from hopweave.functions import text as T


def first_per(df: DataFrame, keys: list[str], *order) -> DataFrame:
    return df.withColumn("_k", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")


def top_per(df: DataFrame, keys: list[str], most: int, *order) -> DataFrame:
    return df.withColumn("_k", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_k") <= most).drop("_k")


def fetch_reason(status: Column, content_type: Column, url: Column, robots_allow: Column) -> Column:
    """Why a recorded response gives no page, or null; the cheap gates first."""
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    return (
        F.when(T.is_binary_url(url), "binary").when(T.is_blocked_url(url), "blocked_domain").when(~F.coalesce(robots_allow, F.lit(True)), "robots")
        .when(status.isin(D.RETRY_STATUS), "retry_exhausted").when(status >= 400, "http_error").when((kind != "") & ~F.contains(kind, F.lit("html")) & ~F.contains(kind, F.lit("text/plain")), "content_type")
    )


def cache_read(cache: DataFrame, wanted: DataFrame, as_of: Column, ttl_seconds: int) -> DataFrame:
    """wanted(namespace, key) with value: null where absent, null itself, or older than the ttl (0: never)."""
    fresh = first_per(cache, ["namespace", "key_hash"], F.desc("stored_at"))
    if ttl_seconds:
        fresh = fresh.where(F.unix_timestamp(as_of) - F.unix_timestamp("stored_at") <= ttl_seconds)
    return wanted.withColumn("key_hash", F.sha2("key", 256)).join(fresh.select("namespace", "key_hash", "value"), ["namespace", "key_hash"], "left").drop("key_hash")


def cache_compact(cache: DataFrame) -> DataFrame:
    """Latest entry of each key; with prefix, by which the table is stored in folders."""
    return first_per(cache, ["namespace", "key_hash"], F.desc("stored_at")).withColumn("prefix", F.substring("key_hash", 1, 2))


HITS = "struct<organic:array<struct<title:string,link:string,snippet:string,position:int>>>"


def flatten_search(responses: DataFrame) -> DataFrame:
    """responses(query, payload JSON) -> query, position, link, title, snippet; items without a link are dropped."""
    hits = responses.select("query", F.posexplode(F.from_json("payload", HITS)["organic"]).alias("i", "h"))
    return hits.where("coalesce(h.link, '') <> ''").select("query", F.coalesce("h.position", F.col("i") + 1).alias("position"), F.col("h.link").alias("link"), F.coalesce("h.title", F.lit("")).alias("title"), F.coalesce("h.snippet", F.lit("")).alias("snippet"))


def urls_to_fetch(hits: DataFrame, seen: DataFrame, most: int = 6) -> DataFrame:
    """The best hits of each query, each URL once for the whole job, those seen before left out."""
    best = top_per(hits, ["query"], most, "position", "link")
    return first_per(best, ["link"], "query", "position").join(seen.select(F.col("url").alias("link")), "link", "left_anti")


def batches(df: DataFrame, size: int, *order, most: int | None = None) -> DataFrame:
    """Batch numbers of rows in order, and whether the number of calls is used up. Call it on bounded worklists."""
    out = df.withColumn("batch", F.floor((F.row_number().over(W.orderBy(*order)) - 1) / size))
    return out if most is None else out.withColumn("answered", F.col("batch") < most)


def nonprofit_match(wanted: Column, found: Column) -> Column:
    """Whether a found organisation's words hold all wanted ones and one more at most."""
    return (F.size(F.array_except(wanted, found)) == 0) & (F.size(F.array_except(found, wanted)) <= 1)


def filing_url(hit_id: Column, cik: Column) -> Column:
    parts = F.split(hit_id, ":")
    return F.concat(F.lit(D.FILING_URL), F.regexp_replace(cik, "^0+", ""), F.lit("/"), F.replace(parts[0], F.lit("-"), F.lit("")), F.lit("/"), parts[1])


def claim_extractions(claims: DataFrame) -> DataFrame:
    """claims(subject, relation, object, source_url) as extractions: the statement is its own span."""
    text = F.concat_ws(" ", "subject", "relation", "object")
    ok = (F.trim("subject") != "") & (F.trim("object") != "") & (F.lower(F.trim("subject")) != F.lower(F.trim("object")))
    return claims.where(ok).select(F.col("subject").alias("subject_name"), F.col("object").alias("object_name"), "source_url", text.alias("span_text"), F.lit(0).alias("span_start"), F.length(text).alias("span_end"), F.lit("structured_claim").alias("resolution_basis"))
