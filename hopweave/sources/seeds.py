"""Curated pairs: CSV worklists, the pages they cite, and a report of what those pages confirm."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopweave.operators import parse, tables

COLUMNS = {"target_name": "a", "connection_name": "b", "relationship_type": "kind", "source_url": "source_url"}


def read_pairs(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """pairs(a, b, kind, source_url) of CSV files with a header; rows without both names or a web address go. Repeated rows stay."""
    rows = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(paths)
    got = rows.select(*[(F.trim(F.coalesce(F.col(c), F.lit(""))) if c in rows.columns else F.lit("")).alias(n) for c, n in COLUMNS.items()])
    return got.where("a <> '' and b <> '' and source_url like 'http%'")


def worklist(pairs: DataFrame) -> DataFrame:
    """(source_url, anchors, pairs): each page once, with the names to look for. Anchors of a page are distinct, as pages cite few people."""
    both = pairs.select("source_url", F.explode(F.array("a", "b")).alias("name"))
    return pairs.groupBy("source_url").agg(F.count("*").alias("pairs")).join(both.groupBy("source_url").agg(F.array_sort(F.collect_set("name")).alias("anchors")), "source_url")


def import_pairs(pairs: DataFrame, pages: DataFrame, existing: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(relations to append, pairs with confirmed) from pages(page_id, url, html): each cited page is parsed once and read without a model."""
    cited = pages.join(pairs.select(F.col("source_url").alias("url")).distinct(), "url", "left_semi").select("page_id", "url", "html")
    docs = parse.documents(cited)
    ex = parse.degraded_extractions(parse.sentences(docs.where("skip_reason is null"))).join(docs.select("page_id", F.col("url").alias("source_url")), "page_id")
    new = ex.dropDuplicates(tables.UNIQUE)
    return (new if existing is None else new.join(existing.select(*tables.UNIQUE), tables.UNIQUE, "left_anti")), tables.confirm_pairs(pairs, ex)


def report(pairs: DataFrame, confirmed: DataFrame, relations: DataFrame, pages: DataFrame) -> DataFrame:
    """One row of counters."""
    urls = pairs.select("source_url").distinct()
    got = urls.join(pages.select(F.col("url").alias("source_url")).distinct(), "source_url", "left_semi")
    one = lambda df, name: df.agg(F.count("*").alias(name))
    sums = confirmed.agg(F.count("*").alias("pairs_total"), F.count_if("confirmed").alias("pairs_confirmed"), F.count_if(~F.col("confirmed")).alias("pairs_unsupported"))
    return one(urls, "urls_total").crossJoin(one(got, "urls_fetched")).crossJoin(sums).crossJoin(one(relations, "relations_written"))  # one row each


def write_report(counters: DataFrame, confirmed: DataFrame, path: str, most: int = 200) -> None:
    """The counters with a sample of unsupported pairs, as one JSON document."""
    rows = confirmed.where(~F.col("confirmed")).orderBy("source_url", "a", "b").limit(most).select("a", "b", "source_url").collect()
    one = counters.first().asDict() | {"unsupported_sample": [list(r) for r in rows]}
    counters.sparkSession.createDataFrame([(json.dumps(one),)], "value string").coalesce(1).write.mode("overwrite").text(path)
