"""What a console shows of contacts, jobs, tiers and routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def split_preview(preview: DataFrame, contacts: DataFrame) -> DataFrame:
    """preview(name) with imported: whether a contact of that name, whatever the case, is there already."""
    there = contacts.select(F.lower("name").alias("_n")).distinct().withColumn("_there", F.lit(True))
    return preview.join(there, F.lower("name") == F.col("_n"), "left").withColumn("imported", F.coalesce("_there", F.lit(False))).drop("_n", "_there")


def filter_rows(rows: DataFrame, search: str, columns: list[str], most: int, *order: str) -> DataFrame:
    """The first rows whose columns, joined by blanks, hold the search text whatever the case (300 contacts, 200 in a picker, jobs by their two names)."""
    text = F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in columns]))
    return rows.where(F.contains(text, F.lit(search.strip().lower()))).orderBy(*order).limit(most)


def prefill(role: Column, company: Column) -> Column:
    """The context that a picked contact suggests."""
    return F.concat_ws(" at ", F.nullif(F.trim(role), F.lit("")), F.nullif(F.trim(company), F.lit("")))


def tier_head(candidates: DataFrame, tier: int, most: int = 12) -> DataFrame:
    return candidates.where(F.col("tier") == tier).orderBy("rank").limit(most)


def route_people(routes: DataFrame, most: int = 500) -> DataFrame:
    """(name) of the distinct people on routes(nodes), to be matched with the roster."""
    return routes.select(F.explode("nodes").alias("name")).distinct().orderBy("name").limit(most)
