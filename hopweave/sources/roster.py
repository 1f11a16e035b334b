"""Contact roster files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hopweave import dictionaries as D
from hopweave.functions import names as N

COLUMNS, HEADER_ROWS = 24, 20


class RosterFormatError(ValueError):
    pass


def fold_header(value: Column) -> Column:
    return F.lower(F.replace(F.regexp_replace(F.trim(value), '^"+|"+$', ""), F.lit("_"), F.lit(" ")))


def pick(headers: list[str], kind: str) -> int | None:
    """Position of the first synonym that is present; headers are folded."""
    return next((headers.index(w) for w in D.HEADERS[kind] if w in headers), None)


def read_roster(spark: SparkSession, path: str) -> DataFrame:
    """Contacts (name, norm_name, name_key, role, company, profile_url, connected_on) of one CSV export.

    The header is found within the first rows, quoted commas and line feeds are kept, blank rows skipped; of rows with one normalized name the
    first counts. RosterFormatError where the file is empty or has no header. Only the rows up to the header reach the driver.
    """
    fields = ", ".join(f"c{i} string" for i in range(COLUMNS))
    rows = spark.read.schema(fields).option("multiLine", True).option("header", False).option("escape", '"').option("mode", "PERMISSIVE").csv(path)
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    head = rows.orderBy("_row").limit(HEADER_ROWS).collect()
    if not head:
        raise RosterFormatError("the file is empty")
    at, headers = None, []
    for r in head:
        folded = [(r[f"c{i}"] or "").strip().lstrip("﻿").strip('"').replace("_", " ").casefold() for i in range(COLUMNS)]
        named = pick(folded, "first") is not None and pick(folded, "last") is not None
        if named or (pick(folded, "full") is not None and sum(map(bool, folded)) > 1):
            at, headers = r["_row"], folded
            break
    if at is None:
        raise RosterFormatError("no header row with name columns in the first rows")
    col = lambda kind: F.coalesce(F.trim(F.col(f"c{i}")), F.lit("")) if (i := pick(headers, kind)) is not None else F.lit("")
    joined = F.trim(F.concat_ws(" ", col("first"), col("last")))
    name = F.when(joined != "", joined).otherwise(col("full"))
    out = rows.where(F.col("_row") > at).select("_row", name.alias("name"), col("role").alias("role"), col("company").alias("company"), col("url").alias("profile_url"), col("connected").alias("connected_on"))
    out = out.withColumn("_tok", N.tokens(F.col("name"))).withColumn("norm_name", N.normalize_name(F.col("_tok"))).withColumn("name_key", N.name_key(F.col("_tok"))).where("norm_name <> ''")
    return out.withColumn("_k", F.row_number().over(W.partitionBy("norm_name").orderBy("_row"))).where("_k = 1").select("name", "norm_name", "name_key", "role", "company", "profile_url", "connected_on")
