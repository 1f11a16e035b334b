"""Verification of extractions against the pages they cite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hopweave.functions import names as N
from hopweave.functions.names import fold


def invariants(start: Column, end: Column, span: Column, basis: Column, context: Column, subject: Column, obj: Column) -> Column:
    """Width equals the span's length, a context where the basis is not direct or a claim, two different parties."""
    return (end > start) & (end - start == F.length(span)) & (basis.isin("direct", "structured_claim") | (F.coalesce(F.trim(context), F.lit("")) != "")) & (fold(F.trim(subject)) != fold(F.trim(obj)))


def contains_span(text: Column, start: Column, end: Column, span: Column) -> Column:
    return F.substring(text, start + 1, end - start) == span


def ground(raw: DataFrame, sents: DataFrame, pages: DataFrame) -> DataFrame:
    """raw extractions with span_start, span_end and reject_reason (null where accepted).

    raw(page_id, subject_name, object_name, sentence_index, span_text, context_before, resolution_basis, subject_attributes, object_attributes).
    """
    out = raw.join(sents.select("page_id", F.col("idx").alias("sentence_index"), F.col("start").alias("_s"), F.col("text").alias("_t")), ["page_id", "sentence_index"], "left").join(pages.select("page_id", F.col("text").alias("_page")), "page_id", "left")
    at = F.expr("position(span_text, _t)")
    start = F.col("_s") + at - 1
    context = F.trim(F.col("context_before"))
    people = F.array(*[N.surname(N.tokens(F.col(c))) for c in ("subject_name", "object_name")])
    antecedent = (context != "") & F.contains(F.col("_page"), context) & F.exists(people, lambda s: (s != "") & F.contains(fold(context), s))

    def org(side: str) -> Column:
        name, attrs = F.col(f"{side}_name"), F.col(f"{side}_attributes")
        stated = F.exists(F.coalesce(attrs, F.array().cast("array<string>")), lambda a: fold(F.trim(a)) == fold(F.trim(name)))
        return N.looks_like_org(name, N.tokens(name)) | stated

    out = out.withColumn("span_start", F.when(at > 0, start)).withColumn("span_end", F.when(at > 0, start + F.length("span_text")))
    reason = (
        F.when(org("subject") | org("object"), "organisation")
        .when(F.col("_t").isNull() | (F.col("span_text") == "") | ~(F.coalesce(at, F.lit(0)) > 0), "span_not_found")
        .when((F.col("resolution_basis") != "direct") & ~F.coalesce(antecedent, F.lit(False)), "no_antecedent")
        .when(~invariants(F.col("span_start"), F.col("span_end"), F.col("span_text"), F.col("resolution_basis"), F.col("context_before"), F.col("subject_name"), F.col("object_name")), "invariant")
        .when(~contains_span(F.col("_page"), F.col("span_start"), F.col("span_end"), F.col("span_text")), "span_mismatch")
    )
    return out.withColumn("reject_reason", reason).drop("_s", "_t", "_page")


def dedup_extractions(rows: DataFrame, order: str) -> DataFrame:
    """The first of each (page, span start, folded names)."""
    w = W.partitionBy("page_id", "span_start", F.lower("subject_name"), F.lower("object_name")).orderBy(order)
    return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def ground_co_listings(rosters: DataFrame, sents: DataFrame, anchors: DataFrame, known: DataFrame, most: int = 40) -> DataFrame:
    """Star edges (page_id, roster_id, subject_name, object_name) of rosters(page_id, roster_id, members array<struct<name, sentence_index, span_text>>).

    Members are located in their sentences, organisations dropped; the pivot is the first member that could be the page's anchor
    (anchors(page_id, anchor)), else the first whose name key is known (known(name_key)); a roster without one is skipped.
    """
    m = rosters.select("page_id", "roster_id", F.posexplode("members").alias("pos", "m")).select("page_id", "roster_id", "pos", "m.*").where(F.col("pos") < most)
    m = m.join(sents.select("page_id", F.col("idx").alias("sentence_index"), F.col("text").alias("_t")), ["page_id", "sentence_index"]).where(F.contains("_t", "span_text"))
    m = m.withColumn("_tok", N.tokens(F.col("name"))).where(~N.looks_like_org(F.col("name"), F.col("_tok")))
    m = m.join(anchors, "page_id", "left").join(known.select(F.col("name_key").alias("_key"), F.lit(True).alias("_known")).distinct(), N.name_key(F.col("_tok")) == F.col("_key"), "left")
    rank = F.when(F.col("anchor").isNotNull() & N.could_be_same_name(F.col("_tok"), N.tokens(F.col("anchor"))), 0).when(F.col("_known"), 1).otherwise(2)
    w = W.partitionBy("page_id", "roster_id")
    m = m.withColumn("_rank", rank).withColumn("_pivot", F.min(F.struct("_rank", "pos", "name")).over(w)).withColumn("_n", F.count("*").over(w))
    return m.where("_n >= 2 and _pivot._rank < 2 and pos <> _pivot.pos").select("page_id", "roster_id", F.col("_pivot.name").alias("subject_name"), F.col("name").alias("object_name"))
