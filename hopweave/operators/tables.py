"""Persistent relations and contacts: insert-or-ignore, lookup with a time to live, fill-only upsert, roster matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hopweave.functions import names as N
from hopweave.sources.recorded import first_per
from hopweave.storage import materialize

UNIQUE = ["subject_name", "object_name", "source_url", "span_start", "span_end"]
FILLED = ["role", "company", "profile_url"]
#: Rows of a task of ``lookup_relations``, and keys that it broadcasts at most.
ROWS, FEW = 400_000, 100_000


def insert_relations(new: DataFrame, existing: DataFrame) -> DataFrame:
    """What of new is inserted: first of each unique tuple, none that exists. Append it."""
    return first_per(new, UNIQUE, "cached_at").join(existing.select(*UNIQUE), UNIQUE, "left_anti")


def lookup_relations(relations: DataFrame, keys: DataFrame, as_of: Column, ttl_seconds: int = 30 * 86400) -> DataFrame:
    """Relations cached within the ttl with a wanted name_key on either side, one per unique tuple; where keys(name_key, [person]) names persons, with the smallest of the keys met.

    However often a key occurs, no task has more than some ROWS rows: up to FEW keys are broadcast; of more, a part of the relations asks for a key
    once and meets the answer alone. All parts are by number, as few bytes can be many rows.
    """
    named, fresh = "person" in keys.columns, relations.where(F.unix_timestamp("cached_at") >= F.unix_timestamp(as_of) - ttl_seconds)
    wanted = keys.select(F.col("name_key").alias("_key"), (F.col("person") if named else F.lit(None).cast("string")).alias("_person")).where("_key is not null")
    smallest, many = F.min("_person").alias("_person"), keys.count()
    if many > FEW:
        fresh = materialize(fresh, "fresh-relations")
    parts = max(int(relations.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-max(2 * fresh.count(), many) // ROWS))
    if many > FEW:
        wanted = wanted.withColumn("_part", F.pmod(F.xxhash64("_person"), F.lit(parts))).repartition(parts, "_key", "_part").groupBy("_key", "_part").agg(smallest).repartition(parts, "_key").groupBy("_key").agg(smallest)
        ends = fresh.withColumn("_part", F.pmod(F.xxhash64(*UNIQUE), F.lit(parts))).withColumn("_key", F.explode(F.array_distinct(F.array("subject_key", "object_key")))).where("_key is not null")
        asked = ends.select("_part", "_key").repartition(parts, "_part", "_key").distinct()
        found = asked.repartition(parts, "_key").join(wanted.hint("merge"), "_key")
        met = ends.repartition(parts, "_part", "_key").join(found.repartition(parts, "_part", "_key").hint("merge"), ["_part", "_key"])
    else:
        wanted, met = wanted.groupBy("_key").agg(smallest), fresh
        for s in ("subject", "object"):
            met = met.join(F.broadcast(wanted.select(F.col("_key").alias(f"_{s}"), F.col("_person").alias(f"_of_{s}"))), F.col(f"{s}_key") == F.col(f"_{s}"), "left")
        met = met.where("_subject is not null or _object is not null").withColumn("_person", F.least("_of_subject", "_of_object"))
    rest = [c for c in relations.columns if c not in UNIQUE]
    one = met.repartition(parts, *UNIQUE).groupBy(*UNIQUE).agg(F.first(F.struct(*rest)).alias("_rest"), smallest)
    return one.select(*[F.col(c) if c in UNIQUE else F.col(f"_rest.`{c}`") for c in relations.columns], *([F.col("_person").alias("person")] if named else []))


def relation_stats(relations: DataFrame) -> DataFrame:
    people = relations.select(F.explode(F.array("subject_key", "object_key")).alias("k")).distinct().agg(F.count("*").alias("people"))
    return relations.agg(F.count("*").alias("relations"), F.count_if(F.col("resolution_basis") == "co_listing").alias("co_listings")).crossJoin(people)  # one row each


def upsert_contacts(new: DataFrame, existing: DataFrame) -> DataFrame:
    """The contacts after new is written, with action created, updated, skipped or kept. A blank never erases; name and connected_on stay."""
    o = existing.select("norm_name", *[F.col(c).alias(f"_{c}") for c in existing.columns if c != "norm_name"])
    both = new.join(o, "norm_name", "full_outer")
    there = F.col("_name").isNotNull()
    fill = {c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"_{c}"), F.lit("")) for c in FILLED}
    changed = F.lit(False)
    for c in FILLED:
        changed = changed | (there & (fill[c] != F.coalesce(f"_{c}", F.lit(""))))
    action = F.when(~there, "created").when(F.col("name").isNull(), "kept").when(changed, "updated").otherwise("skipped")
    return both.select("norm_name", F.coalesce("_name", "name").alias("name"), *[fill[c].alias(c) for c in FILLED], F.coalesce("_connected_on", "connected_on").alias("connected_on"), action.alias("action"))


def search_contacts(contacts: DataFrame, search: str = "", most: int | None = None) -> DataFrame:
    """Substring search over name, company and role, whatever the case, in order of name."""
    q = F.lit(search.lower())
    hit = F.contains(F.lower("name"), q) | F.contains(F.lower(F.coalesce("company", F.lit(""))), q) | F.contains(F.lower(F.coalesce("role", F.lit(""))), q)
    out = (contacts.where(hit) if search else contacts).orderBy(F.lower("name"), "name")
    return out if most is None else out.limit(most)


def match_names(names: DataFrame, contacts: DataFrame) -> DataFrame:
    """names(name) -> name, status (exact, possible, ambiguous, absent), contact, candidates.

    Exact on the normalized name first; else contacts of the same surname that could be the same name: one is possible, several are ambiguous.
    """
    own = names.select("name").distinct().withColumn("_tok", N.tokens(F.col("name"))).withColumn("norm_name", N.normalize_name(F.col("_tok")))
    c = contacts.select(F.col("name").alias("contact"), F.col("norm_name").alias("c_norm"), N.tokens(F.col("name")).alias("c_tok"))
    exact = own.join(c, F.col("norm_name") == F.col("c_norm")).groupBy("name").agg(F.min("contact").alias("exact"))
    fuzzy = own.withColumn("s", N.surname(F.col("_tok"))).join(c.withColumn("s", N.surname(F.col("c_tok"))), "s").where("s <> ''").where(N.could_be_same_name(F.col("_tok"), F.col("c_tok"))).groupBy("name").agg(F.count("*").alias("n"), F.min("contact").alias("only"))
    out = own.join(exact, "name", "left").join(fuzzy, "name", "left")
    status = F.when(F.col("exact").isNotNull(), "exact").when(F.col("n") == 1, "possible").when(F.col("n") > 1, "ambiguous").otherwise("absent")
    return out.select("name", status.alias("status"), F.coalesce("exact", F.when(F.col("n") == 1, F.col("only"))).alias("contact"), F.when(F.col("exact").isNotNull(), 1).otherwise(F.coalesce("n", F.lit(0))).cast("long").alias("candidates"))


def confirm_pairs(pairs: DataFrame, extractions: DataFrame) -> DataFrame:
    """pairs(a, b, source_url) with confirmed: an extraction of the same URL names both, either way round."""
    e = extractions.select("source_url", N.tokens(F.col("subject_name")).alias("s"), N.tokens(F.col("object_name")).alias("o"))
    p = pairs.withColumn("_a", N.tokens(F.col("a"))).withColumn("_b", N.tokens(F.col("b")))
    same = N.could_be_same_name
    hit = p.join(e, "source_url").where((same(F.col("_a"), F.col("s")) & same(F.col("_b"), F.col("o"))) | (same(F.col("_a"), F.col("o")) & same(F.col("_b"), F.col("s")))).select("a", "b", "source_url").distinct()
    return pairs.join(hit.withColumn("_hit", F.lit(True)), ["a", "b", "source_url"], "left").withColumn("confirmed", F.coalesce("_hit", F.lit(False))).drop("_hit")


def rank_frontier(scored: DataFrame, most: int, toward_famous: bool, advisory: DataFrame | None = None, pool: int = 40) -> DataFrame:
    """scored(node, recurrence) -> the best ``most`` with rank. An advisory(node, pos) reorders the pool; ids it leaves out follow in their order."""
    by = F.desc("recurrence") if toward_famous else F.asc("recurrence")
    best = scored.orderBy(by, "node").limit(max(pool, most)).withColumn("own", F.row_number().over(W.orderBy(by, "node")))  # a bounded pool
    if advisory is not None:
        best = best.join(advisory, "node", "left").withColumn("own", F.coalesce(F.col("pos") - 1_000_000, F.col("own")))
    return best.withColumn("rank", F.row_number().over(W.orderBy("own"))).where(F.col("rank") <= most).select("node", "recurrence", "rank")


def pursuable(candidates: DataFrame, most: int) -> DataFrame:
    """candidates(node, rank, reaches) in order yes, unknown, then rank; no is dropped unless nothing else is there."""
    order = F.when(F.col("reaches") == "yes", 0).when(F.col("reaches") == "no", 2).otherwise(1)
    best = candidates.withColumn("_o", order).orderBy("_o", "rank").limit(most)
    w = W.partitionBy(F.lit(1))
    return best.withColumn("_least", F.min("_o").over(w)).where("_o < 2 or _least = 2").orderBy("_o", "rank").drop("_o", "_least")
