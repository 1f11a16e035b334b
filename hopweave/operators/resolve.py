"""Entity resolution: the merge ladder over blocked pairs, then components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hopweave import dictionaries as D
from hopweave.functions import attrs as A
from hopweave.functions import names as N
from hopweave.operators.components import connected_components
from hopweave.storage import materialize


#: Kinds of one name that meet others of it in one task.
PART = 256
#: Rows of one name that meet others of it in one task.
ROWS = 2048
#: What two kinds of rows are to each other, short of URLs and pages.
APART, CONFLICT, NEIGHBOURS, COMMON, RARE, STRANGE = range(6)


def ladder(conflicts: Column, matches: Column, same_canonical: Column, same_url: Column, provenance: Column, clusters: Column, shares_neighbour: Column, verdict: Column, threshold: int = 3) -> Column:
    """struct(basis, allowed) of what is known about two observations of a name. Rungs in order."""
    ok = ~conflicts & matches
    vetoed = F.coalesce(verdict, F.lit("unknown")) == "no"
    step = lambda basis, allowed: F.struct(F.lit(basis).alias("basis"), allowed.alias("allowed"))
    return (
        F.when(same_canonical, step("same_canonical_url", F.lit(True)))
        .when(conflicts, step("conflicting_attributes", F.lit(False)))
        .when(same_url, step("single_referent_co_occurrence", F.lit(True)))
        .when(provenance, step("search_provenance", F.lit(True)))
        .when(ok & shares_neighbour, step("attributes_plus_shared_neighbor", ~vetoed))
        .when(ok & (clusters >= threshold), step("name_too_common", F.lit(False)))
        .when(ok, step("rare_name_attributes", ~vetoed))
        .otherwise(step("name_string_only", F.lit(False)))
    )


def clusters(own: DataFrame, threshold: int = 3) -> DataFrame:
    """(block, clusters) of own(block, obs_id, p): how many mutually inconsistent readings a name has, met in the order of obs_id, counted up to threshold.

    A reading is one more where it contradicts all that were counted before. Equal attribute sets are one, so a hot block holds its different sets only.
    """
    only = F.struct(*[F.col(f"p.only_{k}").alias(f"only_{k}") for k in D.EXCLUSIVE_KEYS])
    sets = own.select("block", "obs_id", only.alias("s")).groupBy("block", "s").agg(F.min("obs_id").alias("first"))
    found = sets.groupBy("block").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "s"))), lambda x: x["s"]).alias("sets"))
    none = F.slice(F.col("sets"), 1, 0)
    grown = F.aggregate("sets", none, lambda kept, x: F.when((F.size(kept) < threshold) & F.forall(kept, lambda c: A.prepared_conflict(c, x)), F.concat(kept, F.array(x))).otherwise(kept))
    return found.select("block", F.greatest(F.size(grown), F.lit(1)).alias("clusters"))


def _own(obs: DataFrame, block: Column | None = None) -> DataFrame:
    """(obs_id, block, n, url, p, canon, prov, orgs): what observations are compared by, once a row, stored."""
    toks = N.tokens(F.col("name"))
    orgs = F.col("neighbour_orgs") if "neighbour_orgs" in obs.columns else F.array().cast("array<string>")
    tasks = int(obs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Names and attributes take long to prepare: rows are spread first, whatever files they come in.
    own = obs.repartition(tasks, "obs_id").select("obs_id", "url", toks.alias("_t"), N.tokens(F.col("provenance_name")).alias("_pt"), A.prepared(F.col("attributes")).alias("p"), F.col("canonical_urls").alias("canon"), A.compacts(orgs).alias("orgs"), (block if block is not None else F.lit(None).cast("string")).alias("_b"))
    own = own.withColumns({"_g": N.given(F.col("_t")), "_s": N.surname(F.col("_t")), "_pg": N.given(F.col("_pt")), "_ps": N.surname(F.col("_pt"))})
    own = own.withColumns({"n": N.prepared(F.col("_t"), F.col("_g"), F.col("_s")), "prov": N.prepared(F.col("_pt"), F.col("_pg"), F.col("_ps")), "block": F.coalesce("_b", N.name_key(F.col("_t")))}).select("obs_id", "block", "n", "url", "p", "canon", "prov", "orgs").where("block <> ''")
    return materialize(own, "observations")


def decisions(obs: DataFrame, block: Column | None = None, threshold: int = 3, verdicts: DataFrame | None = None) -> DataFrame:
    """(left_id, right_id, basis, allowed) of observation pairs that share a block and could share a name.

    obs(obs_id, name, url, attributes map, canonical_urls array, provenance_name, [neighbour_orgs array]). The block is the name
    key. verdicts(left_id, right_id, verdict), ids in
    order, holds what a judge said; "no" forbids a merge on attributes.

    Rows of a name with equal names, attributes and neighbours are one kind. These are compared once for two kinds; two rows look the outcome up
    by number and compare what is left, URLs and pages.
    """
    own = _own(obs, block)  # read for the kinds, for the rows and for the readings of a name
    tasks = int(obs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # A name's kinds are dealt in groups of PART and numbered there.
    alike = ["block", "n", "p", "orgs"]
    kinds = own.groupBy(*alike).agg(F.min("obs_id").alias("first"), F.max("obs_id").alias("last"))
    groups = kinds.groupBy("block").agg(F.ceil(F.count("*") / PART).cast("int").alias("groups"))
    kinds = kinds.join(groups, "block").join(clusters(own, threshold), "block").withColumn("group", F.pmod(F.xxhash64("n", "p", "orgs"), F.col("groups")).cast("int"))
    kinds = materialize(kinds.withColumn("kind", F.row_number().over(W.partitionBy("block", "group").orderBy("first")) - 1), "kinds")

    # What two kinds are to each other, for two groups: a list per kind on the left, with a code per kind on the right.
    other, side = F.explode(F.expr("sequence(0, groups - 1)")), F.struct("kind", "first", "last", "n", "p", "orgs", "clusters")
    pair = ["block", "lg", "rg"]
    left = kinds.select("block", F.col("group").alias("lg"), other.alias("rg"), side.alias("l"))
    right = kinds.select("block", other.alias("lg"), F.col("group").alias("rg"), side.alias("r"))
    # Few bytes make many pairs: the number of tasks is that of the setting, not one by the size of the rows.
    met = left.repartition(tasks, *pair).join(right.repartition(tasks, *pair).hint("merge"), pair)
    near = A.near(F.col("l.orgs"), F.concat(F.col("r.p.employer"), F.col("r.p.institution")))
    agree = F.when(~A.prepared_match(F.col("l.p"), F.col("r.p")), STRANGE).when(near, NEIGHBOURS).when(F.col("l.clusters") >= threshold, COMMON).otherwise(RARE)
    apart = ~F.coalesce((F.col("l.first") < F.col("r.last")) & N.prepared_same_name(F.col("l.n"), F.col("r.n")), F.lit(False))
    code = F.when(apart, APART).when(A.prepared_conflict(F.col("l.p"), F.col("r.p")), CONFLICT).otherwise(agree).cast("byte")
    listed = lambda k, v: F.transform(F.array_sort(F.collect_list(F.struct(F.col(k).alias("k"), F.col(v).alias("v")))), lambda x: x["v"]).alias(v)
    codes = met.select(*pair, F.col("l.kind").alias("lk"), F.col("r.kind").alias("rk"), code.alias("codes")).groupBy(*pair, "lk").agg(listed("rk", "codes")).groupBy(*pair).agg(listed("lk", "codes"))
    codes = materialize(codes, "kind-codes")

    # Rows of a group are dealt in parts of ROWS; a task has two parts and the codes of their groups at a time.
    sought = F.coalesce(N.prepared_same_name(F.col("prov"), F.col("n")), F.lit(False)).alias("sought")
    named = kinds.select("group", "kind", *[F.col(c).alias(f"_{c}") for c in alike])
    rows = own.select("obs_id", "url", "canon", sought, *alike).join(named, F.expr(" and ".join(f"{c} <=> _{c}" for c in alike))).select("obs_id", "block", "url", "canon", "sought", "group", "kind")
    rows = materialize(rows, "kinds-of-rows")
    counts = rows.groupBy("block", "group").agg(F.ceil(F.count("*") / ROWS).cast("int").alias("parts"))
    each = counts.select("block", "group", F.explode(F.expr("sequence(0, parts - 1)")).alias("part"))
    dealt = rows.join(counts, ["block", "group"]).withColumn("part", F.pmod(F.xxhash64("obs_id"), F.col("parts")).cast("int"))
    dealt = dealt.join(each.groupBy("block").agg(F.collect_list(F.struct("group", "part")).alias("all")), "block").withColumn("other", F.explode("all"))
    tile = ["block", "lg", "lp", "rg", "rp"]
    place = lambda l, r: [F.col("block"), *[F.col(x).alias(y) for x, y in zip((*l, *r), tile[1:])]]
    at, there = ("group", "part"), ("other.group", "other.part")
    left = dealt.select(*place(at, there), F.col("obs_id").alias("left_id"), F.col("kind").alias("lk"), F.col("url").alias("l_url"), F.col("canon").alias("l_canon"))
    right = dealt.select(*place(there, at), F.col("obs_id").alias("right_id"), F.col("kind").alias("rk"), F.col("url").alias("r_url"), F.col("canon").alias("r_canon"), "sought")
    parts = lambda g, p: each.select("block", F.col("group").alias(g), F.col("part").alias(p))
    codes = codes.join(parts("lg", "lp"), ["block", "lg"]).join(parts("rg", "rp"), ["block", "rg"]).select(*tile, "codes")
    left = left.repartition(tasks, *tile).join(codes.repartition(tasks, *tile).hint("merge"), tile).select(*tile, "left_id", "l_url", "l_canon", F.col("codes")[F.col("lk")].alias("codes"))
    pairs = left.join(right.repartition(tasks, *tile).hint("merge"), tile).where("left_id < right_id").withColumn("code", F.col("codes")[F.col("rk")]).where(F.col("code") != APART)
    said = F.lit(None).cast("string")
    if verdicts is not None:
        said = F.col("verdict")
        pairs = pairs.join(verdicts.select("left_id", "right_id", "verdict"), ["left_id", "right_id"], "left")
    same_canonical, is_code = F.coalesce(F.arrays_overlap("l_canon", "r_canon"), F.lit(False)), lambda *c: F.col("code").isin(*c)
    d = ladder(is_code(CONFLICT), is_code(NEIGHBOURS, COMMON, RARE), same_canonical, F.col("l_url") == F.col("r_url"), F.col("sought"), F.when(is_code(COMMON), threshold).otherwise(threshold - 1), is_code(NEIGHBOURS), said, threshold)
    return pairs.select("left_id", "right_id", d.alias("d")).select("left_id", "right_id", "d.*")


def _links(obs: DataFrame, threshold: int, verdicts: DataFrame | None) -> DataFrame:
    """(a, b): allowed pairs, few of them, with the components of all that ``decisions`` allows.

    Rows of a name with equal names, attributes and neighbours are one kind, and the rungs that do not look at URLs decide for kinds. Where they
    allow an earlier row of kind L and a later one of kind R, each row of L before the last of R is tied to that last, each row of R after the
    first of L to that first, and these two to each other: every allowed pair lies on such ties, and every tie is an allowed pair. URLs tie the
    rows of a kind to the first with that URL, and the firsts of kinds that go together. Rows that a verdict names are kinds of their own.
    """
    own = _own(obs)
    tasks = int(obs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sought = F.coalesce(N.prepared_same_name(F.col("prov"), F.col("n")), F.lit(False)).alias("sought")
    alone = F.lit(None).cast("long")
    if verdicts is not None:
        no = verdicts.where("verdict = 'no'").select(F.col("left_id").cast("long").alias("left_id"), F.col("right_id").cast("long").alias("right_id")).distinct()
        judged = no.select(F.explode(F.array("left_id", "right_id")).alias("obs_id")).distinct().withColumn("alone", F.col("obs_id"))
        own = own.join(judged, "obs_id", "left")
        alone = F.col("alone")
    own = own.select("obs_id", "block", "n", "url", "p", "canon", "orgs", sought, alone.alias("alone"))
    alike = ["block", "n", "p", "orgs", "sought", "alone"]
    kinds = own.groupBy(*alike).agg(F.min("obs_id").alias("first"), F.max("obs_id").alias("last"))
    only = [F.col(f"p.only_{k}") for k in D.EXCLUSIVE_KEYS]
    kinds = materialize(kinds.withColumn("class", F.min("first").over(W.partitionBy("block", "n", *only))).withColumn("name", F.min("first").over(W.partitionBy("block", "n"))), "kinds")
    small = own.join(kinds.select(F.col("first").alias("kind"), "class", "name", *[F.col(c).alias(f"_{c}") for c in alike]), F.expr(" and ".join(f"{c} <=> _{c}" for c in alike))).select("obs_id", "kind", "class", "name", "block", "url", "canon")
    rows = materialize(small, "kinds-of-rows")

    # Kinds that go together; a name with many kinds is dealt in parts, as in ``decisions``.
    dealt = kinds.join(kinds.groupBy("block").agg(F.ceil(F.count("*") / PART).cast("long").alias("parts")), "block")
    side = F.struct("first", "last", "class", "n", "p", "orgs", "sought", "alone")
    left = dealt.withColumn("part", F.pmod(F.xxhash64("first"), F.col("parts"))).select("block", "part", side.alias("l")).repartition(tasks, "block", "part")
    right = dealt.withColumn("part", F.explode(F.expr("sequence(0L, parts - 1)"))).select("block", "part", side.alias("r")).repartition(tasks, "block", "part")
    met = left.join(right.hint("merge"), ["block", "part"]).where(N.prepared_same_name(F.col("l.n"), F.col("r.n")))
    met = met.join(clusters(own, threshold), "block")
    conflict, match = A.prepared_conflict(F.col("l.p"), F.col("r.p")), A.prepared_match(F.col("l.p"), F.col("r.p"))
    near = A.near(F.col("l.orgs"), F.concat(F.col("r.p.employer"), F.col("r.p.institution")))
    none = F.lit(False)
    rung = ladder(F.col("conflict"), F.col("match"), none, none, F.col("r.sought"), F.col("clusters"), F.col("near"), F.col("verdict"), threshold)
    met = met.withColumns({"conflict": conflict, "match": match, "near": near})
    if verdicts is not None:
        met = met.join(no, (F.col("l.alone") == F.col("left_id")) & (F.col("r.alone") == F.col("right_id")), "left").withColumn("verdict", F.when(F.col("left_id").isNotNull(), "no"))
    else:
        met = met.withColumn("verdict", F.lit(None).cast("string"))
    pairs = met.select(F.col("l.first").alias("l"), F.col("r.first").alias("r"), F.col("r.last").alias("last"), F.col("l.class").alias("cl"), F.col("r.class").alias("cr"), "conflict", (rung["allowed"] & (F.col("l.first") < F.col("r.last"))).alias("allowed"))
    pairs = materialize(pairs.where("allowed or (not conflict and cl < cr)"), "kind-pairs")
    allowed = pairs.where("allowed")
    before = rows.join(allowed.groupBy(F.col("l").alias("kind")).agg(F.max("last").alias("b")), "kind").where("obs_id < b").select(F.col("obs_id").alias("a"), "b")
    after = rows.join(allowed.groupBy(F.col("r").alias("kind")).agg(F.min("l").alias("a")), "kind").where("obs_id > a").select("a", F.col("obs_id").alias("b"))
    ties = [before, after, allowed.select(F.col("l").alias("a"), F.col("last").alias("b"))]

    # URLs and canonical pages: what one class (name and employers) or name has there is tied to its first there, and the firsts of those that go together.
    names = kinds.groupBy("block", "name").agg(F.first("n").alias("n"))
    same = names.select("block", F.col("name").alias("x"), F.col("n").alias("_x")).join(names.select("block", F.col("name").alias("y"), F.col("n").alias("_y")), "block").where("x < y").where(N.prepared_same_name(F.col("_x"), F.col("_y"))).select("x", "y")
    agree = pairs.where("not conflict and cl < cr").select(F.col("cl").alias("x"), F.col("cr").alias("y")).distinct()
    at_url = rows.where("url is not null").select("obs_id", F.col("class").alias("of"), "block", F.col("url").alias("at"))
    at_page = rows.select("obs_id", F.col("name").alias("of"), "block", F.explode("canon").alias("at")).where("at is not null")
    for at, fit in ((at_url, agree), (at_page, same)):
        there = materialize(at.groupBy("block", "at", "of").agg(F.min("obs_id").alias("first")), "kinds-at")
        ties.append(at.join(there, ["block", "at", "of"]).where("obs_id > first").select(F.col("first").alias("a"), F.col("obs_id").alias("b")))
        # Each pair is looked for from the side that goes together with fewer others.
        fit = materialize(fit, "kinds-fit")
        both = fit.union(fit.select("y", "x"))
        many = both.groupBy("x").agg(F.count("*").alias("many"))
        ways = both.join(many, "x").join(many.select(F.col("x").alias("y"), F.col("many").alias("theirs")), "y").where("many < theirs or (many = theirs and x < y)").select(F.col("x").alias("of"), F.col("y").alias("to"))
        ahead = there.join(ways, "of").select("block", "at", F.col("to").alias("of"), F.col("first").alias("a"))
        ties.append(ahead.join(there, ["block", "at", "of"]).select(F.least("a", "first").alias("a"), F.greatest("a", "first").alias("b")))
    out = ties[0]
    for t in ties[1:]:
        out = out.union(t)
    return out


def resolve(obs: DataFrame, threshold: int = 3, verdicts: DataFrame | None = None) -> DataFrame:
    """(obs_id, node_id): components of the allowed pairs; obs_id is a long and node_id the smallest of its node."""
    comps = connected_components(_links(obs, threshold, verdicts))
    return obs.select("obs_id").join(comps.select(F.col("node").alias("obs_id"), "component"), "obs_id", "left").select("obs_id", F.coalesce("component", "obs_id").alias("node_id"))


def nodes(obs: DataFrame, mapping: DataFrame) -> DataFrame:
    """Per node: display name (of its first observation), variants, urls, canonical urls, distinct sources and attributes united by key."""
    own = obs.join(mapping, "obs_id")
    base = own.groupBy("node_id").agg(F.min_by("name", "obs_id").alias("display_name"), F.array_sort(F.collect_set("name")).alias("name_variants"), F.array_sort(F.collect_set("url")).alias("urls"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("canonical_urls", F.array().cast("array<string>")))))).alias("canonical_urls"), F.countDistinct("url").alias("recurrence"))
    values = own.select("node_id", F.explode("attributes").alias("key", "vs")).select("node_id", "key", F.explode("vs").alias("v")).groupBy("node_id", "key").agg(F.array_sort(F.collect_set("v")).alias("vs"))
    return base.join(values.groupBy("node_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "vs"))).alias("attributes")), "node_id", "left")


def pivot_basis(url_in: Column, url_out: Column, shared_page: Column, canonical: Column, attrs_in: Column, attrs_out: Column, verdict: Column | None = None) -> Column:
    """What identifies a route's inner person, in order of precedence."""
    yes = F.coalesce(verdict, F.lit("unknown")) == "yes" if verdict is not None else F.lit(False)
    both = F.coalesce(F.array_contains(canonical, url_in) & F.array_contains(canonical, url_out), F.lit(False))
    return F.when((url_in == url_out) | F.coalesce(shared_page, F.lit(False)), "shared_page").when(both, "canonical_url").when((F.size(A.matching_keys(attrs_in, attrs_out)) > 0) | yes, "attribute_match").otherwise("name_only")


def basis_rank(basis: Column) -> Column:
    out = F.lit(0)
    for k, v in D.BASIS_STRENGTH.items():
        out = F.when(basis == k, v).otherwise(out)
    return out
