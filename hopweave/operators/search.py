"""Search over an evidence graph: what to ask, whom to expand, in which order, within a budget."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hopweave import dictionaries as D
from hopweave.functions import names as N
from hopweave.functions import text as T
from hopweave.operators import graph, tables
from hopweave.storage import materialize


# --- what to ask ---------------------------------------------------------------------------------------------------
def plan_queries(nodes: DataFrame) -> DataFrame:
    """(node_id, position, template, query) of nodes(node_id, display_name, attributes, context, other, is_seed, angle).

    Seeds probe the other end directly and ask for a profile; a context adds itself, its team and its roster; colleagues are always asked
    for, then what the angle adds. A template whose place is blank is left out.
    """
    name, context, other = F.col("display_name"), F.col("context"), F.col("other")
    employer = F.try_element_at(F.array_sort(F.coalesce(F.try_element_at("attributes", F.lit("employer")), F.array().cast("array<string>"))), F.lit(1))
    angle = F.when(F.col("angle").isin(list(D.ANGLES)), F.col("angle")).otherwise("generic")
    seed = F.coalesce("is_seed", F.lit(False))

    def ask(when: Column, template: str, **places: Column) -> Column:
        text = T.render_query(template, name=name, **places)
        return F.when(when & text.isNotNull(), F.struct(F.lit(template).alias("template"), text.alias("query")))

    yes = F.lit(True)
    planned = [ask(seed, "direct_bridge", other=other), ask(yes, "context", context=context), ask(yes, "employer_team", employer=context), ask(yes, "org_roster", employer=context), ask(yes, "colleagues"), ask(seed, "profile")]
    planned += [ask(angle == a, t, employer=employer) for a, ts in D.ANGLES.items() for t in ts]
    return nodes.select("node_id", F.posexplode(F.array_compact(F.array(*planned))).alias("position", "q")).select("node_id", "position", "q.template", "q.query")


def hypothesis_queries(proposals: DataFrame, held: DataFrame, most: int) -> DataFrame:
    """(node_id, rank, query, why) of recorded proposals(node_id, position, query, why): unusable texts and ids that nobody holds go, the first stay per node."""
    clean = proposals.withColumn("query", T.sanitise_hypothesis(F.col("query"))).where("query <> ''").join(held.select("node_id").distinct(), "node_id", "left_semi")
    return clean.withColumn("rank", F.row_number().over(W.partitionBy("node_id").orderBy("position", "query"))).where(F.col("rank") <= most).select("node_id", "rank", "query", "why")


def provider_orgs(attributes: Column, most: int = 2) -> Column:
    """Organisations of two words or more to ask providers about: employers first, each in order."""
    of = lambda k: F.array_sort(F.coalesce(F.try_element_at(attributes, F.lit(k)), F.array().cast("array<string>")))
    return F.slice(F.filter(F.concat(of("employer"), of("institution")), lambda v: F.size(F.filter(F.split(v, r"\s+"), lambda w: w != "")) >= 2), 1, most)


def enrichment_people(ta: DataFrame, tb: DataFrame, nodes: DataFrame, most: int = 25) -> DataFrame:
    """(node_id, display_name, orgs) of those closest to an endpoint; one side alone is enough."""
    near = ta.select("node", F.col("dist").alias("d")).unionByName(tb.select("node", F.col("dist").alias("d"))).groupBy("node").agg(F.min("d").alias("d"))
    best = near.orderBy("d", "node").limit(most)
    return nodes.join(best, F.col("node_id") == F.col("node")).select("node_id", "display_name", provider_orgs(F.col("attributes")).alias("orgs"), F.col("d").alias("dist"))


# --- what to let in ------------------------------------------------------------------------------------------------
def connected_only(extractions: DataFrame, known: DataFrame, enabled: bool = True) -> DataFrame:
    """Extractions that touch the graph: a party could be the origin person, or its name key is in known(name_key).

    All pass while the graph is empty or where the filter is off. Keys are met by two semi-joins, not by an OR-join.
    """
    if not enabled or known.isEmpty():
        return extractions
    toks = {s: N.tokens(F.col(f"{s}_name")) for s in ("subject", "object")}
    origin = N.tokens(F.col("origin"))
    ex = extractions if "origin" in extractions.columns else extractions.withColumn("origin", F.lit(None).cast("string"))
    ex = ex.withColumn("_own", F.coalesce(F.col("origin").isNotNull() & (N.could_be_same_name(origin, toks["subject"]) | N.could_be_same_name(origin, toks["object"])), F.lit(False)))
    keys = known.select("name_key").where("name_key is not null").distinct()
    for s in ("subject", "object"):
        ex = ex.join(keys.select(F.col("name_key").alias(f"_{s}"), F.lit(True).alias(f"_has_{s}")), N.name_key(toks[s]) == F.col(f"_{s}"), "left")
    return ex.where(F.col("_own") | F.col("_has_subject").isNotNull() | F.col("_has_object").isNotNull()).select(*extractions.columns)


def replay(relations: DataFrame, people: DataFrame, as_of: Column, ttl_seconds: int = 30 * 86400) -> DataFrame:
    """Observation rows (eid, side, name, url, span_text, span_start, span_end, provenance_name) of stored relations of people(name): each relation twice,
    once per end, to be resolved anew by the job; rows that break the invariants of an extraction are left out."""
    keys = people.select(F.col("name").alias("person"), N.name_key(N.tokens(F.col("name"))).alias("name_key"))
    fresh = tables.lookup_relations(relations, keys, as_of, ttl_seconds)
    both = fresh.where((F.col("span_end") > F.col("span_start")) & (F.col("span_end") - F.col("span_start") == F.length("span_text")) & (N.fold(F.trim("subject_name")) != N.fold(F.trim("object_name")))).withColumnRenamed("person", "provenance_name")
    eid = F.xxhash64(*tables.UNIQUE)
    ends = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"{s}_name").alias("name")) for s in ("subject", "object")]))
    return both.select("*", eid.alias("eid"), ends.alias("end")).select("eid", "end.side", "end.name", F.col("source_url").alias("url"), "span_text", "span_start", "span_end", "provenance_name")


RECORDED = "extractions array<struct<subject_name:string,object_name:string,sentence_index:int,span_text:string,context_before:string,resolved_statement:string,resolution_basis:string,subject_attributes:array<string>,object_attributes:array<string>>>, co_listings array<struct<affiliation:string,affiliation_kind:string,context_sentence_index:int,context_text:string,members:array<struct<name:string,sentence_index:int,span_text:string,role:string>>>>"


def recorded_answers(chunks: DataFrame, responses: DataFrame, version: str, model: str) -> tuple[DataFrame, DataFrame]:
    """(raw extractions, raw rosters) of chunks(page_id, text_sha256, chunk_lead) from responses(cache_key, json); chunks without a readable answer give none."""
    key = F.concat_ws("|", F.lit(version), F.lit(model), "text_sha256", F.col("chunk_lead").cast("string"))
    found = chunks.withColumn("cache_key", key).join(responses, "cache_key").withColumn("_v", T.tolerant_json(F.col("json"))).where("_v is not null")
    got = found.select("page_id", F.from_json(F.to_json("_v"), RECORDED).alias("a"))
    raw = got.select("page_id", F.explode("a.extractions").alias("e")).select("page_id", "e.*")
    rosters = got.select("page_id", F.posexplode("a.co_listings").alias("roster_id", "r")).select("page_id", "roster_id", "r.*")
    return raw, rosters


# --- whom to expand ------------------------------------------------------------------------------------------------
def staged_budget(credits_left: Column, nodes_left: Column, parents: Column, pursue: Column, bridges: int = 3) -> Column:
    """struct(parents, pursue) that what is left can pay for: the origin comes first, then parents, pursuit gets the rest."""
    cost = 2 + max(0, bridges)
    affordable = F.least(F.floor(F.greatest(credits_left, F.lit(0)) / cost), F.greatest(nodes_left, F.lit(0)))
    spare = F.greatest(affordable - 1, F.lit(0))
    got = F.when(affordable >= 1 + parents + pursue, parents).otherwise(F.least(parents, spare)).cast("long")
    return F.struct(got.alias("parents"), F.when(affordable >= 1 + parents + pursue, pursue).otherwise(F.least(pursue, spare - got)).cast("long").alias("pursue"))


def surfaced_by(edges: DataFrame, parents: DataFrame, held: DataFrame) -> DataFrame:
    """(parent, node) of the neighbours of parents(node) that nobody holds."""
    near = graph.step(F.broadcast(parents.select("node")), edges).where("node <> neighbour").select(F.col("node").alias("parent"), F.col("neighbour").alias("node")).distinct()
    return near.join(held.select("node"), "node", "left_anti").select("parent", "node")


def _scored(rows: DataFrame, scores: DataFrame | Callable[[DataFrame], DataFrame], kind: str) -> DataFrame:
    """rows with the recurrence of their node; scores that are a function are asked for the nodes of the rows alone."""
    if callable(scores):
        rows = materialize(rows, "search-rows")
        scores = scores(rows.select("node").distinct())
    return rows.join(scores.select(F.col("node").cast(kind).alias("node"), "recurrence"), "node", "left").fillna(0, ["recurrence"])


def staged_search(edges: DataFrame, scores: DataFrame | Callable[[DataFrame], DataFrame], origin, target, verdicts: DataFrame | None = None, toward_famous: bool = False, cap: int = 12, per_parent: int = 12, pursue: int = 12) -> DataFrame:
    """(tier, rank, parent, node, recurrence, reaches) of everyone held: the origin's best, the best of each of those, and what the pursued among them lead to.

    edges(src, dst, edge_id), scores(node, recurrence) or a function that gives these for some nodes, verdicts(node, answer). A parent does not get whom an earlier parent holds: parent number i can lose
    ``per_parent`` nodes to each earlier one, so its best ``per_parent * i`` settle the matter and only these, a number that parameters bound, are weighed
    on the driver. Parents are broadcast: there are ``cap`` of them.
    """
    spark = edges.sparkSession
    edges = edges if hasattr(edges, "_scratch_path") else graph.stored(edges)
    kind = edges.schema["src"].dataType.simpleString()
    ids = lambda xs: spark.createDataFrame([(x,) for x in xs], f"node {kind}")
    sign = -1 if toward_famous else 1
    scored = lambda df: _scored(df, scores, kind)
    best = lambda df, most: [(r.node, r.recurrence) for r in tables.rank_frontier(scored(df), most, toward_famous, pool=most).orderBy("rank").collect()]

    tier0 = best(surfaced_by(edges, ids([origin]), ids([origin, target])), cap)
    held = {origin, target} | {n for n, _ in tier0}
    order = [n for n, _ in tier0]
    tier1: list[tuple] = []
    if order:
        near = scored(surfaced_by(edges, ids(order), ids(held)))
        place = spark.createDataFrame(list(enumerate(order, 1)), f"i int, parent {kind}")
        near = near.join(F.broadcast(place), "parent").withColumn("k", F.row_number().over(W.partitionBy("parent").orderBy(F.col("recurrence") * sign, "node"))).where(F.col("k") <= F.col("i") * per_parent)
        left: dict = {}
        for r in near.orderBy("i", "k").collect():  # cap * (cap + 1) / 2 * per_parent rows at most
            if r.node not in held and left.setdefault(r.parent, per_parent):
                left[r.parent] -= 1
                held.add(r.node)
                tier1.append((r.parent, r.node, r.recurrence))
    answers: dict = {}
    if verdicts is not None and tier1:
        mine = ids([n for _, n, _ in tier1])
        answers = {r.node: r.answer for r in verdicts.join(F.broadcast(mine), "node", "left_semi").select("node", T.verdict(F.col("answer")).alias("answer")).groupBy("node").agg(F.min("answer").alias("answer")).collect()}
    rank1 = [(i, p, n, s, answers.get(n, "unknown")) for i, (p, n, s) in enumerate(tier1, 1)]
    pursued = []
    if rank1:
        cand = spark.createDataFrame([(n, i, a) for i, _, n, _, a in rank1], f"node {kind}, rank int, reaches string")
        pursued = [r.node for r in tables.pursuable(cand, pursue).collect()]
    tier2 = best(surfaced_by(edges, ids(pursued), ids(held)).select("node").distinct(), cap) if pursued else []
    rows = [(0, i, origin, n, s, None) for i, (n, s) in enumerate(tier0, 1)] + [(1, i, p, n, s, a) for i, p, n, s, a in rank1] + [(2, i, None, n, s, None) for i, (n, s) in enumerate(tier2, 1)]
    return spark.createDataFrame(rows, f"tier int, rank int, parent {kind}, node {kind}, recurrence long, reaches string")


def bidirectional_search(edges: DataFrame, scores: DataFrame | Callable[[DataFrame], DataFrame], a, b, depth_a: int = 2, depth_b: int = 1, cap: int = 12, famous_a: bool = False, famous_b: bool = False) -> tuple[DataFrame, DataFrame]:
    """(expanded, known edges): both ends are expanded level by level, a node's edges become known when it is expanded, and one level more follows the first meeting.

    Each side's frontier is ranked toward the other end's fame and capped. expanded(node, level, side).
    """
    spark = edges.sparkSession
    edges = edges if hasattr(edges, "_scratch_path") else materialize(edges.select("edge_id", "src", "dst"), "search-edges")
    kind = edges.schema["src"].dataType.simpleString()
    ids = lambda xs: spark.createDataFrame([(x,) for x in xs], f"node {kind}")
    incident = lambda xs: edges.join(F.broadcast(ids(xs)), F.col("src") == F.col("node"), "left_semi").union(edges.join(F.broadcast(ids(xs)), F.col("dst") == F.col("node"), "left_semi")).distinct()
    done: dict = {}
    known = materialize(incident([a, b]).limit(0), "search-known")
    allowed, level, met = max(depth_a, depth_b), 0, False
    while level < allowed:
        front = []
        for seed, depth, side, famous in ((a, depth_a, "a", famous_b), (b, depth_b, "b", famous_a)):
            if level < depth:
                at = _scored(graph.traverse(known, ids([seed]), level).where(F.col("dist") == level).select("node"), scores, kind)
                front += [(r.node, side) for r in tables.rank_frontier(at, cap, famous, pool=cap).orderBy("rank").collect() if r.node not in done]
        front = list({n: (n, s) for n, s in reversed(front)}.values())[::-1]
        if not front:
            break
        done |= {n: (level, s) for n, s in front}
        known = materialize(incident(list(done)), "search-known")
        ta, tb = (graph.traverse(known, ids([x]), d + 2) for x, d in ((a, depth_a), (b, depth_b)))
        if not met and not ta.join(tb.select("node"), "node", "left_semi").isEmpty():
            met, allowed = True, min(allowed, level + 2)
        level += 1
    return spark.createDataFrame([(n, lv, s) for n, (lv, s) in done.items()], f"node {kind}, level int, side string"), known


def number_across(candidates: DataFrame) -> DataFrame:
    """candidates(parent_rank, rank) numbered through all parents. A tier is a bounded worklist."""
    return candidates.withColumn("number", F.row_number().over(W.orderBy("parent_rank", "rank")))


def preview_changed(now: DataFrame, before: DataFrame) -> bool:
    """Whether a set of routes(nodes) differs from the one published before."""
    key = lambda df: df.select(F.to_json("nodes").alias("k"))
    return not key(now).exceptAll(key(before)).isEmpty() or not key(before).exceptAll(key(now)).isEmpty()


