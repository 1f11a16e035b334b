"""Evidence graph: edges, bounded search from both ends, paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hopweave.storage import discard, materialize

FINGERPRINT = ["src", "dst", "source_url", "span_start", "span_end"]


def add_edges(edges: DataFrame, mapping: DataFrame | None = None) -> DataFrame:
    """Merged ids put in, self-loops dropped, one edge (the smallest edge_id) per directional fingerprint."""
    if mapping is not None:
        for side in ("src", "dst"):
            m = mapping.select(F.col("obs_id").alias(side), F.col("node_id").alias("_to"))
            edges = edges.join(m, side, "left").withColumn(side, F.coalesce("_to", side)).drop("_to")
    w = W.partitionBy(*FINGERPRINT).orderBy("edge_id")
    return edges.where("src <> dst").withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def neighbours(edges: DataFrame) -> DataFrame:
    """(node, neighbour, edge_id) both ways."""
    e = edges.where("src <> dst")
    return e.select(F.col("src").alias("node"), F.col("dst").alias("neighbour"), "edge_id").union(e.select("dst", "src", "edge_id"))


def stored(edges: DataFrame) -> DataFrame:
    """(src, dst, edge_id) of edges in a scratch table, for several traversals of one graph."""
    return materialize(edges.where("src <> dst").select("src", "dst", "edge_id"), "bfs-edges")


def step(frontier: DataFrame, edges: DataFrame) -> DataFrame:
    """frontier(node, ...) with neighbour and edge_id: edges are met from either end as they are, not doubled and dealt anew."""
    ahead = frontier.join(edges.select(F.col("src").alias("node"), F.col("dst").alias("neighbour"), "edge_id"), "node")
    return ahead.unionByName(frontier.join(edges.select(F.col("dst").alias("node"), F.col("src").alias("neighbour"), "edge_id"), "node"))


def traverse(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(node, dist, path, edge_path) of every node within depth of seeds(node); of equal parents the smallest (parent, edge_id) wins.

    Levels are joins: the frontier meets its edges, those seen before drop out by an anti-join before the best parent of a node is chosen; paths
    travel with the nodes chosen alone. Levels are stored, so lineage stays short. Edges in a scratch table already are read from there.
    """
    own = hasattr(edges, "_scratch_path")
    edges = edges if own else stored(edges)
    kind = edges.schema["src"].dataType.simpleString()
    seen = frontier = materialize(seeds.select(F.col("node").cast(kind).alias("node"), F.lit(0).alias("dist"), F.array(F.col("node").cast(kind)).alias("path"), F.array().cast("array<" + edges.schema["edge_id"].dataType.simpleString() + ">").alias("edge_path")).distinct(), "bfs")
    for level in range(1, depth + 1):
        found = step(frontier.select("node"), edges).where("node <> neighbour").join(seen.select(F.col("node").alias("neighbour")), "neighbour", "left_anti")
        best = found.groupBy("neighbour").agg(F.min(F.struct("node", "edge_id")).alias("m")).select("neighbour", "m.node", "m.edge_id")
        frontier = materialize(best.join(frontier, "node").select(F.col("neighbour").alias("node"), F.lit(level).alias("dist"), F.concat("path", F.array("neighbour")).alias("path"), F.concat("edge_path", F.array("edge_id")).alias("edge_path")), "bfs")
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
    if not own:
        discard(edges)
    return seen


def meet(ta: DataFrame, tb: DataFrame, most: int = 15) -> DataFrame:
    """Simple paths (nodes, edges, length) through the nodes both sides reach, shortest first, one per node tuple."""
    b = tb.select("node", F.col("dist").alias("db"), F.col("path").alias("pb"), F.col("edge_path").alias("eb"))
    both = ta.join(b, "node").select("node", (F.col("dist") + F.col("db")).alias("length"), F.concat("path", F.slice(F.reverse("pb"), 2, F.greatest(F.size("pb") - 1, F.lit(0)))).alias("nodes"), F.concat("edge_path", F.reverse("eb")).alias("edges"))
    simple = both.where((F.size(F.array_distinct("nodes")) == F.size("nodes")) & (F.size("edges") > 0))
    return simple.groupBy("nodes").agg(F.min(F.struct("length", "node", "edges")).alias("m")).select("nodes", "m.*").orderBy("length", "node").limit(most)


def routes(paths: DataFrame, edges: DataFrame, nodes: DataFrame, most: int = 5, degraded: bool = True) -> DataFrame:
    """Ranked routes: inner nodes verified, weakest basis found, name-only pivots warned of (dropped when degraded)."""
    from hopweave.operators.resolve import basis_rank, pivot_basis

    hops = paths.select("nodes", "length", F.posexplode("edges").alias("hop", "edge_id")).join(edges.select("edge_id", "source_url", "resolution_basis"), "edge_id")
    w = W.partitionBy("nodes").orderBy("hop")
    hops = hops.withColumn("url_out", F.lead("source_url").over(w)).withColumn("node_id", F.try_element_at("nodes", F.col("hop") + 2)).withColumn("prev", F.col("nodes")[F.col("hop")]).withColumn("next", F.try_element_at("nodes", F.col("hop") + 3))
    own = nodes.select("node_id", "urls", "canonical_urls", "attributes", F.col("url_attributes") if "url_attributes" in nodes.columns else F.lit(None).cast("map<string,map<string,array<string>>>").alias("url_attributes"))
    for side in ("prev", "next"):
        hops = hops.join(nodes.select(F.col("node_id").alias(side), F.col("urls").alias(f"{side}_urls")), side, "left")
    hops = hops.join(own, "node_id", "left")
    on = lambda c: F.coalesce(F.try_element_at("url_attributes", F.col(c)), F.col("attributes"))
    shared = F.size(F.array_intersect(F.array_intersect("urls", "prev_urls"), "next_urls")) > 0
    basis = pivot_basis(F.col("source_url"), F.col("url_out"), shared, F.col("canonical_urls"), on("source_url"), on("url_out"))
    hops = hops.withColumn("basis", F.when(F.col("url_out").isNotNull(), basis))
    out = hops.groupBy("nodes", "length").agg(F.coalesce(F.min_by("basis", basis_rank(F.col("basis"))), F.lit("shared_page")).alias("weakest_basis"), F.sum((F.col("resolution_basis") == "structured_claim").cast("int")).alias("claim_hops"), F.transform(F.array_sort(F.collect_list(F.struct("hop", "edge_id", "source_url"))), lambda h: F.struct(h["edge_id"].alias("edge_id"), h["source_url"].alias("source_url"))).alias("hops"))
    out = out.withColumn("warning", F.when(F.col("weakest_basis") == "name_only", "a pivot rests on the name alone"))
    strong = ["shared_page", "canonical_url"]
    if degraded:
        out = out.where(F.col("weakest_basis").isin(strong))
    return out.orderBy("length", "claim_hops", F.desc(basis_rank(F.col("weakest_basis"))), "nodes").limit(most)
