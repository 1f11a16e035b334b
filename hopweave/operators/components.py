"""Connected components by contraction.

Each round every vertex points at its smallest neighbour (a map-side combined
minimum), the pointers are shortened by self-joins until they stop changing, and
the edges are rewritten between roots. Edges shrink geometrically, so the number
of rounds is logarithmic in the longest chain; nothing is collected but counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopweave.storage import discard, materialize


def _shorten(parents: DataFrame) -> DataFrame:
    """Pointer jumping: (node, root) such that no root points elsewhere."""
    while True:
        up = parents.select(F.col("node").alias("root"), F.col("root").alias("higher"))
        hop = parents.join(up, "root", "left").select(
            "node", F.coalesce("higher", "root").alias("root"), (F.coalesce("higher", "root") != F.col("root")).alias("moved")
        )
        hop = materialize(hop, "cc-hop")
        moved = not hop.where("moved").isEmpty()
        discard(parents)
        parents = hop.drop("moved")
        parents._scratch_path = hop._scratch_path
        if not moved:
            return parents


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every vertex of edges(a, b); component is the smallest vertex reachable.

    Nulls and self-loops are ignored, repeated edges count once, an empty table gives no rows.
    """
    edges = materialize(
        edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a is not null and b is not null and a <> b"), "cc-edges"
    )
    labels = None
    while True:
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root"))
        parents = _shorten(materialize(low, "cc-low"))
        if labels is None:
            labels, old = parents, None
        else:
            up = parents.select(F.col("node").alias("root"), F.col("root").alias("higher"))
            old, labels = labels, materialize(labels.join(up, "root", "left").select("node", F.coalesce("higher", "root").alias("root")), "cc-labels")
        pa, pb = (parents.select(F.col("node").alias(c), F.col("root").alias("r" + c)) for c in "ab")
        rest = edges.join(pa, "a").join(pb, "b").where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct()
        rest = materialize(rest, "cc-edges")
        discard(edges, *([old] if old is not None else []), *([parents] if parents is not labels else []))
        edges = rest
        if edges.isEmpty():
            discard(edges)
            return labels.select("node", F.col("root").alias("component"))
