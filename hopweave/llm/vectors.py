"""Embedding near-duplicates by collision-counting projections.

Vectors are compared on the unit sphere. A pair with cosine at least t is at most
``r = sqrt(2 - 2t)`` apart, so along a Gaussian direction its coordinates differ by
a normal variable of deviation r at most. Many one-dimensional projections are
cut at fixed steps with a random shift (a grid; nothing is sorted) and
taken in groups of g; two vectors meet where all g ranges of a group agree. The number
of groups follows from g so that a pair at the limit meets with ``1 - MISS``. Of vectors that meet, collisions in
windows centred on each of the two are counted over COUNTED projections, pairs
with a count that a pair at the limit reaches with ``1 - MISS`` are verified by cosine.

g grows with the logarithm of the largest label, so that strangers rarely meet.
Equal vectors are one vector with a weight. Cells of many near copies are cut into tiles,
each pair of tiles is a unit; a pair counts in the first group where it meets, so links are summed, not listed.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopweave.llm._bytes import U64, batch_rows, mix
from hopweave.llm._units import over_units
from hopweave.operators.components import connected_components
from hopweave.storage import discard, materialize

RANGE, MISS, COUNTED, TILE = 1.0, 1e-5, 32, 256


def _phi(x: float) -> float:
    return 0.5 * (1 + math.erf(x / math.sqrt(2)))


def usable(embedding: str) -> F.Column:
    """Not null, finite components only, not zero."""
    ok = F.forall(F.col(embedding), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(embedding).isNotNull() & ok & F.exists(F.col(embedding), lambda x: x != 0), F.lit(False))


def as_given(table: DataFrame, column: str) -> str:
    """The array type in which a column's numbers keep their precision: double where they are doubles, else float."""
    kind = table.schema[column].dataType.simpleString()
    return "array<float>" if kind in ("array<float>", "array<tinyint>", "array<smallint>") else "array<double>"


def calibrate(threshold: float, largest: int) -> tuple[int, int, float, int]:
    """g, number of groups, window half-width and least count."""
    r = math.sqrt(max(2 - 2 * threshold, 1e-12))
    strangers = (2 * _phi(RANGE / 2 / math.sqrt(2)) - 1) * 0.98  # two independent unit-normal coordinates share a range
    g = max(1, math.ceil(math.log(max(2 * largest, 2)) / -math.log(strangers)))
    same = max(0.05, 1 - r * math.sqrt(2 / math.pi) / RANGE)
    groups = max(1, math.ceil(math.log(MISS) / math.log(1 - same**g)))
    window = 2.5 * r
    p, least, missed = 2 * _phi(2.5) - 1, 0, 0.0
    while least < COUNTED and missed + math.comb(COUNTED, least) * p**least * (1 - p) ** (COUNTED - least) <= MISS:
        missed += math.comb(COUNTED, least) * p**least * (1 - p) ** (COUNTED - least)
        least += 1
    return g, groups, window, least


def cells(vectors: np.ndarray, labels: np.ndarray, g: int, groups: int) -> np.ndarray:
    """The (rows, groups) hashed cells of unit vectors."""
    d = vectors.shape[1]
    rng = np.random.default_rng([2025, d])
    a, shift = rng.standard_normal((d, g * groups)), rng.random(g * groups) * RANGE
    at = np.floor((vectors @ a + shift) / RANGE).astype(np.int64).reshape(len(vectors), groups, g)
    h = np.broadcast_to((mix(labels.astype(np.int64).view(U64)) + U64(d))[:, None], (len(vectors), groups)) + np.arange(groups).astype(U64)
    for k in range(g):
        h = mix(h * U64(0xD1342543DE82EF95) + at[:, :, k].view(U64))
    return h.view(np.int64)


def embedding_links(table: DataFrame, threshold: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of table(vec_id, embedding, label).

    Vectors link when their labels are equal and not null, their lengths equal and their cosine, in double precision,
    at least threshold. Vectors that are null, zero or hold null or non-finite components link with nothing, nor do rows with a null vec_id
    (component_id null, kept true). Rows that repeat a vec_id are vectors of their own with one component. n_links counts the other
    vectors linked directly; component_id is the smallest vec_id reachable. Other columns are ignored; an empty table gives no rows.
    """
    batch_rows(table.sparkSession, 10_000)
    kind = as_given(table, "embedding")
    table = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"), F.col("label").cast("long").alias("label"))
    ok = table.where(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & usable("embedding"))
    classes = materialize(ok.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight")), "vec-classes")
    # A vec_id on different vectors is one vertex of the links: their classes are joined below.
    classes = classes.withColumn("id", F.col("rep"))
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 1
    g, groups, window, least = calibrate(threshold, largest)

    def post(batches):
        for batch in batches:
            out = [None] * batch.num_rows
            raw = batch["embedding"]
            n = np.diff(raw.offsets.to_numpy())
            labels = batch["label"].to_numpy()
            off, flat = raw.offsets.to_numpy(), raw.values.to_numpy()
            for d in np.unique(n):
                i = np.flatnonzero(n == d)
                x = flat[off[i][:, None] + np.arange(d)].astype(float)
                c = cells(x / np.linalg.norm(x, axis=1, keepdims=True), labels[i], g, groups)
                for k, row in zip(i, c):
                    out[k] = row
            yield pa.RecordBatch.from_arrays([batch["rep"], batch["label"], batch["weight"], raw, pa.array(out, pa.list_(pa.int64()))], ["id", "label", "weight", "embedding", "cells"])

    posted = materialize(classes.select("rep", "label", "weight", "embedding").mapInArrow(post, f"id long, label long, weight long, embedding {kind}, cells array<long>").withColumn("row", F.xxhash64("id", "label", "embedding")), "vec-posted")
    postings = posted.select("row", F.posexplode("cells").alias("t", "cell"))
    met = postings.groupBy("cell").agg(F.count("*").alias("k")).where("k > 1").select("cell", F.ceil(F.col("k") / TILE).alias("tiles"))
    tiled = postings.join(materialize(met, "vec-met"), "cell").withColumn("b", F.expr("pmod(xxhash64(row), tiles)"))
    tiled = tiled.withColumn("o", F.explode(F.expr("sequence(0L, tiles - 1)"))).select(F.col("cell").alias("unit"), F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "b", F.col("t").cast("long").alias("t"), "row")
    rows = tiled.join(posted, "row").select("unit", "i", "j", "b", "t", "id", "label", "weight", "embedding", "cells")

    def unit(tab: pa.Table) -> pa.RecordBatch | None:
        if tab.num_rows < 2:
            return None
        tab = tab.combine_chunks()
        emb = tab["embedding"].chunk(0)
        length = np.diff(emb.offsets.to_numpy())
        if (length != length[0]).any():  # only where two hashes collide
            parts = [unit(tab.filter(pa.array(length == n))) for n in np.unique(length)]
            parts = [p for p in parts if p is not None]
            return pa.Table.from_batches(parts).combine_chunks().to_batches()[0] if parts else None
        x = emb.flatten().to_numpy().reshape(tab.num_rows, -1).astype(float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        ids, weight, b, label = (tab[c].to_numpy() for c in ("id", "weight", "b", "label"))
        i, j, t = (tab[c][0].as_py() for c in "ijt")
        one, two = (np.arange(len(x)),) * 2 if i == j else (np.flatnonzero(b == i), np.flatnonzero(b == j))
        if not len(one) or not len(two):
            return None
        p = x @ np.random.default_rng([7, x.shape[1]]).standard_normal((x.shape[1], COUNTED))
        count = np.zeros((len(one), len(two)), np.int8)
        for k in range(COUNTED):
            count += np.abs(p[one, k][:, None] - p[two, k][None, :]) <= window
        pair = (count >= least) & (label[one][:, None] == label[two][None, :])
        if i == j:
            pair = np.triu(pair, 1)
        a, c = np.nonzero(pair)
        if not len(a):
            return None
        a, c = one[a], two[c]
        cell = tab["cells"].chunk(0).flatten().to_numpy().reshape(tab.num_rows, -1)
        for s in range(t):  # pairs that have met in an earlier group were counted there
            if not len(a):
                return None
            fresh = cell[a, s] != cell[c, s]
            a, c = a[fresh], c[fresh]
        linked = np.einsum("ij,ij->i", x[a], x[c]) >= threshold
        a, c = a[linked], c[linked]
        if not len(a):
            return None
        total = np.bincount(a, weight[c], len(x)) + np.bincount(c, weight[a], len(x))
        has = np.flatnonzero(total)
        up = np.arange(len(x))

        def find(v):
            while up[v] != v:
                up[v] = up[up[v]]
                v = up[v]
            return v

        tree = []
        for u, v in zip(a.tolist(), c.tolist()):
            ru, rv = find(u), find(v)
            if ru != rv:
                up[ru] = rv
                tree.append((ids[u], ids[v]))
        # Counts have no second vertex, edges of a spanning forest no count. The label and vector name the class.
        m = len(tree)
        table = tab.select(["label", "embedding"]).take(pa.array(has))
        return pa.RecordBatch.from_arrays(
            [
                pa.concat_arrays([pa.array(ids[has]), pa.array([e[0] for e in tree], pa.int64())]),
                pa.array([None] * len(has) + [e[1] for e in tree], pa.int64()),
                pa.array([int(v) for v in total[has]] + [0] * m, pa.int64()),
                pa.concat_arrays([table["label"].combine_chunks(), pa.nulls(m, pa.int64())]) if m else table["label"].combine_chunks(),
                pa.concat_arrays([table["embedding"].combine_chunks(), pa.nulls(m, table["embedding"].type)]) if m else table["embedding"].combine_chunks(),
            ],
            ["a", "b", "n", "label", "embedding"],
        )

    found = materialize(over_units(rows, ["unit", "i", "j"], unit, f"a long, b long, n long, label long, embedding {kind}"), "vec-found")
    counts = materialize(found.where("b is null").groupBy("label", "embedding").agg(F.sum("n").alias("n")), "vec-counts")
    # Every row's own id is tied to its class's smallest id, so that copies and repeated ids share a component.
    placed = materialize(table.withColumn("_ok", F.col("label").isNotNull() & F.col("vec_id").isNotNull() & usable("embedding")).join(classes.withColumn("_ok", F.lit(True)), ["_ok", "label", "embedding"], "left").join(counts.withColumn("_ok", F.lit(True)), ["_ok", "label", "embedding"], "left").select("vec_id", "rep", (F.coalesce("n", F.lit(0)) + F.coalesce("weight", F.lit(1)) - 1).cast("long").alias("n_links")), "vec-placed")
    comps = connected_components(found.where("b is not null").select("a", "b").union(placed.where("rep <> vec_id").select("vec_id", "rep")))
    discard(posted, found, counts)
    out = placed.join(comps.select(F.col("node").alias("vec_id"), "component"), "vec_id", "left")
    comp = F.coalesce("component", "vec_id")
    return out.select("vec_id", "n_links", comp.alias("component_id"), F.coalesce(F.col("vec_id") == comp, F.lit(True)).alias("kept"))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_links(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP10_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
                     WHERE label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                       AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e)) / sqrt(list_dot_product(b.e, b.e)) >= 0.98),
r AS (SELECT vec_id AS x, vec_id AS c FROM v UNION SELECT l.y, r.c FROM r JOIN l ON l.x = r.x),
m AS (SELECT x, min(c) AS c FROM r GROUP BY x),
k AS (SELECT x, count(*) AS n FROM l GROUP BY x)
SELECT e.vec_id, coalesce(k.n, 0)::BIGINT AS n_links, coalesce(m.c, e.vec_id) AS component_id, coalesce(m.c, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN k ON k.x = e.vec_id LEFT JOIN m ON m.x = e.vec_id
"""
