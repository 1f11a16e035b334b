"""Approximate nearest neighbours: a graph by NN-descent, queries by greedy search.

The graph starts from cells: each vector goes to the cells of its nearest pivots, a sample of the vectors, and to one
random group, and all pairs of a cell are compared in one multiplication; large cells are dealt in parts. The graph improves by joins of neighbours of
neighbours: each vector's sampled neighbours and reverse neighbours meet at it, are compared
with one another there, and a comparison that beats either side's last neighbour is sent to that side.
Two that have both been joined before are not compared again; rounds go on until few list entries are left that have not been joined.
Joins carry the vectors as given; all scores are computed in double precision. Lists are sampled, gathered and cut in Arrow
batches, so that a round is four shuffles.

A query then walks the graph from its own place: each round opens the unopened
vectors of its pool, asks for their neighbours' scores, and keeps the best of all, until its pool has none unopened. Vectors
are held in blocks of bounded size; a round sends each query to the blocks that hold what it asks for.
A fixed number of queries is also compared with every vector; while the walks find too few of their true neighbours, the pool is doubled, so that
the effort follows the table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hopweave.llm._bytes import U64, batch_rows, mix
from hopweave.llm._units import bounds, over_runs, over_units
from hopweave.llm.vectors import as_given, usable
from hopweave.storage import discard, materialize

NEIGHBOURS, SAMPLED, GROUP, STARTS = 40, 20, 1024, 4
POOL, BLOCK = 200, 1024
#: Most pivots, and rows of a slab of a cell's scores.
PIVOTS, SLAB = 4096, 512
#: Queries whose true neighbours are computed, and the share of these that a search has to find; with less, the pool doubles.
PROBES, RECALL = 64, 0.95
#: Rounds end when at most this share of the list entries is new.
CHANGED = 0.001
#: st of a list entry: joined in an earlier round, found and waiting, found and joined in the next round.
JOINED, WAITING, NEXT = 0, 1, 2
LISTS = "v long, nb array<long>, sc array<double>"
GRAPH = LISTS + ", st array<tinyint>"


def _best(v: np.ndarray, nb: np.ndarray, sc: np.ndarray, k: int, st: np.ndarray | None = None):
    """Rows sorted by v, best first, one per (v, nb), that of the smallest st, k per v at most: indices."""
    o = np.lexsort((nb, v) if st is None else (st, nb, v))
    v2, nb2 = v[o], nb[o]
    o = o[np.r_[True, (v2[1:] != v2[:-1]) | (nb2[1:] != nb2[:-1])]] if len(o) else o
    o = o[np.lexsort((nb[o], -sc[o], v[o]))]
    b = bounds(v[o])
    rank = np.arange(len(o)) - np.repeat(b[:-1], np.diff(b))
    return o[rank < k]


def _lists(v: np.ndarray, nb: np.ndarray, sc: np.ndarray, st: np.ndarray | None = None) -> pa.RecordBatch:
    b = bounds(v)
    off = pa.array(b, pa.int32())
    out = [pa.array(v[b[:-1]]), pa.ListArray.from_arrays(off, pa.array(nb, pa.int64())), pa.ListArray.from_arrays(off, pa.array(sc, pa.float64()))]
    if st is not None:
        out.append(pa.ListArray.from_arrays(off, pa.array(st, pa.int8())))
    return pa.RecordBatch.from_arrays(out, ["v", "nb", "sc", "st"][: len(out)])


def _flat(t: pa.Table, *columns: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """For each entry of the rows' lists its row, and the entries of each column."""
    n = np.diff(t[columns[0]].combine_chunks().offsets.to_numpy()) if t.num_rows else np.zeros(0, int)
    return np.repeat(np.arange(len(n)), n), [t[c].combine_chunks().flatten().to_numpy() for c in columns]


def _rank(*keys: np.ndarray) -> np.ndarray:
    """Each entry's place in its run of equal values of all keys."""
    n = len(keys[0])
    b = np.unique(np.concatenate([bounds(k) for k in keys])) if n else np.zeros(1, np.int64)
    return np.arange(n) - np.repeat(b[:-1], np.diff(b))


def _merge(rows: DataFrame, k: int) -> DataFrame:
    """The best k of each v, with its x, which one of its rows has, an empty list too; of those waiting the best SAMPLED are joined next."""
    kind = rows.schema["x"].dataType.simpleString()

    def run(t: pa.Table) -> pa.RecordBatch:
        every = t["v"].to_numpy()
        row, (nb, sc, st) = _flat(t, "nb", "sc", "st")
        v = every[row]
        o = _best(v, nb, sc, k, st)
        v, nb, sc, st = v[o], nb[o], sc[o], st[o].copy()
        i = np.flatnonzero(st == WAITING)
        st[i[_rank(v[i]) < SAMPLED]] = NEXT
        x = t["x"].combine_chunks()
        own = np.flatnonzero(x.is_valid().to_numpy(zero_copy_only=False))
        every = every[own]  # in the order of v, one each
        off = pa.array(np.r_[np.searchsorted(v, every), len(v)], pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(every), x.take(pa.array(own)), *(pa.ListArray.from_arrays(off, pa.array(y, z)) for y, z in ((nb, pa.int64()), (sc, pa.float64()), (st, pa.int8())))], ["v", "x", "nb", "sc", "st"])

    return over_runs(rows, ["v"], run, GRAPH.replace("v long", f"v long, x {kind}", 1))


def _cell_pairs(tab: pa.Table) -> pa.RecordBatch | None:
    """For each vector of a cell its NEIGHBOURS best others."""
    ids, n = tab["v"].to_numpy(), tab.num_rows
    x = tab["x"].combine_chunks().flatten().to_numpy().reshape(n, -1).astype(float)
    k = min(NEIGHBOURS, n - 1)
    if not k:
        return None
    nb, sc = np.empty((n, k), np.int64), np.empty((n, k))
    for a in range(0, n, SLAB):
        s = x[a : a + SLAB] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        i = np.argpartition(s, n - k, 1)[:, n - k :]
        nb[a : a + SLAB], sc[a : a + SLAB] = ids[i], np.take_along_axis(s, i, 1)
    return _lists(np.repeat(ids, k), nb.ravel(), sc.ravel(), np.full(n * k, WAITING, np.int8))


def _start(vectors: DataFrame, total: int) -> DataFrame:
    """GRAPH rows, and x, from cells of near pivots and one random group; a list is empty where a vector has met no other."""
    groups = max(1, total // GROUP)
    pivots = np.array([r["x"] for r in vectors.orderBy(F.xxhash64("v")).limit(min(groups, PIVOTS)).collect()], float)
    pivots /= np.maximum(np.abs(pivots).max(1, keepdims=True), 1e-300) if len(pivots) else 1  # lengths without overflow
    pivots /= np.linalg.norm(pivots, axis=1, keepdims=True) if len(pivots) else 1
    near, kind = min(STARTS - 1, len(pivots)), vectors.schema["x"].dataType.simpleString()

    def assign(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            s = batch["x"].flatten().to_numpy().reshape(n, -1).astype(float)
            s = s / np.abs(s).max(1, keepdims=True) @ pivots.T
            cell = np.argpartition(-s, near - 1, 1)[:, :near]
            if groups > 1:  # random groups are numbered after the pivots
                cell = np.c_[cell, len(pivots) + (mix(batch["v"].to_numpy().view(U64) + U64(1)) % U64(groups)).astype(np.int64)]
            else:
                cell = cell[:, :1]
            off = pa.array(np.arange(n + 1) * cell.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([batch["v"], batch["x"], pa.ListArray.from_arrays(off, pa.array(cell.ravel(), pa.int64()))], ["v", "x", "g"])

    placed = materialize(vectors.select("v", "x").mapInArrow(assign, f"v long, x {kind}, g array<long>"), "ann-cells").withColumn("g", F.explode("g"))
    # A few thousand rows: the cells that are dealt in parts.
    large = placed.groupBy("g").count().where(F.col("count") > STARTS * GROUP).select("g", F.ceil(F.col("count") / (STARTS * GROUP)).alias("parts"))
    dealt = placed.join(F.broadcast(large), "g", "left").withColumn("part", F.pmod(F.xxhash64("v", F.lit(-1)), F.coalesce("parts", F.lit(1)))).select("g", "part", "v", "x")
    met = over_units(dealt, ["g", "part"], _cell_pairs, GRAPH)
    none = vectors.select("v", "x", *(F.array().cast(f"array<{t}>").alias(c) for c, t in (("nb", "long"), ("sc", "double"), ("st", "tinyint"))))
    return _merge(none.unionByName(met, allowMissingColumns=True), NEIGHBOURS)


def _meetings(graph: DataFrame, r: int) -> DataFrame:
    """(at, v, new): the sampled neighbours and reverse neighbours that meet at a vector, where at least one is new."""

    def ends(batches):
        for batch in batches:
            row, (u, st) = _flat(pa.Table.from_batches([batch]), "nb", "st")
            v, known = batch["v"].to_numpy()[row], st != WAITING
            v, u, new = v[known], u[known], st[known] == NEXT
            o = np.lexsort((mix((v * 31 + u + r).view(U64)), ~new, v))
            own = o[_rank(v[o]) < SAMPLED]
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[v[own], u]), pa.array(np.r_[u[own], v]), pa.array(np.r_[new[own], new]), pa.array(np.r_[np.ones(len(own), bool), np.zeros(len(u), bool)])], ["at", "v", "new", "own"])

    met = graph.select("v", "nb", "st").mapInArrow(ends, "at long, v long, new boolean, own boolean").repartition("at")
    rank = F.row_number().over(W.partitionBy("at", "own").orderBy(F.desc("new"), F.xxhash64("at", "v", F.lit(r))))
    met = met.withColumn("k", rank).where(F.col("k") <= SAMPLED).groupBy("at", "v").agg(F.max("new").alias("new"))
    return met.withColumn("any", F.max("new").over(W.partitionBy("at"))).where("any").drop("any")


def _join_pairs(tab: pa.Table) -> pa.RecordBatch | None:
    """Of those that meet at a vector: for each the others above its least score, where one of the two is new."""
    b = bounds(tab["at"].to_numpy())
    ids, least, new = tab["v"].to_numpy(), tab["least"].to_numpy(), tab["new"].to_numpy(zero_copy_only=False).astype(bool)
    x = tab["x"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
    size = np.diff(b)
    out = [[], [], []]
    for n in np.unique(size):
        if n < 2:
            continue
        at = b[:-1][size == n]
        step = max(1, 400_000 // (n * max(n, x.shape[1])))
        for a in range(0, len(at), step):
            m = at[a : a + step][:, None] + np.arange(n)
            e = x[m].astype(float)
            s = e @ e.transpose(0, 2, 1)
            ok = (new[m][:, :, None] | new[m][:, None, :]) & (s > least[m][:, :, None])
            ok[:, np.arange(n), np.arange(n)] = False
            c, i, j = np.nonzero(ok)
            for y, z in zip(out, (ids[m[c, i]], ids[m[c, j]], s[c, i, j])):
                y.append(z)
    if not sum(map(len, out[0])):
        return None
    v, nb, sc = map(np.concatenate, out)
    o = _best(v, nb, sc, NEIGHBOURS)
    return _lists(v[o], nb[o], sc[o], np.full(len(o), WAITING, np.int8))


def build_graph(vectors: DataFrame) -> DataFrame:
    """GRAPH rows, and x, of a stored table (v long, x array of float or double) of distinct v and equal lengths: each v's best neighbours, best first.

    Scores are inner products in double precision.
    """
    total = vectors.count()
    graph = materialize(_start(vectors, total), "ann-graph")
    if total < 2 * GROUP:  # all have met
        return graph
    r = 0
    while graph.select(F.sum(F.size(F.filter("st", lambda x: x != JOINED))) > CHANGED * F.sum(F.size("nb"))).first()[0]:
        # A list that is not full takes anything.
        last = graph.select("v", "x", F.when(F.size("sc") < NEIGHBOURS, F.lit(float("-inf"))).otherwise(F.element_at("sc", -1)).alias("least"))
        found = over_runs(_meetings(graph, r).join(last, "v"), ["at"], _join_pairs, GRAPH)
        old = graph.withColumn("st", F.transform("st", lambda x: F.when(x == NEXT, F.lit(JOINED)).otherwise(x).cast("tinyint")))
        better = materialize(_merge(old.unionByName(found, allowMissingColumns=True), NEIGHBOURS), "ann-graph")
        discard(graph)
        graph = better
        r += 1
    return graph


def exact(vectors: DataFrame, ids: list[int], probes: np.ndarray, k: int) -> DataFrame:
    """(v, sc) for few probes: the best k scores of each with all vectors but itself, vectors in blocks."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            s = batch["x"].flatten().to_numpy().reshape(batch.num_rows, -1).astype(float) @ probes.T
            s[batch["v"].to_numpy()[:, None] == np.array(ids)[None, :]] = -np.inf
            top = -np.sort(-s, axis=0)[:k]
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(ids, len(top)), pa.int64()), pa.array(top.ravel())], ["v", "sc"])

    best = vectors.select("v", "x").mapInArrow(run, "v long, sc double").where("sc > double('-Infinity')")
    return best.groupBy("v").agg(F.slice(F.sort_array(F.collect_list("sc"), False), 1, k).alias("sc"))


def searched(vectors: DataFrame, graph: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """As search, with the pool that a sample of the queries needs."""
    total, pool = vectors.count(), max(POOL, 4 * k)
    sample = vectors.join(queries.orderBy(F.xxhash64("v")).limit(PROBES), "v").collect()
    ids = [r["v"] for r in sample]
    truth = {r["v"]: r["sc"] for r in exact(vectors, ids, np.array([r["x"] for r in sample], float), k).collect()} if ids else {}
    while True:
        found = materialize(search(vectors, graph, queries, k, pool), "ann-found")
        got = {r["v"]: r["sc"] for r in found.where(F.col("v").isin(ids)).select("v", "sc").collect()}
        # By scores, so that of tied neighbours either will do.
        hits = sum(sum(x >= t[-1] - 1e-9 * abs(t[-1]) for x in got.get(v, ())) for v, t in truth.items())
        if hits >= RECALL * sum(map(len, truth.values())) or pool >= total:
            return found
        discard(found)
        pool *= 2


def search(vectors: DataFrame, graph: DataFrame, queries: DataFrame, k: int, pool: int = POOL) -> DataFrame:
    """(v, nb, sc): for each query v of queries(v), its best k of vectors but itself found by greedy search, sc in double precision.

    A round opens all of a pool; the walk ends when no query's pool holds a vector that has not been opened.
    """
    total, kind = vectors.count(), vectors.schema["x"].dataType.simpleString()
    blocks = max(1, -(-total // BLOCK))
    state_schema = f"v long, x {kind}, nb array<long>, sc array<double>, opened array<boolean>, front array<long>"

    def block_of(v: np.ndarray) -> np.ndarray:
        return (mix(v.view(U64)) % U64(blocks)).astype(np.int64)

    def place(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(block_of(batch["v"].to_numpy())), batch["v"], batch["x"]], ["block", "v", "x"])

    edges = graph.select("v", F.explode("nb").alias("u"))
    back = edges.withColumn("k", F.row_number().over(W.partitionBy("u").orderBy(F.xxhash64("v", "u")))).where(F.col("k") <= NEIGHBOURS).select(F.col("u").alias("v"), F.col("v").alias("u"))
    near = materialize(edges.union(back).groupBy("v").agg(F.collect_set("u").alias("near")), "ann-near")
    placed = materialize(vectors.select("v", "x").mapInArrow(place, f"block long, v long, x {kind}"), "ann-placed")
    placed_rows = placed.select("block", F.lit(0).alias("kind"), "v", "x", F.lit(None).cast("array<long>").alias("ask"), F.lit(None).cast("double").alias("least"))
    own = vectors.join(queries, "v", "left_semi").select("v", "x").join(graph.select("v", F.col("nb").alias("front")), "v", "left")
    # The first round opens a query and its own list; scores are all counted in one way, so the list's own are not taken over.
    state = materialize(own.select("v", "x", F.array().cast("array<long>").alias("nb"), F.array().cast("array<double>").alias("sc"), F.array().cast("array<boolean>").alias("opened"), F.concat(F.array("v"), F.coalesce("front", F.array().cast("array<long>"))).alias("front")), "ann-state")

    def ask(tab: pa.Table) -> pa.RecordBatch | None:
        """One query's state row and the neighbours of what it opens: what it asks of each block."""
        first = int(np.flatnonzero(tab["kind"].to_numpy() == 0)[0])
        want = np.unique(tab["near"].combine_chunks().flatten().to_numpy())
        nb, sc = (np.array(tab[c][first].values.to_numpy()) for c in ("nb", "sc"))
        want = want[~np.isin(want, nb) & (want != tab["v"][first].as_py())]
        if not len(want):
            return None
        at = block_of(want)
        o = np.argsort(at, kind="stable")
        at, want = at[o], want[o]
        b = bounds(at)
        n = len(b) - 1
        one = tab["x"].slice(first, 1).combine_chunks()
        least = sc[-1] if len(sc) >= pool else -np.inf
        return pa.RecordBatch.from_arrays([pa.array(at[b[:-1]]), pa.array(np.ones(n, np.int32)), pa.array(np.full(n, tab["v"][first].as_py())), one.take(pa.array(np.zeros(n, np.int64))), pa.ListArray.from_arrays(pa.array(b, pa.int32()), pa.array(want)), pa.array(np.full(n, least))], ["block", "kind", "v", "x", "ask", "least"])

    def answer(tab: pa.Table) -> pa.RecordBatch | None:
        kind = tab["kind"].to_numpy()
        here = int((kind == 0).sum())
        if here == len(kind):
            return None
        emb = tab["x"].combine_chunks().flatten().to_numpy().reshape(len(kind), -1)
        v = tab["v"].to_numpy()
        ids, base = v[:here], emb[:here].astype(float)
        o = np.argsort(ids)
        ids, base = ids[o], base[o]
        rest = tab.slice(here)
        row, (want,) = _flat(rest, "ask")
        query, least = emb[here:].astype(float), rest["least"].to_numpy()
        place, s = np.searchsorted(ids, want), np.empty(len(want))
        for a in range(0, len(want), 20_000):
            # The same sum whatever else is asked: a score never changes, so a pool only gets better.
            s[a : a + 20_000] = (base[place[a : a + 20_000]] * query[row[a : a + 20_000]]).sum(1)
        keep = s >= least[row]  # what is below a full pool's last never enters it
        return _lists(v[here:][row[keep]], want[keep], s[keep]) if keep.any() else None

    def settle(tab: pa.Table) -> pa.RecordBatch:
        """One query's state row and the answers to it: the new state."""
        first = int(np.flatnonzero(tab["kind"].to_numpy() == 0)[0])
        nb = tab["nb"].combine_chunks().flatten().to_numpy()
        sc = tab["sc"].combine_chunks().flatten().to_numpy()
        done = np.array(tab["opened"].combine_chunks().flatten().to_pylist(), bool)
        done = np.r_[done, np.zeros(len(nb) - len(done), bool)]  # the state row is first
        nb, i = np.unique(nb, return_index=True)
        sc, done = sc[i], done[i] | np.isin(nb, np.array(tab["front"][first].as_py(), np.int64))
        o = np.lexsort((nb, -sc))[:pool]
        nb, sc, done = nb[o], sc[o], done[o]
        return pa.RecordBatch.from_arrays([tab["v"][:1].combine_chunks(), tab["x"].slice(first, 1).combine_chunks(), pa.array([nb], pa.list_(pa.int64())), pa.array([sc], pa.list_(pa.float64())), pa.array([done.tolist()], pa.list_(pa.bool_())), pa.array([nb[~done]], pa.list_(pa.int64()))], ["v", "x", "nb", "sc", "opened", "front"])

    while not (walking := state.where(F.size("front") > 0)).isEmpty():
        opened = walking.select("v", F.explode("front").alias("f")).join(near.withColumnRenamed("v", "f"), "f")
        rows = walking.select("v", F.lit(0).alias("kind"), "x", "nb", "sc", F.lit(None).cast("array<long>").alias("near"))
        rows = rows.union(opened.select("v", F.lit(1), F.lit(None).cast(kind), F.lit(None).cast("array<long>"), F.lit(None).cast("array<double>"), "near"))
        asked = over_units(rows, ["v"], ask, f"block long, kind int, v long, x {kind}, ask array<long>, least double", ["kind"])
        found = over_units(placed_rows.union(asked), ["block"], answer, LISTS, ["kind"])
        rows = state.select("v", "x", F.lit(0).alias("kind"), "nb", "sc", "opened", "front").union(found.select("v", F.lit(None).cast(kind), F.lit(1), "nb", "sc", F.lit(None).cast("array<boolean>"), F.lit(None).cast("array<long>")))
        after = materialize(over_units(rows, ["v"], settle, state_schema, ["kind"]), "ann-state")
        discard(state)
        state = after
    discard(near, placed)
    return state.select("v", F.slice("nb", 1, k).alias("nb"), F.slice("sc", 1, k).alias("sc"))


def nearest(table: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank from 1, vec_id, score) for queries(vec_id) against all rows of table(vec_id, embedding).

    Nearness is the inner product in double precision; ties go to the smaller vec_id; a query's own row is no candidate. Vectors that are null,
    zero or hold null or non-finite components take no part, nor do rows with a null vec_id or another length than most rows have. Of rows that
    repeat a vec_id the smallest vector counts. Equal vectors are one vector of the graph and come out as their smallest k + 1 ids.
    Other columns are ignored; an empty table gives no rows.
    """
    batch_rows(table.sparkSession, 10_000)
    table = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(as_given(table, "embedding")).alias("embedding")).where(F.col("vec_id").isNotNull() & usable("embedding"))
    size = table.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    table = materialize(table.where(F.size("embedding") == (size[0]["d"] if size else 0)).groupBy("vec_id").agg(F.min("embedding").alias("x")), "ann-table")
    classes = materialize(table.groupBy("x").agg(F.min("vec_id").alias("v"), F.count("*").alias("copies")), "ann-classes")
    vectors = materialize(classes.select("v", "x"), "ann-vectors")
    copied = classes.where("copies > 1").select("x", "v")
    twins = materialize(table.join(copied, "x").select("v", "vec_id"), "ann-twins")  # members of classes of more than one row
    shown = twins.withColumn("k", F.row_number().over(W.partitionBy("v").orderBy("vec_id"))).where(F.col("k") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    asked = materialize(queries.select(F.col("vec_id").cast("long").alias("query_id")).distinct().join(table.select(F.col("vec_id").alias("query_id"), "x"), "query_id"), "ann-asked")
    asked = asked.join(twins.select(F.col("vec_id").alias("query_id"), "v"), "query_id", "left").select("query_id", F.coalesce("v", "query_id").alias("v"), "x")
    found = searched(vectors, build_graph(vectors), asked.select("v").distinct(), k)
    hits = found.select("v", F.explode(F.arrays_zip("nb", "sc")).alias("h")).select("v", F.col("h.nb").alias("u"), F.col("h.sc").alias("score"))
    dot = F.aggregate("x", F.lit(0.0).cast("double"), lambda a, y: a + y.cast("double") * y.cast("double"))
    self = asked.join(shown.select("v"), "v", "left_semi").select("query_id", F.col("v").alias("u"), dot.alias("score"))
    hits = asked.select("query_id", "v").join(hits, "v").select("query_id", "u", "score").union(self)
    hits = hits.join(shown.withColumnRenamed("v", "u"), "u", "left").select("query_id", "score", F.explode(F.coalesce("ids", F.array("u"))).alias("vec_id")).where("vec_id <> query_id")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(table, table.where("vec_id % 20 = 0"))
