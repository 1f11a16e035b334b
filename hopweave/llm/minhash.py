"""MinHash near-duplicate detection by a signature-coordinate inverted join.

Documents become sets of distinct word shingles and signatures of 64 coordinates.
Every document is posted under its (coordinate, value) items. A pair whose
similarity is at least the threshold agrees in ``matches`` coordinates or more
(missed with a probability of about 5e-7 at exactly 0.8), so

* a document with fewer than ``matches`` items that anyone else holds is done;
* of the others only a prefix is posted: the rarest ``64 - matches + 1`` items in
  one global order, of which such a pair must share one; the items held by one
  document only fill the prefix first and are skipped, as is the frequent rest;
* the count of a candidate pair goes on over the rest of the signature by looking its coordinates up (the
  skip: long posting lists are not merged), and pairs at or above the match count are confirmed on the full sets.

Components need no pair twice: each posting list is first linked to its smallest
document only (linear in its length), and only pairs between what are then still
different components are compared, in tiles of bounded size, the list's largest
component never with itself. Documents with equal sets are one document throughout.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopweave.llm._bytes import U64, WordHashes, batch_rows, binary, mix, trimmed
from hopweave.llm._units import over_units
from hopweave.operators.components import connected_components
from hopweave.storage import discard, materialize

COORDINATES, MATCHES = 64, 36
TILE = 512
#: Ids that are broadcast at most, 16 bytes each.
BROADCAST_IDS = 250_000
_SEED = np.random.default_rng(20250101)
_A = _SEED.integers(1, 1 << 63, COORDINATES, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_B = _SEED.integers(0, 1 << 63, COORDINATES, dtype=np.int64).astype(U64)


_hashes = WordHashes()


def shingle_sets(column, size: int) -> Iterator[np.ndarray]:
    """Each text's sorted distinct shingle hashes; none without words."""
    for text in binary(column):
        h = _hashes.of(text.as_buffer().to_pybytes())
        n = len(h) - size + 1
        if n > 0:
            whole = np.full(n, U64(size))
            for k in range(size):
                whole = mix(whole * U64(0xD1342543DE82EF95) + h[k : k + n])
            yield np.unique(whole)
        elif len(h):
            yield np.frombuffer(hashlib.blake2b(h.tobytes(), digest_size=8).digest(), U64)
        else:
            yield np.zeros(0, U64)


def signature(s: np.ndarray) -> np.ndarray:
    low = np.full(COORDINATES, np.iinfo(np.int32).max, np.int64)
    for i in range(0, len(s), 2048):
        low = np.minimum(low, ((s[None, i : i + 2048] * _A[:, None] + _B[:, None]) >> U64(33)).astype(np.int64).min(1))
    return low.astype(np.int32)


def features(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, n, set_key, sig) of each document with an id."""

    def run(batches):
        for batch in batches:
            n, key, sig = [], [], []
            for s in shingle_sets(batch["text"], size):
                n.append(len(s))
                key.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sig.append(signature(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(sig, pa.list_(pa.int32()))], ["doc_id", "n", "set_key", "sig"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(trimmed(run), "doc_id long, n long, set_key binary, sig array<int>")


def _sets(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """(id, members, small) of the documents with these ids: the set as 64-bit hashes, and as their upper halves."""

    def run(batches):
        for batch in batches:
            full = list(shingle_sets(batch["text"], size))
            small = [np.unique((s >> U64(32)).astype(np.uint32)).tobytes() for s in full]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([s.tobytes() for s in full], pa.binary()), pa.array(small, pa.binary())], ["id", "members", "small"])

    ids = materialize(ids.select(F.col("id").alias("doc_id")).distinct(), "mh-ids")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # A few megabytes of ids go to the texts; more of them meet the texts in a shuffle.
    return own.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi").mapInArrow(trimmed(run), "id long, members binary, small binary")


def _agreeing(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """Of the candidate pairs (a, b), those that agree in enough coordinates."""
    for c in "ab":
        pairs = pairs.join(sigs.select(F.col("id").alias(c), F.col("sig").alias("s" + c)), c)
    agree = F.aggregate(F.zip_with("sa", "sb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda t, x: t + x)
    return pairs.where(agree >= MATCHES).select("a", "b")


def _confirm(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Of the pairs (a, b), a stored table, those whose full sets are similar enough."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id"))
    sets = materialize(_sets(docs, ids, size).select("id", "members"), "mh-sets")
    for c in "ab":
        pairs = pairs.join(sets.select(F.col("id").alias(c), F.col("members").alias("m" + c)), c)

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch["ma"], batch["mb"]):
                x, y = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    out = materialize(pairs.mapInArrow(trimmed(run), "a long, b long"), "mh-links")
    discard(sets)
    return out


def _across(roles: DataFrame, sigs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Similar pairs (a, b) of roles(main, id, comp) that share a main and differ in comp, at least one outside main.

    The rows of a main are cut into tiles of about TILE, and each pair of tiles is one unit, so no pair is a row
    before it is confirmed and no task holds more than two tiles.
    """
    tiles = roles.groupBy("main").agg(F.sum((F.col("comp") != F.col("main")).cast("int")).alias("m"), F.count("*").alias("k"))
    tiles = materialize(tiles.select("main", F.ceil(F.col("m") / TILE).alias("ni"), F.ceil(F.col("k") / TILE).alias("nj")), "mh-tiles")
    placed = roles.join(tiles, "main").withColumn("h", F.xxhash64("id"))
    left = placed.where("comp <> main").select("main", F.expr("pmod(h, ni)").alias("i"), F.explode(F.expr("sequence(0L, nj - 1)")).alias("j"), F.lit(0).alias("side"), "id", "comp")
    right = placed.select("main", F.explode(F.expr("sequence(0L, ni - 1)")).alias("i"), F.expr("pmod(h, nj)").alias("j"), F.lit(1).alias("side"), "id", "comp")
    rows = left.union(right).join(sigs, "id")

    def agreeing(t: pa.Table) -> pa.RecordBatch | None:
        """The rows of a unit that have a partner in another component with enough coordinates in common."""
        side, comp = t["side"].to_numpy(), t["comp"].to_numpy()
        sig = t["sig"].combine_chunks().flatten().to_numpy().reshape(len(side), COORDINATES)
        x, y = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        agree = np.zeros((len(x), len(y)), np.int8)
        for k in range(COORDINATES):
            agree += sig[x, k][:, None] == sig[y, k][None, :]
        hit = (agree >= MATCHES) & (comp[x][:, None] != comp[y][None, :])
        keep = np.r_[x[hit.any(1)], y[hit.any(0)]]
        return t.select(["main", "i", "j", "side", "id", "comp"]).take(pa.array(keep)).combine_chunks().to_batches()[0] if len(keep) else None

    near = materialize(over_units(rows, ["main", "i", "j"], agreeing, "main long, i long, j long, side int, id long, comp long"), "mh-near")
    small = materialize(_sets(docs, near, size).select("id", "small", (F.octet_length("members") / 8).cast("long").alias("n")), "mh-small")
    near = near.join(small, "id")

    def unit(t: pa.Table) -> pa.RecordBatch | None:
        """Pairs whose 32-bit sets, in which strangers may look equal but equals never look strange, are similar enough."""
        side, ids, comp, full = (t[c].to_numpy() for c in ("side", "id", "comp", "n"))
        x, y = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not len(x) or not len(y):
            return None
        held = t["small"].combine_chunks()
        both = [[np.frombuffer(held[int(i)].as_buffer(), np.uint32) for i in of] for of in (x, y)]
        own = [np.array([len(s) for s in of]) for of in both]
        cols = np.intersect1d(*(np.unique(np.concatenate(of)) for of in both), assume_unique=True)
        total = np.zeros((len(x), len(y)), np.float32)
        real = [np.concatenate(of) for of in both]
        spot = [np.searchsorted(cols, r) for r in real]
        owner = [np.repeat(np.arange(len(k)), k) for k in own]
        for c in range(0, len(cols), 8192):  # sizes of the intersections, by bounded blocks of shingles
            m = []
            for q in (0, 1):
                at = np.flatnonzero((spot[q] >= c) & (spot[q] < min(c + 8192, len(cols))))
                at = at[cols[spot[q][at]] == real[q][at]]
                z = np.zeros((len(own[q]), min(8192, len(cols) - c)), np.float32)
                z[owner[q][at], spot[q][at] - c] = 1
                m.append(z)
            total += m[0] @ m[1].T
        lost = (full[x] - own[0])[:, None] + (full[y] - own[1])[None, :]
        total = total.astype(np.int64) + lost
        hit = (100 * total >= percent * (full[x][:, None] + full[y][None, :] - total)) & (comp[x][:, None] != comp[y][None, :])
        i, j = np.nonzero(hit)
        a, b = ids[x[i]], ids[y[j]]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return _confirm(materialize(over_units(near, ["main", "i", "j"], unit, "a long, b long").distinct(), "mh-pairs"), docs, size, percent)


def minhash_components(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs(doc_id, text).

    Words are runs of bytes other than blank and 0x09-0x0D, with A-Z in lower case; a set holds the distinct
    ``size``-word shingles, the whole sequence where there are fewer words, and nothing without words. Documents
    with ``100 * intersection >= percent * union`` are linked; empty sets link with nothing. Rows with a null
    doc_id are kept and link with nothing (component_id null, kept true); of rows that repeat a doc_id each gets
    the component of that id. Other columns are ignored; an empty table gives no rows.
    """
    batch_rows(docs.sparkSession, 2000)
    feats = materialize(features(docs, size), "mh-features")
    usable = feats.where("n > 0 and doc_id is not null")
    classes = materialize(usable.groupBy("set_key").agg(F.min("doc_id").alias("rep")), "mh-classes")
    reps = usable.join(classes.select(F.col("rep").alias("doc_id"), "set_key"), ["doc_id", "set_key"], "left_semi").select(F.col("doc_id").alias("id"), "sig").dropDuplicates(["id"])
    reps = materialize(reps, "mh-reps")
    items = reps.select("id", F.posexplode("sig").alias("c", "v")).select("id", (F.shiftleft(F.col("c").cast("long"), 32) + F.col("v")).alias("item"))
    shared = materialize(items.groupBy("item").agg(F.count("*").alias("df")).where("df > 1"), "mh-shared")
    # array_sort is by df, then item: one order for all documents
    held = items.join(shared, "item").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "item"))).alias("held")).where(F.size("held") >= MATCHES)
    postings = materialize(held.select("id", F.explode(F.slice("held", 1, F.size("held") - MATCHES + 1)).alias("p")).select("id", F.col("p.item").alias("item")), "mh-postings")
    discard(shared)
    ids = postings.select("id").distinct()
    sigs = materialize(reps.join(ids, "id", "left_semi"), "mh-sigs")
    discard(reps)

    first = postings.groupBy("item").agg(F.min("id").alias("a"), F.count("*").alias("k")).where("k > 1").select("item", "a")
    star = postings.join(materialize(first, "mh-first"), "item").where("id <> a").select("a", F.col("id").alias("b")).distinct()
    links = _confirm(materialize(_agreeing(star, sigs), "mh-pairs"), docs, size, percent)
    comps = connected_components(links)

    # What is left: pairs of one posting list in different components, the list's largest component not among itself.
    placed = materialize(postings.join(comps.select(F.col("node").alias("id"), "component"), "id", "left").select("item", "id", F.coalesce("component", "id").alias("comp")), "mh-placed")
    by = placed.groupBy("item", "comp").agg(F.count("*").alias("k"))
    mixed = materialize(by.groupBy("item").agg(F.max(F.struct("k", "comp")).alias("m"), F.count("*").alias("n")).where("n > 1").select("item", F.col("m.comp").alias("main")), "mh-mixed")
    roles = materialize(placed.join(mixed, "item").select("main", "id", "comp").distinct(), "mh-roles")
    more = _across(roles, sigs, docs, size, percent)
    if not more.isEmpty():
        comps = connected_components(links.union(more))
    discard(postings, placed, mixed, roles, sigs)

    member = feats.select("doc_id", "n", "set_key").join(classes, "set_key", "left").drop("set_key")
    out = member.join(comps.select(F.col("node").alias("rep"), "component"), "rep", "left")
    comp = F.coalesce("component", "rep", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), comp.alias("component_id"), F.coalesce(F.col("doc_id") == comp, F.lit(True)).alias("kept"))


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), size=2, percent=80)
