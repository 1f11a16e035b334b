"""Order-dependent operators: rows of a key are met one after the other, in order.

The rows of a key reach one task sorted and are read in batches; what is held is the state of the current key alone. A key that
holds very many rows takes its task long, but no more memory than its state: order-dependent results allow no split of a key.
"""

from __future__ import annotations

import copy
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopweave import dictionaries as D
from hopweave.functions import attrs as A
from hopweave.functions import names as N


def scan(df: DataFrame, key: str, order: list[str], start: Callable[[], object], step: Callable[[object, dict], list[tuple]], schema: str) -> DataFrame:
    """Rows that step(state, row) gives, for the rows of each key in order; start() makes a key's first state."""
    names = [f.strip().split(" ")[0] for f in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = state = None
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                row = {k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in row.items()}
                if state is None or row[key] != at:
                    at, state = row[key], start()
                out += step(state, row)
            yield pd.DataFrame(out, columns=names)

    return df.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


# --- budgets -------------------------------------------------------------------------------------------------------
def spend_exact(events: DataFrame, job: str, order: str, cost: str, ceiling: int) -> DataFrame:
    """(job, order, spent, granted): a cost that would pass the ceiling is refused and leaves the rest for smaller ones."""
    kinds = {f.name: f.dataType.simpleString() for f in events.schema}

    def step(state: dict, row: dict) -> list[tuple]:
        ok = state["spent"] + row[cost] <= ceiling
        state["spent"] += row[cost] if ok else 0
        return [(row[job], row[order], state["spent"], ok)]

    return scan(events.select(job, order, cost), job, [order], lambda: {"spent": 0}, step, f"{job} {kinds[job]}, {order} {kinds[order]}, spent long, granted boolean")


# --- resolution ----------------------------------------------------------------------------------------------------
def _near(xs, ys) -> bool:
    return any(x == y or (len(x) > 3 and len(y) > 3 and (x in y or y in x)) for x in xs for y in ys)


def inconsistent(a: dict, b: dict) -> bool:
    """Whether two sets of employer-shaped values contradict one another on an exclusive key."""
    return any(a[k] and b[k] and not _near(a[k], b[k]) for k in D.EXCLUSIVE_KEYS)


def readings(shaped: list[dict], most: int | None = None) -> int:
    """Greedy number of mutually inconsistent readings, counted up to ``most``."""
    heads: list[dict] = []
    for s in shaped:
        if all(inconsistent(s, h) for h in heads):
            heads.append(s)
            if most and len(heads) >= most:
                break
    return len(heads)


def _prepared(obs: DataFrame) -> DataFrame:
    """Everything the ladder compares, made in the JVM: name parts, compact attribute values, employer-shaped ones."""
    bare = lambda vs: F.array_distinct(F.filter(F.transform(vs, lambda v: A.compact(N.fold(v))), lambda v: v != ""))
    of = lambda k: F.coalesce(F.try_element_at("attributes", F.lit(k)), F.array().cast("array<string>"))
    none = F.array().cast("array<string>")
    out = obs.withColumn("tok", N.tokens(F.col("name")))
    out = out.withColumn("block", N.name_key(F.col("tok"))).withColumn("given", N.given(F.col("tok"))).withColumn("last", N.surname(F.col("tok")))
    out = out.withColumn("forms", N.given_forms(F.col("given"))).withColumn("norm", N.normalize_name(F.col("tok")))
    out = out.withColumn("sought", F.coalesce(N.could_be_same_name(N.tokens(F.col("provenance_name")), F.col("tok")), F.lit(False)))
    for k in D.COMPARED_KEYS:
        out = out.withColumn(f"has_{k}", bare(of(k)))
    for k in D.EXCLUSIVE_KEYS:
        out = out.withColumn(f"org_{k}", bare(F.filter(of(k), A.looks_like_employer)))
    near = bare(F.coalesce("neighbour_orgs", none)) if "neighbour_orgs" in obs.columns else none
    canonical = F.coalesce("canonical_urls", none)
    return out.withColumn("near", near).withColumn("canonical", canonical).withColumn("refused", F.col("refused") if "refused" in obs.columns else F.array().cast("array<long>"))


class _Node:
    def __init__(self, row: dict):
        self.id, self.urls, self.canonical, self.near, self.names, self.group = row["obs_id"], set(), set(), set(), {}, None
        self.has, self.org = {k: set() for k in D.COMPARED_KEYS}, {k: set() for k in D.EXCLUSIVE_KEYS}
        self.add(row)

    def add(self, row: dict) -> None:
        self.urls.add(row["url"])
        self.canonical.update(row["canonical"])
        self.near.update(row["near"])
        self.names.setdefault(row["norm"], (row["given"], row["last"], frozenset(row["forms"])))
        for k, s in self.has.items():
            s.update(row[f"has_{k}"])
        for k, s in self.org.items():
            s.update(row[f"org_{k}"])

    def holds(self, row: dict) -> bool:
        """Whether a row adds nothing but URLs."""
        return row["norm"] in self.names and self.near.issuperset(row["near"]) and all(s.issuperset(row[f"has_{k}"]) for k, s in self.has.items()) and all(s.issuperset(row[f"org_{k}"]) for k, s in self.org.items())

    def key(self) -> tuple:
        """(names, employer-shaped values, the rest) of what the ladder compares but for URLs."""
        return frozenset(self.names), tuple(map(frozenset, self.org.values())), tuple(map(frozenset, self.has.values())), frozenset(self.near)

    def profile(self) -> _Node:
        """This node as it is now, without its URLs."""
        like = copy.copy(self)
        like.id, like.group, like.urls, like.canonical, like.near, like.names = None, None, set(), set(), set(self.near), dict(self.names)
        like.has, like.org = ({k: set(s) for k, s in d.items()} for d in (self.has, self.org))
        return like

    def could_be(self, row: dict) -> bool:
        g, last, forms = row["given"], row["last"], set(row["forms"])
        if row["norm"] in self.names:
            return True
        return any(last and last == m and (g == h or ((len(g) == 1 or len(h) == 1) and g[:1] == h[:1]) or (len(g) > 1 and len(h) > 1 and not forms.isdisjoint(f))) for h, m, f in self.names.values())


def _rung(node: _Node, crowded: Callable[[], bool], row: dict) -> tuple[str, bool]:
    """The first rung of the merge ladder that decides, and whether it merges; crowded() tells whether the name has too many readings."""
    theirs = {k: row[f"org_{k}"] for k in D.EXCLUSIVE_KEYS}
    if not node.canonical.isdisjoint(row["canonical"]):
        return "same_canonical_url", True
    if inconsistent(node.org, theirs):
        return "conflicting_attributes", False
    if row["url"] in node.urls:
        return "single_referent_co_occurrence", True
    if row["sought"]:
        return "search_provenance", True
    if not any(_near(node.has[k], row[f"has_{k}"]) for k in D.COMPARED_KEYS):
        return "name_string_only", False
    veto = node.id in set(row["refused"])
    if _near(node.near, [v for k in D.EXCLUSIVE_KEYS for v in row[f"has_{k}"]]):
        return "attributes_plus_shared_neighbor", not veto
    if crowded():
        return "name_too_common", False
    return "rare_name_attributes", not veto


class _Group:
    """Nodes that the ladder tells apart by their URLs and ids alone."""

    def __init__(self, key: tuple, node: _Node):
        self.key, self.names, self.like, self.at = key, key[0], node.profile(), []  # at: places of its nodes, in order


class _Name:
    """The nodes of one name key, found by what the ladder asks of them, so that a row need not be held against each.

    Nodes of equal names and attributes form a group, which is compared with a row of certain names and attributes once; the URLs of nodes are
    looked up. A place is a node's number in the order in which nodes were opened.
    """

    #: Comparisons of kinds of rows with groups that are remembered (a fixed bound on memory; forgotten ones are made anew).
    REMEMBERED = 1_000_000

    def __init__(self, threshold: int):
        self.threshold, self.remembered = threshold, 0
        self.nodes: list[_Node] = []
        self.groups: dict[tuple, _Group] = {}
        self.made: dict[int, _Group] = {}  # living groups by number, the newest last
        self.count = 0
        self.urls: dict = {}  # url: number of the group: places
        self.canonical: dict = {}  # url: places
        self.names: dict = {}  # names: places
        self.orgs: dict = {}  # employer-shaped values: places
        self.kinds: dict[tuple, list] = {}
        self.heads: list[dict] | None = None  # the readings so far, up to the threshold

    def _group(self, at: int) -> None:
        """Puts a node that is new or has changed among its like."""
        node = self.nodes[at]
        key = node.key()
        g = self.groups.get(key)
        if g is None:
            g = self.groups[key] = _Group(key, node)
            self.count += 1
            g.number = self.count
            self.made[g.number] = g
        node.group = g
        insort(g.at, at)
        insort(self.names.setdefault(g.names, []), at)
        orgs = self.orgs.setdefault(key[1], [])
        if self.heads is not None and not orgs and at == len(self.nodes) - 1:
            self._head(node.org)
        elif not orgs or at < orgs[0]:
            self.heads = None
        insort(orgs, at)
        for u in node.urls:
            insort(self.urls.setdefault(u, {}).setdefault(g.number, []), at)

    def _ungroup(self, at: int) -> None:
        node = self.nodes[at]
        g = node.group
        orgs = self.orgs[g.key[1]]
        if orgs[0] == at:
            self.heads = None
        for places, table, key in ((g.at, self.groups, g.key), (self.names[g.names], self.names, g.names), (orgs, self.orgs, g.key[1]), *((self.urls[u][g.number], self.urls[u], g.number) for u in node.urls)):
            del places[bisect_left(places, at)]
            if not places:
                del table[key]
        if not g.at:
            del self.made[g.number]

    def open(self, row: dict) -> None:
        at = len(self.nodes)
        self.nodes.append(_Node(row))
        for c in self.nodes[at].canonical:
            self.canonical.setdefault(c, []).append(at)
        self._group(at)

    def add(self, at: int, row: dict) -> None:
        node = self.nodes[at]
        for c in set(row["canonical"]) - node.canonical:
            insort(self.canonical.setdefault(c, []), at)
        if node.holds(row):
            node.canonical.update(row["canonical"])
            if row["url"] not in node.urls:
                node.urls.add(row["url"])
                insort(self.urls.setdefault(row["url"], {}).setdefault(node.group.number, []), at)
            return
        self._ungroup(at)
        node.add(row)
        self._group(at)

    def _head(self, org: dict) -> None:
        if len(self.heads) < self.threshold and all(inconsistent(org, h) for h in self.heads):
            self.heads.append(org)

    def crowded(self) -> bool:
        """Whether the name has as many readings as the threshold. Of nodes with equal values only the first can be one of its own."""
        if self.heads is None:
            self.heads = []
            for i in sorted(places[0] for places in self.orgs.values()):
                self._head(self.nodes[i].org)
        return len(self.heads) >= self.threshold

    def fits(self, row: dict, kind: tuple) -> list:
        """[newest group looked at, numbers of consistent groups of the name: basis without URLs, rows' names met: whether they could be the row's]."""
        held = self.kinds.get(kind)
        if held is None:
            if self.remembered > self.REMEMBERED:
                self.kinds.clear()
                self.remembered = 0
            held = self.kinds[kind] = [0, {}, {}]
        if held[0] < self.count:
            bare = {**row, "canonical": (), "url": None, "refused": ()}
            for number in reversed(self.made):
                if number <= held[0]:
                    break
                g = self.made[number]
                if g.names not in held[2]:
                    held[2][g.names] = g.like.could_be(row)
                if held[2][g.names]:
                    basis, _ = _rung(g.like, lambda: False, bare)
                    if basis != "conflicting_attributes":
                        held[1][number] = basis
                        self.remembered += 1
            self.remembered += 1
            held[0] = self.count
        return held

    def place(self, row: dict, kind: tuple) -> tuple[int | None, int]:
        """The first node that the ladder allows, and how many before it (of all, if there is none) could bear the name."""
        _, near, could = self.fits(row, kind)
        best = len(self.nodes)
        for c in row["canonical"]:
            best = min(best, next((i for i in self.canonical.get(c, ()) if i < best and self.nodes[i].could_be(row)), best))
        at_url = self.urls.get(row["url"], {})
        for number in at_url if len(at_url) < len(near) else near:
            if number in at_url and number in near:
                best = min(best, at_url[number][0])
        refused, gone = set(row["refused"]), []
        for number, basis in near.items():
            g = self.made.get(number)
            if g is None:
                gone.append(number)
            elif g.at[0] < best and basis != "name_string_only" and (basis != "rare_name_attributes" or not self.crowded()):
                free = g.at if basis == "search_provenance" else (i for i in g.at if self.nodes[i].id not in refused)
                best = min(best, next(iter(free), best))
        for number in gone:
            del near[number]
        blocked = 0
        for names, places in self.names.items():
            if names not in could:
                could[names] = self.nodes[places[0]].could_be(row)
            if could[names]:
                blocked += bisect_left(places, best)
        return (best if best < len(self.nodes) else None), blocked


def resolve_in_order(obs: DataFrame, order: str, threshold: int = 3, verdicts: DataFrame | None = None) -> DataFrame:
    """(obs_id, node_id, basis, blocked): each observation joins the first node of its name key that the ladder allows, else opens one.

    obs as in ``resolve.decisions``; node_id is the first observation of its node, basis is what merged it (opened for a new node) and
    blocked counts the nodes that held it apart. verdicts(node_id, obs_id, verdict) are recorded answers; only a no counts, on the two
    rungs that rest on attributes. Observations without a name open nodes of their own.
    """
    if verdicts is not None:
        no = verdicts.where(F.lower(F.trim("verdict")) == "no").groupBy("obs_id").agg(F.collect_set(F.col("node_id").cast("long")).alias("refused"))
        obs = obs.join(no, "obs_id", "left").withColumn("refused", F.coalesce("refused", F.array().cast("array<long>")))
    # Names and attributes take long to prepare: rows are spread first, whatever files they come in.
    tasks = int(obs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ready = _prepared(obs.where("obs_id is not null").repartition(tasks, "obs_id")).withColumn("_order", F.col(order))

    alike = ["norm", "given", "last", "sought"], ["forms", *[f"has_{k}" for k in D.COMPARED_KEYS], *[f"org_{k}" for k in D.EXCLUSIVE_KEYS]]

    def step(name: _Name, row: dict) -> list[tuple]:
        at, blocked = name.place(row, (*[row[c] for c in alike[0]], *[tuple(row[c]) for c in alike[1]]))
        if at is None:
            name.open(row)
            return [(row["obs_id"], row["obs_id"], "opened", blocked)]
        node = name.nodes[at]
        basis, _ = _rung(node, name.crowded, row)
        name.add(at, row)
        return [(row["obs_id"], node.id, basis, blocked)]

    cols = ["block", "_order", "obs_id", "url", "canonical", "near", "norm", "given", "last", "forms", "sought", "refused", *[f"has_{k}" for k in D.COMPARED_KEYS], *[f"org_{k}" for k in D.EXCLUSIVE_KEYS]]
    schema = "obs_id long, node_id long, basis string, blocked int"
    named = scan(ready.where("block <> ''").select(*cols), "block", ["_order", "obs_id"], lambda: _Name(threshold), step, schema)
    return named.union(ready.where("block = ''").select("obs_id", F.col("obs_id").alias("node_id"), F.lit("opened").alias("basis"), F.lit(0).alias("blocked")))


# --- seeds ---------------------------------------------------------------------------------------------------------
def context_fit(context, attributes, urls):
    """How well a node fits the words that tell a person apart: 2 per value that shares one, 3 per URL that holds all of them, else 1 for any."""
    wanted = F.array_distinct(F.filter(F.split(F.replace(N.fold(F.coalesce(context, F.lit(""))), F.lit(","), F.lit(" ")), r"\s+"), lambda t: F.length(t) > 2))
    values = F.flatten(F.map_values(F.coalesce(attributes, F.create_map().cast("map<string,array<string>>"))))
    hits = F.size(F.filter(values, lambda v: F.arrays_overlap(F.split(N.fold(v), r"\s+"), wanted)))

    def url(u):
        low = N.fold(u)
        tight = F.regexp_replace(low, "[-./]", "")
        return F.when(F.forall(wanted, lambda w: F.contains(tight, w)), 3).when(F.exists(wanted, lambda w: F.contains(low, w)), 1).otherwise(0)

    return F.when(F.size(wanted) == 0, 0).otherwise(2 * hits + F.aggregate(F.transform(urls, url), F.lit(0), lambda s, x: s + x)).cast("long")


def seed_choice(seeds: DataFrame, nodes: DataFrame, most: int = 6) -> DataFrame:
    """seeds(name, context, famous) -> name, status, node_id, readings, merged, candidates.

    Nodes(node_id, display_name, name_variants, attributes, urls, canonical_urls, observations) that could bear the name are read from the most
    observed down; each joins the first reading whose head it does not contradict. Several readings without a context: of a famous name all
    are merged into the most observed node (status fused, merged holds the ids), of another none is chosen (ambiguous, the first heads are
    candidates). Otherwise the node that fits the context best is chosen; none where nobody bears the name.
    """
    sur = lambda c: F.when(N.surname(N.tokens(c)) != "", N.surname(N.tokens(c))).otherwise(N.normalize_name(N.tokens(c)))
    own = nodes.withColumn("_v", F.explode(F.array_union(F.array("display_name"), F.coalesce("name_variants", F.array().cast("array<string>"))))).withColumn("_s", sur(F.col("_v")))
    s = seeds.select(F.col("name").alias("seed"), "context", F.col("famous"), sur(F.col("name")).alias("_s"))
    hits = own.join(s, "_s").where("_s <> ''").where(N.could_be_same_name(N.tokens(F.col("_v")), N.tokens(F.col("seed"))))
    hits = hits.dropDuplicates(["seed", "node_id"]).withColumn("fit", context_fit(F.col("context"), F.col("attributes"), F.array_union(F.coalesce("urls", F.array().cast("array<string>")), F.coalesce("canonical_urls", F.array().cast("array<string>")))))
    ready = _prepared(hits.select("seed", "node_id", "observations", "fit", F.size("attributes").alias("keys"), F.col("display_name").alias("name"), "attributes", "canonical_urls", F.lit(None).cast("string").alias("provenance_name"))).withColumn("less", -F.col("observations"))

    def step(heads: list[dict], row: dict) -> list[tuple]:
        org = {k: row[f"org_{k}"] for k in D.EXCLUSIVE_KEYS}
        at = next((i for i, h in enumerate(heads) if not inconsistent(h, org)), None)
        if at is None:
            heads.append(org)
        return [(row["seed"], row["node_id"], len(heads) - 1 if at is None else at, at is None, row["observations"], row["keys"], row["fit"])]

    read = scan(ready.select("seed", "less", "node_id", "observations", "keys", "fit", *[f"org_{k}" for k in D.EXCLUSIVE_KEYS]), "seed", ["less", "node_id"], list, step, "seed string, node_id long, reading int, head boolean, observations long, keys int, fit long")
    first = F.struct(F.col("fit"), F.col("observations"), F.col("keys"), -F.col("node_id"))
    seen = F.struct(F.col("observations"), F.col("keys"), -F.col("node_id"))
    heads = F.slice(F.array_sort(F.collect_list(F.when(F.col("head") & (F.col("reading") < most), F.struct("reading", "node_id")))), 1, most)
    one = read.groupBy("seed").agg(F.max("reading").alias("r"), F.max_by("node_id", first).alias("best"), F.max_by("node_id", seen).alias("biggest"), heads.alias("heads"))
    out = seeds.join(one, F.col("name") == F.col("seed"), "left")
    many = (F.col("r") > 0) & (F.coalesce(F.trim("context"), F.lit("")) == "")
    status = F.when(F.col("r").isNull(), "none").when(many & F.col("famous"), "fused").when(many, "ambiguous").otherwise("chosen")
    return out.withColumn("status", status).select("name", "status", F.when(F.col("status") == "fused", F.col("biggest")).when(F.col("status") == "chosen", F.col("best")).alias("node_id"), (F.coalesce("r", F.lit(-1)) + 1).alias("readings"), F.when(F.col("status") == "ambiguous", F.transform("heads", lambda h: h["node_id"])).alias("candidates"))


def fused_mapping(seeds: DataFrame, choice: DataFrame, nodes: DataFrame) -> DataFrame:
    """(obs_id, node_id) that merges every node bearing a fused seed's name into its biggest, for ``graph.add_edges``."""
    sur = lambda c: N.surname(N.tokens(c))
    fused = choice.where("status = 'fused'").select("name", F.col("node_id").alias("keep"), sur(F.col("name")).alias("_s"))
    own = nodes.select("node_id", "display_name", sur(F.col("display_name")).alias("_s"))
    return own.join(fused, "_s").where(N.could_be_same_name(N.tokens(F.col("display_name")), N.tokens(F.col("name")))).groupBy("node_id").agg(F.min("keep").alias("keep")).select(F.col("node_id").alias("obs_id"), F.col("keep").alias("node_id"))
