"""Order-dependent and iterative operators against plain versions on small inputs."""

import random
import time

import pytest
from pyspark.sql import functions as F

from hopweave import dictionaries as D
from hopweave.api import Conflict, Engine, NotReady, UnknownJob
from hopweave.operators import graph, ordered, search
from hopweave.plans.queries import PAGES
from hopweave.sources import providers, seeds
from hopweave.streaming.ingest import Ingest

OBS = "obs_id long, name string, url string, attributes map<string,array<string>>, canonical_urls array<string>, provenance_name string"


def near(xs, ys):
    return any(x == y or (min(len(x), len(y)) > 3 and (x in y or y in x)) for x in xs for y in ys)


def plain_resolution(rows, threshold=3):
    """The ladder over employers alone, for one name key and one spelling."""
    nodes, out = [], {}
    clash = lambda a, b: bool(a and b and not near(a, b))
    for i, url, employers in rows:
        for n in nodes:
            heads = []
            for m in nodes:
                if all(clash(m["e"], h) for h in heads):
                    heads.append(set(m["e"]))
            if not clash(n["e"], employers) and (url in n["u"] or (near(n["e"], employers) and len(heads) < threshold)):
                n["u"].add(url)
                n["e"] |= employers
                out[i] = n["id"]
                break
        else:
            nodes.append({"id": i, "u": {url}, "e": set(employers)})
            out[i] = i
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_ordered_resolution_matches_plain_version(spark, seed):
    rnd = random.Random(seed)
    names = ["Acme", "Globex", "Initech", "Umbrella"]
    rows = [(i, f"u{rnd.randrange(8)}", set(rnd.sample(names, rnd.choice([0, 1, 1, 2])))) for i in range(40)]
    obs = spark.createDataFrame([(i, "Pat Vance", u, {"employer": sorted(e)}, [], None) for i, u, e in rows], OBS)
    got = {r.obs_id: r.node_id for r in ordered.resolve_in_order(obs, "obs_id").collect()}
    assert got == plain_resolution([(i, u, {x.lower() for x in e}) for i, u, e in rows])


@pytest.mark.parametrize("seed", range(60))
def test_indexed_names_match_row_by_row_ladder(seed):
    """Every rung, several spellings of a name, merged nodes that change, refusals: the places found are those of a walk over all nodes."""
    rnd = random.Random(seed)
    some = lambda xs, most: rnd.sample(xs, rnd.randint(0, most))
    wide, threshold = rnd.choice([3, 30]), rnd.choice([2, 3])
    orgs, nodes, heads = ["acme", "acmeltd", "globex", "initech", "ibm", "umbrella"], [], lambda: ordered.readings([n.org for n in nodes], threshold) >= threshold
    spelled, name, merged = [("pat vance", "pat"), ("p vance", "p"), ("patricia vance", "patricia"), ("paul vance", "paul")], ordered._Name(threshold), 0
    name.REMEMBERED = rnd.choice([5, 1_000_000])
    for i in range(150):
        norm, given = rnd.choice(spelled[: rnd.choice([1, 4])])
        row = {"obs_id": i, "url": f"u{rnd.randrange(wide)}", "canonical": some(["x", "y", "z"], 1) if rnd.random() < 0.1 else [], "near": some(orgs, 1), "norm": norm, "given": given, "last": "vance"}
        row |= {"forms": [given] + (["pat"] if given == "patricia" else []), "sought": rnd.random() < 0.05, "refused": some(list(range(i)), min(i, 2)) if rnd.random() < 0.3 else []}
        for k in D.COMPARED_KEYS:
            row[f"has_{k}"] = some(orgs, rnd.choice([0, 1, 1, 2]))
        for k in D.EXCLUSIVE_KEYS:
            row[f"org_{k}"] = some(row[f"has_{k}"], len(row[f"has_{k}"])) if f"has_{k}" in row else some(orgs, 1)
        at, blocked = None, 0
        for j, n in enumerate(nodes):
            if n.could_be(row):
                if ordered._rung(n, heads, row)[1]:
                    at = j
                    break
                blocked += 1
        kind = repr([(k, v) for k, v in row.items() if k[:4] in ("norm", "give", "last", "form", "soug", "has_", "org_")])
        assert name.place(row, (kind,)) == (at, blocked)
        assert name.crowded() == heads()
        if at is None:
            nodes.append(ordered._Node(row))
            name.open(row)
        else:
            merged += 1
            nodes[at].add(row)
            name.add(at, row)
    assert merged and len(nodes) > 1


def test_ordered_resolution_of_a_hot_name(spark):
    """8,000 rows of one name, most of which stay apart: about 32 million comparisons node by node."""
    rows = spark.range(8000).selectExpr("id obs_id", "'Pat Vance' name", "concat('u', id % 4000) url", "map('employer', array(concat('Firm ', char(65 + id % 20)))) attributes", "cast(array() as array<string>) canonical_urls", "cast(null as string) provenance_name")
    start = time.time()
    assert ordered.resolve_in_order(rows, "obs_id").where("node_id = obs_id").count() == 4000
    assert time.time() - start < 40


def test_ordered_resolution_rungs(spark):
    one = {"employer": ["Acme"]}
    rows = [
        (1, "Pat Vance", "u1", one, ["p"], None),
        (2, "P. Vance", "u2", {"employer": ["Globex"]}, ["p"], None),
        (3, "Pat Vance", "u3", {}, [], "Pat Vance"),
        (4, "Pat Vance", "u4", {}, [], None),
        (5, "Pat Vance", "u5", one, [], None),
        (6, "", "u6", one, None, None),
        (7, None, "u6", None, None, None),
        (8, "Pat Vance", "u8", {"employer": ["Initech"]}, [], None),
    ]
    obs = spark.createDataFrame(rows, OBS)
    got = {r.obs_id: (r.node_id, r.basis) for r in ordered.resolve_in_order(obs, "obs_id").collect()}
    assert got[2] == (1, "same_canonical_url") and got[3] == (1, "search_provenance") and got[4] == (4, "opened")
    assert got[5] == (1, "rare_name_attributes") and got[6] == (6, "opened") and got[7] == (7, "opened") and got[8] == (8, "opened")
    no = spark.createDataFrame([(1, 5, " NO ")], "node_id long, obs_id long, verdict string")
    assert {r.obs_id: r.node_id for r in ordered.resolve_in_order(obs, "obs_id", verdicts=no).collect()}[5] == 5
    assert ordered.resolve_in_order(obs.limit(0), "obs_id").count() == 0


def test_seed_choice(spark):
    cols = "node_id long, display_name string, name_variants array<string>, attributes map<string,array<string>>, urls array<string>, canonical_urls array<string>, observations long"
    nodes = spark.createDataFrame([(1, "Pat Vance", [], {"employer": ["Acme"]}, ["https://acme.com/x"], [], 5), (2, "Pat Vance", [], {"employer": ["Globex"]}, ["https://globex-prep.com"], [], 3), (3, "P. Vance", ["Pat Vance"], {}, [], [], 1), (4, "Ann Lee", [], {}, [], [], 1)], cols)
    asked = [("Pat Vance", None, False), ("Patricia Vance", "Globex Prep", False), ("P. Vance", None, True), ("Nobody Here", None, False), ("Ann Lee", None, False)]
    s = spark.createDataFrame(asked, "name string, context string, famous boolean")
    choice = ordered.seed_choice(s, nodes)
    got = {r.name: (r.status, r.node_id, r.readings, r.candidates) for r in choice.collect()}
    assert got["Pat Vance"] == ("ambiguous", None, 2, [1, 2]) and got["Patricia Vance"][:2] == ("chosen", 2)
    assert got["P. Vance"][:3] == ("fused", 1, 2) and got["Nobody Here"] == ("none", None, 0, None) and got["Ann Lee"][:3] == ("chosen", 4, 1)
    assert {(r.obs_id, r.node_id) for r in ordered.fused_mapping(s, choice, nodes).collect()} == {(1, 1), (2, 1), (3, 1)}
    # the most observed node says nothing about itself: as the head of the first reading it contradicts nobody
    mute = nodes.withColumn("observations", F.when(F.col("node_id") == 3, 9).otherwise(F.col("observations")).cast("long"))
    got = {r.name: (r.status, r.node_id, r.readings) for r in ordered.seed_choice(s, mute).collect()}
    assert got["Pat Vance"] == ("chosen", 3, 1) and got["Patricia Vance"] == ("chosen", 2, 1)


def _random_graph(spark, seed, n=40, m=90):
    rnd = random.Random(seed)
    pairs = sorted({(a, b) for a, b in ((rnd.randrange(n), rnd.randrange(n)) for _ in range(m)) if a != b})
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "edge_id long, src long, dst long")
    adj = {}
    for a, b in pairs:
        adj.setdefault(a, set()).add(b)
        adj.setdefault(b, set()).add(a)
    return df, adj


def test_staged_search_matches_plain_version(spark):
    edges, adj = _random_graph(spark, 5, 60, 160)
    score = {v: (v * 7) % 5 for v in adj}
    origin, target = 0, 59
    verdict = {v: ("no", "yes", "unknown")[v % 3] for v in adj}
    rank = lambda vs, k: sorted(vs, key=lambda v: (score[v], v))[:k]
    tier0 = rank(adj[origin] - {origin, target}, 3)
    held, tier1 = {origin, target, *tier0}, []
    for p in tier0:
        kept = rank(adj[p] - held, 2)
        held |= set(kept)
        tier1 += kept
    by = sorted(tier1, key=lambda v: ({"yes": 0, "unknown": 1, "no": 2}[verdict[v]], tier1.index(v)))
    pursued = [v for v in by if verdict[v] != "no"][:3] or by[:3]
    tier2 = rank(set().union(*[adj[v] for v in pursued]) - held if pursued else set(), 3)
    scores = spark.createDataFrame(list(score.items()), "node long, recurrence long")
    said = spark.createDataFrame(list(verdict.items()), "node long, answer string")
    got = search.staged_search(edges, scores, origin, target, said, cap=3, per_parent=2, pursue=3).orderBy("tier", "rank").collect()
    assert [[r.node for r in got if r.tier == t] for t in range(3)] == [tier0, tier1, tier2]
    alone = search.staged_search(edges, scores, 999, target)
    assert alone.count() == 0


def test_bidirectional_search_expands_until_the_bonus_level(spark):
    edges = spark.createDataFrame([(i, i, i + 1) for i in range(12)], "edge_id long, src long, dst long")
    scores = spark.createDataFrame([], "node long, recurrence long")
    expanded, known = search.bidirectional_search(edges, scores, 0, 12, 6, 6)
    level = {r.node: r.level for r in expanded.collect()}
    assert level[0] == 0 and level[12] == 0 and all(level[v] == v for v in range(5)) and max(level.values()) <= 5
    paths = graph.meet(graph.traverse(known, spark.createDataFrame([(0,)], "node long"), 8), graph.traverse(known, spark.createDataFrame([(12,)], "node long"), 8))
    assert paths.first().nodes == list(range(13))


def test_searches_share_stored_edges_and_ask_for_few_degrees(spark):
    rows = [(i, i, i + 1) for i in range(12)] + [(100 + i, 500 + i, 900 + i) for i in range(50)]
    edges = graph.stored(spark.createDataFrame(rows, "edge_id long, src long, dst long"))
    asked = set()

    def degrees(of):
        asked.update(r.node for r in of.collect())
        return graph.step(of, edges).groupBy("node").agg(F.countDistinct("neighbour").alias("recurrence"))

    expanded, _ = search.bidirectional_search(edges, degrees, 0, 4, 2, 2)
    assert {r.node for r in expanded.collect()} >= {0, 1, 3, 4} and asked <= set(range(13))
    assert graph.traverse(edges, spark.createDataFrame([(500,)], "node long"), 3).count() == 2 and edges.count() == 62


@pytest.mark.parametrize("seed", [1, 2])
def test_resolution_by_kinds_has_the_components_of_all_pairs(spark, seed):
    from hopweave.operators import resolve
    from hopweave.operators.components import connected_components

    rnd = random.Random(seed)
    some = lambda xs: [x for x in xs if rnd.random() < 0.25]
    rows = [(i, rnd.choice(["Pat Vance", "P. Vance", "Patricia Vance", "Paul Vance", "Bo Chen", "Cy Dorn", ""]), rnd.choice([f"u{rnd.randrange(60)}", None]), {"employer": some(["Acme", "Globex", "Initech"]), "institution": some(["Oxford"])}, [f"p{rnd.randrange(40)}"] if rnd.random() < 0.1 else [], "Pat Vance" if rnd.random() < 0.05 else None, some(["Acme"]) if i % 5 == 0 else []) for i in range(160)]
    obs = spark.createDataFrame(rows, OBS + ", neighbour_orgs array<string>")
    no = [(a, b, rnd.choice(["no", "no", "yes"])) for a in range(0, 160, 3) for b in range(a + 1, 160, 11)]
    for said, threshold in ((None, 3), (spark.createDataFrame(no, "left_id long, right_id long, verdict string"), 9)):
        pairs = {(r.left_id, r.right_id) for r in resolve.decisions(obs, threshold=threshold, verdicts=said).where("allowed").collect()}
        ties = {(r.a, r.b) for r in resolve._links(obs, threshold, said).collect()}
        assert ties <= pairs and len(ties) < len(pairs)
        components = lambda e: {r.node: r.component for r in connected_components(spark.createDataFrame(sorted(e), "a long, b long")).collect()}
        assert components(ties) == components(pairs)


def test_preview_changes(spark):
    a, b = (spark.createDataFrame([(x,) for x in xs], "nodes array<long>") for xs in ([[1, 2], [3]], [[1, 2]]))
    assert search.preview_changed(a, b) and search.preview_changed(b, a) and not search.preview_changed(a, a)


def test_provider_registry(spark):
    assert providers.available() == ["wikidata", "rosters", "edgar", "openalex", "podcasts", "propublica"]
    assert providers.available(("edgar",), {"opencorporates": "t"})[-1] == "opencorporates" and "edgar" not in providers.available(("edgar",))


def test_feed_items(spark, tmp_path):
    f = tmp_path / "feed.xml"
    f.write_text("<rss><channel><title>Show</title><item><title>With Ann Lee</title><description>x</description><link>l1</link></item><item><title>Other</title></item></channel></rss>")
    got = {(r.title, r.link) for r in providers.feed_items(spark, str(f)).collect()}
    assert got == {("With Ann Lee", "l1"), ("Other", None)}


def _pages(spark):
    return spark.createDataFrame([(i, u, t) for i, u, t in PAGES], "page_id long, url string, html string")


def test_seed_import(spark, tmp_path):
    f = tmp_path / "seed.csv"
    f.write_text("target_name,connection_name,relationship_type,source_url\nPriya Raman,Tom Alvarez,x,https://news.example/a\nDana Cole,Priya Raman,x,https://news.example/a\n,Tom,x,https://news.example/a\nA B,C D,x,ftp://no\n")
    pairs = seeds.read_pairs(spark, str(f))
    new, confirmed = seeds.import_pairs(pairs, _pages(spark))
    assert {(r.a, r.confirmed) for r in confirmed.collect()} == {("Priya Raman", True), ("Dana Cole", False)}
    counters = seeds.report(pairs, confirmed, new, _pages(spark))
    assert counters.first().asDict() == {"urls_total": 1, "urls_fetched": 1, "pairs_total": 2, "pairs_confirmed": 1, "pairs_unsupported": 1, "relations_written": 2}
    seeds.write_report(counters, confirmed, str(tmp_path / "report"))
    assert "Dana Cole" in spark.read.text(str(tmp_path / "report")).first().value


def test_ingest_publishes_changes_and_stops(spark, tmp_path):
    published = []

    def routes(ex):
        return ex.select(F.array("subject_name", "object_name").alias("nodes")).distinct()

    sink = Ingest(spark, f"file://{tmp_path}/sink", routes, lambda rows, batch: published.append(batch))
    pages = _pages(spark).withColumn("origin", F.lit(None).cast("string"))
    sink(pages.where("page_id = 2"), 0)
    sink(pages.where("page_id = 1"), 1)
    sink(pages.where("page_id = 1"), 1)  # a repeated batch replaces itself
    assert sink.extractions().count() == 2 and published == [1]
    far = spark.createDataFrame([(9, "https://far.example/", PAGES[0][2].replace("Priya Raman", "Ann Lee").replace("Tom Alvarez", "Bo Chen").replace("Dana Cole", "Cy Dorn"), None)], "page_id long, url string, html string, origin string")
    sink(far, 2)  # an island: nobody on it is known
    assert sink.extractions().count() == 2
    sink(far.withColumn("origin", F.lit("Ann Lee")), 3)
    assert sink.extractions().count() == 3 and published == [1, 3]
    sink.finish()
    sink(pages, 4)
    assert sink.log[-1] == (4, "skipped")


def test_jobs_and_roster(spark, tmp_path):
    e = Engine(spark, _pages(spark))
    with pytest.raises(UnknownJob):
        e.result("none")
    job = e.submit("Priya Raman", "Dana Cole")
    if e.job(job)["status"] == "running":
        with pytest.raises(NotReady):
            e.result(job)
    for _ in range(600):
        if e.job(job)["status"] != "running":
            break
        time.sleep(0.2)
    [route] = e.result(job)
    assert route.length == 2 and e.list_jobs()[0]["status"] == "done"
    with pytest.raises(Conflict):
        e.finish(job)
    assert e.evict(3600) == 0 and e.evict(0) == 1 and e.list_jobs() == []
    f = tmp_path / "c.csv"
    f.write_text("First Name,Last Name,URL,Company,Position,Connected On\nAda,Byron,u1,Acme,Engineer,1 Jan\n")
    with pytest.raises(Conflict):
        e.roster.upload(str(f))
    with pytest.raises(ValueError):
        e.roster.set_operator(" ")
    e.roster.set_operator("Me")
    assert e.roster.upload(str(f)) == {"created": 1, "updated": 0, "skipped": 0}
    assert e.roster.upload(str(f)) == {"created": 0, "updated": 0, "skipped": 1}
    assert e.roster.contacts("acm").count() == 1
    assert e.roster.match(spark.createDataFrame([("Ada Byron",)], "name string")).first().status == "exact"
    assert e.roster.clear() == 1 and e.roster.contacts().count() == 0


def test_searches_read_all_lines_of_all_orders(spark):
    from hopweave.plans.queries import QUERIES, _evidence, _seeds

    o, l = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").toPandas() for t in ("orders", "lineitem"))
    both = l.merge(o, left_on="l_orderkey", right_on="o_orderkey")
    e = _evidence(spark, "/root/testdata/sf0.001").toPandas()
    assert len(e) == len(both) and set(zip(e.src, e.dst)) == {(f"c{a}", f"s{b}") for a, b in zip(both.o_custkey, both.l_suppkey)}
    s, known = _seeds(spark, "/root/testdata/sf0.001").first(), {i: {a, b} for i, a, b in zip(e.edge_id, e.src, e.dst)}
    assert (s.a, s.b) == (both.o_custkey.min(), both.o_custkey.max())
    paths = QUERIES["g11_paths"](spark, "/root/testdata/sf0.001").collect()
    assert paths
    for p in paths:
        assert (p.nodes[0], p.nodes[-1]) == (f"c{s.a}", f"c{s.b}") and all(known[i] == {x, y} for i, x, y in zip(p.edges, p.nodes, p.nodes[1:]))


def test_replay_for_all_customers(spark):
    from hopweave.plans.queries import QUERIES

    o = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").where("o_orderdate >= '1998-01-01'").select("o_custkey").distinct().toPandas().o_custkey
    got = QUERIES["j5_replayed_relations"](spark, "/root/testdata/sf0.001").toPandas()
    assert set(got.provenance_name) == {f"Customer {c}" for c in o}


def test_names_of_whole_tables(spark):
    from hopweave.plans.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    c, s = (spark.read.parquet(f"{sf}/{t}.parquet").toPandas() for t in ("customer", "supplier"))
    got = QUERIES["j1_j2_roster_match"](spark, sf).toPandas().set_index("name").status
    assert set(c.c_name) | set(s.s_name) <= set(got.index) and (got[list(set(c.c_name))] == "exact").all()


def test_pairs_look_up_what_their_kinds_are(spark, monkeypatch):
    from hopweave.functions import attrs as A
    from hopweave.functions import names as N
    from hopweave.operators import resolve

    rnd = random.Random(11)
    some = lambda xs: [x for x in xs if rnd.random() < 0.4]
    rows = [(i, rnd.choice(["Pat Vance", "P. Vance", "Patricia Vance", "Paul Vance", "Bo Chen", ""]), rnd.choice([f"u{rnd.randrange(9)}", None]), {"employer": some(["Acme", "Globex"]), "institution": some(["Oxford"])}, [f"p{rnd.randrange(9)}"] if rnd.random() < 0.2 else [], rnd.choice(["Pat Vance", None, None, None]), some(["Acme"]) if i % 5 == 0 else []) for i in range(120)]
    obs = spark.createDataFrame(rows, OBS + ", neighbour_orgs array<string>")
    said = spark.createDataFrame([(a, b, rnd.choice(["no", "yes"])) for a in range(0, 120, 2) for b in range(a + 1, 120, 7)], "left_id long, right_id long, verdict string")
    keyed = obs.withColumn("t", N.tokens(F.col("name"))).withColumn("block", N.name_key(F.col("t"))).where("block <> ''")
    a, b = (keyed.select("block", F.struct(*keyed.columns).alias(s)) for s in "ab")
    of = lambda s, k: F.coalesce(F.try_element_at(F.col(f"{s}.attributes"), F.lit(k)), F.array().cast("array<string>"))
    pairs = a.join(b, "block").where("a.obs_id < b.obs_id").where(N.could_be_same_name(F.col("a.t"), F.col("b.t"))).join(said, (F.col("a.obs_id") == F.col("left_id")) & (F.col("b.obs_id") == F.col("right_id")), "left").join(resolve.clusters(resolve._own(obs), 3), "block")
    x, y = F.col("a.attributes"), F.col("b.attributes")
    step = resolve.ladder(A.conflict(x, y).isNotNull(), F.size(A.matching_keys(x, y)) > 0, F.coalesce(F.arrays_overlap("a.canonical_urls", "b.canonical_urls"), F.lit(False)), F.col("a.url") == F.col("b.url"), N.could_be_same_name(N.tokens(F.col("b.provenance_name")), F.col("b.t")), F.col("clusters"), A.overlaps(F.col("a.neighbour_orgs"), F.concat(of("b", "employer"), of("b", "institution"))), F.col("verdict"))
    plain = sorted(map(tuple, pairs.select(F.col("a.obs_id").alias("l"), F.col("b.obs_id").alias("r"), step.alias("d")).select("l", "r", "d.*").collect()))
    assert len({p[2] for p in plain}) >= 6 and len({p[3] for p in plain if p[2] == "rare_name_attributes"} | {p[3] for p in plain if p[2] == "attributes_plus_shared_neighbor"}) == 2
    for part, many in ((256, 2048), (7, 5), (1, 1000)):  # groups of kinds and parts of rows cut nothing
        monkeypatch.setattr(resolve, "PART", part)
        monkeypatch.setattr(resolve, "ROWS", many)
        assert sorted(map(tuple, resolve.decisions(obs, verdicts=said).collect())) == plain
    # Values are not searched anew for every pair of rows.
    assert "lambda" not in resolve.decisions(obs)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("few", [0, 1000])
def test_replay_deals_hot_keys_by_number_of_rows(spark, monkeypatch, few):
    from hopweave.functions import names as N
    from hopweave.operators import tables

    monkeypatch.setattr(tables, "ROWS", 100, raising=False)
    monkeypatch.setattr(tables, "FEW", few, raising=False)
    rows = [(f"Person {i % 300}", "Pat Hot", f"u{i % 2}", f"Person {i % 300} met Pat Hot", 0, len(f"Person {i % 300} met Pat Hot") + (i % 5 == 0), 100 * (i % 7 > 0)) for i in range(1500)] + [("pat  hot", "Pat HOT", "u", "x", 0, 1, 100), ("No One", "Else Who", "u", "met", 0, 3, 100), ("No One", None, "u", "met", 0, 3, 100)]
    rel = spark.createDataFrame(rows, "subject_name string, object_name string, source_url string, span_text string, span_start int, span_end int, age int")
    rel = rel.withColumns({"subject_key": N.name_key(N.tokens(F.col("subject_name"))), "object_key": N.name_key(N.tokens(F.col("object_name"))), "cached_at": F.timestamp_seconds(F.lit(10_000) - F.col("age"))})
    people = spark.createDataFrame([("Pat Hot",), ("P. Hot",), ("Peter Hot",), (None,), *[(f"Person {i}",) for i in range(0, 300, 3)]], "name string")
    out = search.replay(rel, people, F.timestamp_seconds(F.lit(10_000)), 50)
    got = sorted((r.side, r.name, r.url, r.span_end, r.provenance_name) for r in out.collect())
    good = {(a, u, len(s)) for a, _, u, s, _, e, age in rows[:1500] if age == 0 and e == len(s)}
    assert len(good) > 100 and got == sorted((side, a if side == "subject" else "Pat Hot", u, e, "P. Hot") for a, u, e in good for side in ("subject", "object"))
    # As many tasks as rows ask for, none of them for a hot key: a few tasks whose size grew with the table before.
    fresh = sum(r[-1] == 0 for r in rows)
    sizes = [len(p) for p in tables.lookup_relations(rel, people.select(N.name_key(N.tokens(F.col("name"))).alias("name_key")), F.timestamp_seconds(F.lit(10_000)), 50).rdd.glom().collect()]
    assert len(sizes) >= 2 * fresh / 100 and max(sizes) < 100
