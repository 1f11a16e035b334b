import collections

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hopweave.api import Engine
from hopweave.functions import names as N
from hopweave.operators import graph, parse, tables
from hopweave.operators.components import connected_components
from hopweave.plans.queries import PAGES, e1_grounding
from hopweave.sources.roster import RosterFormatError, read_roster
from hopweave.streaming.jobs import expired, sweep_seconds


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .!?\n\"JDr1é", max_size=80))
def test_sentence_offsets(text):
    found = parse.split_sentences(text)
    assert all(text[s:e] == t == t.strip() and t for _, s, e, t in found)
    assert [i for i, *_ in found] == list(range(len(found)))
    assert "".join(t for *_, t in found).replace(" ", "").replace("\n", "") == text.replace(" ", "").replace("\n", "")


def test_sentence_boundaries():
    assert [t for *_, t in parse.split_sentences("J. Smith met Dr. Lee. They left.")] == ["J. Smith met Dr. Lee.", "They left."]
    assert len(parse.split_sentences("J.R.R. Tolkien wrote it.")) == 2


def test_furniture_goes_where_it_is_closed(spark):
    body = "<p>" + "Some words of the page. " * 20 + "</p>"
    cases = {
        f"<title>A  b</title><nav>menu</nav>{body}<footer><form>mail</form> foot</footer>": (False, "A b"),
        f"<nav>menu<ul><li>one</ul>{body}": (True, None),  # never closed
        f"<header>top<nav>menu</nav>{body}": (False, None),
        f"<form>menu{body}</form>": (True, None),  # nothing is left outside
        f"<aside><script>if (a) menu()</script></aside>{body}<script>menu": (False, None),
        f"{body}</nav><nav>me<nav>n</nav>u</nav>": (False, None),
    }
    df = spark.createDataFrame([(i, h) for i, h in enumerate([*cases, None, ""])], "i long, html string").coalesce(1)
    rows = [r.p for r in df.select("i", parse.html_to_text("html").alias("p")).orderBy("i").collect()]
    for r, (html, (menu, title)) in zip(rows, cases.items()):
        assert ("menu" in r.text, r.title, r.text.count("Some words")) == (menu, title, 20), html
    assert [r.text for r in rows[-2:]] == ["", ""] and "mail" not in rows[0].text and "foot" not in rows[0].text


def test_route_and_page_gates(spark):
    pages = spark.createDataFrame([(i, u, t) for i, u, t in PAGES], "page_id long, url string, html string")
    docs = {r.page_id: r.skip_reason for r in parse.documents(pages).collect()}
    assert docs == {1: None, 2: "too_short", 3: "soft_404", 4: None}
    [route] = Engine(spark, pages).connect("Priya Raman", "Dana Cole").collect()
    assert (route.length, route.weakest_basis, route.warning) == (2, "shared_page", None)


def test_grounding_rejects(spark):
    got = {(r.object_name, r.span_text, r.context_before): r.reject_reason for r in e1_grounding(spark, "").collect()}
    assert list(got.values()).count(None) == 1
    assert sorted(v for v in got.values() if v) == ["no_antecedent", "organisation", "span_not_found"]


def test_components(spark):
    edges = [(5, 4), (4, 3), (3, 2), (9, 8), (8, 8), (20, 1000), (1000, 20)] + [(i, i + 1) for i in range(100, 160)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[x] for x in (2, 3, 4, 5)} == {2} and got[9] == 8 and got[1000] == 20 and {got[x] for x in range(100, 161)} == {100}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_traverse_matches_plain_search(spark):
    import random

    random.seed(3)
    edges = [(i, random.randrange(60), random.randrange(60)) for i in range(90)]
    df = spark.createDataFrame([(i, a, b, "u", 0, 1) for i, a, b in edges], "edge_id long, src long, dst long, source_url string, span_start int, span_end int")
    near = collections.defaultdict(set)
    for _, a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    dist, queue = {0: 0}, [0]
    for v in queue:
        for w in near[v]:
            if dist[v] < 3 and w not in dist:
                dist[w] = dist[v] + 1
                queue.append(w)
    got = {r.node: (r.dist, r.path) for r in graph.traverse(df, spark.createDataFrame([(0,)], "node long"), 3).collect()}
    assert {k: d for k, (d, _) in got.items()} == dist
    assert all(len(p) == d + 1 and p[0] == 0 and p[-1] == k and all(y in near[x] for x, y in zip(p, p[1:])) for k, (d, p) in got.items())


def test_roster_file(spark, tmp_path):
    f = tmp_path / "c.csv"
    f.write_text('Notes:\n"a note, with a comma"\n\nFirst Name,Last Name,URL,Company,Position,Connected On\nAda,Byron,u1,Acme,"VP, Engineering",1 Jan\n,,,,,\nADA,BYRON,u2,Other,x,2 Jan\nBob,Vance,,"two\nlines",y,\n')
    got = {r.norm_name: r for r in read_roster(spark, str(f)).collect()}
    assert set(got) == {"ada byron", "bob vance"} and got["ada byron"].role == "VP, Engineering" and got["bob vance"].company == "two\nlines"
    f.write_text("a,b\n1,2\n")
    with pytest.raises(RosterFormatError):
        read_roster(spark, str(f))


def test_upsert_keeps_what_a_blank_would_erase(spark):
    cols = "norm_name string, name string, role string, company string, profile_url string, connected_on string"
    old = spark.createDataFrame([("a", "A", "r", "c", "", "d")], cols)
    new = spark.createDataFrame([("a", "A2", "", "", "u", "e"), ("b", "B", "", "", "", "")], cols)
    got = {r.norm_name: r for r in tables.upsert_contacts(new, old).collect()}
    assert (got["a"].name, got["a"].company, got["a"].profile_url, got["a"].connected_on, got["a"].action) == ("A", "c", "u", "d", "updated")
    assert got["b"].action == "created"


def test_names(spark):
    row = spark.range(1).select(N.could_be_same_name(N.tokens(F.lit("Bob Vance")), N.tokens(F.lit("Robert Vance"))).alias("a"), N.name_key(N.tokens(F.lit("Müller, Jörg"))).alias("k"), N.looks_like_org(F.lit("NEMUS Bioscience"), N.tokens(F.lit("NEMUS Bioscience"))).alias("o"), N.fold(F.lit("Straße Ñandú")).alias("f")).first()
    assert row.a and row.o and row.f == "strasse nandu" and row.k == "m|jorg"


def test_retention(spark):
    jobs = spark.createDataFrame([(1, "done", 120), (2, "done", 30), (3, "running", 86400), (4, "failed", 99)], "job_id long, status string, age long")
    now = F.lit("2024-01-02").cast("timestamp")
    jobs = jobs.withColumn("updated_at", F.timestamp_seconds(F.unix_timestamp(now) - F.col("age")))
    assert {r.job_id for r in expired(jobs, now, 60).collect()} == {1, 4}
    assert sweep_seconds(6 * 3600) == 300 and sweep_seconds(10) == 1


def test_long_documents_keep_all_sentences(spark):
    text = " ".join(f"Sentence number {i} ends here." for i in range(900))
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert parse.sentences(d, key="doc_id").count() == 900
    assert parse.sentences(d, key="doc_id", most=parse.PAGE_SENTENCES).count() == 400


def test_sentences_and_pages_are_passed_on_in_pieces(spark, monkeypatch):
    import pyarrow as pa

    text = " ".join(f"Sentence number {i} ends here." for i in range(500))
    rows = ((i, s) for i in range(2) for s in parse.split_sentences(text))
    schema = pa.schema([*((c, pa.int32()) for c in ("idx", "start", "end")), ("text", pa.string())])
    monkeypatch.setattr(parse, "HELD", 2000)
    made = list(parse._passed_on(rows, pa.RecordBatch.from_pydict({"doc_id": [7, 8]}), ["doc_id"], schema))
    assert len(made) > 40 and max(b.num_rows for b in made) < 50
    assert [(r["doc_id"], r["idx"]) for b in made for r in b.to_pylist()] == [(d, i) for d in (7, 8) for i in range(500)]


def test_ingest_streams_folders_and_reads_whole_pages(spark, tmp_path):
    from hopweave.plans.queries import QUERIES

    fill = "the rest of the page goes on in lower case without any names at all. " * 5
    far = fill + "".join(f"Line {i} has no people in it. " for i in range(500)) + "Priya Raman hired Tom Alvarez at Acme."
    spark.createDataFrame([(1, "https://a.example/", f"<p>{far}</p>")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = QUERIES["e5_stream_ingest"](spark, str(tmp_path)).collect()
    assert [(r.page_id, r.subject_name, r.object_name) for r in got] == [(1, "Priya Raman", "Tom Alvarez")] and got[0].idx > parse.PAGE_SENTENCES
    spark.range(0).selectExpr("id page_id", "'' url", "'' html").write.parquet(f"{tmp_path}/none/pages.parquet")
    assert QUERIES["e5_stream_ingest"](spark, f"{tmp_path}/none").count() == 0
