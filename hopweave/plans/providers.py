"""Queries of the structured providers over answers made of the given tables, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hopweave.plans.registry import query
from hopweave.plans.registry import table as _t
from hopweave.sources import providers as P

_POS_SQL = "row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)"


def _orders(spark, sf) -> DataFrame:
    """Orders as a customer's list of answers, in order of their key."""
    pos = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey"))
    return _t(spark, sf, "orders").withColumn("pos", pos).withColumn("person", F.concat(F.lit("Customer "), F.col("o_custkey").cast("string")))


def _people(spark, sf) -> DataFrame:
    c = _t(spark, sf, "customer").join(_t(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.select(F.concat(F.lit("Customer "), F.col("c_custkey").cast("string")).alias("person"), F.when(F.col("c_custkey") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("University of "), F.initcap("n_name")))).alias("orgs"))


# --- entities ------------------------------------------------------------------------------------------------------
def _entities(spark, sf) -> DataFrame:
    """An entity per order: human unless urgent, two employers (one twice), an article for two of three."""
    k = F.col("o_orderkey")
    q = lambda c: F.concat(F.lit("Q"), c.cast("string"))
    claims = F.create_map(F.lit("P31"), F.array(F.when(F.col("o_orderpriority") == "1-URGENT", "Q43229").otherwise("Q5")), F.lit("P108"), F.array(q(k + 1), q(k + 2), q(k + 1)), F.lit("P26"), F.array(q(k + 2)), F.lit("P39"), F.array(q(k + 3)))
    return _t(spark, sf, "orders").select(q(k).alias("qid"), F.concat(F.lit("Entity "), k.cast("string")).alias("label"), F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("Article "), k.cast("string"))).alias("enwiki"), claims.alias("claims"))


def _hits(spark, sf) -> DataFrame:
    return _orders(spark, sf).select("person", "pos", F.concat(F.lit("Q"), F.col("o_orderkey").cast("string")).alias("qid"), F.when(F.col("o_orderstatus") == "O", "works at the University of France and the University of China").otherwise("a writer").alias("description"))


_ENTITY_SQL = f"""p AS (SELECT c_custkey AS c, CASE WHEN c_custkey % 3 <> 0 AND n_name IN ('FRANCE', 'CHINA') THEN 1 ELSE 0 END AS told FROM customer JOIN nation ON c_nationkey = n_nationkey),
h AS (SELECT o_custkey AS c, o_orderkey AS k, {_POS_SQL} AS pos, o_orderpriority <> '1-URGENT' AS human, o_orderstatus = 'O' AS d FROM orders),
f AS (SELECT c, k FROM h JOIN p USING (c) WHERE pos <= 5 AND human QUALIFY row_number() OVER (PARTITION BY c ORDER BY NOT (told = 1 AND d), pos) = 1)"""


@query("i17_resolved_entities", f"WITH {_ENTITY_SQL} SELECT 'Customer ' || c AS person, 'Q' || k AS qid FROM f")
def i17_resolved_entities(spark, sf):
    return P.resolve_entities(_people(spark, sf), _hits(spark, sf), _entities(spark, sf))


@query("z8_entity_targets", "SELECT 'Q' || o_orderkey AS qid, v.pos::INT AS pos, 'Q' || (o_orderkey + 2 - v.pos) AS target, v.relation FROM orders CROSS JOIN (VALUES (0, 'spouse of'), (1, 'employed by')) v(pos, relation)")
def z8_entity_targets(spark, sf):
    return P.entity_targets(_entities(spark, sf))


def _reverse(spark, sf) -> DataFrame:
    k = F.col("o_orderkey")
    return _t(spark, sf, "orders").select(F.concat(F.lit("Q"), k.cast("string")).alias("qid"), F.lit(0).alias("pos"), F.concat(F.lit("Q9"), k.cast("string")).alias("org_qid"), F.concat(F.lit("Q9"), k.cast("string")).alias("org_label"), F.lit("founded").alias("relation"), F.when(k % 2 == 0, F.concat(F.lit("https://en.wikipedia.org/wiki/Org_"), k.cast("string"))).alias("article"))


@query("s22_entity_documents", f"""WITH {_ENTITY_SQL} SELECT 'Customer ' || c AS person, url FROM (SELECT c, 'https://en.wikipedia.org/wiki/Article_' || k AS url FROM f WHERE k % 3 <> 0
UNION ALL SELECT c, 'https://en.wikipedia.org/wiki/Org_' || k FROM f WHERE k % 2 = 0 UNION ALL SELECT c, 'https://en.wikipedia.org/wiki/Article_' || o_orderkey FROM f JOIN orders ON o_orderkey IN (k + 1, k + 2) WHERE o_orderkey % 3 <> 0)""")
def s22_entity_documents(spark, sf):
    e = _entities(spark, sf)
    return P.entity_discoveries(P.resolve_entities(_people(spark, sf), _hits(spark, sf), e), e, _reverse(spark, sf)).select("person", "url")


@query("s23_entity_claims", f"""WITH {_ENTITY_SQL} SELECT * FROM (SELECT 'Entity ' || k AS subject, 'employed by' AS relation, 'Entity ' || (k + 1) AS object FROM f WHERE k + 1 IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'Entity ' || k, 'spouse of', 'Entity ' || (k + 2) FROM f WHERE k + 2 IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'Entity ' || k, 'founded', 'Org ' || k FROM f WHERE k % 2 = 0)""")
def s23_entity_claims(spark, sf):
    e = _entities(spark, sf)
    return P.entity_claims(P.resolve_entities(_people(spark, sf), _hits(spark, sf), e), e, _reverse(spark, sf)).select("subject", "relation", "object")


# --- filings, works, nonprofits, registries, podcasts, rosters -------------------------------------------------------
@query("s24_filings", f"""WITH h AS (SELECT o_custkey AS c, o_orderkey AS k, o_orderstatus AS s, {_POS_SQL} AS pos FROM orders), t AS (SELECT *, pos % 4 AS q, row_number() OVER (PARTITION BY c, pos % 4 ORDER BY pos) AS r FROM h)
SELECT 'Customer ' || c AS person, 'https://www.sec.gov/Archives/edgar/data/' || (100 + c) || '/' || k || '24/x.htm' AS url FROM t WHERE q <= 2 AND r <= 8 AND s IN ('F', 'O') QUALIFY row_number() OVER (PARTITION BY c ORDER BY q, pos) <= 20""")
def s24_filings(spark, sf):
    form = F.when(F.col("o_orderstatus") == "F", "EX-99.1").when(F.col("o_orderstatus") == "O", "10-K").otherwise("10-Q")
    k = F.col("o_orderkey").cast("string")
    hits = _orders(spark, sf).select("person", (F.col("pos") % 4).alias("query"), "pos", F.concat(k, F.lit("-24:x.htm")).alias("hit_id"), F.concat(F.lit("000"), (100 + F.col("o_custkey")).cast("string")).alias("cik"), form.alias("form"), F.lit("2024-01-01").alias("filed"), F.lit("Acme Inc (ACME)").alias("filer"))
    return P.filing_discoveries(hits).select("person", "url")


@query("i16_resolved_authors", f"""WITH p AS (SELECT c_custkey AS c, CASE WHEN c_custkey % 3 <> 0 THEN n_name END AS org FROM customer JOIN nation ON c_nationkey = n_nationkey),
a AS (SELECT o_custkey AS c, o_orderkey AS k, o_orderstatus = 'F' AS fr, o_orderkey % 6 AS works, {_POS_SQL} AS pos FROM orders), t AS (SELECT *, (fr AND coalesce(org, '') = 'FRANCE') AS fits, count(*) OVER (PARTITION BY c) AS n FROM a JOIN p USING (c) WHERE pos <= 5),
o AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY c ORDER BY NOT fits, pos) = 1) SELECT 'Customer ' || c AS person, 'A' || k AS author_id FROM o WHERE CASE WHEN org IS NOT NULL THEN fits ELSE n = 1 OR works >= 3 END""")
def i16_resolved_authors(spark, sf):
    a = _orders(spark, sf).select("person", "pos", F.concat(F.lit("A"), F.col("o_orderkey").cast("string")).alias("author_id"), F.col("person").alias("display_name"), F.array(F.when(F.col("o_orderstatus") == "F", "National Research Institute, France").otherwise("Nowhere College")).alias("institutions"), (F.col("o_orderkey") % 6).alias("works_count"))
    return P.resolve_authors(_people(spark, sf), a).select("person", "author_id")


@query("s25_works", "WITH w AS (SELECT o_custkey AS c, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 17 DESC, 'W' || o_orderkey) AS r, o_orderkey % 40 AS n FROM orders) SELECT 'Customer ' || c AS person, CASE WHEN k % 2 = 0 THEN 'https://doi.example/' || k ELSE 'W' || k END AS url FROM w WHERE r <= 10 AND n BETWEEN 2 AND 30")
def s25_works(spark, sf):
    o = _orders(spark, sf)
    k = F.col("o_orderkey")
    works = o.select(F.col("person").alias("author_id"), F.concat(F.lit("W"), k.cast("string")).alias("work_id"), (k % 17).alias("cited_by"), F.array_repeat(F.lit("x"), (k % 40).cast("int")).alias("authors"), F.lit("").alias("landing_page"), F.when(k % 2 == 0, F.concat(F.lit("https://doi.example/"), k.cast("string"))).alias("doi"), F.lit("t").alias("title"))
    found = o.select("person", F.col("person").alias("author_id"), F.col("person").alias("author")).distinct()
    return P.work_discoveries(found, works).select("person", "url")


@query("s26_nonprofits", "WITH p AS (SELECT c_custkey AS c, lower(n_name) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 3 <> 0) SELECT 'Customer ' || c AS person, 'https://projects.propublica.org/nonprofits/organizations/' || replace(n, ' ', '') || '-' || v.e AS url FROM p CROSS JOIN (VALUES (1), (2)) v(e)")
def s26_nonprofits(spark, sf):
    people = _people(spark, sf)
    orgs = people.select(F.explode("orgs").alias("org")).distinct()
    ein = lambda i: F.concat(F.replace(F.lower(F.replace("org", F.lit("University of "))), F.lit(" ")), F.lit(f"-{i}"))
    named = [F.concat("org", F.lit(" Christian Church Choir")), F.concat(F.lit("The "), "org"), F.concat("org", F.lit(" Alumni Foundation")), F.concat("org", F.lit(" Inc"))]
    found = orgs.select("org", F.posexplode(F.array(*[F.struct(n.alias("name"), ein(i).alias("ein")) for i, n in enumerate(named)])).alias("pos", "x")).select("org", "pos", "x.name", "x.ein")
    return P.nonprofit_discoveries(people, found).select("person", "url")


def _officers(spark, sf) -> DataFrame:
    return _orders(spark, sf).select("person", "pos", F.when(F.col("o_orderstatus") != "P", "us").alias("jurisdiction"), (F.col("o_orderkey") % 50).cast("string").alias("number"), F.when(F.col("o_orderkey") % 4 == 0, "").otherwise(F.col("o_orderpriority")).alias("company"))


_OFFICER_SQL = f"h AS (SELECT o_custkey AS c, o_orderkey AS k, o_orderstatus AS s, o_orderpriority AS p, {_POS_SQL} AS pos FROM orders), t AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY pos) AS r FROM h WHERE s <> 'P')"


@query("s27_officers", f"WITH {_OFFICER_SQL} SELECT DISTINCT 'Customer ' || c AS person, 'https://opencorporates.com/companies/us/' || k % 50 AS url FROM t WHERE r <= 5")
def s27_officers(spark, sf):
    return P.officer_discoveries(_officers(spark, sf)).select("person", "url")


@query("s27_officer_claims", f"WITH {_OFFICER_SQL} SELECT 'Customer ' || c AS subject, p AS object, 'us/' || k % 50 AS object_id FROM t WHERE r <= 5 AND k % 4 <> 0 QUALIFY row_number() OVER (PARTITION BY c, p ORDER BY pos) = 1")
def s27_officer_claims(spark, sf):
    return P.officer_claims(_officers(spark, sf)).select("subject", "object", "object_id")


@query("s28_podcasts", f"""WITH h AS (SELECT o_custkey AS c, {_POS_SQL} AS pos FROM orders), e AS (SELECT c, pos, row_number() OVER (PARTITION BY c, pos) AS x, v.i FROM h CROSS JOIN (VALUES (0), (1), (2), (3)) v(i) WHERE pos <= 3)
SELECT 'Customer ' || c AS person, 'https://pod.example/' || c || '/' || pos || '/' || i AS url FROM e WHERE i <> 1 QUALIFY row_number() OVER (PARTITION BY c ORDER BY pos, i) <= 6""")
def s28_podcasts(spark, sf):
    o = _orders(spark, sf)
    shows = o.select("person", "pos", F.concat(F.lit("feed/"), F.col("o_custkey").cast("string"), F.lit("/"), F.col("pos").cast("string")).alias("feed_url"), F.lit("Show").alias("show"))
    eps = o.select(F.concat(F.lit("feed/"), F.col("o_custkey").cast("string"), F.lit("/"), F.col("pos").cast("string")).alias("feed_url"), F.upper("person").alias("who"), F.concat(F.lit("https://pod.example/"), F.col("o_custkey").cast("string"), F.lit("/"), F.col("pos").cast("string"), F.lit("/")).alias("u"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("i"))
    eps = eps.select("feed_url", F.col("i").alias("pos"), F.when(F.col("i") == 0, F.concat(F.lit("With "), "who")).otherwise("Talk").alias("title"), F.when(F.col("i") >= 2, F.concat(F.lit("<b>"), "who", F.lit("</b>"))).alias("description"), F.concat("u", F.col("i").cast("string")).alias("link"))
    return P.podcast_discoveries(shows, eps).select("person", "url")


@query("s29_rosters", "WITH p AS (SELECT c_custkey AS c, lower(n_name) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 3 <> 0) SELECT 'Customer ' || c AS person, 'https://www.universityof' || replace(n, ' ', '') || '.io' || v.path AS url FROM p CROSS JOIN (VALUES ('/team'), ('/our-team'), ('/people'), ('/about/team'), ('/leadership'), ('/partners')) v(path)")
def s29_rosters(spark, sf):
    n = _t(spark, sf, "nation").select(F.concat(F.lit("universityof"), F.replace(F.lower("n_name"), F.lit(" "))).alias("stem"))
    live = n.select(F.explode(F.array(F.concat("stem", F.lit(".io")), F.concat("stem", F.lit(".org")))).alias("host")).select("host", F.concat(F.lit("https://www."), "host", F.lit("/")).alias("final_url"))
    return P.roster_discoveries(_people(spark, sf), live).select("person", "url")


@query("w13_provider_documents", f"WITH {_OFFICER_SQL}, d AS (SELECT 'Customer ' || c AS person, 'https://opencorporates.com/companies/us/' || k % 50 AS url FROM t WHERE r <= 5) SELECT min(person) AS person, url FROM d GROUP BY url")
def w13_provider_documents(spark, sf):
    people = _people(spark, sf)
    return P.discover(people, {"officers": _officers(spark, sf)}, P.available(("wikidata", "rosters", "edgar", "openalex", "podcasts", "propublica"), {"opencorporates": "t"})).select("person", "url")
