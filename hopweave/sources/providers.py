"""Structured providers over recorded answers: documents worth reading (discoveries) and relationships stated outright (claims).

Discoveries are (person, provider, pos, url, why), claims (subject, object, relation, source_url, source_title, provider, subject_id,
object_id). Every cap is one of the provider's own, per person; ``people`` is (person, orgs array<string>).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hopweave import dictionaries as D
from hopweave.functions import names as N
from hopweave.functions import text as T
from hopweave.sources.recorded import filing_url, first_per, nonprofit_match, top_per


def _discoveries(df: DataFrame, provider: str, pos: Column, url: Column, why: Column) -> DataFrame:
    return df.select("person", F.lit(provider).alias("provider"), pos.cast("long").alias("pos"), url.alias("url"), why.alias("why"))


def _claims(df: DataFrame, provider: str, **cols: Column) -> DataFrame:
    order = ["subject", "object", "relation", "source_url", "source_title", "subject_id", "object_id"]
    return df.select(*[cols[c].alias(c) for c in order[:5]], F.lit(provider).alias("provider"), *[cols[c].alias(c) for c in order[5:]])


# --- entities ------------------------------------------------------------------------------------------------------
def resolve_entities(people: DataFrame, hits: DataFrame, entities: DataFrame, most: int = 5) -> DataFrame:
    """(person, qid): of the first hits(person, pos, qid, description) that are human, the first whose description holds an organisation, else the first."""
    human = entities.where(F.array_contains(F.coalesce(F.try_element_at("claims", F.lit(D.INSTANCE_OF)), F.array().cast("array<string>")), D.HUMAN)).select("qid")
    top = top_per(hits, ["person"], most, "pos").join(human, "qid", "left_semi").join(people, "person")
    about = F.exists(F.coalesce("orgs", F.array().cast("array<string>")), lambda o: (o != "") & F.contains(F.lower(F.coalesce("description", F.lit(""))), F.lower(o)))
    return top.groupBy("person").agg(F.min_by("qid", F.struct((~about).alias("other"), F.col("pos"))).alias("qid"))


def entity_targets(entities: DataFrame) -> DataFrame:
    """(qid, pos, target, relation) of the followed properties in order, each target once, capped."""
    none = F.array().cast("array<string>")
    of = lambda p, r: F.transform(F.coalesce(F.try_element_at("claims", F.lit(p)), none), lambda q: F.struct(q.alias("target"), F.lit(r).alias("relation")))
    flat = entities.withColumn("t", F.filter(F.concat(*[of(p, r) for p, r in D.PROPERTIES.items()]), lambda t: F.coalesce(t["target"], F.lit("")) != ""))
    flat = flat.withColumn("ids", F.transform("t", lambda t: t["target"]))
    once = flat.withColumn("t", F.slice(F.filter("t", lambda t, i: F.array_position("ids", t["target"]) == i + 1), 1, D.MOST_TARGETS))
    return once.select("qid", F.posexplode("t").alias("pos", "t")).select("qid", "pos", "t.target", "t.relation")


def _article_name(label: Column, article: Column) -> Column:
    """An entity without a label carries its bare id; the article's title reads better."""
    return F.when(label.rlike(r"^Q\d+$"), F.replace(F.substring_index(F.coalesce(article, F.lit("")), "/", -1), F.lit("_"), F.lit(" "))).otherwise(label)


def entity_discoveries(found: DataFrame, entities: DataFrame, reverse: DataFrame) -> DataFrame:
    """Own article, articles of organisations that name the person (reverse(qid, pos, org_qid, org_label, relation, article)), articles of the targets."""
    page = lambda title: F.concat(F.lit(D.ARTICLE_URL), F.replace(title, F.lit(" "), F.lit("_")))
    named = entities.where("coalesce(enwiki, '') <> ''")
    own = found.join(named, "qid")
    own = _discoveries(own, "wikidata", F.lit(0), page(F.col("enwiki")), F.concat(F.lit("article for "), "person"))
    back = first_per(found.join(reverse, "qid").where("coalesce(article, '') <> ''"), ["person", "article"], "pos")
    back = _discoveries(back, "wikidata", 1 + F.col("pos"), F.col("article"), F.concat_ws(" ", "person", "relation", _article_name(F.col("org_label"), F.col("article"))))
    ahead = found.join(entity_targets(entities), "qid").join(named.select(F.col("qid").alias("target"), "enwiki", "label"), "target")
    ahead = _discoveries(ahead, "wikidata", 1000 + F.col("pos"), page(F.col("enwiki")), F.concat_ws(" ", "person", "relation", F.coalesce(F.nullif("label", F.lit("")), "enwiki")))
    return own.union(back).union(ahead)


def entity_claims(found: DataFrame, entities: DataFrame, reverse: DataFrame) -> DataFrame:
    """The same properties as stated relationships; a label equal to the subject is none, each organisation counts once."""
    label = entities.select("qid", F.coalesce("label", F.lit("")).alias("label"))
    people = found.join(label, "qid").withColumn("subject", F.coalesce(F.nullif("label", F.lit("")), "person")).select("person", "qid", "subject")
    ahead = people.join(entity_targets(entities), "qid").join(label.withColumnsRenamed({"qid": "target", "label": "object"}), "target").where("object <> '' and lower(object) <> lower(subject)")
    url = lambda q: F.concat(F.lit(D.ENTITY_URL), q)
    title = lambda n, q: F.concat(F.lit("Wikidata: "), n, F.lit(" ("), q, F.lit(")"))
    c = F.col
    ahead = _claims(ahead, "wikidata", subject=c("subject"), object=c("object"), relation=c("relation"), source_url=url(c("qid")), source_title=title(c("subject"), c("qid")), subject_id=c("qid"), object_id=c("target"))
    back = people.join(reverse, "qid").withColumn("object", _article_name(F.trim("org_label"), c("article"))).where("coalesce(object, '') <> '' and lower(object) <> lower(subject)")
    back = first_per(back, ["person", "object"], "pos")
    back = _claims(back, "wikidata", subject=c("subject"), object=c("object"), relation=F.coalesce("relation", F.lit("is involved with")), source_url=url(F.coalesce(F.nullif("org_qid", F.lit("")), "qid")), source_title=title(c("object"), F.coalesce("org_qid", F.lit(""))), subject_id=c("qid"), object_id=c("org_qid"))
    return ahead.union(back)


# --- filings, works, nonprofits, registries, podcasts, rosters -------------------------------------------------------
def filing_discoveries(hits: DataFrame, per_query: int = 8, most: int = 20) -> DataFrame:
    """hits(person, query, pos, hit_id, cik, form, filed, filer), query 0 for the person and 1, 2 for organisations: prose forms, each URL once."""
    top = top_per(hits.where(F.col("query") <= 2), ["person", "query"], per_query, "pos")
    prose = reduce(lambda a, b: a | b, [F.startswith(F.coalesce("form", F.lit("")), F.lit(p)) for p in D.PROSE_FORMS])
    parts = F.split("hit_id", ":", 2)
    whole = (F.coalesce(parts[0], F.lit("")) != "") & (F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("")) != "") & (F.coalesce("cik", F.lit("")) != "")
    good = first_per(top.where(prose & whole).withColumn("url", filing_url(F.col("hit_id"), F.col("cik"))), ["person", "url"], "query", "pos")
    capped = top_per(good, ["person"], most, "query", "pos")
    return _discoveries(capped, "edgar", F.col("query") * 1000 + F.col("pos"), F.col("url"), F.concat_ws(" ", "form", "filed", F.lit("filed by"), F.trim(F.regexp_replace("filer", r"\s\([A-Z]{1,6}\)", ""))))


def institution_tokens(name: Column) -> Column:
    words = F.transform(F.split(F.lower(name), r"\s+"), lambda t: F.regexp_replace(t, "^[,.]+|[,.]+$", ""))
    return F.array_distinct(F.filter(words, lambda t: ~t.isin(D.INSTITUTION_NOISE) & (F.length(t) > 2)))


def resolve_authors(people: DataFrame, authors: DataFrame, most: int = 5) -> DataFrame:
    """(person, author_id, author): of authors(person, pos, author_id, display_name, institutions, works_count) the first whose institutions share a word with
    the person's organisations; nobody where none does; without organisations the top hit, unless it is one of several and has fewer than three works."""
    none = F.array().cast("array<string>")
    words = lambda xs: F.array_distinct(F.flatten(F.transform(F.coalesce(xs, none), institution_tokens)))
    top = top_per(authors, ["person"], most, "pos").join(people, "person").withColumn("wanted", words(F.col("orgs")))
    top = top.withColumn("fits", F.coalesce(F.arrays_overlap("wanted", words(F.col("institutions"))), F.lit(False)))
    one = top.groupBy("person").agg(F.min(F.struct((~F.col("fits")).alias("other"), "pos", "author_id", "display_name", F.coalesce("works_count", F.lit(0)).alias("works"), F.size("wanted").alias("w"))).alias("m"), F.count("*").alias("n"))
    ok = F.when(F.col("m.w") > 0, ~F.col("m.other")).otherwise((F.col("n") == 1) | (F.col("m.works") >= 3))
    return one.where(ok).select("person", "m.author_id", F.col("m.display_name").alias("author"))


def work_discoveries(found: DataFrame, works: DataFrame, most: int = 10, fewest_authors: int = 2, most_authors: int = 30) -> DataFrame:
    """Most cited works(author_id, work_id, cited_by, authors array, landing_page, doi, title); a number of authors out of range drops a work, not its place."""
    top = top_per(found.join(works, "author_id"), ["person"], most, F.desc("cited_by"), "work_id")
    url = F.coalesce(*[F.nullif(c, F.lit("")) for c in ("landing_page", "doi", "work_id")])
    good = top.where(F.size("authors").between(fewest_authors, most_authors)).withColumn("url", url).where("url is not null")
    return _discoveries(good, "openalex", -F.col("cited_by"), F.col("url"), F.concat_ws(" ", "author", F.lit("co-authored"), F.left(F.col("title"), F.lit(90)), F.lit("with"), (F.size("authors") - 1).cast("string"), F.lit("others")))


def nonprofit_tokens(name: Column) -> Column:
    words = F.split(F.replace(N.fold(name), F.lit(","), F.lit(" ")), r"\s+")
    return F.array_distinct(F.filter(words, lambda t: ~t.isin(D.NONPROFIT_NOISE) & (F.length(t) > 2)))


def nonprofit_discoveries(people: DataFrame, found: DataFrame, most_orgs: int = 3, looked_at: int = 10, most: int = 2) -> DataFrame:
    """found(org, pos, name, ein) answers to organisations of two words or more whose words it holds, with one more at most."""
    asked = people.select("person", F.posexplode(F.slice(F.coalesce("orgs", F.array().cast("array<string>")), 1, most_orgs)).alias("i", "org")).where(F.size(F.split(F.trim("org"), r"\s+")) >= 2)
    hits = asked.join(found.where(F.col("pos") < looked_at), "org").withColumn("w", nonprofit_tokens(F.col("org"))).withColumn("f", nonprofit_tokens(F.col("name")))
    good = top_per(hits.where((F.coalesce("ein", F.lit("")) != "") & (F.size("w") > 0) & nonprofit_match(F.col("w"), F.col("f"))), ["person", "i"], most, "pos")
    once = first_per(good, ["person", "ein"], "i", "pos")
    return _discoveries(once, "propublica", F.col("i") * 1000 + F.col("pos"), F.concat(F.lit(D.NONPROFIT_URL), "ein"), F.concat(F.lit("filings of "), "name"))


def officer_companies(officers: DataFrame, most: int = 5) -> DataFrame:
    """The first companies of officers(person, pos, jurisdiction, number, company) that have both parts of a registry number."""
    ok = officers.where("coalesce(jurisdiction, '') <> '' and coalesce(number, '') <> ''")
    return top_per(ok, ["person"], most, "pos").withColumn("url", F.concat(F.lit(D.COMPANY_URL), "jurisdiction", F.lit("/"), "number"))


def officer_discoveries(officers: DataFrame) -> DataFrame:
    return _discoveries(first_per(officer_companies(officers), ["person", "url"], "pos"), "opencorporates", F.col("pos"), F.col("url"), F.concat_ws(" ", "person", F.lit("listed as an officer of"), "company"))


def officer_claims(officers: DataFrame) -> DataFrame:
    one = first_per(officer_companies(officers).where("coalesce(company, '') <> ''"), ["person", "company"], "pos")
    number = F.concat("jurisdiction", F.lit("/"), "number")
    return _claims(one, "opencorporates", subject=F.col("person"), object=F.col("company"), relation=F.lit("is a registered officer of"), source_url=F.col("url"), source_title=F.concat(F.lit("OpenCorporates: "), "company", F.lit(" ("), number, F.lit(")")), subject_id=F.lit(None).cast("string"), object_id=number)


def feed_items(spark: SparkSession, path: str) -> DataFrame:
    """(title, description, link) of the items of RSS files."""
    return spark.read.format("xml").option("rowTag", "item").schema("title string, description string, link string").load(path)


def podcast_discoveries(shows: DataFrame, episodes: DataFrame, most_shows: int = 3, most: int = 6) -> DataFrame:
    """Episodes(feed_url, pos, title, description, link) of a person's first shows(person, pos, feed_url, show) whose title or description names the person."""
    own = top_per(shows.where("coalesce(feed_url, '') <> ''"), ["person"], most_shows, "pos").withColumnRenamed("pos", "place")
    text = F.concat_ws(" ", F.trim(F.coalesce("title", F.lit(""))), F.regexp_replace(F.coalesce("description", F.lit("")), "<[^>]+>", " "))
    hits = own.join(episodes.where("coalesce(trim(link), '') <> ''"), "feed_url").where(F.contains(N.fold(text), N.fold(F.col("person"))))
    once = first_per(top_per(hits, ["person", "place"], most, "pos"), ["person", "link"], "place", "pos")
    capped = top_per(once, ["person"], most, "place", "pos")
    return _discoveries(capped, "podcasts", F.col("place") * 1000 + F.col("pos"), F.trim("link"), F.concat_ws(" ", "show", F.lit("episode:"), F.left(F.trim("title"), F.lit(70))))


def roster_discoveries(people: DataFrame, live: DataFrame, most_orgs: int = 2, tried: int = 6) -> DataFrame:
    """Team-page paths under the first guessed host that answers; live(host, final_url) records those that do."""
    asked = people.select("person", F.posexplode(F.slice(F.coalesce("orgs", F.array().cast("array<string>")), 1, most_orgs)).alias("i", "org"))
    guess = asked.select("person", "i", "org", F.posexplode(F.slice(T.domain_candidates(F.col("org"), D.TLDS), 1, tried)).alias("rank", "host"))
    first = first_per(guess.join(live, "host"), ["person", "i"], "rank")
    paths = first.select("person", "i", "org", F.regexp_replace("final_url", "/+$", "").alias("base"), F.posexplode(F.array(*map(F.lit, D.TEAM_PATHS))).alias("p", "path"))
    return _discoveries(paths, "rosters", F.col("i") * 100 + F.col("p"), F.concat("base", "path"), F.concat(F.lit("team-page path for "), "org"))


# --- the registry --------------------------------------------------------------------------------------------------
#: In the order in which they are consulted; each with the recorded tables it reads.
PROVIDERS = {
    "wikidata": lambda people, t: entity_discoveries(resolve_entities(people, t["entity_hits"], t["entities"]), t["entities"], t["entity_reverse"]),
    "rosters": lambda people, t: roster_discoveries(people, t["live_hosts"]),
    "edgar": lambda people, t: filing_discoveries(t["filing_hits"].join(people.select("person"), "person", "left_semi")),
    "openalex": lambda people, t: work_discoveries(resolve_authors(people, t["authors"]), t["works"]),
    "podcasts": lambda people, t: podcast_discoveries(t["shows"].join(people.select("person"), "person", "left_semi"), t["episodes"]),
    "propublica": lambda people, t: nonprofit_discoveries(people, t["nonprofits"]),
    "opencorporates": lambda people, t: officer_discoveries(t["officers"].join(people.select("person"), "person", "left_semi")),
}
ASSERTING = {
    "wikidata": lambda people, t: entity_claims(resolve_entities(people, t["entity_hits"], t["entities"]), t["entities"], t["entity_reverse"]),
    "opencorporates": lambda people, t: officer_claims(t["officers"].join(people.select("person"), "person", "left_semi")),
}


def available(disabled: tuple[str, ...] = (), tokens: dict[str, str] | None = None) -> list[str]:
    """Providers in order that are switched on; the company registry needs a token."""
    return [p for p in PROVIDERS if p not in disabled and (p != "opencorporates" or (tokens or {}).get(p, "").strip())]


def discover(people: DataFrame, recorded: dict[str, DataFrame], names: list[str], seen: DataFrame | None = None, most: int = 6) -> DataFrame:
    """The first documents of each provider and person, each URL once for the whole job."""
    parts = [PROVIDERS[n](people, recorded).withColumn("_rank", F.lit(i)) for i, n in enumerate(names)]
    every = top_per(reduce(DataFrame.unionByName, parts), ["person", "provider"], most, "pos", "url")
    once = first_per(every, ["url"], "person", "_rank", "pos").drop("_rank")
    return once if seen is None else once.join(seen.select("url"), "url", "left_anti").select(*once.columns)


def assert_relations(people: DataFrame, recorded: dict[str, DataFrame], names: list[str]) -> DataFrame:
    return reduce(DataFrame.unionByName, [ASSERTING[n](people, recorded) for n in names if n in ASSERTING])
