"""The engine as one object: path search, roster, relations and jobs over tables."""

from __future__ import annotations

import datetime
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopweave.functions import names as N
from hopweave.operators import graph, parse, resolve, tables
from hopweave.sources.roster import read_roster
from hopweave.storage import discard, materialize, shared_dir

CONTACTS = "norm_name string, name string, role string, company string, profile_url string, connected_on string"


class UnknownJob(KeyError):
    """No such job."""


class NotReady(LookupError):
    """The job has no result yet."""


class JobFailed(RuntimeError):
    """The job ended without a result."""


class Conflict(RuntimeError):
    """The state of things does not allow the request."""


class Roster:
    """The operator and their contacts. Each change is a new table in the shared folder; the one before it is deleted."""

    def __init__(self, spark: SparkSession, contacts: DataFrame | None = None):
        self.spark, self.operator = spark, None
        self.table = contacts if contacts is not None else spark.createDataFrame([], CONTACTS)

    def set_operator(self, name: str) -> dict:
        if not name.strip():
            raise ValueError("the operator's name is blank")
        self.operator = {"name": name.strip(), "updated_at": datetime.datetime.now(datetime.timezone.utc)}
        return self.operator

    def upload(self, path: str) -> dict[str, int]:
        """Counts of created, updated and skipped contacts of one file."""
        if self.operator is None:
            raise Conflict("say who the operator is first")
        after = materialize(tables.upsert_contacts(read_roster(self.spark, path), self.table), "contacts")
        counts = {r.action: r.n for r in after.groupBy("action").agg(F.count("*").alias("n")).collect()}
        old, self.table = self.table, after.drop("action")
        self.table._scratch_path = after._scratch_path
        discard(old)
        return {k: counts.get(k, 0) for k in ("created", "updated", "skipped")}

    def contacts(self, search: str = "", most: int | None = None) -> DataFrame:
        return tables.search_contacts(self.table, search, most)

    def match(self, names: DataFrame, most: int = 500) -> DataFrame:
        return tables.match_names(names.select("name").distinct().orderBy("name").limit(most), self.table)

    def clear(self) -> int:
        """Forget the contacts; their number before."""
        n = self.table.count()
        discard(self.table)
        self.table = self.spark.createDataFrame([], CONTACTS)
        return n


class Engine:
    """connect() answers how two people are connected, from pages alone (no model: degraded extraction, routes on strong pivots only)."""

    def __init__(self, spark: SparkSession, pages: DataFrame, depth_a: int = 2, depth_b: int = 1, most_routes: int = 5):
        self.spark, self.pages, self.depth_a, self.depth_b, self.most_routes = spark, pages, depth_a, depth_b, most_routes
        self.jobs: dict[str, dict] = {}
        self._stop: dict[str, threading.Event] = {}
        self._graph = None
        self.roster = Roster(spark)

    def build(self) -> tuple[DataFrame, DataFrame]:
        """(edges, nodes) of the pages."""
        if self._graph is None:
            docs = materialize(parse.documents(self.pages), "docs")
            ex = parse.degraded_extractions(parse.sentences(docs.where("skip_reason is null"))).join(docs.select("page_id", "url"), "page_id")
            ex = materialize(ex.withColumn("eid", F.xxhash64("url", "span_start", "subject_name", "object_name")), "extractions")
            none = F.create_map().cast("map<string,array<string>>")
            sides = [ex.select(F.xxhash64("eid", F.lit(s)).alias("obs_id"), F.col(f"{s}_name").alias("name"), "url", none.alias("attributes"), F.when(N.looks_canonical_for(F.col("url"), N.tokens(F.col(f"{s}_name"))), F.array("url")).otherwise(F.array().cast("array<string>")).alias("canonical_urls"), F.lit(None).cast("string").alias("provenance_name")) for s in ("subject", "object")]
            obs = materialize(sides[0].union(sides[1]), "observations")
            mapping = materialize(resolve.resolve(obs), "mapping")
            edges = ex.select(F.col("eid").alias("edge_id"), F.xxhash64("eid", F.lit("subject")).alias("src"), F.xxhash64("eid", F.lit("object")).alias("dst"), F.col("url").alias("source_url"), "span_text", "span_start", "span_end", "resolution_basis")
            self._graph = materialize(graph.add_edges(edges, mapping), "edges"), materialize(resolve.nodes(obs, mapping), "nodes")
        return self._graph

    def find(self, name: str) -> DataFrame:
        return self.build()[1].where(N.could_be_same_name(N.tokens(F.col("display_name")), N.tokens(F.lit(name))))

    def connect(self, a: str, b: str) -> DataFrame:
        """Ranked routes between two people."""
        edges, nodes = self.build()
        sides = [graph.traverse(edges, self.find(n).select(F.col("node_id").alias("node")), d + 2) for n, d in ((a, self.depth_a), (b, self.depth_b))]
        paths = materialize(graph.meet(*sides, most=3 * self.most_routes), "paths")
        return graph.routes(paths, edges, nodes, self.most_routes)

    def _job(self, job: str) -> dict:
        if job not in self.jobs:
            raise UnknownJob(job)
        return self.jobs[job]

    def submit(self, a: str, b: str) -> str:
        """Run connect in the background; the job's group can be cancelled."""
        job, now = uuid.uuid4().hex, datetime.datetime.now(datetime.timezone.utc)
        self.jobs[job] = {"job_id": job, "person_a": a, "person_b": b, "status": "running", "routes": None, "preview": [], "error": None, "created_at": now, "updated_at": now}
        self._stop[job] = threading.Event()

        def work():
            self.spark.sparkContext.setJobGroup(job, f"{a} - {b}", interruptOnCancel=True)
            try:
                got = {"status": "done", "routes": self._search(a, b, job)}
            except Exception as e:  # the job's state carries it
                got = {"status": "failed", "error": str(e)[:300]}
            if self.jobs[job]["status"] == "running":
                self.jobs[job] |= got | {"updated_at": datetime.datetime.now(datetime.timezone.utc)}

        threading.Thread(target=work, daemon=True).start()
        return job

    def _search(self, a: str, b: str, job: str) -> list:
        """Deeper and deeper until the depths are used up or the job is asked to finish; routes found on the way are its preview."""
        edges, nodes = self.build()
        full_a, full_b, rows = self.depth_a + 2, self.depth_b + 2, []
        for level in range(1, max(full_a, full_b) + 1):
            sides = [graph.traverse(edges, self.find(n).select(F.col("node_id").alias("node")), min(level, d)) for n, d in ((a, full_a), (b, full_b))]
            paths = materialize(graph.meet(*sides, most=3 * self.most_routes), "paths")
            rows = graph.routes(paths, edges, nodes, self.most_routes).collect()  # most_routes rows
            discard(paths)
            self.jobs[job]["preview"] = rows
            if self._stop[job].is_set():
                break
        return rows

    def list_jobs(self, most: int = 50) -> list[dict]:
        """Newest first; a running job's elapsed time is counted up to now."""
        now = datetime.datetime.now(datetime.timezone.utc)
        best = sorted(self.jobs.values(), key=lambda j: j["created_at"], reverse=True)[:most]
        return [{k: j[k] for k in ("job_id", "person_a", "person_b", "status", "created_at")} | {"elapsed_s": round(((now if j["status"] == "running" else j["updated_at"]) - j["created_at"]).total_seconds(), 2), "routes": len(j["routes"] or j["preview"])} for j in best]

    def job(self, job: str) -> dict:
        return dict(self._job(job))

    def result(self, job: str) -> list:
        state = self._job(job)
        if state["status"] == "failed":
            raise JobFailed(state["error"] or "job failed")
        if state["routes"] is None:
            raise NotReady(state["status"])
        return state["routes"]

    def finish(self, job: str) -> int:
        """Stop at the next checkpoint and keep what is there; the number of routes so far."""
        state = self._job(job)
        if state["status"] != "running":
            raise Conflict(f"job is already {state['status']}")
        self._stop[job].set()
        return len(state["preview"])

    def cancel(self, job: str) -> None:
        """Give a job up; its routes are lost."""
        state = self._job(job)
        if state["status"] == "running":
            state |= {"status": "failed", "error": "cancelled", "updated_at": datetime.datetime.now(datetime.timezone.utc)}
            self.spark.sparkContext.cancelJobGroup(job)

    def evict(self, retention_seconds: float, now: datetime.datetime | None = None) -> int:
        """Forget finished jobs that have been idle for the retention; how many."""
        now = now or datetime.datetime.now(datetime.timezone.utc)
        old = [k for k, j in self.jobs.items() if j["status"] != "running" and (now - j["updated_at"]).total_seconds() >= retention_seconds]
        for k in old:
            del self.jobs[k], self._stop[k]
        return len(old)

    def health(self, relations: DataFrame | None = None) -> dict:
        out = {"ok": True, "degraded": True, "cache_dir": shared_dir(self.spark), "jobs": len(self.jobs)}
        if relations is not None:
            out |= tables.relation_stats(relations).first().asDict()
        return out

    def upload(self, path: str, existing: DataFrame) -> DataFrame:
        return tables.upsert_contacts(read_roster(self.spark, path), existing)

    def match(self, names: DataFrame, contacts: DataFrame, most: int = 500) -> DataFrame:
        return tables.match_names(names.select("name").distinct().orderBy("name").limit(most), contacts)
