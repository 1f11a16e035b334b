"""Pages as a stream: every micro-batch is read, what touches the graph is kept, and routes are published as soon as they change."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from hopweave.functions import names as N
from hopweave.operators import parse, search


class Ingest:
    """Sink of a stream of pages(page_id, url, html, origin): extractions, one folder per batch, so a repeated batch replaces itself.

    ``routes`` makes the routes of all extractions so far; publish(routes, batch) is called where they differ from those before. With
    ``first_route_stops``, or once ``finish()`` is called, later batches are recorded as skipped and read nothing.
    """

    def __init__(self, spark: SparkSession, base: str, routes: Callable[[DataFrame], DataFrame] | None = None, publish: Callable[[DataFrame, int], None] | None = None, connected: bool = True, first_route_stops: bool = False):
        self.spark, self.base, self.routes, self.publish = spark, base.rstrip("/"), routes, publish
        self.connected, self.first_route_stops, self.stopped, self.log = connected, first_route_stops, False, []
        self._published: list | None = None

    def finish(self) -> None:
        self.stopped = True

    def extractions(self, before: int | None = None) -> DataFrame | None:
        """Everything kept so far (before a batch, if one is named)."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/extractions")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return None
        rows = self.spark.read.parquet(f"{self.base}/extractions")
        return rows if before is None else rows.where(F.col("batch") < before)

    def __call__(self, pages: DataFrame, batch: int) -> None:
        if self.stopped:
            self.log.append((batch, "skipped"))
            return
        # Pages take long to read: they are spread first, whatever files they come in.
        docs = parse.documents(pages.select("page_id", "url", "html").repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")), "page_id"))
        ex = parse.degraded_extractions(parse.sentences(docs.where("skip_reason is null"))).join(docs.select("page_id", "url"), "page_id")
        ex = ex.join(pages.select("page_id", "origin"), "page_id")
        before = self.extractions(batch)
        if self.connected and before is not None:
            keys = before.select(F.explode(F.array(*[N.name_key(N.tokens(F.col(f"{s}_name"))) for s in ("subject", "object")])).alias("name_key"))
            ex = search.connected_only(ex, keys)
        ex.write.mode("overwrite").parquet(f"{self.base}/extractions/batch={batch}")
        self.log.append((batch, "read"))
        if self.routes is not None:
            self._checkpoint(batch)

    def _checkpoint(self, batch: int) -> None:
        rows = self.routes(self.extractions())
        now = [r.k for r in rows.select(F.to_json("nodes").alias("k")).collect()]  # the routes that are shown, a handful
        if now and now != self._published:
            self._published = now
            if self.publish:
                self.publish(rows, batch)
        if now and self.first_route_stops:
            self.stopped = True


def budget_stream(events: DataFrame, job: str, seq: str, cost: str, ceiling: int) -> DataFrame:
    """(job, seq, spent, granted) of a stream of events: one counter per job is kept as state; a cost that would pass the ceiling is refused.

    Events of a micro-batch are met in the order of seq.
    """

    def spend(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        spent = state.get[0] if state.exists else 0
        rows = pd.concat(list(parts)).sort_values("seq")
        out = []
        for s, c in zip(rows["seq"], rows["cost"]):
            ok = spent + c <= ceiling
            spent += int(c) if ok else 0
            out.append((key[0], s, spent, bool(ok)))
        state.update((spent,))
        yield pd.DataFrame(out, columns=["job", "seq", "spent", "granted"])

    rows = events.select(F.col(job).cast("long").alias("job"), F.col(seq).cast("long").alias("seq"), F.col(cost).cast("long").alias("cost"))
    return rows.groupBy("job").applyInPandasWithState(spend, "job long, seq long, spent long, granted boolean", "spent long", "append", GroupStateTimeout.NoTimeout)
