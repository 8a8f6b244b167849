"""Jobs as an append-only log of partial updates."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.schemas import schema_of
from loomline.sources.store import Store, latest

FIELDS = ("doc_id", "kind", "status", "stage", "progress", "detail", "error")
DONE = ("done", "error")


def current(log: DataFrame) -> DataFrame:
    """Each job's state: of every field the last value that was set, its start, and its end once it is over."""
    last = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in FIELDS]
    over = F.max(F.when(F.col("status").isin(*DONE), F.col("at")))
    return log.groupBy("job_id").agg(*last, F.min("at").alias("started_at"), over.alias("finished_at"))


def latest_jobs(jobs: DataFrame) -> DataFrame:
    """The job started last for each document and kind."""
    return latest(jobs, ["doc_id", "kind"], F.desc("started_at"), "job_id")


class JobLog:
    def __init__(self, store: Store):
        self.store = store
        self.seq = self.written = 0

    def _write(self, job_id: str, **fields) -> None:
        self._write_all(self.store.spark.range(1).select(F.lit(job_id).alias("job_id")), **fields)

    def _write_all(self, jobs: DataFrame, **fields) -> None:
        """One update for each job of ``jobs(job_id, ...)``, whose other columns count as fields too."""
        fields = {k: v for k, v in fields.items() if v is not None}
        if not fields and len(jobs.columns) < 2:
            return
        self.seq = max(self.seq + 1, time.time_ns())
        columns = schema_of("job_events")
        held = {"seq": F.lit(self.seq), "at": F.current_timestamp(), **{k: F.lit(v) for k, v in fields.items()}}
        value = lambda c: F.col(c) if c in jobs.columns else held.get(c, F.lit(None))
        self.store.append("job_events", jobs.select(*(value(f.name).cast(f.dataType).alias(f.name) for f in columns)))
        self.written += 1
        if self.written % self.store.conf.job_updates == 0:
            self.store.compact("job_events")

    def create(self, doc_id: str, kind: str) -> str:
        job_id = f"job_{uuid.uuid4().hex[:12]}"
        self._write(job_id, doc_id=doc_id, kind=kind, status="queued", progress=0.0)
        return job_id

    def create_all(self, doc_ids: DataFrame, kind: str) -> DataFrame:
        """A running job for each document: ``job_id, doc_id``."""
        mark = uuid.uuid4().hex
        jobs = doc_ids.select("doc_id").distinct().select(F.concat(F.lit("job_"), F.substring(F.sha1(F.concat_ws("\x1f", F.lit(mark), F.lit(kind), "doc_id")), 1, 12)).alias("job_id"), "doc_id")
        self._write_all(jobs, kind=kind, status="running", progress=0.01)
        return jobs

    def finish_all(self, jobs: DataFrame, details: DataFrame) -> None:
        """End jobs: with their document's ``details(doc_id, detail)``, or as failed where it has none."""
        ended = jobs.join(details, "doc_id", "left")
        failed = F.col("detail").isNull()
        status = F.when(failed, "error").otherwise("done").alias("status")
        self._write_all(ended.select("job_id", status, F.when(failed, "windows have no observation; the finished ones are kept").alias("error"), F.when(~failed, F.lit(1.0)).alias("progress"), "detail"))

    def update(self, job_id: str, **fields) -> None:
        self._write(job_id, **fields)

    def get(self, job_id: str) -> DataFrame:
        return current(self.store.read("job_events").where(F.col("job_id") == job_id))

    def latest(self, doc_id: str) -> DataFrame:
        return latest_jobs(current(self.store.read("job_events"))).where(F.col("doc_id") == doc_id)

    def run(self, job_id: str, work: Callable[[Callable], str]) -> None:
        """Run work and log how it ends; it gets a function that logs progress."""
        self.update(job_id, status="running", progress=0.01)
        try:
            detail = work(lambda progress, stage: self.update(job_id, progress=progress, stage=stage))
        except Exception as e:
            self.update(job_id, status="error", error=f"{type(e).__name__}: {e}")
            raise
        self.update(job_id, status="done", progress=1.0, detail=detail)
