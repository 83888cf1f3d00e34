"""Journal of jobs and errors: rows appended to a table, counts taken from the data while it passes."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

JOBS = "id string, kind string, status string, at long, stats string, error string"
ERRORS = "scope string, stage string, message string, detail string, at long"


def _now() -> int:
    return time.time_ns() // 1_000_000


class Job:
    """A running job: observe() counts what passes through a DataFrame, add() notes a figure."""

    def __init__(self, kind: str):
        self.id, self.kind, self._stats, self._seen = uuid.uuid4().hex[:20], kind, {}, {}

    def observe(self, df: DataFrame, name: str, **metrics: Column) -> DataFrame:
        """df, whose rows (and any aggregates given) are counted by the action that reads it; no second pass."""
        self._seen[name] = Observation(f"{self.id}-{name}")
        return df.observe(self._seen[name], F.count(F.lit(1)).alias("rows"), *[c.alias(k) for k, c in metrics.items()])

    def add(self, **figures) -> None:
        self._stats.update(figures)

    def stats(self) -> dict:
        return self._stats | {name: seen.get for name, seen in self._seen.items()}


class Journal:
    """Jobs and errors under a folder that driver and executors share. Rows are only appended; a job's state is its latest row."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _append(self, table: str, schema: str, *rows: tuple) -> None:
        self.spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(f"{self.folder}/{table}")

    def _job(self, job: Job, status: str, stats: str | None = None, error: str | None = None) -> None:
        self._append("jobs", JOBS, (job.id, job.kind, status, _now(), stats, error))

    @contextmanager
    def job(self, kind: str) -> Iterator[Job]:
        """A job is running, then ok with its figures, or failed with its error, which is raised on."""
        job = Job(kind)
        self._job(job, "running")
        try:
            yield job
        except Exception as e:
            self._job(job, "failed", error=f"{type(e).__name__}: {e}"[:2000])
            raise
        self._job(job, "ok", json.dumps(job.stats(), default=str, sort_keys=True))

    def record_errors(self, errors: DataFrame) -> None:
        """Append errors(scope, stage, message, detail) as executors find them; messages are cut to 500 characters, details to 4000."""
        (errors.select("scope", "stage", F.substring("message", 1, 500).alias("message"), F.substring("detail", 1, 4000).alias("detail"), F.lit(_now()).alias("at"))
         .write.mode("append").parquet(f"{self.folder}/errors"))

    def jobs(self) -> DataFrame:
        """Each job once: its latest row and when it started."""
        rows = self.spark.read.schema(JOBS).parquet(f"{self.folder}/jobs")
        rank = F.when(F.col("status") == "running", 0).otherwise(1)
        last = F.max_by(F.struct("status", "at", "stats", "error"), F.struct(rank.alias("rank"), "at"))
        return (rows.groupBy("id", "kind").agg(F.min("at").alias("started_at"), last.alias("last"))
                .select("id", "kind", "started_at", "last.status", F.when(F.col("last.status") != "running", F.col("last.at")).alias("finished_at"), "last.stats", "last.error"))

    def errors(self) -> DataFrame:
        return self.spark.read.schema(ERRORS).parquet(f"{self.folder}/errors")

    def listener(self, kind: str) -> StreamingQueryListener:
        """Writes one finished job per micro-batch that had rows, with the batch's own figures and observed metrics. Add it to spark.streams."""
        journal = self

        class Listener(StreamingQueryListener):
            def onQueryStarted(self, event):
                pass

            def onQueryIdle(self, event):
                pass

            def onQueryProgress(self, event):
                p = event.progress
                if p.numInputRows:
                    job = Job(kind)
                    seen = {name: row.asDict() for name, row in (p.observedMetrics or {}).items()}
                    journal._job(job, "ok", json.dumps({"batch": p.batchId, "rows": p.numInputRows} | seen, default=str, sort_keys=True))

            def onQueryTerminated(self, event):
                if event.exception:
                    journal._job(Job(kind), "failed", error=str(event.exception)[:2000])

        return Listener()
