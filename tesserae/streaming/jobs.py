"""Files that arrive, sent to a parser's service, and what comes of them.

Each file is a job, keyed by a name-based id of its name and hash, with a state in the stream's checkpoint: a file that is sent again, or a
stream that starts again, finds the job that there is. Timers ask for jobs that run, until their deadline (counted from when the service has the file); submissions and downloads that
fail are tried again, later each time. A job ends in one row. Nothing waits in a worker.

What is asked of the service in a micro-batch that fails is asked again when it is repeated: with the same id, by which the service can tell.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tesserae.sources.files import file_id
from tesserae.sources.parser import Job, ParserError, ParserService

STATE = "phase string, file_name string, content binary, address string, answer string, attempts int, deadline bigint"
OUTCOME = "data_id string, file_name string, status string, json string, markdown string, error string"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class ParserJobs(StatefulProcessor):
    """Phases: ``submit`` (the content is kept until the service has it), ``wait``, ``fetch``, ``over``. ``make_service`` is called on a worker;
    its ``interval``, ``timeout`` and ``attempts`` count here, and it must not sleep itself."""

    def __init__(self, make_service: Callable[[], ParserService]):
        self.make_service = make_service

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", STATE)
        self.service = self.make_service()
        self.tries, self.service.attempts = self.service.attempts, 1

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        first = next(rows, None)
        for _ in rows:  # the same file again
            pass
        if first is None or self.job.exists():
            return iter(())
        now = timerValues.getCurrentProcessingTimeInMs()
        job = {"phase": "submit", "file_name": first["file_name"], "content": bytes(first["content"]), "address": None, "answer": None, "attempts": 0, "deadline": None}
        return self._step(key[0], job, now)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        names = [f.split()[0] for f in STATE.split(", ")]
        return self._step(key[0], dict(zip(names, self.job.get())), timerValues.getCurrentProcessingTimeInMs())

    def _step(self, data_id: str, job: dict, now: int) -> Iterator[Row]:
        """Takes the job as far as it goes now, and sets a timer if it isn't over."""
        pause = self.service.interval
        try:
            if job["phase"] == "submit":
                sent = self.service.submit_file(job["file_name"], job["content"], data_id)
                job |= {"phase": "wait", "address": sent.address, "content": None, "attempts": 0, "deadline": now + int(1000 * self.service.timeout)}
            elif job["phase"] == "wait":
                if now >= job["deadline"]:
                    return self._over(data_id, job, "timeout", error=f"the job wasn't done in {self.service.timeout} s")
                state, answer = self._asked(data_id, job)
                if state == "done":
                    job |= {"phase": "fetch", "answer": json.dumps(answer), "attempts": 0}
            if job["phase"] == "fetch":
                found = self.service.artifacts(json.loads(job["answer"]))
                if not found:
                    return self._over(data_id, job, "failed", error="the job has no artifact")
                return self._over(data_id, job, "done", json.dumps(found["json"], ensure_ascii=False) if "json" in found else None, found.get("markdown"))
        except JobFailed as error:
            return self._over(data_id, job, "failed", error=str(error))
        except (ParserError, OSError, ValueError) as error:
            job["attempts"] += 1
            if job["attempts"] >= self.tries:
                return self._over(data_id, job, "failed", error=str(error))
            pause *= job["attempts"]
        self._keep(job)
        self.handle.registerTimer(now + int(1000 * pause))
        return iter(())

    def _asked(self, data_id: str, job: dict) -> tuple[str, dict]:
        """The state of the job; the service's word that it failed counts at once, an answer that can't be had is asked for again."""
        try:
            return self.service.ask(Job(job["address"], data_id))
        except ParserError as error:
            if str(error).startswith("the job failed"):
                raise JobFailed(str(error)) from error
            raise

    def _keep(self, job: dict) -> None:
        self.job.update(tuple(job.values()))

    def _over(self, data_id: str, job: dict, status: str, tree: str | None = None, markdown: str | None = None, error: str | None = None) -> Iterator[Row]:
        # What is left of a job tells that it was one.
        self._keep(job | {"phase": "over", "content": None, "answer": None})
        return iter([Row(data_id=data_id, file_name=job["file_name"], status=status, json=tree, markdown=markdown, error=error)])

    def close(self) -> None:
        pass


class JobFailed(RuntimeError):
    """The service says that a job failed."""


def parsed(arriving: DataFrame, make_service: Callable[[], ParserService]) -> DataFrame:
    """A row for each job of the stream ``arriving`` (file_name, sha256, content) that is over: data_id, file_name, status (done, failed, timeout),
    its artifacts ``json`` and ``markdown``, or ``error``. The session's state store must be RocksDB (``PROVIDER``)."""
    keyed = arriving.select(file_id(F.col("file_name"), F.col("sha256")).alias("data_id"), "file_name", "content")
    return keyed.groupBy("data_id").transformWithState(statefulProcessor=ParserJobs(make_service), outputStructType=OUTCOME, outputMode="Append", timeMode="ProcessingTime")


def arriving_files(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """Files as they arrive in a folder: path, file_name, modified, sha256 and content."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    rows = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    name = F.url_decode(F.element_at(F.split("path", "/"), -1))
    return rows.select("path", name.alias("file_name"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"), "content")


def parse_arriving(spark: SparkSession, path: str, make_service: Callable[[], ParserService], out: str, checkpoint: str, every: str = "2 seconds") -> StreamingQuery:
    """Starts a query that sends arriving PDFs to the service, and appends what comes of them to the Parquet table ``out``."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    rows = parsed(arriving_files(spark, path).select("file_name", "sha256", "content"), make_service)
    return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(processingTime=every).start()


def with_artifacts(pdfs: DataFrame, archives: DataFrame, wait: str = "1 hour") -> DataFrame:
    """A stream of ``pdfs`` (sha256, arrived, ...) with ``json`` and ``markdown`` of each archive (origin_sha256, modified, json, markdown) of the
    stream ``archives`` made of it, at most ``wait`` before it arrived or after. One for which none comes in that time has nulls once
    both streams are past it; until then, and no longer, either side is kept as state."""
    left = pdfs.withWatermark("arrived", wait)
    right = archives.select(F.col("origin_sha256").alias("_of"), F.col("modified").alias("_made"), "json", "markdown").filter("_of is not null").withWatermark("_made", wait)
    near = F.expr(f"_made BETWEEN arrived - INTERVAL {wait} AND arrived + INTERVAL {wait}")
    return left.join(right, (F.col("sha256") == F.col("_of")) & near, "left_outer").drop("_of")
