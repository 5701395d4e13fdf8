"""The life of an external batch: submit, poll until it ends, resume after an interruption, process results once.

State is one row for each type of batch, written to a table of its own; a status stream folds into the same rows. The
service is behind ``Provider``; ``FakeProvider`` answers offline.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from datetime import UTC, datetime
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import BATCH_STATE, absent_as_empty
from ..sources.batches import request_lines

TERMINAL = ("completed", "failed", "expired", "cancelled")
#: Seconds between polls, and the least that is taken as given.
POLL, LEAST_POLL = 60, 10


def is_terminal(status: Column) -> Column:
    return status.isin(*TERMINAL)


def terminal_error(status: Column) -> Column:
    """Why a batch that ended gives no results; null for a completed one."""
    return F.when(status == "failed", "batch failed").when(status == "expired", "batch expired before it was completed").when(status == "cancelled", "batch was cancelled").when(status != "completed", F.concat(F.lit("batch ended with status "), status))


def poll_seconds(asked: int) -> int:
    """Intervals that are too short are set to the default, not to the least."""
    return asked if asked >= LEAST_POLL else POLL


class Provider(Protocol):
    def submit(self, lines: DataFrame) -> dict: ...

    def status(self, batch_id: str) -> dict: ...

    def download(self, spark: SparkSession, file_id: str) -> DataFrame: ...

    def cancel(self, batch_id: str) -> None: ...


class FakeProvider:
    """Answers from a function over request lines (value) to result lines, after so many polls."""

    def __init__(self, answer: Callable[[DataFrame], DataFrame], polls: int = 1, ends: str = "completed"):
        self.answer, self.polls, self.ends = answer, polls, ends
        self.jobs: dict[str, dict] = {}

    def submit(self, lines):
        key = f"batch-{len(self.jobs) + 1}"
        self.jobs[key] = {"lines": lines, "left": self.polls}
        return {"batch_id": key, "input_file_id": f"{key}-in", "status": "validating"}

    def status(self, batch_id):
        job = self.jobs[batch_id]
        job["left"] -= 1
        done = job["left"] <= 0
        return {"status": self.ends if done else "in_progress", "output_file_id": f"{batch_id}-out" if done else ""}

    def download(self, spark, file_id):
        return self.answer(self.jobs[file_id.removesuffix("-out")]["lines"])

    def cancel(self, batch_id):
        self.jobs[batch_id]["left"], self.ends = 0, "cancelled"


class Store:
    """State rows below a folder, one table for each type; written anew as a whole."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, kind: str) -> str:
        return f"{self.root}/batch_{kind}"

    def load(self, kind: str) -> dict | None:
        row = absent_as_empty(self.spark, self.path(kind), BATCH_STATE, "parquet").first()
        return row.asDict() if row else None

    def save(self, state: dict) -> None:
        names = [f.name for f in self.spark.createDataFrame([], BATCH_STATE).schema]
        self.spark.createDataFrame([tuple(state.get(n) for n in names)], BATCH_STATE).coalesce(1).write.mode("overwrite").parquet(self.path(state["type"]))

    def delete(self, kind: str) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path(kind))
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def submit(store: Store, provider: Provider, kind: str, requests: DataFrame, chapter_ids: list[int], model: str) -> dict:
    """Sends the requests and keeps the state, so that a later run can go on. A pending batch of the type is not replaced."""
    if (old := store.load(kind)) and old["status"] not in TERMINAL:
        return old
    sent = provider.submit(request_lines(requests))
    state = {"type": kind, "model": model, "endpoint": "/v1/responses", "chapter_ids": chapter_ids, "created_at": datetime.now(UTC).replace(tzinfo=None), "total": len(chapter_ids), "completed": 0, "failed": 0} | sent
    store.save(state)
    return state


def poll(store: Store, provider: Provider, kind: str, every: int = POLL, sleep: Callable[[float], None] = time.sleep, stop: Callable[[], bool] = lambda: False) -> dict:
    """Until the batch ends or ``stop`` says so; the state is kept at each look."""
    state = store.load(kind)
    if state is None:
        raise LookupError(f"no batch of type {kind}")
    while state["status"] not in TERMINAL and not stop():
        state |= {k: v for k, v in provider.status(state["batch_id"]).items() if v is not None}
        if state["status"] in TERMINAL:
            state["completed_at"] = datetime.now(UTC).replace(tzinfo=None)
        store.save(state)
        if state["status"] not in TERMINAL:
            sleep(poll_seconds(every))
    return state


def finish(store: Store, provider: Provider, kind: str, process: Callable[[DataFrame], None]) -> dict:
    """Hands the result lines of a completed batch to ``process`` and drops the state after that; other ends are errors."""
    state = store.load(kind)
    if state is None:
        raise LookupError(f"no batch of type {kind}")
    if state["status"] != "completed":
        reason = store.spark.range(1).select(terminal_error(F.lit(state["status"])).alias("e")).first()["e"]
        raise RuntimeError(reason)
    process(provider.download(store.spark, state["output_file_id"]))
    store.delete(kind)
    return state


def status_stream(updates: DataFrame, state: str, checkpoint: str, merge: Callable[[DataFrame], None]):
    """A stream of status rows (type, status, updated): each micro-batch is folded to the last row of a type, then merged."""

    def fold(rows: DataFrame, _epoch: int) -> None:
        merge(rows.groupBy("type").agg(F.max_by("status", "updated").alias("status"), F.max("updated").alias("updated")))

    return updates.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).queryName(state).trigger(availableNow=True).start()


def pending(chapters: DataFrame, done: DataFrame, force: bool = False) -> DataFrame:
    """Chapters (id) that are not done (chapter_id) yet; all with ``force``, or if none is, so that texts are not shuffled for it."""
    return chapters if force or done.isEmpty() else chapters.join(done.select(F.col("chapter_id").alias("id")), "id", "left_anti")


def pending_stress(chapters: DataFrame, translations: DataFrame, processed: DataFrame, force: bool = False) -> DataFrame:
    """Translated chapters whose stress is not done yet."""
    have = chapters.join(translations.select(F.col("chapter_id").alias("id")), "id", "left_semi")
    return pending(have, processed.select(F.col("id").alias("chapter_id")), force)


def incremental(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame]):
    """New files of a folder, once each, through a transformation to a table; what was done before is skipped."""
    rows = spark.readStream.schema(schema).json(source)
    return transform(rows).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def status_of(chapters: DataFrame, translations: DataFrame, ssml: DataFrame, audio: DataFrame) -> DataFrame:
    """(id, status) raw, translated, ssml or audio, from what exists rather than from rows rewritten at each step."""
    have = lambda t, n: t.select(F.col("chapter_id").alias("id")).distinct().withColumn(n, F.lit(True))
    rows = chapters.select("id").join(have(translations, "t"), "id", "left").join(have(ssml, "s"), "id", "left").join(have(audio, "a"), "id", "left")
    return rows.select("id", F.when(F.col("a"), "audio").when(F.col("s"), "ssml").when(F.col("t"), "translated").otherwise("raw").alias("status"))
