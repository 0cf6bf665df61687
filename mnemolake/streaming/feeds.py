"""Structured Streaming: change feeds into a manifest, freshness state by key, deduplicated events.

The feed's watermark is a sequence number, so contiguity is checked in ``foreachBatch``; no event time is involved.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import freshness, queues

EVENT = "memory_id bigint, position bigint, event_id bigint, amount int"
CHANGE = "sequence bigint, kind string, conversation bigint, message bigint, hash string, visible boolean"


class FeedGap(RuntimeError):
    """The feed is not a contiguous continuation of what was applied."""


def apply_feed(spark: SparkSession, source: str, target: str, checkpoint: str) -> StreamingQuery:
    """Apply files of changes to versions of the manifest below ``target``; a replayed batch writes the same version."""

    def batch(changes: DataFrame, epoch: int) -> None:
        session = changes.sparkSession
        old = session.read.parquet(f"{target}/v{epoch}") if epoch else session.createDataFrame([], CHANGE).drop("kind")
        mark = old.agg(F.coalesce(F.max("sequence"), F.lit(0))).first()[0] if epoch else 0
        marks = session.read.text(f"{target}/marks/{epoch}").first()[0] if epoch else "0"
        mark = max(mark, int(marks))
        fresh = changes.dropDuplicates(["sequence"]).where(F.col("sequence") > mark)
        n, verdict = queues.contiguous(fresh, mark, 0).first()
        if verdict != "apply":
            raise FeedGap(f"{verdict} after {mark}")
        queues.apply_changes(old, fresh).write.mode("overwrite").parquet(f"{target}/v{epoch + 1}")
        top = fresh.agg(F.coalesce(F.max("sequence"), F.lit(mark)).cast("string").alias("value"))
        top.write.mode("overwrite").text(f"{target}/marks/{epoch + 1}")

    stream = spark.readStream.schema(CHANGE).parquet(source)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    score, admitted, steps, last = state.get if state.exists else (100, -1, 0, -1)
    rows = pd.concat(batches).sort_values(["position", "event_id"])
    for position, amount in zip(rows["position"], rows["amount"]):
        if position <= last:  # a replay
            continue
        admitted = position if admitted < 0 else admitted
        now = (position - admitted) // 10
        score = min(max(score - (now - steps), -100) + amount, 100)
        steps, last = now, position
    state.update((int(score), int(admitted), int(steps), int(last)))
    yield pd.DataFrame({"memory_id": [key[0]], "score": [int(score)], "position": [int(last)]})


def freshness_state(events: DataFrame) -> DataFrame:
    """Scores by memory as events arrive in order: (memory_id, score, position), one row a batch and key."""
    return events.groupBy("memory_id").applyInPandasWithState(
        _advance, "memory_id long, score int, position long", "score int, admitted long, steps long, last long", "update", GroupStateTimeout.NoTimeout
    )


def deduplicated(events: DataFrame, key: list[str]) -> DataFrame:
    """Exact replays dropped by key, on a stream or a batch."""
    return events.dropDuplicates(key)


def _checked(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rows = pd.concat(batches).sort_values(["position", "memory_id", "amount"])
    known = state.get[0] if state.exists else None
    said = []
    for row in rows.itertuples(index=False):
        own = f"{row.memory_id}:{row.position}:{row.amount}"
        said.append("apply" if known is None else "replay" if own == known else "conflict")
        known = own if known is None else known
    state.update((known,))
    yield rows.assign(verdict=said)[["memory_id", "position", "event_id", "amount", "verdict"]]


def checked(events: DataFrame) -> DataFrame:
    """Every event with its verdict: ``apply`` the first of its event_id, ``replay`` an equal one, ``conflict`` a different one."""
    return events.groupBy("event_id").applyInPandasWithState(
        _checked, f"{EVENT}, verdict string", "payload string", "append", GroupStateTimeout.NoTimeout
    )


def due_transitions(spark: SparkSession, records: DataFrame, ticks: DataFrame, target: str, checkpoint: str, key: str = "id") -> StreamingQuery:
    """State changes of records that fall due as a stream of ``position`` moves the activity clock; each is written once.

    The clock is no event time, so batches compare it with the records' boundaries; a replayed batch writes the same folder."""

    def batch(rows: DataFrame, epoch: int) -> None:
        session = rows.sparkSession
        before = int(session.read.text(f"{target}/clock/{epoch}").first()[0]) if epoch else -1
        now = rows.agg(F.coalesce(F.max("position"), F.lit(before))).first()[0]
        now = max(before, int(now))
        due = freshness.crossings(records, now, key).where(F.col("boundary") > before)
        due.write.mode("overwrite").parquet(f"{target}/due/epoch={epoch}")
        session.createDataFrame([(str(now),)], "value string").write.mode("overwrite").text(f"{target}/clock/{epoch + 1}")

    return ticks.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below the one that all machines share; on one machine, below a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = f"file://{tempfile.mkdtemp(prefix='mnemolake-')}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def run_to_table(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is available, however long it takes, and return its rows from the shared folder."""
    spark = df.sparkSession
    path = scratch(spark, name)
    spark.createDataFrame([], df.schema).write.parquet(f"{path}/rows/epoch=-1")

    def batch(rows: DataFrame, epoch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/rows/epoch={epoch}")  # a replayed batch writes the same folder

    q = df.writeStream.foreachBatch(batch).outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{path}/rows").select(*df.columns)
