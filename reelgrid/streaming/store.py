"""The label store as streams: folding edits, polling, claims that expire.

Each has a batch twin in operators/labelstore.py that gives the same state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENT = "seq bigint, ts string, user string, uuid string, action string, rev int, after string"


def read_log_stream(spark: SparkSession, folder: str, schema: str = EVENT, per_trigger: int = 100) -> DataFrame:
    """An append-only log (one JSON object a line) as a stream; unreadable lines are left out."""
    lines = spark.readStream.option("maxFilesPerTrigger", per_trigger).text(folder)
    parsed = lines.select(F.when(F.try_parse_json("value").isNotNull(), F.from_json("value", schema)).alias("r"))
    return parsed.where("r IS NOT NULL").select("r.*")


def fold_stream(events: DataFrame) -> DataFrame:
    """The current state of each uuid: its last event by seq, whatever the order of arrival.

    State is one row for each uuid, kept as long as the stream lives: it grows with the number
    of labels, not of events.  Deletes stay as tombstones, so late older edits can't revive a
    label.  After a restart the checkpoint says which files were read; files mustn't shrink.
    """
    last = events.groupBy("uuid").agg(F.max_by(F.struct("seq", "action", "user", "after"), "seq").alias("r"), F.count(F.lit(1)).alias("n_events"))
    return last.select("uuid", "r.*", "n_events")


def poll_stream(events: DataFrame, since: int, each: Callable[[DataFrame], None], checkpoint: str):
    """Hand each micro-batch's changed uuids after since, newest first, to a function."""

    def batch(df: DataFrame, _: int) -> None:
        each(df.where(F.col("seq") > since).groupBy("uuid").agg(F.max("seq").alias("seq")).orderBy(F.desc("seq")))

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def claims_stream(claims: DataFrame, ttl_ms: int = 90_000) -> DataFrame:
    """user_id, uuid, seq, held: what each user holds now; held turns false when the claim runs out.

    claims: user_id, uuid, seq.  State is one claim for each user, dropped by a
    processing-time timer.  Of several users on a clip the one of the highest seq holds it.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            uuid, seq = state.get
            state.remove()
            yield pd.DataFrame({"user_id": [key[0]], "uuid": [uuid], "seq": [seq], "held": [False]})
            return
        now = state.get if state.exists else (None, -1)
        for f in frames:
            top = f.loc[f["seq"].idxmax()]
            if int(top["seq"]) > now[1]:
                now = (str(top["uuid"]), int(top["seq"]))
        state.update(now)
        state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame({"user_id": [key[0]], "uuid": [now[0]], "seq": [now[1]], "held": [True]})

    return claims.groupBy("user_id").applyInPandasWithState(run, "user_id string, uuid string, seq bigint, held boolean", "uuid string, seq bigint", "update", GroupStateTimeout.ProcessingTimeTimeout)


def hourly_counts(events: DataFrame, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Events by hour and type, late ones up to a bound."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("hour"), "event_type", "n")


class ProgressLog(StreamingQueryListener):
    """Rows that each stream has read so far, by its name; add it with spark.streams.addListener."""

    def __init__(self) -> None:
        self.rows: dict[str, int] = {}
        self.ended: set[str] = set()
        self._names: dict[str, str] = {}

    def onQueryStarted(self, event) -> None:
        self._names[str(event.runId)] = event.name or str(event.id)

    def onQueryProgress(self, event) -> None:
        name = self._names.get(str(event.progress.runId), event.progress.name or str(event.progress.id))
        self.rows[name] = self.rows.get(name, 0) + event.progress.numInputRows

    def onQueryIdle(self, event) -> None:
        """Nothing to count."""

    def onQueryTerminated(self, event) -> None:
        self.ended.add(self._names.get(str(event.runId), str(event.id)))
