"""Incremental synchronisation as streams: upserts by batch, journals as state, windows over events."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

C = F.col

# A journal's stages in order, and which statuses follow which; nothing follows those without any.
STAGES = (
    "confirmation_accepted", "body_import_started", "body_import_completed", "staging_snapshot_created", "staging_fts_started", "staging_fts_completed",
    "staging_vector_started", "staging_vector_completed", "derived_backup_started", "derived_backup_completed", "publish_started", "publish_completed",
    "final_verification_started", "final_verification_completed", "rollback_started", "rollback_completed", "receipt_persisted",
)
STATUSES = {"accepted": ("running", "failed", "orphaned"), "running": ("committed", "failed", "orphaned"), "committed": (), "failed": (), "orphaned": ()}
FIRST, VERIFIED, UNDOING, UNDONE, LAST = STAGES[0], *STAGES[13:]


def fitting(stage: str, status: str) -> bool:
    """May a record stand at this stage with this status?"""
    return {"accepted": stage == FIRST, "running": stage not in (FIRST, LAST), "committed": stage == LAST, "failed": stage == LAST, "orphaned": stage != LAST}.get(status, False) and stage in STAGES


def legal_moves() -> set[tuple[str, str, str, str]]:
    """STM5: (stage, status) to (stage, status): all moves that a journal may make.

    Stages go forward, or stay. A rollback may start at any stage before its end; from then on only its end or the receipt
    of a failure follow. A commitment needs the final verification, a failure may be put down at any stage.
    """

    def follows(a: str, b: str, status: str) -> bool:
        if a == b:
            return True
        if b == LAST:
            return status == "failed" or a == VERIFIED
        if a == UNDONE or b == UNDOING:
            return a not in (UNDONE, LAST)
        return b == UNDONE if a == UNDOING else STAGES.index(b) > STAGES.index(a)

    states = [(a, s) for a in STAGES for s in STATUSES if fitting(a, s)]
    return {(a, s, b, t) for a, s in states for b, t in states if (s == t or t in STATUSES[s]) and STATUSES[s] and follows(a, b, t)}


def upserted(current: DataFrame, batch: DataFrame, key: str, order: str) -> DataFrame:
    """STM3, STM4: the current rows with those of a batch put in, the last of each key; batches may come twice."""
    from pyspark.sql import Window

    every = current.unionByName(batch)
    return every.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order), F.desc(F.xxhash64(*current.columns))))).where("_r = 1").drop("_r")


def conflicts(batch: DataFrame, key: str, content: str) -> DataFrame:
    """STM3: keys that a batch brings with several contents."""
    return batch.groupBy(key).agg(F.count_distinct(content).alias("n")).where("n > 1")


def worker(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, interval: str | None = None):
    """STM1, STM7: run `apply` on each batch of a stream; all that is there once, or at an interval."""
    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def first_notes(stream: DataFrame, key: str, at: str, delay: str) -> DataFrame:
    """STM3 in the stream: each key once within the watermark."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def _judged(pdf: pd.DataFrame, record: tuple[str, str] | None, moves: set) -> tuple[list[str], tuple[str, str] | None]:
    """Verdicts on records in their order, after the last accepted one (None: there is none yet), and the last accepted one then."""
    verdicts = []
    for new in zip(pdf["stage"], pdf["status"], strict=True):
        ok = new == (FIRST, "accepted") if record is None else (*record, *new) in moves
        verdicts.append("accepted" if ok else "rejected")
        record = new if ok else record
    return verdicts, record


def _verdicts(name: str, key, pdf: pd.DataFrame, verdicts: list[str]) -> pd.DataFrame:
    return pd.DataFrame({name: [key] * len(pdf), "seq": pdf["seq"].to_numpy(), "stage": pdf["stage"].to_numpy(), "status": pdf["status"].to_numpy(), "verdict": verdicts})


class _Journal(StatefulProcessor):
    """The last accepted record of each operation, how many records were rejected, and a timer that silence lets run out."""

    def __init__(self, key: str, silence: int | None):
        self.key, self.silence = key, silence

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.moves = legal_moves()
        self.record = handle.getValueState("record", "stage string, status string")
        self.rejected = handle.getValueState("rejected", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        record = tuple(self.record.get()) if self.record.exists() else None
        bad = self.rejected.get()[0] if self.rejected.exists() else 0
        pdf = pd.concat(list(rows)).sort_values("seq", kind="stable")
        verdicts, record = _judged(pdf, record, self.moves)
        self.rejected.update((bad + verdicts.count("rejected"),))
        if record:
            self.record.update(record)
        if self.silence:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if record and STATUSES[record[1]]:
                self.handle.registerTimer(timerValues.getCurrentWatermarkInMs() + self.silence)
        yield _verdicts(self.key, key[0], pdf, verdicts)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        stage = self.record.get()[0]
        self.record.update((stage, "orphaned"))
        yield pd.DataFrame({self.key: [key[0]], "seq": [None], "stage": [stage], "status": ["orphaned"], "verdict": ["timer"]}).astype({"seq": "Int64"})

    def close(self) -> None:
        pass


def journal(records: DataFrame, key: str = "operation_id", silence: int | None = None) -> DataFrame:
    """STM5: operation, seq, stage, status of records -> each with a verdict, accepted or rejected, by `legal_moves`.

    A rejected record changes nothing; the first one has to be an acceptance. Stages and statuses that are none, nulls among
    them, are rejected. For tables and streams alike: records of an operation are taken in the order of seq, in a stream within
    a batch, and one operation's records of a table or batch are one group. Streams need the RocksDB state store. silence
    (milliseconds): in a stream with a watermark, an operation that has no end that long after the watermark of its last
    record is orphaned, which gives a row of its own without a seq and with the verdict `timer`.
    """
    schema = f"{key} {records.schema[key].dataType.simpleString()}, seq long, stage string, status string, verdict string"
    if records.isStreaming:
        return records.groupBy(key).transformWithStateInPandas(_Journal(key, silence), schema, "Append", "EventTime" if silence else "None")

    def judged(keys, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq", kind="stable")
        return _verdicts(key, keys[0], pdf, _judged(pdf, None, legal_moves())[0])

    return records.groupBy(key).applyInPandas(judged, schema)


def windowed(events: DataFrame, at: str, size: str, delay: str, *by: str) -> DataFrame:
    """Extension: counts in tumbling windows; late events within the delay count."""
    return events.withWatermark(at, delay).groupBy(F.window(at, size), *by).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
