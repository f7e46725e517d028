"""Resumable work as a stream: attempts of each survey until one is valid or the last has failed.

State is one small record a survey: attempts so far and when the next is due.
It lies in the checkpoint, so a restart goes on where the last run ended. A timer
tells when the next attempt is due, which is later after each failure.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Attempts(StatefulProcessor):
    """Rows (survey_key, at, attempt, ok) to decisions (survey_key, status, n_attempts, at_us).

    Attempts count in order of time and number within a micro-batch. The first
    valid one, or the `most`th failure, is the decision; what comes after it is
    ignored. A failure before that sets a timer `wait` seconds later, doubled with each failure; when
    event time passes it without another attempt, a row of status due comes out.
    """

    def __init__(self, kind: str, most: int, wait: float):
        self.kind, self.most, self.wait = kind, most, wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("attempts", "n int, decided boolean, due long")

    def _rows(self, key, found: list[tuple[str, int, int]]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *f) for f in found], columns=["survey_key", "status", "n_attempts", "at_us"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, decided, due = self.state.get() if self.state.exists() else (0, False, 0)
        if decided:
            for _ in rows:
                pass
            return
        before, found = due, []
        for row in pd.concat(list(rows)).sort_values(["at_us", "attempt"]).itertuples():
            n += 1
            if row.ok or n >= self.most:
                found, decided, due = [("valid" if row.ok else "given_up", n, int(row.at_us))], True, 0
                break
            due = int(row.at_us // 1000 + self.wait * 1000 * 2 ** (n - 1))
        if before and before != due:
            self.handle.deleteTimer(before)
        if due and due != before:
            self.handle.registerTimer(due)
        self.state.update((n, decided, due))
        yield self._rows(key, found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n, decided, due = self.state.get()
        if not decided:
            yield self._rows(key, [("due", n, due * 1000)])

    def close(self) -> None:
        pass


def attempt_decisions(stream: DataFrame, key: str, at: str, attempt: str, ok: str, most: int = 3, wait: float = 3600.0, late: str = "1 day") -> DataFrame:
    """A stream of decisions (survey_key, status valid, given_up or due, n_attempts, at_us) over a stream of attempts.

    Rows later than `late` are dropped by the watermark; null keys are one survey and a null ok is a failure. Needs the RocksDB state store (see run_attempts).
    """
    kind = dict(stream.dtypes)[key]
    rows = stream.select(
        F.col(key).alias("survey_key"), F.col(at).cast("timestamp").alias("at"), F.unix_micros(F.col(at).cast("timestamp")).alias("at_us"), F.col(attempt).alias("attempt"),
        F.coalesce(F.col(ok), F.lit(False)).alias("ok"),
    )
    out = f"survey_key {kind}, status string, n_attempts int, at_us long"
    return rows.withWatermark("at", late).groupBy("survey_key").transformWithStateInPandas(Attempts(kind, most, wait), out, "Append", "EventTime")


def state_session(spark: SparkSession) -> SparkSession:
    """A session beside the caller's with the RocksDB state store; the caller's settings stay as they are."""
    child = spark.newSession()
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        child.conf.set(name, spark.conf.get(name))
    child.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return child


def run_attempts(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Run a stream of decisions over all that is there, appended to out as Parquet; a later call goes on from the checkpoint."""
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
