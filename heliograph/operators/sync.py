"""Phased synchronisation with a ledger: what was done is known row by row, so an interrupted run goes on where it stopped."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.operators.merge import run_status
from heliograph.shared import folder_exists


@dataclass
class Phase:
    """``todo`` gives the rows with their id; ``apply`` sends rows and gives (id, error), error null where it went well.

    Phases that delete do not run in a recovery, when the backup's state is pushed to a primary that knows more.
    """

    name: str
    todo: Callable[[], DataFrame]
    apply: Callable[[DataFrame], DataFrame]
    destructive: bool = False


class Ledger:
    """Outcomes of one run below a shared folder: a table of (id, error) for each attempt at each phase."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _attempt(self, phase: str, number: int) -> str:
        return f"{self.folder}/phase={phase}/attempt={number}"

    def attempts(self, phase: str) -> int:
        """The attempts that were recorded whole."""
        number = 0
        while folder_exists(self.spark, f"{self._attempt(phase, number)}/_SUCCESS"):
            number += 1
        return number

    def record(self, phase: str, rows: DataFrame) -> None:
        """An attempt; what an interrupted one has left in its place is replaced."""
        rows.select(F.col("id").cast("string").alias("id"), F.col("error").cast("string").alias("error")).write.mode("overwrite").parquet(self._attempt(phase, self.attempts(phase)))

    def rows(self, phase: str) -> DataFrame:
        """(id, error, attempt) of all attempts."""
        found = self.spark.createDataFrame([], "id string, error string, attempt int")
        for number in range(self.attempts(phase)):
            found = found.unionAll(self.spark.read.schema("id string, error string").parquet(self._attempt(phase, number)).withColumn("attempt", F.lit(number)))
        return found

    def done(self, phase: str) -> DataFrame:
        """(id) of the rows that went well in some attempt."""
        return self.rows(phase).where("error is null").select("id").distinct()


def synchronise(phases: list[Phase], ledger: Ledger, recovery: bool = False, retry: bool = False) -> None:
    """Run the phases in order; each is tried with the rows that have not gone well yet, and recorded.

    A phase that is recorded in the ledger is over, so a run that was interrupted goes on with the phase that it stopped in.
    ``retry`` tries those with failed rows again. Failed rows do not stop a run.
    """
    for phase in phases:
        if phase.destructive and recovery:
            continue
        if ledger.attempts(phase.name) and not (retry and not _failed(ledger, phase.name).isEmpty()):
            continue
        todo = phase.todo()
        open_ = todo.join(ledger.done(phase.name).withColumnRenamed("id", "__id"), todo["id"].cast("string") == F.col("__id"), "left_anti")
        ledger.record(phase.name, phase.apply(open_))


def _failed(ledger: Ledger, phase: str) -> DataFrame:
    return ledger.rows(phase).where("error is not null").select("id").distinct().join(ledger.done(phase), "id", "left_anti")


def outcome(phases: list[Phase], ledger: Ledger, recovery: bool = False) -> DataFrame:
    """(place, phase, done, failed, status): success, partial or error of the phases that ran, left out or pending of the others.

    A row counts as failed only if no attempt went well; failed rows are counted once.
    """
    out = ledger.spark.createDataFrame([], "place int, phase string, done long, failed long, status string")
    for place, phase in enumerate(phases):
        named = [F.lit(place).alias("place"), F.lit(phase.name).alias("phase")]
        if not ledger.attempts(phase.name):
            status = "left out" if phase.destructive and recovery else "pending"
            counts = ledger.spark.range(1).select(*named, F.lit(0).cast("long").alias("done"), F.lit(0).cast("long").alias("failed"), F.lit(status).alias("status"))
        else:
            best = ledger.rows(phase.name).groupBy("id").agg(F.bool_or(F.col("error").isNull()).alias("well"))
            sums = best.agg(F.count_if("well").alias("done"), F.count_if(~F.col("well")).alias("failed"))
            counts = sums.select(*named, "done", "failed", run_status("done", "failed").alias("status"))
        out = out.unionAll(counts)
    return out
