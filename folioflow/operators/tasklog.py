"""Task lifecycle as an append-only log with a latest view (SNK-1..4, SRC-6, FLT-6..8, STR-6).

Plain Spark tables can't be updated, so each change of a task is a row (T10). The last row by (updated_at, seq)
is the task's state; nothing guards final states, the latest wins (E4).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions.text import to_json_full
from folioflow.schemas import RESTART_ERROR, STATUSES, TASK_LOG

COLUMNS = [x.split()[0] for x in TASK_LOG.split(", ")]


def check_status(status: str) -> str:
    """FLT-8, SRT-3."""
    if status not in STATUSES:
        raise ValueError(f"Invalid OCR task status '{status}'. Expected one of: {sorted(STATUSES)}")
    return status


def checked(status: Column) -> Column:
    """The same check on a column: a value outside the domain fails the query."""
    fail = F.raise_error(F.concat(F.lit("Invalid OCR task status '"), F.coalesce(status, F.lit("None")), F.lit(f"'. Expected one of: {sorted(STATUSES)}")))
    return F.when(status.isin(*STATUSES), status).otherwise(fail.cast("string"))


def initialize(spark: SparkSession, path: str) -> None:
    """SNK-1: an empty log, unless there is one."""
    spark.createDataFrame([], TASK_LOG).write.mode("ignore").parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TASK_LOG).parquet(path)


def append(rows: DataFrame, path: str) -> None:
    rows.select(*COLUMNS).withColumn("status", checked(F.col("status"))).write.mode("append").parquet(path)


def created(tasks: DataFrame, now: Column, seq: int = 0) -> DataFrame:
    """SNK-2: first rows of tasks(task_id, filename)."""
    none = F.lit(None).cast("string")
    return tasks.select(
        "task_id", F.lit(seq).cast("bigint").alias("seq"), "filename", F.lit("processing").alias("status"),
        none.alias("result_json"), none.alias("error"), now.alias("created_at"), now.alias("updated_at"),
    )


def latest(log: DataFrame) -> DataFrame:
    """One row a task. max_by keeps one row a task and partition before the shuffle, also for a hot task."""
    rest = [c for c in log.columns if c != "task_id"]
    row = F.max_by(F.struct(*rest), F.struct("updated_at", "seq")).alias("r")
    return log.groupBy("task_id").agg(row).select("task_id", *[f"r.{c}" for c in rest])


def updated(current: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """SNK-3: log rows for changes(task_id, status, result_json, error). Unknown tasks give no row; result and
    error are always set, to NULL if the change has none (E3). created_at and filename stay."""
    old = current.select("task_id", "filename", "created_at", F.col("seq").alias("_seq"))
    return changes.join(old, "task_id").select(
        "task_id", (F.col("_seq") + 1).alias("seq"), "filename", checked(F.col("status")).alias("status"), "result_json", "error",
        "created_at", now.alias("updated_at"),
    )


def restamped(current: DataFrame, now: Column) -> DataFrame:
    """STR-6: a task that is taken up (again) is processing, without result and error."""
    none = F.lit(None).cast("string")
    return updated(current, current.select("task_id", F.lit("processing").alias("status"), none.alias("result_json"), none.alias("error")), now)


def finished(results: DataFrame) -> DataFrame:
    """(task_id, result, error) to changes: failed with an error and no result, or completed (E1: an error of '' fails too)."""
    bad = F.col("error").isNotNull()
    return results.select(
        "task_id", F.when(bad, F.lit("failed")).otherwise("completed").alias("status"),
        F.when(~bad, to_json_full(F.col("result"))).alias("result_json"), "error",
    )


def recovered(rows: DataFrame, now: Column) -> DataFrame:
    """SNK-4, FLT-7, E11: what was processing has failed; result_json stays, as do all other rows."""
    hit = F.coalesce(F.col("status") == "processing", F.lit(False))
    new = {"status": F.lit("failed"), "error": F.lit(RESTART_ERROR), "updated_at": now}
    return rows.withColumns({k: F.when(hit, v).otherwise(F.col(k)) for k, v in new.items()})


def recover_on_restart(spark: SparkSession, path: str, now: Column | None = None) -> None:
    """Appends the rows that recovery changes."""
    stuck = latest(read_log(spark, path)).filter(F.col("status") == "processing").withColumn("seq", F.col("seq") + 1)
    append(recovered(stuck, F.current_timestamp() if now is None else now), path)
