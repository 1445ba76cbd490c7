"""Read side: submit and status responses, health (SNK-5..7, AGG-1, JN-3, FLT-12)."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.functions.text import iso_utc, result_from_json
from folioflow.operators import tasklog
from folioflow.schemas import RESULT, STATUSES


def submit_response(tasks: DataFrame) -> DataFrame:
    """SNK-5."""
    return tasks.select("task_id", "status", "filename")


def status_response(latest: DataFrame, schema: str = RESULT) -> DataFrame:
    """SNK-6, PRJ-1."""
    return latest.select(
        "task_id", "status", "filename", result_from_json(F.col("result_json"), schema).alias("result"), "error",
        iso_utc(F.col("created_at")).alias("created_at"), iso_utc(F.col("updated_at")).alias("updated_at"),
    )


def status_lookup(ids: DataFrame, latest: DataFrame) -> DataFrame:
    """SRC-6, FLT-12: every asked id (a bounded request) with its task; code 404 where there is none."""
    found = latest.withColumn("_hit", F.lit(True))
    out = ids.select("task_id").join(found, "task_id", "left")
    return out.withColumn("code", F.when(F.col("_hit"), 200).otherwise(404)).drop("_hit")


def lookup_log(ids: DataFrame, log: DataFrame) -> DataFrame:
    """The same from the log: only rows of the asked ids are aggregated, and a request's ids are few."""
    asked = ids.select("task_id").distinct()
    return status_lookup(ids, tasklog.latest(log.join(asked, "task_id", "left_semi")))


def status_counts(rows: DataFrame) -> DataFrame:
    """AGG-1, JN-3: counts by status; known ones without tasks get 0, unknown ones stay."""
    domain = rows.sparkSession.createDataFrame([(s,) for s in STATUSES], "status string")
    counts = rows.groupBy("status").agg(F.count("*").alias("n"))
    return domain.join(counts, "status", "full_outer").select("status", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def health(rows: DataFrame, registry: DataFrame, worker_running: bool, queue_size: int, path: str = "") -> DataFrame:
    """SNK-7, SRT-1, FN-19: one row. An unreadable log raises (E6)."""
    counts = status_counts(rows).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n")))).alias("task_counts"))
    failed = F.struct("name", "failure_reason")
    models = registry.agg(
        F.coalesce(F.bool_or(F.col("loaded") & F.col("ordinal").isNotNull()), F.lit(False)).alias("model_loaded"),
        F.array_sort(F.collect_list(F.when(F.col("loaded"), F.col("name")))).alias("loaded_models"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("failure_reason").isNotNull(), failed)))).alias("failed_models"),
    )
    ok = F.col("model_loaded") & F.lit(worker_running)
    return counts.join(models).select(  # one row on either side
        F.when(ok, F.lit("healthy")).otherwise("degraded").alias("status"), F.lit("ok").alias("api"), "model_loaded", "loaded_models",
        "failed_models", F.lit(worker_running).alias("worker_running"), F.lit(queue_size).alias("queue_size"),
        F.struct(F.lit(True).alias("ok"), F.lit(path).alias("path"), F.col("task_counts")).alias("database"),
    )
