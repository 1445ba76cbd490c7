"""The worker as a streaming query (STR-1..STR-8).

Each micro-batch: uploads, admission, log rows 'processing', pages, recognizer, assembly, log rows 'completed' or
'failed'. Documents of a batch run in parallel. Keys are derived from the files, so a replayed batch writes the
same tasks again and the latest view doesn't change in content. A stopped query goes on where it was; for the
other behaviour, call tasklog.recover_on_restart first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioflow.operators import admission, assemble, pages, recognize, tasklog
from folioflow.operators.registry import Registry
from folioflow.schemas import REJECTS
from folioflow.settings import Settings
from folioflow.sources.shared import remove, written
from folioflow.sources.uploads import stream_uploads


def rejects_path(log_path: str) -> str:
    return log_path.rstrip("/") + "_rejects"


def process_batch(uploads: DataFrame, log_path: str, registry: Registry, settings: Settings, **decoders) -> None:
    """One batch of uploads(upload_id, filename, content_type, content). Rejected ones never get a task; what they would
    be answered is written beside the log, so that one rejected for lack of a model isn't lost.

    A task's row 'processing' also re-stamps one that a replayed batch takes up again: its result and error are gone in
    the latest view. The end of a task follows from the rows of its own batch, the log isn't read.
    """
    spark = uploads.sparkSession
    model, now = registry.active(), F.current_timestamp()
    judged = admission.admit(uploads, settings, "loaded" if model else None, registry.failure()).drop("content", "is_pdf")
    judged = written(judged, "judged")
    refused = judged.filter("reject_code IS NOT NULL").withColumn("rejected_at", now)
    refused.select(*[x.split()[0] for x in REJECTS.split(", ")]).write.mode("append").parquet(rejects_path(log_path))
    made = tasklog.created(admission.admitted(judged).withColumnRenamed("upload_id", "task_id").select("task_id", "filename"), now)
    made = written(made, "created")
    tasklog.append(made, log_path)
    if model is not None:
        docs = uploads.withColumnRenamed("upload_id", "task_id").join(made.select("task_id"), "task_id", "left_semi").select("task_id", "content")
        texts = written(recognize.recognize(pages.explode_pages(docs, settings, **decoders), model, timed=True), "page_texts")
        done = tasklog.finished(assemble.assemble(texts, settings, made.select("task_id"), model.name))
        tasklog.append(tasklog.updated(made, done, now), log_path)
        remove(spark, texts)
    remove(spark, judged, made)


def start_worker(spark: SparkSession, folder: str, log_path: str, checkpoint: str, registry: Registry, settings: Settings, once: bool = False, **decoders) -> StreamingQuery:
    """once: takes what is there and ends. The query's isActive is the running flag. Where a worker of this checkpoint
    runs already, that one is returned (STR-3)."""
    name = f"worker of {checkpoint}"
    running = next((q for q in spark.streams.active if q.name == name), None)
    if running is not None:
        return running
    tasklog.initialize(spark, log_path)
    stream = stream_uploads(spark, folder)
    writer = stream.writeStream.queryName(name).option("checkpointLocation", checkpoint)
    writer = writer.foreachBatch(lambda batch, _: process_batch(batch, log_path, registry, settings, **decoders))
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()


def queue_semi_filter(messages: DataFrame, tasks: DataFrame) -> DataFrame:
    """JN-4: messages that have a task row."""
    return messages.join(tasks.select("task_id"), "task_id", "left_semi")


def backlog(submitted: DataFrame, latest: DataFrame) -> DataFrame:
    """STR-4: submitted tasks without a final state, as one row."""
    final = latest.filter(F.col("status").isin("completed", "failed")).select("task_id")
    return submitted.join(final, "task_id", "left_anti").agg(F.count("*").alias("queue_size"))


def stream_status_counts(spark: SparkSession, folder: str, schema, status, checkpoint: str, out: str) -> StreamingQuery:
    """Appends each micro-batch's counts by state; readers sum them. Finished batches aren't counted twice."""
    stream = spark.readStream.schema(schema).parquet(folder)

    def count(batch: DataFrame, n: int) -> None:
        counts = batch.groupBy(status.alias("status")).agg(F.count("*").alias("n"))
        counts.write.mode("overwrite").parquet(f"{out}/batch={n}")

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(count).trigger(availableNow=True).start()
