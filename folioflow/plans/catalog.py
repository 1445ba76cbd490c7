"""Query catalogue over the driver tables, with DuckDB SQL beside each query.

documents stand in for uploads, conversations for documents with pages, events for task transitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from folioflow.functions.text import WHITESPACE, base64_plain, chat_content, data_url, is_pdf, iso_utc, py_strip, to_json_full
from folioflow.operators import admission, assemble, pages, recognize, registry, serving, tasklog
from folioflow.settings import Settings
from folioflow.streaming import worker

SETTINGS = Settings()
STRIP_SQL = "||".join(f"chr({ord(c)})" for c in WHITESPACE)
STATUS_SQL = "CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'processing' END"
REGISTRY_ROWS = [(0, "alpha", False, ""), (1, "beta", True, "boom"), (2, "gamma", True, None), (None, "delta", True, None)]
REGISTRY_SQL = "(VALUES (0,'alpha',false,''),(1,'beta',true,'boom'),(2,'gamma',true,NULL),(NULL,'delta',true,NULL)) r(ordinal,name,loaded,failure_reason)"


def state():
    """State of a task after an event."""
    return F.expr(STATUS_SQL)


#: Schemas of tables read before, as a catalogue keeps them: (application, path). Spark starts a job to infer one.
_SCHEMAS: dict[tuple[str, str], StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    key = spark.sparkContext.applicationId, path
    if key not in _SCHEMAS:
        _SCHEMAS[key] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[key]).parquet(path)


def page_texts(spark, sf_dir) -> DataFrame:
    """Some pages emptied or padded, as the driver's text has neither."""
    t = F.when((F.col("turn") % 4 == 3) | (F.col("conv_id") % 10 == 0), F.lit("")).when(F.col("turn") % 4 == 2, F.concat(F.lit("　\u001c"), "text", F.lit(" \n"))).otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("task_id"), F.col("turn").cast("int").alias("page_index"), py_strip(t).alias("page_text"), F.lit(None).cast("string").alias("error")
    )


PAGES_SQL = f"""(SELECT CAST(conv_id AS VARCHAR) task_id, turn, CASE WHEN turn%4=3 OR conv_id%10=0 THEN '' WHEN turn%4=2 THEN
 trim(chr(12288)||chr(28)||text||chr(160)||chr(10), {STRIP_SQL}) ELSE trim(text, {STRIP_SQL}) END t FROM conversations)"""
RAW_SQL = "coalesce(string_agg(t, chr(10)||chr(10) ORDER BY turn) FILTER (WHERE t<>''), '')"
QUALITY_SQL = f"""SELECT task_id, page_count, line_count, length(s) AS char_count, CASE WHEN s='' THEN 'empty' ELSE 'generated' END AS status,
 CASE WHEN s='' THEN 'no_text_detected' ELSE '' END AS warnings FROM (SELECT task_id, count(*) page_count, count(*) FILTER (WHERE t<>'') line_count,
 trim({RAW_SQL}, {STRIP_SQL}) s FROM {{pages}} GROUP BY task_id)"""


def doc_quality(spark, sf_dir):
    """First slice: AGG-2..6, FN-1, FN-12."""
    q = assemble.with_quality(assemble.gather(page_texts(spark, sf_dir)))
    return q.select("task_id", "page_count", "line_count", "char_count", "status", F.array_join("warnings", ",").alias("warnings"))


def raw_text_join(spark, sf_dir):
    return assemble.gather(page_texts(spark, sf_dir)).select("task_id", "raw_text")


def zero_page_docs(spark, sf_dir):
    """E8: pages of every fifth document removed; the document stays."""
    all_pages = page_texts(spark, sf_dir)
    docs = all_pages.select("task_id").distinct()
    q = assemble.with_quality(assemble.gather(all_pages.filter(F.col("task_id").cast("bigint") % 5 != 0), docs))
    return q.select("task_id", "page_count", "line_count", "char_count", "status")


def result_envelope(spark, sf_dir):
    """PRJ-2..5, FN-13, FN-14: through JSON text and back, then flat fields."""
    done = tasklog.finished(assemble.assemble(page_texts(spark, sf_dir), SETTINGS))
    res = serving.result_from_json(F.col("result_json"), assemble.S.RESULT)["res"]
    return done.select("task_id", "status", res.alias("res"), F.col("result_json").contains('"bbox":null').alias("has_null_bbox")).select(
        "task_id", "status", "has_null_bbox", F.col("res.page_count").alias("page_count"), F.col("res.final_text").alias("final_text"),
        F.col("res.quality.char_count").alias("char_count"), F.aggregate("res.pages", F.lit(0), lambda a, p: a + p["totals"]["block_count"]).cast("bigint").alias("blocks"),
        F.col("res.generation.pipeline").alias("pipeline"), F.col("res.model_name").alias("model_name"),
    )


RESULT_SQL = f"""SELECT task_id, 'completed' AS status, line_count>0 AS has_null_bbox, page_count, raw AS final_text, length(trim(raw, {STRIP_SQL})) AS char_count,
 line_count AS blocks, '{assemble.S.REMOTE_PIPELINE}' AS pipeline, 'qwen_ocr' AS model_name FROM (SELECT task_id, count(*) page_count,
 count(*) FILTER (WHERE t<>'') line_count, {RAW_SQL} raw FROM {PAGES_SQL} GROUP BY task_id)"""


def page_explode(spark, sf_dir):
    """LIM-1, FN-20, natively: at most 20 newline pages a document."""
    d = table(spark, sf_dir, "documents")
    pieces = F.slice(F.split("text", "\n"), 1, SETTINGS.max_pdf_pages)
    return d.select("doc_id", F.posexplode(pieces).alias("page_index", "page_text"))


def page_generator(spark, sf_dir):
    """UDTF-1 as the pluggable generator, with the line decoder for content that isn't a PDF."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("task_id"), F.encode("text", "utf-8").alias("content"))
    return pages.explode_pages(d, SETTINGS, image=pages.decode_lines, pages_per_batch=2000).select("task_id", "page_index", F.length("image").cast("bigint").alias("n_bytes"))


def recognize_stub(spark, sf_dir):
    """UDF-1 over capped line pages, then counts by document."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("task_id"), F.encode("text", "utf-8").alias("content"))
    texts = recognize.recognize(pages.explode_pages(d, SETTINGS, image=pages.decode_lines_capped, pages_per_batch=2000), recognize.StubRecognizer())
    q = assemble.with_quality(assemble.gather(texts))
    return q.select("task_id", "page_count", "line_count", "char_count", "status")


def recognize_whole(spark, sf_dir):
    """UDF-1 over all lines of each document: content that isn't a PDF has no page cap (E9)."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("task_id"), F.encode("text", "utf-8").alias("content"))
    texts = recognize.recognize(pages.explode_pages(d, SETTINGS, image=pages.decode_lines, pages_per_batch=2000), recognize.StubRecognizer())
    q = assemble.with_quality(assemble.gather(texts))
    return q.select("task_id", "page_count", "line_count", "char_count", "status")


def admission_gate(spark, sf_dir):
    """FLT-1, FLT-2, precedence; a small cap so that some are too large, content types by doc_id."""
    kinds = F.array(*[F.lit(x) for x in (*SETTINGS.allowed_types, "text/plain")])
    d = table(spark, sf_dir, "documents").select("doc_id", F.get(kinds, (F.col("doc_id") % 6).cast("int")).alias("content_type"), F.octet_length("text").cast("bigint").alias("size_bytes"))
    code = admission.rejection_code(F.col("content_type"), F.col("size_bytes") * 1000, F.lit(True), SETTINGS)
    return d.withColumn("reject_code", code)


def magic_sniff(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    content = F.concat(F.when(F.col("doc_id") % 3 == 0, "%PDF-1.7 ").when(F.col("doc_id") % 3 == 1, " %PDF").otherwise(""), "text")
    return d.select("doc_id", is_pdf(content).alias("is_pdf"))


def strip_parity(spark, sf_dir):
    pad = F.lit(WHITESPACE)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", py_strip(F.concat(pad, "text", pad)).alias("stripped"))


def data_url_query(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", data_url(F.encode("text", "utf-8")).alias("url"))


def task_log(spark, sf_dir) -> DataFrame:
    ts, none = F.col("ts").cast("timestamp"), F.lit(None).cast("string")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("task_id"), F.col("event_id").alias("seq"), F.concat(F.lit("f"), "user_id").alias("filename"), state().alias("status"),
        F.when(state() == "completed", F.col("props")).alias("result_json"), F.when(state() == "failed", F.lit("boom")).otherwise(none).alias("error"),
        ts.alias("created_at"), ts.alias("updated_at"),
    )


def task_latest(spark, sf_dir):
    return tasklog.latest(task_log(spark, sf_dir)).select("task_id", "seq", "status", "result_json", "error", iso_utc(F.col("updated_at")).alias("updated_at"))


ISO_SQL = "strftime({t},'%Y-%m-%dT%H:%M:%S')||CASE WHEN date_part('microsecond',{t})%1000000=0 THEN '' ELSE strftime({t},'.%f') END||'+00:00'"
LATEST_SQL = f"(SELECT user_id, arg_max(event_id, (ts,event_id)) seq, arg_max(event_type,(ts,event_id)) event_type, arg_max(props,(ts,event_id)) props, max(ts) ts FROM events GROUP BY user_id)"


def status_counts_zero_filled(spark, sf_dir):
    """AGG-1, JN-3; one state is made unknown, another one gets no rows."""
    s = F.when(state() == "failed", "lost").otherwise(state())
    return serving.status_counts(table(spark, sf_dir, "events").select(s.alias("status")))


def restart_recovery(spark, sf_dir):
    rows = tasklog.recovered(task_log(spark, sf_dir), F.lit("2025-01-01 00:00:00").cast("timestamp"))
    return rows.select("seq", "task_id", "status", "result_json", "error", iso_utc(F.col("updated_at")).alias("updated_at"))


def json_path(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))
    reply = F.concat(F.lit('{"choices":[{"message":{"content":" k='), "k", F.lit(' "}}]}'))
    return e.select("event_id", F.col("k").cast("int").alias("k"), chat_content(reply).alias("content"))


def registry_table(spark):
    return spark.createDataFrame(REGISTRY_ROWS, registry.SCHEMA)


def status_lookup(spark, sf_dir):
    """Ids from the table's ends and one that isn't there."""
    e = table(spark, sf_dir, "events")
    ids = e.agg(F.min("user_id").alias("a"), F.max("user_id").alias("b")).select(F.explode(F.array(*[F.col(x).cast("string") for x in "ab"], (F.col("b") + 1).cast("string"))).alias("task_id"))
    return serving.lookup_log(ids, task_log(spark, sf_dir)).select("task_id", "code", "status")


def queue_semi_filter(spark, sf_dir):
    tasks = table(spark, sf_dir, "events").select(F.col("user_id").alias("task_id"))
    return worker.queue_semi_filter(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("task_id")), tasks)


def task_update(spark, sf_dir):
    """SNK-3: every document completes the task of its id; ids without a task give no row."""
    changes = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("task_id"), F.lit("completed").alias("status"), F.lit(None).cast("string").alias("result_json"), F.lit(None).cast("string").alias("error")
    )
    new = tasklog.updated(tasklog.latest(task_log(spark, sf_dir)), changes, F.lit("2025-01-01 00:00:00").cast("timestamp"))
    return new.select("task_id", "seq", "filename", "status", "result_json", "error")


def backlog(spark, sf_dir):
    latest = tasklog.latest(task_log(spark, sf_dir))
    return worker.backlog(latest.select("task_id"), latest)


def health_snapshot(spark, sf_dir):
    h = serving.health(tasklog.latest(task_log(spark, sf_dir)), registry_table(spark), True, 0, "log")
    counts = F.col("database.task_counts")
    return h.select("status", "api", "model_loaded", F.array_join("loaded_models", ",").alias("loaded_models"), "worker_running", F.col("queue_size").cast("bigint").alias("queue_size"), *[F.element_at(counts, s).alias(f"n_{s}") for s in ("processing", "completed", "failed")])


def status_domain(spark, sf_dir):
    """FLT-8: states pass the check of the domain."""
    return table(spark, sf_dir, "events").select("event_id", tasklog.checked(state()).alias("status"))


def model_gate(spark, sf_dir):
    """FLT-11, FLT-1, FLT-2 in one: every other upload meets a service without a model."""
    kinds = F.array(*[F.lit(x) for x in (*SETTINGS.allowed_types, "text/plain")])
    d = table(spark, sf_dir, "documents").select("doc_id", F.get(kinds, (F.col("doc_id") % 6).cast("int")).alias("kind"), (F.octet_length("text").cast("bigint") * 1000).alias("size"))
    code = admission.rejection_code(F.col("kind"), F.col("size"), F.col("doc_id") % 2 == 0, SETTINGS)
    detail = admission.rejection_detail(code, F.col("kind"), F.lit("alpha: boom"), SETTINGS)
    return d.select("doc_id", code.alias("reject_code"), detail.alias("reject_detail"))


def created_tasks(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("task_id"), F.concat(F.lit("f"), "doc_id").alias("filename"))
    return tasklog.created(d, F.lit("2025-01-01 00:00:00").cast("timestamp"))


def tasks_created(spark, sf_dir):
    """SNK-2."""
    return created_tasks(spark, sf_dir).select("task_id", "seq", "filename", "status", "result_json", "error", iso_utc(F.col("created_at")).alias("created_at"))


def submit_responses(spark, sf_dir):
    """SNK-5."""
    return serving.submit_response(created_tasks(spark, sf_dir))


def status_responses(spark, sf_dir):
    """SNK-6, PRJ-1: the latest state of each task as it is answered, with the result parsed."""
    r = serving.status_response(tasklog.latest(task_log(spark, sf_dir)), "k int")
    return r.select("task_id", "status", "filename", F.col("result.k").alias("k"), "error", "created_at", "updated_at")


def load_summary(spark, sf_dir):
    """AGG-8."""
    return registry.load_summary(registry_table(spark))


def task_restamp(spark, sf_dir):
    """STR-6: every task is taken up again."""
    rows = tasklog.restamped(tasklog.latest(task_log(spark, sf_dir)), F.lit("2025-01-01 00:00:00").cast("timestamp"))
    return rows.select("task_id", "seq", "filename", "status", "result_json", "error", iso_utc(F.col("updated_at")).alias("updated_at"))


def stream_stop_resume(spark, sf_dir):
    """STR-5: a stream that ends and is started again counts what came in between, and nothing twice."""
    from folioflow.sources.shared import new_path, remove, written

    base, folder = new_path(spark, "resumed"), new_path(spark, "events")
    batch = table(spark, sf_dir, "events")
    for part in (batch.filter("event_id % 2 = 0"), batch.filter("event_id % 2 <> 0")):
        part.write.mode("append").parquet(folder)
        worker.stream_status_counts(spark, folder, batch.schema, state(), f"{base}/checkpoint", f"{base}/out").awaitTermination()
    out = written(spark.read.parquet(f"{base}/out").groupBy("status").agg(F.sum("n").alias("n")), "stream_counts")
    remove(spark, folder, base)
    return out


def stream_task_counts(spark, sf_dir):
    """STR-1..6: the events as a stream of one pass, counted by state."""
    from folioflow.sources.shared import new_path, remove

    base, src = new_path(spark, "stream"), f"{sf_dir}/events.parquet"
    folder = new_path(spark, "events")
    batch = spark.read.parquet(src)
    batch.write.parquet(folder)
    q = worker.stream_status_counts(spark, folder, batch.schema, state(), f"{base}/checkpoint", f"{base}/out")
    q.awaitTermination()
    remove(spark, folder)
    return spark.read.parquet(f"{base}/out").groupBy("status").agg(F.sum("n").alias("n"))


QUERIES = {
    "doc_quality": doc_quality,
    "raw_text_join": raw_text_join,
    "zero_page_docs": zero_page_docs,
    "result_envelope": result_envelope,
    "page_explode": page_explode,
    "page_generator": page_generator,
    "recognize_stub": recognize_stub,
    "recognize_whole": recognize_whole,
    "status_domain": status_domain,
    "model_gate": model_gate,
    "tasks_created": tasks_created,
    "submit_responses": submit_responses,
    "status_responses": status_responses,
    "load_summary": load_summary,
    "task_restamp": task_restamp,
    "stream_stop_resume": stream_stop_resume,
    "admission_gate": admission_gate,
    "magic_sniff": magic_sniff,
    "strip_parity": strip_parity,
    "data_url": data_url_query,
    "task_latest": task_latest,
    "task_update": task_update,
    "status_counts_zero_filled": status_counts_zero_filled,
    "restart_recovery": restart_recovery,
    "json_path": json_path,
    "active_model": lambda spark, sf_dir: registry.active_model(registry_table(spark)),
    "active_failure": lambda spark, sf_dir: registry.active_failure(registry_table(spark)),
    "status_lookup": status_lookup,
    "queue_semi_filter": queue_semi_filter,
    "backlog": backlog,
    "health_snapshot": health_snapshot,
    "stream_task_counts": stream_task_counts,
}

ORACLES = {
    "doc_quality": QUALITY_SQL.format(pages=PAGES_SQL),
    "raw_text_join": f"SELECT task_id, {RAW_SQL} AS raw_text FROM {PAGES_SQL} GROUP BY task_id",
    "zero_page_docs": f"""SELECT task_id, coalesce(page_count,0) AS page_count, coalesce(line_count,0) AS line_count, coalesce(char_count,0) AS char_count, coalesce(status,'empty') AS status
 FROM (SELECT DISTINCT CAST(conv_id AS VARCHAR) task_id FROM conversations) LEFT JOIN ({QUALITY_SQL.format(pages=PAGES_SQL)}) q USING (task_id) WHERE CAST(task_id AS BIGINT)%5<>0
 UNION ALL SELECT DISTINCT CAST(conv_id AS VARCHAR), 0, 0, 0, 'empty' FROM conversations WHERE conv_id%5=0""",
    "result_envelope": RESULT_SQL,
    "page_explode": "SELECT doc_id, CAST(unnest(range(len(x))) AS INTEGER) AS page_index, unnest(x) AS page_text FROM (SELECT doc_id, string_split(text, chr(10))[1:20] x FROM documents)",
    "page_generator": "SELECT CAST(doc_id AS VARCHAR) AS task_id, CAST(unnest(range(len(x))) AS INTEGER) AS page_index, strlen(unnest(x)) AS n_bytes FROM (SELECT doc_id, string_split(text, chr(10)) x FROM documents)",
    "recognize_stub": QUALITY_SQL.format(pages=f"(SELECT CAST(doc_id AS VARCHAR) task_id, unnest(range(len(x))) turn, trim(unnest(x), {STRIP_SQL}) t FROM (SELECT doc_id, string_split(text, chr(10))[1:20] x FROM documents))").replace(", CASE WHEN s='' THEN 'no_text_detected' ELSE '' END AS warnings", "").replace(",\n CASE WHEN s='' THEN 'no_text_detected' ELSE '' END AS warnings", ""),
    "recognize_whole": QUALITY_SQL.format(pages=f"(SELECT CAST(doc_id AS VARCHAR) task_id, unnest(range(len(x))) turn, trim(unnest(x), {STRIP_SQL}) t FROM (SELECT doc_id, string_split(text, chr(10)) x FROM documents))").replace(",\n CASE WHEN s='' THEN 'no_text_detected' ELSE '' END AS warnings", ""),
    "status_domain": f"SELECT event_id, {STATUS_SQL} AS status FROM events",
    "model_gate": f"""SELECT doc_id, c AS reject_code, CASE c WHEN 503 THEN 'No configured OCR model is loaded at startup. Startup error: alpha: boom' WHEN 415 THEN 'Unsupported file type: '||k||'. Allowed: [''image/jpeg'', ''image/png'', ''image/webp'', ''image/tiff'', ''application/pdf'']'
 WHEN 413 THEN 'File exceeds 20MB limit' END AS reject_detail FROM (SELECT doc_id, k, CASE WHEN doc_id%2<>0 THEN 503 WHEN k='text/plain' THEN 415 WHEN n*1000>{SETTINGS.max_bytes} THEN 413 END c
 FROM (SELECT doc_id, ['image/jpeg','image/png','image/webp','image/tiff','application/pdf','text/plain'][doc_id%6+1] k, strlen(text) n FROM documents))""",
    "tasks_created": "SELECT CAST(doc_id AS VARCHAR) AS task_id, CAST(0 AS BIGINT) AS seq, 'f'||doc_id AS filename, 'processing' AS status, CAST(NULL AS VARCHAR) AS result_json, CAST(NULL AS VARCHAR) AS error, '2025-01-01T00:00:00+00:00' AS created_at FROM documents",
    "submit_responses": "SELECT CAST(doc_id AS VARCHAR) AS task_id, 'processing' AS status, 'f'||doc_id AS filename FROM documents",
    "status_responses": f"""SELECT CAST(user_id AS VARCHAR) AS task_id, {STATUS_SQL} AS status, 'f'||user_id AS filename, CASE WHEN event_type='purchase' THEN CAST(json_extract(props,'$.k') AS INTEGER) END AS k,
 CASE WHEN event_type='error' THEN 'boom' END AS error, {ISO_SQL.format(t='ts')} AS created_at, {ISO_SQL.format(t='ts')} AS updated_at FROM {LATEST_SQL}""",
    "load_summary": f"SELECT count(*) AS requested, count(*) FILTER (WHERE loaded) AS loaded, count(*) FILTER (WHERE NOT loaded) AS failed FROM {REGISTRY_SQL} WHERE ordinal IS NOT NULL",
    "task_restamp": f"SELECT CAST(user_id AS VARCHAR) AS task_id, seq+1 AS seq, 'f'||user_id AS filename, 'processing' AS status, CAST(NULL AS VARCHAR) AS result_json, CAST(NULL AS VARCHAR) AS error, '2025-01-01T00:00:00+00:00' AS updated_at FROM {LATEST_SQL}",
    "stream_stop_resume": f"SELECT {STATUS_SQL} AS status, count(*) AS n FROM events GROUP BY 1",
    "admission_gate": f"""SELECT doc_id, k AS content_type, n AS size_bytes, CASE WHEN k='text/plain' THEN 415 WHEN n*1000>{SETTINGS.max_bytes} THEN 413 END AS reject_code
 FROM (SELECT doc_id, ['image/jpeg','image/png','image/webp','image/tiff','application/pdf','text/plain'][doc_id%6+1] k, strlen(text) n FROM documents)""",
    "magic_sniff": "SELECT doc_id, starts_with(CASE doc_id%3 WHEN 0 THEN '%PDF-1.7 ' WHEN 1 THEN ' %PDF' ELSE '' END||text, '%PDF') AS is_pdf FROM documents",
    "strip_parity": f"SELECT conv_id, turn, trim({STRIP_SQL}||text||{STRIP_SQL}, {STRIP_SQL}) AS stripped FROM conversations",
    "data_url": "SELECT conv_id, turn, 'data:image/png;base64,'||base64(encode(text)) AS url FROM conversations",
    "task_latest": f"""SELECT CAST(user_id AS VARCHAR) AS task_id, seq, {STATUS_SQL} AS status, CASE WHEN event_type='purchase' THEN props END AS result_json,
 CASE WHEN event_type='error' THEN 'boom' END AS error, {ISO_SQL.format(t='ts')} AS updated_at FROM {LATEST_SQL}""",
    "task_update": f"SELECT CAST(user_id AS VARCHAR) AS task_id, seq+1 AS seq, 'f'||user_id AS filename, 'completed' AS status, CAST(NULL AS VARCHAR) AS result_json, CAST(NULL AS VARCHAR) AS error FROM documents JOIN {LATEST_SQL} ON doc_id=user_id",
    "status_counts_zero_filled": f"""SELECT status, coalesce(n,0) AS n FROM (VALUES ('processing'),('completed'),('failed')) d(status) FULL OUTER JOIN
 (SELECT CASE WHEN {STATUS_SQL}='failed' THEN 'lost' ELSE {STATUS_SQL} END status, count(*) n FROM events GROUP BY 1) USING (status)""",
    "restart_recovery": f"""SELECT event_id AS seq, CAST(user_id AS VARCHAR) AS task_id, CASE WHEN s='processing' THEN 'failed' ELSE s END AS status, CASE WHEN s='completed' THEN props END AS result_json,
 CASE s WHEN 'processing' THEN 'Server restarted before task completed.' WHEN 'failed' THEN 'boom' END AS error,
 CASE WHEN s='processing' THEN '2025-01-01T00:00:00+00:00' ELSE {ISO_SQL.format(t='ts')} END AS updated_at FROM (SELECT *, {STATUS_SQL} s FROM events)""",
    "json_path": "SELECT event_id, CAST(json_extract(props,'$.k') AS INTEGER) AS k, 'k='||json_extract_string(props,'$.k') AS content FROM events",
    "active_model": f"SELECT arg_min(name, ordinal) FILTER (WHERE loaded AND ordinal IS NOT NULL) AS active_model FROM {REGISTRY_SQL}",
    "active_failure": f"SELECT arg_min(name||': '||failure_reason, ordinal) FILTER (WHERE failure_reason<>'' AND ordinal IS NOT NULL) AS failure FROM {REGISTRY_SQL}",
    "status_lookup": f"""SELECT CAST(i AS VARCHAR) AS task_id, CASE WHEN user_id IS NULL THEN 404 ELSE 200 END AS code, CASE WHEN user_id IS NOT NULL THEN {STATUS_SQL} END AS status
 FROM (SELECT unnest([min(user_id), max(user_id), max(user_id)+1]) i FROM events) LEFT JOIN {LATEST_SQL} ON user_id=i""",
    "queue_semi_filter": "SELECT doc_id AS task_id FROM documents SEMI JOIN events ON doc_id=user_id",
    "backlog": f"SELECT count(*) AS queue_size FROM {LATEST_SQL} WHERE {STATUS_SQL}='processing'",
    "health_snapshot": f"""SELECT 'healthy' AS status, 'ok' AS api, true AS model_loaded, 'beta,delta,gamma' AS loaded_models, true AS worker_running, CAST(0 AS BIGINT) AS queue_size,
 count(*) FILTER (WHERE s='processing') AS n_processing, count(*) FILTER (WHERE s='completed') AS n_completed, count(*) FILTER (WHERE s='failed') AS n_failed FROM (SELECT {STATUS_SQL} s FROM {LATEST_SQL})""",
    "stream_task_counts": f"SELECT {STATUS_SQL} AS status, count(*) AS n FROM events GROUP BY 1",
}
