"""Pages to document (AGG-2..AGG-7, PRJ-2..PRJ-5): built-in functions only, one shuffle on task_id."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow import schemas as S
from folioflow.functions.text import elapsed_ms, join_nonempty, py_strip
from folioflow.settings import Settings


def line_struct(index: Column, text: Column) -> Column:
    """PRJ-2."""
    return F.struct(
        index.cast("int").alias("page_index"), F.lit(0).alias("line_index"), text.alias("text"), text.alias("raw_text"),
        F.lit(0.0).alias("confidence"), F.lit(None).cast("array<double>").alias("bbox"),
        F.struct(F.lit(S.BBOX_SOURCE).alias("source")).alias("bbox_source"), F.lit(False).alias("bbox_valid"),
        F.lit("generated").alias("status"),
    ).cast(S.LINE)


def page_struct(index: Column, text: Column) -> Column:
    """PRJ-3, AGG-7. A page of white space still has a line: only '' has none."""
    lines = F.when(text != "", F.array(line_struct(index, text))).otherwise(F.array().cast(f"array<{S.LINE}>"))
    return F.struct(
        index.cast("int").alias("page_index"), text.alias("text"), text.alias("raw_text"), lines.alias("lines"),
        lines.alias("accepted_lines"), F.lit(S.LAYOUT_MODE).alias("layout_mode"), F.array().cast("array<string>").alias("tables"),
        F.struct(F.size(lines).alias("block_count"), F.lit(0).alias("table_count")).alias("totals"),
        F.lit(0.0).alias("avg_confidence"),
    ).cast(S.PAGE)


def gather(page_texts: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """One row a document: (task_id, pages array<struct<page_index, page_text>>, error, raw_text).

    With `documents`, those without pages stay, with an empty array (E8). error is the first page's that failed
    (E2). NULL text counts as ''. A document's pages meet in one row, as its result is one row by contract. Pages
    with elapsed_s, of a timed recognizer, give elapsed_ms (FN-10, UDF-5).
    """
    timed = "elapsed_s" in page_texts.columns
    text = F.coalesce(F.col("page_text"), F.lit(""))
    rows = page_texts.groupBy("task_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("page_index") >= 0, F.struct("page_index", text.alias("page_text"))))).alias("pages"),
        F.min_by("error", F.when(F.col("error").isNotNull(), F.col("page_index"))).alias("error"),
        *([elapsed_ms(F.sum("elapsed_s")).alias("elapsed_ms")] if timed else []),
    )
    if documents is not None:
        rows = documents.select(F.col("task_id").cast("string").alias("task_id")).join(rows, "task_id", "left")
        rows = rows.withColumn("pages", F.coalesce("pages", F.array().cast("array<struct<page_index:int,page_text:string>>")))
    return rows.withColumn("raw_text", join_nonempty(F.col("pages.page_text")))


def with_quality(gathered: DataFrame) -> DataFrame:
    """Adds page_count, line_count, char_count, status, warnings. Status looks at the stripped text, lines don't (E7)."""
    stripped = py_strip(F.col("raw_text"))
    empty = stripped == ""
    return gathered.withColumns(
        {
            "page_count": F.size("pages").cast("bigint"),
            "line_count": F.size(F.filter("pages", lambda p: p["page_text"] != "")).cast("bigint"),
            "char_count": F.length(stripped).cast("bigint"),
            "status": F.when(empty, F.lit("empty")).otherwise("generated"),
            "warnings": F.when(empty, F.array(F.lit("no_text_detected"))).otherwise(F.array().cast("array<string>")),
        }
    )


def generation_struct(settings: Settings) -> Column:
    remote = settings.provider.lower() == "vllm"
    values = {
        "provider": settings.provider.lower(),
        "pipeline": S.REMOTE_PIPELINE if remote else S.LOCAL_PIPELINE,
        "model_id": settings.model_id,
        "vllm_base_url": settings.base_url.rstrip("/") if remote else None,
        "device_map": settings.device_map,
        "max_new_tokens": settings.max_new_tokens,
        "prompt": settings.prompt,
        "pdf_dpi": settings.pdf_dpi,
        "max_pdf_pages": settings.max_pdf_pages,
    }
    return F.struct(*[F.lit(v).alias(k) for k, v in values.items()]).cast(S.GENERATION)


def envelope(quality: DataFrame, settings: Settings, model_name: str = S.MODEL_NAME, elapsed_ms: Column | None = None) -> DataFrame:
    """PRJ-4, PRJ-5: (task_id, result struct<res>, error). A document with an error has no result."""
    text = F.col("raw_text")
    note = F.struct(
        F.col("status"), F.col("warnings"), F.col("line_count"), F.col("char_count"), F.lit(0.0).alias("avg_confidence"),
        F.lit(S.CONFIDENCE_NOTE).alias("confidence_note"),
    )
    res = F.struct(
        F.col("page_count"), text.alias("final_text"), text.alias("raw_text_before_correction"),
        F.lit(settings.model_id).alias("selected_variant"), F.lit(0.0).alias("confidence_score"),
        F.lit(S.LAYOUT_MODE).alias("layout_mode"),
        F.transform("pages", lambda p: page_struct(p["page_index"], p["page_text"])).alias("pages"),
        F.array().cast("array<string>").alias("tables"), text.alias("markdown_text"), note.alias("quality"),
        generation_struct(settings).alias("generation"), F.lit(model_name).alias("model_name"),
        (F.lit(0.0) if elapsed_ms is None else elapsed_ms).alias("inference_time_ms"),
    )
    result = F.when(F.col("error").isNull(), F.struct(res.alias("res")).cast(S.RESULT))
    return quality.select("task_id", result.alias("result"), "error")


def assemble(page_texts: DataFrame, settings: Settings, documents: DataFrame | None = None, model_name: str = S.MODEL_NAME) -> DataFrame:
    quality = with_quality(gather(page_texts, documents))
    took = F.coalesce("elapsed_ms", F.lit(0.0)) if "elapsed_ms" in quality.columns else None
    return envelope(quality, settings, model_name, took)
