"""Admission rules on uploads (FLT-1..3, FLT-11): one ordered CASE, so the first failing rule decides."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.text import is_pdf
from folioflow.schemas import NO_MODEL_ERROR
from folioflow.settings import Settings


def rejection_code(content_type: Column, size: Column, model_loaded: Column, settings: Settings) -> Column:
    """503, then 415, then 413; NULL when admitted. A file of exactly the cap, or of no bytes, is admitted."""
    allowed = F.coalesce(content_type.isin(*settings.allowed_types), F.lit(False))
    return (
        F.when(~model_loaded, F.lit(503))
        .when(~allowed, F.lit(415))
        .when(F.coalesce(size, F.lit(0)) > F.lit(settings.max_bytes), F.lit(413))
    )


def rejection_detail(code: Column, content_type: Column, failure: Column, settings: Settings) -> Column:
    kinds = "[" + ", ".join(f"'{x}'" for x in settings.allowed_types) + "]"
    return (
        F.when(code == 503, no_model_text(failure))
        .when(code == 415, F.concat(F.lit("Unsupported file type: "), F.coalesce(content_type, F.lit("None")), F.lit(f". Allowed: {kinds}")))
        .when(code == 413, F.lit(f"File exceeds {settings.max_file_size_mb}MB limit"))
    )


def no_model_text(failure: Column) -> Column:
    return F.concat(F.lit(NO_MODEL_ERROR), F.when(F.coalesce(failure, F.lit("")) != "", F.concat(F.lit(" Startup error: "), failure)).otherwise(""))


def admit(uploads: DataFrame, settings: Settings, active_model: str | None, failure: str | None = None) -> DataFrame:
    """Adds size_bytes, is_pdf, reject_code and reject_detail. Rejected rows stay; filter them before a Python stage."""
    size = F.coalesce(F.octet_length("content"), F.lit(0)).cast("bigint")
    out = uploads.withColumns({"size_bytes": size, "is_pdf": is_pdf(F.col("content"))})
    out = out.withColumn("reject_code", rejection_code(F.col("content_type"), F.col("size_bytes"), F.lit(active_model is not None), settings))
    return out.withColumn("reject_detail", rejection_detail(F.col("reject_code"), F.col("content_type"), F.lit(failure).cast("string"), settings))


def admitted(uploads: DataFrame) -> DataFrame:
    return uploads.filter(F.col("reject_code").isNull())
