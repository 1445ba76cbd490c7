"""Scalar functions (FN-1..FN-20) as Column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points Python's str.strip() removes.
WHITESPACE = "".join(
    map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)


def py_strip(c: Column) -> Column:
    """FN-1. Strips the 29 Unicode white-space characters at both ends; NULL stays NULL."""
    return F.btrim(c, F.lit(WHITESPACE))


def rstrip_slash(c: Column) -> Column:
    """FN-2."""
    return F.rtrim(c, F.lit("/"))


def is_pdf(content: Column) -> Column:
    """FLT-3, FN-4. The first four bytes are %PDF; leading white space isn't skipped."""
    return F.coalesce(F.substring(content.cast("binary"), 1, 4) == F.lit(b"%PDF"), F.lit(False))


def base64_plain(content: Column) -> Column:
    """FN-8. Base64 without the line breaks that Spark may add (T4)."""
    return F.replace(F.base64(content.cast("binary")), F.lit("\r\n"), F.lit(""))


def data_url(png: Column) -> Column:
    """PRJ-9."""
    return F.concat(F.lit("data:image/png;base64,"), base64_plain(png))


def iso_utc(ts: Column) -> Column:
    """FN-18. Like Python's isoformat(): no fraction when the microseconds are 0. The session is in UTC."""
    ts = ts.cast("timestamp")
    return F.replace(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx"), F.lit(".000000"), F.lit(""))


def to_json_full(c: Column) -> Column:
    """FN-13. Keeps NULL fields, as the results contain "bbox": null (T3); a NULL value stays SQL NULL."""
    return F.to_json(c, {"ignoreNullFields": "false"})


def result_from_json(c: Column, schema: str) -> Column:
    """FN-14, FLT-13. NULL or '' gives NULL."""
    return F.from_json(F.nullif(c, F.lit("")), schema)


def chat_content(response: Column) -> Column:
    """FN-15, FN-16. Text of a chat response, stripped."""
    return py_strip(F.get_json_object(response, "$.choices[0].message.content"))


def chat_payload(url: Column, model_id: str, prompt: str, max_new_tokens: int) -> Column:
    """PRJ-8. The chat request as JSON text: image first, then prompt."""
    image = F.to_json(F.struct(F.lit("image_url").alias("type"), F.struct(url.alias("url")).alias("image_url")))
    text = F.to_json(F.struct(F.lit("text").alias("type"), F.lit(prompt).alias("text")))
    head = F.to_json(F.struct(F.lit(model_id).alias("m")))
    return F.concat(
        F.lit('{"model":'), F.substring(head, 6, 1_000_000).substr(F.lit(1), F.length(head) - 6),
        F.lit(',"messages":[{"role":"user","content":['), image, F.lit(","), text,
        F.lit(f']}}],"max_tokens":{int(max_new_tokens)},"temperature":0}}'),
    )


def join_nonempty(items: Column, sep: str = "\n\n") -> Column:
    """AGG-3, FN-6. Joins the non-empty strings of an array; '' when there is none."""
    return F.array_join(F.filter(items, lambda x: x.isNotNull() & (x != "")), sep)


def new_task_id() -> Column:
    """FN-17. Only for ids at the edge: uuid() isn't deterministic (T9)."""
    return F.expr("uuid()")


def stable_id(*keys: Column) -> Column:
    """A deterministic id from stable keys, for jobs that may be retried."""
    return F.sha2(F.to_json(F.struct(*[k.cast("string").alias(f"k{i}") for i, k in enumerate(keys)])), 256)


def elapsed_ms(seconds: Column) -> Column:
    """FN-10."""
    return F.round(seconds * 1000, 2)
