"""Operator 5, WARC: archives written and read back, with transactions assembled from their records.

Writing: each page gives a request, a response (or revisit) and a metadata record; the latter name the response in
WARC-Concurrent-To. A record ends with CRLF CRLF, which is the text writer's line separator, so Spark's own committed
writer makes the files and a lost task leaves nothing behind. Archives are gzip files of about ARCHIVE_BYTES.

Reading: binary files are parsed record by record by Content-Length. Records are brought together by the identifier
of their capture, which gives one nested row for each capture.

Defined cases: a NULL page counts as no bytes, a NULL url as ''. Rows that repeat a page_id are captures of their
own. Of equal payloads of REVISIT_BYTES or more, the largest page_id is the response; where rows repeat that id all
of them are. A NULL page_id is never revisited nor a revisit. Only the id, url and page are read. An empty table gives no captures.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.common import documents, in_arrow
from folioflow.sources.shared import new_path, remove, written

REVISIT_BYTES = 1000
ARCHIVE_BYTES = 16 << 20
CRLF = "\r\n"
DATE = "2024-01-01T00:00:00Z"
# Fixed value: the profile of the standard for equal payloads.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

CAPTURE = (
    "capture_id string, page_id bigint, url string, response struct<type:string,refers_to:string,payload_bytes:bigint,payload_digest:string,payload:binary>, "
    "request struct<method:string,path:string>, metadata struct<payload_bytes:bigint,payload_digest:string>"
)


# ---- writing ----


def judged(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", text_col: str = "html") -> DataFrame:
    """(page_id, url, html, payload_bytes, payload_digest, refers_to, refers_url). Digests are counted before the
    join, so a payload that a third of the rows share is one row on the joined side."""
    html = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    p = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), html.alias("html"))
    p = p.withColumns({"payload_bytes": F.octet_length("html").cast("bigint"), "payload_digest": F.sha1(F.col("html").cast("binary"))})
    large = p.filter(F.col("payload_bytes") >= REVISIT_BYTES).groupBy("payload_digest").agg(F.max(F.struct("page_id", "url")).alias("x"), F.count("*").alias("n"))
    large = written(large.filter("n > 1 AND x.page_id IS NOT NULL").select("payload_digest", F.col("x.page_id").alias("last"), F.col("x.url").alias("last_url")), "revisited")
    p = p.join(large, "payload_digest", "left")
    other = (F.col("payload_bytes") >= REVISIT_BYTES) & (F.col("page_id") != F.col("last"))
    return p.select("page_id", "url", "html", "payload_bytes", "payload_digest", F.when(other, F.col("last")).alias("refers_to"), F.when(other, F.col("last_url")).alias("refers_url"))


def uuid_of(*parts) -> Column:
    h = F.md5(F.concat_ws(":", *parts).cast("binary"))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def record(kind: str, rid: Column, target: Column, block: Column, extra: list) -> Column:
    """One record without its end, as text. Header lines that are NULL are left out."""
    line = lambda k, v: F.when(v.isNotNull(), F.concat(F.lit(f"{k}: "), v, F.lit(CRLF))).otherwise(F.lit(""))
    head = [line("WARC-Type", F.lit(kind)), line("WARC-Record-ID", rid), line("WARC-Date", F.lit(DATE)), line("WARC-Target-URI", F.regexp_replace(target, "[\r\n]", ""))]
    head += [line(k, v) for k, v in extra]
    return F.concat(F.lit("WARC/1.1" + CRLF), *head, line("Content-Length", F.octet_length(block).cast("string")), F.lit(CRLF), block)


def records(pages: DataFrame) -> DataFrame:
    """judged() rows to (record), three for a page. Ids come from page_id and a number of the row."""
    n = F.monotonically_increasing_id().cast("string")
    p = pages.withColumn("cid", uuid_of(F.lit("capture"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), n))
    path = F.regexp_extract("url", r"^[^:]*://[^/?#]*([^#\r\n]*)", 1)
    host = F.regexp_extract("url", r"://([^/?#\r\n]*)", 1)
    page = F.col("page_id").cast("string")
    is_revisit = F.col("refers_to").isNotNull()
    http = F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}{CRLF}")
    digest = F.concat(F.lit("sha1:"), "payload_digest")
    common = [("WARC-Payload-Digest", digest), ("X-Page-ID", page), ("Content-Type", F.lit("application/http;msgtype=response"))]
    response = record("response", F.col("cid"), F.col("url"), F.concat(http, "html"), common)
    revisit = record("revisit", F.col("cid"), F.col("url"), http, [*common, ("WARC-Profile", F.lit(PROFILE)), ("X-Refers-To-Page-ID", F.col("refers_to").cast("string")), ("WARC-Refers-To-Target-URI", F.regexp_replace("refers_url", "[\r\n]", "")), ("WARC-Refers-To-Date", F.lit(DATE))])
    asked = F.concat(F.lit("GET "), F.when(path == "", F.lit("/")).otherwise(path), F.lit(f" HTTP/1.1{CRLF}Host: "), host, F.lit(CRLF * 2))
    request = record("request", uuid_of(F.lit("request"), F.col("cid")), F.col("url"), asked, [("WARC-Concurrent-To", F.col("cid")), ("X-Page-ID", page), ("Content-Type", F.lit("application/http;msgtype=request"))])
    fields = F.concat(F.lit("payload-bytes: "), F.col("payload_bytes").cast("string"), F.lit(f"{CRLF}payload-sha1: "), "payload_digest", F.lit(CRLF))
    metadata = record("metadata", uuid_of(F.lit("metadata"), F.col("cid")), F.col("url"), fields, [("WARC-Concurrent-To", F.col("cid")), ("X-Page-ID", page), ("Content-Type", F.lit("application/warc-fields"))])
    return p.select(F.explode(F.array(request, F.when(is_revisit, revisit).otherwise(response), metadata)).alias("record"))


def write_archives(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """judged() rows to gzip archives in a folder; their number follows from the bytes to write."""
    total = pages.agg(F.sum(F.when(F.col("refers_to").isNull(), F.col("payload_bytes")).otherwise(0) + 1500)).first()[0] or 0
    dealt = pages.repartition(1 + int(total) // archive_bytes, "page_id", "url")
    records(dealt).write.option("lineSep", CRLF * 2).option("compression", "gzip").text(path)


# ---- reading ----


def inflated(data: bytes, chunk: int = 1 << 16) -> bytes:
    """All members of a gzip file, in time linear in it. One that is cut off is an error."""
    out, at, view = [], 0, memoryview(data)
    while at < len(data):
        d = zlib.decompressobj(31)
        while not d.eof:
            if at >= len(data):
                raise ValueError("the archive is cut off")
            out.append(d.decompress(view[at : at + chunk]))
            at += len(view[at : at + chunk])
        at -= len(d.unused_data)
    return b"".join(out)


def parsed(data: bytes) -> Iterator[tuple[dict[str, str], memoryview]]:
    """(headers, block) of the records of one archive, plain or gzip with one or more members."""
    if data[:2] == b"\x1f\x8b":
        data = inflated(data)
    view, at = memoryview(data), 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if not data.startswith(b"WARC/", at) or end < 0:
            raise ValueError(f"no record at byte {at}")
        lines = data[at:end].decode("utf-8", "replace").split(CRLF)[1:]
        head: dict[str, str] = {}
        for k, _, v in (x.partition(":") for x in lines):
            head.setdefault(k.strip().lower(), v.strip())  # of a repeated name, such as concurrent-to, the first
        start = end + 4
        at = start + int(head["content-length"])
        yield head, view[start:at]
        if data[at : at + 4] != b"\r\n\r\n":
            raise ValueError(f"record ends wrongly at byte {at}")
        at += 4


RECORD = "capture_id string, kind string, page_id bigint, url string, refers_to string, payload_bytes bigint, payload_digest string, payload binary, method string, path string"
COLUMNS = [x.split()[0] for x in RECORD.split(", ")]


def fields_of(head: dict[str, str], block: memoryview, with_payload: bool) -> dict:
    kind = head["warc-type"]
    row = dict.fromkeys(COLUMNS)
    page = head.get("x-page-id")
    row |= {"capture_id": head.get("warc-concurrent-to") or head["warc-record-id"], "kind": kind, "url": head.get("warc-target-uri", ""), "page_id": int(page) if page else None}
    raw = bytes(block)
    if kind == "response":
        body = raw[raw.find(b"\r\n\r\n") + 4 :]
        row |= {"payload_bytes": len(body), "payload_digest": hashlib.sha1(body).hexdigest(), "payload": body if with_payload else None}
        if head.get("warc-payload-digest", "") != "sha1:" + row["payload_digest"]:
            raise ValueError(f"digest of {head['warc-record-id']} differs")
    elif kind == "revisit":
        row |= {"refers_to": head.get("x-refers-to-page-id"), "payload_digest": head.get("warc-payload-digest", "").removeprefix("sha1:")}
    elif kind == "request":
        line = raw.split(b"\r\n", 1)[0].decode("utf-8", "replace")
        row["method"], _, rest = line.partition(" ")
        row["path"] = rest.rpartition(" ")[0]
    elif kind == "metadata":
        got = dict(x.split(": ", 1) for x in raw.decode().split(CRLF) if x)
        row |= {"payload_bytes": int(got["payload-bytes"]), "payload_digest": got["payload-sha1"]}
    return row


def read_records(spark: SparkSession, path: str, with_payload: bool = True, rows_per_batch: int = 256) -> DataFrame:
    schema = pa.schema([(n, {"bigint": pa.int64(), "binary": pa.binary()}.get(k, pa.string())) for n, k in (x.split() for x in RECORD.split(", "))])

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                rows = []
                for head, block in parsed(batch.column(0)[i].as_py()):
                    rows.append(fields_of(head, block, with_payload))
                    if len(rows) >= rows_per_batch:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return in_arrow(spark.read.format("binaryFile").load(path).select("content"), run, RECORD)


def assemble(recs: DataFrame) -> DataFrame:
    """Records to captures (CAPTURE): one group by capture id, of three records each."""
    pick = lambda kinds, cols: F.max(F.when(F.col("kind").isin(*kinds), F.struct(*cols)))
    main = [F.col("kind").alias("type"), "refers_to", "payload_bytes", "payload_digest", "payload"]
    return recs.groupBy("capture_id").agg(
        F.max("page_id").alias("page_id"), F.max("url").alias("url"), pick(["response", "revisit"], main).alias("response"),
        pick(["request"], ["method", "path"]).alias("request"), pick(["metadata"], ["payload_bytes", "payload_digest"]).alias("metadata"),
    )


def captures(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    return assemble(read_records(spark, path, with_payload))


def query(spark, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_archives(judged(documents(spark, sf_dir, "pages")), path)
    c = captures(spark, path, with_payload=False)
    size = F.coalesce("response.payload_bytes", "metadata.payload_bytes")
    out = written(c.select("page_id", size.alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest"), F.col("response.type").alias("record_type"), F.col("response.refers_to").cast("bigint").alias("refers_to")), "captures")
    remove(spark, path)
    return out


SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html,'')) n, sha1(coalesce(html,'')) d FROM pages), m AS (SELECT d, max(page_id) last FROM p WHERE n>=1000 GROUP BY d)
SELECT page_id, n AS payload_bytes, p.d AS payload_digest, CASE WHEN last<>page_id THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN last<>page_id THEN last END AS refers_to FROM p LEFT JOIN m ON p.d=m.d AND n>=1000"""
