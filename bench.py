"""Runs the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line. Median of 3 runs to a noop sink.

With --plain, each query alternates with a bare Spark SQL form of the same result in the same session, which takes the
"""

import json
import os
import statistics
import sys
import time

from folioflow.functions.text import WHITESPACE
from folioflow.plans import catalog
from folioflow.session import get_spark

HEADLINE = [
    "admission_gate", "magic_sniff", "page_explode", "raw_text_join", "doc_quality", "task_latest", "status_counts_zero_filled",
    "restart_recovery", "data_url", "json_path", "strip_parity", "zero_page_docs", "queue_semi_filter", "recognize_stub",
]

_STATE = "CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'processing' END"
_ISO = "replace(date_format(cast(ts AS timestamp), \"yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx\"), '.000000', '')"
_BLANK = "".join(f"\\u{ord(c):04x}" for c in WHITESPACE)
_PAGES = f"""(SELECT cast(conv_id AS string) task_id, turn, btrim(CASE WHEN turn%4=3 OR conv_id%10=0 THEN '' WHEN turn%4=2
 THEN concat('\\u3000\\u001c', text, '\\u00a0\\n') ELSE text END, '{_BLANK}') t FROM conversations)"""
_RAW = "array_join(transform(filter(array_sort(collect_list(struct(turn, t))), x -> x.t <> ''), x -> x.t), '\\n\\n')"
PLAIN = {
    "admission_gate": """SELECT doc_id, kind, octet_length(text) n, CASE WHEN kind = 'text/plain' THEN 415 WHEN octet_length(text)*1000 > 20971520 THEN 413 END
 FROM (SELECT *, element_at(array('image/jpeg','image/png','image/webp','image/tiff','application/pdf','text/plain'), cast(doc_id%6+1 AS int)) kind FROM documents)""",
    "magic_sniff": "SELECT doc_id, substring(cast(concat(CASE doc_id%3 WHEN 0 THEN '%PDF-1.7 ' WHEN 1 THEN ' %PDF' ELSE '' END, text) AS binary), 1, 4) = X'25504446' FROM documents",
    "page_explode": "SELECT doc_id, i, t FROM documents LATERAL VIEW posexplode(slice(split(text, '\\n'), 1, 20)) x AS i, t",
    "raw_text_join": f"SELECT task_id, {_RAW} FROM {_PAGES} GROUP BY task_id",
    "doc_quality": f"""SELECT task_id, n, lines, length(s), if(s = '', 'empty', 'generated'), if(s = '', 'no_text_detected', '')
 FROM (SELECT task_id, count(*) n, count_if(t <> '') lines, btrim({_RAW}, '{_BLANK}') s FROM {_PAGES} GROUP BY task_id)""",
    "task_latest": f"""SELECT cast(user_id AS string), r.event_id, r.s, if(r.s = 'completed', r.props, NULL), if(r.s = 'failed', 'boom', NULL), r.u
 FROM (SELECT user_id, max_by(struct(event_id, {_STATE} s, props, {_ISO} u), struct(ts, event_id)) r FROM events GROUP BY user_id)""",
    "status_counts_zero_filled": f"""SELECT status, coalesce(n, 0) FROM (VALUES ('processing'), ('completed'), ('failed')) d(status)
 FULL OUTER JOIN (SELECT if({_STATE} = 'failed', 'lost', {_STATE}) status, count(*) n FROM events GROUP BY 1) USING (status)""",
    "restart_recovery": f"""SELECT event_id, cast(user_id AS string), if(s = 'processing', 'failed', s), if(s = 'completed', props, NULL),
 CASE s WHEN 'processing' THEN 'Server restarted before task completed.' WHEN 'failed' THEN 'boom' END,
 if(s = 'processing', '2025-01-01T00:00:00+00:00', {_ISO}) FROM (SELECT *, {_STATE} s FROM events)""",
    "data_url": "SELECT conv_id, turn, concat('data:image/png;base64,', replace(base64(encode(text, 'utf-8')), '\\r\\n', '')) FROM conversations",
    "json_path": f"""SELECT event_id, cast(k AS int), btrim(get_json_object(concat('{{"choices":[{{"message":{{"content":" k=', k, ' "}}}}]}}'), '$.choices[0].message.content'), '{_BLANK}')
 FROM (SELECT event_id, get_json_object(props, '$.k') k FROM events)""",
}


def seconds(make) -> float:
    t = time.perf_counter()
    make().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = get_spark("bench", int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8)))
    out = {"metric": "total_median_query_time", "value": 0.0, "unit": "sec"}
    median = lambda runs: round(statistics.median(runs[1:]), 4)
    if "--plain" in sys.argv:
        for name in ("documents", "conversations", "events"):
            spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
        both = {k: [(seconds(lambda: catalog.QUERIES[k](spark, sf_dir)), seconds(lambda: spark.sql(PLAIN[k]))) for _ in range(6)] for k in PLAIN}  # noqa: B023
        out["queries"] = {k: median([a for a, _ in v]) for k, v in both.items()}
        out["plain"] = {k: median([b for _, b in v]) for k, v in both.items()}
        out["ratio"] = {k: round(out["queries"][k] / out["plain"][k], 2) for k in PLAIN}
    else:
        out["queries"] = {k: median([seconds(lambda: catalog.QUERIES[k](spark, sf_dir)) for _ in range(4)]) for k in HEADLINE}  # noqa: B023
    out |= {"value": round(sum(out["queries"].values()), 4), "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}
    print(json.dumps(out))


if __name__ == "__main__":
    main()
