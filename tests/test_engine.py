"""Hand-made cases G1-G21, E1-E12 and T1-T9 of the blueprint, by the ids of its section 2."""

import base64
import json
import urllib.error
from datetime import datetime, timezone

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from folioflow import schemas as S
from folioflow.cli import text_of
from folioflow.functions import text as X
from folioflow.operators import admission, assemble, pages, recognize, registry, serving, tasklog
from folioflow.settings import Settings
from folioflow.sources.shared import new_path
from folioflow.streaming import worker

CFG = Settings()
MIB20 = 20 * 1024 * 1024


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column.alias("x")).first().x


def texts_frame(spark, docs):
    rows = [(k, i, t, None) for k, ts in docs.items() for i, t in enumerate(ts)]
    return spark.createDataFrame(rows, S.PAGE_TEXTS)


# ---- settings, D14, SRC-8


def test_settings(tmp_path):
    env = tmp_path / ".env"
    env.write_text("# c\nMAX_FILE_SIZE_MB=5\nPROVIDER=\nUNKNOWN=1\nPDF_DPI='72'\nENABLED_MODELS=[\"a\",\"b\"]\n")
    s = Settings.load({"PDF_DPI": "100", "MODEL_ID": "", "LOW_CPU_MEM_USAGE": "false"}, env)
    assert (s.max_file_size_mb, s.pdf_dpi, s.provider, s.enabled_models, s.low_cpu_mem_usage, s.max_bytes) == (5, 100, "vllm", ("a", "b"), False, 5 << 20)
    assert s.model_id == CFG.model_id and CFG.max_pdf_pages == 20 and CFG.max_new_tokens == 4096
    with pytest.raises(ValueError):
        Settings.load({"LOW_CPU_MEM_USAGE": "maybe"})


# ---- FN-1..FN-20


@given(st.text(alphabet=st.sampled_from(list(X.WHITESPACE) + list("ab​😀")), max_size=12))
@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_strip_is_pythons(spark, s):
    assert one(spark, X.py_strip(F.col("v")), v=s) == s.strip()


def test_whitespace_is_all_of_it():
    assert {c for c in map(chr, range(0x110000)) if c.isspace()} == set(X.WHITESPACE) and len(X.WHITESPACE) == 29


def test_scalars(spark):
    assert one(spark, X.rstrip_slash(F.col("v")), v="http://h/v1//") == "http://h/v1"
    raw = bytes(range(256)) * 2
    assert one(spark, X.data_url(F.col("v")), v=bytearray(raw)) == "data:image/png;base64," + base64.b64encode(raw).decode()
    assert [one(spark, X.is_pdf(F.col("v")), v=bytearray(b)) for b in (b"%PDF-1.7", b" %PDF", b"", b"%PD")] == [True, False, False, False]
    assert one(spark, F.length(X.py_strip(F.col("v"))), v="a😀é") == 3
    for micros in (0, 120000):
        t = datetime(2024, 5, 6, 7, 8, 9, micros, tzinfo=timezone.utc)
        assert one(spark, X.iso_utc(F.col("v")), v=t) == t.isoformat()
    reply = json.dumps({"choices": [{"message": {"content": "　text\n"}}]})
    assert one(spark, X.chat_content(F.col("v")), v=reply) == "text"
    payload = json.loads(one(spark, X.chat_payload(F.col("v"), 'm"1', 'say "hi"\n', 7), v="data:x"))
    image = {"type": "image_url", "image_url": {"url": "data:x"}}
    assert payload == {"model": 'm"1', "messages": [{"role": "user", "content": [image, {"type": "text", "text": 'say "hi"\n'}]}], "max_tokens": 7, "temperature": 0}
    assert one(spark, X.elapsed_ms(F.col("v")), v=0.0123456) == 12.35
    assert len(one(spark, X.new_task_id(), v=1)) == 36
    assert one(spark, X.stable_id(F.col("v")), v="a") == one(spark, X.stable_id(F.col("v")), v="a") != one(spark, X.stable_id(F.col("v")), v="b")
    d = spark.createDataFrame([("",), (None,), ('{"a":1}',)], "v string").select(X.result_from_json(F.col("v"), "a int").alias("x"))
    assert [r.x and r.x.a for r in d.collect()] == [None, None, 1]


# ---- FLT-1..3, FLT-11, G1-G4


def test_admission(spark):
    assert one(spark, admission.rejection_code(F.col("t"), F.col("n"), F.lit(True), CFG), t="image/png", n=MIB20) is None
    assert one(spark, admission.rejection_code(F.col("t"), F.col("n"), F.lit(True), CFG), t="image/png", n=MIB20 + 1) == 413
    assert one(spark, admission.rejection_code(F.col("t"), F.col("n"), F.lit(True), CFG), t="text/plain", n=MIB20 + 1) == 415
    assert one(spark, admission.rejection_code(F.col("t"), F.col("n"), F.lit(False), CFG), t="text/plain", n=1) == 503
    up = spark.createDataFrame([("1", "a", "image/png", bytearray(b"")), ("2", "b", None, bytearray(b"%PDFx")), ("3", "c", "IMAGE/PNG", None)], S.UPLOADS)
    rows = admission.admit(up, CFG, "m").orderBy("upload_id").collect()
    assert [r.reject_code for r in rows] == [None, 415, 415] and [r.is_pdf for r in rows] == [False, True, False]
    assert rows[1].reject_detail == "Unsupported file type: None. Allowed: ['image/jpeg', 'image/png', 'image/webp', 'image/tiff', 'application/pdf']"
    assert admission.admitted(admission.admit(up, CFG, "m")).count() == 1
    assert {r.reject_detail for r in admission.admit(up, CFG, None, "m: boom").collect()} == {S.NO_MODEL_ERROR + " Startup error: m: boom"}
    assert {r.reject_detail for r in admission.admit(up, CFG, None, None).collect()} == {S.NO_MODEL_ERROR}


# ---- UDTF-1, LIM-1, E8, E9, G3, G5


def fake_pdf(content, cfg):
    for i in range(min(cfg.max_pdf_pages, content.count(b"P") - 1)):
        yield b"pdf%d" % i


def fake_image(content, cfg):
    if not content:
        raise ValueError("cannot identify image file")
    yield from content.split(b"|")


def test_pages(spark):
    up = spark.createDataFrame([("pdf", bytearray(b"%PDF" + b"P" * 25)), ("tif", bytearray(b"|".join([b"f"] * 25))), ("bad", bytearray(b"")), ("nul", None), ("zero", bytearray(b"%PDF"))], "task_id string, content binary")
    rows = pages.explode_pages(up, CFG, fake_pdf, fake_image).collect()
    n = {k: sum(r.task_id == k for r in rows) for k in ("pdf", "tif", "bad", "nul", "zero")}
    assert n == {"pdf": 20, "tif": 25, "bad": 1, "nul": 1, "zero": 0}
    assert {(r.page_index, r.error) for r in rows if r.task_id in ("bad", "nul")} == {(-1, "cannot identify image file")}
    real = pages.explode_pages(up.filter("task_id = 'pdf'"), CFG).collect()
    assert real[0].error == "PDF OCR with Qwen requires the 'pymupdf' package." or real[0].page_index >= 0 or real[0].error
    assert [bytes(x) for x in pages.decode_lines_capped(b"\n".join([b"a"] * 30), CFG)] == [b"a"] * 20


# ---- recognizers, UDF-1..5, FLT-9, FLT-10, SRC-9


def test_chat_recognizer():
    calls = []

    def transport(method, url, headers, body, timeout):
        calls.append((method, url, headers, body, timeout))
        return {"choices": [{"message": {"content": " hi "}}]}

    r = recognize.make_recognizer(Settings(provider="VLLM", base_url="http://h/v1//", api_key="k"), transport)
    r.load()
    assert r.read(b"img") == "hi"
    assert calls[0][:2] == ("GET", "http://h/v1/models") and calls[0][4] == 10.0
    assert calls[1][:2] == ("POST", "http://h/v1/chat/completions") and calls[1][2]["Authorization"] == "Bearer k" and calls[1][4] == 300.0
    assert calls[1][3]["messages"][0]["content"][0]["image_url"]["url"] == "data:image/png;base64," + base64.b64encode(b"img").decode()
    for key in ("", "EMPTY", "empty"):
        assert "Authorization" not in recognize.ChatRecognizer(Settings(api_key=key)).headers()

    def down(*a):
        raise urllib.error.URLError("no")

    with pytest.raises(RuntimeError, match="Could not reach vLLM at http://localhost:8000/v1. Start it first"):
        recognize.ChatRecognizer(CFG, down).load()
    with pytest.raises(ValueError, match="must be either 'vllm' or 'transformers'"):
        recognize.make_recognizer(Settings(provider="x"))
    local = recognize.make_recognizer(Settings(provider="Transformers"))
    with pytest.raises(RuntimeError, match="not initialized"):
        local.read(b"")
    bad = recognize.RecognizerOutput.failed("m", "boom")
    assert (bad.raw_text, bad.inference_time_ms, bad.avg_confidence, bad.error, bad.metadata) == ("", 0.0, 0.0, "boom", {})


def test_errors_stay_in_their_rows(spark):
    up = spark.createDataFrame([("a", bytearray(b"x|boom|y")), ("b", bytearray(b"ok")), ("c", bytearray(b""))], "task_id string, content binary")
    texts = recognize.recognize(pages.explode_pages(up, CFG, fake_pdf, fake_image), recognize.StubRecognizer(fail_on="boom"))
    got = {r.task_id: r for r in tasklog.finished(assemble.assemble(texts, CFG, up.select("task_id"))).collect()}
    assert (got["a"].status, got["a"].error, got["a"].result_json) == ("failed", "boom", None)
    assert got["b"].status == "completed" and json.loads(got["b"].result_json)["res"]["final_text"] == "ok"
    assert (got["c"].status, got["c"].error) == ("failed", "cannot identify image file")


def test_empty_error_message_fails(spark):
    class Silent(recognize.StubRecognizer):
        def read(self, image):
            raise RuntimeError("")

    up = spark.createDataFrame([("a", bytearray(b"x"))], "task_id string, content binary")
    r = tasklog.finished(assemble.assemble(recognize.recognize(pages.explode_pages(up, CFG, fake_pdf, fake_image), Silent()), CFG)).first()
    assert (r.status, r.error) == ("failed", "RuntimeError")


# ---- assembly, AGG-2..7, PRJ-2..5, G6-G11


def plain(texts):
    raw = "\n\n".join(t for t in texts if t)
    s = raw.strip()
    return {"page_count": len(texts), "raw_text": raw, "line_count": sum(t != "" for t in texts), "char_count": len(s), "status": "generated" if s else "empty", "warnings": [] if s else ["no_text_detected"]}


@given(st.lists(st.lists(st.sampled_from(["", " ", "a", "b\n", "　", "a😀é"]), max_size=5), min_size=1, max_size=6), st.randoms())
@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_assembly_is_the_plain_one(spark, docs, rnd):
    rows = [(str(k), i, t, None) for k, ts in enumerate(docs) for i, t in enumerate(ts)]
    rnd.shuffle(rows)
    ids = spark.createDataFrame([(str(k),) for k in range(len(docs))], "task_id string")
    got = assemble.with_quality(assemble.gather(spark.createDataFrame(rows, S.PAGE_TEXTS), ids)).collect()
    assert len(got) == len(docs)
    for r in got:
        want = plain(docs[int(r.task_id)])
        assert {k: r[k] for k in want} == want


def test_envelope(spark):
    t = texts_frame(spark, {"d": ["a", "", "b"]})
    r = tasklog.finished(assemble.assemble(t, CFG)).first()
    res = json.loads(r.result_json)["res"]
    assert list(res) == [x for x in "page_count final_text raw_text_before_correction selected_variant confidence_score layout_mode pages tables markdown_text quality generation model_name inference_time_ms".split()]
    assert res["final_text"] == res["markdown_text"] == res["raw_text_before_correction"] == "a\n\nb"
    line = {"page_index": 0, "line_index": 0, "text": "a", "raw_text": "a", "confidence": 0.0, "bbox": None, "bbox_source": {"source": "qwen_generated_text"}, "bbox_valid": False, "status": "generated"}
    assert res["pages"][0]["lines"] == res["pages"][0]["accepted_lines"] == [line] and res["pages"][1]["lines"] == []
    assert [p["totals"] for p in res["pages"]] == [{"block_count": n, "table_count": 0} for n in (1, 0, 1)]
    assert res["quality"] == {"status": "generated", "warnings": [], "line_count": 2, "char_count": 4, "avg_confidence": 0.0, "confidence_note": S.CONFIDENCE_NOTE}
    g = res["generation"]
    assert g["pipeline"] == "vLLM OpenAI-compatible API" and g["vllm_base_url"] == "http://localhost:8000/v1" and g["prompt"] == CFG.prompt and list(g)[0] == "provider"
    g = json.loads(tasklog.finished(assemble.assemble(t, Settings(provider="transformers"))).first().result_json)["res"]["generation"]
    assert g["pipeline"] == "AutoModelForImageTextToText" and g["vllm_base_url"] is None
    back = serving.status_response(tasklog.created(spark.createDataFrame([("d", "f")], "task_id string, filename string"), F.current_timestamp()).withColumn("result_json", F.lit(r.result_json))).first()
    assert back.result.res.quality.char_count == 4 and back.result.res.pages[0].lines[0].bbox is None


def test_first_page_error_wins(spark):
    t = spark.createDataFrame([("d", 2, None, "late"), ("d", 1, None, "early"), ("d", 0, "x", None)], S.PAGE_TEXTS)
    assert assemble.gather(t).first().error == "early"


# ---- task log, SNK-1..4, FLT-6..8, E3, E4, E11, G14, G15, G18, G21


def log_row(task, seq, status, result=None, error=None, minute=0):
    t = datetime(2024, 1, 1, 0, minute)
    return (task, seq, f"{task}.png", status, result, error, datetime(2024, 1, 1), t)


def test_log(spark):
    path = new_path(spark, "log")
    tasklog.initialize(spark, path)
    tasklog.initialize(spark, path)
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    tasks = spark.createDataFrame([("a", "a.png"), ("b", None)], "task_id string, filename string")
    tasklog.append(tasklog.created(tasks, now), path)
    changes = spark.createDataFrame([("a", "completed", "{}", None), ("zz", "failed", None, "x")], "task_id string, status string, result_json string, error string")
    tasklog.append(tasklog.updated(tasklog.latest(tasklog.read_log(spark, path)), changes, now), path)
    got = {r.task_id: r for r in tasklog.latest(tasklog.read_log(spark, path)).collect()}
    assert set(got) == {"a", "b"} and (got["a"].status, got["a"].result_json, got["a"].filename, got["a"].seq) == ("completed", "{}", "a.png", 1)
    assert got["b"].status == "processing"
    again = spark.createDataFrame([("a", "processing", None, None)], "task_id string, status string, result_json string, error string")
    tasklog.append(tasklog.updated(tasklog.latest(tasklog.read_log(spark, path)), again, now), path)
    assert tasklog.latest(tasklog.read_log(spark, path)).filter("task_id = 'a'").first().result_json is None
    tasklog.recover_on_restart(spark, path, F.lit("2024-01-02 00:00:00").cast("timestamp"))
    rows = tasklog.latest(tasklog.read_log(spark, path)).collect()
    assert {(r.status, r.error) for r in rows} == {("failed", S.RESTART_ERROR)} and {r.updated_at for r in rows} == {datetime(2024, 1, 2)}
    with pytest.raises(PySparkException, match="Invalid OCR task status"):
        tasklog.append(tasklog.created(tasks, now).withColumn("status", F.lit("queued")), path)
    with pytest.raises(ValueError, match=r"Expected one of: \['completed', 'failed', 'processing'\]"):
        tasklog.check_status("queued")


def test_recovery_and_latest(spark):
    rows = [log_row("a", 0, "processing", minute=0), log_row("a", 1, "completed", "{}", minute=1), log_row("a", 2, "failed", None, "e", minute=1), log_row("b", 3, "processing", "kept")]
    log = spark.createDataFrame(rows, S.TASK_LOG)
    got = {r.task_id: r for r in tasklog.latest(log).collect()}
    assert (got["a"].status, got["a"].result_json, got["a"].error) == ("failed", None, "e")
    rec = {r.task_id: r for r in tasklog.recovered(tasklog.latest(log), F.current_timestamp()).collect()}
    assert (rec["b"].status, rec["b"].result_json, rec["b"].error) == ("failed", "kept", S.RESTART_ERROR) and rec["a"].error == "e"


# ---- registry and serving, JN-1..3, AGG-1, AGG-8, SRT-1, TOP-1, E6, G16-G18


class Broken(recognize.StubRecognizer):
    def load(self):
        raise RuntimeError("boom")

    def unload(self):
        raise RuntimeError("late")


def test_registry(spark):
    r = registry.Registry({"a": Broken, "b": recognize.StubRecognizer, "c": recognize.StubRecognizer}, ["a", "x", "b", "c"])
    assert r.initialize() == {"requested": 4, "loaded": 2, "failed": 2}
    assert r.active() is r.get("b") and r.active_name() == "stub" and list(r.all()) == ["b", "c"]
    assert r.failure() == "a: boom" and r.failed["x"] == "Unknown model name or optional dependency missing"
    t = r.table(spark)
    assert registry.active_model(t).first()[0] == "b" and registry.active_failure(t).first()[0] == "a: boom"
    h = serving.health(spark.createDataFrame([], S.TASK_LOG), t, True, 3, "p").first()
    assert (h.status, h.api, h.loaded_models, h.failed_models["a"], h.queue_size, h.database.path) == ("healthy", "ok", ["b", "c"], "boom", 3, "p")
    assert h.database.task_counts == {"completed": 0, "failed": 0, "processing": 0}
    assert serving.health(spark.createDataFrame([], S.TASK_LOG), t, False, 0).first().status == "degraded"
    none = registry.Registry({"a": Broken}, ["a"])
    none.initialize()
    none.loaded = {"a": Broken()}
    none.shutdown()
    none.loaded = {}
    assert none.active() is None and none.active_name() is None
    empty = none.table(spark)
    assert registry.active_model(empty).first()[0] is None
    assert serving.health(spark.createDataFrame([], S.TASK_LOG), empty, True, 0).first().status == "degraded"
    assert serving.health(spark.createDataFrame([], S.TASK_LOG), empty.limit(0), True, 0).first().model_loaded is False


def test_counts_keep_unknown_states(spark):
    rows = spark.createDataFrame([("lost",), ("failed",), ("failed",)], "status string")
    assert {tuple(r) for r in serving.status_counts(rows).collect()} == {("lost", 1), ("failed", 2), ("processing", 0), ("completed", 0)}


def test_lookup(spark):
    log = spark.createDataFrame([log_row("a", 0, "completed", "{}")], S.TASK_LOG)
    ids = spark.createDataFrame([("a",), ("zz",)], "task_id string")
    assert {(r.task_id, r.code, r.status) for r in serving.status_lookup(ids, tasklog.latest(log)).collect()} == {("a", 200, "completed"), ("zz", 404, None)}
    assert serving.submit_response(tasklog.latest(log)).columns == ["task_id", "status", "filename"]


# ---- streaming, STR-1..8, SNK-9, SRC-1, SRC-2, SNK-8


def test_worker(spark, tmp_path):
    folder, log = tmp_path / "in", str(tmp_path / "log")
    folder.mkdir()
    (folder / "a.png").write_bytes(b"one|two")
    (folder / "b.tiff").write_bytes(b"boom")
    (folder / "c.txt").write_bytes(b"rejected")
    r = registry.Registry({"stub": lambda: recognize.StubRecognizer(fail_on="boom")}, ["stub"])
    r.initialize()
    run = lambda: worker.start_worker(spark, str(folder), log, str(tmp_path / "cp"), r, CFG, once=True, pdf=fake_pdf, image=fake_image)
    q = run()
    q.awaitTermination()
    assert not q.isActive
    got = {x.filename: x for x in tasklog.latest(tasklog.read_log(spark, log)).collect()}
    assert {k: v.status for k, v in got.items()} == {"a.png": "completed", "b.tiff": "failed"}
    assert json.loads(got["a.png"].result_json)["res"]["final_text"] == "one\n\ntwo" and got["b.tiff"].error == "boom"
    n = tasklog.read_log(spark, log).count()
    run().awaitTermination()
    assert tasklog.read_log(spark, log).count() == n == 4
    latest = tasklog.latest(tasklog.read_log(spark, log))
    assert worker.backlog(latest.select("task_id"), latest).first().queue_size == 0
    (folder / "d.png").write_bytes(b"more")
    run().awaitTermination()
    assert tasklog.latest(tasklog.read_log(spark, log)).count() == 3
    assert text_of(spark, str(folder / "a.png"), CFG, recognize.StubRecognizer(), pdf=fake_pdf, image=fake_image) == "one\n\ntwo"
    assert text_of(spark, str(folder / "b.tiff"), CFG, recognize.StubRecognizer(fail_on="boom"), pdf=fake_pdf, image=fake_image) == ""


def test_worker_keeps_rejects_and_times(spark, tmp_path):
    up = spark.createDataFrame([("1", "a.png", "image/png", bytearray(b"x|y")), ("2", "b.txt", "text/plain", bytearray(b"x")), ("3", "c", None, None)], S.UPLOADS)
    log = str(tmp_path / "log")
    tasklog.initialize(spark, log)
    r = registry.Registry({"stub": recognize.StubRecognizer}, ["stub"])
    worker.process_batch(up, log, r, CFG, pdf=fake_pdf, image=fake_image)  # nothing is loaded yet
    refused = {x.upload_id: x for x in spark.read.schema(S.REJECTS).parquet(worker.rejects_path(log)).collect()}
    assert {x.reject_code for x in refused.values()} == {503} and len(refused) == 3 and tasklog.read_log(spark, log).count() == 0
    r.initialize()
    worker.process_batch(up, log, r, CFG, pdf=fake_pdf, image=fake_image)
    refused = [x for x in spark.read.schema(S.REJECTS).parquet(worker.rejects_path(log)).collect() if x.reject_code == 415]
    assert sorted(x.upload_id for x in refused) == ["2", "3"] and refused[0].size_bytes in (0, 1) and refused[0].rejected_at is not None
    done = tasklog.latest(tasklog.read_log(spark, log)).collect()
    assert [x.status for x in done] == ["completed"] and json.loads(done[0].result_json)["res"]["inference_time_ms"] >= 0


def test_elapsed_time_is_of_all_pages(spark):
    t = spark.createDataFrame([("a", 0, "x", None, 0.25), ("a", 1, "y", None, 0.5), ("b", 0, "z", None, None)], S.PAGE_TEXTS + ", elapsed_s double")
    got = {x.task_id: x.result.res.inference_time_ms for x in assemble.assemble(t, CFG).collect()}
    assert got == {"a": 750.0, "b": 0.0}


def test_second_start_gives_the_running_worker(spark, tmp_path):
    (tmp_path / "in").mkdir()
    r = registry.Registry({"stub": recognize.StubRecognizer}, ["stub"])
    r.initialize()
    start = lambda: worker.start_worker(spark, str(tmp_path / "in"), str(tmp_path / "log"), str(tmp_path / "cp"), r, CFG)
    q = start()
    try:
        assert start().id == q.id and q.isActive
    finally:
        q.stop()


def test_local_recognizer_travels_as_its_settings(monkeypatch):
    import pickle
    import sys
    import types

    made, calls = [], []

    def pipeline(task, **options):
        made.append((task, options))
        return lambda **given: calls.append(given) or [{"generated_text": " text "}]

    monkeypatch.setitem(sys.modules, "transformers", types.SimpleNamespace(pipeline=pipeline))
    picture = types.ModuleType("PIL")
    picture.Image = types.SimpleNamespace(open=lambda b: b.read())
    monkeypatch.setitem(sys.modules, "PIL", picture)
    cfg = Settings(provider="transformers", model_id="tests/model")
    local = recognize.make_recognizer(cfg)
    local.load()
    again = pickle.loads(pickle.dumps(local))
    assert again == local and [again.read(b"a"), local.read(b"b")] == ["text", "text"] and len(made) == 1
    assert made[0][0] == "image-text-to-text" and made[0][1]["model"] == "tests/model" and made[0][1]["model_kwargs"]["offload_folder"] == "data/qwen_offload"
    parts = calls[0]["text"][0]["content"]
    assert [p["type"] for p in parts] == ["image", "text"] and parts[0]["image"] == b"a" and calls[0]["generate_kwargs"]["do_sample"] is False
    local.unload()
    assert cfg not in recognize._IN_PROCESS


def test_settings_by_their_documented_names(tmp_path):
    env = tmp_path / ".env"
    env.write_text("QWEN_OCR_PROVIDER=transformers\nQWEN_OCR_PDF_DPI=100\nALLOWED_IMAGE_TYPES=[\"image/png\"]\n")
    s = Settings.load({"QWEN_OCR_VLLM_TIMEOUT": "7", "PDF_DPI": "50", "QWEN_OCR_PROMPT": ""}, env)
    assert (s.provider, s.pdf_dpi, s.timeout_s, s.allowed_types, s.prompt) == ("transformers", 100, 7.0, ("image/png",), CFG.prompt)


def test_worker_without_model(spark, tmp_path):
    up = spark.createDataFrame([("1", "a.png", "image/png", bytearray(b"x"))], S.UPLOADS)
    log = str(tmp_path / "log")
    tasklog.initialize(spark, log)
    worker.process_batch(up, log, registry.Registry({}, ["a"]), CFG)
    assert tasklog.read_log(spark, log).count() == 0


def test_semi_filter(spark):
    m = spark.createDataFrame([("a",), ("b",)], "task_id string")
    assert [r.task_id for r in worker.queue_semi_filter(m, m.filter("task_id = 'b'")).collect()] == ["b"]
