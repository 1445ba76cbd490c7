"""Operators 5, 6, 7, 8, 10 and the pipeline: round trips, brute force, held-out accuracy, hand-made cases."""

import gzip
import hashlib
import math
import random

import duckdb
import pytest
import sentencepiece

import corpus_pipeline
from folioflow.llm import decontaminate, language_id, minhash, sentencepiece_codec, token_counts, url_filter, warc
from folioflow.sources.shared import new_path
from tests.oracle import assert_same

SF = "/root/testdata/sf0.001"
TEXTS = [(1, "Hello  world\n\n日本 😀 ▁x"), (2, ""), (3, None), (4, " "), (5, "a" * 500), (6, "the the"), (6, "the the"), (None, "x"), (7, "\x00\x01 \t"), (8, "word " * 3000)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, ids int, lang_pred string")


def test_pieces_equal_the_library(spark):
    model = corpus_pipeline.TOKENIZER
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    got = sentencepiece_codec.encode(frame(spark, TEXTS), model).collect()
    assert sorted((str(r.doc_id), r.ids) for r in got) == sorted((str(i), sp.encode(t or "")) for i, t in TEXTS)
    texts = {str(r.doc_id): r.text for r in sentencepiece_codec.decode(sentencepiece_codec.encode(frame(spark, TEXTS[1:]), model), model).collect()}
    assert all(texts[str(i)] == (t or "") for i, t in TEXTS[1:])


def test_pieces_of_driver_rows(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=corpus_pipeline.TOKENIZER)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in sentencepiece_codec.query(spark, SF).collect():
        ids = sp.encode(texts[r.doc_id])
        assert r.restored and r.n_ids == len(ids)
    got = sentencepiece_codec.encode(spark.read.parquet(f"{SF}/documents.parquet"), corpus_pipeline.TOKENIZER).collect()
    assert all(r.ids == sp.encode(texts[r.doc_id]) for r in got) and len(got) == len(texts)
    assert sentencepiece_codec.query(spark, SF).limit(0).count() == 0 and sentencepiece_codec.encode(frame(spark, []), corpus_pipeline.TOKENIZER).count() == 0


def test_the_stream_gives_the_ids_without_words(monkeypatch):
    """The window over whole texts, the words and their memo, and the library agree; also with a memo of a few words."""
    r = random.Random(7)
    sp = sentencepiece.SentencePieceProcessor(model_file=corpus_pipeline.TOKENIZER)
    c = sentencepiece_codec.Codec(corpus_pipeline.TOKENIZER)
    texts = ["".join(r.choice("abcde  ABé\u00df\n\t\u65e5\u672c\U0001f600\u258119.,") for _ in range(r.randint(1, 300))) for _ in range(60)] + [" ", "a" * 2000, "internationalization" * 30, "\u65e5\u672c\u8a9e" * 100]
    whole = [c.ids((sentencepiece_codec.SPACE + t).replace(" ", sentencepiece_codec.SPACE)) for t in texts]
    assert whole == [sp.encode(t) for t in texts] == [c.encode(t) for t in texts]
    monkeypatch.setattr(sentencepiece_codec, "MEMO", 3)
    small = sentencepiece_codec.Codec(corpus_pipeline.TOKENIZER)
    assert [small.encode(t) for t in texts] == whole and len(small.words) <= 3


def test_a_very_long_text_streams_with_a_bounded_window():
    c = sentencepiece_codec.codec(corpus_pipeline.TOKENIZER)
    longest = max(len("".join(part)) for part in c.stream("x1y" * 30000))
    assert longest <= 3 * c.longest


def test_stream_commits_within_a_window():
    c = sentencepiece_codec.codec(corpus_pipeline.TOKENIZER)
    text = "▁" + "internationalization" * 40
    parts = list(c.stream(text))
    assert len(parts) > 5 and "".join(p for x in parts for p in x) == text
    assert [p for x in parts for p in x] == c.merged(text)


def test_unigram_lattice():
    c = object.__new__(sentencepiece_codec.Codec)
    c.bpe, c.longest, c.least = False, 3, -50.0
    c.score = {"a": -1.0, "b": -1.0, "ab": -1.5, "aba": -2.9, "ba": -3.0}
    c.id = {k: i for i, k in enumerate(c.score)}
    text = "abababbaab"
    best = {0: (0.0, [])}
    for e in range(1, len(text) + 1):
        best[e] = max((best[s][0] + c.score[text[s:e]], best[s][1] + [text[s:e]]) for s in range(max(0, e - 3), e) if text[s:e] in c.score)
    got = [p for x in c.stream(text) for p in x]
    assert abs(sum(c.score[p] for p in got) - best[len(text)][0]) < 1e-9


def test_token_counts_brute(spark):
    path = f"{token_counts.TOKENIZERS}/{token_counts.VOCABULARY}"
    enc = token_counts.encoding(path)
    got = token_counts.token_counts(frame(spark, TEXTS).repartition(3), path, block=64).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == sorted((str(i), len(enc.encode_ordinary(t or ""))) for i, t in TEXTS)
    assert token_counts.token_counts(frame(spark, []), path).count() == 0


def test_token_counts_where_a_task_writes_several_files(spark):
    path = f"{token_counts.TOKENIZERS}/{token_counts.VOCABULARY}"
    enc = token_counts.encoding(path)
    rows = [(i, f"{'word ' * (i % 7)}{i}") for i in range(40)]
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "3")
    try:
        got = token_counts.token_counts(frame(spark, rows).repartition(2), path).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    assert sorted((r.doc_id, r.n_tokens) for r in got) == [(i, len(enc.encode_ordinary(t))) for i, t in rows]


def test_token_counts_of_driver_rows(spark):
    enc = token_counts.encoding(f"{token_counts.TOKENIZERS}/{token_counts.VOCABULARY}")
    want = sorted((r.doc_id, len(enc.encode_ordinary(r.text))) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    assert sorted(tuple(r) for r in token_counts.query(spark, SF).collect()) == want


def test_stitching(spark):
    import numpy as np

    r = np.random.default_rng(2)
    for size in (1, 3, 7, 50):
        tokens = r.choice([1, 2, 3, token_counts.END], 200, p=[0.4, 0.3, 0.2, 0.1]).astype("<u2")
        rows = [("f", i, *(x.tolist() if hasattr(x, "tolist") else x for x in token_counts.scan_block(tokens[a : a + size]))) for i, a in enumerate(range(0, 200, size))]
        got = [x.n_tokens for x in token_counts.stitched(spark.createDataFrame(rows, "file string, block long, n_seps long, head long, tail long, inner array<long>")).orderBy("ordinal").collect()]
        ends = np.flatnonzero(tokens == token_counts.END)
        want = np.diff(np.concatenate([[-1], ends])) - 1
        rest = 199 - (ends[-1] if len(ends) else -1)
        assert got == want.tolist() + ([int(rest)] if rest else [])


def test_warc_sql(spark):
    assert_same(warc.query(spark, SF), warc.SQL, SF)


def test_warc_cases(spark):
    big, odd = "é" * 600, "x\r\n\r\nWARC/1.1\r\n\r\n" * 80
    rows = [(1, "http://a.org/x?q=1#f", big), (2, "http://b.org", big), (3, None, None), (4, "no url", "small"), (5, "", "small"), (6, "u://h\r\nX: y/", odd), (7, "http://c.org/", big), (7, "http://c.org/2", big), (None, "http://n.org/", big), (8, "u", odd)]
    pages = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, type string")
    path = new_path(spark, "warc_test")
    warc.write_archives(warc.judged(pages), path)
    got = warc.captures(spark, path).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got if r.page_id not in (7, None)}
    assert [by[k].response.type for k in (1, 2, 3, 4, 5, 6, 8)] == ["revisit", "revisit", "response", "response", "response", "revisit", "response"]
    assert by[1].response.refers_to == "7" and by[6].response.refers_to == "8" and by[1].metadata.payload_bytes == 1200
    assert bytes(by[8].response.payload).decode() == odd and by[8].response.payload_digest == hashlib.sha1(odd.encode()).hexdigest()
    assert by[1].request.path == "/x?q=1" and all(r.request is not None and r.metadata is not None for r in got)
    assert [r.response.type for r in got if r.page_id in (7, None)] == ["response"] * 3
    assert warc.judged(pages.limit(0)).count() == 0
    raw = [h for row in spark.read.format("binaryFile").load(path).collect() for h, _ in warc.parsed(bytes(row.content))]
    assert {h["warc-refers-to-target-uri"] for h in raw if h["warc-type"] == "revisit"} == {"http://c.org/2", "u"}
    import os

    empty = new_path(spark, "warc_none")
    os.makedirs(empty.removeprefix("file://"))
    assert warc.captures(spark, empty).count() == 0


def test_warc_parser_reads_members_and_reports_damage():
    one = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <a>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert [bytes(b) for _, b in warc.parsed(gzip.compress(one) + gzip.compress(one))] == [b"abc", b"abc"]
    with pytest.raises(ValueError):
        list(warc.parsed(one[:-2]))
    with pytest.raises(ValueError, match="cut off"):
        list(warc.parsed(gzip.compress(one * 50)[:-9]))
    members = b"".join(gzip.compress(one) for _ in range(3000))
    assert sum(1 for _ in warc.parsed(members)) == 3000 and warc.inflated(members, 100) == one * 3000


URLS = ["http://a.net/x", "http://NET/", "http://a.net", "https://sub.example.net/en/1", "http://example.net/english", "http://x.example.com/de/", "http://badexample.com/de/", "http://z.org/fr/1?x#y", "http://org/fr", "a://b://c/d", "nothing", "", None, "http://h?q/x", "http://h#f", "http://shopnews.example.com/en/1", "http://a.net/x"]


def plain(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
        host, rest = rest[:end].lower(), rest[end:]
        path = rest[: min([i for i in (rest.find(c) for c in "?#") if i >= 0], default=len(rest))]
    fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else None


def test_urls(spark):
    pages = spark.createDataFrame([(i, u, "<p>shop news shop news words</p>" if i else None, "x") for i, u in enumerate(URLS)], "page_id long, url string, html string, host string")
    got = {r.page_id: r for r in url_filter.filter_urls(pages).collect()}
    for i, u in enumerate(URLS):
        host, path, rule, verdict = plain(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), u
        assert got[i].verdict == (verdict or ("block" if got[i].block_odds > 0 else "allow"))
    assert url_filter.filter_urls(pages.limit(0)).count() == 0


def test_segmenter_brute():
    seg = url_filter.Segmenter({"shop": 50, "news": 40, "new": 30, "s": 5, "sho": 2, "pnews": 1})
    name, best = "shopnewsxq", None
    for mask in range(1 << (len(name) - 1)):
        cuts = [0, *[i + 1 for i in range(len(name) - 1) if mask >> i & 1], len(name)]
        parts = [name[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        score = sum(seg.log.get(p, seg.unknown[len(p)]) for p in parts)
        best = max(best or (score, parts), (score, parts))
    assert sum(seg.log.get(p, seg.unknown[len(p)]) for p in seg.split(name)) == pytest.approx(best[0])
    assert seg.split("shopnews") == ("shop", "news") and seg.split("") == ()


def test_url_counts_brute(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    counts = url_filter.word_counts(pages)
    p = [(h, q, v) for h, q, _, v in map(plain, (r.url for r in pages.collect())) if v]
    n = url_filter.class_counts(spark.createDataFrame(p, "host string, path string, verdict string"), counts)
    assert n[url_filter.BUCKETS].tolist() == [sum(v == x for *_, v in p) for x in url_filter.VERDICTS]
    seg = url_filter.Segmenter(counts)
    assert n[: url_filter.BUCKETS].sum() == sum(len(seg.tokens(h, q)) for h, q, _ in p)


def test_language_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language_id.query(spark, "/root/testdata/sf0.01").join(d.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 1000 and len(held) > 150
    assert sum(r.lang == r.lang_pred for r in held) / len(held) >= 0.97
    assert all(0 <= r.score <= 1 for r in rows)
    crc = duckdb.sql("select doc_id from '/root/testdata/sf0.01/documents.parquet'").fetchall()
    import zlib

    assert {r.doc_id for r in held} == {i for (i,) in crc if zlib.crc32(str(i).encode()) % 4 == 2}


def test_language_edges(spark):
    d = spark.createDataFrame([(i, t, lang, 1) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("der Hund und die Katze", "de"), (None, "en"), ("", None), ("12 34 !!", "en"), ("x", None)] * 6)], "doc_id long, text string, lang string, score int")
    got = language_id.predict(d, language_id.train(d)).collect()
    assert len(got) == 36 and all(r.lang_pred == "und" and r.score == 0 for r in got if r.doc_id % 6 in (2, 3, 4))
    assert all(r.lang_pred in ("en", "de") for r in got if r.doc_id % 6 in (0, 1, 5))
    assert {r.lang_pred for r in language_id.predict(d, None).collect()} == {"und"}
    assert language_id.train(d.limit(0)) is None and language_id.predict(d.limit(0), None).count() == 0


def uneven(spark, common, n, rare, m):
    """Languages of own letters: `common` of n rows each, and "rare" of m rows."""
    text = lambda j, i: " ".join(chr(0x4E00 + 8 * j + (i + p) % 8) * (1 + p % 3) for p in range(12))
    rows = [(j * n + i, text(j, i), f"l{j}") for j in range(common) for i in range(n)] + [(common * n + i, text(common, i), rare) for i in range(m)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_rare_language_is_sampled_and_predicted(spark):
    d = uneven(spark, 9, 600, "rare", 16)
    model = language_id.train(d, sample=120)
    got = language_id.predict(d.filter("lang = 'rare'"), model).collect()
    assert len(got) == 16 and all(r.lang_pred == "rare" for r in got)
    rows = language_id.learnable(d).selectExpr("doc_id id", "text", "lang")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    taken = {r["lang"]: r["count"] for r in language_id.sampled(rows, counts, 120).groupBy("lang").count().collect()}
    assert taken == language_id.quotas(counts, 120) and sum(taken.values()) == 120 and taken["rare"] == min(12, counts["rare"])


def test_all_languages_are_learned(spark, monkeypatch):
    d = uneven(spark, 2, 30, "rare", 8)
    assert language_id.train(d)["languages"] == ["l0", "l1", "rare"]
    monkeypatch.setattr(language_id, "MAX_LANGUAGES", 2)
    with pytest.raises(ValueError, match="more than 2 languages"):
        language_id.train(d)


def plain_scores(text, model):
    """Probabilities of one text from a dict of its n-grams."""
    t, counts = f"\n{text.lower()}\n", {}
    for n in language_id.ORDERS:
        for i in range(len(t) - n + 1):
            h = 0
            for c in t[i : i + n]:
                h = (h + ord(c) + 1) * 0x9E3779B1 % (1 << 32)
                h ^= h >> 15
            b = (h * 0x85EBCA6B % (1 << 32)) >> 16
            counts[b] = counts.get(b, 0) + 1
    tf = sum(c * float(model["idf"][b]) for b, c in counts.items())
    s = [sum(c * float(model["weights"][b, j]) for b, c in counts.items()) * language_id.SCALE / tf / model["temperature"] for j in range(len(model["languages"]))]
    e = [math.exp(x - max(s)) for x in s]
    return [x / sum(e) for x in e]


@pytest.mark.parametrize("chunk", [language_id.CHUNK, 50])
def test_language_scores_brute_and_in_any_partitions(spark, monkeypatch, chunk):
    d = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    model = language_id.train(d)
    monkeypatch.setattr(language_id, "CHUNK", chunk)
    texts = {r.doc_id: r.text for r in d.collect()} | {900: "A", 901: "ab", 902: "İıß ß", 903: "x" * 400}
    frames = [(i, t, "x", "y", 1) for i, t in texts.items()]
    d = spark.createDataFrame(frames, "doc_id long, text string, lang_pred string, score string, _text int")
    runs = [{r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(d.repartition(n), model).collect()} for n in (1, 4, 16)]
    assert runs[0] == runs[1] == runs[2]
    got = language_id.scores(list(texts.values()), model)
    for i, (k, t) in enumerate(texts.items()):
        want = plain_scores(t, model)
        assert max(abs(a - b) for a, b in zip(got[i], want, strict=True)) < 1e-6
        assert runs[0][k][0] == model["languages"][max(range(len(want)), key=want.__getitem__)]
    assert got.shape[0] == len(texts) and language_id.scores(["x" * 400], model)[0].tolist() == got[-1].tolist()


def test_document_frequencies_brute(spark):
    texts = ["Ab a", None, "", "ab"]
    total, df = language_id.document_frequencies(spark.createDataFrame([(t,) for t in texts], "text string"))
    want = sum(len({x for b, _ in language_id.grams([t]) for x in b.tolist()}) for t in texts if t is not None)
    assert total == 3 and df.sum() == want


def test_pipeline_stages(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    d = d.withColumn("spans", d.doc_id)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_duplicates", "decontamination", "pii", "sentencepiece"]
    docs, seen = d, {}
    for name, stage in corpus_pipeline.STAGES:
        seen[name] = (docs, docs := stage(spark, docs, SF))
        if name != "sentencepiece":
            assert docs.columns == d.columns
            docs = spark.createDataFrame(docs.collect(), d.schema)
    before, after = seen["near_duplicates"]
    texts = {r.doc_id: r.text for r in before.collect()}
    from tests.llm.test_pairs import brute_components

    want = {i for i, (_, _, kept) in brute_components(list(texts.items())).items() if kept}
    assert {r.doc_id for r in after.collect()} == want
    bench = [decontaminate.words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    windows = {tuple(w[i : i + min(10, len(w))]) for w in bench for i in range(max(1, len(w) - 9)) if w}
    before, after = seen["decontamination"]
    has = lambda t: any(tuple(w[i : i + 10]) in windows for w in [decontaminate.words(t)] for i in range(len(w)))
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect() if not has(r.text)}
    before, after = seen["pii"]
    assert before.count() == after.count() and not any("@mail" in r.text for r in after.collect())
    last = seen["sentencepiece"][1].collect()
    assert len(last) == after.count() and all(r.restored for r in last)


def test_pipeline_keeps_clean_rows_without_an_id(spark):
    item = max((r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()), key=len)
    clean = [" ".join(f"{w}{i}" for i in range(30)) for w in "abcd"]
    rows = [(None, clean[0], 1), (None, clean[0], 2), (None, item, 3), (None, None, 4), (1, clean[1], 5), (2, clean[1], 6), (3, item, 7), (5, clean[2], 8), (5, clean[1], 9)]
    d = spark.createDataFrame(rows, "doc_id long, text string, extra int")
    once = corpus_pipeline.drop_near_duplicates(spark, d, SF)
    assert once.columns == d.columns and sorted(r.extra for r in once.collect()) == [1, 2, 3, 4, 5, 7, 8, 9]
    twice = corpus_pipeline.drop_contaminated(spark, spark.createDataFrame(once.collect(), d.schema), SF)
    assert twice.columns == d.columns and sorted(r.extra for r in twice.collect()) == [1, 2, 4, 5, 8, 9]


def test_pipeline_with_clashing_names_nulls_and_empty_tables(spark):
    """Extra columns under names that operators use, NULLs in any column, and no rows at all."""
    extra = "_text string, stage_lang string, stage_score int, stage_id int, id int, kept int, spans int, _row int, _none int, hub int, k int, component_id int"
    names = [x.split()[0] for x in extra.split(", ")]
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars, *("x" if " string" in x else 1 for x in extra.split(", "))) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(40).collect()]
    rows += [(None, rows[0][1], None, None, None, *[None] * len(names)), (7001, None, None, None, None, *[None] * len(names))]
    d = spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {extra}")
    for docs in (d, d.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.columns == d.columns
            docs = spark.createDataFrame(docs.collect(), d.schema)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()


def test_pipeline_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 50
    assert minhash.HASHES == 128
