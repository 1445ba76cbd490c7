"""Operator 3, benchmark decontamination by winnowing.

Of the k-word hashes of a text, the smallest in each window of w is kept; any span of k + w - 1 = 10 words that a
document shares with an item then shares a kept hash. Documents' and items' fingerprints are joined, which gives
candidate pairs; each pair is then extended over the whole document and confirmed word by word. Items of fewer than
10 words have no full window, so for each such length that occurs all runs of that length are fingerprints.

Spark broadcasts the items' fingerprints only where their size is below its threshold, and otherwise shuffles both.

Defined cases: NULL and texts without words have no hits, items without words or id never occur. Each input row gives
one row and is judged by its own text, also where a doc_id is repeated: texts are told apart by id and a 64-bit hash.
Rows without an id aren't judged: they count as clean. Only ids and texts are read, so other columns may have any
names. An empty table on either side gives no hits.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import ALNUM, documents, flat, in_arrow, mixed, shingle_hashes, steps, words_of
from folioflow.sources.shared import written

SPAN = 10
GRAM = 5
WINDOW = SPAN - GRAM + 1
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
SQL_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())


def winnowed(h: np.ndarray, row: np.ndarray, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(rows, fingerprints) of word hashes; row is ascending. Only windows inside one text count."""
    grams = shingle_hashes(h, gram)
    m = len(grams) - window + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least = grams[:m].copy()
    for j in range(1, window):
        np.minimum(least, grams[j : j + m], out=least)
    inside = row[:m] == row[gram + window - 2 : gram + window - 2 + m]
    r, f = row[:m][inside], least[inside]
    new = np.ones(len(f), bool)
    new[1:] = (f[1:] != f[:-1]) | (r[1:] != r[:-1])
    return r[new], f[new]


def runs(h: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """All runs of n < SPAN words, with n in the hash."""
    grams = mixed(shingle_hashes(h, n) + np.uint64(n))
    inside = row[: len(grams)] == row[n - 1 : n - 1 + len(grams)] if n > 1 else np.ones(len(grams), bool)
    return row[: len(grams)][inside], grams[inside]


def fingerprints(df: DataFrame, short: tuple[int, ...] | None) -> DataFrame:
    """df(id, k, text) to (id, k, fp). short: lengths below SPAN whose runs count; None, for items: a short item's
    whole run."""

    def run(batches):
        for batch in batches:
            for part in steps(batch, 2):
                w = words_of(part.column(2), ALNUM)
                found = [winnowed(w.hash, w.row)]
                if short is None:
                    for n in np.unique(w.count[(w.count > 0) & (w.count < SPAN)]).tolist():
                        r, f = runs(w.hash, w.row, n)
                        keep = w.count[r] == n
                        found.append((r[keep], f[keep]))
                else:
                    found += [runs(w.hash, w.row, n) for n in short]
                r, f = (np.concatenate(x) for x in zip(*found, strict=True))
                at = pa.array(r)
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), pa.array(f.view(np.int64))], names=["id", "k", "fp"])

    return in_arrow(df.select("id", "k", "text"), run, f"id {dict(df.dtypes)['id']}, k bigint, fp bigint")


def word_counts(df: DataFrame) -> DataFrame:
    """df(id, k, text) to (id, k, n_words): the places where a word begins."""

    def run(batches):
        for batch in batches:
            for part in steps(batch, 2):
                data, offsets = flat(part.column(2))
                mask = ALNUM[data]
                begins = mask.copy()
                begins[1:] &= ~mask[:-1]
                at = offsets[:-1][offsets[:-1] < len(data)]
                begins[at] = mask[at]  # a text's first byte has nothing before it
                total = np.concatenate([[0], np.cumsum(begins)])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(total[offsets[1:]] - total[offsets[:-1]], pa.int64())], names=["id", "k", "n_words"])

    return in_arrow(df.select("id", "k", "text"), run, f"id {dict(df.dtypes)['id']}, k bigint, n_words bigint")


def short_lengths(items: DataFrame, text_col: str) -> tuple[int, ...]:
    """Lengths from 1 to SPAN - 1 that items have: nine numbers at most."""
    n = F.size(F.regexp_extract_all(F.lower(text_col), F.lit(SQL_WORD), F.lit(0)))
    return tuple(sorted(r[0] for r in items.select(n.alias("n")).filter(F.col("n").between(1, SPAN - 1)).distinct().collect()))


def extended(text: str | None, items: list[tuple[str, str | None]]) -> tuple[int, list[str]]:
    """(words hit, ids of the items that occur) of one document and its candidate items. What is kept grows with the
    items; the document's windows are only looked up."""
    doc, wanted = words(text), {}
    for item, item_text in items:
        w = words(item_text)
        n = min(SPAN, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            wanted.setdefault(n, {}).setdefault(b" ".join(w[i : i + n]), []).append(item)
    hit, names = bytearray(len(doc)), set()
    for n, of in wanted.items():
        for p in range(len(doc) - n + 1):
            if found := of.get(b" ".join(doc[p : p + n])):
                names.update(found)
                hit[p : p + n] = b"\x01" * n
    return sum(hit), sorted(names)


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row an input row: id, n_words, n_hit, n_items, items (array of ids as strings), contaminated."""
    known = items.filter(F.col(item_id).isNotNull()).select(F.col(item_id).cast("string").alias("item"), F.col(item_text).cast("string").alias("item_text"))
    given = known.select(F.col("item").alias("id"), F.lit(0).cast("bigint").alias("k"), F.col("item_text").alias("text"))
    table = written(fingerprints(given, None).select(F.col("id").alias("item"), "fp").distinct(), "item_fingerprints")
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("k", F.xxhash64("text"))
    mine = fingerprints(d.filter("id IS NOT NULL"), short_lengths(known, "item_text"))
    pairs = mine.join(table, "fp").select("id", "k", "item").distinct()
    found = pairs.join(known.distinct(), "item").groupBy("id", "k").agg(F.collect_list(F.struct("item", "item_text")).alias("items"))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                out = [extended(t, [(x["item"], x["item_text"]) for x in i]) for t, i in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([n for n, _ in out], pa.int64()), pa.array([x for _, x in out], pa.list_(pa.string()))], names=["id", "k", "n_hit", "items"])

    kind = dict(d.dtypes)["id"]
    hits = in_arrow(d.join(found, ["id", "k"]).select("id", "k", "text", "items"), run, f"id {kind}, k bigint, n_hit bigint, items array<string>")
    hits = hits.filter("n_hit > 0").groupBy("id", "k").agg(F.max(F.struct("n_hit", "items")).alias("h"))
    n_hit = F.coalesce("h.n_hit", F.lit(0)).cast("bigint")
    names = F.coalesce("h.items", F.array().cast("array<string>"))
    return word_counts(d).join(hits, ["id", "k"], "left").select(
        F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.size(names).cast("bigint").alias("n_items"), names.alias("items"), (n_hit > 0).alias("contaminated")
    )


def query(spark, sf_dir: str) -> DataFrame:
    out = decontaminate(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


_LOW = "translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} w FROM documents), b AS (SELECT item_id, {_WORDS} w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w),10) n, array_to_string(w[i:i+least(len(w),10)-1],' ') x FROM (SELECT *, unnest(range(1, len(w)-least(len(w),10)+2)) i FROM b WHERE len(w)>0)),
ls AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i+n-1],' ') x FROM (SELECT doc_id, w, n, unnest(range(1, len(w)-n+2)) i FROM d, ls WHERE len(w)>=n)),
h AS (SELECT doc_id, item_id, dw.n, i FROM dw JOIN bw ON dw.n=bw.n AND dw.x=bw.x),
hw AS (SELECT doc_id, count(DISTINCT p) n_hit FROM (SELECT doc_id, unnest(range(i, i+n)) p FROM h) GROUP BY doc_id),
hi AS (SELECT doc_id, count(DISTINCT item_id) n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) s FROM h GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit,0) AS n_hit, coalesce(n_items,0) AS n_items, sha256(coalesce(s,'')) AS items_sha256, coalesce(n_hit,0)>0 AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)"""
