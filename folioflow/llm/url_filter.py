"""Operator 7, URL filters: rules first, then naive Bayes on segmented words.

Host labels are names run together; a unigram Viterbi splits them into words. Word counts come from all pages' texts;
the words kept are those with a share of MIN_SHARE or more of all words, so there are at most 1 / MIN_SHARE of them,
whatever the input's size. Shares are of all words, kept or not; a rarer word, or one of over MAX_WORD letters, has the
probability of an unknown one. A multinomial naive Bayes over words of host and path, hashed into BUCKETS, is counted on
all URLs that a rule decides, and judges the others.

Defined cases: a NULL url, or one without '://', has an empty host and path; no rule fits it. Where nothing is
decided by rules, the method allows. Each input row gives one row. Only id, url and page text are read. An empty
table gives an empty result. NULL pages count as ''.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import documents, in_arrow
from folioflow.sources.shared import remove, written

# Rules as (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
MIN_SHARE = 1e-5
MAX_WORD = 20
BUCKETS = 1 << 16
SMOOTHING = 1.0
VERDICTS = ("allow", "block")


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, else NULL."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


class Counts(dict):
    """Counts of the words that are kept, and `total` of all words."""

    total = 0


def word_counts(pages: DataFrame, text_col: str = "html", min_share: float = MIN_SHARE) -> dict[str, int]:
    """Frequent words of all pages' texts: at most 1 / min_share of them come to the driver."""
    text = F.lower(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"<[^>]*+>", " "))
    words = pages.select(F.explode(F.regexp_extract_all(text, F.lit(rf"(?<![a-z0-9])[a-z]++(?![a-z0-9])"), F.lit(0))).alias("word"))
    counts = written(words.groupBy("word").agg(F.count("*").alias("n")), "word_counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    out = Counts((r.word, r.n) for r in counts.filter((F.col("n") >= max(1.0, min_share * total)) & (F.length("word") <= MAX_WORD)).collect())
    out.total = total
    remove(pages.sparkSession, counts)
    return out


class Segmenter:
    """Unigram Viterbi. An unknown word of n letters has a probability that falls by a factor of 10 a letter."""

    def __init__(self, counts: dict[str, int]):
        self.total = max(getattr(counts, "total", 0) or sum(counts.values()), 1)
        self.log = {w: math.log(n / self.total) for w, n in counts.items()}
        self.unknown = [math.log(10.0 / self.total) - n * math.log(10.0) for n in range(MAX_WORD + 1)]
        self.split = lru_cache(1 << 14)(self._split)

    def _split(self, name: str) -> tuple[str, ...]:
        best, back = [0.0] + [-math.inf] * len(name), [0] * (len(name) + 1)
        for end in range(1, len(name) + 1):
            for start in range(max(0, end - MAX_WORD), end):
                score = best[start] + self.log.get(name[start:end], self.unknown[end - start])
                if score > best[end]:
                    best[end], back[end] = score, start
        out, end = [], len(name)
        while end:
            out.append(name[back[end] : end])
            end = back[end]
        return tuple(reversed(out))

    def tokens(self, host: str, path: str) -> list[str]:
        """Words of host labels and of the path, marked by where they stand."""
        out = [f"h:{w}" for label in re.findall("[a-z]+|[0-9]+", host) for w in (self.split(label) if label.isalpha() else ("0",))]
        return out + [f"p:{w}" for piece in re.findall("[a-z]+|[0-9]+", path.lower()) for w in (self.split(piece) if piece.isalpha() else ("0",))]


def bucket(token: str) -> int:
    return xxhash.xxh32_intdigest(token) % BUCKETS


def class_counts(decided: DataFrame, counts: dict[str, int]) -> np.ndarray:
    """decided(host, path, verdict) to counts (BUCKETS + 1, 2); the last row has the numbers of URLs. Sums are made
    in Spark by bucket and class, so the driver gets 2 * (BUCKETS + 1) rows at most."""
    shared = decided.sparkSession.sparkContext.broadcast(counts)

    def run(batches):
        seg, n = Segmenter(shared.value), np.zeros((BUCKETS + 1, 2), np.int64)
        for batch in batches:
            for host, path, verdict in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                k = VERDICTS.index(verdict)
                n[BUCKETS, k] += 1
                for t in seg.tokens(host, path):
                    n[bucket(t), k] += 1
        b, k = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(b, pa.int64()), pa.array(k, pa.int64()), pa.array(n[b, k], pa.int64())], names=["b", "k", "n"])

    out = np.zeros((BUCKETS + 1, 2), np.int64)
    for r in in_arrow(decided, run, "b bigint, k bigint, n bigint").groupBy("b", "k").agg(F.sum("n").alias("n")).collect():
        out[r.b, r.k] = r.n
    return out


def log_odds(n: np.ndarray) -> tuple[float, np.ndarray]:
    """Prior and per-bucket log odds of 'block'."""
    urls, words = n[BUCKETS], n[:BUCKETS]
    like = np.log(words + SMOOTHING) - np.log(words.sum(axis=0) + SMOOTHING * BUCKETS)
    return float(np.log(urls[1] + 1.0) - np.log(urls[0] + 1.0)), like[:, 1] - like[:, 0]


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", rules=RULES) -> DataFrame:
    """One row an input row: id, host, path, rule, verdict, block_odds (the method's log odds, also where a rule decides)."""
    counts = word_counts(pages, text_col)
    p = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("_url")).select("id", host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path"))
    p = p.withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    decided = p.filter("r IS NOT NULL").select("host", "path", F.col("r.verdict").alias("verdict"))
    n = class_counts(decided, counts)
    prior, odds = log_odds(n)
    known = bool(n[BUCKETS].sum())
    sc = pages.sparkSession.sparkContext
    words, table = sc.broadcast(counts), sc.broadcast(odds)

    def run(batches):
        seg = Segmenter(words.value)
        for batch in batches:
            host, path = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            score = [prior + sum(table.value[bucket(t)] for t in seg.tokens(h, q)) if known else -1.0 for h, q in zip(host, path, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64())], names=["id", "host", "path", "rule", "ruled", "block_odds"])

    kind = dict(p.dtypes)["id"]
    given = p.select("id", "host", "path", F.col("r.rule").alias("rule"), F.col("r.verdict").alias("ruled"))
    out = in_arrow(given, run, f"id {kind}, host string, path string, rule string, ruled string, block_odds double")
    method = F.when(F.col("block_odds") > 0, F.lit("block")).otherwise("allow")
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), "block_odds")


def query(spark, sf_dir: str) -> DataFrame:
    return filter_urls(documents(spark, sf_dir, "pages")).drop("block_odds")
