"""Operator 10, language ID: sparse multinomial logistic regression on TF-IDF of character n-grams.

Lower-cased characters, with a line feed before and after the text, give n-grams of 1 to 3, hashed into BUCKETS.
Document frequencies count all rows that may be learned from. Weights are fitted by follow-the-regularised-leader with
elastic-net penalties on a sample of at most SAMPLE rows (one a language at least), shared evenly by the languages and
chosen by a hash of the id; a part of each language's rows is kept out and sets the temperature. Scoring is a sum over a
whole text's n-grams, in pieces of CHUNK characters, so it is linear in the text and needs only one table of BUCKETS x
languages. A row's score depends on its own text and the model only.

All languages of the rows are learned. The driver holds tables of BUCKETS x languages; where these would be more than
MAX_LANGUAGES, training raises an error and leaves none out silently.

Defined cases: NULL texts and texts without a letter are 'und' with score 0. Where there is nothing to learn from,
all are 'und'. Rows with a NULL language are only predicted, those with a NULL id aren't learned from; they don't count
as held out. Each input row gives one row, repeated ones too. Only id, text and lang are read, and lang only of rows to
learn from; other columns may have any names. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.llm.common import documents, fresh, in_arrow, steps

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
SAMPLE = 4000
MAX_LANGUAGES = 1000
#: Characters that are looked at in one go. A longer text is scored piece by piece.
CHUNK = 1 << 19
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")

_MIX = np.uint32(0x9E3779B1)


def pieces(texts: list[str]) -> Iterator[list[tuple[int, str, int]]]:
    """Lists of (text number, characters, n-gram starts) of about CHUNK characters. Short texts share a list; a longer
    one is cut, and each of its pieces is a list of its own, so that its sums don't depend on other texts. A piece has
    the characters behind it that its last n-grams need."""
    held, size = [], 0
    for i, t in enumerate(texts):
        t = f"\n{t.lower()}\n"
        if size + len(t) > CHUNK and held:
            yield held
            held, size = [], 0
        if len(t) > CHUNK:
            for a in range(0, len(t), CHUNK):
                yield [(i, t[a : a + CHUNK + max(ORDERS) - 1], min(CHUNK, len(t) - a))]
        else:
            held.append((i, t, len(t)))
            size += len(t)
    if held:
        yield held


def grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, text numbers) of the n-grams of some texts, a bounded number at a time. An n-gram lies inside one
    text; runs of white space aren't merged."""
    for some in pieces(texts):
        chars = np.frombuffer("".join(t for _, t, _ in some).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.array([len(t) for _, t, _ in some])
        place = np.repeat(np.arange(len(some)), sizes)
        owner = np.array([i for i, *_ in some], np.int64)
        starts = np.arange(len(chars)) - np.repeat(np.cumsum(sizes) - sizes, sizes) < np.repeat([n for *_, n in some], sizes)
        out, own, h = [], [], np.zeros(len(chars), np.uint32)
        for n in range(1, max(ORDERS) + 1):
            m = max(len(chars) - n + 1, 0)
            h = (h[:m] + chars[n - 1 : n - 1 + m] + np.uint32(1)) * _MIX
            h ^= h >> np.uint32(15)
            if n in ORDERS:
                inside = np.flatnonzero(starts[:m] & (place[:m] == place[n - 1 : n - 1 + m]))
                out.append(((h[inside] * np.uint32(0x85EBCA6B)) >> np.uint32(16)).astype(np.int32))
                own.append(owner[place[inside]])
        yield np.concatenate(out), np.concatenate(own)


def document_frequencies(rows: DataFrame) -> tuple[int, np.ndarray]:
    """(rows, rows that have each bucket) over all of rows(text). Partial counts are summed by bucket in Spark, so the
    driver gets BUCKETS + 1 numbers at most."""

    def run(batches):
        df, n = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for part in steps(batch, 0, 1 << 20):
                texts = [t for t in part.column(0).to_pylist() if t is not None]
                seen, last = np.zeros(BUCKETS, bool), -1
                for b, own in grams(texts):
                    order = np.argsort(own, kind="stable")
                    b, own = b[order], own[order]
                    cuts = np.flatnonzero(np.diff(own)) + 1
                    for i, found in zip(own[np.append(0, cuts)].tolist(), np.split(b, cuts), strict=True):
                        if i != last:
                            df += seen
                            seen[:], last = False, i
                        seen[found] = True
                df += seen
                n += len(texts)
        hit = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(hit, -1), pa.int64()), pa.array(np.append(df[hit], n), pa.int64())], names=["bucket", "n"])

    out, total = np.zeros(BUCKETS, np.int64), 0
    for r in in_arrow(rows.select("text"), run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        if r.bucket < 0:
            total = r.n
        else:
            out[r.bucket] = r.n
    return total, out


def features(texts: list[str], idf: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sparse TF-IDF rows that sum to 1."""
    out = []
    for t in texts:
        c = sum(np.bincount(b, minlength=BUCKETS) for b, _ in grams([t]))
        b = np.flatnonzero(c)
        x = c[b] * idf[b]
        out.append((b, x / max(x.sum(), 1e-12)))
    return out


SCALE = 30.0


def fit(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, k: int, epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-3) -> np.ndarray:
    """FTRL-proximal with one learning rate a weight. Returns weights (BUCKETS, k), most of them 0."""
    z, n = np.zeros((BUCKETS, k)), np.zeros((BUCKETS, k))
    weights = lambda z, n: np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))
    rng = np.random.default_rng(11)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            b, x = rows[i][0], rows[i][1] * SCALE
            zb, nb = z[b], n[b]
            w = weights(zb, nb)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y[i]] -= 1
            g = x[:, None] * p[None, :]
            sigma = (np.sqrt(nb + g * g) - np.sqrt(nb)) / alpha
            z[b] = zb + g - sigma * w
            n[b] = nb + g * g
    return weights(z, n)


def softmax(s: np.ndarray) -> np.ndarray:
    p = np.exp(s - s.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def temperature(scores: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, on a grid."""
    grid = np.exp(np.linspace(np.log(0.1), np.log(10), 41))
    loss = [-np.log(softmax(scores / t)[np.arange(len(y)), y] + 1e-12).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def learnable(docs: DataFrame, id_col: str = "doc_id", lang_col: str = "lang") -> DataFrame:
    return docs.filter((F.crc32(F.col(id_col).cast("string")) % 4 != 2) & F.col(lang_col).isNotNull())


def quotas(counts: dict[str, int], sample: int) -> dict[str, int]:
    """Rows to sample of each language: an even share; what rare languages don't have goes to the others. At least 1."""
    out, left = {}, sample
    for i, (lang, n) in enumerate(sorted(counts.items(), key=lambda c: (c[1], c[0]))):
        out[lang] = max(1, min(n, left // (len(counts) - i)))
        left -= out[lang]
    return out


def sampled(rows: DataFrame, counts: dict[str, int], sample: int) -> DataFrame:
    """(text, lang, nth): of each language its quota of the first rows by hash. Rows are thinned before they are
    dealt by language, with six deviations to spare, so a language's task gets little more than its quota."""
    quota = quotas(counts, sample)
    by_lang = lambda f: F.try_element_at(F.create_map(*[x for v, q in quota.items() for x in (F.lit(v), F.lit(f(v, q)))]), "lang")
    share = by_lang(lambda v, q: min(1.0, (q + 6 * q**0.5 + 20) / counts[v]))
    h = F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1 << 30))
    thinned = rows.withColumn("h", h).filter(F.col("h") < share * float(1 << 30))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h", "id", "text"))
    return thinned.withColumn("nth", nth).filter(F.col("nth") <= by_lang(lambda v, q: q)).select("text", "lang", "nth")


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> dict | None:
    """The model: languages, one table of idf * weight, idf, temperature. None where there is nothing to learn from."""
    rows = learnable(docs, id_col, lang_col).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("text IS NOT NULL")
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if not counts:
        return None
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages; the tables of the driver would be too large")
    languages = sorted(counts)
    total, df = document_frequencies(rows)
    idf = np.log((1 + total) / (1 + df)) + 1

    def run(batches):
        for batch in batches:
            f = features(batch.column(0).to_pylist(), idf)
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array([b for b, _ in f], pa.list_(pa.int32())), pa.array([x.astype(np.float32) for _, x in f], pa.list_(pa.float32()))], names=["lang", "nth", "b", "x"])

    got = in_arrow(sampled(rows, counts, sample), run, "lang string, nth int, b array<int>, x array<float>").toArrow()
    y, nth = np.array([languages.index(v) for v in got["lang"].to_pylist()], np.int64), got["nth"].to_numpy()
    order = np.lexsort((y, nth))
    x = [(b.values.to_numpy(), v.values.to_numpy()) for b, v in zip(got["b"], got["x"], strict=True)]
    x, y = [x[i] for i in order], y[order]
    kept_out = nth[order] % 5 == 0
    del got
    w = fit([r for r, o in zip(x, kept_out, strict=True) if not o], y[~kept_out], len(languages))
    t = 1.0
    if kept_out.any():
        t = temperature(np.array([(r[1] * SCALE) @ w[r[0]] for r, o in zip(x, kept_out, strict=True) if o]), y[kept_out])
    return {"languages": languages, "weights": (w * idf[:, None]).astype(np.float32), "idf": idf.astype(np.float32), "temperature": t}


def scores(texts: list[str], model: dict) -> np.ndarray:
    """Probabilities of the languages, a row a text."""
    tf, s = np.zeros(len(texts)), np.zeros((len(texts), len(model["languages"])))
    for b, own in grams(texts):
        tf += np.bincount(own, model["idf"][b], minlength=len(texts))
        for j in range(s.shape[1]):
            s[:, j] += np.bincount(own, model["weights"][b, j], minlength=len(texts))
    return softmax(s * SCALE / np.maximum(tf, 1e-12)[:, None] / model["temperature"])


def predict(docs: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """(id, lang_pred, score) a row; `keep` names further columns to carry, `out` the two new ones. The model is
    broadcast; it is BUCKETS rows of at most MAX_LANGUAGES numbers."""
    names = [id_col, *keep]
    kinds = dict(docs.dtypes)
    inner = fresh(names, "text", *out) if text_col not in names else [text_col, *fresh(names, *out)]
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names) + f", `{inner[1]}` string, `{inner[2]}` double"
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = names.index(text_col) if text_col in names else len(names)

    def run(batches):
        m = shared.value
        for batch in batches:
            for part in steps(batch, at, 1 << 20):
                texts = [t or "" for t in part.column(at).to_pylist()]
                lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
                if m is not None:
                    p = scores(texts, m)
                    for i, t in enumerate(texts):
                        if LETTER.search(t):
                            lang[i], score[i] = m["languages"][int(p[i].argmax())], p[i].max()
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], pa.array(lang, pa.string()), pa.array(np.minimum(score, 1.0), pa.float64())], names=[*names, *inner[1:]])

    given = docs.select(*[F.col(f"`{c}`") for c in names], *([F.col(f"`{text_col}`").alias(inner[0])] if at == len(names) else []))
    found = in_arrow(given, run, schema)
    return found.withColumnsRenamed({a: b for a, b in zip(inner[1:], out, strict=True) if a != b})


def query(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = predict(docs, train(docs))
    return out.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
