"""Operator 9, suffix-array dedup by distributed prefix doubling.

Wanted: every byte covered by a string of WIDTH bytes that also starts earlier (smaller id, or same document and an
earlier start). Ranks of prefixes are 64-bit hashes, taken at growing lengths, and positions leave as soon as their
rank is unique or settles them:

1. GRAM bytes, at anchors: in each window of WIDTH bytes the gram of the least hash. Equal windows have equal anchors,
   so a window is repeated only if its anchor's gram is. Anchors of unique rank leave.
2. The stretch of all windows that an anchor stands for. An anchor whose stretch has come earlier settles all its
   windows as repeated; where a gram has one stretch only, its first anchor's windows are all new.
3. What is left, at each position: rank pairs of WIDTH bytes (64 and 32 bits) with their positions are sorted over all
   partitions; a row with the rank of a row before it is repeated. A group of any size spreads over partitions.

Sorting every position of a corpus, as the plain form of the method does, would move over 20 times its bytes; the
anchors carry about one position in 31, and step 3 sees the edges of repeated passages only.

Defined cases: NULL and '' have no bytes. Rows without an id keep all bytes. Each input row gives one row; rows that
repeat an id and text count as one document, an id with different texts as several, in the order of a hash of the text.
Ids are integers. Only id and text are read, so other columns may have any names. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import INVERSE, cached_powers, documents, flat, in_arrow, mixed, prefix_hash, steps
from folioflow.sources.shared import remove, written

WIDTH = 100
GRAM = 40
SPAN = WIDTH - GRAM + 1
BASE_2 = 0xD1342543DE82EF95
INVERSE_2 = pow(BASE_2, -1, 1 << 64)
STEP = 1 << 20


def anchors_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, first window's start in its row, windows, gram rank, stretch rank) of each anchor of some texts."""
    n = len(data)
    if n < WIDTH:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int32, np.int32, np.int64, np.int64))
    p, inverse = prefix_hash(data), cached_powers(n + 1, INVERSE)
    gram = mixed((p[GRAM:] - p[:-GRAM]) * inverse[: n - GRAM + 1])
    bits = np.uint64((1 << n.bit_length()) - 1)
    least = (gram & ~bits) | np.arange(len(gram), dtype=np.uint64)  # of equal hashes the leftmost
    size = 1
    while size * 2 <= SPAN:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    least = np.minimum(least[: n - WIDTH + 1], least[SPAN - size : SPAN - size + n - WIDTH + 1])
    row = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    start = np.flatnonzero(row[: n - WIDTH + 1] == row[WIDTH - 1 :])
    if not len(start):
        return anchors_of(data[:0], offsets[:1])
    at = (least[start] & bits).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    first, count, at = start[new], np.diff(np.append(new, len(at))), at[new]
    end = first + count - 1 + WIDTH
    stretch = (p[end] - p[first]) * inverse[first]
    stretch = mixed(stretch + (at - first).astype(np.uint64) * np.uint64(BASE_2) + count.astype(np.uint64) * np.uint64(INVERSE_2))
    r = row[first].astype(np.int64)
    return r, (first - offsets[r]).astype(np.int32), count.astype(np.int32), gram[at].view(np.int64), stretch.view(np.int64)


def anchors(docs: DataFrame) -> DataFrame:
    """docs(id, t, text) to (g, c, id, t, p, n)."""

    def run(batches):
        for batch in batches:
            for part in steps(batch, 2, STEP):
                r, p, n, g, c = anchors_of(*flat(part.column(2)))
                at = pa.array(r)
                yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(c), part.column(0).take(at), part.column(1).take(at), pa.array(p), pa.array(n)], names=["g", "c", "id", "t", "p", "n"])

    return in_arrow(docs.select("id", "t", "text"), run, "g bigint, c bigint, id bigint, t bigint, p int, n int")


def second_hash(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * cached_powers(len(data), BASE_2), out=out[1:])
    return out


def window_ranks(open_docs: DataFrame) -> DataFrame:
    """open_docs(id, t, text, runs array<struct<p, n>>) to (k, k2, id, t, p): the rank pair of each open window."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                data, _ = flat(batch.column(2).slice(i, 1))
                runs = batch.column(3)[i].as_py()
                at = np.unique(np.concatenate([np.arange(x["p"], x["p"] + x["n"]) for x in runs])) if runs else np.zeros(0, np.int64)
                at = at[at + WIDTH <= len(data)]
                if not len(at):
                    continue
                p, q = prefix_hash(data), second_hash(data)
                k = mixed((p[at + WIDTH] - p[at]) * cached_powers(len(data) + 1, INVERSE)[at]).view(np.int64)
                k2 = (mixed((q[at + WIDTH] - q[at]) * cached_powers(len(data) + 1, INVERSE_2)[at]) >> np.uint64(33)).astype(np.int32)
                same = [pa.array(np.full(len(at), batch.column(c)[i].as_py(), np.int64)) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(k2), *same, pa.array(at.astype(np.int32))], names=["k", "k2", "id", "t", "p"])

    return in_arrow(open_docs.select("id", "t", "text", "runs"), run, "k bigint, k2 int, id bigint, t bigint, p int")


def later(ranks: DataFrame) -> DataFrame:
    """Of (k, k2, id, p), and t if there is one: the places (id, t, p) whose rank has come before. Sorted over all
    partitions; as a group may cross partitions, each reports its first and last rank, two rows a partition, which the
    driver compares."""
    place = [c for c in ("id", "t", "p") if c in ranks.columns]
    kinds = {"id": pa.int64(), "t": pa.int64(), "p": pa.int32(), "mark": pa.int32(), "pid": pa.int32(), "k": pa.int64(), "k2": pa.int32()}
    schema = pa.schema([(c, kinds[c]) for c in (*place, "mark", "pid", "k", "k2")])

    def run(batches):
        from pyspark import TaskContext

        pid, carry, head = TaskContext.get().partitionId(), None, None  # carry: a group's rank and first place
        one = lambda mark, rank, at: pa.RecordBatch.from_pylist([dict(zip(schema.names, (*at, mark, pid, *rank), strict=True))], schema=schema)
        for batch in batches:
            k, k2, *at = (c.to_numpy() for c in batch.columns)
            if not len(k):
                continue
            new = np.ones(len(k), bool)
            new[1:] = (k[1:] != k[:-1]) | (k2[1:] != k2[:-1])
            if carry is not None:
                new[0] = (k[0], k2[0]) != carry[0]
            start = np.maximum.accumulate(np.where(new, np.arange(len(k)), -1))
            first = [np.where(start >= 0, x[np.maximum(start, 0)], carry[1][i] if carry else 0) for i, x in enumerate(at)]
            again = np.logical_or.reduce([x != y for x, y in zip(at, first, strict=True)])
            if head is None:
                head = (int(k[0]), int(k2[0])), [int(x[0]) for x in at]
            carry = (int(k[-1]), int(k2[-1])), [int(x[-1]) for x in first]
            m = int(again.sum())
            yield pa.RecordBatch.from_arrays([*[pa.array(x[again], kinds[c]) for x, c in zip(at, place, strict=True)], pa.array(np.zeros(m, np.int32)), *[pa.nulls(m, kinds[c]) for c in ("pid", "k", "k2")]], schema=schema)
        if carry is not None:
            yield one(1, *head)
            yield one(2, *carry)

    keys = ["k", "k2", *place]
    dealt = ranks.select(*keys).repartitionByRange(*keys).sortWithinPartitions(*keys)
    kept = dict(ranks.dtypes)
    found = written(in_arrow(dealt, run, ", ".join([*(f"{c} {kept[c]}" for c in place), "mark int, pid int, k bigint, k2 int"])), "repeated")
    ends = sorted(found.filter("mark > 0").collect(), key=lambda r: (r.pid, r.mark))
    more, last = [], None
    for r in ends:
        at = tuple(r[c] for c in place)
        if r.mark == 1:
            if last is not None and (r.k, r.k2) == last[0] and at != last[1]:
                more.append(at)
        elif last is None or (r.k, r.k2) != last[0]:
            last = (r.k, r.k2), at
    return found.filter("mark = 0").select(*place).union(ranks.sparkSession.createDataFrame(more, ", ".join(f"{c} {kept[c]}" for c in place)))


def told_apart(d: DataFrame) -> DataFrame:
    """d(id, text) with t: 0, or a hash of the text where its id also has another text."""
    h = F.xxhash64("text")
    spread = d.groupBy("id").agg(F.min(h).alias("lo"), F.max(h).alias("hi")).filter("lo <> hi").select("id", F.lit(True).alias("several"))
    several = written(spread, "repeated_ids")
    return d.join(several, "id", "left").select("id", "text", F.when(F.col("several"), F.xxhash64("text")).otherwise(F.lit(0)).cast("bigint").alias("t"))


def repeated_runs(docs: DataFrame) -> DataFrame:
    """docs(id, t, text) to (id, t, runs): starts and numbers of the windows that have come earlier."""
    spark = docs.sparkSession
    d = docs.filter("id IS NOT NULL")
    a = written(anchors(d), "anchors")
    twice = written(a.groupBy("g").agg(F.count("*").alias("m")).filter("m > 1").select("g"), "repeated_grams")
    some = written(a.join(twice, "g"), "repeated_anchors")
    remove(spark, a, twice)

    firsts = some.groupBy("g", "c").agg(F.min(F.struct("id", "t", "p", "n")).alias("f"))
    firsts = written(firsts.select("g", "c", *[F.col(f"f.{x}").alias(f"f{x}") for x in ("id", "t", "p", "n")]), "first_stretches")
    settled = written(some.join(firsts, ["g", "c"]).filter("id <> fid OR t <> ft OR p <> fp").select("id", "t", "p", "n"), "settled")
    several = firsts.groupBy("g").agg(F.count("*").alias("m")).filter("m > 1").select("g")
    left = firsts.join(several, "g").select(F.col("fid").alias("id"), F.col("ft").alias("t"), F.struct(F.col("fp").alias("p"), F.col("fn").alias("n")).alias("r"))
    left = written(left.groupBy("id", "t").agg(F.collect_list("r").alias("runs")), "open")
    remove(spark, some, firsts)

    ranks = written(window_ranks(d.join(left, ["id", "t"])), "ranks")
    again = later(ranks)
    remove(spark, ranks)
    runs = settled.union(again.select("id", "t", "p", F.lit(1).alias("n")))
    return runs.groupBy("id", "t").agg(F.collect_list(F.struct("p", "n")).alias("runs"))


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_kept: bool = False) -> DataFrame:
    """One row an input row: id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept (the bytes left)."""
    d = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    d = told_apart(d)
    whole = d.join(repeated_runs(d), ["id", "t"], "left").select("id", "text", F.col("runs.p").alias("p"), F.col("runs.n").alias("n"))

    def run(batches):
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                data, _ = flat(batch.column(1).slice(i, 1))
                p, n = (np.array(batch.column(k)[i].values if batch.column(k)[i].is_valid else [], np.int64) for k in (2, 3))
                edge = np.zeros(len(data) + 1, np.int64)
                np.add.at(edge, p, 1)
                np.add.at(edge, p + n - 1 + WIDTH, -1)
                cut = np.cumsum(edge[:-1]) > 0
                kept = data[~cut].tobytes()
                spans = int(cut[:1].sum() + (cut[1:] & ~cut[:-1]).sum())
                out.append((len(data), int(cut.sum()), spans, hashlib.sha256(kept).hexdigest(), kept if with_kept else None))
            n_bytes, removed, spans, digest, kept = zip(*out, strict=True) if out else ((),) * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, pa.int64()) for x in (n_bytes, removed, spans)], pa.array(digest, pa.string()), pa.array(kept, pa.binary())], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    out = in_arrow(whole, run, "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary").withColumnRenamed("id", id_col)
    return out if with_kept else out.drop("kept")


def query(spark, sf_dir: str) -> DataFrame:
    return suffix_dedup(documents(spark, sf_dir))
