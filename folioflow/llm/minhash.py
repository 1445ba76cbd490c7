"""Operator 2, near-duplicates: MinHash with sequential Bayesian verification.

1. Each text gets its set of 5-word shingles, a digest of the set and a MinHash signature. Texts with equal sets are
   one class with a number of its own; only classes go on, so ids may repeat with other texts.
2. Signatures are cut into bands; classes that share a band's bucket are candidates. A bucket's members are sorted
   and first compared along that order (each with its predecessor and with the first of its run), which takes pairs in
   proportion to rows however large a bucket is.
3. Candidates are compared in batches of signature positions. After each batch a pair goes where the posterior
   probability that its similarity reaches the threshold is below MISS; survivors are verified on their full sets.
4. Components of the links. Then buckets that still hold several components are searched for links between them, see
   related(): members are put against one text of their largest component, and only those that share a rare
   difference from it are compared. No link between components is lost; pairs inside one don't matter.

At a similarity of 0.75, 32 bands of 4 miss a pair with probability 5e-6, and MISS adds 1e-6 a batch.

Defined cases: NULL, '' and texts without words have no shingles, are linked with nothing and are kept. Texts of
fewer than 5 words are one shingle. Each input row gives one row and is judged by its own text, also where an id is
repeated; its component is named by the smallest id in it. Rows with a NULL id are linked with nothing and kept. Only id
and text are read, the id in any type that has an order. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import SPACED, documents, in_arrow, mixed, shingle_hashes, steps, words_of
from folioflow.llm.components import components
from folioflow.sources.shared import remove, written

SHINGLE = 5
THRESHOLD = 75  # percent
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
BATCH = 32
MISS = 1e-6
#: Shingles that verification keeps in a worker, beside the two sets of a pair.
HELD = 100_000
#: A difference in which so many pairs would meet makes a family of its own, LEVELS - 1 times at most.
HOT_PAIRS, LEVELS = 50_000, 4
WORD = re.compile(rb"[^\x20\x09-\x0D]+")

_rng = np.random.default_rng(20240229)
FACTORS = _rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def shingles(text: str | None) -> set:
    """The exact set of a text, for verification."""
    w = WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())
    return set(zip(*[w[i:] for i in range(SHINGLE)], strict=False)) if len(w) >= SHINGLE else {tuple(w)} if w else set()


def linked(x: set, y: set, percent: int = THRESHOLD) -> bool:
    if not x or not y or 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    same = len(x & y)
    return 100 * same >= percent * (len(x) + len(y) - same)


def signature(h: np.ndarray) -> np.ndarray:
    """MinHash of distinct shingle hashes, in slices that fit the cache."""
    out = np.full(HASHES, 0xFFFFFFFF, np.uint64)
    for i in range(0, len(h), 256):
        np.minimum(out, ((h[None, i : i + 256] * FACTORS[:, None] + SHIFTS[:, None]) >> np.uint64(32)).min(axis=1), out=out)
    return out.astype(np.uint32)


def row_hashes(column: pa.Array) -> list[np.ndarray]:
    """The distinct shingle hashes of each text of a step, ascending."""
    w, out = words_of(column, SPACED), []
    grams = shingle_hashes(w.hash, SHINGLE)
    for n, end in zip(w.count.tolist(), np.cumsum(w.count).tolist(), strict=True):
        if n >= SHINGLE:
            out.append(np.unique(grams[end - n : end - SHINGLE + 1]))
        else:
            out.append(mixed(shingle_hashes(w.hash[end - n : end], n) + np.uint64(n)) if n else grams[:0])
    return out


def key_of(h: np.ndarray) -> bytes | None:
    return hashlib.blake2b(h.tobytes(), digest_size=16).digest() if len(h) else None


def sketches(docs: DataFrame) -> DataFrame:
    """docs(id, text) to (id, n_shingles, key, sig); key and sig are NULL without words."""

    def run(batches):
        for batch in batches:
            for part in steps(batch, 1):
                hs = row_hashes(part.column(1))
                sigs = [signature(h).tobytes() if len(h) else None for h in hs]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(h) for h in hs], pa.int64()), pa.array([key_of(h) for h in hs], pa.binary()), pa.array(sigs, pa.binary())], names=["id", "n_shingles", "key", "sig"])

    return in_arrow(docs, run, f"id {dict(docs.dtypes)['id']}, n_shingles bigint, key binary, sig binary")


def keyed(docs: DataFrame) -> DataFrame:
    """docs(id, text) to (key, text)."""

    def run(batches):
        for batch in batches:
            for part in steps(batch, 1):
                yield pa.RecordBatch.from_arrays([pa.array([key_of(h) for h in row_hashes(part.column(1))], pa.binary()), part.column(1)], names=["key", "text"])

    return in_arrow(docs.select("id", "text"), run, "key binary, text string")


def matrix(column: pa.Array) -> np.ndarray:
    """Signatures of a column as rows."""
    column = column.cast(pa.binary()) if not pa.types.is_binary(column.type) else column
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(np.uint32).reshape(len(column), HASHES)


def buckets(classes: DataFrame) -> DataFrame:
    """classes(id, sig) to (bucket, id), a row for each band. The band's number is in the bucket."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                s = matrix(part.column(1)).reshape(part.num_rows, BANDS, ROWS).astype(np.uint64)
                h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (part.num_rows, BANDS)).copy()
                for j in range(ROWS):
                    h = mixed(h + s[:, :, j])
                ids = part.column(0).take(pa.array(np.repeat(np.arange(part.num_rows), BANDS)))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64).reshape(-1)), ids], names=["bucket", "id"])

    return in_arrow(classes.select("id", "sig"), run, "bucket bigint, id bigint")


@lru_cache
def least_matches(percent: int = THRESHOLD, miss: float = MISS) -> tuple[tuple[int, int], ...]:
    """(positions compared, least matches to go on). With m of n equal and a flat prior, the posterior of the
    similarity is Beta(m + 1, n - m + 1), so P(similarity >= t) is P(Binomial(n + 1, t) <= m)."""
    t, out = percent / 100, []
    for n in range(BATCH, HASHES + 1, BATCH):
        total, m = 0.0, 0
        while (total := total + comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)) < miss:
            m += 1
        out.append((n, m))
    return tuple(out)


def pruned(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) whose posterior stays above MISS through all batches of positions."""
    table = least_matches()

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                part = batch.slice(at, 8192)
                x, y = matrix(part.column(2)), matrix(part.column(3))
                rows, m, before = np.arange(len(x)), np.zeros(len(x), np.int64), 0
                for n, least in table:
                    m = m + (x[rows, before:n] == y[rows, before:n]).sum(axis=1)
                    keep = m >= least
                    rows, m, before = rows[keep], m[keep], n
                keep = pa.array(rows)
                yield pa.RecordBatch.from_arrays([part.column(0).take(keep), part.column(1).take(keep)], names=["a", "b"])

    side = lambda k: classes.select(F.col("id").alias(k), F.col("sig").alias(f"sig_{k}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sig_a", "sig_b")
    return in_arrow(both, run, "a bigint, b bigint")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs that are linked on their full sets."""

    def run(batches):
        sets: dict = {}
        held = 0

        def of(k, text):
            nonlocal held
            if k not in sets:
                if held > HELD:
                    sets.clear()
                    held = 0
                sets[k] = shingles(text)
                held += len(sets[k])
            return sets[k]

        for batch in batches:
            a, b, x, y = (batch.column(i) for i in range(4))
            keep = [i for i in range(batch.num_rows) if linked(of(a[i].as_py(), x[i].as_py()), of(b[i].as_py(), y[i].as_py()))]
            keep = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([a.take(keep), b.take(keep)], names=["a", "b"])

    side = lambda k: texts.select(F.col("id").alias(k), F.col("text").alias(f"text_{k}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b")
    return in_arrow(both, run, "a bigint, b bigint")


def walked(rows: DataFrame) -> DataFrame:
    """rows(bucket, id) to (bucket, id, prev, hub) of buckets that may have several members: the predecessor in the
    bucket's order and the first of its run in this partition, NULL for the first itself. Rows are dealt by range of
    (bucket, id), so a bucket of any size spreads over partitions. The first and the last row of a partition always stay."""

    def run(batches):
        held = None  # the row before: bucket, id, prev, hub, whether it shares its bucket
        schema = ["bucket", "id", "prev", "hub"]
        for batch in batches:
            k, ids = (batch.column(i).to_numpy() for i in range(2))
            if not len(k):
                continue
            new = np.ones(len(k), bool)
            new[1:] = k[1:] != k[:-1]
            new[0] = held is None or k[0] != held[0]
            start = np.maximum.accumulate(np.where(new, np.arange(len(k)), -1))
            hub = np.where(start >= 0, ids[np.maximum(start, 0)], held[3] if held and held[3] is not None else held[1] if held else 0)
            prev = np.empty_like(ids)
            prev[1:] = ids[:-1]
            prev[0] = held[1] if held else 0
            shares = ~new
            shares[:-1] |= ~new[1:]
            if held is None:
                shares[0] = True
            elif held[4] or not new[0]:
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in held[:4]], names=schema)
            at = np.flatnonzero(shares[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(k[at]), pa.array(ids[at]), pa.array(prev[at], mask=new[at]), pa.array(hub[at], mask=new[at])], names=schema)
            held = (int(k[-1]), int(ids[-1]), None if new[-1] else int(prev[-1]), None if new[-1] else int(hub[-1]), bool(shares[-1]))
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in held[:4]], names=schema)

    dealt = rows.repartitionByRange("bucket", "id").sortWithinPartitions("bucket", "id")
    return in_arrow(dealt, run, "bucket bigint, id bigint, prev bigint, hub bigint")


def ordered(x, y) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def along(members: DataFrame) -> DataFrame:
    """Candidate pairs along each bucket's order, of walked() rows."""
    both = members.select("id", F.explode(F.array("prev", "hub")).alias("other"))
    return both.filter("other IS NOT NULL AND other <> id").select(*ordered("id", "other")).distinct()


def edits(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """pairs(id, hub, c, hc) with n and m, the sizes of the text's and of the hub's set, and e, the hashes in just one
    of them."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 32):
                part = batch.slice(at, 32)
                x, h = row_hashes(part.column(4)), row_hashes(part.column(5))
                e = [np.setxor1d(i, j, assume_unique=True).view(np.int64) for i, j in zip(x, h, strict=True)]
                sizes = [pa.array([len(i) for i in s], pa.int64()) for s in (x, h)]
                yield pa.RecordBatch.from_arrays([*part.columns[:4], *sizes, pa.array(e, pa.list_(pa.int64()))], names=["id", "hub", "c", "hc", "n", "m", "e"])

    side = lambda k: texts.select(F.col("id").alias(k), F.col("text").alias(f"text_{k}"))
    both = pairs.join(side("id"), "id").join(side("hub"), "hub").select("id", "hub", "c", "hc", "text_id", "text_hub")
    return in_arrow(both, run, "id bigint, hub bigint, c bigint, hc bigint, n bigint, m bigint, e array<bigint>")


def centred(e: DataFrame) -> DataFrame:
    """edits() rows against a text nearer to the middle of each hub's family, with its id as t, so that fewer edits are
    common by chance: the text that differs least from the set of what most of the family has. The hub becomes a
    row of its family. Edits of x against t are those that just one of x and t has against the hub."""
    d = F.size("e").cast("bigint")
    each = e.select("hub", "id", F.explode("e").alias("h"))
    sizes = e.groupBy("hub").agg(F.count("*").alias("texts"))
    most = each.groupBy("hub", "h").agg(F.count("*").alias("f")).join(sizes, "hub").filter("2 * f > texts").select("hub", "h")
    held = each.join(most, ["hub", "h"]).groupBy("hub", "id").agg(F.count("*").alias("q"))
    away = e.select("hub", "id", d.alias("d")).join(held, ["hub", "id"]).withColumn("far", F.col("d") - 2 * F.col("q"))
    t = away.groupBy("hub").agg(F.min(F.struct("far", "id")).alias("x")).filter("x.far < 0").select("hub", F.col("x.id").alias("id"))
    t = written(e.join(t, ["hub", "id"]).select("hub", F.col("id").alias("t"), F.col("c").alias("tc"), F.col("n").alias("tn"), F.col("e").alias("te"), F.col("hc").alias("oc"), F.col("m").alias("om")), "centres")
    moved = e.join(t.select("hub", "t", "tc", "tn", "te"), "hub", "left")
    far = F.concat(F.array_except("e", "te"), F.array_except("te", "e"))
    stays = F.col("t").isNull()
    new = lambda old, now: F.when(stays, F.col(old)).otherwise(now)
    moved = moved.filter("t IS NULL OR id <> t").select("id", "hub", "c", new("hc", F.col("tc")).alias("hc"), "n", new("m", F.col("tn")).alias("m"), new("e", far).alias("e"), F.coalesce("t", "hub").alias("t"))
    return moved.union(t.select(F.col("hub").alias("id"), "hub", F.col("oc").alias("c"), F.col("tc").alias("hc"), F.col("om").alias("n"), F.col("tn").alias("m"), F.col("te").alias("e"), "t"))


def sharing(e: DataFrame, last: bool) -> tuple[DataFrame, DataFrame | None]:
    """Of edits() rows: candidate pairs (a, b) of one hub that share edits, and families (id, hub, c, hc) for the next
    level (None at the last one).

    Texts x and y of n(x) and n(y) shingles differ by d(x) + d(y) - 2 * s shingles, where d counts edits and s those in
    common. At a threshold of 3 in 4 they are linked where 7 times that is at most n(x) + n(y), which is
    14 * s >= v(x) + v(y) with v = 7 * d - n. Where both are linked with the hub they are in its component, so at
    least one, x say, isn't: v(x) > m, the hub's size; hence s > 0. Texts are put into classes by v, and a class's
    least v gives the least s that a text needs with any text of that class. Edits that no other text of the hub has
    can't be common; a text with fewer others than it needs has no partner in the class. Sets with s common members
    share one among their first (size - s + 1) in any one order; here rare edits come first, so that hardly any are
    shared by chance.
    """
    d = F.size("e").cast("bigint")
    g = e.select("id", "hub", "c", "m", (7 * d - F.col("n")).alias("v"), "e")
    each = g.select("id", "hub", F.explode("e").alias("h"))
    often = each.groupBy("hub", "h").agg(F.count("*").alias("f")).filter("f > 1")
    rare_first = each.join(often, ["hub", "h"]).groupBy("id", "hub").agg(F.sort_array(F.collect_list(F.struct("f", "h"))).alias("s"))
    g = g.drop("e").join(rare_first, ["id", "hub"])
    g = g.withColumn("w", F.greatest(F.lit(14), F.expr("m div 16"))).withColumn("k", F.floor((F.col("v") - F.col("m") - 1) / F.col("w")))
    g = written(g.select("id", "hub", "c", "m", "v", "s", "w", "k"), "shared_edits")
    classes = g.groupBy("hub").agg(F.collect_set("k").alias("ks"))
    size = F.size("s").cast("bigint")
    first = lambda k: (size - F.greatest(F.lit(1), F.ceil((F.col("v") + F.col("m") + 1 + k * F.col("w")) / 14)) + 1).cast("int")
    wanted = F.filter(F.transform(F.filter("ks", lambda k: (F.col("k") >= 0) | (k >= 0)), lambda k: F.struct(k.alias("k"), first(k).alias("n"))), lambda x: x["n"] > 0)
    posts = g.join(classes, "hub").select("hub", "id", "c", "v", "k", size.alias("z"), "s", F.explode(wanted).alias("x"))
    posts = posts.select("hub", F.least("k", "x.k").alias("lo"), F.greatest("k", "x.k").alias("hi"), F.explode(F.slice("s", 1, F.col("x.n"))["h"]).alias("h"), "id", "c", "v", "k", "z")
    posts = written(posts, "postings")
    at = ["hub", "lo", "hi", "h"]
    given, hot = posts, None
    if not last:
        meet = F.sum((F.col("k") == F.col("lo")).cast("bigint")) * F.sum((F.col("k") == F.col("hi")).cast("bigint"))
        hot = written(posts.groupBy(*at).agg(meet.alias("pairs"), F.min(F.struct("id", "c")).alias("x")).filter(F.col("pairs") > HOT_PAIRS), "hot_edits")
        given = posts.join(hot.select(*at), at, "left_anti")
    x = given.filter("k = lo").select(*at, F.col("id").alias("x"), F.col("c").alias("cx"), F.col("v").alias("vx"), F.col("z").alias("zx"))
    pairs = x.join(given.filter("k = hi"), at).filter("c <> cx AND (lo < hi OR x < id) AND 14 * least(z, zx) >= v + vx").select(*ordered("x", "id"))
    if last:
        return pairs.distinct(), None
    own = posts.join(hot.select(*at, F.col("x.id").alias("own"), F.col("x.c").alias("hc")), at)
    return pairs.distinct(), own.filter("id <> own").select("id", F.col("own").alias("hub"), "c", "hc").distinct()


def related(family: DataFrame, texts: DataFrame) -> DataFrame:
    """family(id, hub, c, hc) with components c of the text and hc of the hub, to candidate pairs (a, b) that hold all
    links between texts of one hub and of different components: those with the hub itself, and those that share an edit.
    Texts that share an edit with too many others get the first of these as a hub for the next level. That edit is gone
    there, so a family within a family is taken apart in the same way; the last level compares all that are left."""
    spark, found = family.sparkSession, []
    for level in range(LEVELS):
        family = written(family, "families")
        if not family.limit(1).count():
            break
        by_hub = written(edits(family, texts), "edits")
        e = written(centred(by_hub), "edits")
        near = e.filter("7 * size(e) <= n + m AND c <> hc").select(*ordered("id", "t"))
        pairs, more = sharing(e, level == LEVELS - 1)
        found.append(written(near.union(pairs), "related"))
        remove(spark, family, by_hub, e)
        if more is None:
            break
        family = more
    out = found[0] if found else family.select(F.col("id").alias("a"), F.col("hub").alias("b"))
    for f in found[1:]:
        out = out.union(f)
    return out.distinct()


def across(members: DataFrame, labels: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """Candidate pairs (a, b) that hold all links between different components of a bucket. Buckets of one component
    fall out first. In the others, the first text of the largest component is the hub of related(). Without texts there
    is nothing to bound by, and all pairs of different components come out."""
    of = members.join(labels, "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("c"))
    sizes = of.groupBy("bucket", "c").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("bucket").agg(F.max_by("c", F.struct("n", "c")).alias("big"), F.count("*").alias("parts"))
    largest = written(largest.filter("parts > 1").select("bucket", "big"), "mixed_buckets")
    of = of.join(largest, "bucket")
    if texts is None:
        rest = of.filter("c <> big").select("bucket", F.col("id").alias("x"), F.col("c").alias("cx"))
        return rest.join(of, "bucket").filter("c <> cx").select(*ordered("x", "id")).distinct()
    return related(of.filter("id <> big").select("id", F.col("big").alias("hub"), "c", F.col("big").alias("hc")).distinct(), texts)


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (id, component) after further links (a, b), which are few: only components are joined, not all links anew."""
    ends = links.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(labels, "id", "left_anti")
    every = labels.union(ends.select("id", F.col("id").alias("component")))
    side = lambda k: every.select(F.col("id").alias(k), F.col("component").alias(f"c_{k}"))
    top = components(links.join(side("a"), "a").join(side("b"), "b"), "c_a", "c_b")
    return every.join(top.select(F.col("id").alias("component"), F.col("component").alias("top")), "component", "left").select("id", F.coalesce("top", "component").alias("component"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row an input row: id, n_shingles, component_id (the smallest id reachable), kept (the id is that one)."""
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    sketch = written(sketches(d), "sketches")
    known = sketch.filter("key IS NOT NULL AND id IS NOT NULL")
    classes = known.groupBy("key").agg(F.min("id").alias("rep"), F.first("sig").alias("sig"))
    classes = written(classes.withColumn("id", F.monotonically_increasing_id()), "classes")

    rows = written(buckets(classes), "buckets")
    members = written(walked(rows), "members")
    remove(spark, rows)
    meant = written(members.select("id").distinct().join(classes.select("id", "key", "rep"), "id"), "meant")
    some = keyed(d.join(meant.select(F.col("rep").alias("id")).distinct(), "id"))
    texts = written(some.join(meant.select("key", "id"), "key").dropDuplicates(["key"]).select("id", "text"), "texts")

    first = written(along(members), "pairs")
    survivors = written(pruned(first, classes), "survivors")
    links = written(verified(survivors, texts), "links")
    labels = components(links)
    second = written(across(members, labels, texts).join(first, ["a", "b"], "left_anti"), "pairs")
    survivors_2 = written(pruned(second, classes), "survivors")
    more = written(verified(survivors_2, texts), "links")
    if more.limit(1).count():
        labels = merged(labels, more)
    remove(spark, texts, members, meant, first, survivors, links, second, survivors_2)

    of_class = classes.select("key", "rep", "id").join(labels, "id", "left").select("key", "rep", F.coalesce("component", "id").alias("part"))
    names = written(of_class.groupBy("part").agg(F.min("rep").alias("c")), "names")
    own = written(of_class.join(names, "part").select("key", "c"), "components")
    remove(spark, classes, names)
    out = sketch.select("id", "n_shingles", "key").join(own, "key", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("c", "id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


_WORDS = r"regexp_extract_all(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+4],' ') x FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w)-3, 2))) i FROM d WHERE len(w)>0)),
n AS (SELECT doc_id, count(*) n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id a, b.doc_id b, count(*) c FROM s a JOIN s b ON a.x=b.x AND a.doc_id<>b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id=a JOIN n y ON y.doc_id=b WHERE 100*c>=75*(x.n+y.n-c)),
r AS (SELECT doc_id id, doc_id c FROM d UNION SELECT e.b, r.c FROM r JOIN e ON e.a=r.id)
SELECT doc_id, coalesce(n,0) AS n_shingles, m.c AS component_id, m.c=doc_id AS kept FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT id, min(c) c FROM r GROUP BY id) m ON m.id=doc_id"""
