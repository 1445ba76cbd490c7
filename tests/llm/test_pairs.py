"""Operators 2, 3 and 9: SQL on driver rows, brute force and hand-made cases."""

import hashlib
import random

import numpy as np
import pytest

from folioflow.llm import components, decontaminate, minhash, suffix_dedup
from tests.llm.brute import dedup_bytes
from tests.oracle import assert_same

SF = "/root/testdata/sf0.001"
WORDS = [f"w{i}" for i in range(400)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, True) for i, t in rows], "doc_id long, text string, component_id int, kept boolean")


def group_of_copies(seed=1, n=40):
    """A text, near copies of it with some words changed, exact copies, and others."""
    r = random.Random(seed)
    base = [r.choice(WORDS) for _ in range(120)]
    rows = [(100, " ".join(base)), (101, " ".join(base)), (102, " ".join(base).upper())]
    for i in range(n):
        w = list(base)
        for _ in range(r.randint(0, 5)):
            w[r.randrange(len(w))] = r.choice(WORDS)
        rows.append((200 + i, " ".join(w)))
    rows += [(500 + i, " ".join(r.choice(WORDS) for _ in range(60))) for i in range(20)]
    rows += [(1, None), (2, ""), (3, " \n"), (4, "a b c"), (5, "A b\tc"), (6, "a b"), (7, "one two three four five"), (8, "ONE two three four five")]
    return rows


def brute_components(rows):
    sets = {i: minhash.shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if minhash.linked(sets[i], sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def test_near_duplicates_brute(spark):
    rows = group_of_copies()
    got = {r.doc_id: tuple(r)[1:] for r in minhash.near_duplicates(frame(spark, rows)).collect()}
    assert got == brute_components(rows)


def edited(seed, n, words=150, most=9):
    """Near copies of one text with 1 to `most` words replaced, removed or added."""
    r = random.Random(seed)
    base, out = [r.choice(WORDS) for _ in range(words)], []
    for i in range(n):
        w = list(base)
        for p in r.sample(range(words), r.randint(1, most)):
            w[p] = r.choice([r.choice(WORDS), r.choice(WORDS), "", w[p] + " " + r.choice(WORDS)])
        out.append((1000 * seed + i, " ".join(w)))
    return out


@pytest.mark.parametrize("hot", [minhash.HOT_PAIRS, 20])
def test_near_duplicates_of_edited_copies_brute(spark, monkeypatch, hot):
    """Also with families taken apart at once, which large ones would be."""
    monkeypatch.setattr(minhash, "HOT_PAIRS", hot)
    rows = edited(1, 300)
    r = random.Random(8)
    inner = rows[0][1].split()
    for p in r.sample(range(100), 12):
        inner[p] = r.choice(WORDS)
    for i in range(40):  # a family within the family, far from its middle
        w = list(inner)
        for p in r.sample(range(len(w)), r.randint(0, 8)):
            w[p] = r.choice(WORDS)
        rows.append((3000 + i, " ".join(w)))
    got = {r.doc_id: tuple(r)[1:] for r in minhash.near_duplicates(frame(spark, rows)).collect()}
    want = brute_components(rows)
    assert len({c for _, c, _ in want.values()}) > 30
    assert got == want


def groups_of(ids, links):
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("seed", [2, 5])
def test_related_holds_all_links_between_components(spark, seed):
    """The links known before and those among related() pairs connect all that any link connects, with few pairs."""
    rows = edited(seed, 120)
    texts = spark.createDataFrame(rows, "id long, text string")
    sets = {i: minhash.shingles(t) for i, t in rows}
    links = {(a, b) for a in sets for b in sets if a < b and minhash.linked(sets[a], sets[b])}
    hub = rows[0][0]
    known = {(a, b) for a, b in links if a == hub}
    near = {b for _, b in known} | {hub}
    family = spark.createDataFrame([(i, hub, hub if i in near else i, hub) for i in sets if i != hub], "id long, hub long, c long, hc long")
    got = {tuple(r) for r in minhash.related(family, texts).collect()}
    assert groups_of(sets, known) != groups_of(sets, links) == groups_of(sets, known | (got & links))
    assert len(got) < 4 * len(sets)


def test_near_duplicates_with_repeated_ids(spark):
    r = random.Random(4)
    a, b = ([r.choice(WORDS) for _ in range(60)] for _ in range(2))
    near = lambda w: [*w[:59], "other"]
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, " ".join(near(a))), (3, " ".join(near(b))), (4, " ".join(b[:30]))]
    got = sorted((x.doc_id, x.n_shingles, x.component_id, x.kept) for x in minhash.near_duplicates(frame(spark, rows)).collect())
    assert got == [(1, 56, 1, True), (1, 56, 1, True), (2, 56, 1, False), (3, 56, 1, False), (4, 26, 4, True)]
    named = spark.createDataFrame([("b", " ".join(a)), ("a", " ".join(near(a))), (None, " ".join(a)), ("c", None)], "doc_id string, text string")
    assert sorted((str(x.doc_id), x.component_id) for x in minhash.near_duplicates(named).collect()) == [("None", None), ("a", "a"), ("b", "a"), ("c", "c")]


def test_near_duplicates_sql(spark):
    assert_same(minhash.query(spark, SF), minhash.SQL, SF)


def test_near_duplicates_edges(spark):
    assert minhash.near_duplicates(frame(spark, [])).count() == 0
    d = frame(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f")])
    got = sorted((tuple(r) for r in minhash.near_duplicates(d).collect()), key=str)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (None, 2, None, True)], key=str)


def test_bayes_table():
    for n, m in minhash.least_matches():
        assert m < 0.75 * n  # a pair at the threshold is expected to pass
    assert minhash.least_matches()[-1][1] > 60


def test_across_finds_all_pairs(spark):
    members = spark.createDataFrame([(1, i) for i in range(6)] + [(2, 0), (2, 1)], "bucket long, id long")
    labels = spark.createDataFrame([(0, 0), (1, 0), (2, 0), (3, 3), (4, 3)], "id long, component long")
    got = {tuple(r) for r in minhash.across(members, labels).collect()}
    comp = {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 5}
    assert got == {(a, b) for a in comp for b in comp if a < b and comp[a] != comp[b]}


def test_components_of_a_chain(spark):
    n = 60
    links = spark.createDataFrame([(i + 1, i) for i in range(n)] + [(100, 101), (101, 100), (7, 7), (None, 3)], "a long, b long")
    got = {r.id: r.component for r in components.components(links).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 100: 100, 101: 100}
    assert components.components(links.limit(0)).count() == 0


def test_merged_labels(spark):
    labels = components.components(spark.createDataFrame([(1, 2), (2, 3), (10, 11), (20, 21)], "a long, b long"))
    got = {r.id: r.component for r in minhash.merged(labels, spark.createDataFrame([(3, 11), (30, 20), (40, 41)], "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 10: 1, 11: 1, 20: 20, 21: 20, 30: 20, 40: 40, 41: 40}


ITEMS = [(1, "the quick brown fox jumps over the lazy dog again and again"), (2, "Short item"), (3, None), (4, ""), (5, "the quick brown fox jumps over the lazy dog again and again"), (10, "é ü ß 1 2 3 4 5 6 7 8 9"), (None, "x")]
DOCS = [
    (1, "He said: THE quick, brown fox jumps over the lazy dog again!"), (2, "a short ITEM here; short item"), (3, None), (4, ""), (5, "the quick brown fox jumps over the lazy dog"),
    (6, "é ü ß 1 2 3 4 5 6 7 and é ü ß 1 2 3 4 5 6 7 8 9"), (7, "clean text"), (8, "x"), (8, "x"), (None, "short item"),
]


def contamination_row(text):
    w = decontaminate.words(text)
    hit, names = set(), set()
    for i, t in ITEMS:
        v = decontaminate.words(t)
        n = min(10, len(v))
        windows = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if n else set()
        for k in range(len(w) - n + 1):
            if tuple(w[k : k + n]) in windows and i is not None:
                names.add(str(i))
                hit |= set(range(k, k + n))
    return len(w), len(hit), sorted(names)


def test_decontaminate_cases(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    d = spark.createDataFrame([(i, t, "x") for i, t in DOCS], "doc_id long, text string, item string")
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in decontaminate.decontaminate(d, items).collect()), key=str)
    want = sorted(((i, *(contamination_row(t) if i is not None else (len(decontaminate.words(t)), 0, []))) for i, t in DOCS), key=str)
    assert got == want
    assert decontaminate.decontaminate(d.limit(0), items).count() == 0
    assert decontaminate.decontaminate(d, items.limit(0)).filter("contaminated").count() == 0


def test_decontaminate_with_repeated_ids(spark):
    items = spark.createDataFrame(ITEMS[:2], "item_id long, text string")
    rows = [(1, "x"), (1, ITEMS[0][1]), (1, "clean words only"), (1, "x"), (2, "a short item")]
    got = sorted((r.doc_id, r.n_words, r.n_hit) for r in decontaminate.decontaminate(spark.createDataFrame([(i, t, 1, 1) for i, t in rows], "doc_id long, text string, k int, fp int"), items).collect())
    assert got == [(1, 1, 0), (1, 1, 0), (1, 3, 0), (1, 12, 12), (2, 3, 2)]


def test_decontaminate_sql(spark):
    assert_same(decontaminate.query(spark, SF), decontaminate.SQL, SF)


def test_winnowing_guarantee():
    r = np.random.default_rng(5)
    for _ in range(200):
        shared = r.integers(1, 1 << 60, decontaminate.SPAN, dtype=np.uint64)
        a, b = (np.concatenate([r.integers(1, 1 << 60, k, dtype=np.uint64), shared, r.integers(1, 1 << 60, 7, dtype=np.uint64)]) for k in r.integers(0, 30, 2))
        fa, fb = (set(decontaminate.winnowed(x, np.zeros(len(x), np.int64))[1].tolist()) for x in (a, b))
        assert fa & fb


def repeats(seed):
    r = random.Random(seed)
    piece = lambda n: "".join(r.choice("abcdé ") for _ in range(n))
    passage, line = piece(400), piece(130)
    docs = []
    for i in range(30):
        k = r.randint(0, len(passage) - 110)
        docs.append((i, piece(r.randint(0, 200)) + r.choice([passage, passage[k:], passage[:k], line, ""]) + piece(r.randint(0, 150)) + r.choice([line, "", passage[50:200]])))
    return docs + [(50, docs[3][1]), (51, docs[3][1]), (52, "z" * 350), (53, "z" * 99), (54, None), (55, ""), (56, "xy" * 200), (57, line), (58, line[:99])]


@pytest.mark.parametrize("seed", [1, 2])
def test_suffix_dedup_brute(spark, seed):
    rows = repeats(seed)
    got = sorted(tuple(r) for r in suffix_dedup.suffix_dedup(frame(spark, rows)).collect())
    assert got == dedup_bytes([(i, (t or "").encode()) for i, t in rows])


def test_suffix_dedup_driver_rows(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    got = sorted(tuple(r) for r in suffix_dedup.query(spark, SF).collect())
    assert got == dedup_bytes([(r.doc_id, (r.text or "").encode()) for r in d.collect()])


def test_suffix_dedup_edges(spark):
    assert suffix_dedup.suffix_dedup(frame(spark, [])).count() == 0
    r = random.Random(3)
    t = "".join(r.choice("abc") for _ in range(300))
    d = frame(spark, [(1, t), (1, t), (None, t), (2, t)])
    got = sorted(((r.doc_id, r.n_removed) for r in suffix_dedup.suffix_dedup(d).collect()), key=str)
    assert got == sorted([(1, 0), (1, 0), (None, 0), (2, 300)], key=str)
    kept = suffix_dedup.suffix_dedup(frame(spark, [(1, "short")]), with_kept=True).first()
    assert bytes(kept.kept) == b"short" and kept.kept_sha256 == hashlib.sha256(b"short").hexdigest()


def test_suffix_dedup_with_repeated_ids(spark):
    r = random.Random(6)
    a, b = ("".join(r.choice("abcd ") for _ in range(400)) for _ in range(2))
    rows = [(1, a), (1, "short"), (1, a), (1, b), (2, a[100:] + b[::-1][:120]), (3, b)]
    got = sorted((x.doc_id, x.n_bytes, x.n_removed) for x in suffix_dedup.suffix_dedup(frame(spark, rows)).collect())
    assert got == [(1, 5, 0), (1, 400, 0), (1, 400, 0), (1, 400, 0), (2, 420, 300), (3, 400, 400)]


def test_later_across_partitions(spark):
    rows = [(5, 1, i, 0) for i in range(200)] + [(i, 0, 7, i) for i in range(300)]
    ranks = spark.createDataFrame(rows, "k long, k2 int, id long, p int")
    got = {tuple(r) for r in suffix_dedup.later(ranks).collect()}
    assert got == {(i, 0) for i in range(1, 200)}
