import random
import re

from quillstream.llm import jaccard
from quillstream.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, n=4):
    w = WORD.findall((text or "").translate(LOWER))
    if 0 < len(w) < n:
        return {tuple(w)}
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def brute(rows, t=85):
    """doc_id -> (n, component)"""
    sets = {d: shingle_set(x) for d, x in rows}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, x in enumerate(ids):
        for y in ids[i + 1 :]:
            a, b = sets[x], sets[y]
            if a and b and 100 * min(len(a), len(b)) >= t * max(len(a), len(b)):
                k = len(a & b)
                if 100 * k >= t * (len(a) + len(b) - k):
                    rx, ry = sorted((find(x), find(y)))
                    parent[ry] = rx
    return {d: (len(sets[d]), find(d)) for d in ids}


def corpus(seed, groups, size, vocabulary=400):
    rng = random.Random(seed)
    rows = []
    for _ in range(groups):
        base = [f"v{rng.randrange(vocabulary)}" for _ in range(rng.randrange(3, 160))]
        for _ in range(rng.randrange(1, size)):
            w = list(base)
            for _ in range(rng.randrange(0, 5)):
                k = rng.randrange(len(w))
                w[k : k + rng.randrange(2)] = [f"v{rng.randrange(vocabulary)}"]
            rows.append((len(rows), " ".join(w)))
    rng.shuffle(rows)
    return rows


def test_matches_brute_force(spark):
    rows = corpus(1, 60, 12)
    shared = " ".join(f"p{i}" for i in range(60))
    rows += [(1000 + i, f"{shared} {' '.join(f'q{i}x{j}' for j in range(i % 40))}") for i in range(80)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_large_near_copy_group_and_salted_tokens(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "HOT", 16)
    monkeypatch.setattr(jaccard, "PAIRED", 32)
    monkeypatch.setattr(jaccard, "FAN_IN", 2)
    rng = random.Random(5)
    base = [f"b{i}" for i in range(90)]
    rows = []
    for i in range(250):
        w = list(base)
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(90)] = f"n{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_query_matches_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.op6_jaccard_join(spark, sf).collect()}
    assert got == brute(rows)


def test_defined_cases(spark, docs, rows, none):
    got = jaccard.join(docs).collect()
    assert len(got) == len(rows)
    want = brute([(r[0], r[1]) for r in rows])
    assert all((r.n_shingles, r.component_id) == want[r.doc_id] for r in got)
    kept = jaccard.deduplicate(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(d for d, (_, c) in want.items() if c == d)
    assert jaccard.join(none).count() == 0


def test_components_of_long_paths(spark):
    edges = [(i, i + 1) for i in range(0, 200)] + [(500, 400), (400, 450), (7, 7)]
    for small in (0, 1000):
        got = {r.id: r.comp for r in components(spark.createDataFrame(edges, "x long, y long"), small=small).collect()}
        assert {i for i, c in got.items() if c == 0} >= set(range(1, 201)) and got[500] == got[450] == 400
    assert components(spark.createDataFrame([], "x long, y long")).count() == 0


def test_rows_that_share_an_id_are_documents_of_their_own(spark):
    def words(c, n=60):
        return " ".join(f"{c}{i}" for i in range(n))

    rows = [(None, words("a")), (None, words("b")), (None, words("b") + " end"), (None, None), (None, ""), (7, words("c")), (7, words("d")), (7, words("d")), (8, words("d") + " end"), (9, words("e")), (3, words("c") + " x")]
    rows = [(d, t, i) for i, (d, t) in enumerate(rows)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row int")
    got = jaccard.join(docs).collect()
    keys = sorted({(d, t) for d, t, _ in rows}, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = brute([(k, t) for k, (_, t) in enumerate(keys)])
    assert sorted(map(str, got)) == sorted(f"Row(doc_id={d}, n_shingles={want[k][0]}, component_id={keys[want[k][1]][0]})" for d, t, _ in rows for k in [keys.index((d, t))])
    kept = jaccard.deduplicate(docs)
    assert kept.columns == docs.columns
    kept = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(kept) == len(set(kept)) == 7
    assert {(None, words("a")), (None, None), (None, ""), (7, words("d")), (9, words("e")), (3, words("c") + " x")} < set(kept)
    assert sum(d is None and (t or "").startswith("b0") for d, t in kept) == 1
