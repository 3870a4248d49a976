import hashlib
import random
import re

from quillstream.llm import substring

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, length=20):
    """(doc_id, text) in order of ids -> doc_id -> (n_words, n_removed, kept)"""
    seen, out = {}, {}
    for d, t in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        w = WORD.findall(t or "")
        gone = set()
        for i in range(len(w) - length + 1):
            if seen.setdefault(tuple(w[i : i + length]), (d, i)) != (d, i):
                gone.update(range(i, i + length))
        out[d] = (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    return out


def check(got, rows):
    want = brute(rows)
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.n_removed, r.kept) == want[r.doc_id]


def test_matches_brute_force(spark):
    rng = random.Random(2)
    passages = [[f"p{rng.randrange(50)}" for _ in range(rng.randrange(15, 70))] for _ in range(12)]
    rows = []
    for i in range(300):
        w = []
        for _ in range(rng.randrange(0, 5)):
            w += rng.choice(passages) if rng.random() < 0.6 else [f"u{rng.randrange(9999)}" for _ in range(rng.randrange(40))]
        rows.append((i, rng.choice([" ", "\n", "  "]).join(w)))
    rows += [(400, "a " * 200), (401, "a b " * 100), (402, "a " * 19), (403, " ".join("abc" * 30))]
    check(substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect(), rows)


def test_other_length(spark):
    rows = [(i, " ".join(f"w{j % (7 + i % 3)}" for j in range(i))) for i in range(60)]
    got = substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), length=6).collect()
    want = brute(rows, 6)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in got} == want


def test_three_levels_and_parts(spark, monkeypatch):
    assert substring.levels(20) == [10, 20] and substring.levels(40) == [10, 20, 40] and substring.levels(6) == [3, 6] and substring.levels(36) == [18, 36]
    monkeypatch.setattr(substring, "MANY", 1)
    monkeypatch.setattr(substring, "REMEMBERED", 3)
    rng = random.Random(8)
    passages = [[f"p{rng.randrange(90)}" for _ in range(n)] for n in (12, 25, 39, 40, 41, 60, 90)]
    rows = []
    for i in range(200):
        w = []
        for _ in range(rng.randrange(0, 4)):
            w += rng.choice(passages) if rng.random() < 0.7 else [f"u{rng.randrange(9999)}" for _ in range(rng.randrange(60))]
        rows.append((i, " ".join(w)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    for length in (40, 20):
        got = substring.remove_repeats(d, length=length).collect()
        assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in got} == brute(rows, length)
    # Nothing survives the first level.
    alone = spark.createDataFrame([(i, " ".join(f"{i}x{j}" for j in range(90))) for i in range(9)], "doc_id long, text string")
    assert {(r.n_words, r.n_removed) for r in substring.remove_repeats(alone, length=80).collect()} == {(90, 0)}


def test_defined_cases(spark, docs, rows, none):
    more = docs.unionByName(spark.createDataFrame([(None, rows[5][1], "en", "s", 1, "x", "y")], docs.schema))
    check(substring.remove_repeats(more).collect(), [*((r[0], r[1]) for r in rows), (None, rows[5][1])])
    assert substring.remove_repeats(none).count() == 0


def test_query_matches_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = brute(rows)
    got = substring.op3_substring_dedup(spark, sf).collect()
    assert len(got) == len(rows) and any(r.n_removed for r in got)
    for r in got:
        n, gone, kept = want[r.doc_id]
        assert (r.n_words, r.n_removed, r.kept_sha256) == (n, gone, hashlib.sha256(kept.encode()).hexdigest())


def test_rows_that_share_an_id_have_spans_of_their_own(spark):
    passage = " ".join(f"p{i}" for i in range(40))
    own = lambda c, n: " ".join(f"{c}{i}" for i in range(n))
    rows = [(None, f"{own('a', 500)} {passage}"), (None, passage), (None, passage + " end"), (None, own("b", 3)), (None, None), (None, passage), (5, f"{own('c', 90)} {passage}"), (5, passage[:-4]), (6, f"{own('c', 30)} x")]
    texts = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(r[1].encode()).digest() if r[1] is not None else b""))
    want = brute([(k, t) for k, (_, t) in enumerate(texts)])
    got = substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str((d, *want[texts.index((d, t))])) for d, t in rows)
