"""The pipeline's stages on their own inputs, against plain versions."""

import hashlib
import sys
from collections import Counter
from pathlib import Path

import corpus_pipeline as p
import pytest

sys.path.insert(0, str(Path(__file__).parent))

import test_jaccard  # noqa: E402
import test_mixing_packing as mp  # noqa: E402
import test_quality  # noqa: E402
import test_secrets  # noqa: E402


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    """docs, then each stage's result, written and read again."""
    out = [spark.read.parquet(f"{sf}/documents.parquet")]
    for k, (_, stage) in enumerate(p.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, out[-1], sf).write.parquet(path)
        out.append(spark.read.parquet(path))
    return [(df.columns, df.collect()) for df in out]


def test_columns_stay(stages):
    assert len(p.STAGES) == 5 and all(columns == stages[0][0] for columns, _ in stages[:-1])


def test_rejected_documents_go(stages):
    (_, docs), (_, kept) = stages[:2]
    ids = {r.doc_id for r in kept}
    for r in docs:
        n, *_, repeats = test_quality.plain(r.text)
        if n < 50 or 100 * repeats > 50 * n:
            assert r.doc_id not in ids
    assert len(kept) > 0.5 * len(docs) and {r.doc_id: r for r in docs} | {r.doc_id: r for r in kept} == {r.doc_id: r for r in docs}


def test_one_of_each_group_stays(stages):
    (_, docs), (_, kept) = stages[1:3]
    want = [d for d, (_, c) in test_jaccard.brute([(r.doc_id, r.text) for r in docs]).items() if d == c]
    assert sorted(r.doc_id for r in kept) == sorted(want)


def test_secrets_go_and_documents_stay(stages):
    (_, docs), (_, masked) = stages[2:4]
    before, after = {r.doc_id: r for r in docs}, {r.doc_id: r for r in masked}
    assert before.keys() == after.keys()
    for d, r in after.items():
        assert not [s for s in test_secrets.plain(r.text) if "[secret]" not in r.text[s[0] : s[2] + 8]]
        assert r.text == before[d].text or "[secret]" in r.text
    assert all("[secret]" in after[d].text for d, r in before.items() if test_secrets.plain(r.text))


def test_mix_takes_what_the_rates_say(stages):
    (_, docs), (_, mixed) = stages[3:5]
    size = {r.doc_id: len(test_quality.WORD.findall(r.text)) for r in docs}
    per = Counter()
    for r in docs:
        per[r.source] += size[r.doc_id]
    target = mp.water(per)
    want = Counter()
    for r in docs:
        rate = min(3.0, target[r.source] / per[r.source])
        u = int(hashlib.md5(f"mix:{r.doc_id}".encode()).hexdigest()[:12], 16) / 16**12
        want[r.doc_id] = int(rate) + (u < rate - int(rate))
    assert Counter(r.doc_id for r in mixed) == +want


def test_all_pieces_are_packed(stages):
    (_, docs), (_, packed) = stages[4:6]
    mp.check(packed, [(r.doc_id, r.text) for r in docs])


def test_run_applies_the_stages_in_order(spark, sf, monkeypatch):
    cut = lambda spark, docs, d: docs.where("doc_id % 2 = 0")
    last = lambda spark, docs, d: docs.select("doc_id")
    monkeypatch.setattr(p, "STAGES", [("a", cut), ("b", last)])
    got = p.run(spark, sf)
    assert got.columns == ["doc_id"] and {r.doc_id % 2 for r in got.collect()} == {0}


def test_quality_judges_each_row_by_its_own_text(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    good, bad = " ".join(f"w{i}" for i in range(80)), "too short"
    rows = [(None, good, "x"), (None, bad, "x"), (4, good, None), (4, bad, "y"), (4, good, None), (5, None, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words string")
    got = p.quality_rules(spark, docs, str(tmp_path))
    assert got.schema == docs.schema and Counter(map(tuple, got.collect())) == Counter(r for r in rows if r[1] == good)


CASES = [(1, None), (2, ""), (3, "  \n "), (4, " ".join(f"w{i}" for i in range(60))), (5, " ".join(f"v{i}" for i in range(30_000))), (5, " ".join(f"v{i}" for i in range(30_000)))]
NAMES = ["_size", "_keep", "_kept", "_row", "_d", "_h", "row", "k", "key", "base", "spans", "n_words", "quality", "digest"]


def test_stages_take_any_row_and_name(spark, sf):
    """Null, empty and very long texts, repeated rows, empty tables, and columns whose names a stage might use itself."""
    rows = [(d, t, "en", None if d == 4 else "s", len(t or ""), *(f"{n}{d}" for n in NAMES)) for d, t in CASES]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in NAMES))
    want = {0: [4, 5, 5], 1: [1, 2, 3, 4, 5], 2: [1, 2, 3, 4, 5, 5]}
    whole = {r[0]: r for r in rows}
    for k, (_, stage) in enumerate(p.STAGES):
        got, none = stage(spark, docs, sf), stage(spark, docs.limit(0), sf)
        assert none.count() == 0
        if k == len(p.STAGES) - 1:
            assert {r.doc_id for r in got.collect()} == {1, 2, 3, 4, 5}
            continue
        assert got.schema == docs.schema == none.schema
        found = got.collect()
        assert all(tuple(r) == whole[r.doc_id] for r in found)
        if k in want:
            assert sorted(r.doc_id for r in found) == want[k]
