import math
import random
import re
import zlib
from functools import lru_cache

import numpy as np
from quillstream.llm import toxicity


def test_held_out_accuracy_and_defined_cases(spark):
    rng = random.Random(7)
    words = [f"{a}{b}" for a in ("lor", "ips", "dol", "sit", "ame") for b in ("um", "or", "et", "an", "is")]
    bad = ["scumbag", "worthless", "moronic"]
    docs, labels = [], []
    for i in range(1500):
        w = [rng.choice(words) for _ in range(rng.randrange(5, 80))]
        toxic = i % 4 == 0
        if toxic:
            w[rng.randrange(len(w))] = rng.choice(bad)
        if rng.random() < (0.6 if toxic else 0.1):  # groups are named more often in toxic texts
            w.insert(0, rng.choice(toxicity.IDENTITY[0]))
        docs.append((i, " ".join(w), "x"))
        labels.append((i, 1, int(toxic)))
    docs += [(5000, None, "x"), (5001, "", "x"), (5002, "women men girls", "x"), (None, "plain words", "x"), docs[3]]
    labels += [(9999, 1, 1), (None, 1, 1), (5002, None, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string, score string")
    got = toxicity.classify(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(docs)
    by = {r.doc_id: r for r in got}
    out = [i for i in range(1500) if toxicity.crc_held_out(i)]
    assert all(by[i].held_out == toxicity.crc_held_out(i) for i in range(1500))
    assert np.mean([by[i].predicted == (i % 4 == 0) for i in out]) > 0.97
    assert by[5000].score == by[5001].score and 0 <= by[5000].score <= 1
    assert by[5002].predicted == 0 and all(r.predicted == (r.score >= 0.5) for r in got)


def test_swapping_changes_little(spark):
    rng = np.random.default_rng(0)
    n = 400
    y = (np.arange(n) % 2).astype(float)
    # Column 0: a toxic word; 1: a term named in toxic texts only; 2: the term it is swapped for.
    rows, cols, srows, scols, pairs = [], [], [], [], []
    for i in range(n):
        if y[i] and rng.random() < 0.7:
            rows.append(i)
            cols.append(0)
        if y[i] and rng.random() < 0.5:
            rows.append(i)
            cols.append(1)
            pairs.append(i)
            srows += [i] * (1 + (cols[-2:-1] == [0] and rows[-2] == i))
            scols += [0, 2] if cols[-2:-1] == [0] and rows[-2] == i else [2]
    args = (y, *map(np.asarray, (rows, cols, srows, scols, pairs)), 3, 1e-4)
    free, _ = toxicity.train(*args, 0.0, 400)
    held, _ = toxicity.train(*args, 10.0, 400)
    assert abs(held[1] - held[2]) < 0.2 * abs(free[1] - free[2]) and held[0] > 1


def test_without_labels_or_rows(spark):
    d = spark.createDataFrame([(1, "a b", "x")], "doc_id long, text string, lang string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.predicted for r in toxicity.classify(d, none).collect()] == [0]
    assert toxicity.classify(d.limit(0), none).count() == 0


def test_query(spark, sf):
    got = toxicity.op10_toxicity(spark, sf).collect()
    label = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    right = [r.predicted == label[r.doc_id] for r in got if r.held_out and r.doc_id in label]
    assert np.mean(right) > 0.8


def plain_score(text, weight, bias):
    """The score of one text: the weights of the words and word beginnings that it has, each once."""
    found = set()
    for w in re.findall(rb"[A-Za-z\x80-\xff]+", (text or "").encode()):
        w = bytes(c + 32 if 65 <= c <= 90 else c for c in w)
        found |= {(0, w), *((k, w[: toxicity.HEADS[k]]) for k in (1, 2, 3) if len(w) > toxicity.HEADS[k])}
    # Features share a weight if their numbers agree, and count once.
    numbers = {feature_number(k, w) for k, w in found}
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(weight.get(n, 0.0) for n in numbers) + bias))))


@lru_cache(maxsize=None)
def feature_number(k, w):
    """The number of a whole word (k = 0) or of a beginning, which a longer word gives."""
    raw = w if not k else w + b"a" * 9
    f, _ = toxicity.tokens(np.frombuffer(raw, np.uint8), np.asarray([0, len(raw)]), toxicity._hasher())
    return int(f[0, k])


def test_query_matches_plain_scores(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    weight = dict(zip(model.features.tolist(), model.weights.tolist()))
    text = {r.doc_id: r.text for r in docs.collect()}
    got = toxicity.op10_toxicity(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(text)
    for r in got:
        want = plain_score(text[r.doc_id], weight, model.bias)
        assert abs(r.score - want) < 1e-9 and r.predicted == (want >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_more_labels_than_the_bound_and_repeats(spark):
    words = "alpha beta gamma delta".split()
    docs = spark.createDataFrame([(i % 60, f"{words[i % 4]} {'scum' if i % 60 % 3 == 0 else 'fine'} {i}") for i in range(240)] + [(7, " ".join(["long"] * 200_000))], "doc_id long, text string")
    labels = spark.createDataFrame([(i % 60, 1, int(i % 60 % 3 == 0)) for i in range(180)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    one = toxicity.labelled(docs, labels, 1000).collect()
    assert len(one) == len({r.doc_id for r in one}) and not any(toxicity.crc_held_out(r.doc_id) for r in one)
    few = [sorted(r.doc_id for r in toxicity.labelled(docs, labels, 11).collect()) for _ in range(2)]
    assert few[0] == few[1] and len(few[0]) == 11
    got = toxicity.classify(docs, labels, max_labelled=30).collect()
    assert len(got) == 241 and np.mean([r.predicted == (r.doc_id % 3 == 0) for r in got if r.doc_id != 7]) > 0.95
