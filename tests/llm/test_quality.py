import re

import numpy as np
from quillstream.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    w = WORD.findall(text or "")
    win = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count = {x: win.count(x) if len(win) < 500 else None for x in set(win)}
    if len(win) >= 500:
        count = dict.fromkeys(win, 0)
        for x in win:
            count[x] += 1
    hit = {i + k for i, x in enumerate(win) if count[x] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_counts_match_brute_force(spark, docs, rows, none):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.judge(docs, labels).collect()
    assert len(got) == len(rows)
    text = {r[0]: r[1] for r in rows}
    for r in got:
        want = plain(text[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert r.kept == (not r.base_failed)
    assert quality.judge(none, labels).count() == 0


def test_query_matches_brute_force(spark, sf):
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = quality.op5_quality_rules(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(text)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain(text[r.doc_id])
        assert not (r.base_failed and r.kept)


def test_rules_find_planted_thresholds():
    rng = np.random.default_rng(1)
    x = rng.random((3000, len(quality.NAMES)))
    bad = (x[:, 1] > 0.8) | ((x[:, 2] > 0.7) & (x[:, 5] < 0.3))
    rules = quality.learn(x, bad)
    got = np.zeros(len(x), bool)
    for r in rules:
        got |= quality._covers(x, r)
    assert (got == bad).mean() > 0.95 and all(len(r) <= 4 for r in rules)
    assert quality.learn(x, np.zeros(3000, bool)) == []


def all_counts(text):
    """Every count of a text, by the names in COUNTS."""
    t = text or ""
    n, chars, symbols, dups, repeats = plain(t)
    within = lambda cs: sum(t.count(c) for c in cs)
    lines = sum(bool(WORD.search(x)) for x in t.split("\n"))
    return dict(zip(quality.COUNTS, (n, chars, symbols, dups, repeats, lines, within("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), within("0123456789"), within("!?"), within(".,;:"))))


def plain_kept(c, rules):
    """The verdict of the base rules and the list, from counts."""
    if c["n_words"] < 50 or 100 * c["n_repeat_words"] > 50 * c["n_words"]:
        return False
    x = [c[a] / max(c[b], 1) for _, a, b in quality.RATIOS] + [float(c["n_words"])]
    return not any(all(x[j] >= t if least else x[j] <= t for j, least, t in rule) for rule in rules)


def test_verdicts_match_the_list(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    text = {r.doc_id: r.text for r in docs.collect()}
    rules = quality.fit(quality.statistics(docs), quality.marked(labels, 40_000))
    assert {r.doc_id: r.kept for r in quality.op5_quality_rules(spark, sf).collect()} == {d: plain_kept(all_counts(t), rules) for d, t in text.items()}
    got = quality.statistics(docs).collect()
    assert all({k: r[k] for k in quality.COUNTS} == all_counts(text[r.doc_id]) for r in got)


def test_labels_with_nulls_repeats_and_a_bound(spark):
    good, bad = " ".join(f"w{i}" for i in range(80)), " ".join(f"w{i} ##" for i in range(60))
    rows = [(i, f"{good} {i}" if i % 2 else f"{bad} {i}") for i in range(300)] + [(0, good), (None, good), (301, " ".join(f"x{i}" for i in range(300_000)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(300)] * 2 + [(None, 0, 0), (4, None, 1), (9999, 0, 0)], "doc_id long, quality int, toxic int")
    known = quality.marked(labels, 100).collect()
    assert len(known) == 100 == len({r.doc_id for r in known}) and known == quality.marked(labels, 100).collect()
    for most in (40_000, 120):
        got = quality.judge(docs, labels, most).collect()
        assert len(got) == len(rows)
        assert all(r.kept == (r.n_symbols == 0) for r in got if r.doc_id not in (0, None))
