"""Queries that SQL can't express, against plain versions."""

import html
import re
import unicodedata
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F
from quillstream.functions import profiles
from quillstream.operators import evidence, layout, similarity
from quillstream.plans import registry

SF = "/root/testdata/sf0.001"


def read(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet").collect()


def ratio(a, b):
    return SequenceMatcher(None, a, b, autojunk=False).ratio()


def clean(x):
    return " ".join(html.unescape(re.sub("<[^>]+>", " ", x or "")).split())


def words(x):
    found = re.findall(r"[^\W_]+(?:['’-][^\W_]+)*", clean(x).lower().replace("ß", "ss"))
    return [re.sub(r"[\W_]", "", w) for w in found]


def alike(a, b):
    x, y = words(a), words(b)
    return 0.72 * ratio(x, y) + 0.28 * ratio(" ".join(x), " ".join(y)) if x and y else 0.0


def lines(text):
    parts = re.split(r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]", text or "")
    return [x for x in (" ".join(p.split()) for p in parts) if x]


def test_nfkc(spark):
    want = {}
    for r in read(spark, "documents"):
        kept = (c for c in unicodedata.normalize("NFKC", r.text).casefold() if not unicodedata.category(c).startswith("P"))
        want[r.doc_id] = " ".join("".join(kept).split())
    assert {r.doc_id: r.normalized for r in registry.QUERIES["normalize_nfkc"](spark, SF).collect()} == want


def test_every_entity(spark):
    for r in registry.QUERIES["visible_text_all_entities"](spark, SF).collect()[:20]:
        raw = next(p.html for p in read(spark, "pages") if p.page_id == r.page_id)
        v = re.sub(r"(?i)<br\s*/?>", "\n", raw.strip())
        v = html.unescape(re.sub(r"<[^>]+>", " ", re.sub(r"(?i)</(?:Line|Header|Paragraph|TextBlock|Page)>\s*", "\n", v)))
        assert r.visible_text == "\n".join(x for x in (" ".join(y.split()) for y in v.splitlines()) if x)


def test_smoothed_bands(spark):
    got = {r.vec_id: r for r in registry.QUERIES["band_score_smoothed"](spark, SF).collect()}
    for r in read(spark, "embeddings")[:60]:
        v = profiles.smoothed(np.abs(np.asarray(r.embedding, float)))
        level, runs, start = max(v.mean() * 0.75, np.quantile(v, 0.65) * 0.70), [], None
        for i, x in enumerate([*v, 0.0]):
            if x > level and start is None:
                start = i
            elif x <= level and start is not None:
                runs.append(i - start)
                start = None
        bands = sum(n <= max(3, len(v) // 5) for n in runs)
        want = np.log1p(max(1, bands)) + 1.25 * v.std() / (v.mean() + 1e-6) + 0.75 * (v < v.mean() * 0.45).mean()
        assert got[r.vec_id].bands == bands and abs(got[r.vec_id].score - want) < 2e-6


def test_full_repetition_pairs(spark):
    want = {}
    for r in read(spark, "documents"):
        all_ = [[w.lower() for w in re.findall("[A-Za-z0-9]+(?:['’-][A-Za-z0-9]+)?", x)] for x in lines(r.text)]
        runs = [{tuple(w[i : i + 4]) for i in range(len(w) - 3)} for w in all_]
        for right, b in enumerate(all_):
            best = None
            for left in range(max(0, right - 10), right):
                a = all_[left]
                shared = len(set(a) & set(b))
                if min(len(a), len(b)) < 4 or shared < 3:
                    continue
                s = 1.0 if runs[left] & runs[right] else max(ratio(a, b), 0.82 * shared / min(len(set(a)), len(set(b))))
                if s >= 0.68 and (best is None or s > best[1]):
                    best = (left, s)
            if best:
                want[r.doc_id, right] = (best[0], round(best[1], 6))
    got = {(r.doc_id, r.right_line): (r.left_line, r.similarity) for r in registry.QUERIES["repetition_pairs_full"](spark, SF).collect()}
    assert got == want


def turns(spark):
    by = {}
    for r in sorted(read(spark, "conversations"), key=lambda r: (r.conv_id, r.turn)):
        by.setdefault(r.conv_id, []).append(r)
    return [(a, b) for rows in by.values() for a, b in zip(rows, rows[1:])]


def test_alignment_is_the_cheapest(spark):
    got = {}
    for r in sorted(registry.QUERIES["line_alignment"](spark, SF).collect(), key=lambda r: (r.conv_id, r.turn, r.step)):
        got.setdefault((r.conv_id, r.turn), []).append(r)
    for a, b in turns(spark):
        page, visual, steps = lines(a.text), lines(b.text), got.get((b.conv_id, b.turn), [])
        assert [r.page_index for r in steps if r.page_index is not None] == list(range(len(page)))
        assert [r.visual_index for r in steps if r.visual_index is not None] == list(range(len(visual)))
        match = lambda i, j: 1 - alike(page[i], visual[j]) if alike(page[i], visual[j]) >= 0.28 else 1.05  # noqa: B023, E731
        cost = [[0.0] * (len(visual) + 1) for _ in range(len(page) + 1)]
        for i in range(len(page) + 1):
            for j in range(len(visual) + 1):
                options = [cost[i - 1][j] + 0.52] * (i > 0) + [cost[i][j - 1] + 0.48] * (j > 0) + ([cost[i - 1][j - 1] + match(i - 1, j - 1)] if i and j else [])
                cost[i][j] = min(options, default=0.0)
        total = sum(0.52 if r.operation == "page_only" else 0.48 if r.operation == "visual_only" else match(r.page_index, r.visual_index) for r in steps)
        assert abs(total - cost[-1][-1]) < 1e-9


def test_second_views(spark):
    got = {(r.page, r.key): r.consensus for r in registry.QUERIES["second_views"](spark, SF).collect()}
    assert len(got) == 87 and any(v is None for v in got.values())
    for r in read(spark, "conversations"):
        if r.turn % 4 != 3:
            want = None if r.turn % 3 == 2 else alike(r.text, re.sub(r"\s\S+$", "", r.text, flags=re.A) if r.turn % 2 == 0 else r.text)
            assert got[str(r.conv_id), f"index:{r.turn:08d}"] == (None if want is None else pytest.approx(want))


def test_residual_suffix(spark):
    got = {r.doc: (r.reason, r.remaining) for r in registry.QUERIES["residual_suffix"](spark, SF).collect()}
    for a, b in turns(spark):
        emitted, visual = lines(a.text), lines(a.text + "\n" + b.text)
        steps = similarity.alignment([words(x) for x in emitted], [words(x) for x in visual])
        strong = [(i, j) for kind, i, j, s in steps if kind == "match" and s >= 0.70]
        if not strong:
            want = ("no_strong_monotonic_anchor", 0)
        elif max(strong)[0] < len(emitted) - 2:
            want = ("strong_anchor_not_near_generated_tail", 0)
        else:
            left = [v for j, v in enumerate(visual) if j > max(strong)[1] and max(alike(v, x) for x in emitted) < 0.58]
            want = ("strong_lower_visual_suffix" if len(left) >= 2 else "insufficient_distinct_lower_visual_lines", len(left))
        assert got[b.conv_id * 1000 + b.turn] == want
    none = spark.createDataFrame([(1, [], [("x", 0.0, 1.0)]), (2, ["x"], [])], "doc long, emitted array<string>, visual array<struct<text:string,y0:double,y1:double>>")
    assert {r.reason for r in evidence.residual_suffix(none).collect()} == {"missing_generated_or_eligible_visual_lines"}


def page(h=400, w=300, lines_=12):
    """A mask of lines of text: a dense body with a few ascenders above it."""
    ink = np.zeros((h, w), bool)
    rng = np.random.default_rng(0)
    for k in range(lines_):
        top = 16 + k * (h - 30) // lines_
        ink[top : top + 6, 20 : w - 20] |= rng.random((6, w - 40)) < 0.12
        ink[top + 6 : top + 14, 20 : w - 20] |= rng.random((8, w - 40)) < 0.6
    return ink


def found(spark, ink, w=300, h=400):
    d = spark.createDataFrame([(ink.tolist(), w, h)], "ink array<array<boolean>>, w int, h int")
    return layout.orient(d, "ink", "w", "h").first().orientation


def test_orientation(spark):
    ink = page()
    for angle in (0, 90, 180, 270):
        # What is turned by an angle clockwise must be turned back counter-clockwise.
        o = found(spark, np.rot90(ink, -angle // 90))
        assert o.angle == angle and not o.ambiguous and not o.flags and set(o.votes) == {angle % 180}
    blank = found(spark, np.zeros((40, 30), bool), 300, 100)
    assert blank.angle == 0 and blank.ambiguous and set(blank.flags) == {"sparse_or_blank", "wide_spread_or_landscape", "orientation_ambiguous"}
    half = page(400, 400, 12)
    mixed = np.concatenate([half[:, :200], np.rot90(half)[:, :200]], axis=1)
    assert "mixed_orientation_regions" in found(spark, mixed, 100, 300).flags and "tall_strip" in found(spark, mixed, 100, 300).flags
    rows = spark.createDataFrame([(True, 90), (False, 90), (False, 0)], "ambiguous boolean, angle int").select(layout.by_geometry(F.struct("ambiguous", "angle")).alias("r")).collect()
    assert [tuple(r.r) for r in rows] == [(0, "unchanged_geometry_ambiguous"), (90, "whole_page_rotation"), (0, "unchanged")]


def test_gutter(spark):
    v = [0.1] * 100
    v[45:55] = [0.0] * 10
    row = spark.createDataFrame([(v,), ([0.1] * 100,), ([0.0] * 100,), ([0.5],)], "v array<double>").select(layout.gutter_evidence(F.col("v"), F.lit(1000)).alias("g")).collect()
    assert (row[0].g.valid, row[0].g.run_left, row[0].g.run_right, row[0].g.x) == (True, 450, 550, 500)
    assert not row[1].g.valid and not row[2].g.valid and len(row) == 4
