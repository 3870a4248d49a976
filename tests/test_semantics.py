"""Rules that SQL doesn't show, against plain expectations."""

import pytest
from pyspark.sql import functions as F
from quillstream.functions import text as t
from quillstream.functions import values
from quillstream.operators import layout, manifest, merge, settings, similarity


def one(spark, value, f, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(f(F.col("x")).alias("r")).first().r


def test_visible_text(spark):
    raw = "```xml\n<HistoricalDocument><Metadata>no</Metadata><Page><Header>A  b</Header><Line>c&amp;d<br/>e</Line></Page></HistoricalDocument>\n```"
    assert one(spark, raw, t.visible_text) == "A b\nc&d\ne"
    assert one(spark, "<p>&eacute;&#233;</p>", lambda c: t.visible_text(c, every_entity=True)) == "éé"


def test_word_edits_and_empty_texts(spark):
    row = spark.createDataFrame([("The CAT, sat", "the cat sat down"), ("", "x"), ("Straße", "strasse")], "a string, b string").select(t.score(F.col("a"), F.col("b")).alias("s")).collect()
    assert [(r.s.word_edits, r.s.target_words, r.s.exact) for r in row] == [(1, 3, False), (1, 0, False), (0, 1, True)]
    assert row[1].s.cer == 1.0


def test_loop_detectors(spark):
    phrase = "the river rose over the stone bridge again "
    words = lambda c: t.repeated_word_suffix(t.loop_words(c))
    assert one(spark, "start " + phrase * 3, words) == 8
    assert one(spark, "start " + phrase * 2, words) is None
    lines = lambda c: t.repeated_line_suffix(t.lines(c))
    assert one(spark, "x\n" + "one two three four five six seven eight\n" * 3, lines) == 1
    assert one(spark, "x\n" + "one two three\n" * 3, lines) is None
    mixed = " ".join(f"{w} and then he said that we would go to the {w}" for w in "mill farm town mill farm town mill".split())
    assert one(spark, mixed, lambda c: t.low_novelty_tail(t.loop_words(c))) is not None
    assert one(spark, " ".join(f"w{i}" for i in range(80)), lambda c: t.low_novelty_tail(t.loop_words(c))) is None


def test_incomplete_reasons(spark):
    f = lambda c: t.incomplete_reasons(c, F.lit(True))
    assert one(spark, "a</HistoricalDocument>", f) == []
    assert one(spark, "a <!-- and so on ... --></HistoricalDocument>", f) == ["explicit_omission_placeholder"]
    assert one(spark, "<!-- a --> text ... <!-- b --></HistoricalDocument>", f) == []
    assert one(spark, "The rest of the page is not transcribed", f) == ["unclosed_historical_document", "explicit_omission_placeholder"]


def test_provenance_follows_contents(spark):
    schema = "id string, r array<struct<id:string,reading_order:int,source:string,meaningful_content:boolean>>"

    def ids(source, flag=True):
        rows = [("p", [("", 1, "b", True), ("", 0, source, flag)])]
        return [r.bound_id for r in manifest.expand_regions(spark.createDataFrame(rows, schema), "id", "r").orderBy("region_index").collect()]

    assert ids("a") == ids("a") and ids("a")[0] != ids("c")[0] and ids("a")[1] != ids("c")[1]
    assert len(ids("a", False)) == 1


def guarded(spark, gains, lefts, **kind):
    d = spark.createDataFrame([(gains, lefts)], "g array<double>, l array<long>")
    return tuple(d.select(similarity.guard(F.col("g"), F.col("l"), **kind).alias("r")).first().r)


def test_guard(spark):
    good = [0.1] * 8 + [0.0] * 7
    assert guarded(spark, good, [8, 9]) == ("counterfactually_unsupported_repetitive_tail", 8)
    assert guarded(spark, good, [8])[0] == guarded(spark, good, None)[0] == "insufficient_repetition_evidence"
    assert guarded(spark, good, [2, 9])[0] == "repetition_begins_before_visual_baseline"
    assert guarded(spark, [0.1] * 15, [8, 9])[0] == "repetitive_tail_still_prefers_real_page"
    assert guarded(spark, [0.1] * 6 + [0.0, None] + [0.0] * 7, [8, 9])[1] == 8
    assert guarded(spark, [0.1] * 9 + [0.0] * 11, [12, 13])[1] == 9
    assert guarded(spark, [0.1] * 5 + [0.0] * 10, [8, 9])[0] == "candidate_tail_is_not_a_safe_page_suffix"
    assert guarded(spark, [0.01] * 8 + [0.0] * 7, [8, 9])[0] == "real_page_has_no_reliable_prior_visual_advantage"
    assert guarded(spark, [0.1, 0.1] + [None] * 6 + [0.0] * 7, [8, 9])[0] == "insufficient_counterfactual_line_scores"
    assert guarded(spark, [0.1] * 8 + [0.0] * 4, [8, 9])[0] == "candidate_tail_is_not_a_safe_page_suffix"
    kind = {"ratio": 0.62, "floor": None, "names": similarity.GROUNDING}
    assert guarded(spark, [0.01] * 8 + [0.005] * 7, [8, 9], **kind) == ("unsupported_repetitive_tail", 8)
    assert guarded(spark, [0.01] * 8 + [0.007] * 7, [8, 9], **kind)[0] == "tail_remains_visually_grounded"


def test_alignment_has_gaps():
    page, visual = [["the", "old", "mill"], ["zzz"], ["by", "the", "river"]], [["the", "old", "mill"], ["by", "the", "river"]]
    assert [(k, i, j) for k, i, j, _ in similarity.alignment(page, visual)] == [("match", 0, 0), ("page_only", 1, None), ("match", 2, 1)]


def test_prior_needs_support(spark):
    cols = "item string, page string, pos long, left_angle int, right_angle int, left_content boolean, right_content boolean, left_conf double, right_conf double"
    rows = [("a", f"p{i}", i, 90, 270, True, True, 0.9, 0.8) for i in range(5)] + [("a", "p5", 5, 270, 90, True, True, 0.9, 0.9)]
    same = [("b", "p", i, 90, 270, True, True, 0.9, 0.9) for i in range(8)]
    got = layout.item_priors(spark.createDataFrame(rows + same, cols)).collect()
    assert [(r["item"], r.prior_left, r.supporting_pages, r.minimum_confidence) for r in got] == [("a", 90, 5, 0.8)]


def test_limits(spark):
    row = spark.createDataFrame([(10, "dark", True), (10, None, True), (0, None, False), (5000, None, False)], "cap int, why string, c boolean")
    assert [r[0] for r in row.select(merge.token_limit(F.col("cap"), F.col("why"), F.col("c"), 2048)).collect()] == [32, 2048, 2048, 2048]
    retry = spark.createDataFrame([(3, True, True), (3, False, True), (-1, False, False), (2, False, False)], "n int, s boolean, c boolean")
    assert [r[0] for r in retry.select(merge.retry_cap(F.col("n"), F.col("s"), F.col("c"))).collect()] == [1, 0, 0, 2]


def test_word_edits_of_many_different_words(spark):
    a, b = [f"w{i}" for i in range(40_000)], [f"v{i}" for i in range(300)]
    d = spark.createDataFrame([(a[:40], a[40:] and a[:38] + ["x"]), (a, b)], "a array<string>, b array<string>")
    assert [r[0] for r in d.select(t.word_edits(F.col("a"), F.col("b"))).collect()] == [2, 40_000]


def test_settings():
    faithful, legacy = settings.generation_settings("faithful"), settings.generation_settings("legacy")
    assert (faithful["repetition_penalty"], faithful["no_repeat_ngram_size"], faithful["targeted_loop_guard"]) == (1.0, 32, "no_repeat_ngram_size_32")
    assert (legacy["repetition_penalty"], legacy["no_repeat_ngram_size"], legacy["targeted_loop_guard"]) == (1.05, 8, None)
    assert settings.generation_settings("faithful-beam2")["num_beams"] == 2 and "targeted_loop_guard" not in settings.model_settings("grounded-faithful")
    assert settings.generation_settings("native")["no_repeat_ngram_size"] == 0
    settings.RunArguments(profile="grounded-coverage-faithful", line_evidence="x")
    for wrong in ({"profile": "x"}, {"profile": "coverage-gated-faithful"}, {"selective_retry": True}, {"batch_size": 2, "profile": "par-pp"}, {"adapter_label": "a"}, {"require_page_evidence": True}):
        with pytest.raises(ValueError):
            settings.RunArguments(**wrong)
    for wrong in ({"penalty": float("nan")}, {"penalty": 7.0}, {"most_margin": 6.0}, {"anchor_similarity": 1.1}, {"remaining_lines": 0}):
        with pytest.raises(ValueError):
            settings.GateArguments(**wrong)
    for wrong in ({"repeats": 2}, {"check_every": 0}, {"tail_tokens": 100}):
        with pytest.raises(ValueError):
            settings.LoopStopArguments(**wrong)


def test_wrong_scales_and_ids(spark):
    d = spark.createDataFrame([(1,)], "x int")
    fine = d.select(values.layer_scales(F.array(F.lit("3-5:0.5"), F.lit("0:2")))).first()[0]
    assert [(r.layer, r.scale) for r in fine] == [(0, 2.0), (3, 0.5), (4, 0.5), (5, 0.5)]
    for wrong in (["5-3:1"], ["36:1"], ["1:0.5", "0-2:1"], ["a:1"]):
        with pytest.raises(Exception, match="layer scale"):
            d.select(values.layer_scales(F.array(*map(F.lit, wrong)))).collect()
    assert d.select(values.part_scales(F.array(F.lit("33:4:0.0")), r"\d+")).first()[0][0].part == "4"
    with pytest.raises(Exception, match="scale"):
        d.select(values.part_scales(F.array(F.lit("1:q:1"), F.lit("1:q:2")))).collect()
    with pytest.raises(KeyError, match="9"):
        manifest.only_ids(d, "x", ["1", "9"])
    with pytest.raises(Exception, match="lacks"):
        manifest.remap(spark.createDataFrame([("",)], "s string"), "s").collect()
    assert manifest.first_rows(d, "x", 0).count() == 1 and manifest.first_rows(d, "x", 0, zero_is_all=False).count() == 0


def test_predictions_of_another_config_are_refused(spark):
    regions = spark.createDataFrame([("r1", "p", 1), ("r2", "p", 1)], "id string, provenance string, parent int")
    rows = [(0, "r1", "p", 1, "m", "d"), (1, "r2", "p", 1, "m", "d")]
    cols = "pos int, id string, provenance string, parent int, model string, decode_profile string"
    good = spark.createDataFrame(rows, cols)
    assert manifest.accepted(good, regions, ["parent"], ["model", "decode_profile"]).count() == 2
    bad = manifest.rejected_predictions(good, regions, ["parent"], ["model", "decode_profile"], {"model": "other"})
    assert {r.problem for r in bad.collect()} == {"unexpected_config"}
    for change, problem in (((1, "r1", "p", 1, "m", "d"), "duplicate_id"), ((1, "r3", "p", 1, "m", "d"), "unexpected_or_stale_id"), ((1, "r2", "q", 1, "m", "d"), "provenance_mismatch"), ((1, "r2", "p", 2, "m", "d"), "parent"), ((1, "r2", "p", 1, "n", "d"), "mixed_config"), ((1, "r2", "p", 1, "m", ""), "incomplete_config")):
        with pytest.raises(ValueError, match=problem):
            manifest.accepted(spark.createDataFrame([rows[0], change], cols), regions, ["parent"], ["model", "decode_profile"])
