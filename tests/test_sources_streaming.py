import hashlib
import json
import sys

import pytest
from quillstream.operators import recognizer
from quillstream.sources import jsonl
from quillstream.sources.tail import Replaced, TailReader, TailSource
from quillstream.streaming import merging, tasks


def test_scans(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"a": 1}\n\n{"a": 2, "b": 3}\n')
    assert sorted(r.a for r in jsonl.scan_lenient(spark, str(p), "a int").collect()) == [1, 2]
    assert jsonl.scan_strict(spark, str(p), "a int").count() == 2
    assert jsonl.scan_or_empty(spark, str(tmp_path / "none"), "a int").count() == 0
    p.write_text('{"a": 1}\n[2]\n{"a"\n')
    assert [(r.pos, r.problem) for r in jsonl.violations(spark, str(p)).orderBy("pos").collect()] == [(2, "not an object"), (3, "not JSON")]
    with pytest.raises(ValueError, match=":2: not an object"):
        jsonl.scan_strict(spark, str(p), "a int")
    assert jsonl.last_records(spark, str(p)).first().value == '{"a": 1}'


def test_files(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "b.PNG").write_bytes(b"1")
    (tmp_path / "x" / "c.txt").write_bytes(b"2")
    (tmp_path / "x" / "s.json").write_text('{"id": "t", "current": 2}')
    (tmp_path / "x" / "broken.json").write_text("{")
    assert [r.path.rsplit("/", 1)[1] for r in jsonl.scan_images(spark, [str(tmp_path / "x")]).collect()] == ["b.PNG"]
    sums = {r.path.rsplit("/", 1)[1]: r.sha256 for r in jsonl.checksums(spark, str(tmp_path / "x")).collect()}
    assert sums["c.txt"] == hashlib.sha256(b"2").hexdigest() and len(sums) == 4
    got = jsonl.scan_sidecars(spark, str(tmp_path / "x"), "id string, current double").collect()
    assert [(r.id, r.current, r.file) for r in got] == [("t", 2.0, "s.json")]


def test_tail_waits_for_line_ends_and_notices_replacement(tmp_path):
    p = tmp_path / "t.jsonl"
    p.write_bytes(b'{"a": 1}\n{"a"')
    r = TailReader({"path": str(p)})
    zero = r.initialOffset()
    one = r.latestOffset()
    assert [json.loads(v) for s in r.partitions(zero, one) for _, v in r.read(s)] == [{"a": 1}]
    with p.open("ab") as f:
        f.write(b": 2}\n")
    two = r.latestOffset()
    assert [json.loads(v) for s in r.partitions(one, two) for _, v in r.read(s)] == [{"a": 2}]
    p.write_bytes(b'{"b": 1}\n{"b": 2}\n{"b": 3}\n')
    with pytest.raises(Replaced):
        r.latestOffset()


def test_tail_stream(spark, tmp_path):
    spark.dataSource.register(TailSource)
    p = tmp_path / "t.jsonl"
    p.write_text('{"a": 1}\n{"a": 2}\n')
    q = spark.readStream.format("jsonl_tail").option("path", str(p)).load().writeStream.format("memory").queryName("tailed").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(90)
    assert sorted(r.value for r in spark.table("tailed").collect()) == ['{"a": 1}', '{"a": 2}']


ROWS = [("p", 0, 2, "one ", True, False), ("p", 1, 2, "", False, True), ("q", 0, 2, "x", True, False), ("r", 0, 1, "  ", True, False)]
SCHEMA = "parent string, idx long, expected long, prediction string, meaningful boolean, incomplete boolean"


def run(spark, tmp_path, name, rows, schema, f, mode="update"):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    got = []
    q = f(spark.readStream.schema(schema).json(str(tmp_path / "in"))).writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / "c")).foreachBatch(lambda df, _: got.extend(df.collect())).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return got


def test_merge_stream(spark, tmp_path):
    got = run(spark, tmp_path, "m", ROWS, SCHEMA, merging.merge_stream)
    assert [tuple(r) for r in got] == [("p", "one", 2, True, False)]
    got = run(spark, tmp_path, "m", [("q", 1, 2, "y", True, False)], SCHEMA, merging.merge_stream)
    assert [tuple(r) for r in got] == [("q", "x\ny", 2, False, False)]


def test_loop_stop_latches(spark, tmp_path):
    block = "a b c d e "
    rows = [("k", 0, block), ("k", 1, block * 2), ("k", 2, "something else"), ("n", 0, "one two three four")]
    got = run(spark, tmp_path, "l", rows, "key string, seq long, chunk string", merging.stop_loops)
    assert {r.key: r.verdict for r in got} == {"k": "repeated_words", "n": None}


def test_recognizer(spark):
    pages = spark.createDataFrame([("1", "a.jpg", "page", 200, 0), ("2", "b.jpg", "page", 10, 0)], "id string, image string, task string, token_limit int, attempt long")
    got = {r.id: r.raw for r in recognizer.recognize(pages, recognizer.stub, "stub").collect()}
    assert got["1"].endswith("</HistoricalDocument>") and len(got["2"]) == 10


def test_loop_stop_has_all_detectors(spark, tmp_path):
    line = lambda n, w: f'<Line n="{n}">{" ".join(w)}</Line>\n'
    long, plain = [f"w{i}" for i in range(50)], " ".join(f"v{i}" for i in range(300))
    mutating = [f"the same sentence goes on and on and says number {i} of the same old story. " for i in range(12)]
    rows = [("lines", i, line(i, long)) for i in range(3)]
    rows += [("marked", i, line(i, ["One,", "two", "three;", "four"])) for i in range(3)]
    rows += [("within", 0, "A b c d e. " * 3 + plain), ("clean", 0, plain), ("clean", 1, None), ("novelty", 0, "".join(mutating[:2])), ("novelty", 1, "".join(mutating[2:]))]
    rows += [("split", i, x) for i, x in enumerate(["a b c d", "x e a b c ddx ", "q a b ", "c ddx e a b c ddx e a b c", " ddx e ", plain])]
    got = run(spark, tmp_path, "l", rows, "key string, seq long, chunk string", merging.stop_loops)
    assert {r.key: r.verdict for r in got} == {"lines": "repeated_lines", "marked": "repeated_words", "within": "repeated_words", "clean": None, "novelty": "low_novelty", "split": "repeated_words"}
    assert merging.first_loop("".join(line(i, long[:10]) for i in range(3))) == "repeated_lines"


def test_tail_is_cut_into_spans_and_flushed(tmp_path):
    p = tmp_path / "t.jsonl"
    lines = [json.dumps({"n": i, "x": "y" * (i % 40)}) for i in range(200)]
    p.write_text("\n".join(lines))
    r = TailReader({"path": str(p), "span": "500"})
    zero, end = r.initialOffset(), r.latestOffset()
    spans = r.partitions(zero, end)
    got = [v for s in spans for _, v in r.read(s)]
    assert len(spans) > 5 and got == lines[:-1]
    last = TailReader({"path": str(p), "final": "true"})
    assert [v for s in last.partitions(end, last.latestOffset()) for _, v in last.read(s)] == lines[-1:]
    copy = p.read_bytes()
    p.rename(tmp_path / "old")
    p.write_bytes(copy)
    with pytest.raises(Replaced):
        r.latestOffset()


def test_pages_are_taken_back(spark, tmp_path):
    f = lambda df: merging.merge_stream(df, revise=True)
    assert [tuple(r) for r in run(spark, tmp_path, "r", [("p", 0, 1, "x", True, False)], SCHEMA, f)] == [("p", "x", 1, False, False)]
    assert [tuple(r) for r in run(spark, tmp_path, "r", [("p", 0, 1, " ", True, False)], SCHEMA, f)] == [("p", None, 1, None, True)]


def test_wrong_predictions_end_the_stream(spark, tmp_path):
    for k, rows in enumerate(([("p", 0, 2, "x", True, False), ("p", 0, 2, "y", True, False)], [("p", 0, 2, "x", True, False), ("p", 1, 3, "y", True, False)], [("p", 2, 2, "x", True, False)])):
        with pytest.raises(Exception, match="page p"):
            run(spark, tmp_path / str(k), "w", rows, SCHEMA, merging.merge_stream)
    with pytest.raises(Exception, match="mixed configs"):
        run(spark, tmp_path / "c", "w", [("p", 0, 2, "x", True, False, "a"), ("p", 1, 2, "x", True, False, "b")], SCHEMA + ", config string", merging.merge_stream)


def test_watch_keeps_whole_versions(spark, tmp_path):
    put = lambda rows: spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    put([("p", 0, 1, "one", True, False), ("q", 0, 2, "x", True, False)])
    stream = lambda: merging.merge_stream(spark.readStream.schema(SCHEMA).json(str(tmp_path / "in")))
    args = (str(tmp_path / "snap"), str(tmp_path / "check"), str(tmp_path / "ready.json"))
    assert merging.watch(stream(), *args) == 1
    put([("q", 1, 2, "y", True, False)])
    (tmp_path / "done").write_text("")
    assert merging.watch(stream(), *args, done=str(tmp_path / "done"), expected=2) == 2
    ready = json.loads((tmp_path / "ready.json").read_text())
    assert {(r.parent, r.prediction) for r in spark.read.parquet(ready["version"]).collect()} == {("p", "one"), ("q", "x\ny")}
    with pytest.raises(RuntimeError, match="1 pages"):
        merging.watch(stream(), *args, done=str(tmp_path / "done"), expected=3)


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a/b", "one \n\n", "<x/>"), ("c", None, "y")], "id string, text string, xml string")
    assert jsonl.write_texts(rows, str(tmp_path / "t"), "id", "text", "xml", suffixes=(".txt", ".xml")) == 4
    assert {p.name: p.read_text() for p in (tmp_path / "t").iterdir()} == {"a_b.txt": "one \n\n".rstrip(" ") + "\n", "a_b.xml": "<x/>\n", "c.txt": "\n", "c.xml": "y\n"}
    jsonl.write_json({"a": 1, "é": None}, str(tmp_path / "s" / "x.json"))
    jsonl.write_json({"a": 2}, str(tmp_path / "s" / "x.json"))
    assert json.loads((tmp_path / "s" / "x.json").read_text()) == {"a": 2} and len(list((tmp_path / "s").iterdir())) == 1
    assert jsonl.read_object(spark, str(tmp_path / "s" / "x.json"), "a int") == {"a": 2}
    assert jsonl.read_object(spark, str(tmp_path / "none"), "a int") is None
    jsonl.write_lines(rows, str(tmp_path / "l"))
    jsonl.append_lines(rows, str(tmp_path / "l"))
    assert jsonl.scan_lenient(spark, str(tmp_path / "l"), "id string").count() == 4
    assert jsonl.scan_strict(spark, str(tmp_path / "none"), "a int").count() == 0
    with pytest.raises(ValueError, match="not an image"):
        jsonl.scan_images(spark, [str(tmp_path / "s" / "x.json")])


def test_copies_are_verified_and_pages_paired(spark, tmp_path):
    for folder in ("i", "t"):
        (tmp_path / folder).mkdir()
    for n in ("p1", "p2"):
        (tmp_path / "i" / f"{n}.jpg").write_bytes(n.encode())
    (tmp_path / "t" / "p1.txt").write_text("first page")
    pages = jsonl.page_files(spark, str(tmp_path / "t"), str(tmp_path / "i")).collect()
    assert [(r.id, r.target) for r in pages] == [("p1", "first page")]
    sums = jsonl.checksums(spark, str(tmp_path / "i")).collect()
    rows = [(r.path, str(tmp_path / "out" / f"{r.sha256}.jpg"), r.sha256) for r in sums]
    copied = lambda rows: {r.target: r.ok for r in jsonl.copy_verified(spark.createDataFrame(rows, "s string, t string, h string"), "s", "t", "h").collect()}
    assert copied(rows) == {t: True for _, t, _ in rows} and copied(rows) == {t: True for _, t, _ in rows}
    assert copied([(rows[0][0], str(tmp_path / "out" / "bad.jpg"), "0")]) == {str(tmp_path / "out" / "bad.jpg"): False}


def test_task_reports(tmp_path):
    now = [100.0]
    with tasks.Task("Read pages", total=10, task_id="a b", folder=str(tmp_path), clock=lambda: now[0]) as task:
        now[0] = 110.0
        task.update(4, "page 4", {"cer": 0.2})
        state = json.loads((tmp_path / "a-b.json").read_text())
        assert (state["percent"], state["eta_seconds"], state["status"], state["metrics"]) == (40.0, 15.0, "running", {"cer": 0.2})
    assert json.loads((tmp_path / "a-b.json").read_text())["status"] == "complete"
    with pytest.raises(KeyError), tasks.Task("x", folder=str(tmp_path), task_id="x"):
        raise KeyError("gone")
    state = json.loads((tmp_path / "x.json").read_text())
    assert state["status"] == "failed" and "gone" in state["message"] and tasks.alive(state["pid"])


def test_tracked_commands(tmp_path):
    code = 'import sys\nfor i in range(40): print("page", i, "/ 40")\nprint(\'{"loss": 0.5, "epoch": 2, "epochs": 4}\')\nsys.exit(int(sys.argv[1]))'
    for exit_code, status in ((0, "complete"), (3, "failed")):
        got, last = tasks.run_tracked([sys.executable, "-c", code, str(exit_code)], "job", str(tmp_path), f"j{exit_code}")
        state = json.loads((tmp_path / f"j{exit_code}.json").read_text())
        assert (got, len(last), state["status"], state["total"], state["metrics"]) == (exit_code, 30, status, 4.0, {"loss": 0.5})
    assert [tasks.read_line(x) for x in ("epoch 2/5", "x 7 of 9", "items: 7 of 9", "50.5 % done", "[1]", "1.2.3/4")] == [(2.0, 5.0), None, (7.0, 9.0), (50.0, 100.0), None, None]


def test_lines_are_numbered_across_splits(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.jsonl").write_text("".join(json.dumps({"n": f"{name}{i}", "x": "y" * (i % 50)}) + ("\r\n" if i % 3 else "\n") for i in range(3000)) + ("[1]\n" if name == "b" else '{"last": 1}'))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = {(r.file.rsplit("/", 1)[1], r.pos): r.value for r in jsonl.numbered(spark, str(tmp_path)).collect()}
        assert len(got) == 6002 and all(json.loads(got[f"{f}.jsonl", i + 1])["n"] == f"{f}{i}" for f in "ab" for i in range(3000))
        assert [(r.pos, r.problem) for r in jsonl.violations(spark, str(tmp_path)).collect()] == [(3001, "not an object")]
        assert sorted(r.value[:9] for r in jsonl.last_records(spark, str(tmp_path)).collect()) == ['{"last": ', '{"n": "b2']
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
