"""Region predictions merged into pages as they arrive; loop stops over chunks of text."""

from __future__ import annotations

import json
import os
import re
import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.jsonl import write_json

_TAG, _OTHER, _WORD = re.compile(r"<[^>]+>"), re.compile(r"[^\w']+"), re.compile(r"[\w']+")
_LINE = re.compile(r"<Line(?:\s+[^>]*)?>(.*?)</Line>", re.I | re.S)
OUT = "parent string, prediction string, regions bigint, incomplete boolean, retracted boolean"


class PageState(StatefulProcessor):
    """A page's regions by index; the page is given out whenever it becomes or stays complete, and taken
    back (``retracted``) if a later prediction makes it incomplete again.

    A prediction for an index that is there already replaces an equal one; another one is an error
    unless ``revise``, and so are mixed numbers of regions and mixed configs: a replayed batch changes
    nothing and a second opinion doesn't pass unseen.
    """

    def __init__(self, revise: bool = False, config: str | None = None) -> None:
        self.revise, self.wanted = revise, config

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.regions = handle.getMapState("regions", "idx bigint", "prediction string, meaningful boolean, incomplete boolean")
        self.expected = handle.getValueState("expected", "n bigint, config string, out boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer: object) -> Iterator[pd.DataFrame]:  # noqa: N802
        n, config, out = self.expected.get() if self.expected.exists() else (None, self.wanted, False)
        for part in rows:
            for r in part.itertuples(index=False):
                value, at = (r.prediction, bool(r.meaningful), bool(r.incomplete)), (int(r.idx),)
                if not self.revise and self.regions.containsKey(at) and tuple(self.regions.getValue(at)) != value:
                    raise ValueError(f"page {key[0]}: another prediction for region {at[0]}")
                if n is not None and n != int(r.expected):
                    raise ValueError(f"page {key[0]}: mixed numbers of regions")
                if not 0 <= at[0] < int(r.expected):
                    raise ValueError(f"page {key[0]}: unexpected region {at[0]}")
                own = getattr(r, "config", None)
                if config is not None and own is not None and own != config:
                    raise ValueError(f"page {key[0]}: mixed configs")
                self.regions.updateValue(at, value)
                n, config = int(r.expected), config or own
        got = {k[0]: tuple(v) for k, v in self.regions.iterator()}
        texts = [(got[k][0] or "").strip() for k in sorted(got)]
        lacks = any(m and not t for t, (_, m, _) in zip(texts, (got[k] for k in sorted(got)), strict=True))
        whole = len(got) == n and not lacks
        self.expected.update((n, config, whole))
        if whole or out:
            text, incomplete = ("\n".join(t for t in texts if t), any(v[2] for v in got.values())) if whole else (None, None)
            yield pd.DataFrame({"parent": [key[0]], "prediction": [text], "regions": [len(got)], "incomplete": [incomplete], "retracted": [not whole]})

    def close(self) -> None:
        """No resources of its own."""


def merge_stream(predictions: DataFrame, revise: bool = False, config: str | None = None) -> DataFrame:
    """Complete pages from a stream of (parent, idx, expected, prediction, meaningful, incomplete[, config]).

    State is keyed by page and lives in the RocksDB state store; a page's state is its own regions.
    """
    return predictions.groupBy("parent").transformWithStateInPandas(PageState(revise, config), OUT, "Update", "None")


def watch(merged: DataFrame, snapshot: str, checkpoint: str, ready: str | None = None, done: str | None = None, expected: int | None = None, every: str | None = None) -> int:
    """Keep the table ``snapshot`` (Parquet, a folder per version) at the pages that merge_stream() has given out.

    Each batch with a change writes a new version and then points ``ready`` (a JSON file) to it, so a
    reader sees whole versions alone. ``every`` is the interval of the polls; without it what is there
    is drained once. With ``done``, a file that the producer writes last, polls end when it is there
    and all is drained; if fewer than ``expected`` pages are complete then, that is an error. Returns
    the number of complete pages.
    """
    spark, state = merged.sparkSession, {"version": None, "pages": 0}

    def keep(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        path = f"{snapshot}/v{number}"
        new = batch.drop("retracted").where(~F.col("retracted"))
        if state["version"]:
            old = spark.read.parquet(state["version"]).join(batch.select("parent"), "parent", "left_anti")
            new = old.unionByName(new)
        new.write.mode("overwrite").parquet(path)
        state["version"], state["pages"] = path, spark.read.parquet(path).count()
        if ready:
            write_json({"version": path, "pages": state["pages"]}, ready)

    def drain() -> None:
        before = state["version"]
        if before is None and ready and (last := _pointed(ready)):
            state["version"], state["pages"] = last["version"], last["pages"]
        q = merged.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(keep).trigger(availableNow=True).start()
        q.awaitTermination()

    seconds = float(every.split()[0]) if every else 0.0
    while True:
        finished = done is None or os.path.exists(done)
        drain()
        if finished or not every:
            break
        time.sleep(seconds)
    if done is not None and finished and expected is not None and state["pages"] < expected:
        raise RuntimeError(f"{expected - state['pages']} pages are incomplete though all predictions are there")
    return state["pages"]


def _pointed(ready: str) -> dict | None:
    try:
        with open(ready, encoding="utf-8") as f:
            return json.load(f)
    except (OSError, ValueError):
        return None


class LoopStop(StatefulProcessor):
    """Chunks of generated text per key; the first verdict of the loop detectors latches.

    All three detectors look at every word of a chunk, so a loop that ends within it counts too.

    The state is the last 16,384 characters and the verdict, whatever the length of the text.
    """

    TAIL = 16_384

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("tail", "tail string, verdict string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer: object) -> Iterator[pd.DataFrame]:  # noqa: N802
        tail, verdict = self.state.get() if self.state.exists() else ("", None)
        chunks = pd.concat(list(rows)).sort_values("seq")
        for chunk in chunks["chunk"]:
            if verdict is None:
                text = tail + (chunk or "")
                verdict = first_loop(text, len(tail))
                tail = text[-self.TAIL :]
        self.state.update((tail, verdict))
        yield pd.DataFrame({"key": [key[0]], "verdict": [verdict]})

    def close(self) -> None:
        """No resources of its own."""


def _words(text: str) -> list[str]:
    return _OTHER.sub(" ", text.casefold()).split()


def _thrice(a: list, n: int) -> bool:
    return a[-n:] == a[-2 * n : -n] == a[-3 * n : -2 * n]


def first_loop(text: str, seen: int = 0) -> str | None:
    """The verdict at the first word, with the markup after it, that goes beyond the first ``seen``
    characters and where a detector fires: repeated_lines, repeated_words or low_novelty, in this order.

    Words and detectors are those of functions.text.loop_verdict: tags out, folded; up to four lines
    of eight words or more, or 4 to 40 words, that stand three times; 64 words that hardly bring anything new.
    """
    plain = _TAG.sub(lambda m: " " * len(m[0]), text)
    found = [(m.start(), w) for m in _WORD.finditer(plain) for w in _words(m[0])]
    w, ends = [x for _, x in found], [at for at, _ in found[1:]] + [len(text)]
    lines = [(m.end(), x) for m in _LINE.finditer(text) if (x := " ".join(_words(m[1])))]
    have: list[str] = []
    for i, end in enumerate(ends[: len(w)]):
        new = False
        while len(have) < len(lines) and lines[len(have)][0] <= end:
            new = lines[len(have)][0] > seen
            have.append(lines[len(have)][1])
        if end <= seen:
            continue
        if new and any(_thrice(have, n) and len(" ".join(have[-n:]).split()) >= 8 for n in range(1, min(4, len(have) // 3) + 1)):
            return "repeated_lines"
        last = w[max(0, i - 119) : i + 1]
        if any(last[-1] == last[-1 - n] and _thrice(last, n) for n in range(4, min(40, len(last) // 3) + 1)):
            return "repeated_words"
        tail = last[-64:]
        if len(tail) == 64 and len(set(tail)) / 64 <= 0.60 and 1 - len(set(zip(tail, tail[1:], tail[2:], tail[3:]))) / 61 >= 0.30:  # noqa: B905
            return "low_novelty"
    return None


def stop_loops(chunks: DataFrame) -> DataFrame:
    """(key, verdict) from a stream of (key, seq, chunk)."""
    return chunks.groupBy("key").transformWithStateInPandas(LoopStop(), "key string, verdict string", "Update", "None")
