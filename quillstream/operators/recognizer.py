"""The seam for recognisers: a batch function that Spark runs over pages; no model is part of it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: Takes a batch with id, image, task, token_limit and attempt; returns one text per row.
Recognizer = Callable[[pd.DataFrame], list[str]]
OUT = "id string, attempt bigint, raw string, model string"


def recognize(pages: DataFrame, load: Callable[[], Recognizer], model: str) -> DataFrame:
    """Run a recogniser that ``load`` makes once per task, when the first batch arrives."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = None
        for part in parts:
            f = f or load()
            texts = f(part)
            if len(texts) != len(part):
                raise ValueError("a recogniser must return one text per row")
            yield pd.DataFrame({"id": part["id"], "attempt": part["attempt"], "raw": texts, "model": model})

    return pages.select("id", "image", "task", "token_limit", "attempt").mapInPandas(run, OUT)


def stub() -> Recognizer:
    """A deterministic stand-in for tests: the image's name between page tags, cut to the limit."""
    return lambda b: [f"<HistoricalDocument><Page>{i} {a}</Page></HistoricalDocument>"[: int(n)] for i, a, n in zip(b["image"], b["attempt"], b["token_limit"], strict=True)]
