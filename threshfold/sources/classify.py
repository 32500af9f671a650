"""Stance by an external classifier, as an interface: the service is a function that is passed in.

Without one the lexical floor is used, and only where that is asked for by name."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threshfold.functions.text import lexical_stance, mark_span

LABELS = ("bullish", "bearish", "neutral", "question")


def salvage(raw: str) -> tuple[str, float]:
    """Label and confidence from an answer that holds a JSON object somewhere; neutral and 0 if not."""
    try:
        got = json.loads(raw[raw.index("{") : raw.rindex("}") + 1])
        label, conf = got.get("stance", "neutral"), float(got.get("confidence", 0.5))
    except (ValueError, TypeError, AttributeError):
        return "neutral", 0.0
    return (label if label in LABELS else "neutral"), min(1.0, max(0.0, conf))


def classify(mentions: DataFrame, docs: DataFrame, service: Callable[[list[str]], list[str]] | None = None, lexical: bool = False, limit: int | None = None) -> DataFrame:
    """``doc_id, entity_id, ticker, stance, stance_confidence, method`` of mentions in ``docs`` (``doc_id, text``).
    With ``limit`` only so many mentions with a text are asked about, by document and place."""
    if service is None and not lexical:
        raise ValueError("no classifier given; ask for lexical=True to get the floor")
    m = mentions.join(docs.select("doc_id", "text"), "doc_id").withColumn("marked", mark_span(F.col("text"), F.col("span_start"), F.col("span_end")))
    if limit is not None:
        m = m.where("text <> ''").orderBy("doc_id", "span_start", "entity_id").limit(limit)
    if service is None:
        return m.select("doc_id", "entity_id", "ticker", lexical_stance(F.col("text")).alias("s"), F.lit("lexical").alias("method")).select("doc_id", "entity_id", "ticker", "s.*", "method")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [salvage(x) for x in service(b["marked"].tolist())]
            out = b[["doc_id", "entity_id", "ticker"]].copy()
            out["stance"], out["stance_confidence"], out["method"] = [s for s, _ in got], [c for _, c in got], "service"
            yield out

    return m.select("doc_id", "entity_id", "ticker", "marked").mapInPandas(run, "doc_id string, entity_id string, ticker string, stance string, stance_confidence double, method string")
