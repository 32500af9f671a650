"""The study from texts to write-up: stages in order, each written, gates that stop it, and a restart that goes on
where it stopped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from threshfold.operators.review import GateError
from threshfold.plans.study_queries import QUERIES
from threshfold.sources.files import existing, report

Query = Callable[[SparkSession, str], DataFrame]

#: Stage, and the column of its single row that must be true for the study to go on.
STAGES: tuple[tuple[str, str | None], ...] = (
    ("capture_lag", None), ("extracted_mentions", None), ("precision_recall", "passes"), ("funnel_by_period", None), ("mention_panel", None), ("matched_cohort", None), ("fetch_plan", None),
    ("quality_gate", "usable"), ("outcome_labels", None), ("group_outcomes", None), ("post_stratified_lift", None), ("trimmed_support", None), ("common_support", None), ("bootstrap_ci", None), ("recall_by_class", None), ("dose_response_fine", None), ("portfolio_weighted", None), ("novelty_shares", None),
    ("novelty_in_index", None), ("timing_summary", None), ("factor_alpha", None), ("rank_analysis", None), ("rank_intervals", None), ("exchange_mix", None), ("companies_table", None),
)
#: What the write-up shows, with the heading of each part.
SECTIONS = {
    "precision_recall": "Extraction", "funnel_by_period": "How wide the net is", "post_stratified_lift": "Lift against controls of like size", "group_outcomes": "The groups as a whole", "trimmed_support": "Names without controls of their size", "common_support": "Lift on common support", "bootstrap_ci": "Intervals", "exchange_mix": "Where the names are listed", "recall_by_class": "Who was mentioned",
    "dose_response_fine": "More authors", "portfolio_weighted": "As a portfolio", "novelty_shares": "How novel the names are", "novelty_in_index": "How many were in an index", "timing_summary": "When they were mentioned",
    "factor_alpha": "Against factors", "rank_analysis": "Rank against membership", "rank_intervals": "Intervals of ranks",
}


def run(spark: SparkSession, d: str, out: str, stages: tuple[tuple[str, str | None], ...] = STAGES, queries: dict[str, Query] | None = None, allow: frozenset[str] = frozenset()) -> list[str]:
    """Run the stages over the tables in ``d`` and write each as a folder of ``out`` (a shared folder), then
    ``writeup``. A stage that is there is not run again. A gate that says no raises :class:`GateError` unless it is in
    ``allow``; what was written stays, so a later run goes on from there. Returns the stages that were run now."""
    queries = queries or QUERIES
    done = []
    for name, gate in stages:
        path = f"{out.rstrip('/')}/{name}"
        if not existing(spark, [f"{path}/_SUCCESS"]):
            queries[name](spark, d).write.mode("overwrite").parquet(path)
            done.append(name)
        if gate is not None and name not in allow:
            row = spark.read.parquet(path).first()
            if row is None or not row[gate]:
                raise GateError(f"stopped at {name}: {row.asDict() if row else 'no row'}")
    text = writeup({n: spark.read.parquet(f"{out.rstrip('/')}/{n}") for n, _ in stages if n in SECTIONS})
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{out.rstrip('/')}/writeup")
    return done


def writeup(results: dict[str, DataFrame]) -> str:
    """A Markdown document of the results that are there, one part each, with what their verdicts and gates say."""
    parts = ["# Mention study"]
    for name, title in SECTIONS.items():
        if name not in results:
            continue
        df = results[name]
        body = report(df, title).replace("# ", "## ", 1)
        if df.isEmpty():
            body += "\nToo few names for this part.\n"
        if "verdict" in df.columns:
            body += "".join(f"\n* {v}: {n}" for v, n in sorted((str(r["verdict"]), r["count"]) for r in df.groupBy("verdict").count().collect())) + "\n"
        parts.append(body)
    return "\n\n".join(parts) + "\n"
