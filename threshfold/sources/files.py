"""File sources and sinks: newline JSON, separated text, price folders, factor files, zip archives, reports."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

POSTS = "id string, created_utc long, retrieved_on long, author string, title string, selftext string, score int, num_comments int, removed_by_category string, _corrupt_record string"
COMMENTS = "id string, created_utc long, retrieved_on long, author string, body string, link_id string, score int, removed_by_category string, _corrupt_record string"
MENTIONS = (
    "doc_id string, doc_type string, created_utc long, author string, link_id string, score int, entity_id string, ticker string, channel string, confidence double, "
    "span_start int, span_end int, evidence array<string>, in_title boolean, is_primary boolean, n_entities_in_doc int"
)
PRICES = "date date, adj_close double, close double, volume double"


def existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """The paths that are there, on whatever file system they name."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    out = []
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        if at.getFileSystem(conf).globStatus(at):
            out.append(p)
    return out


def read_ndjson(spark: SparkSession, paths: str | list[str], schema: str, min_confidence: float | None = None) -> DataFrame:
    """Newline JSON with a fixed schema. Missing files are skipped, broken lines come out in
    ``_corrupt_record`` where the schema has it, identifiers that are numbers are read as text. A confidence floor is inclusive."""
    there = existing(spark, [paths] if isinstance(paths, str) else list(paths))
    df = spark.read.schema(schema).json(there) if there else spark.createDataFrame([], schema)
    return df if min_confidence is None else df.where(F.col("confidence") >= min_confidence)


def write_ndjson(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_csv(spark: SparkSession, path: str, schema: str | None = None, sep: str = ",") -> DataFrame:
    """Separated text with a header; columns are matched by name, missing ones are null, values are text without a schema."""
    raw = spark.read.option("header", True).option("sep", sep).option("multiLine", sep == ",").csv(path)
    if schema is None:
        return raw
    kinds = T.StructType.fromDDL(schema)
    return raw.select(*[(F.col(f.name).try_cast(f.dataType) if f.name in raw.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in kinds])


def write_csv(df: DataFrame, path: str, columns: list[str], sep: str = ",", order: list[Column | str] | None = None) -> None:
    """A fixed column list with header as one file; for reports, whose rows are few."""
    out = df.orderBy(*order) if order else df
    out.select(*columns).coalesce(1).write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, year, gold_tickers array, notes`` of a label sheet; rows with neither gold nor notes
    are unlabelled and dropped. A missing ``text`` column and carriage returns are tolerated."""
    raw = read_csv(spark, path, "doc_id string, year int, gold_tickers string, notes string", sep="\t")
    tidy = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), "\\r", ""))
    raw = raw.withColumns({"gold_tickers": tidy("gold_tickers"), "notes": tidy("notes")})
    raw = raw.where((F.col("gold_tickers") != "") | (F.col("notes") != ""))
    parts = F.filter(F.transform(F.split(F.upper("gold_tickers"), ","), lambda x: F.trim(x)), lambda x: x != "")
    return raw.withColumn("gold_tickers", parts)


def write_label_sheet(df: DataFrame, path: str) -> None:
    """``doc_id, year, text`` as a sheet to fill in: tabs and returns as blanks, newlines as a sign, cut at 4,000."""
    from threshfold.operators.review import flat_label_text

    empty = F.lit("").cast("string")
    write_csv(df.select("doc_id", "year", empty.alias("gold_tickers"), empty.alias("notes"), flat_label_text(F.col("text")).alias("text")), path, ["doc_id", "year", "gold_tickers", "notes", "text"], "\t")


def read_json_document(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    r = spark.read.option("multiLine", True)
    return (r.schema(schema) if schema else r).json(path)


def write_json_document(df: DataFrame, path: str) -> None:
    df.coalesce(1).select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def price_rows(spark: SparkSession, folder: str) -> DataFrame:
    """``symbol, date, adj_close, close, volume`` of a folder with one JSON array per symbol, named by it.

    Rows without adjusted close are dropped."""
    raw = spark.read.schema(PRICES).option("multiLine", True).json(f"{folder.rstrip('/')}/*.json")
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1)
    return raw.where("adj_close is not null").select(name.alias("symbol"), "date", "adj_close", "close", "volume")


def read_price_folder(spark: SparkSession, folder: str) -> DataFrame:
    """``symbol, date, adj_close, dollar_volume`` of such a folder; null close and volume count as 0."""
    zero = F.lit(0.0)
    return price_rows(spark, folder).select("symbol", "date", "adj_close", (F.coalesce("close", zero) * F.coalesce("volume", zero)).alias("dollar_volume"))


def read_zipped(spark: SparkSession, path: str, member: str = "") -> DataFrame:
    """``archive, name, line_no, line`` of the text files in zip archives (whose name contains ``member``)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io
        import zipfile

        for b in batches:
            for p, content in zip(b["path"], b["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for n in z.namelist():
                        if member in n:
                            lines = z.read(n).decode("utf-8-sig", "replace").splitlines()
                            yield pd.DataFrame({"archive": p, "name": n, "line_no": range(len(lines)), "line": lines})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "archive string, name string, line_no long, line string")


def parse_factors(lines: DataFrame, file: str = "name", no: str = "line_no", line: str = "line") -> DataFrame:
    """``month, factor, value`` of factor files: a preamble, a header whose first field is empty,
    monthly rows (six digits) in percent, then other sections that are left out. The section ends at
    the first line after the header whose first field is no month."""
    from pyspark.sql import Window as W

    parts = F.transform(F.split(line, ","), lambda x: F.trim(x))
    d = lines.select(F.col(file).alias("f"), F.col(no).alias("no"), parts.alias("p"))
    head = d.where((F.size("p") > 1) & (F.element_at("p", 1) == "")).groupBy("f").agg(F.min_by("p", "no").alias("h"), F.min("no").alias("h_no"))
    body = d.join(head, "f").where(F.col("no") > F.col("h_no"))
    month = F.element_at("p", 1).rlike(r"^\d{6}$")
    # one file is a few thousand lines
    body = body.withColumn("ended", F.max(F.when(~month, 1).otherwise(0)).over(W.partitionBy("f").orderBy("no"))).where(month & (F.col("ended") == 0))
    wide = body.select(F.element_at("p", 1).alias("m"), F.arrays_zip(F.slice("h", 2, 99).alias("factor"), F.slice("p", 2, 99).alias("value")).alias("z"))
    out = wide.select("m", F.inline("z"))
    value = F.col("value").try_cast("double")
    return out.where(value.isNotNull() & (F.col("factor") != "")).select(F.concat(F.substring("m", 1, 4), F.lit("-"), F.substring("m", 5, 2)).alias("month"), "factor", (value / 100).alias("value"))


def factor_table(base: DataFrame, *more: DataFrame) -> DataFrame:
    """``month`` and a column per factor: the months of ``base`` (rows of :func:`parse_factors`), with the factors of
    other files (momentum) where they have the month, null elsewhere. Factor names are few, a column each; a
    factor that several files tell comes from the first."""
    def wide(df: DataFrame, taken: list[str]) -> DataFrame:
        w = df.groupBy("month").pivot("factor").agg(F.first("value"))
        return w.select("month", *[F.col(f"`{c}`") for c in w.columns if c != "month" and c not in taken])

    out = wide(base, [])
    for m in more:
        out = out.join(wide(m, out.columns), "month", "left")
    return out


def registry_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a registry document ``{"fields": [...], "data": [[...], ...]}``; every value as text."""
    doc = spark.read.schema("fields array<string>, data array<array<string>>").option("multiLine", True).json(path)
    fields = doc.select("fields").first()["fields"]  # column names
    return doc.select(F.explode("data").alias("r")).select(*[F.get("r", F.lit(i)).alias(n) for i, n in enumerate(fields)])


def html_table(spark: SparkSession, path: str, css_class: str = "wikitable") -> DataFrame:
    """``row_no, cells`` of the first table of a class in HTML files; symbols keep their sign ``-`` for ``.``."""
    from threshfold.functions.text import table_rows

    page = spark.read.text(path, wholetext=True)
    return page.select(F.posexplode(table_rows(F.col("value"), css_class)).alias("row_no", "cells"))


#: Rows of a report, which are read by the driver.
MOST_ROWS = 100_000


def _all_rows(results: DataFrame) -> list:
    rows = results.limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"a report of more than {MOST_ROWS} rows")
    return rows


def report(results: DataFrame, title: str) -> str:
    """A Markdown table of a small result; one of more than MOST_ROWS rows is refused."""
    rows = _all_rows(results)
    show = lambda v: "" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v)
    head = f"# {title}\n\n| {' | '.join(results.columns)} |\n|{'---|' * len(results.columns)}\n"
    return head + "".join(f"| {' | '.join(show(v) for v in r)} |\n" for r in rows)


def results_json(results: DataFrame, keys: list[str]) -> str:
    """Tidy results (at most MOST_ROWS rows, more are refused) as nested JSON; values that are no numbers in JSON come out as null."""
    tree: dict = {}
    for r in _all_rows(results):
        at = tree
        for k in keys[:-1]:
            at = at.setdefault(str(r[k]), {})
        at[str(r[keys[-1]])] = {c: (None if isinstance(r[c], float) and r[c] != r[c] else r[c]) for c in results.columns if c not in keys}
    return json.dumps(tree, default=str, indent=1)
