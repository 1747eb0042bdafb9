"""Sinks. Spark's commit protocol takes the place of lock files: a failed write
leaves nothing behind and is raised, not swallowed."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, functions as F

from .readers import LINE_ORDER


def write_vocab(vocab: DataFrame, path: str) -> None:
    """(token, id). A path ending in `.json` gets one object sorted by token, an entry a line: one
    file, written line by line, so no row holds more than an entry."""
    if path.endswith(".json"):
        key = F.regexp_extract(F.to_json(F.struct(F.col("token").alias("t"))), r"(?s)^\{\"t\":(.*)\}$", 1)
        comma = F.when(F.col("token") == vocab.agg(F.min("token")).scalar(), "").otherwise(",")
        entries = vocab.select(F.lit(1).alias("part"), "token", F.concat(comma, key, F.lit(":"), "id").alias("value"))
        ends = vocab.sparkSession.createDataFrame([(0, "", "{"), (2, "", "}")], "part int, token string, value string")
        lines = entries.unionByName(ends).repartition(1).sortWithinPartitions("part", "token")
        lines.select("value").write.mode("overwrite").text(path)
    else:
        vocab.write.mode("overwrite").parquet(path)


def write_remap(remap: DataFrame, path: str) -> None:
    remap.select("token", "rank", "code").write.mode("overwrite").parquet(path)


def append_results(results: DataFrame, path: str, as_csv: bool = False) -> None:
    """Append result rows, columns sorted by name."""
    rows = results.select(*sorted(results.columns))
    if as_csv:
        rows.write.mode("append").option("header", True).csv(path)
    else:
        rows.write.mode("append").parquet(path)


def append_new(results: DataFrame, path: str, keys: list[str]) -> None:
    """Append the rows whose `keys` (never null) the table does not hold yet, one for each; columns sorted
    by name. A job that is run again adds nothing: its rows are there already, or, if it failed before
    Spark's commit, none of them is."""
    spark = results.sparkSession
    fresh = results.select(*sorted(results.columns)).dropDuplicates(keys)
    try:
        fresh = fresh.join(spark.read.parquet(path).select(*keys), keys, "left_anti").select(*fresh.columns)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    fresh.write.mode("append").parquet(path)


def write_wide(wide: DataFrame, path: str, key: str = "step") -> None:
    """Wide CSV sorted by step, empty cell for a missing value."""
    wide.orderBy(key).write.mode("overwrite").option("header", True).option("nullValue", "").csv(path)


def write_split(rows: DataFrame, path: str, text: str = "text") -> None:
    """Text lines in one folder per split."""
    rows.select(F.col(text).alias("value"), "split").write.mode("overwrite").partitionBy(
        "split"
    ).text(path)


def write_code_dict(lines: DataFrame, path: str, value: str = "value") -> None:
    """Dictionary lines back to text, in their order."""
    lines.orderBy(*LINE_ORDER).select(value).write.mode("overwrite").text(path)


def write_eval_log(logs: DataFrame, path: str) -> None:
    """(run, step, value) as `step,value` lines, one folder per run."""
    logs.select("run", "step", "value").sortWithinPartitions("run", "step").write.mode(
        "overwrite"
    ).partitionBy("run").csv(path)
