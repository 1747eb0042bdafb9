"""Scans. Schemas are given, so no pass over the data is spent on guessing them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.codes import parse_code_dict
from ..operators.tasks import task_fields, task_table

TOKENIZER_FIELDS = """name string, max_vocab_size string, max_examples string,
    special_tokens map<string,string>, tokenizer_files_dir string, vocab_file_name string,
    input_method string, sp_path string"""
MODEL_FIELDS = """n_positions int, n_ctx int, n_embd int, n_layer int, n_head int,
    activation_function string"""
TRAINING_FIELDS = """eval_steps int, max_steps int, batch_size int, learning_rate double,
    weight_decay double, warmup_steps int, max_grad_norm double"""
CONFIG_SCHEMA = (
    f"tokenizer struct<{TOKENIZER_FIELDS}>, model struct<{MODEL_FIELDS}>, "
    f"training struct<{TRAINING_FIELDS}>"
)
LINE_ORDER = ["file", "block", "line_no"]


def read_corpus(spark: SparkSession, path: str, text_col: str = "text",
                order_col: str = "doc_id", extra: list[str] = ()) -> DataFrame:
    """Documents as (order, text, extra...); only these columns are read."""
    return spark.read.parquet(path).select(order_col, text_col, *extra)


def spread_small(df: DataFrame, key: str) -> DataFrame:
    """Rows of a table with fewer splits than cores, spread over the cores by key.

    Work on texts is bound by the processor, and a small file is one split. A table
    with at least as many splits as cores is returned as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def read_lines(spark: SparkSession, path: str, keep_newline: bool = False) -> DataFrame:
    """(value, file, block, line_no): one document per line.

    The last three give the order of the lines; line numbers grow inside a file
    block, they are not consecutive. `keep_newline` puts the line end back.
    """
    lines = spark.read.text(path)
    value = F.concat("value", F.lit("\n")) if keep_newline else F.col("value")
    return lines.select(
        value.alias("value"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line_no"),
    )


def _decoded(name: Column) -> Column:
    """A percent-encoded name; unlike in form data, a plus sign stands for itself."""
    return F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))


def read_eval_logs(spark: SparkSession, pattern: str) -> DataFrame:
    """(run, step, value, file, block, line_no) of `step,value` files; the run is the name of the
    directory that holds the file. Directories without a log give no rows. The last three give
    the order of a run's lines, over its files by name and over the blocks of a file."""
    logs = spark.read.schema("step bigint, value double").csv(pattern)
    folder = _decoded(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+\z", 1))
    # A partition folder `run=<name>` carries the name in its own escaped form.
    name = F.when(
        folder.startswith("run="), _decoded(F.regexp_replace(folder, r"\Arun=", ""))
    ).otherwise(folder)
    return logs.select(
        name.alias("run"), "step", "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line_no"),
    )


def read_wide(spark: SparkSession, path: str, columns: list[str], key: str = "step") -> DataFrame:
    """A compiled wide CSV with a known set of columns; empty cells are null."""
    schema = ", ".join([f"`{key}` bigint", *[f"`{c}` double" for c in columns]])
    return spark.read.option("header", True).schema(schema).csv(path)


def read_configs(spark: SparkSession, pattern: str, one_per_file: bool = True) -> DataFrame:
    """Run configurations with their directory as `run`. `max_*` may be a number or
    an empty string; both empty and missing become null."""
    rows = spark.read.schema(CONFIG_SCHEMA).option("multiLine", one_per_file).json(pattern)
    tokenizer = F.col("tokenizer")
    for name in ("max_vocab_size", "max_examples"):
        tokenizer = tokenizer.withField(name, F.col(f"tokenizer.{name}").try_cast("bigint"))
    run = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+\z", 1)
    return rows.select(run.alias("run"), tokenizer.alias("tokenizer"), "model", "training")


def read_code_dict(spark: SparkSession, path: str) -> DataFrame:
    """(ch, code) of a tab-separated dictionary with a header up to `...`."""
    return parse_code_dict(read_lines(spark, path), LINE_ORDER)


def read_task(spark: SparkSession, path: str, task: str, split: str) -> DataFrame:
    """Labelled rows of one task and split, with the task's kind and classes.

    The table is partitioned by (task, split), so other parts are not read.
    """
    task_fields(task)
    rows = spark.read.parquet(path).where((F.col("task") == task) & (F.col("split") == split))
    return rows.join(F.broadcast(task_table(spark).where(F.col("task") == task)), "task")


def read_vocab(spark: SparkSession, path: str) -> DataFrame:
    """(token, id) written as a table, or as one JSON object per file."""
    if path.endswith(".json"):
        rows = spark.read.text(path, wholetext=True).select(
            F.explode(F.from_json("value", "map<string,bigint>")).alias("token", "id")
        )
        return rows
    return spark.read.parquet(path)


def read_remap(spark: SparkSession, path: str) -> DataFrame:
    """(token, rank, code)."""
    return spark.read.parquet(path)
