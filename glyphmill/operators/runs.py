"""Evaluation logs of many runs: gather, compare, rank."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import text as T
from ..session import materialize
from .ordering import bucket_of, key_bounds, ordered_index, running

# Runs left out of comparisons, and name replacements in order.
EXCLUDED_RUNS = ("testing", "model_trial1")
RENAMES = [
    ("experiments/", ""),
    ("subword-bpe", "character-bpe"),
    ("repacked-subword", "repacked-character-bpe"),
]
# The family of each run.
FAMILIES = {
    "character": "Basic (No BPE)",
    "byte": "Basic (No BPE)",
    "character-bpe": "Basic (BPE)",
    "byte-bpe": "Basic (BPE)",
    "pinyin-above-bpe": "Chinese BPE",
    "pinyin-after-bpe": "Chinese BPE",
    "zhuyin-bpe": "Chinese BPE",
    "cangjie-bpe": "Chinese BPE",
    "cangjie-component": "Chinese BPE",
    "wubi-bpe": "Chinese BPE",
    "wubi-component": "Chinese BPE",
    "repacked-character-bpe": "Repacked",
    "repacked-cangjie": "Repacked",
    "repacked-cangjie-component": "Repacked",
    "repacked-pinyin-above": "Repacked",
    "repacked-pinyin-after": "Repacked",
    "repacked-wubi": "Repacked",
    "repacked-wubi-component": "Repacked",
    "repacked-zhuyin": "Repacked",
}
# Parameter classes by name part, first match wins.
PARAMETER_CLASSES = [
    ("wte", "Word Embeddings"),
    ("wpe", "Position Embeddings"),
    ("ln", "Layer Normalization"),
    ("mlp", "Feed-Forward Network"),
    ("c_fc", "Feed-Forward Network"),
    ("c_proj", "Feed-Forward Network"),
    ("attn", "Self-Attention"),
    ("lm_head", "Final Output Layer"),
]
TOTAL_LABEL = "Total parameter count"


def exclude_runs(logs: DataFrame, names: Sequence[str] = EXCLUDED_RUNS, run: str = "run") -> DataFrame:
    return logs.where(~F.col(run).isin(*names))


def family_table(spark: SparkSession, families: dict[str, str] = FAMILIES) -> DataFrame:
    return spark.createDataFrame(list(families.items()), "run string, family string")


def attach_category(logs: DataFrame, families: DataFrame, run: str = "run",
                    strict: bool = True) -> DataFrame:
    """Add `family`; a run without one raises when the row is read, or stays null."""
    table = families.select(F.col("run").alias("_run"), F.col("family"))
    out = logs.join(table, F.col(run) == F.col("_run"), "left").drop("_run")
    if strict:
        problem = F.concat(F.lit("run without a family: "), F.col(run))
        out = out.withColumn("family", F.coalesce("family", F.raise_error(problem).cast("string")))
    return out


def unknown_runs(logs: DataFrame, families: DataFrame, run: str = "run") -> DataFrame:
    """Names of runs that have no family."""
    table = families.select(F.col("run").alias(run))
    return logs.select(run).distinct().join(table, run, "left_anti")


def line_order(logs: DataFrame, order: str = "line_no") -> Column:
    """The place of a line: its number, after the file and block it was read from, if these are given."""
    return F.struct(*[c for c in ("file", "block") if c in logs.columns], order)


def last_per_step(logs: DataFrame, order: str = "line_no") -> DataFrame:
    """(run, step, value): the later line wins."""
    return logs.groupBy("run", "step").agg(F.max_by("value", line_order(logs, order)).alias("value"))


def all_steps(logs: DataFrame) -> DataFrame:
    return logs.select("step").distinct()


def all_runs(logs: DataFrame) -> DataFrame:
    return logs.select("run").distinct()


def sorted_names(logs: DataFrame) -> DataFrame:
    """(run, place): the distinct runs in order, from 1. Null is no name."""
    names = all_runs(logs).where("run IS NOT NULL")
    bucket = bucket_of(F.col("run"), key_bounds(names, "run"))
    return ordered_index(names, "place", [F.col("run")], bucket).withColumn("place", (F.col("place") + 1).cast("bigint"))


def run_names(logs: DataFrame, limit: int = 10_000) -> list[str]:
    """Sorted run names: the columns of the wide table, so there must be few."""
    names = [row.run for row in all_runs(logs).limit(limit + 1).collect()]
    if len(names) > limit:
        raise ValueError(f"more than {limit} runs do not fit the columns of one table")
    return sorted(names)


def pivot_runs(logs: DataFrame, names: Sequence[str] | None = None, order: str = "line_no") -> DataFrame:
    """One row per step, one column per run, columns sorted by name."""
    names = run_names(logs) if names is None else sorted(names)
    return last_per_step(logs, order).groupBy("step").pivot("run", names).agg(F.first("value"))


def unpivot_row(wide: DataFrame, value: str = "value", ids: Sequence[str] = ()) -> DataFrame:
    """(run, value) from a wide table."""
    columns = [c for c in wide.columns if c not in ids]
    return wide.unpivot(list(ids), columns, "run", value)


def pivot_row(rows: DataFrame, name: str, value: str) -> DataFrame:
    """A (name, value) table as one wide row, columns sorted: the form of a totals file."""
    names = run_names(rows.select(F.col(name).alias("run")))
    return rows.groupBy().pivot(name, names).agg(F.first(value))


def rank_runs(logs: DataFrame, step: int, order: str = "line_no") -> DataFrame:
    """Runs at one step with `place`, by value descending; one row per run."""
    rows = last_per_step(logs.where(F.col("step") == step), order)
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.desc("value"), "run")))


def step_numbers(rows: DataFrame, every: int, order: Sequence[Column], bucket: Column,
                 run: str = "run") -> DataFrame:
    """Add `step`: (i + 1) * every for the i-th value of its run."""
    return ordered_index(rows, "step", order, bucket, [run]).withColumn(
        "step", (F.col("step") + 1) * every
    )


def sum_by_class(items: DataFrame, name: str, number: str,
                 rules: Sequence[tuple[str, str]] = PARAMETER_CLASSES) -> DataFrame:
    """(type, total): sum per class, and the grand total."""
    kinds = items.select(T.classify_by_rules(F.col(name), list(rules)).alias("type"), number)
    return (
        kinds.rollup("type")
        .agg(F.sum(number).alias("total"), F.grouping("type").alias("g"))
        .select(F.when(F.col("g") == 1, F.lit(TOTAL_LABEL)).otherwise(F.col("type")).alias("type"),
                "total")
    )


def stop_rule(logs: DataFrame, bucket: Column, patience: int = 3, delta: float = 0.01) -> DataFrame:
    """(run, best_step, best, stop_step) of a loss that should fall.

    An evaluation improves when it beats the best one before it by more than
    `delta`; the first evaluation that is the `patience`-th without improvement
    stops the run (null if none), and what comes after it does not count. All of it is running minima and maxima, cut into
    buckets so that one long run is spread over tasks.
    """
    order, one = [F.col("step")], F.lit(1).cast("bigint")
    # Written once: the second running value reads it twice.
    placed = materialize(
        running(
            logs.select("run", "step", "value"),
            {"_best": ("min", F.col("value"), False), "_count": ("sum", one, True)},
            order, bucket, ["run"],
        ),
        "losses",
    )
    first = F.col("_best").isNull()
    better = first | (F.col("_best") - F.col("value") > delta)
    last = {"_last": ("max", F.when(better, F.col("_count")), True)}
    marked = running(placed, last, order, bucket, ["run"])
    stale = F.col("_count") - F.col("_last") >= patience
    marked = marked.withColumn("_lowest", first | (F.col("value") < F.col("_best")))
    stops = marked.groupBy("run").agg(F.min(F.when(stale, F.col("step"))).alias("stop_step"))
    return marked.join(stops, "run").where(
        F.col("stop_step").isNull() | (F.col("step") <= F.col("stop_step"))
    ).groupBy("run").agg(
        # The last row below everything before it is the first with the smallest value.
        F.max(F.when(F.col("_lowest"), F.col("step"))).alias("best_step"),
        F.min("value").alias("best"), F.first("stop_step").alias("stop_step"),
    )
