"""Comparing runs: one wide table, a ranking, and the series over time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions import text as T
from ..operators import runs
from ..sources import readers, writers


def compile_runs(logs: DataFrame, excluded: Sequence[str] = runs.EXCLUDED_RUNS) -> DataFrame:
    """One row per step, one column per run."""
    return runs.pivot_runs(runs.exclude_runs(logs, excluded))


def compile_folder(spark, pattern: str, target: str,
                   excluded: Sequence[str] = runs.EXCLUDED_RUNS) -> DataFrame:
    """Read all logs, write the wide CSV, and return the wide table."""
    wide = compile_runs(readers.read_eval_logs(spark, pattern), excluded)
    writers.write_wide(wide, target)
    return wide


def run_ranking(logs: DataFrame, families: DataFrame, step: int,
                renames: Sequence[tuple[str, str]] = runs.RENAMES, strict: bool = True) -> DataFrame:
    """(run, value, place, family) at one step."""
    named = logs.withColumn("run", T.rename_by_rules(F.col("run"), list(renames)))
    return runs.attach_category(runs.rank_runs(named, step), families, strict=strict)


def run_series(logs: DataFrame, families: DataFrame,
               renames: Sequence[tuple[str, str]] = runs.RENAMES, strict: bool = True) -> DataFrame:
    """(run, step, value, family): the values over time."""
    named = logs.withColumn("run", T.rename_by_rules(F.col("run"), list(renames)))
    return runs.attach_category(runs.last_per_step(named), families, strict=strict)


def wide_row_report(wide: DataFrame, families: DataFrame, value: str,
                    renames: Sequence[tuple[str, str]] = runs.RENAMES, strict: bool = True) -> DataFrame:
    """A one-row wide table (token counts, ratios) as (run, value, family), largest first."""
    rows = runs.unpivot_row(wide, value)
    named = rows.withColumn("run", T.rename_by_rules(F.col("run"), list(renames)))
    return runs.attach_category(named, families, strict=strict).orderBy(F.desc(value), "run")
