"""Encoding and scoring labelled tasks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import arrays as A
from ..operators import encode, metrics, tasks
from ..sources import writers


def encode_task(rows: DataFrame, task: str, ids_of: Callable[[Column], Column], start: int,
                end: int, pad: int, size: int = tasks.TASK_POSITIONS) -> DataFrame:
    """Encode the one or two fields of a task; a pair is cut from its longer side."""
    fields = tasks.task_fields(task)
    ids = [f"_ids{i}" for i in range(len(fields))]
    for name, source in zip(ids, fields):
        rows = rows.withColumn(name, ids_of(F.col(source)))
    if len(fields) == 1:
        joined = tasks.join_pair(F.slice(ids[0], 1, size - 2), None, start, end)
    else:
        joined = tasks.join_pair(*tasks.cut_pair(F.col(ids[0]), F.col(ids[1]), size - 4), start, end)
    rows = rows.withColumn("_ids", joined)
    return encode.pack(rows, "_ids", size, pad).drop("_ids", "labels", *ids)


def score_tasks(logits: DataFrame, column: str = "logits", label: str = "label",
                task: str = "task") -> DataFrame:
    """(task, correct, total, accuracy) from rows with a logit array."""
    rows = logits.withColumn("_pred", A.argmax(F.col(column)))
    return metrics.accuracy(rows, "_pred", label, task)


def score_and_append(logits: DataFrame, path: str, run: str, **columns: str) -> None:
    """Score all tasks of a run and append a row for each to the results at `path`. A row is told by run
    and task, so the same run scored again leaves the results as they are."""
    scored = score_tasks(logits, **columns).withColumn("run", F.lit(run))
    writers.append_new(scored, path, ["run", columns.get("task", "task")])
