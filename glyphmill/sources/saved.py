"""Folders that hold a tokenizer's tables in versions, each made known by a committed manifest row.

A version's tables are written first, into a folder of their own; the manifest row that names it comes
last. A reader takes the newest row, so a write that fails half-way, or is still going on, is never seen.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession, functions as F

FORMAT = 1
_MANIFEST = "format int, version bigint, folder string, kind string, settings string, sizes map<string,bigint>"


def newest(spark: SparkSession, path: str) -> Row | None:
    """The manifest row of the newest version, or None where nothing has been saved."""
    try:
        rows = spark.read.schema(_MANIFEST).parquet(f"{path}/manifest")
        return rows.orderBy(F.desc("version"), F.desc("folder")).first()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def write_version(tables: Mapping[str, DataFrame], spark: SparkSession, path: str, kind: str, settings: dict) -> int:
    """Save `tables` as a new version; its number."""
    before = newest(spark, path)
    version = (before.version if before else 0) + 1
    folder = f"version-{version:06d}-{uuid.uuid4().hex}"
    sizes = {}
    for name, table in tables.items():
        table.write.parquet(f"{path}/{folder}/{name}")
        sizes[name] = spark.read.parquet(f"{path}/{folder}/{name}").count()
    row = (FORMAT, version, folder, kind, json.dumps(settings, sort_keys=True), sizes)
    spark.createDataFrame([row], _MANIFEST).coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return version


def read_version(spark: SparkSession, path: str) -> tuple[str, dict, dict[str, DataFrame]]:
    """(kind, settings, tables) of the newest version. A table that has not the rows it was saved
    with, or another format, is an error."""
    row = newest(spark, path)
    if row is None:
        raise FileNotFoundError(f"nothing saved at {path}")
    if row.format != FORMAT:
        raise ValueError(f"{path} has format {row.format}, not {FORMAT}")
    tables = {name: spark.read.parquet(f"{path}/{row.folder}/{name}") for name in row.sizes}
    for name, table in tables.items():
        if table.count() != row.sizes[name]:
            raise ValueError(f"{path}/{row.folder}/{name} is not whole")
    return row.kind, json.loads(row.settings), tables
