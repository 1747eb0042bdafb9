"""Incremental counts over a folder of documents that grows.

Projections and filters of the library work on a stream as they are. Counts come
in two forms: a stateful aggregation, and per-batch counts kept as a table that
is summed when it is read, which needs no state between batches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import vocab
from ..operators.ordering import key_bounds
from ..session import materialize, scratch_path
from ..sources import saved


def read_stream(spark: SparkSession, folder: str, schema, glob: str = "*.parquet",
                files_per_batch: int | None = None) -> DataFrame:
    """Documents of a folder; new files become new batches."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def read_table_stream(spark: SparkSession, folder: str, name: str, schema) -> DataFrame:
    """One table of a folder as a stream; the table is a file, or a folder of files that may grow.

    The name is given as a pattern that only it fits, since a pattern finds both forms.
    """
    return spark.readStream.schema(schema).parquet(f"{folder.rstrip('/')}/[{name[0]}]{name[1:]}")


def running_table(counts: DataFrame, target: str, state: str) -> None:
    """Run a streaming aggregation over what is there and keep each batch's result as a version.

    Complete mode: a version is the whole table after its batch. It is written into a folder of its own and
    becomes the newest by a manifest row that comes last, so what a reader holds is never overwritten,
    and a batch that is run again after a failure only adds the same table again.
    """

    def keep(batch: DataFrame, number: int) -> None:
        saved.write_version({"table": batch}, batch.sparkSession, target, "running", {"batch": number})

    query = (
        counts.writeStream.outputMode("complete").foreachBatch(keep)
        .option("checkpointLocation", state).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def newest_table(spark: SparkSession, target: str) -> DataFrame:
    """The newest whole table that `running_table` has committed; it stays readable while others follow."""
    kind, _, tables = saved.read_version(spark, target)
    if kind != "running":
        raise ValueError(f"{target} holds no running table")
    return tables["table"]


def batch_counts(docs: DataFrame, count: Callable[[DataFrame], DataFrame], target: str,
                 state: str) -> None:
    """Count each batch on its own and keep the result under its number.

    A batch that is run again after a failure overwrites its own folder.
    """

    def keep(batch: DataFrame, number: int) -> None:
        count(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    query = (
        docs.writeStream.foreachBatch(keep)
        .option("checkpointLocation", state).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def append_rows(rows: DataFrame, target: str, state: str) -> None:
    """Append a stream of projected or filtered rows to a table, each row once."""
    query = (
        rows.writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", state).trigger(availableNow=True).start(target)
    )
    query.awaitTermination()


def stream_char_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(token, n) kept up to date by a stateful aggregation."""
    spark = docs.sparkSession
    target = scratch_path(spark, "stream-chars")
    running_table(vocab.char_counts(docs, text), target, scratch_path(spark, "stream-state"))
    return newest_table(spark, target)


def stream_char_counts_by_batch(docs: DataFrame, text: str = "text") -> DataFrame:
    """(token, n) as the sum of per-batch counts."""
    spark = docs.sparkSession
    target = scratch_path(spark, "stream-batches")
    batch_counts(docs, lambda b: vocab.char_counts(b, text), target,
                 scratch_path(spark, "stream-state"))
    return spark.read.parquet(target).groupBy("token").agg(F.sum("n").alias("n"))


def stream_ranked_tokens(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(token, n, first_doc, first_pos, rank) of the characters seen so far.

    A rank needs all counts, so it is made per snapshot: batches add their counts to
    a table, and the table is added up and ranked when it is read.
    """
    spark = docs.sparkSession
    target = scratch_path(spark, "stream-ranks")
    batch_counts(docs, lambda b: vocab.counts_with_first(b, key=key), target,
                 scratch_path(spark, "stream-state"))
    counts = materialize(vocab.add_counts(spark.read.parquet(target)), "counts")
    return vocab.frequency_rank(counts, key_bounds(counts, "first_doc"))


def stream_totals(rows: DataFrame, by: str, value: str) -> DataFrame:
    """(by, total) of a number column, kept up to date by a stateful aggregation."""
    spark = rows.sparkSession
    target = scratch_path(spark, "stream-totals")
    totals = rows.groupBy(by).agg(F.sum(value).alias("total"))
    running_table(totals, target, scratch_path(spark, "stream-state"))
    return newest_table(spark, target)
