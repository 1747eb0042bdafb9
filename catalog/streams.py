"""Counts kept by streaming queries over the documents' folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from glyphmill.operators import corpus, encode, vocab
from glyphmill.session import scratch_path
from glyphmill.streaming import counts

from .registry import SQL_CHARS, SQL_RANKED, joined, query, sql_bytes

SIZE = 1024


def stream(t):
    return counts.read_table_stream(t.spark, t.sf_dir, "documents.parquet", t.documents.schema)


@query("stream_char_counts", f"WITH {SQL_CHARS} SELECT c AS token, count(*) AS n FROM chars GROUP BY c")
def stream_char_counts(t):
    """A stateful aggregation."""
    return counts.stream_char_counts(stream(t))


@query("stream_char_counts_by_batch", f"WITH {SQL_CHARS} SELECT c AS token, count(*) AS n FROM chars GROUP BY c")
def stream_char_counts_by_batch(t):
    """Counts per batch, summed when read."""
    return counts.stream_char_counts_by_batch(stream(t))


@query("stream_char_counts_in_files", f"WITH {SQL_CHARS} SELECT c AS token, count(*) AS n FROM chars GROUP BY c")
def stream_char_counts_in_files(t):
    """A stateful aggregation over several files and batches; the newest committed table."""
    folder, state = scratch_path(t.spark, "stream-files"), scratch_path(t.spark, "stream-state")
    target = scratch_path(t.spark, "stream-chars")
    docs = t.documents
    files = docs.rdd.getNumPartitions()
    if files < 4:
        files, docs = 4, docs.repartition(4, "doc_id")
    # A file for each split, so that no task holds a share of the table that grows with it; two batches.
    docs.write.parquet(folder)
    docs = counts.read_stream(t.spark, folder, t.documents.schema, files_per_batch=(files + 1) // 2)
    counts.running_table(vocab.char_counts(docs), target, state)
    return counts.newest_table(t.spark, target)


@query("stream_token_totals", f"""
SELECT lang, sum(least(octet_length(encode(text)), {SIZE}))::BIGINT AS total FROM documents GROUP BY lang
""")
def stream_token_totals(t):
    """Byte tokens per language after the cut, from non-empty texts."""
    rows = corpus.non_empty(stream(t)).select(
        "lang", F.least(F.octet_length("text"), F.lit(SIZE)).cast("bigint").alias("tokens")
    )
    return counts.stream_totals(rows, "lang", "tokens")


@query("stream_frequency_rank", f"""
WITH {SQL_RANKED} SELECT token, n, first_doc, first_pos, rank FROM ranked
""")
def stream_frequency_rank(t):
    """Ranks from counts that batches add to a table."""
    return counts.stream_ranked_tokens(stream(t).select("doc_id", "text"))


@query("stream_non_empty_bytes", f"""
SELECT doc_id, array_to_string(list_transform({sql_bytes('text')}, lambda b: b + 4), ' ') AS ids
FROM documents WHERE text <> ''
""")
def stream_non_empty_bytes(t):
    """A filter and an encoding on a stream, appended to a table."""
    rows = corpus.non_empty(stream(t)).select("doc_id", joined(encode.byte_ids(F.col("text"))).alias("ids"))
    target = scratch_path(t.spark, "stream-rows")
    counts.append_rows(rows, target, scratch_path(t.spark, "stream-state"))
    return t.spark.read.parquet(target)
