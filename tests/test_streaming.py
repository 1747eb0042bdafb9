from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from glyphmill.operators import encode, vocab
from glyphmill.session import scratch_path
from glyphmill.sources import saved
from glyphmill.streaming import counts

SCHEMA = "doc_id bigint, lang string, text string"


def add(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def test_counts_grow_with_the_folder(spark):
    folder, target, state = (scratch_path(spark, x) for x in ("in", "out", "state"))
    texts = ["abca", "bb c", "", "é日a"]
    for half in (texts[:2], texts[2:]):
        add(spark, folder, [(i, "en", t) for i, t in enumerate(half)])
        stream = counts.read_stream(spark, folder, SCHEMA, files_per_batch=1)
        counts.batch_counts(stream, vocab.char_counts, target, state)
    got = {r.token: r.n for r in spark.read.parquet(target).groupBy("token").agg(F.sum("n").alias("n")).collect()}
    assert got == Counter("".join(texts))


@pytest.mark.parametrize("whole", [True, False])
def test_a_table_is_a_file_or_a_folder(spark, whole):
    """A folder of files gave no rows, and so no table; other tables beside it are not read."""
    folder, target, state = (scratch_path(spark, x) for x in ("in", "out", "state"))
    table = f"{folder}/documents.parquet"
    add(spark, table, [(1, "en", "aab")])
    add(spark, f"{folder}/other.parquet", [(9, "en", "zzz")])
    if whole:
        part = next(Path(table).glob("part-*.parquet"))
        folder = f"{folder}-file"
        Path(folder).mkdir()
        (Path(folder) / "documents.parquet").write_bytes(part.read_bytes())
    else:
        add(spark, table, [(2, "de", "c")])
    stream = counts.read_table_stream(spark, folder, "documents.parquet", SCHEMA)
    counts.running_table(vocab.char_counts(stream), target, state)
    got = {r.token: r.n for r in counts.newest_table(spark, target).collect()}
    assert got == ({"a": 2, "b": 1} if whole else {"a": 2, "b": 1, "c": 1})


def test_stateful_counts_resume(spark):
    folder, target, state = (scratch_path(spark, x) for x in ("in", "out", "state"))
    for rows in ([(1, "en", "aab")], [(2, "de", "abc")]):
        add(spark, folder, rows)
        stream = counts.read_stream(spark, folder, SCHEMA)
        counts.running_table(vocab.char_counts(stream), target, state)
    assert {r.token: r.n for r in counts.newest_table(spark, target).collect()} == {"a": 3, "b": 2, "c": 1}


def test_readers_keep_their_table(spark):
    folder, target, state = (scratch_path(spark, x) for x in ("in", "out", "state"))
    add(spark, folder, [(1, "en", "aab")])
    counts.running_table(vocab.char_counts(counts.read_stream(spark, folder, SCHEMA)), target, state)
    held = counts.newest_table(spark, target)
    add(spark, folder, [(2, "de", "abc")])
    counts.running_table(vocab.char_counts(counts.read_stream(spark, folder, SCHEMA)), target, state)
    assert {r.token: r.n for r in held.collect()} == {"a": 2, "b": 1}


def test_a_failure_before_the_manifest_row(spark, monkeypatch):
    folder, target, state = (scratch_path(spark, x) for x in ("in", "out", "state"))
    add(spark, folder, [(1, "en", "aab")])
    counts.running_table(vocab.char_counts(counts.read_stream(spark, folder, SCHEMA)), target, state)
    add(spark, folder, [(2, "de", "abc")])

    def cut_off(*_):
        raise OSError("cut off")

    with monkeypatch.context() as m:
        m.setattr(saved.json, "dumps", cut_off)
        with pytest.raises(Exception):
            counts.running_table(vocab.char_counts(counts.read_stream(spark, folder, SCHEMA)), target, state)
    assert {r.token: r.n for r in counts.newest_table(spark, target).collect()} == {"a": 2, "b": 1}
    # The next run does the batch again.
    counts.running_table(vocab.char_counts(counts.read_stream(spark, folder, SCHEMA)), target, state)
    assert {r.token: r.n for r in counts.newest_table(spark, target).collect()} == {"a": 3, "b": 2, "c": 1}


def test_ranks_over_several_batches(spark):
    folder = scratch_path(spark, "in")
    texts = ["bca", "ab", "zzc"]
    for i, text in enumerate(texts):
        add(spark, folder, [(i, "en", text)])
    stream = counts.read_stream(spark, folder, SCHEMA, files_per_batch=1)
    got = counts.stream_ranked_tokens(stream).orderBy("rank").collect()
    assert [(r.token, r.n) for r in got] == Counter("".join(texts)).most_common()


def test_projections_work_on_streams(spark):
    folder = scratch_path(spark, "in")
    add(spark, folder, [(1, "en", "abc"), (2, "en", " ")])
    stream = counts.read_stream(spark, folder, SCHEMA)
    encoded = encode.pack(stream.withColumn("ids", encode.byte_ids(F.col("text"))), "ids", 5, 0)
    target = scratch_path(spark, "out")
    counts.append_rows(encoded, target, scratch_path(spark, "state"))
    assert {r.doc_id: r.input_ids for r in spark.read.parquet(target).collect()} == {
        1: [101, 102, 103, 0, 0], 2: [36, 0, 0, 0, 0]}


def test_a_cluster_without_a_shared_folder_is_an_error(monkeypatch):
    from glyphmill import session

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        session.shared_folder(Session())
