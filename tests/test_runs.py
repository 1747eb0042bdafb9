import random

import pytest
from pyspark.sql import functions as F

from glyphmill.operators import runs, tasks
from glyphmill.operators.ordering import bucket_of, key_bounds
from glyphmill.plans import reports
from glyphmill.session import scratch_path
from glyphmill.sources import readers, writers

LOGS = [("experiments/byte", 1000, 0.7, 1), ("experiments/byte", 2000, 0.5, 2), ("experiments/byte", 2000, 0.4, 3),
        ("experiments/subword-bpe", 1000, 0.08, 1), ("testing", 10, 0.6, 1)]


@pytest.fixture
def logs(spark):
    return spark.createDataFrame(LOGS, "run string, step bigint, value double, line_no bigint")


def test_wide_table_keeps_the_last_line_and_sorts_columns(logs):
    wide = reports.compile_runs(logs)
    assert wide.columns == ["step", "experiments/byte", "experiments/subword-bpe"]
    assert {tuple(r) for r in wide.collect()} == {(1000, 0.7, 0.08), (2000, 0.4, None)}


def test_logs_survive_files(spark, logs):
    folder, target = scratch_path(spark, "logs"), scratch_path(spark, "wide")
    writers.write_eval_log(runs.last_per_step(logs), folder)
    got = {(r.run, r.step, r.value) for r in readers.read_eval_logs(spark, folder + "/*").collect()}
    assert got == {("experiments/byte", 1000, 0.7), ("experiments/byte", 2000, 0.4),
                   ("experiments/subword-bpe", 1000, 0.08), ("testing", 10, 0.6)}
    wide = reports.compile_folder(spark, folder + "/*", target)
    back = readers.read_wide(spark, target, wide.columns[1:])
    assert {tuple(r) for r in back.collect()} == {(1000, 0.7, 0.08), (2000, 0.4, None)}


def test_plain_folder_names_are_run_names(spark, tmp_path):
    for name, lines in [("byte", "1000,0.5\n2000,0.25\n"), ("a+b %c", "10,1.5\n")]:
        (tmp_path / name).mkdir()
        (tmp_path / name / "ratios.txt").write_text(lines)
    (tmp_path / "empty").mkdir()
    got = {(r.run, r.step, r.value) for r in readers.read_eval_logs(spark, f"{tmp_path}/*/ratios.txt").collect()}
    assert got == {("byte", 1000, 0.5), ("byte", 2000, 0.25), ("a+b %c", 10, 1.5)}


def test_later_lines_win_over_files_and_blocks(spark, tmp_path):
    folder = tmp_path / "byte"
    folder.mkdir()
    # The later file is the smaller one, so a scan takes the earlier, larger file first or in several blocks.
    (folder / "a-1.txt").write_text("".join(f"{i % 7},{i}\n" for i in range(400)))
    (folder / "a-2.txt").write_text("3,-1\n5,-3\n5,-2\n")
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(name) for name in names]
    try:
        for size in ("134217728", "256"):
            spark.conf.set(names[0], size)
            spark.conf.set(names[1], "0")
            logs = readers.read_eval_logs(spark, f"{tmp_path}/*/*.txt")
            got = {r.step: r.value for r in runs.last_per_step(logs).collect()}
            want = {i % 7: float(i) for i in range(400)} | {3: -1.0, 5: -2.0}
            assert got == want
    finally:
        for name, value in zip(names, before):
            spark.conf.set(name, value)


def test_configs_with_empty_sizes(spark, tmp_path):
    (tmp_path / "byte").mkdir()
    (tmp_path / "byte" / "experiment.json").write_text(
        '{\n "tokenizer": {"name": "ByteTokenizer", "max_vocab_size": "", "max_examples": 1000000,\n'
        ' "special_tokens": {"pad_token": "<pad>"}},\n "model": {"n_positions": 1024},\n'
        ' "training": {"learning_rate": 5e-5}}')
    row = readers.read_configs(spark, f"{tmp_path}/*/experiment.json").first()
    assert (row.run, row.tokenizer.name, row.tokenizer.max_vocab_size) == ("byte", "ByteTokenizer", None)
    assert (row.tokenizer.max_examples, row.model.n_positions) == (1_000_000, 1024)
    assert row.tokenizer.special_tokens == {"pad_token": "<pad>"} and row.training.learning_rate == 5e-5


def test_ranking_has_families_and_unknown_runs_raise(spark, logs):
    families = runs.family_table(spark)
    kept = runs.exclude_runs(logs)
    got = [(r.run, r.place, r.family) for r in reports.run_ranking(kept, families, 1000).orderBy("place").collect()]
    assert got == [("byte", 1, "Basic (No BPE)"), ("character-bpe", 2, "Basic (BPE)")]
    with pytest.raises(Exception, match="run without a family"):
        reports.run_series(logs, families).collect()
    assert [r.run for r in runs.unknown_runs(logs.select("run"), families).orderBy("run").collect()] == [
        "experiments/byte", "experiments/subword-bpe", "testing"]
    assert len(runs.FAMILIES) == 19 and len(set(runs.FAMILIES.values())) == 4


def test_sums_per_class(spark):
    items = spark.createDataFrame([("wte", 5), ("h.ln_1", 2), ("h.mlp", 3), ("x", 1)], "name string, n bigint")
    got = {r.type: r.total for r in runs.sum_by_class(items, "name", "n").collect()}
    assert got == {"Word Embeddings": 5, "Layer Normalization": 2, "Feed-Forward Network": 3, "Other": 1,
                   "Total parameter count": 11}


def stop_by_hand(values, patience=3, delta=0.01):
    best, stale, stop = None, 0, None
    for step, value in values:
        better = best is None or best - value > delta
        stale = 0 if better else stale + 1
        best = value if best is None else min(best, value)
        if stale >= patience:
            stop = step
            break
    return next(s for s, v in values if v == best), best, stop


def test_stop_rule_equals_a_loop(spark):
    rnd = random.Random(11)
    rows = []
    for run in range(6):
        level = 5.0
        for step in range(1, 400 if run == 0 else 30):
            level -= rnd.choice([0.02, 0.005, -0.01, 0.0])
            rows.append((f"r{run}", step * 10, round(level, 3)))
    df = spark.createDataFrame(rows, "run string, step bigint, value double")
    bucket = bucket_of(F.col("step"), key_bounds(df, "step"))
    for r in runs.stop_rule(df, bucket).collect():
        values = [(s, v) for name, s, v in rows if name == r.run]
        assert (r.best_step, r.best, r.stop_step) == stop_by_hand(values), r.run


def test_results_are_appended_with_sorted_columns(spark):
    path = scratch_path(spark, "results")
    for notes in ("one", "two"):
        df = spark.createDataFrame([(notes, "byte", 0.5)], "notes string, dataset string, bits_per_byte double")
        writers.append_results(df, path)
    back = spark.read.parquet(path)
    assert back.columns == ["bits_per_byte", "dataset", "notes"] and back.count() == 2


def test_split_has_exact_sizes(spark):
    rows = spark.range(1003).withColumnRenamed("id", "doc_id")
    for ratio in (0.9, 0.5, 0.0, 1.0):
        got = {r.split: r["count"] for r in tasks.split_exact(rows, ratio).groupBy("split").count().collect()}
        assert got.get("train", 0) == int(1003 * ratio) and sum(got.values()) == 1003
    a = {r.doc_id for r in tasks.split_exact(rows, 0.5, 1).where("split = 'train'").collect()}
    b = {r.doc_id for r in tasks.split_exact(rows, 0.5, 2).where("split = 'train'").collect()}
    assert a != b


def test_masking_shares(spark):
    rows = spark.range(200).select(
        F.col("id").alias("doc_id"),
        F.concat(F.array(F.lit(0)), F.array_repeat(F.lit(50), 1000), F.array(F.lit(2))).alias("ids"))
    out = tasks.mask_tokens(rows, "ids", "doc_id", 5000, 4, [0, 1, 2, 3, 4]).collect()
    targets = masked = kept = 0
    for r in out:
        assert r.labels[0] == r.labels[-1] == -100 and r.masked_ids[0] == 0 and r.masked_ids[-1] == 2
        for x, y, label in zip(r.ids, r.masked_ids, r.labels):
            assert label in (-100, x) and (label != -100 or x == y)
            targets += label != -100
            masked += label != -100 and y == 4
            kept += label != -100 and y == x
    assert abs(targets / 200_000 - 0.15) < 0.005
    assert abs(masked / targets - 0.8) < 0.01 and abs(kept / targets - 0.1) < 0.01


def test_unknown_task_raises():
    with pytest.raises(ValueError):
        tasks.task_fields("nothing")


def test_sorted_names(spark):
    rows = spark.createDataFrame([(n,) for n in ["b", "a", None, "c", "a", "B"]], "run string")
    assert sorted(map(tuple, runs.sorted_names(rows).collect())) == [("B", 1), ("a", 2), ("b", 3), ("c", 4)]
    assert runs.sorted_names(rows.limit(0)).collect() == []
