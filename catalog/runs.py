"""Logs of runs. The events stand in for evaluation logs: the type names the run,
the hour is the step, and a later event of the same hour wins."""

from __future__ import annotations

from pyspark.sql import functions as F

from glyphmill.functions import text as T
from glyphmill.operators import runs
from glyphmill.operators.ordering import bucket_of, key_bounds
from glyphmill.plans import reports
from glyphmill.session import scratch_path
from glyphmill.sources import readers, writers

from .registry import query

NAMES = {
    "click": "experiments/subword-bpe", "error": "experiments/repacked-subword",
    "purchase": "experiments/byte", "signup": "testing", "view": "experiments/character",
}
STEP = 24


def logs(t):
    name = F.create_map(*[F.lit(x) for pair in NAMES.items() for x in pair])
    step = F.datediff("ts", F.lit("2024-01-01").cast("date")) * 24 + F.hour("ts")
    return t.events.select(
        F.get(F.map_values(F.map_filter(name, lambda k, _: k == F.col("event_type"))), F.lit(0)).alias("run"),
        step.cast("bigint").alias("step"), "value", F.col("event_id").alias("line_no"),
    )


SQL_LOGS = f"""
logs AS (
  SELECT CASE event_type {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in NAMES.items())} END AS run,
         (date_diff('day', DATE '2024-01-01', ts::DATE) * 24 + hour(ts))::BIGINT AS step,
         value, event_id AS line_no
  FROM events
), latest AS (SELECT run, step, arg_max(value, line_no) AS value FROM logs GROUP BY run, step)"""
SQL_RENAMED = """replace(replace(replace(run, 'experiments/', ''), 'subword-bpe', 'character-bpe'),
  'repacked-subword', 'repacked-character-bpe')"""
SQL_FAMILIES = "families AS (SELECT * FROM (VALUES {}) v(run, family))".format(
    ", ".join(f"('{k}', '{v}')" for k, v in runs.FAMILIES.items())
)
COLUMNS = sorted(v for v in NAMES.values() if v != "testing")
SQL_WIDE = "SELECT step, {} FROM latest WHERE run <> 'testing' GROUP BY step".format(
    ", ".join(f"max(CASE WHEN run = '{c}' THEN value END) AS \"{c}\"" for c in COLUMNS)
)


@query("exclude_runs", f"WITH {SQL_LOGS} SELECT run, step, value, line_no FROM logs WHERE run <> 'testing'")
def exclude_runs(t):
    return runs.exclude_runs(logs(t))


@query("pivot_runs", f"WITH {SQL_LOGS} {SQL_WIDE}")
def pivot_runs(t):
    return reports.compile_runs(logs(t))


@query("all_steps", f"WITH {SQL_LOGS} SELECT DISTINCT step FROM logs")
def all_steps(t):
    return runs.all_steps(logs(t))


@query("all_runs", f"WITH {SQL_LOGS} SELECT DISTINCT run FROM logs")
def all_runs(t):
    return runs.all_runs(logs(t))


@query("sorted_steps", f"WITH {SQL_LOGS} {SQL_WIDE} ORDER BY step")
def sorted_steps(t):
    return reports.compile_runs(logs(t)).orderBy("step")


@query("sorted_names", f"""
WITH {SQL_LOGS}
SELECT run, row_number() OVER (ORDER BY run)::BIGINT AS place FROM (SELECT DISTINCT run FROM logs)
""")
def sorted_names(t):
    """The column order of the wide table."""
    return runs.sorted_names(logs(t))


@query("unpivot_row", f"""
WITH {SQL_LOGS} SELECT step, run, value FROM latest WHERE run <> 'testing'
""")
def unpivot_row(t):
    return runs.unpivot_row(reports.compile_runs(logs(t)), "value", ["step"]).where("value IS NOT NULL")


@query("strip_prefix_rename", f"WITH {SQL_LOGS} SELECT line_no, {SQL_RENAMED} AS run FROM logs")
def strip_prefix_rename(t):
    return logs(t).select("line_no", T.rename_by_rules(F.col("run"), runs.RENAMES).alias("run"))


@query("rank_runs", f"""
WITH {SQL_LOGS}
SELECT run, step, value, row_number() OVER (ORDER BY value DESC, run)::BIGINT AS place
FROM latest WHERE step = {STEP}
""")
def rank_runs(t):
    return runs.rank_runs(logs(t), STEP)


@query("attach_category", f"""
WITH {SQL_LOGS}, {SQL_FAMILIES}, named AS (SELECT {SQL_RENAMED} AS run, step, value FROM latest)
SELECT n.run, step, value, family FROM named n LEFT JOIN families f ON n.run = f.run
""")
def attach_category(t):
    """Families of all runs; the one without a family stays null."""
    return reports.run_series(logs(t), runs.family_table(t.spark), strict=False)


@query("unknown_runs", f"""
WITH {SQL_LOGS}, {SQL_FAMILIES}
SELECT DISTINCT run FROM (SELECT {SQL_RENAMED} AS run FROM logs) WHERE run NOT IN (SELECT run FROM families)
""")
def unknown_runs(t):
    named = logs(t).withColumn("run", T.rename_by_rules(F.col("run"), runs.RENAMES))
    return runs.unknown_runs(named, runs.family_table(t.spark))


@query("run_ranking", f"""
WITH {SQL_LOGS}, {SQL_FAMILIES}, named AS (SELECT {SQL_RENAMED} AS run, step, value FROM latest WHERE run <> 'testing')
SELECT n.run, step, value, row_number() OVER (ORDER BY value DESC, n.run)::BIGINT AS place, family
FROM named n JOIN families f ON n.run = f.run WHERE step = {STEP}
""")
def run_ranking(t):
    return reports.run_ranking(runs.exclude_runs(logs(t)), runs.family_table(t.spark), STEP)


@query("run_series", f"""
WITH {SQL_LOGS}, {SQL_FAMILIES}, named AS (SELECT {SQL_RENAMED} AS run, step, value FROM latest WHERE run <> 'testing')
SELECT n.run, step, value, family FROM named n JOIN families f ON n.run = f.run
""")
def run_series(t):
    return reports.run_series(runs.exclude_runs(logs(t)), runs.family_table(t.spark))


@query("wide_row_report", f"""
WITH {SQL_LOGS}, {SQL_FAMILIES}, counts AS (
  SELECT {SQL_RENAMED} AS run, count(*) AS n FROM logs WHERE run <> 'testing' GROUP BY 1)
SELECT c.run, n, family FROM counts c JOIN families f ON c.run = f.run
""")
def wide_row_report(t):
    """One wide row of counts per run, turned back into a ranked list."""
    kept = runs.exclude_runs(logs(t))
    wide = kept.groupBy().pivot("run", runs.run_names(kept)).agg(F.count("value"))
    return reports.wide_row_report(wide, runs.family_table(t.spark), "n")


PARTS = ["wte", "wpe", "ln_1", "mlp.c_fc", "mlp.c_proj", "attn.c_attn", "lm_head", "bias"]
SQL_CLASSES = """CASE WHEN contains(name, 'wte') THEN 'Word Embeddings'
  WHEN contains(name, 'wpe') THEN 'Position Embeddings'
  WHEN contains(name, 'ln') THEN 'Layer Normalization'
  WHEN contains(name, 'mlp') OR contains(name, 'c_fc') OR contains(name, 'c_proj') THEN 'Feed-Forward Network'
  WHEN contains(name, 'attn') THEN 'Self-Attention'
  WHEN contains(name, 'lm_head') THEN 'Final Output Layer' ELSE 'Other' END"""
SQL_PARAMETERS = f"""
parameters AS (
  SELECT p_partkey, p_size, ({PARTS})[p_size % 8 + 1] || '.' || p_name AS name FROM part
)"""


def parameters(t):
    part = F.get(F.array(*[F.lit(p) for p in PARTS]), F.col("p_size") % 8)
    return t.part.select("p_partkey", "p_size", F.concat_ws(".", part, "p_name").alias("name"))


@query("classify_by_rules", f"""
WITH {SQL_PARAMETERS} SELECT p_partkey, {SQL_CLASSES} AS type FROM parameters
""")
def classify_by_rules(t):
    kind = T.classify_by_rules(F.col("name"), runs.PARAMETER_CLASSES)
    return parameters(t).select("p_partkey", kind.alias("type"))


@query("sum_by_class", f"""
WITH {SQL_PARAMETERS}, typed AS (SELECT {SQL_CLASSES} AS type, p_size FROM parameters)
SELECT type, sum(p_size)::BIGINT AS total FROM typed GROUP BY type
UNION ALL SELECT 'Total parameter count', sum(p_size)::BIGINT FROM typed
""")
def sum_by_class(t):
    return runs.sum_by_class(parameters(t), "name", "p_size")


@query("step_numbers", """
SELECT event_id, event_type AS run,
       (row_number() OVER (PARTITION BY event_type ORDER BY event_id) * 1000)::BIGINT AS step FROM events
""")
def step_numbers(t):
    rows = t.events.select("event_id", F.col("event_type").alias("run"))
    bucket = bucket_of(F.col("event_id"), key_bounds(rows, "event_id"))
    return runs.step_numbers(rows, 1000, [F.col("event_id")], bucket)


@query("stop_rule", """
WITH placed AS (
  SELECT event_type AS run, event_id AS step, value,
         min(value) OVER (PARTITION BY event_type ORDER BY event_id
                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best,
         row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i
  FROM events
), marked AS (
  SELECT *, max(CASE WHEN best IS NULL OR best - value > 0.01 THEN i END)
              OVER (PARTITION BY run ORDER BY step ROWS UNBOUNDED PRECEDING) AS last
  FROM placed
)
SELECT run, min(CASE WHEN value = top THEN step END) AS best_step, any_value(top) AS best, any_value(stop) AS stop_step
FROM (SELECT *, min(value) OVER (PARTITION BY run) AS top
      FROM (SELECT *, min(CASE WHEN i - last >= 3 THEN step END) OVER (PARTITION BY run) AS stop FROM marked)
      WHERE stop IS NULL OR step <= stop) GROUP BY run
""")
def stop_rule(t):
    """Event values as losses in event order: five long runs."""
    rows = t.events.select(F.col("event_type").alias("run"), F.col("event_id").alias("step"), "value")
    return runs.stop_rule(rows, bucket_of(F.col("step"), key_bounds(rows, "step")))


def log_folder(t) -> str:
    """One log folder per run, in the line order of the events."""
    path = scratch_path(t.spark, "logs")
    writers.write_eval_log(runs.last_per_step(logs(t)), path)
    return path


@query("read_eval_logs", f"WITH {SQL_LOGS} SELECT run, step, value FROM latest")
def read_eval_logs(t):
    return readers.read_eval_logs(t.spark, log_folder(t) + "/*").select("run", "step", "value")


@query("eval_logs_in_files", f"WITH {SQL_LOGS} SELECT run, step, value FROM latest")
def eval_logs_in_files(t):
    """Every line of the logs over several files a run and blocks a file; the latest line of a step wins."""
    path = scratch_path(t.spark, "logs")
    lines = logs(t).repartitionByRange(4, "line_no").sortWithinPartitions("run", "line_no")
    lines.select("run", "step", "value").write.partitionBy("run").csv(path)
    return runs.last_per_step(readers.read_eval_logs(t.spark, path + "/*"))


@query("write_eval_log", f"""
WITH {SQL_LOGS}, numbered AS (
  SELECT run, value, row_number() OVER (PARTITION BY run ORDER BY line_no) AS k FROM logs)
SELECT run, (k * 500)::BIGINT AS step, value FROM numbered
""")
def write_eval_log(t):
    """Values numbered per run, written as logs, and read back."""
    rows = logs(t).drop("step")
    bucket = bucket_of(F.col("line_no"), key_bounds(rows, "line_no"))
    numbered = runs.step_numbers(rows, 500, [F.col("line_no")], bucket)
    path = scratch_path(t.spark, "logs")
    writers.write_eval_log(numbered, path)
    return readers.read_eval_logs(t.spark, path + "/*").select("run", "step", "value")


@query("compile_runs", f"WITH {SQL_LOGS} {SQL_WIDE}")
def compile_runs(t):
    """All logs of a folder into one wide CSV, read back."""
    target = scratch_path(t.spark, "wide")
    wide = reports.compile_folder(t.spark, log_folder(t) + "/*", target)
    return readers.read_wide(t.spark, target, [c for c in wide.columns if c != "step"])


@query("read_wide", f"WITH {SQL_LOGS} SELECT * FROM ({SQL_WIDE})")
def read_wide(t):
    """The whole wide CSV; its empty cells are null."""
    target = scratch_path(t.spark, "wide")
    writers.write_wide(reports.compile_runs(logs(t)), target)
    return readers.read_wide(t.spark, target, COLUMNS)


@query("append_results", """
SELECT lang AS dataset, round(avg(n_chars), 4) AS validation_loss, count(*) AS max_pos_embeddings, 'first' AS notes
FROM documents GROUP BY lang
UNION ALL
SELECT source, round(avg(n_chars), 4), count(*), 'second' FROM documents GROUP BY source
""")
def append_results(t):
    """Two appends of result rows, columns sorted by name."""
    path = scratch_path(t.spark, "results")
    for column, note in (("lang", "first"), ("source", "second")):
        rows = t.documents.groupBy(F.col(column).alias("dataset")).agg(
            F.round(F.avg("n_chars"), 4).alias("validation_loss"),
            F.count("*").alias("max_pos_embeddings"),
        ).withColumn("notes", F.lit(note))
        writers.append_results(rows, path)
    return t.spark.read.parquet(path)


@query("read_configs", """
SELECT 'Brand' || p_partkey AS name, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size * 100 END::BIGINT AS max_vocab_size,
       NULL::BIGINT AS max_examples, p_size::BIGINT AS n_positions, p_retailprice AS learning_rate
FROM part
""")
def read_configs(t):
    """One configuration per part, as JSON lines; some sizes are empty strings."""
    size = F.when(F.col("p_size") % 3 == 0, '""').otherwise((F.col("p_size") * 100).cast("string"))
    line = F.format_string(
        '{"tokenizer": {"name": "Brand%s", "max_vocab_size": %s, "max_examples": "", "special_tokens": '
        '{"pad_token": "<pad>"}}, "model": {"n_positions": %s}, "training": {"learning_rate": %s}}',
        F.col("p_partkey"), size, F.col("p_size"), F.col("p_retailprice").cast("string"),
    )
    path = scratch_path(t.spark, "configs")
    t.part.select(line.alias("value")).write.text(path)
    rows = readers.read_configs(t.spark, path, one_per_file=False)
    return rows.select(
        "tokenizer.name", "tokenizer.max_vocab_size", "tokenizer.max_examples", "model.n_positions",
        "training.learning_rate",
    )
