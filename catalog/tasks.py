"""Splits, masking and labelled tasks."""

from __future__ import annotations

from pyspark.sql import functions as F

from glyphmill.functions import arrays as A
from glyphmill.operators import encode, tasks
from glyphmill.plans import labelled
from glyphmill.session import scratch_path
from glyphmill.sources import readers, writers

from .registry import joined, query, sql_bytes

SQL_SPLIT = """
placed AS (
  SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id || ':0'), doc_id) AS k, count(*) OVER () AS n
  FROM documents
), parted AS (SELECT doc_id, CASE WHEN k <= floor(n * 0.9::DOUBLE) THEN 'train' ELSE 'val' END AS split FROM placed)"""


@query("split_exact", f"WITH {SQL_SPLIT} SELECT doc_id, split FROM parted")
def split_exact(t):
    return tasks.split_exact(t.documents.select("doc_id"))


@query("write_split", f"""
WITH {SQL_SPLIT}
SELECT split, value, count(*) AS n
FROM (SELECT split, unnest(string_split(text, chr(10))) AS value FROM documents JOIN parted USING (doc_id))
GROUP BY split, value
""")
def write_split(t):
    path = scratch_path(t.spark, "split")
    writers.write_split(tasks.split_exact(t.documents.select("doc_id", "text")), path)
    return t.spark.read.text(path).groupBy("split", "value").agg(F.count("*").alias("n"))


CHOSEN, MASKED, REPLACED = tasks.draw_limits(0.15)
P1, P2, P3 = tasks.DRAW_PRIMES


@query("mask_tokens", f"""
WITH cells AS (
  SELECT doc_id, seeds, generate_subscripts(ids, 1) - 1 AS i, unnest(ids) AS x
  FROM (SELECT doc_id, list_transform([1, 9, 17], lambda k: ('0x' || substr(md5(doc_id || ':7'), k, 8))::BIGINT % 2147483648) AS seeds,
               list_concat([1], list_transform({sql_bytes('text')}, lambda b: b + 4), [2]) AS ids FROM documents)
), spread AS (SELECT *, (i::BIGINT + seeds[1]) * {tasks.DRAW_FACTOR} % {P1} AS a FROM cells),
mixed AS (SELECT *, (a * a + seeds[2]) % {P2} AS b FROM spread),
drawn AS (SELECT doc_id, i, x, (b * b + seeds[3]) % {P3} AS r FROM mixed)
SELECT doc_id,
  string_agg((CASE WHEN x <= 3 OR r >= {REPLACED} THEN x WHEN r < {MASKED} THEN 3
              ELSE floor((r - {MASKED}) * 260 / {REPLACED - MASKED}) END)::BIGINT::VARCHAR, ' ' ORDER BY i) AS masked_ids,
  string_agg((CASE WHEN x > 3 AND r < {CHOSEN} THEN x ELSE -100 END)::VARCHAR, ' ' ORDER BY i) AS labels
FROM drawn GROUP BY doc_id
""")
def mask_tokens(t):
    """Masked byte ids of the whole documents."""
    ids = A.wrap_specials(encode.byte_ids(F.col("text")), 1, 2)
    rows = t.documents.select("doc_id", ids.alias("ids"))
    masked = tasks.mask_tokens(rows, "ids", "doc_id", 260, 3, [0, 1, 2, 3], seed=7)
    return masked.select(
        "doc_id", joined(F.col("masked_ids")).alias("masked_ids"), joined(F.col("labels")).alias("labels")
    )


@query("encode_task_single", f"""
SELECT doc_id, array_to_string(list_slice(list_concat([1], list_slice(ids, 1, 510), [2],
         list_transform(range(512), lambda x: 0)), 1, 512), ' ') AS input_ids, least(len(ids) + 2, 512)::BIGINT AS tokens
FROM (SELECT doc_id, list_transform({sql_bytes('text')}, lambda b: b + 4) AS ids FROM documents)
""")
def encode_task_single(t):
    rows = t.documents.select("doc_id", F.col("text").alias("sentence"))
    encoded = labelled.encode_task(rows, "tnews", encode.byte_ids, 1, 2, 0)
    return encoded.select(
        "doc_id", joined(F.col("input_ids")).alias("input_ids"),
        A.total(F.col("attention_mask")).alias("tokens"),
    )


@query("encode_task_pair", f"""
WITH pairs AS (
  SELECT a.conv_id, a.turn, list_transform({sql_bytes('a.text')}, lambda b: b + 4) AS x,
         list_transform({sql_bytes('b.text')}, lambda b: b + 4) AS y
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
), cut AS (
  SELECT conv_id, turn, list_slice(x, 1, CASE WHEN len(x) + len(y) <= 508 THEN len(x) ELSE least(len(x), greatest(508 - len(y), 254)) END) AS x,
         list_slice(y, 1, CASE WHEN len(x) + len(y) <= 508 THEN len(y) ELSE least(len(y), greatest(508 - len(x), 254)) END) AS y
  FROM pairs
)
SELECT conv_id, turn, array_to_string(list_slice(list_concat([1], x, [2], [2], y, [2],
         list_transform(range(512), lambda v: 0)), 1, 512), ' ') AS input_ids, (len(x) + len(y) + 4)::BIGINT AS tokens
FROM cut
""")
def encode_task_pair(t):
    """Neighbouring turns as sentence pairs, the longer side cut first."""
    a = t.conversations.select("conv_id", "turn", F.col("text").alias("sentence1"))
    b = t.conversations.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("sentence2"))
    encoded = labelled.encode_task(a.join(b, ["conv_id", "turn"]), "afqmc", encode.byte_ids, 1, 2, 0)
    return encoded.select(
        "conv_id", "turn", joined(F.col("input_ids")).alias("input_ids"),
        A.total(F.col("attention_mask")).alias("tokens"),
    )


@query("read_task", f"""
WITH {SQL_SPLIT}
SELECT doc_id, text AS sentence, quality::BIGINT AS label, 'tnews' AS task, 'validation' AS split,
       'single' AS kind, 15::BIGINT AS classes
FROM documents JOIN labels USING (doc_id) JOIN parted USING (doc_id) WHERE split = 'val'
""")
def read_task(t):
    """Labelled documents and turns as two tasks in one partitioned table; one part is read."""
    rows = tasks.split_exact(t.documents.select("doc_id", "text")).join(t.labels, "doc_id").select(
        F.col("doc_id"), F.col("text").alias("sentence"), F.col("quality").alias("label"),
        F.lit("tnews").alias("task"),
        F.when(F.col("split") == "val", "validation").otherwise("train").alias("split"),
    )
    other = t.conversations.select(
        F.col("conv_id").alias("doc_id"), F.col("text").alias("sentence"), F.lit(0).alias("label"),
        F.lit("iflytek").alias("task"), F.lit("validation").alias("split"),
    )
    path = scratch_path(t.spark, "tasks")
    rows.unionByName(other).write.partitionBy("task", "split").parquet(path)
    return readers.read_task(t.spark, path, "tnews", "validation").drop("fields")


SQL_SCORES = """
SELECT ['tnews', 'afqmc', 'ocnli'][(vec_id % 3 + 1)::INTEGER] AS task,
       sum((list_position(embedding, list_max(embedding)) - 1 = label)::INTEGER)::BIGINT AS correct, count(*) AS total,
       round(avg((list_position(embedding, list_max(embedding)) - 1 = label)::INTEGER), 6) AS accuracy
FROM embeddings GROUP BY 1"""


def logits(t):
    """Embeddings stand in for logits of three tasks."""
    names = F.array(*[F.lit(x) for x in ("tnews", "afqmc", "ocnli")])
    return t.embeddings.select(
        F.get(names, (F.col("vec_id") % 3).cast("int")).alias("task"), F.col("embedding").alias("logits"), "label",
    )


@query("score_tasks", SQL_SCORES)
def score_tasks(t):
    return labelled.score_tasks(logits(t)).withColumn("accuracy", F.round("accuracy", 6))


@query("score_and_append", f"SELECT run, s.* FROM ({SQL_SCORES}) s, (VALUES ('first'), ('second')) v(run)")
def score_and_append(t):
    """Two runs, one of them scored twice: one row for each run and task."""
    path = scratch_path(t.spark, "results")
    for run in ("first", "second", "first"):
        labelled.score_and_append(logits(t), path, run)
    return t.spark.read.parquet(path).withColumn("accuracy", F.round("accuracy", 6))
