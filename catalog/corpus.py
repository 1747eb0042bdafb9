"""Scans, sinks, and choosing documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from glyphmill.functions import text as T
from glyphmill.operators import corpus, metrics
from glyphmill.plans import validation
from glyphmill.session import scratch_path
from glyphmill.sources import readers

from .registry import SPACE, SQL_VALIDATION, query, sql_last, sql_strip, sql_symbols

# The documents hold no Han text, so the full stop takes the place of its Chinese form.
MARK = "."


@query("read_corpus", "SELECT doc_id, text FROM documents")
def read_corpus(t):
    return readers.read_corpus(t.spark, f"{t.sf_dir}/documents.parquet")


def _line_folder(t) -> str:
    path = scratch_path(t.spark, "lines")
    t.documents.select("text").write.text(path)
    return path


@query("read_lines", """
SELECT value, count(*) AS n
FROM (SELECT unnest(string_split(text, chr(10))) AS value FROM documents) GROUP BY value
""")
def read_lines(t):
    lines = readers.read_lines(t.spark, _line_folder(t))
    return lines.groupBy("value").agg(F.count("*").alias("n"))


@query("line_corpus_bits", f"""
WITH lines AS (
  SELECT unnest(string_split(text, chr(10))) || chr(10) AS text FROM documents
), {sql_symbols('lines')}
SELECT sum(n)::BIGINT AS symbols, round(sum(-n * log2(n / total)), 6) AS bits
FROM symbols, (SELECT sum(n) AS total FROM symbols)
""")
def line_corpus_bits(t):
    """The unigram bits of a line file, line ends counted as symbols."""
    lines = readers.read_lines(t.spark, _line_folder(t), keep_newline=True)
    return validation.validation_bits(lines, "value").withColumn("bits", F.round("bits", 6))


@query("non_empty", f"""
SELECT doc_id, turn, text FROM (
  SELECT conv_id AS doc_id, turn, unnest(string_split(text, '.')) AS text FROM conversations)
WHERE regexp_matches(text, '[^{SPACE}]')
""")
def non_empty(t):
    parts = t.conversations.select(
        F.col("conv_id").alias("doc_id"), "turn", F.explode(F.split("text", r"\.")).alias("text")
    )
    return corpus.non_empty(parts)


@query("last_mark_index", f"""
SELECT doc_id, ({sql_last('text', '.', 256)})::BIGINT AS pos FROM documents
""")
def last_mark_index(t):
    return t.documents.select("doc_id", T.last_mark_index(F.col("text"), MARK).alias("pos"))


@query("trim_to_mark", f"""
SELECT doc_id, substring(text, 1, pos + 1) AS text
FROM (SELECT doc_id, text, {sql_last('text', '.', 256)} AS pos FROM documents)
WHERE pos >= 100 AND pos < 256
""")
def trim_to_mark(t):
    return corpus.trim_to_mark(t.documents.select("doc_id", "text"), MARK)


@query("py_strip", f"""
SELECT part, count(*) AS n FROM (
  SELECT {sql_strip('part')} AS part
  FROM (SELECT unnest(string_split(text, '.')) AS part FROM documents))
GROUP BY part
""")
def py_strip(t):
    parts = t.documents.select(F.explode(F.split("text", r"\.")).alias("part"))
    return parts.groupBy(T.py_strip(F.col("part")).alias("part")).agg(F.count("*").alias("n"))


@query("drop_separators", """
SELECT doc_id, replace(replace(text, '. ', '.'), chr(10), '') AS text FROM documents
""")
def drop_separators(t):
    marked = F.replace(
        F.replace("text", F.lit(". "), F.lit(".\u2028")), F.lit("\n"), F.lit("\u2029")
    )
    return t.documents.select("doc_id", T.drop_separators(marked).alias("text"))


@query("training_lines", f"""
SELECT doc_id, part FROM (
  SELECT doc_id, {sql_strip('part')} AS part
  FROM (SELECT doc_id, unnest(string_split(text, '.')) AS part FROM documents))
WHERE part <> ''
""")
def training_lines(t):
    parts = t.documents.select("doc_id", F.explode(F.split("text", r"\.")).alias("part"))
    return corpus.training_lines(parts, "part")


@query("training_lines_with_blank", f"""
SELECT doc_id, {sql_strip('part')} AS part
FROM (SELECT doc_id, unnest(string_split(text, '.')) AS part FROM documents)
""")
def training_lines_with_blank(t):
    parts = t.documents.select("doc_id", F.explode(F.split("text", r"\.")).alias("part"))
    return corpus.training_lines(parts, "part", keep_blank=True)


@query("max_examples", """
SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT 300
""")
def max_examples(t):
    return corpus.max_examples(t.documents.select("doc_id", "text"), 300)


@query("first_n", """
SELECT doc_id, text FROM documents WHERE trim(text) <> '' ORDER BY doc_id LIMIT 500
""")
def first_n(t):
    return corpus.first_n(corpus.non_empty(t.documents.select("doc_id", "text")), 500)


@query("first_passing", """
SELECT doc_id, text FROM documents WHERE contains(text, '@') ORDER BY doc_id LIMIT 20
""")
def first_passing(t):
    """The first texts with an address, which are few: the prefix that is read grows until it holds enough."""
    rows = t.documents.select("doc_id", "text")
    return corpus.first_passing(rows, 20, lambda d: d.where(F.col("text").contains("@")))


@query("validation_set", f"WITH {SQL_VALIDATION} SELECT doc_id, text FROM valid")
def validation_set(t):
    return validation.validation_set(t.documents, mark=MARK)


@query("validation_bits", f"""
WITH {SQL_VALIDATION}, {sql_symbols('valid')}
SELECT sum(n)::BIGINT AS symbols, round(sum(-n * log2(n / total)), 6) AS bits
FROM symbols, (SELECT sum(n) AS total FROM symbols)
""")
def validation_bits(t):
    """The flagship: trim, choose, learn the unigram model, total its bits."""
    bits = validation.validation_bits(validation.validation_set(t.documents, mark=MARK))
    return bits.withColumn("bits", F.round("bits", 6))


@query("score_validation", f"""
WITH {SQL_VALIDATION}, {sql_symbols('valid')}, {sql_symbols('benchmark', 'other')}
SELECT sum(CASE WHEN s.n IS NOT NULL THEN o.n ELSE 0 END)::BIGINT AS symbols,
       round(sum(-o.n * log2(s.n / total)), 6) AS bits,
       sum(CASE WHEN s.n IS NULL THEN o.n ELSE 0 END)::BIGINT AS unseen
FROM other o LEFT JOIN symbols s USING (token), (SELECT sum(n) AS total FROM symbols)
""")
def score_validation(t):
    """The benchmark texts under the validation set's model."""
    model = metrics.unigram_model(validation.validation_set(t.documents, mark=MARK))
    scored = metrics.score_under_model(metrics.symbol_counts(t.benchmark), model)
    return scored.withColumn("bits", F.round("bits", 6))
