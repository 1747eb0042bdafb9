"""Entropy, bits per byte, accuracy, and number arrays."""

from __future__ import annotations

from pyspark.sql import functions as F

from glyphmill.functions import arrays as A, text as T
from glyphmill.operators import encode, metrics
from glyphmill.plans import compare, validation

from .registry import SQL_VALIDATION, query, sql_symbols

SIZE = 1024
TOTAL = "(SELECT sum(n) AS total FROM symbols)"


@query("unigram_model", f"""
WITH {sql_symbols('documents')}
SELECT token, n, round(n / total, 9) AS p FROM symbols, {TOTAL}
""")
def unigram_model(t):
    return metrics.unigram_model(t.documents).withColumn("p", F.round("p", 9))


@query("unigram_bits", f"""
WITH {sql_symbols('documents')}
SELECT sum(n)::BIGINT AS symbols, round(sum(-n * log2(n / total)), 3) AS bits FROM symbols, {TOTAL}
""")
def unigram_bits(t):
    return metrics.unigram_bits(metrics.unigram_model(t.documents)).withColumn("bits", F.round("bits", 3))


@query("score_under_model", f"""
WITH {sql_symbols('documents')}, {sql_symbols('pages_text', 'other').replace('WITH', '')}
SELECT sum(CASE WHEN s.n IS NOT NULL THEN o.n ELSE 0 END)::BIGINT AS symbols,
       round(sum(-o.n * log2(s.n / total)), 3) AS bits,
       sum(CASE WHEN s.n IS NULL THEN o.n ELSE 0 END)::BIGINT AS unseen
FROM other o LEFT JOIN symbols s USING (token), {TOTAL}
""".replace("FROM pages_text", "FROM (SELECT html AS text FROM pages)"))
def score_under_model(t):
    """Raw pages under the documents' model; some of their characters are unseen."""
    scored = metrics.score_under_model(
        metrics.symbol_counts(t.pages, "html"), metrics.unigram_model(t.documents)
    )
    return scored.withColumn("bits", F.round("bits", 3))


@query("scale_by_total", """
SELECT source, n, round(n / sum(n) OVER (), 9) AS p
FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)
""")
def scale_by_total(t):
    counts = t.documents.groupBy("source").agg(F.count("*").alias("n"))
    return metrics.scale_by_total(counts).withColumn("p", F.round("p", 9))


@query("nats_to_bits", """
SELECT event_id, round(value / ln(2), 6) AS bits FROM events
""")
def nats_to_bits(t):
    return t.events.select("event_id", F.round(metrics.nats_to_bits(F.col("value")), 6).alias("bits"))


SQL_UNE = f"""
{SQL_VALIDATION}, {sql_symbols('valid')},
bits AS (SELECT sum(n)::BIGINT AS symbols, sum(-n * log2(n / total)) AS bits FROM symbols, {TOTAL}),
tokens AS (SELECT sum(least(length(text), {SIZE}))::BIGINT AS tokens FROM valid)"""


@query("une", f"""
WITH {SQL_UNE}
SELECT event_id, event_type AS run, round(value / ln(2) * tokens / bits, 6) AS une
FROM events, bits, tokens
""")
def une(t):
    """Event values as mean losses, scaled by the validation set."""
    rows = validation.validation_set(t.documents, mark=".")
    bits = validation.validation_bits(rows)
    mask = rows.select(A.attention_mask(T.code_points(F.col("text")), SIZE).alias("attention_mask"))
    tokens = metrics.token_total(mask)
    value = metrics.une(F.col("value"), tokens.scalar(), bits.select("bits").scalar())
    return t.events.select("event_id", F.col("event_type").alias("run"), F.round(value, 6).alias("une"))


@query("per_token_ratio", f"""
WITH {SQL_UNE}
SELECT event_type AS run,
       round(max(value) / ln(2) * any_value(tokens) / any_value(bits) * any_value(symbols) / any_value(tokens), 6) AS ratio
FROM events, bits, tokens GROUP BY event_type
""")
def per_token_ratio(t):
    rows = validation.validation_set(t.documents, mark=".")
    bits = validation.validation_bits(rows)
    tokens = rows.agg(F.sum(F.least(F.length("text"), F.lit(SIZE)))).scalar()
    symbols, all_bits = bits.select("symbols").scalar(), bits.select("bits").scalar()
    ratio = metrics.per_token_ratio(metrics.une(F.col("loss"), tokens, all_bits), symbols, tokens)
    worst = t.events.groupBy(F.col("event_type").alias("run")).agg(F.max("value").alias("loss"))
    return worst.select("run", F.round(ratio, 6).alias("ratio"))


SQL_NLL = f"""
{sql_symbols('documents')},
cells AS (
  SELECT doc_id, c, count(*) AS n
  FROM (SELECT doc_id, unnest(string_split(text, '')) AS c FROM documents) GROUP BY doc_id, c
),
stats AS (
  SELECT doc_id, sum(-cells.n * ln(symbols.n / total)) AS nats, sum(cells.n) AS tokens,
         sum(cells.n * octet_length(encode(c))) AS n_bytes
  FROM cells JOIN symbols ON token = c, {TOTAL} GROUP BY doc_id
),
batched AS (
  SELECT s.*, b.batch FROM stats s JOIN (
    SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 16 AS batch FROM documents) b USING (doc_id)
)"""


@query("bits_per_byte", f"""
WITH {SQL_NLL}
SELECT round(avg(per_token * tokens / n_bytes), 6) AS bits_per_byte,
       round(sum(nats) / ln(2) / sum(n_bytes), 6) AS micro_bits_per_byte
FROM (SELECT batch, avg(nats / ln(2) / tokens) AS per_token, sum(tokens) AS tokens, sum(n_bytes) AS n_bytes,
             sum(nats) AS nats FROM batched GROUP BY batch)
""")
def bits_per_byte(t):
    """The unigram model's own bits per byte on the documents, batches of 16."""
    model = metrics.unigram_model(t.documents)
    stats = t.documents.select(
        "doc_id", metrics.text_nll(F.col("text"), model).alias("nats"),
        F.length("text").alias("tokens"), F.octet_length("text").alias("n_bytes"),
    )
    stats = metrics.batch_id(stats, 16)
    result = metrics.bits_per_byte(stats)
    return result.select(*[F.round(c, 6).alias(c) for c in result.columns])


@query("sequence_stats", f"""
WITH {SQL_NLL}
SELECT doc_id, round(nats, 4) AS nats, tokens::BIGINT AS tokens, n_bytes::BIGINT AS n_bytes FROM stats
""")
def sequence_stats(t):
    """The same per document from rows (document, character, count): a join in place
    of the table in a literal."""
    model = metrics.unigram_model(t.documents).select("token", (-F.log("p")).alias("nll"))
    cells = t.documents.select("doc_id", F.explode(T.char_tokens(F.col("text"))).alias("token"))
    rows = cells.groupBy("doc_id", "token").agg(F.count("*").alias("n")).join(model, "token")
    rows = rows.withColumn("n_bytes", F.octet_length("token"))
    stats = metrics.sequence_stats(rows, ["doc_id"], weight="n")
    return stats.withColumn("nats", F.round("nats", 4))


@query("accuracy", """
SELECT lang, sum((quality = 1 - toxic)::INTEGER)::BIGINT AS correct, count(*) AS total,
       round(avg((quality = 1 - toxic)::INTEGER), 6) AS accuracy
FROM labels JOIN documents USING (doc_id) GROUP BY lang
""")
def accuracy(t):
    rows = t.labels.join(t.documents.select("doc_id", "lang"), "doc_id").withColumn(
        "guess", 1 - F.col("toxic")
    )
    return metrics.accuracy(rows, "guess", "quality", "lang").withColumn(
        "accuracy", F.round("accuracy", 6)
    )


@query("batch_id", """
SELECT doc_id, ((row_number() OVER (ORDER BY doc_id) - 1) // 64)::BIGINT AS batch FROM documents
""")
def batch_id(t):
    return metrics.batch_id(t.documents.select("doc_id"), 64)


@query("argmax", """
SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::BIGINT AS best FROM embeddings
""")
def argmax(t):
    return t.embeddings.select("vec_id", A.argmax(F.col("embedding")).alias("best"))


@query("softmax", """
SELECT vec_id, generate_subscripts(s, 1) - 1 AS i, round(unnest(s), 6) AS p FROM (
  SELECT vec_id, list_transform(e, lambda x: exp(x) / list_sum(list_transform(e, lambda y: exp(y)))) AS s
  FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings))
""")
def softmax(t):
    rows = t.embeddings.select("vec_id", F.posexplode(A.softmax(F.col("embedding"))).alias("i", "p"))
    return rows.withColumn("p", F.round("p", 6))


@query("centered_log", """
SELECT vec_id, generate_subscripts(s, 1) - 1 AS i, round(unnest(s), 6) AS x FROM (
  SELECT vec_id, list_transform(l, lambda x: x - list_avg(l)) AS s
  FROM (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: ln(greatest(x, 1e-10))) AS l FROM embeddings))
""")
def centered_log(t):
    rows = t.embeddings.select("vec_id", F.posexplode(A.centered_log(F.col("embedding"))).alias("i", "x"))
    return rows.withColumn("x", F.round("x", 6))


@query("token_nll", """
SELECT vec_id, round(ln(list_sum(list_transform(e, lambda x: exp(x)))) - e[label + 1], 6) AS nll
FROM (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)
""")
def token_nll(t):
    return t.embeddings.select(
        "vec_id", F.round(A.token_nll(F.col("embedding"), F.col("label")), 6).alias("nll")
    )


@query("bytes_of", """
SELECT token, octet_length(encode(token))::BIGINT AS n_bytes, count(*) AS n
FROM (SELECT unnest(string_split(text, '')) AS token FROM documents) GROUP BY token
""")
def bytes_of(t):
    chars = t.documents.select(F.explode(T.char_tokens(F.col("text"))).alias("token"))
    return chars.groupBy("token").agg(F.count("*").alias("n")).select(
        "token", F.octet_length("token").alias("n_bytes"), "n"
    )


@query("compare_tokenizers", f"""
WITH {SQL_VALIDATION}, {sql_symbols('valid')},
bits AS (SELECT sum(n)::BIGINT AS symbols, sum(-n * log2(n / total)) AS bits FROM symbols, {TOTAL}),
counts AS (
  SELECT 'character' AS tokenizer, sum(least(length(text), {SIZE}))::BIGINT AS tokens FROM valid
  UNION ALL SELECT 'byte', sum(least(octet_length(encode(text)), {SIZE}))::BIGINT FROM valid
), losses AS (SELECT CASE WHEN event_type IN ('click', 'view') THEN 'character' ELSE 'byte' END AS tokenizer,
                     avg(value) AS loss FROM events GROUP BY 1)
SELECT tokenizer, tokens, round(loss / ln(2) * tokens / bits, 6) AS une,
       round(loss / ln(2) * symbols / bits, 6) AS per_token
FROM counts JOIN losses USING (tokenizer), bits
""")
def compare_tokenizers(t):
    """Characters and bytes on the validation set; event values stand in for losses."""
    rows = validation.validation_set(t.documents, mark=".")
    forms = {"character": T.code_points(F.col("text")), "byte": encode.byte_ids(F.col("text"))}
    counts = compare.encode_all(rows, forms, SIZE)
    name = F.when(F.col("event_type").isin("click", "view"), "character").otherwise("byte")
    loss = t.events.groupBy(name.alias("tokenizer")).agg(F.avg("value").alias("loss"))
    result = compare.compare_tokenizers(counts, loss, validation.validation_bits(rows))
    return result.withColumn("une", F.round("une", 6)).withColumn("per_token", F.round("per_token", 6))
