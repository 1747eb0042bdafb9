"""Counting, ranking and numbering tokens."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from glyphmill.functions import text as T
from glyphmill.operators import repack, vocab
from glyphmill.session import scratch_path
from glyphmill.sources import readers, writers

from .registry import SQL_CHARS, SQL_RANK_OF_CHARS, SQL_RANKED, query, sql_bytes

SPECIALS = ["<unk>", "<s>", "</s>", "<pad>", "e", "<s>"]
VOCAB_CAP = 64
# The same, as SQL: distinct specials in order, then other characters by rank.
SQL_VOCAB = SQL_RANKED + f""",
vocab AS (
  SELECT token, id FROM (VALUES ('<unk>', 0), ('<s>', 1), ('</s>', 2), ('<pad>', 3), ('e', 4)) v(token, id)
  UNION ALL
  SELECT token, row_number() OVER (ORDER BY rank) + 4 AS id FROM ranked WHERE token <> 'e'
  QUALIFY id < {VOCAB_CAP}
)"""
# (token, n, first_doc, first_pos, rank) of all words.
WORD = r"[^ \n]+"
SQL_WORDS = r"""
words AS (
  SELECT doc_id, generate_subscripts(ws, 1) - 1 AS i, unnest(ws) AS w
  FROM (SELECT doc_id, regexp_extract_all(text, '[^ \n]+') AS ws FROM documents)
),
word_firsts AS (
  SELECT w AS token, count(*) AS n, min(doc_id) AS first_doc FROM words GROUP BY w
),
ranked_words AS (
  SELECT token, n, first_doc, first_pos,
         row_number() OVER (ORDER BY n DESC, first_doc, first_pos) - 1 AS rank
  FROM (SELECT f.token, f.n, f.first_doc, min(x.i) AS first_pos
        FROM word_firsts f JOIN words x ON x.w = f.token AND x.doc_id = f.first_doc
        GROUP BY f.token, f.n, f.first_doc)
)"""


def words():
    return F.regexp_extract_all("text", F.lit(WORD), F.lit(0))


def ranked_chars(t):
    return vocab.ranked_tokens(t.documents.select("doc_id", "text"))


def char_vocab(t):
    return vocab.assign_ids(SPECIALS, ranked_chars(t), VOCAB_CAP)


@query("char_counts", f"WITH {SQL_CHARS} SELECT c AS token, count(*) AS n FROM chars GROUP BY c")
def char_counts(t):
    return vocab.char_counts(t.documents)


@query("token_counts", f"""
SELECT token, count(*) AS n FROM (SELECT unnest({sql_bytes('text')}) AS token FROM documents)
GROUP BY token
""")
def token_counts(t):
    """Counts of byte tokens."""
    return vocab.token_counts(t.documents, T.byte_tokens(F.col("text")))


@query("distinct_chars", f"""
WITH {SQL_CHARS}, firsts AS (
  SELECT doc_id, i, c, row_number() OVER (ORDER BY doc_id, i) AS k
  FROM (SELECT c, min(doc_id) AS doc_id FROM chars GROUP BY c) JOIN
       (SELECT c, doc_id, min(i) AS i FROM chars GROUP BY c, doc_id) USING (c, doc_id)
)
SELECT c AS token, doc_id AS first_doc, i AS first_pos FROM firsts
WHERE doc_id <= coalesce((SELECT doc_id FROM firsts WHERE k = 61), (SELECT max(doc_id) FROM firsts))
""")
def distinct_chars(t):
    return vocab.distinct_chars(t.documents, 60)


@query("frequency_rank", f"""
WITH {SQL_RANKED} SELECT token, n, first_doc, first_pos, rank FROM ranked
""")
def frequency_rank(t):
    return ranked_chars(t)


@query("word_frequency_rank", f"""
WITH {SQL_WORDS} SELECT token, n, first_doc, first_pos, rank FROM ranked_words
""")
def word_frequency_rank(t):
    """The same over words: an open set of tokens, a third of them seen once."""
    return vocab.ranked_tokens(t.documents, words())


@query("top_tokens", f"""
WITH {SQL_WORDS} SELECT token, n, first_doc, first_pos FROM ranked_words WHERE rank < 50
""")
def top_tokens(t):
    return vocab.top_tokens(vocab.counts_with_first(t.documents, words()), 50)


@query("assign_ids", f"WITH {SQL_VOCAB} SELECT token, id::BIGINT AS id FROM vocab")
def assign_ids(t):
    return char_vocab(t)


@query("specials_union_tokens", f"""
WITH {SQL_RANKED}
SELECT token, min(k)::BIGINT AS id FROM (
  SELECT token, k FROM (VALUES ('<s>', 0), ('<pad>', 1), ('</s>', 2), ('<unk>', 3), ('<mask>', 4)) v(token, k)
  UNION ALL
  SELECT token, row_number() OVER (ORDER BY first_doc, first_pos) + 4 FROM ranked)
GROUP BY token
""")
def specials_union_tokens(t):
    """Ordered union: five specials, then all characters by first appearance."""
    found = vocab.distinct_chars(t.documents)
    order = F.struct("first_doc", "first_pos")
    # One row per code point at most: the window is bounded.
    ranked = found.withColumn("rank", F.row_number().over(Window.orderBy(order)) - 1)
    return vocab.assign_ids(["<s>", "<pad>", "</s>", "<unk>", "<mask>"], ranked, 0x110000)


@query("cap_documents", f"""
WITH {SQL_CHARS}, early AS (SELECT * FROM chars WHERE doc_id IN (
  SELECT doc_id FROM documents ORDER BY doc_id LIMIT 400)),
fresh AS (
  SELECT doc_id, sum(count(*)) OVER (ORDER BY doc_id) AS seen
  FROM (SELECT c, min(doc_id) AS doc_id FROM early GROUP BY c) GROUP BY doc_id
)
SELECT doc_id, length(text)::BIGINT AS n_chars FROM documents
WHERE doc_id <= coalesce((SELECT min(doc_id) FROM fresh WHERE seen >= 75),
                         (SELECT max(doc_id) FROM early))
""")
def cap_documents(t):
    kept = vocab.cap_documents(t.documents.select("doc_id", "text"), 75, 400)
    return kept.select("doc_id", F.length("text").alias("n_chars"))


@query("vocab_with_added", f"""
WITH {SQL_VOCAB}, added AS (
  SELECT token, n + 1000 AS id FROM ranked WHERE regexp_matches(token, '[A-Z]')
)
SELECT token, id::BIGINT AS id FROM added
UNION ALL
SELECT token, id::BIGINT FROM vocab WHERE token NOT IN (SELECT token FROM added)
""")
def vocab_with_added(t):
    added = ranked_chars(t).where(F.col("token").rlike("[A-Z]")).select(
        "token", (F.col("n") + 1000).alias("id")
    )
    return vocab.vocab_with_added(char_vocab(t), added)


# Characters of the conversations against the documents' vocabulary.
SQL_OTHER = f"""{SQL_VOCAB},
other AS (
  SELECT token, count(*) AS n
  FROM (SELECT unnest(string_split(text, '')) AS token FROM conversations) GROUP BY token
)"""


@query("membership", f"""
WITH {SQL_OTHER}
SELECT o.token, o.n, coalesce(v.token, '<unk>') AS known
FROM other o LEFT JOIN vocab v ON o.token = v.token
""")
def membership(t):
    return vocab.membership(vocab.char_counts(t.conversations), char_vocab(t))


@query("tokens_to_ids", f"""
WITH {SQL_OTHER}
SELECT o.token, o.n, coalesce(v.id, 0)::BIGINT AS id
FROM other o LEFT JOIN vocab v ON o.token = v.token
""")
def tokens_to_ids(t):
    return vocab.tokens_to_ids(vocab.char_counts(t.conversations), char_vocab(t))


@query("ids_to_tokens", f"""
WITH {SQL_VOCAB}
SELECT label::BIGINT * 13 AS id, count(*) AS n, coalesce(any_value(v.token), '<unk>') AS token
FROM embeddings LEFT JOIN vocab v ON label * 13 = v.id GROUP BY label
""")
def ids_to_tokens(t):
    ids = t.embeddings.groupBy((F.col("label") * 13).cast("bigint").alias("id")).agg(
        F.count("*").alias("n")
    )
    return vocab.ids_to_tokens(ids, char_vocab(t))


@query("covered_chars", f"""
WITH {SQL_CHARS}, counted AS (SELECT c AS token, count(*) AS n FROM chars GROUP BY c),
spread AS (
  SELECT token, n, coalesce(sum(n) OVER (ORDER BY n DESC, token
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_it,
         sum(n) OVER () AS total
  FROM counted
)
SELECT token, n FROM spread WHERE before_it < 0.9995 * total
""")
def covered_chars(t):
    return vocab.covered_chars(vocab.char_counts(t.documents), 0.9995)


@query("assign_byte_codes", f"""
WITH {SQL_WORDS},
codes AS (
  SELECT token, rank FROM ranked_words
  UNION ALL SELECT '<unk>', count(*) FROM ranked_words
)
SELECT token, rank,
       hex(encode(chr((32 + rank + CASE WHEN 32 + rank >= 55296 THEN 2048 ELSE 0 END)::INTEGER))) AS code
FROM codes
""")
def assign_byte_codes(t):
    """Byte codes of every word by rank."""
    coded = repack.assign_byte_codes(vocab.ranked_tokens(t.documents, words()))
    return coded.withColumn(
        "code", F.array_join(F.transform("code", lambda b: F.lpad(F.hex(b), 2, "0")), "")
    )


@query("vocab_round_trip", f"WITH {SQL_VOCAB} SELECT token, id::BIGINT AS id FROM vocab")
def vocab_round_trip(t):
    """Written as one JSON object and read back."""
    path = scratch_path(t.spark, "vocab") + ".json"
    writers.write_vocab(char_vocab(t), path)
    return readers.read_vocab(t.spark, path)


@query("remap_round_trip", f"""
WITH {SQL_RANKED}, codes AS (
  SELECT token, rank FROM ranked UNION ALL SELECT '<unk>', count(*) FROM ranked)
SELECT token, rank, hex(encode(chr((32 + rank)::INTEGER))) AS code FROM codes
""")
def remap_round_trip(t):
    path = scratch_path(t.spark, "remap")
    writers.write_remap(repack.assign_byte_codes(ranked_chars(t)), path)
    read = readers.read_remap(t.spark, path)
    return read.withColumn(
        "code", F.array_join(F.transform("code", lambda b: F.lpad(F.hex(b), 2, "0")), "")
    )


@query("apply_remap", f"""
WITH chars AS (
  SELECT doc_id, generate_subscripts(cs, 1) - 1 AS i, unnest(cs) AS c
  FROM (SELECT item_id AS doc_id, string_split(text, '') AS cs FROM benchmark WHERE text <> '')
), {SQL_RANK_OF_CHARS}, codes AS (
  SELECT token, rank FROM ranked UNION ALL SELECT '<unk>', count(*) FROM ranked),
other AS (
  SELECT token, count(*) AS n
  FROM (SELECT unnest(string_split(text, '')) AS token FROM documents) GROUP BY token)
SELECT o.token, o.n,
       hex(encode(chr((32 + coalesce(c.rank, (SELECT rank FROM codes WHERE token = '<unk>')))::INTEGER))) AS code
FROM other o LEFT JOIN codes c ON o.token = c.token
""")
def apply_remap(t):
    """Codes learned on the benchmark, given to the documents' characters; those the
    benchmark lacks get the unknown mark's."""
    texts = t.benchmark.select(F.col("item_id").alias("doc_id"), "text")
    remap = repack.assign_byte_codes(vocab.ranked_tokens(texts))
    coded = repack.apply_remap(vocab.char_counts(t.documents), remap)
    return coded.withColumn(
        "code", F.array_join(F.transform("code", lambda b: F.lpad(F.hex(b), 2, "0")), "")
    )
