"""Encoding texts as ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from glyphmill.functions import arrays as A, text as T
from glyphmill.operators import encode, metrics, runs
from glyphmill.plans import compare, tokenizers
from glyphmill.session import materialize

from .registry import SQL_RANK_OF_CHARS, joined, query, sql_bytes, sql_strip
from .vocab import SQL_VOCAB, char_vocab

SIZE = 1024


def byte_rows(t):
    return t.documents.select("doc_id", encode.byte_ids(F.col("text")).alias("ids"))


# (doc_id, ids) with the byte ids of each document.
SQL_BYTE_ROWS = f"""
byte_rows AS (
  SELECT doc_id, list_transform({sql_bytes('text')}, lambda b: b + 4) AS ids FROM documents
)"""
SQL_PADDED = f"list_slice(list_concat(ids, list_transform(range({SIZE}), lambda x: 0)), 1, {SIZE})"
SQL_MASK = f"list_transform(range({SIZE}), lambda x: CASE WHEN x < len(ids) THEN 1 ELSE 0 END)"


@query("char_tokens", """
SELECT doc_id, array_to_string(string_split(text, ''), '|') AS tokens FROM documents
""")
def char_tokens(t):
    return t.documents.select("doc_id", joined(T.char_tokens(F.col("text")), "|").alias("tokens"))


@query("byte_tokens", f"""
WITH {SQL_BYTE_ROWS} SELECT doc_id, array_to_string(ids, ' ') AS ids FROM byte_rows
""")
def byte_tokens(t):
    return byte_rows(t).withColumn("ids", joined(F.col("ids")))


@query("byte_tokens_of_pages", f"""
SELECT page_id, array_to_string(list_transform({sql_bytes('html')}, lambda b: b + 4), ' ') AS ids
FROM pages
""")
def byte_tokens_of_pages(t):
    return t.pages.select("page_id", joined(encode.byte_ids(F.col("html"))).alias("ids"))


@query("bytes_to_text", "SELECT doc_id, text FROM documents")
def bytes_to_text(t):
    """Decoding the encoded text gives the text."""
    return byte_rows(t).select("doc_id", encode.bytes_from_ids(F.col("ids")).alias("text"))


@query("byte_alphabet", f"""
WITH {SQL_BYTE_ROWS}, alphabet AS (
  SELECT token, id FROM (VALUES ('<pad>', 0), ('<s>', 1), ('</s>', 2), ('<unk>', 3)) v(token, id)
  UNION ALL SELECT CASE WHEN range = 0 THEN chr(0) ELSE chr(range::INTEGER) END, range + 4 FROM range(256)
)
SELECT a.token, a.id::BIGINT AS id, coalesce(u.n, 0)::BIGINT AS n
FROM alphabet a
LEFT JOIN (SELECT id, count(*) AS n FROM (SELECT unnest(ids) AS id FROM byte_rows) GROUP BY id) u USING (id)
""")
def byte_alphabet(t):
    """The 260 byte tokens with their use in the documents."""
    used = byte_rows(t).select(F.explode("ids").alias("id")).groupBy(F.col("id").cast("bigint").alias("id")).agg(
        F.count("*").alias("n")
    )
    return encode.byte_alphabet(t.spark).join(used, "id", "left").select(
        "token", "id", F.coalesce("n", F.lit(0)).alias("n")
    )


@query("latin1_text", f"""
SELECT doc_id, array_to_string(list_transform({sql_bytes('text')}, lambda b: chr(b::INTEGER)), '') AS text
FROM documents
""")
def latin1_text(t):
    return t.documents.select("doc_id", T.latin1_text(F.col("text")).alias("text"))


@query("pad_truncate", f"""
WITH {SQL_BYTE_ROWS}
SELECT doc_id, array_to_string({SQL_PADDED}, ' ') AS ids,
       greatest(len(ids) - {SIZE}, 0)::BIGINT AS n_cut
FROM byte_rows
""")
def pad_truncate(t):
    ids = F.col("ids")
    return byte_rows(t).select(
        "doc_id", joined(A.pad_truncate(ids, SIZE, 0)).alias("ids"), A.cut_count(ids, SIZE).alias("n_cut")
    )


@query("attention_mask", f"""
WITH {SQL_BYTE_ROWS} SELECT doc_id, array_to_string({SQL_MASK}, '') AS mask FROM byte_rows
""")
def attention_mask(t):
    return byte_rows(t).select("doc_id", joined(A.attention_mask(F.col("ids"), SIZE), "").alias("mask"))


@query("labels_copy", f"""
WITH {SQL_BYTE_ROWS}
SELECT doc_id, array_to_string({SQL_PADDED}, ' ') AS labels,
       array_to_string(list_transform({SQL_PADDED}, lambda x: CASE WHEN x = 0 THEN -100 ELSE x END), ' ')
         AS masked_labels
FROM byte_rows
""")
def labels_copy(t):
    padded, mask = A.pad_truncate(F.col("ids"), SIZE, 0), A.attention_mask(F.col("ids"), SIZE)
    return byte_rows(t).select(
        "doc_id", joined(A.labels_copy(padded)).alias("labels"),
        joined(A.labels_copy(padded, mask)).alias("masked_labels"),
    )


@query("pad_to_longest", f"""
WITH {SQL_BYTE_ROWS}, batches AS (
  SELECT doc_id, ids, (row_number() OVER (ORDER BY doc_id) - 1) // 16 AS batch FROM byte_rows
), longest AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch) AS top FROM batches)
SELECT doc_id, batch::BIGINT AS batch, top::BIGINT AS size,
       array_to_string(list_concat(ids, list_transform(range(top - len(ids)), lambda x: 0)), ' ') AS ids
FROM longest
""")
def pad_to_longest(t):
    sizes = metrics.batch_id(t.documents.select("doc_id", F.octet_length("text").alias("size")), 16)
    rows = t.documents.select("doc_id", "text").join(encode.longest_of_batch(sizes, "size", "batch"), "doc_id")
    padded = encode.pad_to(rows.withColumn("ids", encode.byte_ids(F.col("text"))), "ids", F.col("longest"), 0)
    return padded.select(
        "doc_id", "batch", F.size("input_ids").alias("size"), joined(F.col("input_ids")).alias("ids")
    )


@query("wrap_specials", f"""
WITH {SQL_BYTE_ROWS}
SELECT doc_id, array_to_string(list_concat([1], ids, [2]), ' ') AS ids FROM byte_rows
""")
def wrap_specials(t):
    return byte_rows(t).withColumn("ids", joined(A.wrap_specials(F.col("ids"), 1, 2)))


@query("prepend_start", f"""
SELECT a.conv_id, a.turn,
       array_to_string(list_concat([1], {sql_bytes('a.text')}, [1], {sql_bytes('b.text')}), ' ') AS with_start,
       array_to_string(list_concat({sql_bytes('a.text')}, {sql_bytes('b.text')}), ' ') AS without_start
FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
""")
def prepend_start(t):
    """Neighbouring turns as two sequences."""
    a = t.conversations.select("conv_id", "turn", F.col("text").alias("a"))
    b = t.conversations.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("b"))
    # Texts are joined, and encoded where they meet.
    first, second = T.byte_tokens(F.col("a")), T.byte_tokens(F.col("b"))
    return a.join(b, ["conv_id", "turn"]).select(
        "conv_id", "turn",
        joined(A.prepend_start(first, second, 1)).alias("with_start"),
        joined(A.prepend_start(first, second)).alias("without_start"),
    )


@query("drop_columns", f"""
WITH {SQL_BYTE_ROWS}
SELECT doc_id, lang, source, n_chars, sum(x)::BIGINT AS mask_sum
FROM (SELECT doc_id, unnest({SQL_MASK}) AS x FROM byte_rows) JOIN documents USING (doc_id)
GROUP BY doc_id, lang, source, n_chars
""")
def drop_columns(t):
    """Encoding keeps the other columns and drops the text."""
    tokenizer = tokenizers.ByteTokenizer(tokenizers.TokenizerConfig("ByteTokenizer", SIZE))
    encoded = tokenizer.transform(t.documents).drop("text")
    return encoded.withColumn("mask_sum", A.total(F.col("attention_mask"))).drop(
        "input_ids", "attention_mask", "labels", "n_cut"
    )


@query("token_total", f"""
SELECT 'byte' AS tokenizer, sum(least(octet_length(encode(text)), {SIZE}))::BIGINT AS tokens FROM documents
UNION ALL
SELECT 'character', sum(least(length(text), {SIZE}))::BIGINT FROM documents
""")
def token_total(t):
    docs = t.documents.select("doc_id", "text")
    masks = [
        docs.select(F.lit(name).alias("tokenizer"), A.attention_mask(ids, SIZE).alias("attention_mask"))
        for name, ids in [("byte", encode.byte_ids(F.col("text"))),
                          ("character", T.code_points(F.col("text")))]
    ]
    return metrics.token_total(compare.union_all(masks), by="tokenizer")


@query("token_total_wide", f"""
SELECT sum(least(octet_length(encode(text)), {SIZE}))::BIGINT AS "byte",
       sum(least(length(text), {SIZE}))::BIGINT AS "character" FROM documents
""")
def token_total_wide(t):
    """The totals as one wide row."""
    forms = {"character": T.code_points(F.col("text")), "byte": encode.byte_ids(F.col("text"))}
    counts = compare.encode_all(t.documents.select("doc_id", "text"), forms, SIZE)
    totals = counts.groupBy("tokenizer").agg(F.sum("tokens").alias("tokens"))
    return runs.pivot_row(materialize(totals, "totals"), "tokenizer", "tokens")


@query("character_vocab", f"""
WITH {SQL_VOCAB} SELECT token, id::BIGINT AS id FROM vocab
""")
def character_vocab(t):
    """Built through the tokenizer object."""
    return _character_tokenizer(t).vocabulary(t.spark)


def _character_tokenizer(t):
    """A tokenizer that opens a vocabulary made before."""
    config = tokenizers.TokenizerConfig("CharacterTokenizer", SIZE)
    return tokenizers.CharacterTokenizer(config).load(materialize(char_vocab(t), "vocab"))


@query("character_encode", f"""
WITH {SQL_VOCAB}, rows AS (
  SELECT doc_id, list(coalesce(v.id, 0) ORDER BY i) AS ids
  FROM chars LEFT JOIN vocab v ON v.token = c GROUP BY doc_id
)
SELECT doc_id, array_to_string(list_slice(list_concat(ids, list_transform(range({SIZE}), lambda x: 3)), 1, {SIZE}), ' ') AS input_ids,
       least(len(ids), {SIZE})::BIGINT AS tokens, greatest(len(ids) - {SIZE}, 0)::BIGINT AS n_cut
FROM rows
""")
def character_encode(t):
    rows = _character_tokenizer(t).transform(t.documents.select("doc_id", "text"))
    return rows.select(
        "doc_id", joined(F.col("input_ids")).alias("input_ids"),
        A.total(F.col("attention_mask")).alias("tokens"), "n_cut",
    )


# The vocabulary of the documents up to the one where the distinct characters reach 75.
SQL_CAPPED = """
all_chars AS (
  SELECT doc_id, generate_subscripts(cs, 1) - 1 AS i, unnest(cs) AS c
  FROM (SELECT doc_id, string_split(text, '') AS cs FROM documents WHERE text <> '')
), fresh AS (
  SELECT doc_id, sum(count(*)) OVER (ORDER BY doc_id) AS seen
  FROM (SELECT c, min(doc_id) AS doc_id FROM all_chars GROUP BY c) GROUP BY doc_id
), chars AS (
  SELECT * FROM all_chars
  WHERE doc_id <= coalesce((SELECT min(doc_id) FROM fresh WHERE seen >= 75), doc_id)
)"""


@query("character_vocab_capped", f"""
WITH {SQL_CAPPED}, {SQL_RANK_OF_CHARS}
SELECT '<pad>' AS token, 0::BIGINT AS id
UNION ALL SELECT token, rank + 1 FROM ranked WHERE rank < 74
UNION ALL SELECT token, k + (SELECT least(count(*), 74) + 1 FROM ranked)
FROM (VALUES ('<unk>', 0), ('<s>', 1), ('</s>', 2)) v(token, k)
""")
def character_vocab_capped(t):
    """The whole job: capped reading, counting, ranking, numbering."""
    config = {"name": "CharacterTokenizer", "max_vocab_size": 75, "max_examples": "",
              "special_tokens": {"pad_token": "<pad>"}}
    tokenizer = tokenizers.tokenizer_from_config(config, SIZE)
    return tokenizer.fit(t.documents).vocabulary(t.spark)


@query("byte_encode", f"""
WITH {SQL_BYTE_ROWS}
SELECT doc_id, array_to_string({SQL_PADDED}, ' ') AS input_ids,
       array_to_string({SQL_MASK}, '') AS attention_mask, greatest(len(ids) - {SIZE}, 0)::BIGINT AS n_cut
FROM byte_rows
""")
def byte_encode(t):
    tokenizer = tokenizers.tokenizer_from_config(
        {"name": "ByteTokenizer", "max_vocab_size": "", "special_tokens": ""}, SIZE
    )
    rows = tokenizer.fit(t.documents).transform(t.documents.select("doc_id", "text"))
    return rows.select(
        "doc_id", joined(F.col("input_ids")).alias("input_ids"),
        joined(F.col("attention_mask"), "").alias("attention_mask"), "n_cut",
    )


@query("line_dataset", f"""
WITH {SQL_VOCAB}, lines AS (
  SELECT conv_id, turn, generate_subscripts(ls, 1) AS k, unnest(ls) AS line
  FROM (SELECT conv_id, turn, string_split(text, chr(10)) AS ls FROM conversations)
), cells AS (
  SELECT conv_id, turn, k, generate_subscripts(cs, 1) AS i, unnest(cs) AS c
  FROM (SELECT conv_id, turn, k, string_split({sql_strip('line')}, '') AS cs FROM lines)
), rows AS (
  SELECT conv_id, turn, k, list(coalesce(v.id, 0) ORDER BY i) AS ids
  FROM cells LEFT JOIN vocab v ON v.token = c WHERE c <> '' GROUP BY conv_id, turn, k
)
SELECT conv_id, turn, k::BIGINT AS k,
       array_to_string(list_slice(list_concat(ids, list_transform(range(128), lambda x: 3)), 1, 128), ' ') AS input_ids,
       least(len(ids), 128)::BIGINT AS tokens
FROM (SELECT conv_id, turn, k, coalesce(ids, []) AS ids FROM lines LEFT JOIN rows USING (conv_id, turn, k))
""")
def line_dataset(t):
    lines = t.conversations.select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("k", "text"))
    lines = lines.withColumn("k", F.col("k") + 1)
    rows = encode.line_dataset(lines, char_vocab(t), 128, 3)
    return rows.select(
        "conv_id", "turn", "k", joined(F.col("input_ids")).alias("input_ids"),
        A.total(F.col("attention_mask")).alias("tokens"),
    )
