"""Merged vocabularies and re-coded tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from glyphmill.operators import merges, vocab
from glyphmill.plans import compare, tokenizers, validation

from glyphmill.session import scratch_path

from .codes import SQL_DICT, entries
from .registry import SQL_VALIDATION, joined, query, sql_bytes, sql_symbols

TOKENS = 200
FIRST = merges.FIRST_JOINED
SPECIALS = ["<unk>", "<s>", "</s>", "<pad>"]

SQL_WORD_PIECES = r"""
pieces AS (
  SELECT piece, count(*) AS n
  FROM (SELECT '▁' || unnest(regexp_extract_all(text, '[^ \n]+')) AS piece FROM source)
  GROUP BY piece
)"""
SQL_STATE = "'<' || array_to_string(list_transform(string_split({0}, ''), lambda c: unicode(c)), '><') || '>'"


def sql_pairs(state: str) -> str:
    """(l, r, n): neighbouring symbols of a (s, n) relation."""
    return f"""
  SELECT p[1] AS l, p[2] AS r, sum(n)::BIGINT AS n
  FROM (SELECT unnest(list_zip(x[:-2], x[2:])) AS p, n
        FROM (SELECT list_transform(string_split(substring(s, 2, length(s) - 2), '><'), lambda v: v::BIGINT) AS x, n
              FROM {state}))
  GROUP BY l, r"""


def sql_training(tokens: int = TOKENS, min_count: int = 1) -> str:
    """Merges one at a time until there are so many new tokens; needs `pieces`. Gives text_of (id, txt)
    of the new tokens, merge_list (rank, l, r, id, n) and merge_steps, a list of `old new`.

    One table holds all that changes: pieces (p), pair counts (c), new tokens (v), merges (m). A round
    takes the best pair and replaces the pieces that hold it and the counts that they change.
    """
    pair = "'<' || l || '><' || r || '>'"
    text = lambda x: (
        f"coalesce((SELECT s FROM recurring.train WHERE kind = 'v' AND a = {x}), chr(least({x}, 1114111)::INTEGER))"
    )
    known = "(SELECT min(a) FROM recurring.train WHERE kind = 'v' AND s = txt)"
    fresh = f"{FIRST} + (SELECT count(*) FROM recurring.train WHERE kind = 'v')"
    start = f"(SELECT {SQL_STATE.format('piece')} AS s, n FROM pieces WHERE length(piece) > 1)"
    return f"""
train(kind, a, b, s, n) USING KEY (kind, a, b) AS (
  SELECT 'p', row_number() OVER (), 0::BIGINT, s, n::BIGINT FROM {start}
  UNION ALL SELECT 'c', l, r, '', n FROM ({sql_pairs(start)})
  UNION (
    WITH best AS MATERIALIZED (
      SELECT a AS l, b AS r, n FROM recurring.train WHERE kind = 'c' AND n >= {min_count} ORDER BY n DESC, a, b LIMIT 1
    ), spelled AS MATERIALIZED (
      SELECT *, {text('l')} || {text('r')} AS txt FROM best
      WHERE (SELECT count(*) FROM recurring.train WHERE kind = 'v') < {tokens}
    ), chosen AS MATERIALIZED (
      SELECT *, coalesce({known}, {fresh}) AS id, {pair} AS old FROM spelled
    ), changed AS MATERIALIZED (
      SELECT t.a, t.s, replace(t.s, old, '<' || id || '>') AS new, t.n
      FROM recurring.train t, chosen WHERE t.kind = 'p' AND contains(t.s, old)
    ), moved AS MATERIALIZED (
      SELECT l, r, sum(n)::BIGINT AS n FROM (
        SELECT * FROM ({sql_pairs("(SELECT new AS s, n FROM changed WHERE contains(new, '><'))")})
        UNION ALL SELECT l, r, -n FROM ({sql_pairs("changed")}))
      GROUP BY l, r
    )
    SELECT 'p', a, 0, new, n FROM changed
    UNION ALL SELECT 'c', l, r, '', moved.n + coalesce(t.n, 0)
      FROM moved LEFT JOIN (SELECT * FROM recurring.train WHERE kind = 'c') t ON t.a = l AND t.b = r
    UNION ALL SELECT 'v', id, 0, txt, 0 FROM chosen
    UNION ALL SELECT 'm', (SELECT count(*) FROM recurring.train WHERE kind = 'm'), 0, l || ' ' || r || ' ' || id, n FROM chosen
  )
),
text_of AS (SELECT a AS id, s AS txt FROM train WHERE kind = 'v'),
merge_list AS (
  SELECT a AS rank, split_part(s, ' ', 1)::BIGINT AS l, split_part(s, ' ', 2)::BIGINT AS r, split_part(s, ' ', 3)::BIGINT AS id, n
  FROM train WHERE kind = 'm'
),
merge_steps AS (SELECT list({pair} || ' <' || id || '>' ORDER BY rank) AS steps FROM merge_list)"""


def sql_joined(state: str) -> str:
    """A state with all merges applied in order."""
    return (
        f"list_reduce(list_prepend({state}, (SELECT steps FROM merge_steps)), "
        "lambda s, m: replace(s, split_part(m, ' ', 1), split_part(m, ' ', 2)))"
    )


def sql_merge_table() -> str:
    side = lambda x: f"coalesce((SELECT txt FROM text_of WHERE id = {x}), chr(least({x}, 1114111)::INTEGER))"
    return f"""
SELECT rank::BIGINT AS rank, {side('l')} AS "left", {side('r')} AS "right", {side('l')} || {side('r')} AS token, n
FROM merge_list"""


def tokenizer(t, kind=tokenizers.MergedTokenizer, method: str = "", dictionary=None):
    config = tokenizers.TokenizerConfig(
        "", 512, 50_257, None, {"pad_token": "<pad>"}, input_method=method
    )
    return kind(config, dictionary=dictionary, merges=TOKENS)


@query("pair_counts", f"""
WITH source AS (SELECT text FROM documents), {SQL_WORD_PIECES},
state0 AS (SELECT {SQL_STATE.format('piece')} AS s, n FROM pieces)
SELECT l AS "left", r AS "right", n FROM ({sql_pairs('state0')})
""")
def pair_counts(t):
    """Weighted counts of neighbouring characters in words."""
    pieces = merges.piece_counts(t.documents, merges.words(F.col("text")), merges.WORD_MARK)
    return merges.pair_counts(merges.symbol_state(merges.spread(pieces)))


# The training text of the merged vocabularies. The coverage of 0.9995 leaves out the
# rarest characters.
SQL_LINES = """
source AS (
  SELECT unnest(string_split(text, chr(10))) AS text FROM documents
)"""
SQL_COVERED = """
piece_chars AS (
  SELECT c, sum(n) AS n FROM (SELECT unnest(string_split(piece, '')) AS c, n FROM pieces) GROUP BY c
), covered AS (
  SELECT c, n FROM (
    SELECT c, n, sum(n) OVER (ORDER BY n DESC, c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before_it,
           sum(n) OVER () AS total FROM piece_chars)
  WHERE coalesce(before_it, 0) < {0} * total
)"""


@query("merged_vocab_train", f"""
WITH RECURSIVE {SQL_LINES}, {SQL_WORD_PIECES}, {sql_training()}
{sql_merge_table()}
""")
def merged_vocab_train(t):
    """Merges over the words of the documents, until they have made 200 tokens. At these few the
    rare characters that the coverage leaves out take part in none."""
    return tokenizer(t).fit(t.documents).model.table(t.spark)


@query("merged_vocab", f"""
WITH RECURSIVE {SQL_LINES}, {SQL_WORD_PIECES}, {SQL_COVERED.format('0.9995')}, {sql_training()}
SELECT token, k::BIGINT AS id FROM (VALUES ('<unk>', 0), ('<s>', 1), ('</s>', 2), ('<pad>', 3)) v(token, k)
UNION ALL SELECT txt, id - {FIRST} + 4 FROM text_of
UNION ALL SELECT c, row_number() OVER (ORDER BY n DESC, c) + {TOKENS + 3} FROM covered
""")
def merged_vocab(t):
    """Ids: specials, merges, then the covered characters."""
    fitted = tokenizer(t).fit(t.documents)
    return fitted.vocabulary(t.spark)


SQL_MERGED_NUMBERS = f"""
numbers AS (
  SELECT id AS symbol, id - {FIRST} + 4 AS id FROM text_of
  UNION ALL SELECT unicode(c), row_number() OVER (ORDER BY n DESC, c) + {TOKENS + 3} FROM covered
)"""


def sql_encoded(text: str, key: str = "doc_id", table: str = "documents") -> str:
    """(key, i, id, token): units of each text in order. A word mark stands at the start of the text
    and for every run of spaces, nowhere else. Merged symbols and covered characters are units with
    an id; so is a run of other characters, without one."""
    return f"""
marked AS (
  SELECT {key}, generate_subscripts(w, 1) AS place, '▁' || unnest(w) AS word
  FROM (SELECT {key}, list_filter(string_split({text}, ' '), lambda w: w <> '') AS w FROM {table})
), formed AS (
  SELECT word, regexp_extract_all({sql_joined(SQL_STATE.format('word'))}, '[0-9]+') AS x
  FROM (SELECT DISTINCT word FROM marked)
), symbols AS (
  SELECT {key}, place, generate_subscripts(x, 1) AS j, unnest(x)::BIGINT AS symbol FROM marked JOIN formed USING (word)
), spelled AS (
  SELECT {key}, row_number() OVER ordered AS i, n.id, coalesce(t.txt, chr(least(symbol, 1114111)::INTEGER)) AS txt,
         coalesce(lag(n.id IS NULL) OVER ordered, false) AS after_unknown
  FROM symbols LEFT JOIN numbers n USING (symbol) LEFT JOIN text_of t ON t.id = symbol
  WINDOW ordered AS (PARTITION BY {key} ORDER BY place, j)
), encoded AS (
  SELECT {key}, unit AS i, any_value(id) AS id, string_agg(txt, '' ORDER BY i) AS token
  FROM (SELECT *, sum(CASE WHEN id IS NULL AND after_unknown THEN 0 ELSE 1 END)
                  OVER (PARTITION BY {key} ORDER BY i) AS unit FROM spelled)
  GROUP BY {key}, unit
)"""


@query("merged_encode", f"""
WITH RECURSIVE {SQL_LINES}, {SQL_WORD_PIECES}, {SQL_COVERED.format('0.9995')}, {sql_training()},
{SQL_MERGED_NUMBERS}, {sql_encoded('text')}
SELECT doc_id, string_agg(coalesce(id, 0)::VARCHAR, ' ' ORDER BY i) AS ids
FROM encoded GROUP BY doc_id
""")
def merged_encode(t):
    """The merged ids of every document."""
    fitted = tokenizer(t).fit(t.documents)
    return t.documents.select("doc_id", joined(fitted.ids(F.col("text"))).alias("ids"))


SQL_BYTE_SOURCE = f"""
latin AS (
  SELECT doc_id, array_to_string(list_transform({sql_bytes('text')}, lambda b: chr(b::INTEGER)), '') AS text
  FROM documents
), source AS (
  SELECT unnest(string_split(text, chr(10))) AS text FROM latin
)"""


@query("byte_merged", f"""
WITH RECURSIVE {SQL_BYTE_SOURCE}, {SQL_WORD_PIECES}, {SQL_COVERED.format('1.0')}, {sql_training()},
{SQL_MERGED_NUMBERS}, {sql_encoded('text', table='latin')}
SELECT doc_id, string_agg(coalesce(id, 0)::VARCHAR, ' ' ORDER BY i) AS ids
FROM encoded GROUP BY doc_id
""")
def byte_merged(t):
    """Merges over the UTF-8 bytes of the words."""
    fitted = tokenizer(t, tokenizers.ByteMergedTokenizer).fit(t.documents)
    return t.documents.select("doc_id", joined(fitted.ids(F.col("text"))).alias("ids"))


# Texts written in codes, as a source of pieces.
SQL_CODED = f"""{SQL_DICT},
coded AS (
  SELECT doc_id, string_agg(coalesce(code, c), '#' ORDER BY i) AS text
  FROM chars LEFT JOIN entries ON ch = c GROUP BY doc_id
), source AS (
  SELECT unnest(string_split(text, chr(10))) AS text FROM coded
)"""


@query("input_method_merged", f"""
WITH RECURSIVE {SQL_CODED}, {SQL_WORD_PIECES}, {SQL_COVERED.format('1.0')}, {sql_training()},
{SQL_MERGED_NUMBERS}, {sql_encoded('text', table='coded')}
SELECT doc_id, string_agg(coalesce(id, 0)::VARCHAR, ' ' ORDER BY i) AS ids
FROM encoded GROUP BY doc_id
""")
def input_method_merged(t):
    """Merges over texts written in a dictionary's codes."""
    fitted = tokenizer(t, tokenizers.InputMethodTokenizer, "wubi", entries(t)).fit(t.documents)
    return t.documents.select("doc_id", joined(fitted.ids(F.col("text"))).alias("ids"))


# Byte codes of the tokens in `cells` (doc_id, i, token), by frequency, then by first appearance.
SQL_REMAP = """
token_firsts AS (SELECT token, count(*) AS n, min(doc_id) AS doc_id FROM cells GROUP BY token),
token_ranks AS (
  SELECT token, n, row_number() OVER (ORDER BY n DESC, doc_id, i) - 1 AS rank
  FROM (SELECT f.token, f.n, f.doc_id, min(c.i) AS i
        FROM token_firsts f JOIN cells c ON c.token = f.token AND c.doc_id = f.doc_id GROUP BY ALL)
), remap AS (SELECT token, rank, n, hex(encode(chr((32 + rank)::INTEGER))) AS code FROM token_ranks)
"""
SQL_REPACKED = f"""
WITH RECURSIVE {SQL_LINES}, {SQL_WORD_PIECES}, {SQL_COVERED.format('0.9995')}, {sql_training()},
{SQL_MERGED_NUMBERS}, {sql_encoded('text')},
cells AS (SELECT doc_id, i, token, id FROM encoded),{SQL_REMAP}"""


def repacked(t):
    return tokenizers.RepackedTokenizer(
        tokenizers.TokenizerConfig("RepackagedByteTokenizer", 512), tokenizer(t).fit(t.documents)
    ).fit(t.documents)


@query("repack_train", f"""{SQL_REPACKED}
SELECT token, rank, code FROM remap
UNION ALL SELECT '<unk>', count(*), hex(encode(chr((32 + count(*))::INTEGER))) FROM remap
""")
def repack_train(t):
    """Byte codes of the merged tokens by rank."""
    return repacked(t).remap.withColumn(
        "code", F.array_join(F.transform("code", lambda b: F.lpad(F.hex(b), 2, "0")), "")
    )


@query("repack_encode", f"""{SQL_REPACKED}
SELECT doc_id, array_to_string(list_transform(
         regexp_extract_all(string_agg(code, '' ORDER BY i), '..'), lambda h: ('0x' || h)::BIGINT + 4), ' ') AS ids
FROM cells JOIN remap USING (token) GROUP BY doc_id
""")
def repack_encode(t):
    return t.documents.select("doc_id", joined(repacked(t).ids(F.col("text"))).alias("ids"))


# White space and the printable characters of the byte-level rule.
SQL_WHITE = r"\t\n\x0b\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SQL_PRINTED = "[" + ", ".join(f"chr({c})" for c in merges.byte_level_table()) + "]"
SQL_CONTRACTIONS = "|".join("''" + end for end in ("s", "t", "re", "ve", "m", "ll", "d"))
# A mark stands before the last of several white characters that a word follows: the rule looks
# ahead there, and what follows the mark is a piece of its own.
SQL_BYTE_LEVEL_PIECES = rf"""
lines AS (SELECT unnest(regexp_extract_all(text, '[^\n]*\n|[^\n]+')) AS line FROM documents),
cut AS (
  SELECT unnest(regexp_extract_all(
    regexp_replace(line, '([{SQL_WHITE}]+)([{SQL_WHITE}][^{SQL_WHITE}])', '\1' || chr(57344) || '\2', 'g'),
    '{SQL_CONTRACTIONS}| ?\p{{L}}+| ?\p{{N}}+| ?[^{SQL_WHITE}\p{{L}}\p{{N}}\x{{E000}}]+|[{SQL_WHITE}]+')) AS raw
  FROM lines
), pieces AS (
  SELECT array_to_string(list_transform({sql_bytes('raw')}, lambda b: ({SQL_PRINTED})[b + 1]), '') AS piece, n
  FROM (SELECT raw, count(*) AS n FROM cut GROUP BY raw)
)"""


@query("byte_level_vocab", f"""
WITH RECURSIVE {SQL_BYTE_LEVEL_PIECES}, {sql_training(min_count=tokenizers.LINE_MIN_COUNT)}
SELECT token, (i - 1)::BIGINT AS id FROM (
  SELECT unnest({tokenizers.LINE_SPECIALS}) AS token, unnest(range(1, {len(tokenizers.LINE_SPECIALS) + 1})) AS i)
UNION ALL SELECT c, row_number() OVER (ORDER BY unicode(c)) + {len(tokenizers.LINE_SPECIALS) - 1}
  FROM (SELECT unnest({SQL_PRINTED}) AS c)
UNION ALL SELECT txt, id - {FIRST} + {len(tokenizers.LINE_SPECIALS) + 256} FROM text_of
""")
def byte_level_vocab(t):
    """Specials, 256 bytes and 200 merged tokens of the byte-level rule."""
    size = len(tokenizers.LINE_SPECIALS) + 256 + TOKENS
    model, tokens = tokenizers.byte_level_model(t.documents, size=size)
    return t.spark.createDataFrame([(k, i) for i, k in enumerate(tokens)], "token string, id bigint")


@query("merged_token_counts", f"""{SQL_REPACKED}
SELECT coalesce(id, 0)::BIGINT AS token, count(*) AS n FROM cells GROUP BY ALL
""")
def merged_token_counts(t):
    fitted = tokenizer(t).fit(t.documents)
    return vocab.token_counts(t.documents, fitted.ids(F.col("text")))


def saved_path(t) -> str:
    return scratch_path(t.spark, "tokenizer")


def reopened(t, fitted):
    """The tokenizer as it comes back from its folder."""
    path = saved_path(t)
    fitted.save(t.spark, path)
    return tokenizers.open_tokenizer(t.spark, path)


@query("merged_round_trip", f"""
WITH RECURSIVE {SQL_LINES}, {SQL_WORD_PIECES}, {SQL_COVERED.format('0.9995')}, {sql_training()},
{SQL_MERGED_NUMBERS}, {sql_encoded('text')}
SELECT doc_id, count(*) AS n_tokens,
       substring(string_agg(CASE WHEN id IS NULL THEN '<unk>' ELSE replace(token, '▁', ' ') END, '' ORDER BY i), 2) AS text
FROM encoded GROUP BY doc_id
""")
def merged_round_trip(t):
    """Saved, opened again, encoded and decoded: the words with one space between them, runs of
    characters that the vocabulary leaves out as the unknown mark."""
    tok = reopened(t, tokenizer(t).fit(t.documents))
    rows = t.documents.select("doc_id", tok.ids(F.col("text")).alias("ids"))
    return rows.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), tok.decode(F.col("ids")).alias("text"))


@query("repacked_round_trip", """
SELECT doc_id, array_to_string(list_filter(string_split(text, ' '), lambda w: w <> ''), ' ') AS text FROM documents
""")
def repacked_round_trip(t):
    """Byte codes of one to four bytes back to text. Every run of unknown characters has a code."""
    path = saved_path(t)
    tokenizer(t).fit(t.documents).save(t.spark, path)
    config = {"name": "RepackagedByteTokenizer", "sp_path": path, "tokenizer_files_dir": saved_path(t)}
    tok = tokenizers.prepared(t.spark, config, 512, t.documents)
    rows = t.documents.select("doc_id", tok.ids(F.col("text")).alias("ids"))
    return rows.select("doc_id", tok.decode(F.col("ids")).alias("text"))


@query("reopened_encode", f"""
WITH RECURSIVE {SQL_BYTE_SOURCE}, {SQL_WORD_PIECES}, {SQL_COVERED.format('1.0')}, {sql_training()},
{SQL_MERGED_NUMBERS}, {sql_encoded('text', table='latin')}
SELECT doc_id, string_agg(coalesce(id, 0)::VARCHAR, ' ' ORDER BY i) AS ids,
       regexp_replace(array_to_string(list_filter(string_split(any_value(d.text), ' '), lambda w: w <> ''), ' '),
                      '\\n+', '<unk>', 'g') AS text
FROM encoded JOIN documents d USING (doc_id) GROUP BY doc_id
""")
def reopened_encode(t):
    """A byte vocabulary from its configuration: learned and saved, then opened by the same configuration.
    Line breaks are the only characters that a vocabulary of words does not know."""
    config = {"name": "ByteBPETokenizer", "max_vocab_size": "", "special_tokens": {"pad_token": "<pad>"},
              "tokenizer_files_dir": saved_path(t), "vocab_file_name": "bytes"}
    tokenizers.prepared(t.spark, config, 512, t.documents, merges=TOKENS)
    tok = tokenizers.prepared(t.spark, config, 512, t.documents.limit(0), merges=TOKENS)
    rows = t.documents.select("doc_id", tok.ids(F.col("text")).alias("found"))
    return rows.select("doc_id", joined(F.col("found")).alias("ids"), tok.decode(F.col("found")).alias("text"))


POSITIONS = 128
FORMS = ["byte", "character", "merged", "repacked"]
SQL_TOTAL = "(SELECT sum(n) AS total FROM unigrams)"


# One table holds the documents and, under negative keys, the validation set: it is encoded as they are.
@query("experiment", f"""
WITH RECURSIVE {SQL_LINES}, {SQL_WORD_PIECES}, {SQL_COVERED.format('0.9995')}, {sql_training()},
{SQL_MERGED_NUMBERS}, {SQL_VALIDATION},
texts AS (SELECT doc_id, text FROM documents UNION ALL SELECT -1 - doc_id, text FROM valid),
{sql_encoded('text', table='texts')},
cells AS (SELECT doc_id, i, token, id FROM encoded WHERE doc_id >= 0),{SQL_REMAP},
{sql_symbols('valid', 'unigrams')},
bits AS (SELECT sum(n)::BIGINT AS symbols, sum(-n * log2(n / total)) AS bits FROM unigrams, {SQL_TOTAL}),
merged AS (
  SELECT doc_id, count(*) AS units,
         sum(length(coalesce(code, (SELECT hex(encode(chr((32 + count(*))::INTEGER))) FROM remap))) // 2) AS bytes
  FROM encoded LEFT JOIN remap USING (token) WHERE doc_id < 0 GROUP BY doc_id
), counts AS (
  SELECT 'character' AS tokenizer, sum(least(length(text), {POSITIONS}))::BIGINT AS tokens FROM valid
  UNION ALL SELECT 'byte', sum(least(octet_length(encode(text)), {POSITIONS}))::BIGINT FROM valid
  UNION ALL SELECT 'merged', sum(least(units, {POSITIONS}))::BIGINT FROM merged
  UNION ALL SELECT 'repacked', sum(least(bytes, {POSITIONS}))::BIGINT FROM merged
), losses AS (
  SELECT {FORMS}[event_id % 4 + 1] AS tokenizer, avg(value) AS loss FROM events GROUP BY 1
)
SELECT tokenizer, tokens, round(loss / ln(2) * tokens / bits, 6) AS une,
       round(loss / ln(2) * symbols / bits, 6) AS per_token
FROM counts JOIN losses USING (tokenizer), bits
""")
def experiment(t):
    """Four saved vocabularies on the validation set, in one pass; event values stand in for losses."""
    base = tokenizer(t).fit(t.documents)
    config = {"name": "CharacterTokenizer", "max_vocab_size": "", "special_tokens": {"pad_token": "<pad>", "unk_token": "<unk>"}}
    recoded = tokenizers.RepackedTokenizer(tokenizers.TokenizerConfig("RepackagedByteTokenizer", POSITIONS), base)
    models = {
        "byte": tokenizers.ByteTokenizer(tokenizers.TokenizerConfig("ByteTokenizer", POSITIONS)),
        "character": reopened(t, tokenizers.tokenizer_from_config(config, POSITIONS).fit(t.documents)),
        "merged": reopened(t, base),
        "repacked": reopened(t, recoded.fit(t.documents)),
    }
    name = F.element_at(F.array(*map(F.lit, FORMS)), (F.col("event_id") % 4 + 1).cast("int"))
    loss = t.events.groupBy(name.alias("tokenizer")).agg(F.avg("value").alias("loss"))
    result = compare.experiment(validation.validation_set(t.documents, mark="."), models, loss, POSITIONS)
    return result.withColumn("une", F.round("une", 6)).withColumn("per_token", F.round("per_token", 6))
