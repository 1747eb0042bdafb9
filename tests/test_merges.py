import random
from collections import Counter
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from glyphmill.operators import merges, training
from glyphmill.plans import tokenizers


def greedy(pieces, tokens):
    """One merge at a time over plain lists, until there are so many new tokens."""
    state = [([ord(c) for c in piece], n) for piece, n in pieces.items()]
    model = merges.MergeModel()
    while len(model.texts) < tokens:
        counts = Counter()
        for ids, n in state:
            for pair in zip(ids, ids[1:]):
                counts[pair] += n
        if not counts:
            break
        (a, b), n = min(counts.items(), key=lambda x: (-x[1], x[0]))
        model.add(a, b, n)
        new = model.pairs[-1][2]
        for ids, _ in state:
            i = 0
            while i < len(ids) - 1:
                if ids[i] == a and ids[i + 1] == b:
                    ids[i:i + 2] = [new]
                i += 1
    return model


@pytest.mark.parametrize("seed,frame,runs", [(1, 1024, 10**5), (2, 12, 10**5), (3, 40, 150), (4, 3, 10), (5, 25, 10**5)])
def test_rounds_equal_one_at_a_time(spark, seed, frame, runs):
    rnd = random.Random(seed)
    pieces = Counter()
    for _ in range(400):
        pieces["".join(rnd.choice("aabcde") for _ in range(rnd.randint(1, 11)))] += rnd.randint(1, 9)
    table = spark.createDataFrame(list(pieces.items()), "piece string, n bigint")
    tokens = 12 if frame < 10 else 60
    model = training.train_merges(table, tokens, frame=frame, most_runs=runs)
    expected = greedy(pieces, tokens)
    assert model.pairs == expected.pairs and model.counts == expected.counts


def test_rounds_on_documents(spark):
    """Several rounds on real words."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text")
    table = merges.piece_counts(docs, merges.words(F.col("text")), merges.WORD_MARK).where("n > 3").cache()
    pieces = {r.piece: r.n for r in table.collect()}
    model = training.train_merges(table, 150, frame=200)
    expected = greedy(pieces, 150)
    assert model.pairs == expected.pairs and len(model.texts) == 150


def test_rare_characters_join_nothing(spark):
    table = spark.createDataFrame([("abab", 50), ("azaz", 1)], "piece string, n bigint")
    model = training.train_merges(table, 10, chars=["a", "b"])
    assert all("z" not in text for text in model.texts.values()) and "abab" in model.by_text


def test_short_and_long_way_of_merging_agree():
    rnd = random.Random(9)
    for _ in range(300):
        ranks = {}
        for k in range(30):
            pair = tuple(rnd.choice([1, 2, 3, *range(100, 100 + k)]) for _ in range(2))
            ranks.setdefault(pair, (k, 100 + k))
        ids = [rnd.choice([1, 2, 3]) for _ in range(rnd.randint(0, 45))]
        assert merges.merge_symbols(list(ids), ranks) == merges._merge_long(list(ids), ranks)


def test_model_survives_its_table(spark):
    model = greedy(Counter({"abcabc": 5, "aaaa": 3, "bcbc": 2}), 6)
    again = merges.MergeModel.from_table(model.table(spark))
    assert (again.pairs, again.counts, again.texts) == (model.pairs, model.counts, model.texts)


def test_byte_level_vocabulary_equals_the_library(spark):
    tokenizers_lib = pytest.importorskip("tokenizers")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    texts = [r.text for r in docs.collect()]
    lines = [line for text in texts for line in text.splitlines(keepends=True)]
    library = tokenizers_lib.ByteLevelBPETokenizer()
    library.train_from_iterator(
        lines, vocab_size=261 + 80, min_frequency=2, special_tokens=tokenizers.LINE_SPECIALS)
    model, tokens = tokenizers.byte_level_model(docs, size=261 + 80)
    vocab = library.get_vocab()
    assert tokens == sorted(vocab, key=vocab.get)
    rows = docs.select("text", tokenizers.byte_level_ids(F.col("text"), model, tokens).alias("ids")).collect()
    assert all(library.encode(r.text).ids == r.ids for r in rows)


def config(name, **more):
    return {"name": name, "max_vocab_size": "", "max_examples": "",
            "special_tokens": {"pad_token": "<pad>"}, **more}


def test_merged_tokens_spell_the_text(spark, docs):
    tok = tokenizers.tokenizer_from_config(config("SubwordBPETokenizer"), 32, merges=15)
    tok.fit(docs)
    names = tok.tokens
    for r in docs.select("text", tok.ids(F.col("text")).alias("ids")).collect():
        if r.text is None:
            assert r.ids is None
            continue
        spelled = "".join(names[i] for i in r.ids).replace("<unk>", "?")
        words = "".join("▁" + w for w in r.text.split(" ") if w)
        kept = set("".join(names[3:])) - set("<>")
        # Neighbouring unknown characters, line breaks among them, are one; no mark follows a break.
        assert spelled == "".join("?" if k else "".join(g) for k, g in groupby(words, lambda c: c not in kept))


def test_byte_merged_decodes_to_the_words(spark, docs):
    tok = tokenizers.tokenizer_from_config(config("ByteBPETokenizer"), 32, merges=20).fit(docs)
    rows = docs.where("doc_id in (0, 3, 5)").select("text", tok.ids(F.col("text")).alias("ids")).collect()
    for r in rows:
        words = "".join(tok.tokens[i] for i in r.ids).split("▁")
        assert " ".join(words).strip().encode("latin-1").decode() == r.text


def test_repacked_ids_are_bytes_of_ranks(spark, docs):
    base = tokenizers.tokenizer_from_config(config("SubwordBPETokenizer"), 32, merges=10).fit(docs)
    tok = tokenizers.tokenizer_from_config(config("RepackagedByteTokenizer", sp_path="x"), 32, base=base).fit(docs)
    plain = docs.where(F.col("text").isNotNull()).orderBy("doc_id").select(
        "text", base.texts(F.col("text")).alias("a"), tok.ids(F.col("text")).alias("b")).collect()
    known = {base.tokens[i]: i for i in base.numbers.values()}
    number = lambda token: known.get(token, tok.runs.get(token))
    # Every run of unknown characters keeps its own text.
    assert "\n\n" in tok.runs
    counter = Counter()
    for r in plain:
        if r.text.strip():
            stripped = r.text.strip()
            counter.update(r.a if stripped == r.text else [])
    for r in plain:
        expected = [b + 4 for token in r.a for b in tok.codes.get(number(token), tok.unknown)]
        assert r.b == expected
    ranks = [bytes(tok.codes[number(token)]) for token, _ in counter.most_common(3)]
    assert ranks[0] <= ranks[1] <= ranks[2]


def test_input_method_tokenizer_needs_its_dictionary(spark, docs):
    table = spark.createDataFrame([("t", "abc"), ("h", "d")], "ch string, code string")
    tok = tokenizers.tokenizer_from_config(
        config("ChineseBPETokenizer", input_method="wubi"), 16, dictionary=table, merges=5).fit(docs)
    assert docs.select(tok.written(F.col("text"))).first()[0].startswith("abc#d#e# #")
    bare = tokenizers.tokenizer_from_config(config("ChineseBPETokenizer", input_method="wubi"), 16, merges=5)
    with pytest.raises(ValueError):
        bare.fit(docs)


def test_encoded_rows_have_the_right_shape(spark, docs):
    for name, extra in [("CharacterTokenizer", {}), ("ByteTokenizer", {}), ("SubwordBPETokenizer", {"merges": 3})]:
        tok = tokenizers.tokenizer_from_config(config(name), 10, **extra).fit(docs)
        for r in tok.transform(docs.where(F.col("text").isNotNull())).collect():
            assert len(r.input_ids) == len(r.attention_mask) == len(r.labels) == 10
            assert r.labels == r.input_ids and sum(r.attention_mask) <= 10
            assert all(i == tok.pad_id for i, m in zip(r.input_ids, r.attention_mask) if not m)
        ids = [r.id for r in tok.vocabulary(spark).collect()]
        assert sorted(ids) == list(range(len(ids)))


def test_unknown_name_raises():
    with pytest.raises(ValueError):
        tokenizers.tokenizer_from_config(config("Nobody"), 8)


def test_word_marks_and_unknown_runs(spark):
    rows = spark.createDataFrame([("the cat",), ("the mat",)], "text string").withColumn("doc_id", F.lit(1))
    tok = tokenizers.tokenizer_from_config(config("SubwordBPETokenizer"), 16, merges=9).fit(rows)
    odd = spark.createDataFrame([("the cat\nthe mat",), ("ZZ  theZ\n\nq",), ("\nthe",)], "text string")
    got = [r[0] for r in odd.select(tok.texts(F.col("text"))).collect()]
    assert ["".join(t) for t in got] == ["▁the▁cat\nthe▁mat", "▁ZZ▁theZ\n\nq", "▁\nthe"]
    ids = [r[0] for r in odd.select(tok.ids(F.col("text"))).collect()]
    assert [i.count(0) for i in ids] == [1, 2, 1]


def test_long_lines_are_kept_unless_asked(spark):
    rows = spark.createDataFrame([(1, "ab " * 20000 + "\nxy")], "doc_id bigint, text string")
    make = lambda **more: tokenizers.tokenizer_from_config(config("SubwordBPETokenizer"), 8, merges=2, **more)
    assert "▁ab" in make().fit(rows).tokens
    assert "▁ab" not in make(max_line_bytes=32_768).fit(rows).tokens


def test_many_pieces_are_merged_together():
    """Distinct pieces were merged one by one, and all of a batch were held."""
    import random

    import numpy as np

    draw = random.Random(5)
    for _ in range(300):
        pairs, symbols = [], list(range(97, 101))
        for n in range(draw.randint(0, 12)):
            pairs.append((draw.choice(symbols), draw.choice(symbols), 1000 + draw.randint(0, n)))
            symbols.append(pairs[-1][2])
        ranks = {}
        for rank, (left, right, joined) in enumerate(pairs):
            ranks.setdefault((left, right), (rank, joined))
        pieces = ["".join(chr(draw.randint(97, 101)) for _ in range(draw.choice([1, 2, 5, 30, 300]))) for _ in range(20)]
        found, sizes = merges._merged_pieces(pieces, "a", merges._merge_table(pairs), ranks)
        want = [merges.merge_symbols([ord(c) for c in "a" + p], ranks) for p in pieces]
        assert found.tolist() == sum(want, []) and sizes.tolist() == list(map(len, want))
    assert merges._merged_pieces([], "a", merges._merge_table([]), {})[1].tolist() == []
    assert np.array_equal(merges._merged_pieces(["b"], "", merges._merge_table([]), {})[0], [98])


def test_slices_of_a_batch(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(merges, "_SLICE_BYTES", 10)
    rows = pa.array([["a" * 5, "b"], None, [], ["c" * 40], ["d"], ["e"], [], ["f" * 9]])
    parts = list(merges._slices(rows.slice(1)))
    assert pa.concat_arrays(parts).equals(rows.slice(1)) and len(parts) == 4
    assert list(merges._slices(rows.slice(0, 0))) == []
