"""Saved tokenizers: versions, unfinished writes, and ids back to text."""

import random

import pytest
from pyspark.sql import functions as F

from glyphmill.operators import repack
from glyphmill.plans import tokenizers
from glyphmill.session import scratch_path
from glyphmill.sources import readers, saved, writers


def config(name, **more):
    return {"name": name, "max_vocab_size": "", "max_examples": "", "special_tokens": {"pad_token": "<pad>"}, **more}


def ids(tok, docs):
    return [r[0] for r in docs.orderBy("doc_id").select(tok.ids(F.col("text"))).collect()]


def texts(tok, docs):
    encoded = docs.select("doc_id", tok.ids(F.col("text")).alias("ids"))
    return [r[0] for r in encoded.orderBy("doc_id").select(tok.decode(F.col("ids"))).collect()]


@pytest.mark.parametrize("name", ["CharacterTokenizer", "ByteTokenizer", "SubwordBPETokenizer", "ByteBPETokenizer", "ChineseBPETokenizer"])
def test_opened_tokenizers_encode_alike(spark, docs, name):
    extra = {} if name in ("CharacterTokenizer", "ByteTokenizer") else {"merges": 12}
    if name == "ChineseBPETokenizer":
        extra["dictionary"] = spark.createDataFrame([("t", "abc"), ("h", "d")], "ch string, code string")
    tok = tokenizers.tokenizer_from_config(config(name, input_method="wubi" if "Chinese" in name else ""), 16, **extra).fit(docs)
    path = scratch_path(spark, "tok")
    tok.save(spark, path)
    again = tokenizers.open_tokenizer(spark, path, 8)
    assert type(again) is type(tok) and again.config.n_positions == 8
    assert ids(again, docs) == ids(tok, docs)
    assert (tok.pad_id, texts(tok, docs)) == (again.pad_id, texts(again, docs))


def test_round_trips(spark, docs):
    plain = [r.text for r in docs.orderBy("doc_id").collect()]
    assert texts(tokenizers.tokenizer_from_config(config("ByteTokenizer"), 8), docs) == plain
    tok = tokenizers.tokenizer_from_config(config("ByteBPETokenizer"), 8, merges=20).fit(docs)
    words = [None if t is None else " ".join(w for w in t.split(" ") if w).replace("\n\n", "\n").replace("\n", "<unk>") for t in plain]
    assert texts(tok, docs) == words


def test_recoded_tokenizer_from_its_configuration(spark, docs):
    base = scratch_path(spark, "base")
    tokenizers.tokenizer_from_config(config("SubwordBPETokenizer"), 8, merges=10).fit(docs).save(spark, base)
    with pytest.raises(ValueError):
        tokenizers.tokenizer_from_config(config("RepackagedByteTokenizer"), 8, spark)
    given = config("RepackagedByteTokenizer", sp_path=base, tokenizer_files_dir=scratch_path(spark, "codes"))
    made = tokenizers.prepared(spark, given, 8, docs)
    again = tokenizers.prepared(spark, given, 8, docs.limit(0))
    assert ids(made, docs) == ids(again, docs)
    for found, text in zip(texts(again, docs), [r.text for r in docs.orderBy("doc_id").collect()]):
        if text is not None and text.strip() == text:
            assert found == " ".join(w for w in text.split(" ") if w)


def test_codes_of_all_lengths(spark):
    rnd = random.Random(5)
    ranks = [0, 95, 96, 2015, 2016, 55263, 55264, 63455, 63456, 1112031] + [rnd.randrange(1112032) for _ in range(50)]
    rows = spark.createDataFrame([(ranks,)], "r array<bigint>")
    values = F.flatten(F.transform("r", lambda r: repack.byte_code(r)))
    assert rows.select(repack.ranks_of(values)).first()[0] == ranks
    # A cut leaves out the code that it parts, and what stands before the first whole code.
    cut = F.array(*[F.lit(b) for b in (0x80, 0xBF, 65, 0xE4, 0xB8)])
    assert rows.select(repack.ranks_of(cut)).first()[0] == [33]
    assert rows.select(repack.ranks_of(F.array().cast("array<int>"))).first()[0] == []


def test_unfinished_versions_are_not_seen(spark, monkeypatch):
    path = scratch_path(spark, "versions")
    assert saved.newest(spark, path) is None
    with pytest.raises(FileNotFoundError):
        saved.read_version(spark, path)
    one, two = spark.range(3), spark.range(5)
    assert saved.write_version({"t": one}, spark, path, "K", {"a": 1}) == 1
    # The tables of a second version are written, its manifest row is not.
    with monkeypatch.context() as patch:
        patch.setattr(saved.json, "dumps", lambda *a, **k: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            saved.write_version({"t": two}, spark, path, "K", {})
    kind, settings, tables = saved.read_version(spark, path)
    assert (kind, settings, tables["t"].count()) == ("K", {"a": 1}, 3)
    assert saved.write_version({"t": two}, spark, path, "K", {}) == 2
    assert saved.read_version(spark, path)[2]["t"].count() == 5


def test_strict_input_methods():
    for method in ("", "morse"):
        with pytest.raises(ValueError):
            tokenizers.tokenizer_from_config(config("ChineseBPETokenizer", input_method=method), 8)
    with pytest.raises(ValueError):
        tokenizers.RepackedTokenizer(tokenizers.TokenizerConfig("RepackagedByteTokenizer", input_method="morse"))


def test_json_vocabulary(spark):
    rows = [('"', 0), ("\\", 1), ("é ", 2), ("a b", 3), ("}", 4), ("\n", 5), (",", 6)]
    table = spark.createDataFrame(rows, "token string, id bigint")
    path = scratch_path(spark, "vocab") + ".json"
    writers.write_vocab(table, path)
    assert sorted(map(tuple, readers.read_vocab(spark, path).collect())) == sorted(rows)
    lines = [r.value for r in spark.read.text(path).collect()]
    assert lines[0] == "{" and lines[-1] == "}" and len(lines) == len(rows) + 2
    writers.write_vocab(table.limit(0), path)
    assert readers.read_vocab(spark, path).count() == 0


def test_results_are_appended_once(spark):
    path = scratch_path(spark, "results")
    rows = spark.createDataFrame([("a", "t", 1.0), ("a", "u", 2.0), ("a", "u", 2.0)], "run string, task string, x double")
    for _ in range(2):
        writers.append_new(rows, path, ["run", "task"])
    writers.append_new(rows.withColumn("run", F.lit("b")), path, ["run", "task"])
    found = spark.read.parquet(path)
    assert found.columns == ["run", "task", "x"] and found.count() == 4
