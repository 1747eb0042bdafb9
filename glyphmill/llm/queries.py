"""The registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import (
    bpe, common as C, copies, fertility, licences, main_text, parity_join, phrases, prefixes, private, redirects, repeats, suffix_tree, winnowing,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return register


def _sha(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


@query("op1_tokeniser_fertility")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures, token measures and the verdict of every document."""
    rows = fertility.judged(fertility.measure(C.table(spark, sf_dir, "documents"), keep=["doc_id"]))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "script", "n_tokens", "chars_per_token", "byte_share", "entropy", "units_per_byte",
    )


@query("op2_winnowing", winnowing.ORACLE)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of benchmark passages in every document."""
    found = winnowing.contamination(
        C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark")
    )
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("bigint").alias("n_items"),
        _sha(F.array_join("item_ids", ",")).alias("items_sha256"), winnowing.contaminated().alias("contaminated"),
    )


@query("op3_bpe")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of every document."""
    rows = bpe.decode(bpe.encode(C.table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"))
    return rows.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        _sha(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"),
        _sha(F.col("decoded")).alias("decoded_sha256"),
    )


@query("op4_redirects")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page's url, with the pages' own links as aliases."""
    pages = C.table(spark, sf_dir, "pages")
    judged = redirects.judge(pages.select("page_id", "url"), redirects.page_edges(pages))
    return judged.select("page_id", "host", "path", "rule", "verdict", "via")


@query("op5_repeats", repeats.ORACLE)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without its repeated passages."""
    rows = repeats.without_repeats(C.table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", _sha(F.col("kept")).alias("kept_sha256"))


@query("op6_licences", licences.oracle())
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every licence notice in every document."""
    return licences.scan(C.table(spark, sf_dir, "documents")).withColumn("dice", F.round("dice", 9))


@query("op7_suffix_tree")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of every document, by single tokens and by the suffix tree."""
    return suffix_tree.scores(C.table(spark, sf_dir, "documents"))


@query("op8_parity_join", parity_join.ORACLE)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate group of every document."""
    return parity_join.groups(C.table(spark, sf_dir, "documents"))


@query("op9_main_text")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = main_text.extract(C.table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


@query("op10_private", None)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    found = private.find(C.table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("bigint")

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(
            spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))
        ), ",")

    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in private.KINDS],
        _sha(listed(base)).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
    )


@query("op11_exact_copies", copies.ORACLE)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row that stays of every document's group of equal texts."""
    rows = copies.groups(C.table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", F.col("keep").alias("keep_id"), F.col("n").alias("group_size"), "kept",
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


@query("op12_phrases", phrases.ORACLE)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best phrases of every language."""
    return phrases.collocations(C.table(spark, sf_dir, "documents"))


@query("op13_prefix_trie", prefixes.ORACLE)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the conversations' prefix trie."""
    nodes = prefixes.prefix_trie(C.table(spark, sf_dir, "conversations"))
    return nodes.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    )
