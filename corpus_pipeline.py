"""From raw documents to token ids: the stages of a training corpus, in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from glyphmill.llm import bpe, common as C, fertility, parity_join, private, winnowing

# Quality rules come from a tokenizer, so no SQL gives the whole job's rows.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, with all their columns; a column named like one of the
    measures keeps its own values. Null and empty texts have no words and go; repeated rows are
    judged alike."""
    inner = [f"_given{i}" for i in range(len(docs.columns))]
    text = inner[docs.columns.index("text")]
    judged = fertility.judged(fertility.measure(docs.toDF(*inner), text))
    return judged.where("kept").select(*[F.col(a).alias(c) for a, c in zip(inner, docs.columns)])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each near-duplicate group."""
    return parity_join.first_of_groups(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the contamination that the benchmark's windows show."""
    return winnowing.without_contaminated(docs, C.table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars follows the text."""
    return private.masked(docs).withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's token ids."""
    return bpe.encode(docs).select(
        "doc_id", "lang", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids"
    )


STAGES = [
    ("quality rules", quality),
    ("n-gram jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("personal data", personal_data),
    ("bpe encoding", encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table, each on what the one before has written."""
    docs = C.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if stage is not STAGES[-1][1]:
            docs = C.staged(docs, name.replace(" ", "-"))
    return docs
