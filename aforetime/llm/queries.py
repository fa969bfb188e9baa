"""The text problems' queries over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aforetime.llm import abuse, bpe, leaks
from aforetime.sources.tables import table
from aforetime.storage import spread


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """Document texts, over all cores."""
    return spread(table(spark, folder, "documents").select("doc_id", "text", "source"))


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document."""
    return bpe.encode_corpus(documents(spark, folder), tokenizer_path("byte_bpe_50k.tiktoken"))


def p9_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Alignment scores of the documents and items that share an n-gram."""
    return leaks.leak_scores(documents(spark, folder), table(spark, folder, "eval_item"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """The items that each document contains."""
    return leaks.leaks(p9_scores(spark, folder)).select("doc_id", "item_id")


def p10_scores(spark: SparkSession, folder: str) -> DataFrame:
    """A score for abusive, hateful or sexual content of every document."""
    texts = documents(spark, folder)
    model = abuse.fit_reviewed(texts, table(spark, folder, "review_label"))
    return abuse.score(texts, model, keep=("source",))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """The documents with such content."""
    return p10_scores(spark, folder).where(F.col("score") >= abuse.THRESHOLD).select("doc_id")


def p10_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Documents, toxic documents and their rate per source."""
    toxic = (F.col("score") >= abuse.THRESHOLD).cast("int")
    return (
        p10_scores(spark, folder)
        .groupBy("source")
        .agg(F.count("*").alias("n_documents"), F.sum(toxic).alias("n_toxic"), F.avg(toxic).alias("toxic_rate"))
    )


QUERIES = {"p8_ids": p8_ids, "p9_scores": p9_scores, "p9_found": p9_found,
    "p10_scores": p10_scores,
    "p10_found": p10_found,
    "p10_rates": p10_rates,
}
ORACLES: dict[str, str] = {}
