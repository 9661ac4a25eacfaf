"""From raw documents to token ids, in stages that are written and read again.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last
return the columns of documents. SQL cannot express the learned and the tokenising stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomgrid.llm import decontamination, near_duplicates, sentencepieces, suffixes, toxicity
from fathomgrid.llm.common import free_names, stage

ORACLE_SQL = None
TOXIC = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half; empty ones stay."""
    model = toxicity.fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(toxicity.toxicity_of(F.col("text"), model)["score"] < TOXIC)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the least id, of every group of near-duplicates (five words, similarity 0.8)."""
    return near_duplicates.drop_near_duplicates(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 100 bytes that stand earlier; a document with nothing left goes."""
    (name,) = free_names(docs, "_spans")
    spans = F.col(name)
    found = suffixes.with_spans(docs, spans=name)
    cut = F.when(spans.isNull(), F.col("text")).otherwise(suffixes.cut_text(F.coalesce("text", F.lit("")), spans))
    n_chars = F.when(spans.isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(docs.schema["n_chars"].dataType))
    done = found.withColumn("text", cut).where(spans.isNull() | (F.length(F.trim("text")) > 0))
    return done.withColumn("n_chars", n_chars).select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontamination.drop_leaked(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, checked by decoding them."""
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    return sentencepieces.decode_documents(sentencepieces.encode_documents(docs, model), model)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("suffixes", cut_repeats),
    ("decontamination", drop_leaks),
    ("sentencepieces", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name)
    return docs
