"""The training-data pipeline over ``documents``: five stages, each written as Parquet and read again as the next one's input.

Language identification drops texts without letters and texts that no language dominates; of each group of SimHash near-duplicates the smallest
doc_id stays; personal data are replaced by their kind; sources are mixed to target weights, so a document may go or come several times; the last
stage encodes the texts. Rows that repeat a doc_id stand for one document, and stay or go together; rows without an id are never dropped as
duplicates. All stages but the last return the columns of their input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evisets.llm import bpe, langid, mixing, pii, simhash
from evisets.llm.common import remainder, stored
from evisets.llm.queries import mixture, word_vocabulary

LEAST_SHARE = 0.5  # of the letters that the predicted language must have


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from the labelled rows outside the held-out third, keep rows with a language that has most letters."""
    model = langid.fit(docs.where(remainder(F.col("doc_id"), 3) != 1))
    seen = langid.predict(docs, model, keep=tuple(docs.columns), prefix="_seen_")
    return seen.where((F.col("_seen_lang_pred") != "und") & (F.col("_seen_score") >= LEAST_SHARE)).select(docs.columns)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest doc_id of each group of near-duplicates."""
    gone = simhash.near_duplicates(docs).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data; n_chars follows the new text."""
    clean = pii.redact(docs, pii.spans(docs))
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType))) if "n_chars" in docs.columns else clean


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as its source's budget takes it."""
    return mixing.mixed(docs, *mixture(spark))


def bpe_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, and the digest of the text they decode to."""
    e = bpe.encode(docs, word_vocabulary())
    return e.select("doc_id", "n_tokens", "ids", F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


STAGES = [("language_id", language_id), ("simhash_dedup", simhash_dedup), ("pii", redact_pii), ("mix", mix_sources), ("bpe", bpe_encode)]

#: SQL can't express the learned, iterative and encoding stages; tests hold each against a plain computation.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES, SQL = {"pipeline": run}, {}
