"""A training corpus from raw documents: language, site lines, near copies, source weights, pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm import langid, lines, minhash, mixing, pieces
from ridgeline.llm._store import materialize, tidied, tidy

#: A document without a language, or where none is likelier than all others together, is rejected.
LEAST_POSTERIOR = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language. The classifier learns from the labelled documents themselves; their lang column stays as it is.

    Where no document has both a label and a text there is nothing to learn from, and every text that has a letter stays.
    """
    model = langid.fit(docs)
    if not model.languages:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    found = langid.predict(docs.select(F.struct("*").alias("doc"), "text"), model)
    return found.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_POSTERIOR)).select("doc.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the boilerplate lines of their source; every document stays. Exact copies in a source count as one, so the copy that near_dedup keeps still has its text."""
    whole = docs.select(F.struct("*").dropFields("text").alias("doc"), "source", "text")
    out = lines.drop_boilerplate(whole, "source", "text", once=True)
    n_chars = F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("doc.n_chars")).cast(docs.schema["n_chars"].dataType)
    now = {"text": F.col("text"), "n_chars": n_chars}
    return out.select([now.get(c, F.col("doc").getField(c)).alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return minhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources, documents repeated where a source's target holds it more than once."""
    return mixing.mix_texts(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_pieces, pieces, decoded_equal of each row of the mix."""
    return pieces.encode_texts(docs.select("doc_id", "source", "text")).select("doc_id", "source", "n_pieces", "pieces", "decoded_equal")


STAGES = [("language", language), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mix_sources", mix_sources), ("encode", encode)]

#: Encoding has no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


@tidied
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written before the next one reads it; what an earlier one has written goes then."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = tidy(materialize(docs))
    return docs
