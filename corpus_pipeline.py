"""A corpus from raw documents to packed sequences: the stages, and all of them in a row.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame with the columns of documents;
the last returns pieces of packed sequences. Nulls, empty texts, repeated rows and empty tables
have the results that the operators' docstrings state: texts without words fail the quality
rules, and an empty table stays empty in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlake.llm import line_frequency, mixing, near_copies, packing, private_data
from churnlake.llm.registry import ready, table
from churnlake.session import stored

# Tokenisers, trees of minwise values and the field have no SQL form.
ORACLE_SQL = None

SHINGLE = 5  # words


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, without the lines that many documents of their source share."""
    ready(spark)
    judged = line_frequency.verdicts(docs, with_text=True).filter("kept")
    return _columns(judged.withColumn("text", F.col("cleaned")), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: sets of five-word shingles at least 0.8 alike."""
    ready(spark)
    return near_copies.one_of_each(docs, shingle=SHINGLE)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind."""
    ready(spark)
    return _columns(private_data.masked(docs), docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the target weight of its source asks for."""
    ready(spark)
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of neighbours."""
    ready(spark)
    return packing.pack(docs).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("private", private), ("mix", mix), ("pack", pack)]


def _columns(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of the input, with the length of the new text where there is one."""
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each result is stored, so that a lost executor costs one stage at most."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = stored(out, "corpus") if k < len(STAGES) - 1 else out
    return docs
