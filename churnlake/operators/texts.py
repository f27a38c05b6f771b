"""Words in long form: counts, weights, look-ups and rankings of terms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from churnlake.session import broadcast_if_small, shuffle_width, splittable


def explode_tokens(df: DataFrame, doc: str, tokens: Column) -> DataFrame:
    """``(doc, position, token)``, one row per word."""
    return df.select(doc, F.posexplode(tokens).alias("position", "token"))


def lemmatise(tokens: DataFrame, lemmas: DataFrame) -> DataFrame:
    """Replace words by their base form from a ``(token, lemma)`` table."""
    joined = tokens.join(broadcast_if_small(splittable(lemmas, "token")), "token", "left")
    return joined.withColumn("token", F.coalesce("lemma", "token")).drop("lemma")


def keep_pos(tokens: DataFrame, tags: DataFrame, prefixes: Sequence[str] = ("NN", "JJ")) -> DataFrame:
    """Words whose tag in a ``(token, pos)`` table starts like a noun or adjective."""
    wanted = F.lit(False)
    for p in prefixes:
        wanted = wanted | F.col("pos").startswith(p)
    return tokens.join(broadcast_if_small(splittable(tags.filter(wanted).select("token").distinct(), "token")), "token", "left_semi")


def term_counts(tokens: DataFrame, doc: str) -> DataFrame:
    """Document-term counts ``(doc, term, tf)``; never densified."""
    return tokens.groupBy(doc, F.col("token").alias("term")).agg(F.count(F.lit(1)).alias("tf"))


def document_frequency(counts: DataFrame) -> DataFrame:
    return counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def hapax(counts: DataFrame) -> DataFrame:
    """Terms that occur in exactly one document."""
    return document_frequency(counts).filter("df = 1").select("term")


def only_hapax(counts: DataFrame) -> DataFrame:
    """Counts of the terms that occur in exactly one document."""
    whole = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.first(counts.columns[0]).alias(
        counts.columns[0]), F.first("tf").alias("tf"))
    return whole.filter("df = 1").select(counts.columns[0], "term", "tf")


def tfidf(counts: DataFrame, doc: str, n_docs: Column, smooth: bool = True, norm: bool = True) -> DataFrame:
    """``tf * (ln((1 + n) / (1 + df)) + 1)`` per document and term, rows of length 1."""
    add = 1 if smooth else 0
    idf = F.log((n_docs + add) / (F.col("df") + add)) + 1
    weighted = counts.join(splittable(document_frequency(counts), "term"), "term").select(
        doc, "term", (F.col("tf") * idf).alias("weight"))
    if not norm:
        return weighted
    # The terms of one document came from one row, so the frame is bounded by one text.
    length = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy(doc)))
    return weighted.withColumn("weight", F.col("weight") / length)


def top_terms(tokens: DataFrame, n: int) -> DataFrame:
    """The ``n`` commonest words of the whole collection."""
    counts = tokens.groupBy(F.col("token").alias("term")).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "term").limit(n)


def by_term(counts: DataFrame, doc: str) -> DataFrame:
    """The term-document view of the same counts: totals per term."""
    return counts.groupBy("term").agg(
        F.count(doc).alias("n_docs"), F.sum("tf").alias("n"), F.max("tf").alias("max_tf"))


def dense_index(df: DataFrame, col: str, name: str) -> DataFrame:
    """Number the distinct values 0..n-1 without sorting them in one task."""
    n_buckets = 4 * shuffle_width(df.sparkSession)
    values = df.select(col).distinct().withColumn("_b", F.pmod(F.xxhash64(col), F.lit(n_buckets)))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = values.groupBy("_b").agg(F.count(F.lit(1)).alias("_n")).select(
        "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))  # one row per bucket
    number = F.row_number().over(Window.partitionBy("_b").orderBy(col)) - 1
    return values.join(F.broadcast(offsets), "_b").select(col, (number + F.col("_off")).cast("int").alias(name))
