"""LDA in rounds over blocks of documents against Spark ML's own, and counts that it must refuse."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.ml.clustering import LDA
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import functions as F

from churnlake.operators import topics
from churnlake.operators.texts import dense_index
from churnlake.session import checkpoint


def counts_of(spark, n_docs=600, n_terms=150, seed=4):
    r = np.random.default_rng(seed)
    rows = []
    for d in range(n_docs):
        own = np.minimum(r.zipf(1.4, r.integers(1, 40)), n_terms) + (d % 3) * 20
        rows += [(f"{d}-m", f"w{t % n_terms:03d}", int(n)) for t, n in zip(*np.unique(own % n_terms, return_counts=True))]
    rows += [("none", "w001", 0), ("none", "only", 0), (None, "w002", 3)]
    return spark.createDataFrame(rows, "doc string, term string, tf long")


def by_spark(counts, k, max_iter, n_terms):
    words = checkpoint(counts.select("doc", "term", "tf"))
    index = checkpoint(dense_index(words, "term", "id"))
    size = index.count()
    sparse = F.udf(lambda cells: Vectors.sparse(size, sorted((c["id"], float(c["tf"])) for c in cells)), VectorUDT())
    vectors = words.join(index, "term").groupBy("doc").agg(sparse(F.collect_list(F.struct("id", "tf"))).alias("features"))
    rows = vectors.join(dense_index(words, "doc", "number"), "doc")
    model = LDA(k=k, maxIter=max_iter, seed=1, optimizer="em", docConcentration=[1.1], topicConcentration=1.1).fit(rows.select("features"))
    got = model.describeTopics(n_terms).select("topic", F.inline(F.arrays_zip("termIndices", "termWeights")))
    return got.join(index, F.col("termIndices") == F.col("id")).select("topic", "term", F.col("termWeights").alias("weight"))


@pytest.mark.parametrize("cells", [topics.LDA_CELLS, 300])
def test_lda_is_that_of_spark_ml_for_any_blocks(spark, cells):
    """300 cells make about 70 blocks of 75 entries, so that most terms lie in many of them."""
    counts = counts_of(spark)
    got = topics.lda(counts, "doc", k=4, max_iter=6, n_terms=9, cells=cells)
    assert got.dtypes == [("topic", "int"), ("term", "string"), ("weight", "double")]
    got = {(r.topic, r.term): r.weight for r in got.collect()}
    assert got == pytest.approx({(r.topic, r.term): r.weight for r in by_spark(counts, 4, 6, 9).collect()}, rel=1e-9)
    assert len(got) == 36


def test_rounds_move_a_key_once_for_a_block(spark, monkeypatch):
    """Stored sums hold a key for each term and document of a block and not for each entry, in at most blocks x blocks rows."""
    stored = []
    monkeypatch.setattr(topics, "checkpoint", lambda df: stored.append(checkpoint(df)) or stored[-1])
    counts = spark.range(4000).selectExpr("CAST(id % 400 AS string) AS doc", "concat('w', id DIV 400) AS term", "1L AS tf")
    topics.lda(counts, "doc", k=3, max_iter=2, n_terms=2).collect()
    words, index, *rounds = stored
    n_blocks = 4 * spark.sparkContext.defaultParallelism
    assert len(rounds) == 3
    for sums in rounds:
        keys, rows = sums.agg(F.sum(F.length("keys")) / 8, F.count("keys")).first()
        assert keys == 400 + 10 * n_blocks and rows <= n_blocks ** 2
        assert sums.agg(F.sum(F.col("of_terms")[0] + F.col("of_terms")[1] + F.col("of_terms")[2])).first()[0] == pytest.approx(4000)


@pytest.mark.parametrize("row", [("0-m", "w001", 5), ("new", "w001", None)])
def test_lda_refuses_terms_that_repeat_and_missing_counts(spark, row):
    bad = counts_of(spark, 5).filter("doc IS NOT NULL").union(spark.createDataFrame([row, row], "doc string, term string, tf long"))
    with pytest.raises(PySparkException):
        topics.lda(bad, "doc", k=2, max_iter=1).collect()


def test_java_draws():
    """The first doubles of java.util.Random(42), and the same ones by steps ahead."""
    first = np.array([42 ^ topics.JAVA_MUL], np.uint64)
    got = [float(x[0]) for x in topics._doubles(first, 6)]
    assert got[:2] == [0.7275636800328681, 0.6832234717598454]
    assert [float(x) for x in next(topics._doubles(topics._ahead(first, np.arange(3), 2), 1))] == got[::2]
