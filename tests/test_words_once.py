"""Word odds: words are written once, and repeated documents and labels count once."""

import math

import pytest
from pyspark.sql import functions as F

from churnlake.operators import sentiment


@pytest.mark.parametrize("again", [False, True])
def test_odds_and_scores_of_distinct_words(spark, again):
    rows = [(1, "a b a", 1), (2, "b c", 0), (3, "a c c", 1), (4, None, 0), (5, "", 1)] + ([(1, "a d", 1)] if again else [])
    docs = spark.createDataFrame(rows, "doc long, text string, y int")
    words, once = sentiment.distinct_words(docs, "doc", F.filter(F.split("text", " "), lambda w: w != ""))
    assert once is not again and words.count() == len(rows)
    long = words.join(docs.select("doc", "y").distinct(), "doc").select("doc", "y", F.explode("words").alias("token"))
    odds = {r["token"]: r["log_odds"] for r in sentiment.nb_log_odds(long, "doc", "y", once).collect()}
    want = {"a": math.log(3 / 4) - math.log(1 / 3), "b": math.log(2 / 4) - math.log(2 / 3), "c": math.log(2 / 4) - math.log(2 / 3)}
    want |= {"d": math.log(2 / 4) - math.log(1 / 3)} if again else {}
    assert odds == pytest.approx(want)
    table = spark.createDataFrame(list(odds.items()), "token string, log_odds double")
    scored = sentiment.nb_positive(long, "doc", table, docs=docs.select("doc").distinct(), once=once)
    got = {r["doc"]: r["p_pos"] for r in scored.collect()}
    own = {1: {"a", "b"} | ({"d"} if again else set()), 2: {"b", "c"}, 3: {"a", "c"}, 4: set(), 5: set()}
    assert got == pytest.approx({d: 1 / (1 + math.exp(-sum(want[w] for w in s))) for d, s in own.items()})
