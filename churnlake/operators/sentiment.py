"""Lexicon sentiment of texts, and text features per customer.

A lexicon is a DataFrame. Words carry their neighbours' effects before they are
joined to it, so one join and one sum per text give the score.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlake.operators.ranking import group_quantiles
from churnlake.session import broadcast_if_small, splittable, stored

# Fixed values of the published valence rules.
BOOST = 0.293
DAMPING = (1.0, 0.95, 0.9)
NEGATION = -0.74
CAPITALS = 0.733
BEFORE_BUT, AFTER_BUT = 0.5, 1.5
EXCLAMATION, MAX_EXCLAMATIONS = 0.292, 4
QUESTION, MANY_QUESTIONS = 0.18, 0.96
ALPHA = 15.0
# Fixed values of the polarity rules.
POLARITY_NEGATION = -0.5

NEGATIONS = ("not", "no", "never", "none", "nor", "cannot", "without", "dont", "don't", "isn't", "wasn't", "won't")
BOOSTERS = {
    "absolutely": BOOST, "extremely": BOOST, "really": BOOST, "so": BOOST, "totally": BOOST, "very": BOOST,
    "barely": -BOOST, "hardly": -BOOST, "slightly": -BOOST, "somewhat": -BOOST,
}
INTENSIFIERS = {"very": 1.3, "really": 1.2, "extremely": 1.5, "slightly": 0.7, "somewhat": 0.8}

# Valence, polarity, subjectivity of a few words, on the scales of two published
# lexicons under free licences (VADER, MIT; pattern, BSD) and close to their entries. Give a full
# lexicon as a table for real work.
SMALL_LEXICON = (
    ("amazing", 2.8, 0.6, 0.9), ("awful", -2.0, -1.0, 1.0), ("bad", -2.5, -0.7, 0.67),
    ("boring", -1.3, -1.0, 1.0), ("delay", -1.3, -0.2, 0.3), ("delayed", -0.9, -0.2, 0.3),
    ("enjoy", 2.2, 0.4, 0.5), ("excellent", 2.7, 1.0, 1.0), ("fun", 2.3, 0.3, 0.2),
    ("good", 1.9, 0.7, 0.6), ("great", 3.1, 0.8, 0.75), ("happy", 2.7, 0.8, 1.0),
    ("hate", -2.7, -0.8, 0.9), ("helpful", 1.8, 0.3, 0.4), ("horrible", -2.5, -1.0, 1.0),
    ("love", 3.2, 0.5, 0.6), ("lost", -1.3, -0.2, 0.3), ("nice", 1.8, 0.6, 1.0),
    ("poor", -2.1, -0.4, 0.6), ("rude", -2.0, -0.3, 0.6), ("sad", -2.1, -0.5, 1.0),
    ("safe", 1.9, 0.5, 0.5), ("terrible", -2.1, -1.0, 1.0), ("thanks", 1.9, 0.2, 0.2),
    ("unsafe", -1.9, -0.5, 0.5), ("wonderful", 2.7, 1.0, 1.0), ("worst", -3.1, -1.0, 1.0),
)


def small_lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        list(SMALL_LEXICON), "token string, valence double, polarity double, subjectivity double")


def bare_words(text: Column) -> Column:
    """Words split at blanks, punctuation at their ends removed, case kept."""
    return F.transform(
        F.filter(F.split(text, r"\s+"), lambda w: w != ""),
        lambda w: F.regexp_replace(w, r"^[\p{P}\p{S}]+|[\p{P}\p{S}]+$", ""))


def _lookup(word: Column, table: Mapping[str, float], default: float) -> Column:
    entries = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(entries, word), F.lit(default))


def _before(words: Column, i: Column, distance: int) -> Column:
    return F.when(i >= distance, F.get(words, i - distance))


def _words(df: DataFrame, text: str) -> DataFrame:
    words = bare_words(F.col(text))
    return df.withColumn("_raw", words).withColumn("_w", F.transform("_raw", F.lower))


def valence(df: DataFrame, doc: str, text: str, lexicon: DataFrame,
            boosters: Mapping[str, float] = BOOSTERS, negations: Sequence[str] = NEGATIONS,
            contrast: str = "but") -> DataFrame:
    """``(doc, sentiment)``: the compound valence in -1..1, 0 for texts without known words.

    Boosters up to three words back add, negations there flip, capitals and
    punctuation add weight, and what follows the contrast word counts more.
    """
    known = lexicon.filter(~F.col("token").isin(*boosters, *negations)).select("token", "valence")

    def marked(word: Column, i: Column) -> Column:
        earlier = [_before(F.col("_w"), i, d) for d in (1, 2, 3)]
        boost, negated = F.lit(0.0), F.lit(1.0)
        for w, damp in zip(earlier, DAMPING):
            boost = boost + _lookup(w, boosters, 0.0) * damp
            negated = negated * F.when(F.coalesce(w.isin(*negations), F.lit(False)), NEGATION).otherwise(1.0)
        shout = F.get(F.col("_raw"), i)
        capitals = (shout == F.upper(shout)) & (shout != F.lower(shout)) & (F.length(shout) > 1)
        position = F.col("_contrast")
        side = F.when(position < 0, 1.0).when(i < position, BEFORE_BUT).when(i > position, AFTER_BUT).otherwise(1.0)
        return F.struct(word.alias("token"), boost.alias("boost"), (negated * side).alias("factor"),
                        capitals.alias("capitals"))

    # Per-text facts are columns before the words fan out, so they are found once.
    words = _words(df.select(doc, text), text).withColumns({
        "_contrast": F.array_position("_w", F.lit(contrast)) - 1,
        "_mixed": F.exists("_raw", lambda w: w != F.upper(w)),
        "_exclaim": F.length(text) - F.length(F.replace(F.col(text), F.lit("!"), F.lit(""))),
        "_ask": F.length(text) - F.length(F.replace(F.col(text), F.lit("?"), F.lit(""))),
    }).select(doc, "_mixed", "_exclaim", "_ask", F.inline_outer(F.transform("_w", marked)))
    hit = words.join(broadcast_if_small(splittable(known, "token")), "token", "left")
    sign = F.signum("valence")
    shouted = F.when(F.col("capitals") & F.col("_mixed"), CAPITALS).otherwise(0.0)
    score = (F.col("valence") + sign * (F.col("boost") + shouted)) * F.col("factor")
    sums = hit.groupBy(doc).agg(
        F.coalesce(F.sum(score), F.lit(0.0)).alias("_s"),
        F.first("_exclaim").alias("_e"), F.first("_ask").alias("_q"))
    emphasis = F.least(F.col("_e"), F.lit(MAX_EXCLAMATIONS)) * EXCLAMATION + F.when(
        F.col("_q") <= 1, 0.0).when(F.col("_q") <= 3, F.col("_q") * QUESTION).otherwise(MANY_QUESTIONS)
    # Sums that cancel exactly must stay 0 whatever the order of summation.
    total = F.round("_s", 9)
    total = total + F.signum(total) * emphasis
    return sums.select(doc, (total / F.sqrt(total * total + ALPHA)).alias("sentiment"))


def polarity_subjectivity(df: DataFrame, doc: str, text: str, lexicon: DataFrame,
                          intensifiers: Mapping[str, float] = INTENSIFIERS,
                          negations: Sequence[str] = NEGATIONS) -> DataFrame:
    """``(doc, polarity, subjectivity)``: means over known words, 0 where there are none.

    The word before scales both; a negation before (or before the scaling word)
    halves and flips the polarity.
    """
    known = lexicon.filter(~F.col("token").isin(*intensifiers, *negations)).select("token", "polarity", "subjectivity")

    def marked(word: Column, i: Column) -> Column:
        one, two = _before(F.col("_w"), i, 1), _before(F.col("_w"), i, 2)
        scaled = F.coalesce(one.isin(*intensifiers), F.lit(False))
        before = F.when(scaled, two).otherwise(one)
        negated = F.coalesce(before.isin(*negations), F.lit(False))
        return F.struct(word.alias("token"), _lookup(one, intensifiers, 1.0).alias("scale"),
                        F.when(negated, POLARITY_NEGATION).otherwise(1.0).alias("flip"))

    words = _words(df.select(doc, text), text).select(doc, F.inline_outer(F.transform("_w", marked)))
    hit = words.join(broadcast_if_small(splittable(known, "token")), "token", "left")

    def clip(c: Column, low: float) -> Column:
        return F.least(F.greatest(c, F.lit(low)), F.lit(1.0))

    has = F.col("polarity").isNotNull()
    return hit.groupBy(doc).agg(
        F.coalesce(F.avg(F.when(has, clip(F.col("polarity") * F.col("scale"), -1.0) * F.col("flip"))), F.lit(0.0)).alias("polarity"),
        F.coalesce(F.avg(F.when(has, clip(F.col("subjectivity") * F.col("scale"), 0.0))), F.lit(0.0)).alias("subjectivity"))


def distinct_words(docs: DataFrame, doc: str, tokens: Column) -> tuple[DataFrame, bool]:
    """``(doc, words)``: the distinct words of each row, written once as several steps read them; and whether no ``doc`` comes twice."""
    words = stored(docs.select(doc, F.array_distinct(tokens).alias("words")), "words")
    return words, words.groupBy(doc).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()


def nb_log_odds(tokens: DataFrame, doc: str, label: str, once: bool = False) -> DataFrame:
    """``(token, log_odds)`` of word presence in positive against negative texts; ``once``: each word is there once for a text and label."""
    presence = tokens.select(doc, label, "token")
    presence = presence if once else presence.distinct()
    sizes = tokens.select(doc, label).distinct().agg(
        F.struct(F.sum(label).alias("pos"), F.sum(1 - F.col(label)).alias("neg")).alias("s")).scalar()
    counts = presence.groupBy("token").agg(F.sum(label).alias("p"), F.sum(1 - F.col(label)).alias("n"))
    odds = F.log((F.col("p") + 1) / (sizes["pos"] + 2)) - F.log((F.col("n") + 1) / (sizes["neg"] + 2))
    return counts.select("token", odds.alias("log_odds"))


def nb_positive(tokens: DataFrame, doc: str, log_odds: DataFrame, prior: float = 0.0,
                docs: DataFrame | None = None, once: bool = False) -> DataFrame:
    """``(doc, p_pos)``: naive-Bayes probability that the text is positive.

    With ``docs``, texts without any word get the prior's probability. ``once``: each word is there once for a text.
    """
    present = tokens.select(doc, "token")
    seen = (present if once else present.distinct()).join(broadcast_if_small(splittable(log_odds, "token")), "token", "left")
    total = F.lit(prior) + F.coalesce(F.sum("log_odds"), F.lit(0.0))
    out = seen.groupBy(doc).agg((1 / (1 + F.exp(-total))).alias("p_pos"))
    if docs is None:
        return out
    return docs.select(doc).join(out, doc, "left").fillna(1 / (1 + math.exp(-prior)), subset=["p_pos"])


def polarity_class(polarity: Column, cut: float = 0.5) -> Column:
    return (
        F.when(polarity.isNull(), None)
        .when(polarity >= cut, "very positive").when(polarity >= 0, "positive")
        .when(polarity >= -cut, "negative").otherwise("very negative"))


def customer_features(scores: DataFrame, key: str, cols: Mapping[str, str],
                      stats: Sequence[str] = ("median",), flags: Sequence[str] = ()) -> DataFrame:
    """One row per customer: statistics of text scores, number of texts, sums of topic flags.

    ``cols`` maps score columns to the short name used in the result, as in
    ``pol_med``.
    """
    plain = {"min": F.min, "mean": F.avg, "max": F.max}
    aggregates = [F.count(F.lit(1)).alias("num_texts")]
    aggregates += [plain[s](c).alias(f"{short}_{s}") for c, short in cols.items() for s in stats if s in plain]
    aggregates += [F.sum(f).alias(f) for f in flags]
    out = scores.groupBy(key).agg(*aggregates)
    if "median" in stats:
        long = scores.select(key, *[F.col(c).cast("double").alias(s) for c, s in cols.items()]).unpivot(
            [key], list(cols.values()), "_score", "_value")
        medians = group_quantiles(long, [key, "_score"], "_value", {"_m": 0.5})
        wide = medians.groupBy(key).agg(*[
            F.max(F.when(F.col("_score") == s, F.col("_m"))).alias(f"{s}_med") for s in cols.values()])
        out = out.join(wide, key, "left")
    return out


def attach_features(df: DataFrame, features: DataFrame, key: str) -> DataFrame:
    """Left join of text features; customers without texts get 0."""
    new = [c for c in features.columns if c != key]
    return df.join(features, key, "left").fillna(0, subset=new)


def differing(a: DataFrame, b: DataFrame, key: str, col: str, tolerance: float = 0.0) -> DataFrame:
    """Keys whose score differs between two versions."""
    both = a.select(key, F.col(col).alias(f"{col}_a")).join(b.select(key, F.col(col).alias(f"{col}_b")), key)
    return both.filter(F.abs(F.col(f"{col}_a") - F.col(f"{col}_b")) > tolerance)
