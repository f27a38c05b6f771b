"""Quality of scored rows: label 0/1, score in 0..1.

Everything that needs an order works on counts per distinct score, accumulated
over score ranges, so no task ever sorts the whole scored set.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlake.operators.ranking import is_number, running_totals
from churnlake.session import checkpoint


def classify(score: Column, threshold: float, yes: str = "yes", no: str = "no") -> Column:
    """The class of a score; none where the score is missing (NULL or NaN)."""
    known = score.isNotNull() & ~F.isnan(score.cast("double"))
    return F.when(known & (score >= threshold), yes).when(known, no)


def confusion(df: DataFrame, observed: str, predicted: str) -> DataFrame:
    return df.groupBy(observed, predicted).agg(F.count(F.lit(1)).alias("n"))


def _cells(label: Column, hit: Column) -> list[Column]:
    def cell(y: int, p: bool) -> Column:
        return F.count(F.when((label == y) & (hit == p), 1))

    return [cell(1, True).alias("tp"), cell(0, True).alias("fp"), cell(1, False).alias("fn"), cell(0, False).alias("tn")]


def _f1(tp: Column, fp: Column, fn: Column) -> Column:
    return F.try_divide(2 * tp, 2 * tp + fp + fn)


def _class_lines(one: DataFrame) -> DataFrame:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))

    def line(name: str, t: Column, f: Column, m: Column) -> Column:
        return F.struct(
            F.lit(name).alias("class"), F.try_divide(t, t + f).alias("precision"),
            F.try_divide(t, t + m).alias("recall"), _f1(t, f, m).alias("f1"), (t + m).alias("support"),
            F.try_divide(tp + tn, tp + fp + fn + tn).alias("accuracy"))

    return one.select(F.inline(F.array(line("yes", tp, fp, fn), line("no", tn, fn, fp))))


def report(df: DataFrame, label: str, score: str, threshold: float) -> DataFrame:
    """Precision, recall, F1 and support of both classes, and the overall accuracy.

    Rows without a label or a score (NULL or NaN) count nowhere.
    """
    return _class_lines(df.filter(F.col(label).isNotNull() & is_number(score)).agg(*_cells(F.col(label), F.col(score) >= threshold)))


def naive_f1(df: DataFrame, label: str) -> DataFrame:
    """F1 and accuracy of predicting everybody positive."""
    p = F.avg(F.col(label).cast("double"))
    return df.agg(p.alias("accuracy"), (2 * p / (p + 1)).alias("f1"))


# --- metrics over all thresholds --------------------------------------------------------

def score_counts(df: DataFrame, label: str, score: str) -> DataFrame:
    """``(threshold, n, pos)``: rows and positives per distinct score, written out.

    Rows without a label or without a score (NULL or NaN) count nowhere.

    All threshold metrics read this table, so the model scores its rows once.
    """
    known = df.filter(F.col(label).isNotNull() & is_number(score))
    return checkpoint(known.groupBy(F.col(score).alias("threshold")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(label).alias("pos")))


def curve_of(counts: DataFrame) -> DataFrame:
    """Per distinct score, used as threshold: ``n, pos, tp, fp, fn, tn``."""
    run = running_totals(counts, "threshold", {"n": F.col("n"), "pos": F.col("pos")}, distinct=True)
    total = counts.select(F.struct(F.sum("n").alias("n"), F.sum("pos").alias("pos"))).scalar()
    tp, predicted = F.col("cum_pos"), F.col("cum_n")
    return run.select(
        "threshold", "n", "pos", tp.alias("tp"), (predicted - tp).alias("fp"),
        (total["pos"] - tp).alias("fn"), (total["n"] - predicted - total["pos"] + tp).alias("tn"))


def auc_of(counts: DataFrame) -> DataFrame:
    neg = (F.col("n") - F.col("pos")).cast("double")
    # tn negatives lie strictly below this score; its own negatives tie.
    right = F.sum(F.col("pos") * (F.col("tn") + neg / 2))
    pairs = F.sum("pos").cast("double") * F.sum(neg)
    return curve_of(counts).agg(F.try_divide(right, pairs).alias("auc"))


def report_of(counts: DataFrame, threshold: float) -> DataFrame:
    hit, pos, neg = F.col("threshold") >= threshold, F.col("pos"), F.col("n") - F.col("pos")

    def cell(rows: Column, where: Column) -> Column:
        return F.coalesce(F.sum(F.when(where, rows)), F.lit(0))

    return _class_lines(counts.agg(
        cell(pos, hit).alias("tp"), cell(neg, hit).alias("fp"), cell(pos, ~hit).alias("fn"), cell(neg, ~hit).alias("tn")))


def best_of(counts: DataFrame) -> DataFrame:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    recall, specificity = F.try_divide(tp, tp + fn), F.try_divide(tn, tn + fp)
    criteria = {
        "f1": _f1(tp, fp, fn),
        "accuracy": F.try_divide(tp + tn, tp + fp + fn + tn),
        "precision": F.try_divide(tp, tp + fp),
        "recall": recall,
        "specificity": specificity,
        "min_per_class_accuracy": F.least(recall, specificity),
    }
    best = curve_of(counts).agg(*[
        F.max(F.struct(v.alias("value"), F.col("threshold"))).alias(k) for k, v in criteria.items()])
    return best.select(F.inline(F.array(*[
        F.struct(F.lit(k).alias("criterion"), F.col(k)["threshold"].alias("threshold"), F.col(k)["value"].alias("value"))
        for k in criteria])))


def roc(df: DataFrame, label: str, score: str) -> DataFrame:
    return curve_of(score_counts(df, label, score)).select(
        "threshold", F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")).alias("tpr"),
        F.try_divide(F.col("fp"), F.col("fp") + F.col("tn")).alias("fpr"))


def auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Share of (positive, negative) pairs in the right order, ties counting half."""
    return auc_of(score_counts(df, label, score))


def gini(df: DataFrame, label: str, score: str) -> DataFrame:
    return auc(df, label, score).select((2 * F.col("auc") - 1).alias("gini"))


def best_thresholds(df: DataFrame, label: str, score: str) -> DataFrame:
    """For each criterion its maximum and the (highest) threshold that reaches it."""
    return best_of(score_counts(df, label, score))


def max_f1(counts: DataFrame) -> tuple[float, float]:
    """Threshold and value of the largest F1."""
    row = best_of(counts).filter("criterion = 'f1'").first()  # one row
    return row["threshold"], row["value"]


def lift(df: DataFrame, label: str, score: str) -> DataFrame:
    """Cumulated observed and predicted positives from the highest score down."""
    counts = score_counts(df, label, score).withColumn("predicted", F.col("threshold") * F.col("n"))
    run = running_totals(counts, "threshold", {c: F.col(c) for c in ("n", "pos", "predicted")}, distinct=True)
    total = counts.select(F.struct(F.sum("n").alias("n"), F.sum("pos").alias("pos"))).scalar()
    return run.select(
        F.col("threshold").alias(score), (F.col("pos") / total["pos"]).alias("perc"), F.col("cum_pos").alias("obs_cum"),
        F.col("cum_predicted").alias("pred_cum"), (F.lit(100.0) * F.col("cum_n") / total["n"]).alias("percentile"))


def regression_errors(df: DataFrame, observed: str, predicted: str) -> DataFrame:
    y = F.col(observed).cast("double")
    error = y - F.col(predicted)
    mse = F.avg(error * error)
    return df.agg(
        F.avg(F.abs(error)).alias("mae"), mse.alias("mse"), F.sqrt(mse).alias("rmse"),
        (1 - mse / F.var_pop(y)).alias("r2"))


def calibration(df: DataFrame, label: str, score: str) -> DataFrame:
    known = df.filter(F.col(label).isNotNull() & is_number(score))
    return known.agg(F.avg(score).alias("predicted"), F.avg(label).alias("observed"))


def results_table(sets: Mapping[tuple[str, str], tuple[DataFrame, float]]) -> DataFrame:
    """``(model, set, auc, accuracy, f1_score)`` from score counts with their thresholds."""
    out = None
    for (model, name), (counts, threshold) in sets.items():
        quality = report_of(counts, threshold).filter(F.col("class") == "yes")
        row = quality.select(
            F.lit(model).alias("model"), F.lit(name).alias("set"), auc_of(counts).scalar().alias("auc"),
            "accuracy", F.col("f1").alias("f1_score"))
        out = row if out is None else out.unionByName(row)
    return out
