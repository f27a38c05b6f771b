"""Everything that is fitted, on disk and back: models, imputers, level groups, thresholds."""

from __future__ import annotations

import json

import numpy as np
from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlake.operators import boosting, margins, models, penalty, prep


def _write_facts(spark: SparkSession, path: str, facts: dict) -> None:
    spark.createDataFrame([(json.dumps(facts),)], "facts string").write.mode("overwrite").parquet(f"{path}/facts")


def save(spark: SparkSession, fitted, path: str, threshold: float | None = None) -> None:
    """Store a fitted object in a folder: a Spark ML model, a model of ``operators.models``, a
    ``PcaImputerModel``, or a table such as a level mapping; with its decision threshold, if any."""
    facts: dict = {"threshold": threshold}
    if isinstance(fitted, DataFrame):
        fitted.write.mode("overwrite").parquet(f"{path}/table")
        facts["kind"] = "table"
    elif isinstance(fitted, models.Fitted):
        fitted.model.write().overwrite().save(f"{path}/model")
        facts |= {"kind": "fitted", "family": fitted.family, "params": fitted.params}
    elif isinstance(fitted, models.AdaBoost):
        for i, (tree, _) in enumerate(fitted.stages):
            tree.write().overwrite().save(f"{path}/tree{i}")
        facts |= {"kind": "ada", "label": fitted.label, "params": fitted.params, "say": [s for _, s in fitted.stages]}
    elif isinstance(fitted, penalty.Linear):
        facts |= {"kind": "linear", "raw": [float(c) for c in fitted.raw], "params": fitted.params, "features": fitted.features}
    elif isinstance(fitted, margins.Machine):
        facts |= {"kind": "machine", "params": fitted.params, "weights": fitted.weights.tolist(), "cut": fitted.threshold, "features": fitted.features}
    elif isinstance(fitted, boosting.Boosted):
        facts |= {"kind": "boosted", "start": fitted.start, "trees": fitted.trees, "params": fitted.params, "losses": fitted.losses}
    elif isinstance(fitted, models.Stacked):
        for i, m in enumerate([*fitted.base, fitted.meta]):
            save(spark, m, f"{path}/part{i}")
        facts |= {"kind": "stacked", "n": len(fitted.base)}
    elif isinstance(fitted, models.CountNaiveBayes):
        numbers = [F.lit(None).cast("string")] if not fitted.number_cols else [F.to_json(fitted.moments)]
        spark.range(1).select(fitted.prior.alias("prior"), numbers[0].alias("moments")).write.mode("overwrite").parquet(f"{path}/numbers")
        if fitted.text_cols:
            fitted.levels.write.mode("overwrite").parquet(f"{path}/levels")
        facts |= {"kind": "counts", "text_cols": fitted.text_cols, "number_cols": fitted.number_cols,
                  "label": fitted.label, "laplace": fitted.laplace}
    elif isinstance(fitted, prep.PcaImputerModel):
        facts |= {"kind": "imputer", "cols": fitted.cols, "mean": fitted.mean.tolist(), "sd": fitted.sd.tolist(),
                  "loadings": fitted.loadings.tolist(), "rank": fitted.loadings.shape[1], "ridge": fitted.ridge}
    else:
        fitted.write().overwrite().save(f"{path}/model")
        facts["kind"] = "spark"
    _write_facts(spark, path, facts)


def load(spark: SparkSession, path: str):
    """``(fitted, threshold)`` as :func:`save` stored them."""
    facts = json.loads(spark.read.parquet(f"{path}/facts").first()["facts"])  # one row
    kind = facts["kind"]

    def ml(name: str):
        return DefaultParamsReader.loadParamsInstance(f"{path}/{name}", spark)

    if kind == "table":
        out = spark.read.parquet(f"{path}/table")
    elif kind == "fitted":
        params = facts["params"]
        out = models.Fitted(facts["family"], params, ml("model"), models.before_model(facts["family"], params))
    elif kind == "ada":
        out = models.AdaBoost(facts["label"], **facts["params"])
        out.stages = [(ml(f"tree{i}"), say) for i, say in enumerate(facts["say"])]
    elif kind == "linear":
        out = penalty.Linear(np.array(facts["raw"]), facts["params"], features=facts["features"])
    elif kind == "machine":
        out = margins.Machine(facts["params"], np.array(facts["weights"]), facts["cut"], facts["features"])
    elif kind == "boosted":
        out = boosting.Boosted(facts["start"], [[tuple(n) for n in t] for t in facts["trees"]], facts["params"], facts["losses"])
    elif kind == "stacked":
        parts = [load(spark, f"{path}/part{i}")[0] for i in range(facts["n"] + 1)]
        out = models.Stacked(parts[:-1], parts[-1])
    elif kind == "counts":
        out = models.CountNaiveBayes(facts["text_cols"], facts["number_cols"], facts["label"], facts["laplace"])
        row = spark.read.parquet(f"{path}/numbers").first()  # one row
        out.prior = F.lit(row["prior"])
        if out.number_cols:
            held = json.loads(row["moments"])
            out.moments = {f"{c}_{k}_{m}": F.lit(held.get(f"{c}_{k}_{m}")) for c in out.number_cols for k in ("pos", "neg") for m in ("mean", "sd")}
        if out.text_cols:
            out.levels = spark.read.parquet(f"{path}/levels")
    elif kind == "imputer":
        loadings = np.array(facts["loadings"], float).reshape(len(facts["cols"]), facts["rank"])
        out = prep.PcaImputerModel(facts["cols"], np.array(facts["mean"]), np.array(facts["sd"]), loadings, facts["ridge"])
    else:
        out = ml("model")
    return out, facts["threshold"]


def save_model(spark: SparkSession, model, threshold: float, path: str) -> None:
    save(spark, model, path, threshold)


load_model = load
