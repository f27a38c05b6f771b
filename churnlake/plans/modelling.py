"""Queries: model families, their search, ensembles, and scoring of new trips."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from churnlake.operators import board, boosting, evaluate, explain, landmarks, levels, models, penalty, prep, profile, tree_contributions
from churnlake.plans import roles
from churnlake.plans.preparing import split_trips
from churnlake.plans.registry import query
from churnlake.plans.roles import CRM, FINANCE, MESSAGES, SCORED, TRIPS, rounded, with_ctes
from churnlake.session import checkpoint, shared_folder
from churnlake.sources import models as stored
from churnlake.sources import tables

TEXT, NUMBERS = ("travel_type", "month"), ("price", "program")


def with_month(df):
    return df.withColumn("month", F.month("departure_date").cast("string"))


def prepared(spark, sf):
    """Training and test trips with a ``features`` vector fitted on the training part."""
    train, test = (with_month(d) for d in split_trips(spark, sf))
    pipeline = prep.feature_pipeline(TEXT, NUMBERS).fit(train)
    keep = ["orderkey", "retained", "features"]
    return checkpoint(pipeline.transform(train).select(*keep)), pipeline.transform(test).select(*keep)


def results(name, model, train, test):
    """AUC, accuracy and F1 of a model on both sets, at the threshold best for training F1."""
    counts = {s: evaluate.score_counts(model.score(d), "retained", "pred") for s, d in (("train", train), ("test", test))}
    cut, _ = evaluate.max_f1(counts["train"])
    return evaluate.results_table({(name, s): (c, cut) for s, c in counts.items()})


def searched(spark, sf, family, candidates, **kw):
    train, test = prepared(spark, sf)
    found = models.search(family, train, "retained", "orderkey", candidates, **kw)
    return results(family, found.best, train, test)


@query("l1_elastic_net")
def _(spark, sf):
    """Random mixing weights, each with two penalties."""
    alphas = models.random_params(2, 2020, alpha=lambda r: round(r.random(), 4))
    return searched(spark, sf, "glm", [{**a, "lambda": v} for a in alphas for v in (0.001, 0.01)])


ALPHAS = [p["alpha"] for p in models.random_params(100, 2020, alpha=lambda r: round(r.random(), 4))]


def searched_path(spark, sf):
    """The paths of all mixing weights on two folds, and for each the penalty with the least out-of-fold deviance."""
    train, test = prepared(spark, sf)
    folded = checkpoint(models.add_folds(train, "retained", "orderkey", 2))
    path = penalty.penalty_path(folded, "retained", ALPHAS)
    deviance = penalty.deviances(path, folded, "retained")
    return path, deviance, [(i, int(j)) for i, j in enumerate(deviance.argmin(axis=1))], folded, test


@query("l1_penalty_path")
def _(spark, sf):
    """100 mixing weights, each with its whole path; the winner has the best F1 of out-of-fold scores."""
    path, _, chosen, folded, test = searched_path(spark, sf)
    scores = penalty.out_of_fold(path, folded, "retained", "orderkey", chosen)  # read once
    best = int(board.top(scores, "retained", 1)[0].rsplit("_", 1)[1])
    model = path.model(*chosen[best])
    out = results("glm", model, folded, test)
    return out.withColumns({"alpha": F.lit(model.params["alpha"]), "lambda": F.lit(model.params["lambda"])})


@query("l1_path_start", with_ctes(TRIPS) + f""",
tr AS (SELECT *, month(departure_date) AS m FROM trips WHERE orderkey % 4 <> 0),
x AS (SELECT abs(corr(price, retained)) AS r FROM tr UNION ALL SELECT abs(corr(program, retained)) FROM tr
      UNION ALL SELECT abs(corr(CASE WHEN t.travel_type = l.travel_type THEN 1 ELSE 0 END, retained)) FROM tr t, (SELECT DISTINCT travel_type FROM tr) l GROUP BY l.travel_type
      UNION ALL SELECT abs(corr(CASE WHEN t.m = l.m THEN 1 ELSE 0 END, retained)) FROM tr t, (SELECT DISTINCT m FROM tr) l GROUP BY l.m)
SELECT alpha, round((SELECT max(r) FROM x) * (SELECT stddev_pop(retained) FROM tr) / greatest(alpha, 0.001), 7) AS first_lambda
FROM (SELECT unnest({ALPHAS}::DOUBLE[]) AS alpha)""")
def _(spark, sf):
    """The largest penalty of each path, from which on a coefficient is not 0."""
    train, _ = prepared(spark, sf)
    path = penalty.penalty_path(train, "retained", ALPHAS, n_lambdas=1, folds=0)
    assert (abs(path.coefficients[:, 0, 0, 1:]) < 1e-6).all()
    return spark.createDataFrame([(float(a), round(float(v), 7)) for a, v in zip(path.alphas, path.lambdas[:, 0])], "alpha double, first_lambda double")


@query("l1_path_stationarity", f"SELECT alpha, true AS stationary FROM (SELECT unnest({ALPHAS}::DOUBLE[]) AS alpha)")
def _(spark, sf):
    """The chosen solution of every mixing weight, tested for stationarity by an aggregation over the rows."""
    path, _, chosen, folded, _ = searched_path(spark, sf)
    return penalty.violations(path, folded, "retained", chosen).select("alpha", (F.col("violation") < 1e-6).alias("stationary"))


@query("l2_naive_bayes_counts", with_ctes(TRIPS) + """,
tr AS (SELECT *, CAST(month(departure_date) AS VARCHAR) AS month FROM trips WHERE orderkey % 4 <> 0),
te AS (SELECT *, CAST(month(departure_date) AS VARCHAR) AS month FROM trips WHERE orderkey % 4 = 0),
lv AS (SELECT 'travel_type' AS c, travel_type AS v, sum(retained) AS p, sum(1 - retained) AS n FROM tr GROUP BY 2
       UNION ALL SELECT 'month', month, sum(retained), sum(1 - retained) FROM tr GROUP BY 2),
od AS (SELECT c, v, ln((p + 1) / (sum(p) OVER w + count(*) OVER w)) - ln((n + 1) / (sum(n) OVER w + count(*) OVER w)) AS o
       FROM lv WINDOW w AS (PARTITION BY c)),
st AS (SELECT avg(price) FILTER (retained = 1) AS mp, stddev_samp(price) FILTER (retained = 1) AS sp,
              avg(price) FILTER (retained = 0) AS mn, stddev_samp(price) FILTER (retained = 0) AS sn,
              ln(sum(retained) / sum(1 - retained)) AS prior FROM tr)
SELECT orderkey, round(1 / (1 + exp(-(prior + coalesce(a.o, 0) + coalesce(b.o, 0)
   - ln(sp) - ((price - mp) / sp) ** 2 / 2 + ln(sn) + ((price - mn) / sn) ** 2 / 2))), 7) AS pred
FROM te, st LEFT JOIN od a ON a.c = 'travel_type' AND a.v = travel_type LEFT JOIN od b ON b.c = 'month' AND b.v = month""")
def _(spark, sf):
    """Exact group-count form on text and number columns."""
    train, test = (with_month(d) for d in split_trips(spark, sf))
    model = models.CountNaiveBayes(TEXT, ["price"], "retained").fit(train)
    return rounded(model.score(test, "orderkey"), pred=7)


@query("l3_kernel_svm")
def _(spark, sf):
    return searched(spark, sf, "svm", models.grid(gamma=[0.05, 0.5], reg=[0.001]), metric="f1")


# The grid of kernel widths and costs.
GAMMAS, COSTS = [0.001, 0.005, 0.01, 0.05], [0.001, 0.01, 0.1, 1.0, 10.0, 100.0]
LANDMARKS = 40


def kernel_grid(spark, sf):
    """The machines of the whole grid on two folds and on all training rows, with the rows they are fitted on."""
    train, test = (d.withColumn("x", vector_to_array("features")) for d in prepared(spark, sf))
    folded = checkpoint(models.add_folds(train, "retained", "orderkey", 2))
    mean, sd = landmarks.scales(folded, "x")
    marks = landmarks.Landmarks(landmarks.chosen_landmarks(folded, "x", LANDMARKS, mean, sd), mean, sd, GAMMAS)
    return landmarks.fit_grid(folded, "retained", "x", marks, COSTS), folded, test


@query("l3_kernel_grid")
def _(spark, sf):
    """Every width and cost: kernel error, best out-of-fold F1 over all thresholds, and whether the solution is stationary."""
    machines, folded, _ = kernel_grid(spark, sf)
    scores = machines.out_of_fold(folded, "retained", "orderkey", "fold", "x")  # read once
    f1 = {r["model"]: r["f1"] for r in board.best_f1(scores, ["model"], "retained").collect()}  # a row per model
    rows = [(machines.name(i, j), g, c, f1.get(machines.name(i, j)), max(machines.slopes[i, j, f] for f in range(3)) <= 1e-6)
            for i, g in enumerate(GAMMAS) for j, c in enumerate(COSTS)]
    found = spark.createDataFrame(rows, "model string, gamma double, cost double, f1 double, stationary boolean")
    return found.join(F.broadcast(machines.marks.errors(folded, "x")), "gamma")


@query("l3_kernel_error_of_two_landmarks", with_ctes(TRIPS) + f""",
tr AS (SELECT * FROM trips WHERE orderkey % 4 <> 0),
z AS (SELECT (price - avg(price) OVER ()) / stddev_samp(price) OVER () AS a, (program - avg(program) OVER ()) / stddev_samp(program) OVER () AS b FROM tr),
k AS (SELECT g, exp(-g * ((a + 1) ** 2 + b ** 2)) AS u, exp(-g * ((a - 0.5) ** 2 + (b - 1) ** 2)) AS v, exp(-g * 3.25) AS w
      FROM z, (SELECT unnest({GAMMAS}::DOUBLE[]) AS g))
SELECT g AS gamma, round(avg(1 - (u * u + v * v - 2 * w * u * v) / (1 - w * w)), 7) AS kernel_error FROM k GROUP BY 1""")
def _(spark, sf):
    """What two given landmarks leave out of the kernel of two numbers."""
    train = split_trips(spark, sf)[0].select(F.array(F.col("price").cast("double"), F.col("program").cast("double")).alias("x"))
    marks = landmarks.Landmarks(np.array([[-1.0, 0.0], [0.5, 1.0]]), *landmarks.scales(train, "x"), GAMMAS)
    return rounded(marks.errors(train, "x"), kernel_error=7)


@query("l4_gradient_boosting")
def _(spark, sf):
    """Random search; a tenth of the rows tells when to stop adding trees."""
    train, test = prepared(spark, sf)
    train = train.withColumn("validation", F.pmod(F.xxhash64("orderkey"), F.lit(10)) == 0)
    candidates = models.random_params(
        2, 1, trees=[10, 20], depth=[3, 4], rate=[0.1, 0.2], sample=[0.8, 1.0], min_rows=[1, 10], bins=[32, 64],
        validation_col=["validation"])
    found = models.search("gbm", train, "retained", "orderkey", candidates)
    return results("gbm", found.best, train, test)


@query("l5_boosted_classifier_and_regressor")
def _(spark, sf):
    train, test = prepared(spark, sf)
    classifier = models.fit("gbm", train, "retained", {"trees": 20, "depth": 3, "rate": 0.3})
    regressor = models.fit_regressor(train, "retained", {"trees": 20, "depth": 3})
    return results("gbm", classifier, train, test).unionByName(results("gbm_regressor", regressor, train, test))


@query("l6_random_forest")
def _(spark, sf):
    return searched(spark, sf, "rf", models.grid(trees=[20], depth=[4, 6]))


@query("l7_decision_tree")
def _(spark, sf):
    return searched(spark, sf, "dt", models.grid(depth=[3, 5], min_rows=[1, 20]))


@query("l7_decision_tree_rules")
def _(spark, sf):
    train, _ = prepared(spark, sf)
    text = models.rules(models.fit("dt", train, "retained", {"depth": 3}))
    return spark.createDataFrame(list(enumerate(text.rstrip().split("\n"))), "line int, rule string")


@query("l8_adaboost")
def _(spark, sf):
    train, test = prepared(spark, sf)
    return results("ada", models.fit("ada", train, "retained", {"trees": 4, "depth": 10}), train, test)


@query("l9_neural_network")
def _(spark, sf):
    return searched(spark, sf, "nn", [{"hidden": (8,)}, {"hidden": (8, 4)}])


@query("l10_stacked_ensemble")
def _(spark, sf):
    train, test = prepared(spark, sf)
    base = [("glm", {"lambda": 0.01}), ("gbm", {"trees": 10, "depth": 3}), ("nn", {"hidden": (8,), "max_iter": 50})]
    return results("stacked", models.stack(base, train, "retained", "orderkey"), train, test)


@query("l11_automl")
def _(spark, sf):
    train, test = prepared(spark, sf)
    best, _ = models.automl(train, "retained", "orderkey", [
        ("glm", models.grid(alpha=[0.0, 1.0])), ("dt", models.grid(depth=[4])), ("gbm", [{"trees": 10, "depth": 3}])])
    return results("auto", best, train, test)


@query("l12_grid_search")
def _(spark, sf):
    """Three stratified folds, scored by AUC, one row per parameter set."""
    train, _ = prepared(spark, sf)
    found = models.search("dt", train, "retained", "orderkey", models.grid(depth=[3, 5]), folds=3, metric="auc")
    return found.report(spark)


@query("l12_stratified_folds", with_ctes(TRIPS) + """
SELECT orderkey, retained, CAST((row_number() OVER (ORDER BY retained, md5(orderkey || '|1'), orderkey) - 1) % 5 AS INTEGER) AS fold
FROM trips""")
def _(spark, sf):
    trips = roles.trips(spark, sf).select("orderkey", "retained")
    return models.add_folds(trips, "retained", "orderkey", 5)


@query("l13_random_search")
def _(spark, sf):
    """Stops early once two draws in a row bring nothing."""
    train, _ = prepared(spark, sf)
    draws = models.random_params(5, 1, alpha=lambda r: round(r.random(), 4), **{"lambda": [0.001, 0.01, 0.1]})
    found = models.search("glm", train, "retained", "orderkey", draws, metric="accuracy", stop_rounds=2)
    return found.report(spark)


LAPLACES = (0.5, 1.0, 500.0)
# Accuracy of each smoothing on each of two stratified folds of the training trips.
COUNTS_CV = with_ctes(TRIPS) + f""",
f AS (SELECT *, CAST(month(departure_date) AS VARCHAR) AS month,
        (row_number() OVER (ORDER BY retained, md5(orderkey || '|1'), orderkey) - 1) % 2 AS fold FROM trips WHERE orderkey % 4 <> 0),
lap AS (SELECT unnest({list(LAPLACES)}) AS a), held AS (SELECT unnest([0, 1]) AS h),
lv AS (SELECT h, 'travel_type' AS c, travel_type AS v, sum(retained) AS p, sum(1 - retained) AS n FROM f JOIN held ON fold <> h GROUP BY 1, 3
       UNION ALL SELECT h, 'month', month, sum(retained), sum(1 - retained) FROM f JOIN held ON fold <> h GROUP BY 1, 3),
od AS (SELECT h, a, c, v, ln((p + a) / (sum(p) OVER w + a * count(*) OVER w)) - ln((n + a) / (sum(n) OVER w + a * count(*) OVER w)) AS o
       FROM lv, lap WINDOW w AS (PARTITION BY h, a, c)),
pr AS (SELECT h, ln(sum(retained) / sum(1 - retained)) AS prior FROM f JOIN held ON fold <> h GROUP BY 1),
sc AS (SELECT lap.a, f.fold, retained, prior + coalesce(x.o, 0) + coalesce(y.o, 0) AS z FROM f JOIN pr ON pr.h = fold CROSS JOIN lap
       LEFT JOIN od x ON x.h = fold AND x.a = lap.a AND x.c = 'travel_type' AND x.v = travel_type
       LEFT JOIN od y ON y.h = fold AND y.a = lap.a AND y.c = 'month' AND y.v = month),
acc AS (SELECT a, fold, avg(CASE WHEN (z >= 0) = (retained = 1) THEN 1.0 ELSE 0.0 END) AS accuracy FROM sc GROUP BY 1, 2)
"""


def searched_counts(spark, sf):
    train, test = (with_month(d) for d in split_trips(spark, sf))
    return *models.search_counts(train, TEXT, [], "retained", "orderkey", LAPLACES), test


@query("l2_naive_bayes", COUNTS_CV + """,
best AS (SELECT arg_max(a, (round(m, 12), -a)) AS a FROM (SELECT a, avg(accuracy) AS m FROM acc GROUP BY 1)),
tl AS (SELECT 'travel_type' AS c, travel_type AS v, sum(retained) AS p, sum(1 - retained) AS n FROM f GROUP BY 2
       UNION ALL SELECT 'month', month, sum(retained), sum(1 - retained) FROM f GROUP BY 2),
to_ AS (SELECT c, v, ln((p + a) / (sum(p) OVER w + a * count(*) OVER w)) - ln((n + a) / (sum(n) OVER w + a * count(*) OVER w)) AS o
       FROM tl, best WINDOW w AS (PARTITION BY c))
SELECT orderkey, round(1 / (1 + exp(-((SELECT ln(sum(retained) / sum(1 - retained)) FROM f) + coalesce(x.o, 0) + coalesce(y.o, 0)))), 7) AS pred
FROM trips LEFT JOIN to_ x ON x.c = 'travel_type' AND x.v = travel_type
LEFT JOIN to_ y ON y.c = 'month' AND y.v = CAST(month(departure_date) AS VARCHAR) WHERE orderkey % 4 = 0""")
def _(spark, sf):
    """The smoothing of the best cross-validated accuracy, then scores of new trips."""
    best, _, test = searched_counts(spark, sf)
    return rounded(best.score(test, "orderkey"), pred=7)


@query("l14_search_report", COUNTS_CV + "SELECT CAST(a AS DOUBLE) AS laplace, round(avg(accuracy), 9) AS mean, round(stddev_pop(accuracy), 9) AS sd FROM acc GROUP BY 1")
def _(spark, sf):
    """Mean and deviation over the folds, one row per smoothing."""
    _, scores, _ = searched_counts(spark, sf)
    out = scores.groupBy("laplace").agg(F.avg("accuracy").alias("mean"), F.stddev_pop("accuracy").alias("sd"))
    return rounded(out, mean=9, sd=9)


def f1_sql(part):
    hit = "pred >= cut"
    return (f"2 * count(*) FILTER ({part} AND retained = 1 AND {hit}) / (2 * count(*) FILTER ({part} AND retained = 1 AND {hit})"
            f" + count(*) FILTER ({part} AND retained = 0 AND {hit}) + count(*) FILTER ({part} AND retained = 1 AND NOT {hit}))")


CUTS = [0.5, 0.55, 0.6, 0.62, 0.64, 0.66, 0.68, 0.7]


@query("l15_leaderboard", with_ctes(SCORED) + f""",
cuts AS (SELECT unnest({CUTS}) AS cut),
res AS (SELECT 'cut_' || CASE WHEN cut = 0.6 THEN 'cv_' ELSE '' END || CAST(CAST(round(cut * 100) AS INTEGER) AS VARCHAR) AS modID,
               {f1_sql('orderkey % 4 <> 0')} AS trainF1, {f1_sql('orderkey % 4 = 0')} AS testF1 FROM scored, cuts GROUP BY cut)
SELECT modID, trainF1, testF1, abs(trainF1 - testF1) AS diff FROM res
WHERE trainF1 < 1 AND abs(trainF1 - testF1) < 0.025 AND NOT contains(modID, '_cv_')""")
def _(spark, sf):
    """Thresholds of the formula scorer compared as if they were models."""
    scored = roles.scored(spark, sf).withColumn("cut", F.explode(F.array(*[F.lit(c) for c in CUTS])))
    train, yes, hit = F.col("orderkey") % 4 != 0, F.col("retained") == 1, F.col("pred") >= F.col("cut")

    def f1(part):
        tp, wrong = F.count(F.when(part & yes & hit, 1)), F.count(F.when(part & (yes != hit), 1))
        return 2 * tp / (2 * tp + wrong)

    name = F.concat(F.when(F.col("cut") == 0.6, "cut_cv_").otherwise("cut_"), F.round(F.col("cut") * 100).cast("int").cast("string"))
    board = scored.groupBy("cut").agg(f1(train).alias("trainF1"), f1(~train).alias("testF1"))
    return models.leaderboard(board.withColumn("modID", name).drop("cut"))


COUNT_MODELS = {f"counts_grid_model_{i}": (text, laplace) for i, (text, laplace) in enumerate(
    (text, laplace) for text in (TEXT[:1], TEXT[1:], TEXT) for laplace in LAPLACES)}


class Keyed:
    """A count model whose scores are joined to the rows again."""

    def __init__(self, model):
        self.model = model

    def score(self, df):
        return df.join(self.model.score(df, "orderkey"), "orderkey")


BOARD_SQL = with_ctes(TRIPS) + ", " + f"""
t AS (SELECT *, CAST(month(departure_date) AS VARCHAR) AS month, CASE WHEN orderkey % 4 <> 0 THEN 'train' ELSE 'test' END AS set_ FROM trips),
lv AS (SELECT 'travel_type' AS c, travel_type AS v, sum(retained) AS p, sum(1 - retained) AS n FROM t WHERE set_ = 'train' GROUP BY 2
       UNION ALL SELECT 'month', month, sum(retained), sum(1 - retained) FROM t WHERE set_ = 'train' GROUP BY 2),
m AS (SELECT unnest({[{"modID": k, "lap": v[1], "a": int("travel_type" in v[0]), "b": int("month" in v[0])} for k, v in COUNT_MODELS.items()]}) AS m),
od AS (SELECT m.modID, c, v, ln((p + m.lap) / (sum(p) OVER w + m.lap * count(*) OVER w)) - ln((n + m.lap) / (sum(n) OVER w + m.lap * count(*) OVER w)) AS o
       FROM lv, m WINDOW w AS (PARTITION BY m.modID, c)),
sc AS (SELECT m.modID, set_, retained, CAST(round(1000 / (1 + exp(-((SELECT ln(sum(retained) / sum(1 - retained)) FROM t WHERE set_ = 'train')
         + m.a * coalesce(x.o, 0) + m.b * coalesce(y.o, 0))))) AS INTEGER) AS cut
       FROM t CROSS JOIN m LEFT JOIN od x ON x.modID = m.modID AND x.c = 'travel_type' AND x.v = travel_type
       LEFT JOIN od y ON y.modID = m.modID AND y.c = 'month' AND y.v = month),
k AS (SELECT modID, set_, cut, sum(retained) AS pos, count(*) AS n FROM sc GROUP BY 1, 2, 3),
r AS (SELECT *, sum(pos) OVER d AS tp, sum(n) OVER d AS hit, sum(pos) OVER (PARTITION BY modID, set_) AS positives FROM k
      WINDOW d AS (PARTITION BY modID, set_ ORDER BY cut DESC)),
b AS (SELECT modID, max_by(cut, (2 * tp / (hit + positives), cut)) AS best FROM r WHERE set_ = 'train' GROUP BY 1),
f AS (SELECT modID, 2 * count(*) FILTER (set_ = 'train' AND retained = 1 AND cut >= best) / (count(*) FILTER (set_ = 'train' AND cut >= best) + count(*) FILTER (set_ = 'train' AND retained = 1)) AS trainF1,
        2 * count(*) FILTER (set_ = 'test' AND retained = 1 AND cut >= best) / (count(*) FILTER (set_ = 'test' AND cut >= best) + count(*) FILTER (set_ = 'test' AND retained = 1)) AS testF1
      FROM sc JOIN b USING (modID) GROUP BY 1)
SELECT modID, round(trainF1, 9) AS trainF1, round(testF1, 9) AS testF1, round(abs(trainF1 - testF1), 9) AS diff FROM f WHERE trainF1 < 1 AND abs(trainF1 - testF1) < 0.025"""


@query("l15_leaderboard_of_count_models", BOARD_SQL)
def _(spark, sf):
    """Nine fitted count models compared from their stored scores."""
    train, test = (with_month(d) for d in split_trips(spark, sf))
    fitted = {name: Keyed(models.CountNaiveBayes(text, [], "retained", laplace).fit(train)) for name, (text, laplace) in COUNT_MODELS.items()}
    scores = board.on_sets(fitted, {"train": train, "test": test}, "retained", "orderkey")
    return rounded(board.board(scores, "retained"), trainF1=9, testF1=9, diff=9)


SEARCHED = {
    "gbm": models.random_params(6, 1, trees=[10, 20, 30], depth=[2, 3, 4], rate=[0.1, 0.3], sample=[0.6, 0.8, 1.0], min_rows=[50, 70, 100], bins=[16, 32, 64]),
    "nn": models.grid(hidden=[(4,), (8,), (8, 4)], max_iter=[60]),
}


def searched_families(spark, sf):
    """The three best of each family by out-of-fold scores of the paths and of the searches, with their stored scores, fitted on all rows."""
    path, _, chosen, folded, test = searched_path(spark, sf)
    parts = {"glm": penalty.out_of_fold(path, folded, "retained", "orderkey", chosen)}
    for family, candidates in SEARCHED.items():
        parts[family] = board.out_of_fold(family, folded, "retained", "orderkey", candidates, 2)
    fitted = {}
    for family, scores in parts.items():
        for name in board.top(scores, "retained", 3):
            i = int(name.rsplit("_", 1)[1])
            fitted[name] = path.model(*chosen[i]) if family == "glm" else models.fit(family, folded, "retained", SEARCHED[family][i])
    # Scores of a hundred paths would be a hundred rows for each one; those that the stack reads are written.
    store = checkpoint(board.together(list(parts.values())).filter(F.col("model").isin(list(fitted))))
    return store, fitted, folded, test


@query("l10_stack_of_searches")
def _(spark, sf):
    """The three best of each searched family, stacked on their stored out-of-fold scores."""
    store, fitted, folded, test = searched_families(spark, sf)
    return results("stacked", board.stack(store, fitted, "retained", "orderkey"), folded, test)


@query("l15_leaderboard_of_searches")
def _(spark, sf):
    """The three best models of each searched family and their stack, from stored scores of both sets."""
    store, fitted, folded, test = searched_families(spark, sf)
    every = fitted | {"stacked": board.stack(store, fitted, "retained", "orderkey")}
    return board.board(board.on_sets(every, {"train": folded, "test": test}, "retained", "orderkey"), "retained")


@query("x1_tree_importance")
def _(spark, sf):
    train, _ = prepared(spark, sf)
    model = models.fit("gbm", train, "retained", {"trees": 10, "depth": 3})
    return spark.createDataFrame(models.importances(model, train), "feature string, importance double")


@query("x2_partial_dependence_of_model")
def _(spark, sf):
    """Mean prediction of a fitted pipeline over the deciles of the price."""
    train, test = (with_month(d) for d in split_trips(spark, sf))
    pipeline = prep.feature_pipeline(TEXT, NUMBERS).fit(train)
    model = models.fit("glm", pipeline.transform(train), "retained")
    grid = explain.quantile_grid(train, "price", 10)
    return explain.partial_dependence(test, lambda d: model.score(pipeline.transform(d)), "price", grid)


D5_JOINED = """joined AS (SELECT t.orderkey, t.custkey, t.price, t.travel_type, t.retained, coalesce(nation, 'NA') AS nation,
   CASE WHEN t.orderkey % 7 <> 0 THEN revenue END AS revenue, coalesce(special_pay, 'other') AS special_pay, coalesce(n_messages, 0) AS n_messages
  FROM trips t LEFT JOIN crm USING (custkey) LEFT JOIN finance USING (orderkey)
  LEFT JOIN (SELECT customer_id AS custkey, count(*) AS n_messages FROM messages GROUP BY 1) USING (custkey)),
tr0 AS (SELECT * FROM joined WHERE orderkey % 4 <> 0),
gone AS (SELECT abs(corr(price, revenue)) > 0.8 AS revenue FROM tr0 WHERE revenue IS NOT NULL),
sizes AS (SELECT nation, count(*) AS n FROM tr0 GROUP BY 1),
lump AS (SELECT nation AS level, CASE WHEN n < round((SELECT sum(n) FROM sizes) * 0.035) THEN 'other' ELSE nation END AS grp FROM sizes),
full_ AS (SELECT orderkey, retained, travel_type, special_pay, coalesce(grp, 'other') AS nation, price, CAST(n_messages AS DOUBLE) AS n_messages,
   coalesce(revenue, (SELECT avg(revenue) FROM tr0)) AS revenue FROM joined LEFT JOIN lump ON level = nation),
tr AS (SELECT * FROM full_ WHERE orderkey % 4 <> 0)"""
D5_SQL = with_ctes(TRIPS, CRM, FINANCE, MESSAGES, D5_JOINED) + """,
lv AS (SELECT c, v, sum(retained) AS p, sum(1 - retained) AS n FROM (
        SELECT 'travel_type' AS c, travel_type AS v, retained FROM tr UNION ALL SELECT 'nation', nation, retained FROM tr
        UNION ALL SELECT 'special_pay', special_pay, retained FROM tr) GROUP BY 1, 2),
od AS (SELECT c, v, ln((p + 1) / (sum(p) OVER w + count(*) OVER w)) - ln((n + 1) / (sum(n) OVER w + count(*) OVER w)) AS o
       FROM lv WINDOW w AS (PARTITION BY c)),
nums AS (SELECT orderkey, retained, 'price' AS c, price AS x FROM full_ UNION ALL SELECT orderkey, retained, 'n_messages', n_messages FROM full_
         UNION ALL SELECT orderkey, retained, 'revenue', revenue FROM full_ WHERE NOT (SELECT revenue FROM gone)),
st AS (SELECT c, avg(x) FILTER (retained = 1) AS mp, stddev_samp(x) FILTER (retained = 1) AS sp, avg(x) FILTER (retained = 0) AS mn,
              stddev_samp(x) FILTER (retained = 0) AS sn FROM nums WHERE orderkey % 4 <> 0 GROUP BY 1),
dens AS (SELECT orderkey, sum(-ln(sp) - ((x - mp) / sp) ** 2 / 2 + ln(sn) + ((x - mn) / sn) ** 2 / 2) AS d FROM nums JOIN st USING (c) GROUP BY 1)
SELECT orderkey, round(p, 6) AS pred, CASE WHEN p >= 0.75 THEN 'yes' ELSE 'no' END AS pred_class FROM (
  SELECT f.orderkey, 1 / (1 + exp(-((SELECT ln(sum(retained) / sum(1 - retained)) FROM tr) + coalesce(a.o, 0) + coalesce(b.o, 0) + coalesce(e.o, 0) + d))) AS p
  FROM full_ f JOIN dens USING (orderkey) LEFT JOIN od a ON a.c = 'travel_type' AND a.v = f.travel_type
  LEFT JOIN od b ON b.c = 'nation' AND b.v = f.nation LEFT JOIN od e ON e.c = 'special_pay' AND e.v = f.special_pay WHERE f.orderkey % 4 = 0)"""


def trips_with_everything(spark, sf):
    """Trips with customer, finance and message facts, joined on their keys."""
    revenue = F.when(F.col("orderkey") % 7 != 0, F.col("revenue"))
    messages = roles.messages(spark, sf).groupBy(F.col("customer_id").alias("custkey")).agg(F.count(F.lit(1)).alias("n_messages"))
    return (roles.trips(spark, sf).select("orderkey", "custkey", "price", "travel_type", "retained")
            .join(roles.crm(spark, sf).select("custkey", "nation"), "custkey", "left")
            .join(roles.finance(spark, sf).select("orderkey", revenue.alias("revenue"), "special_pay"), "orderkey", "left")
            .join(messages, "custkey", "left").fillna("other", subset=["special_pay"])
            .withColumn("n_messages", F.coalesce("n_messages", F.lit(0)).cast("double")).withColumn("country", F.lit("US")))


def d5_parts(spark, sf):
    """Everything learned on the training trips, stored and loaded again; and the new trips."""
    joined = checkpoint(trips_with_everything(spark, sf))
    train, unseen = joined.filter("orderkey % 4 <> 0"), joined.filter("orderkey % 4 = 0")
    numbers = ["n_messages", "price", "revenue"]
    flat = profile.near_zero_variance(train, ["country"])  # a constant column goes
    related = [r["var2"] for r in profile.correlated_pairs(train, numbers).select("var2").collect()]  # column names only
    numbers = [c for c in numbers if c not in related]
    train, unseen = (profile.drop_near_zero_variance(d, flat) for d in (train, unseen))

    def kept(fitted, name, threshold=None):
        path = shared_folder(spark, f"d5-{name}")
        stored.save(spark, fitted, path, threshold)
        return stored.load(spark, path)

    groups, _ = kept(levels.lump_rare_levels(train, "nation", 0.035), "groups")
    imputer, _ = kept(prep.PcaImputer(numbers, rank=0).fit(train, "orderkey"), "imputer")

    def ready(df):
        return imputer.transform(levels.apply_groups(df, "nation", groups))

    train = checkpoint(ready(train))
    return numbers, train, prep.scale(ready(unseen), train, numbers, center=True, ddof=1), kept


@query("d5_score_new_trips", D5_SQL)
def _(spark, sf):
    """Join, drop columns, group levels, impute, scale, fit, store, load, score unseen trips, write and read them."""
    numbers, train, unseen, kept = d5_parts(spark, sf)
    model = models.CountNaiveBayes(["travel_type", "nation", "special_pay"], numbers, "retained").fit(
        prep.scale(train, train, numbers, center=True, ddof=1))
    loaded, threshold = kept(model, "model", 0.75)
    scored = loaded.score(unseen, "orderkey")
    path = shared_folder(spark, "d5-scored")
    tables.write_table(scored.withColumn("pred_class", evaluate.classify(F.col("pred"), threshold)), path)
    return rounded(spark.read.parquet(path), pred=6)


@query("d5_score_new_trips_linear")
def _(spark, sf):
    """The same path with a linear model, whose threshold is best for training F1."""
    numbers, train, unseen, kept = d5_parts(spark, sf)
    text = ("travel_type", "nation", "special_pay")
    pipeline, _ = kept(prep.feature_pipeline(text, numbers).fit(train), "pipeline")
    model = models.fit("glm", pipeline.transform(train), "retained")
    cut, _ = evaluate.max_f1(evaluate.score_counts(model.score(pipeline.transform(train)), "retained", "pred"))
    loaded, threshold = kept(model, "glm", cut)
    return loaded.score(pipeline.transform(unseen)).select("orderkey", evaluate.classify(F.col("pred"), threshold).alias("pred_class"))


S7_SQL = with_ctes(TRIPS) + """,
tr AS (SELECT *, CAST(month(departure_date) AS VARCHAR) AS month FROM trips WHERE orderkey % 4 <> 0),
lv AS (SELECT 'travel_type' AS c, travel_type AS v, sum(retained) AS p, sum(1 - retained) AS n FROM tr GROUP BY 2
       UNION ALL SELECT 'month', month, sum(retained), sum(1 - retained) FROM tr GROUP BY 2),
od AS (SELECT c, v, ln((p + 1) / (sum(p) OVER w + count(*) OVER w)) - ln((n + 1) / (sum(n) OVER w + count(*) OVER w)) AS o
       FROM lv WINDOW w AS (PARTITION BY c)),
z AS (SELECT orderkey, retained, (SELECT ln(sum(retained) / sum(1 - retained)) FROM tr) + coalesce(a.o, 0) AS plain, coalesce(b.o, 0) AS more
      FROM trips LEFT JOIN od a ON a.c = 'travel_type' AND a.v = travel_type
      LEFT JOIN od b ON b.c = 'month' AND b.v = CAST(month(departure_date) AS VARCHAR) WHERE orderkey % 4 = 0)
SELECT orderkey, retained, round(1 / (1 + exp(-plain - more)), 7) AS pred, round(1 / (1 + exp(-plain)), 7) AS pred_plain,
       CASE WHEN 1 / (1 + exp(-plain - more)) >= 0.75 THEN 'yes' ELSE 'no' END AS pred_class,
       CASE WHEN 1 / (1 + exp(-plain)) >= 0.8 THEN 'yes' ELSE 'no' END AS pred_class_plain FROM z"""


@query("s7_two_stored_models", S7_SQL)
def _(spark, sf):
    """A model with and one without the month, stored with thresholds, loaded and scored side by side."""
    train, unseen = (with_month(d) for d in split_trips(spark, sf))
    out = unseen.select("orderkey", "retained")
    for name, text, cut in (("", TEXT, 0.75), ("_plain", TEXT[:1], 0.8)):
        path = shared_folder(spark, "stored-model")
        stored.save(spark, models.CountNaiveBayes(text, [], "retained").fit(train), path, cut)
        model, threshold = stored.load(spark, path)
        pred = model.score(unseen, "orderkey").select(
            "orderkey", F.col("pred").alias(f"pred{name}"), evaluate.classify(F.col("pred"), threshold).alias(f"pred_class{name}"))
        out = out.join(pred, "orderkey")
    return rounded(out, pred=7, pred_plain=7)


def explained_trees(spark, sf):
    """A boosted model, its explanation against the training trips, and the test trips."""
    train, test = prepared(spark, sf)
    model = models.fit("gbm", train, "retained", {"trees": 10, "depth": 3})
    return model, tree_contributions.explain_trees(model, train, "retained"), tree_contributions.column_names(train, NUMBERS), test


@query("x4_tree_contributions")
def _(spark, sf):
    """Exact contributions of program, price, travel type and month to every test trip's log odds."""
    _, explained, names, test = explained_trees(spark, sf)
    return tree_contributions.tree_contributions(test, explained, "orderkey", names)


@query("x4_tree_summary")
def _(spark, sf):
    _, explained, names, test = explained_trees(spark, sf)
    return tree_contributions.summary(tree_contributions.tree_contributions(test, explained, "orderkey", names))


@query("x4_tree_contributions_add_up", with_ctes(TRIPS) + "SELECT orderkey, 4 AS n_features, true AS adds_up FROM trips WHERE orderkey % 4 = 0")
def _(spark, sf):
    """Contributions and the mean of the training trips make up the log odds of every test trip."""
    model, explained, names, test = explained_trees(spark, sf)
    told = tree_contributions.tree_contributions(test, explained, "orderkey", names).groupBy("orderkey").agg(
        F.count(F.lit(1)).cast("int").alias("n_features"), F.sum("contribution").alias("total"))
    # The model's score is the logistic function of twice the sum of its trees.
    odds = F.log(F.col("pred") / (1 - F.col("pred"))) / 2
    return model.score(test).join(told, "orderkey").select(
        "orderkey", "n_features", (F.abs(odds - explained.base - F.col("total")) < 1e-9).alias("adds_up"))



# Draws of the search over row and column shares, their change by level, leaf sizes, bins and least gains.
BOOSTED = models.random_params(
    4, 1, trees=lambda r: 15, depth=lambda r: r.randint(2, 4), sample=lambda r: r.randint(20, 100) / 100, columns=lambda r: r.randint(20, 100) / 100,
    columns_tree=lambda r: r.randint(20, 100) / 100, columns_change=lambda r: r.randint(90, 110) / 100, min_rows=lambda r: r.choice([50, 70, 100]),
    bins=lambda r: r.choice([16, 32]), min_gain=lambda r: r.choice([0.0, 1e-8, 1e-6, 1e-4]))


@query("l4_histogram_boosting")
def _(spark, sf):
    """Candidates and folds grow side by side; the best by out-of-fold F1, judged on both sets."""
    train, test = prepared(spark, sf)
    folded = checkpoint(models.add_folds(train, "retained", "orderkey", 2))
    grown = boosting.boosted(folded, "retained", "orderkey", BOOSTED)
    scores = board.together([  # read once
        m.score(folded.filter(F.col("fold") == f)).select(F.lit(f"gbm_grid_model_{i}").alias("model"), "fold", "orderkey", "retained", "pred")
        for i, some in enumerate(grown) for f, m in enumerate(some[:-1])])
    best = int(board.top(scores, "retained", 1)[0].rsplit("_", 1)[1])
    return results("gbm", grown[best][-1], folded, test)


@query("l4_first_split", with_ctes(TRIPS) + """,
tr AS (SELECT *, month(departure_date) AS m FROM trips WHERE orderkey % 4 <> 0),
b AS (SELECT avg(retained) AS p, count(*) AS n, sum(retained) AS pos FROM tr),
s AS (SELECT 'program' AS feature, c AS cut, count(*) FILTER (program <= c) AS n, sum(retained) FILTER (program <= c) AS pos
      FROM tr, (SELECT DISTINCT program AS c FROM tr) GROUP BY c
      UNION ALL SELECT 'travel_type', NULL, count(*) FILTER (t.travel_type <> l.travel_type), sum(retained) FILTER (t.travel_type <> l.travel_type)
      FROM tr t, (SELECT DISTINCT travel_type FROM tr) l GROUP BY l.travel_type
      UNION ALL SELECT 'month', NULL, count(*) FILTER (t.m <> l.m), sum(retained) FILTER (t.m <> l.m) FROM tr t, (SELECT DISTINCT m FROM tr) l GROUP BY l.m),
g AS (SELECT s.*, (s.n * p - s.pos) AS gl, s.n * p * (1 - p) AS hl, b.n * p - b.pos AS g, b.n * p * (1 - p) AS h, b.n AS whole FROM s, b),
best AS (SELECT *, gl ** 2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g ** 2 / (h + 1) AS gain FROM g WHERE n >= 10 AND whole - n >= 10)
SELECT feature, CAST(n AS BIGINT) AS n_left, round(-gl / (hl + 1), 7) AS left_value, round(-(g - gl) / (h - hl + 1), 7) AS right_value
FROM best ORDER BY gain DESC LIMIT 1""")
def _(spark, sf):
    """The first split of a tree of depth one, on features with few values."""
    train, _ = (with_month(d) for d in split_trips(spark, sf))
    ready = checkpoint(prep.feature_pipeline(TEXT, ["program"]).fit(train).transform(train).select("orderkey", "retained", "features"))
    model = boosting.boosted(ready, "retained", "orderkey", [{"trees": 1, "depth": 1, "rate": 1.0, "min_rows": 10, "bins": 64}], fold=None, held=0.0)[0][0]
    feature, cut, left, right, _ = model.trees[0][0]
    n = ready.filter(vector_to_array("features")[feature] <= cut).count()
    name = tree_contributions.column_names(ready, ["program"])[feature]
    return spark.createDataFrame([(name, n, round(float(model.trees[0][left][4]), 7), round(float(model.trees[0][right][4]), 7))],
                                 "feature string, n_left bigint, left_value double, right_value double")
