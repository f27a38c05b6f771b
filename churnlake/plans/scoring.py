"""Queries: quality of scores, explanations and decisions, on a closed-form scorer."""

from __future__ import annotations

from pyspark.sql import functions as F

from churnlake.operators import decide, evaluate, explain, profile, ranking
from churnlake.plans import roles
from churnlake.plans.registry import query
from churnlake.plans.roles import CRM, MESSAGES, SCORED, TRIPS, rounded, score_sql, table, with_ctes

CUT = 0.7
CLASSES = f"cls AS (SELECT *, CASE WHEN pred >= {CUT} THEN 'yes' ELSE 'no' END AS pred_class, CASE retained WHEN 1 THEN 'yes' ELSE 'no' END AS obs_class FROM scored)"


def classes(spark, sf):
    return roles.scored(spark, sf).withColumns({
        "pred_class": evaluate.classify(F.col("pred"), CUT),
        "obs_class": F.when(F.col("retained") == 1, "yes").otherwise("no")})


def scorer(df):
    return df.withColumn("pred", roles.score(F.col("price"), F.col("program")))


def cells_sql(source="scored", cut=CUT):
    return f"""SELECT count(*) FILTER (retained = 1 AND pred >= {cut}) AS tp, count(*) FILTER (retained = 0 AND pred >= {cut}) AS fp,
  count(*) FILTER (retained = 1 AND pred < {cut}) AS fn, count(*) FILTER (retained = 0 AND pred < {cut}) AS tn FROM {source}"""


CURVE = """curve AS (SELECT pred AS threshold, n, pos, CAST(sum(pos) OVER w AS BIGINT) AS tp,
    CAST(sum(n - pos) OVER w AS BIGINT) AS fp, CAST(sum(pos) OVER () - sum(pos) OVER w AS BIGINT) AS fn,
    CAST(sum(n - pos) OVER () - sum(n - pos) OVER w AS BIGINT) AS tn
  FROM (SELECT pred, count(*) AS n, sum(retained) AS pos FROM scored GROUP BY 1) WINDOW w AS (ORDER BY pred DESC))"""
AUC = "(SELECT sum(pos * (tn + (n - pos) / 2)) / (sum(pos) * sum(n - pos)) FROM {curve})"


@query("v1_predict_class", with_ctes(SCORED, CLASSES) + "SELECT orderkey, pred, pred_class FROM cls")
def _(spark, sf):
    return classes(spark, sf).select("orderkey", "pred", "pred_class")


@query("v2_confusion_matrix", with_ctes(SCORED, CLASSES) + """
SELECT obs_class, pred_class, count(*) AS n FROM cls GROUP BY ALL""")
def _(spark, sf):
    return evaluate.confusion(classes(spark, sf), "obs_class", "pred_class")


@query("v2_two_prediction_sets", with_ctes(SCORED) + """
SELECT CASE WHEN pred >= 0.65 THEN 'yes' ELSE 'no' END AS old, CASE WHEN pred >= 0.7 THEN 'yes' ELSE 'no' END AS new,
       count(*) AS n FROM scored GROUP BY ALL""")
def _(spark, sf):
    both = roles.scored(spark, sf).select(
        evaluate.classify(F.col("pred"), 0.65).alias("old"), evaluate.classify(F.col("pred"), 0.7).alias("new"))
    return evaluate.confusion(both, "old", "new")


GAPS = """gappy AS (SELECT CASE WHEN orderkey % 5 <> 0 THEN retained END AS retained, CASE WHEN orderkey % 7 <> 0 AND orderkey % 11 <> 0 THEN pred END AS pred FROM scored),
kept AS (SELECT * FROM gappy WHERE retained IS NOT NULL AND pred IS NOT NULL)"""


@query("v5_auc_with_gaps", with_ctes(SCORED, GAPS) + """,
n AS (SELECT pred, count(*) AS n, sum(retained) AS pos FROM kept GROUP BY 1),
r AS (SELECT pos, n - pos AS neg, coalesce(sum(n - pos) OVER (ORDER BY pred ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM n)
SELECT round(sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)), 9) AS auc FROM r""")
def _(spark, sf):
    """Rows without a label, without a score, or with NaN as score count nowhere."""
    key = F.col("orderkey")
    gappy = roles.scored(spark, sf).withColumns({
        "retained": F.when(key % 5 != 0, F.col("retained")),
        "pred": F.when(key % 11 == 0, F.lit(float("nan"))).when(key % 7 != 0, F.col("pred"))})
    return rounded(evaluate.auc(gappy, "retained", "pred"), auc=9)


@query("v3_class_report", with_ctes(SCORED) + f""", c AS ({cells_sql()})
SELECT 'yes' AS class, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1,
       tp + fn AS support, (tp + tn) / (tp + fp + fn + tn) AS accuracy FROM c
UNION ALL SELECT 'no', tn / (tn + fn), tn / (tn + fp), 2 * tn / (2 * tn + fn + fp), tn + fp,
       (tp + tn) / (tp + fp + fn + tn) FROM c""")
def _(spark, sf):
    return evaluate.report(roles.scored(spark, sf), "retained", "pred", CUT)


@query("v4_naive_f1", with_ctes(TRIPS) + """
SELECT round(p, 9) AS accuracy, round(2 * p / (p + 1), 9) AS f1 FROM (SELECT avg(retained) AS p FROM trips)""")
def _(spark, sf):
    return rounded(evaluate.naive_f1(roles.trips(spark, sf), "retained"), accuracy=9, f1=9)


@query("v5_auc", with_ctes(SCORED, CURVE) + f"SELECT round({AUC.format(curve='curve')}, 9) AS auc")
def _(spark, sf):
    return rounded(evaluate.auc(roles.scored(spark, sf), "retained", "pred"), auc=9)


@query("v6_gini", with_ctes(SCORED, CURVE) + f"SELECT round(2 * {AUC.format(curve='curve')} - 1, 9) AS gini")
def _(spark, sf):
    return rounded(evaluate.gini(roles.scored(spark, sf), "retained", "pred"), gini=9)


@query("v7_roc_points", with_ctes(SCORED, CURVE) + """
SELECT threshold, tp / (tp + fn) AS tpr, fp / (fp + tn) AS fpr FROM curve""")
def _(spark, sf):
    return evaluate.roc(roles.scored(spark, sf), "retained", "pred")


def best_sql(name, e):
    return f"(SELECT '{name}' AS criterion, threshold, {e} AS value FROM curve ORDER BY value DESC, threshold DESC LIMIT 1)"


@query("v8_best_thresholds", with_ctes(SCORED, CURVE) + "\nUNION ALL ".join([
    best_sql("f1", "2 * tp / (2 * tp + fp + fn)"), best_sql("accuracy", "(tp + tn) / (tp + fp + fn + tn)"),
    best_sql("precision", "tp / (tp + fp)"), best_sql("recall", "tp / (tp + fn)"),
    best_sql("specificity", "tn / (tn + fp)"),
    best_sql("min_per_class_accuracy", "least(tp / (tp + fn), tn / (tn + fp))")]))
def _(spark, sf):
    return evaluate.best_thresholds(roles.scored(spark, sf), "retained", "pred")


@query("v9_lift_curve", with_ctes(SCORED) + """
SELECT pred, obs / (SELECT sum(retained) FROM scored) AS perc, CAST(sum(obs) OVER w AS BIGINT) AS obs_cum,
       round(sum(p) OVER w, 6) AS pred_cum, 100.0::DOUBLE * sum(n) OVER w / (SELECT count(*) FROM scored) AS percentile
FROM (SELECT pred, count(*) AS n, sum(retained) AS obs, sum(pred) AS p FROM scored GROUP BY 1)
WINDOW w AS (ORDER BY pred DESC)""")
def _(spark, sf):
    return rounded(evaluate.lift(roles.scored(spark, sf), "retained", "pred"), pred_cum=6)


@query("v10_regression_errors", with_ctes(SCORED) + """
SELECT round(avg(abs(retained - pred)), 9) AS mae, round(avg((retained - pred) ** 2), 9) AS mse,
       round(sqrt(avg((retained - pred) ** 2)), 9) AS rmse,
       round(1 - avg((retained - pred) ** 2) / var_pop(retained), 9) AS r2 FROM scored""")
def _(spark, sf):
    out = evaluate.regression_errors(roles.scored(spark, sf), "retained", "pred")
    return rounded(out, mae=9, mse=9, rmse=9, r2=9)


def result_sql(name, where):
    inner = CURVE.replace("curve AS (", "", 1).rsplit(")", 1)[0].replace("FROM scored", f"FROM scored WHERE {where}")
    auc = AUC.format(curve=f"({inner})")
    return f"""SELECT 'formula' AS model, '{name}' AS "set", round({auc}, 9) AS auc,
  (tp + tn) / (tp + fp + fn + tn) AS accuracy, 2 * tp / (2 * tp + fp + fn) AS f1_score
  FROM ({cells_sql(f"(SELECT * FROM scored WHERE {where})")})"""


@query("v11_results_table", with_ctes(SCORED) + result_sql("train", "orderkey % 4 <> 0") + "\nUNION ALL " + result_sql("test", "orderkey % 4 = 0"))
def _(spark, sf):
    """Both parts of a 3:1 split, each row of the table in exactly one part."""
    scored = roles.scored(spark, sf)
    parts = {"train": scored.filter("orderkey % 4 <> 0"), "test": scored.filter("orderkey % 4 = 0")}
    counts = {("formula", name): (evaluate.score_counts(part, "retained", "pred"), CUT) for name, part in parts.items()}
    return rounded(evaluate.results_table(counts), auc=9)


@query("v12_observed_predicted_by_level", with_ctes(SCORED) + """
SELECT CAST(CASE WHEN price > 0 AND price <= 600000 THEN ceil(price / 50000) END AS INTEGER) AS level, count(*) AS expo,
       CAST(sum(retained) AS BIGINT) AS tot, round(sum(pred), 6) AS tot_pred, sum(retained) / count(*) AS ave,
       round(sum(pred) / count(*), 9) AS predprop FROM scored GROUP BY 1""")
def _(spark, sf):
    out = profile.target_by_level(roles.scored(spark, sf), "price", "retained", pred="pred",
                                  breaks=[50000 * i for i in range(13)])
    return rounded(out, tot_pred=6, predprop=9)


@query("v13_calibration", with_ctes(SCORED) + """
SELECT round(avg(pred), 9) AS predicted, round(avg(retained), 9) AS observed FROM scored""")
def _(spark, sf):
    return rounded(evaluate.calibration(roles.scored(spark, sf), "retained", "pred"), predicted=9, observed=9)


# ---------------------------------------------------------------- explanations

PRICES = [50000.0 * i for i in range(1, 10)]
GRID = "(SELECT unnest([" + ", ".join(f"{p}::DOUBLE" for p in PRICES) + "]) AS price)"


LOSS = "avg(-CASE WHEN retained = 1 THEN ln({p}) ELSE ln(1 - {p}) END)"
MIXED = {"": ("a.price", "a.program"), "price": ("b.price", "a.program"), "program": ("a.price", "b.program")}


@query("x1_permutation_importance", with_ctes(TRIPS) + """,
a AS (SELECT *, row_number() OVER (ORDER BY md5(orderkey || '|1'), orderkey) AS pos FROM trips),
b AS (SELECT *, row_number() OVER (ORDER BY md5(orderkey || '|2'), orderkey) AS pos FROM trips),
loss AS (""" + " UNION ALL ".join(
    f"SELECT '{name}' AS feature, {LOSS.format(p='p')} AS loss FROM (SELECT retained, {score_sql(*cols)} AS p FROM "
    "(SELECT retained, pos, price, program FROM a) a JOIN (SELECT pos, price, program FROM b) b USING (pos))"
    for name, cols in MIXED.items()) + """)
SELECT feature, round(loss - (SELECT loss FROM loss WHERE feature = ''), 9) AS importance FROM loss WHERE feature <> ''""")
def _(spark, sf):
    trips = roles.trips(spark, sf)
    out = explain.permutation_importance(trips, scorer, "orderkey", "retained", ["price", "program"])
    return rounded(out, importance=9)


@query("x2_partial_dependence", with_ctes(TRIPS) + f"""
SELECT g.price, round(avg({score_sql('g.price', 'program')}), 9) AS mean_pred FROM trips, {GRID} g GROUP BY 1""")
def _(spark, sf):
    trips = roles.trips(spark, sf).select("price", "program")
    return rounded(explain.partial_dependence(trips, scorer, "price", PRICES), mean_pred=9)


@query("x3_ice_curves", with_ctes(TRIPS) + f"""
SELECT orderkey, g.price, {score_sql('g.price', 'program')} AS pred FROM trips, {GRID} g""")
def _(spark, sf):
    return explain.ice(roles.trips(spark, sf).select("orderkey", "price", "program"), scorer, "orderkey", "price", PRICES)


@query("x4_linear_contributions", with_ctes(TRIPS) + """
SELECT orderkey, 'price' AS feature, round(-0.35 * (price - (SELECT avg(price) FROM trips)) / 100000, 6) AS contribution FROM trips
UNION ALL SELECT orderkey, 'program', round(0.2 * (program - (SELECT avg(program) FROM trips)), 6) FROM trips""")
def _(spark, sf):
    trips = roles.trips(spark, sf)
    out = explain.linear_contributions(trips, trips, "orderkey", {
        "price": roles.PER_PRICE / 100000.0, "program": roles.PER_PROGRAM})
    return rounded(out, contribution=6)


PICKED = f"""picked AS (
  SELECT * FROM scored WHERE pred = (SELECT min(pred) FROM scored) OR pred = (SELECT max(pred) FROM scored)
  UNION (SELECT * FROM scored WHERE pred > {CUT} * 0.99 AND pred < {CUT} * 1.01 ORDER BY orderkey LIMIT 1)),
bg AS (SELECT price AS bp, program AS bq FROM scored ORDER BY md5(orderkey || '|1'), orderkey LIMIT 20),
walks AS (SELECT orderkey, {score_sql('price', 'program')} AS own, {score_sql('bp', 'program')} AS no_price,
                 {score_sql('price', 'bq')} AS no_program, {score_sql('bp', 'bq')} AS none FROM picked, bg)"""


@query("x4_sampled_contributions", with_ctes(SCORED, PICKED) + """
SELECT orderkey, 'price' AS feature, round(avg((own - no_price + no_program - none) / 2), 8) AS contribution FROM walks GROUP BY 1
UNION ALL SELECT orderkey, 'program', round(avg((own - no_program + no_price - none) / 2), 8) FROM walks GROUP BY 1""")
def _(spark, sf):
    """Sampled contributions of the rows picked for explanation."""
    scored = roles.scored(spark, sf)
    picked = explain.pick_rows(scored.select("orderkey", "price", "program", "pred"), "orderkey", CUT)
    out = explain.shapley_sample(picked.drop("pick").distinct(), scored, scorer, "orderkey", ["price", "program"])
    return rounded(out, contribution=8)


@query("x5_rows_to_explain", with_ctes(SCORED) + f"""
SELECT 'lowest' AS pick, orderkey, pred, retained FROM scored WHERE pred = (SELECT min(pred) FROM scored)
UNION ALL (SELECT 'nearest', orderkey, pred, retained FROM scored WHERE pred > {CUT} * 0.99 AND pred < {CUT} * 1.01 ORDER BY orderkey LIMIT 1)
UNION ALL SELECT 'highest', orderkey, pred, retained FROM scored WHERE pred = (SELECT max(pred) FROM scored)""")
def _(spark, sf):
    scored = roles.scored(spark, sf).select("orderkey", "pred", "retained")
    return explain.pick_rows(scored, "orderkey", CUT)


@query("x6_evidence_for_errors", with_ctes(MESSAGES, SCORED) + """
SELECT doc_id, customer_id, text FROM messages WHERE customer_id IN (
  SELECT custkey FROM scored WHERE (pred < 0.6 AND retained = 1) OR (pred > 0.75 AND retained = 0))""")
def _(spark, sf):
    scored = roles.scored(spark, sf).withColumnRenamed("custkey", "customer_id")
    out = explain.confident_errors(scored, roles.messages(spark, sf), "customer_id", "retained", low=0.6, high=0.75)
    return out.select("doc_id", "customer_id", "text")


# ---------------------------------------------------------------- decisions

LOW = ("AF", "AS")


@query("d1_scenario", with_ctes(SCORED, CRM) + f""",
m AS (SELECT median(price) AS med FROM trips WHERE program = 2),
s AS (SELECT price AS w, pred, CASE WHEN income_level IN ('AF', 'AS') THEN 2 ELSE program END AS np,
             CASE WHEN income_level IN ('AF', 'AS') THEN med ELSE price END AS npr
      FROM scored JOIN crm USING (custkey), m),
r AS (SELECT w, pred, {score_sql('npr', 'np')} AS pred2 FROM s)
SELECT round(avg(pred), 9) AS mean_before, round(avg(pred2), 9) AS mean_after, round(sum(w * pred), 0) AS total_before,
       round(sum(w * pred2), 0) AS total_after, round(sum(w * pred2) / sum(w * pred), 9) AS proportion,
       round(sum(w * pred2) - sum(w * pred), 0) AS absolute FROM r""")
def _(spark, sf):
    """Move low-income customers to programme 2 at its median price."""
    trips = roles.trips(spark, sf)
    joined = trips.join(roles.crm(spark, sf).select("custkey", "income_level"), "custkey")
    price = ranking.group_quantiles(trips.filter("program = 2"), [], "price", {"m": 0.5}).scalar()
    out = decide.scenario(joined, scorer, F.col("income_level").isin(*LOW),
                          {"program": F.lit(2), "price": price}, "price")
    return rounded(out, mean_before=9, mean_after=9, total_before=0, total_after=0, proportion=9, absolute=0)


SWEEP = f"""swept AS (SELECT orderkey, d, price * (1 - d) AS r, {score_sql('price * (1 - d)', 'program')} AS p
  FROM trips, (SELECT unnest([0.0::DOUBLE, 0.01, 0.02, 0.03, 0.04, 0.05]) AS d)),
sweep AS (SELECT orderkey, max(CASE WHEN d = 0 THEN p END) AS pred, max(CASE WHEN d = 0 THEN r * 0.05::DOUBLE * p END) AS e_profit,
  arg_max(d, (r * 0.05::DOUBLE * p, -d)) AS best_discount, arg_max(p, (r * 0.05::DOUBLE * p, -d)) AS best_pred,
  max(r * 0.05::DOUBLE * p) AS max_profit FROM swept GROUP BY 1)"""


def sweep(spark, sf):
    trips = roles.trips(spark, sf).select("orderkey", "price", "program")
    return decide.discount_sweep(trips, scorer, "orderkey", "price")


@query("d2_discount_sweep", with_ctes(TRIPS, SWEEP) + """
SELECT orderkey, pred, best_pred, best_discount, round(e_profit, 10) AS e_profit, round(max_profit, 10) AS max_profit FROM sweep""")
def _(spark, sf):
    return rounded(sweep(spark, sf), e_profit=10, max_profit=10)


@query("d2_discount_totals", with_ctes(TRIPS, SWEEP) + """
SELECT round(sum(max_profit) / sum(e_profit), 9) AS proportion, round(sum(max_profit) - sum(e_profit), 1) AS absolute FROM sweep""")
def _(spark, sf):
    return rounded(decide.sweep_totals(sweep(spark, sf)), proportion=9, absolute=1)


@query("d3_largest_uplift", with_ctes(TRIPS, SWEEP) + """
SELECT orderkey, pred, best_pred, best_discount, round(max_profit - e_profit, 10) AS uplift FROM sweep
WHERE max_profit - e_profit = (SELECT max(max_profit - e_profit) FROM sweep)""")
def _(spark, sf):
    out = decide.largest_uplift(sweep(spark, sf)).select("orderkey", "pred", "best_pred", "best_discount", "uplift")
    return rounded(out, uplift=10)


@query("d4_segments", with_ctes(TRIPS, CRM) + "\nUNION ALL ".join(
    f"""SELECT '{c}' AS "column", CAST({c} AS VARCHAR) AS level, round(sum(price), 3) AS expo, CAST(sum(retained) AS BIGINT) AS tot,
  round(1e6 * sum(retained) / sum(price), 6) AS ave FROM trips JOIN crm USING (custkey) GROUP BY 2"""
    for c in ("income_level", "segment", "program")))
def _(spark, sf):
    """Retention per unit of revenue by income level, market and programme."""
    joined = roles.trips(spark, sf).join(roles.crm(spark, sf).select("custkey", "income_level", "segment"), "custkey")
    out = decide.segments(joined, ["income_level", "segment", "program"], "retained", "price")
    return rounded(out.withColumn("ave", F.col("ave") * 1e6), expo=3, ave=6)


@query("d4_by_group_size", with_ctes(TRIPS, roles.FINANCE) + """
SELECT CAST(CASE WHEN pax > -10 AND pax <= 500 THEN ceil((pax + 10) / 10) END AS INTEGER) AS level, count(*) AS expo,
       CAST(sum(retained) AS BIGINT) AS tot, sum(retained) / count(*) AS ave
FROM trips LEFT JOIN finance USING (orderkey) GROUP BY 1""")
def _(spark, sf):
    sizes = roles.finance(spark, sf).select("orderkey", "pax")
    joined = roles.trips(spark, sf).join(sizes, "orderkey", "left")
    return decide.by_group_size(joined, "pax", "retained", [10 * i for i in range(-1, 51)])
