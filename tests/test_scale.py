"""Exactness of the range-wise operators, skewed groups, and the shape of plans."""

import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
from churnlake.operators import evaluate, keys, profile, ranking
from churnlake.plans import roles
from churnlake.session import tune

SF = "/root/testdata/sf0.001"
QUICK = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@QUICK
@given(st.lists(st.tuples(st.sampled_from("abc"), st.integers(-5, 5) | st.floats(-1e3, 1e3)), min_size=1, max_size=60))
def test_group_quantiles_equal_numpy(spark, rows):
    df = spark.createDataFrame([(g, float(v)) for g, v in rows], "g string, v double")
    probs = {"q1": 0.25, "med": 0.5, "p9": 0.9}
    got = {r.g: r for r in ranking.group_quantiles(df, ["g"], "v", probs, n_ranges=4).collect()}
    for g in {g for g, _ in rows}:
        values = [float(v) for h, v in rows if h == g]
        for name, p in probs.items():
            assert got[g][name] == pytest.approx(np.quantile(values, p), abs=1e-9)


@QUICK
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 1)), min_size=1, max_size=60))
def test_running_totals_equal_loop(spark, rows):
    df = spark.createDataFrame([(v / 10, y) for v, y in rows], "v double, y int")
    got = ranking.running_totals(df, "v", {"n": F.lit(1), "pos": F.col("y")}, n_ranges=4).collect()
    for r in got:
        above = [(v, y) for v, y in rows if v / 10 >= r.v]
        assert (r.cum_n, r.cum_pos) == (len(above), sum(y for _, y in above))


def test_missing_numbers_are_left_out(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (3.0,)], "v double")
    assert ranking.group_quantiles(df, [], "v", {"m": 0.5}).first().m == 2.0
    assert {r.cum_n for r in ranking.running_totals(df, "v", {"n": F.lit(1)}).collect()} == {1, 2}
    empty = df.filter("v > 5")
    assert ranking.group_quantiles(empty, [], "v", {"m": 0.5}).count() == 0
    assert ranking.running_totals(empty, "v", {"n": F.lit(1)}).count() == 0


def test_hot_group_quantiles(spark):
    """One group with most rows and one value shared by a third of them."""
    rng = random.Random(1)
    rows = [("hot", 7.0 if rng.random() < 0.33 else rng.random() * 100) for _ in range(5000)]
    rows += [(f"g{i}", float(i)) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r.m for r in ranking.group_quantiles(df, ["g"], "v", {"m": 0.5}).collect()}
    assert len(got) == 201
    assert got["hot"] == pytest.approx(np.median([v for g, v in rows if g == "hot"]))


def test_auc_against_pairs(spark):
    rng = random.Random(2)
    rows = [(rng.randint(0, 1), round(rng.random(), 2)) for _ in range(400)]
    pos, neg = ([p for y, p in rows if y == k] for k in (1, 0))
    want = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))
    df = spark.createDataFrame(rows, "y int, p double")
    assert evaluate.auc(df, "y", "p").first()[0] == pytest.approx(want)


def test_curve_invariants(spark):
    df = roles.scored(spark, SF)
    points = sorted(evaluate.roc(df, "retained", "pred").collect(), key=lambda r: -r.threshold)
    assert all(a.tpr <= b.tpr and a.fpr <= b.fpr for a, b in zip(points, points[1:]))
    assert (points[-1].tpr, points[-1].fpr) == (1.0, 1.0)
    ends = evaluate.lift(df, "retained", "pred").agg(F.max("obs_cum"), F.max("percentile")).first()
    assert ends[0] == df.filter("retained = 1").count() and ends[1] == 100.0


def test_shuffled_position_is_a_permutation(spark):
    df = spark.range(1000).withColumn("y", (F.col("id") % 3 == 0).cast("int"))
    got = ranking.shuffled_position(df, "id", 5, "pos", ["y"]).collect()
    assert sorted(r.pos for r in got) == list(range(1000))
    assert max(r.pos for r in got if r.y == 0) < min(r.pos for r in got if r.y == 1)


def test_hot_customer_keeps_retention(spark, tmp_path):
    """A customer with half of all orders gives the same targets as a plain look-ahead."""
    orders = roles.table(spark, SF, "orders").withColumn(
        "o_custkey", F.when(F.col("o_orderkey") % 2 == 0, 0).otherwise(F.col("o_custkey")).cast("long"))
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    pdf = orders.toPandas().sort_values(["o_custkey", "o_orderdate", "o_orderkey"])
    ahead = pdf.groupby("o_custkey")["o_orderdate"].shift(-1)
    pdf["want"] = ((ahead - pdf["o_orderdate"]).dt.days <= 365).astype(int)
    pdf = pdf[pdf["o_orderdate"] <= pdf["o_orderdate"].max() - np.timedelta64(365, "D")]
    got = {r.orderkey: r.retained for r in roles.trips(spark, str(tmp_path)).collect()}
    assert got == dict(zip(pdf["o_orderkey"], pdf["want"]))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


SHAPED = [n for n in entry.oracle_sql() if n[0] in "ajefpuvtdw" and not n.startswith("d6")]


@pytest.mark.parametrize("name", SHAPED)
def test_no_cross_joins(spark, name):
    plan = plan_of(entry.queries()[name](spark, SF))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan


def test_filters_and_columns_reach_the_scan(spark):
    df = roles.table(spark, SF, "orders").filter("o_totalprice > 400000").select("o_orderkey")
    plan = plan_of(df)
    assert "PushedFilters: [IsNotNull(o_totalprice), GreaterThan(o_totalprice,400000.0)]" in plan
    assert "o_custkey" not in plan


def test_top_rows_are_cut_before_the_shuffle(spark):
    df = roles.table(spark, SF, "orders").select("o_custkey", "o_orderkey")
    plan = plan_of(ranking.first_per_group(df, ["o_custkey"], [F.asc("o_orderkey")]))
    assert plan.count("WindowGroupLimit") == 2


def test_global_windows_only_see_range_totals(spark):
    """The one window without partitions in a running total has one row per range below it."""
    df = spark.range(1000).select((F.col("id") % 77 / 77).alias("pred"))
    plan = plan_of(ranking.running_totals(df, "pred", {"n": F.lit(1)}))
    assert plan.count("Exchange SinglePartition") == 1
    lines = plan.split("\n")
    for i, line in enumerate(lines):
        if "SinglePartition" in line and "Exchange" in line:
            assert "_range" in "".join(lines[i:i + 3])


def test_profile_is_one_scan_per_use(spark):
    df = roles.table(spark, SF, "orders")
    plan = plan_of(profile.level_counts(df, ["o_orderstatus", "o_orderpriority", "o_custkey"]))
    assert plan.count("FileScan parquet") == 1


def test_skewed_join_is_split_at_run_time(spark):
    """Half of the rows share one key; the join splits that partition although a sum follows."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
    }
    old = {k: spark.conf.get(k, None) for k in settings}
    tune(spark)
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        facts = spark.range(200_000, numPartitions=16).select(
            F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id")).alias("k"), F.rand(1).alias("v"))
        dims = spark.range(200_000).select(F.col("id").alias("k"), (F.col("id") % 9).alias("level"))
        joined = facts.join(dims, "k", "left").groupBy("k").agg(F.sum("v").alias("v"), F.count("level").alias("n"))
        got = {r.k: r.n for r in joined.collect()}
        assert got[7] == 100_001 and sum(got.values()) == 200_000
        assert "skew=true" in plan_of(joined)
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_reconciliation_counts_missing_and_repeated_keys(spark):
    a = spark.createDataFrame([("1", True, True), ("1", True, False), (None, True, True), ("2", False, True)],
                              "id_actual string, prefix_ok boolean, suffix_ok boolean")
    b = spark.createDataFrame([("1", True, True), (None, True, True), ("3", True, True)], a.schema)
    got = {r.check: r.n for r in keys.reconciliation_report(a, b).collect()}
    assert got == {
        "left_rows": 4, "left_prefix_mismatch": 1, "left_suffix_mismatch": 1, "left_repeated_keys": 1, "left_unmatched": 2,
        "right_rows": 3, "right_prefix_mismatch": 0, "right_suffix_mismatch": 0, "right_repeated_keys": 0, "right_unmatched": 2}


def test_level_profile_counts_once(spark):
    df = profile.levels(roles.table(spark, SF, "orders"), ["o_orderstatus", "o_custkey"], 5)
    df.collect()
    final = plan_of(df).split("== Initial Plan ==")[0]
    assert final.count("FileScan parquet") == 1 and "ReusedExchange" in final


def test_split_of_many_classes_and_missing_labels(spark):
    from churnlake.operators import prep

    rows = [(i, f"c{i % 1500}") for i in range(6000)] + [(6000 + i, None) for i in range(8)] + [(7000 + i, "") for i in range(4)]
    out = prep.stratified_split(spark.createDataFrame(rows, "k long, y string"), "y", "k", 0.75, bucket_rows=500)
    got = {r["y"]: r["n"] for r in out.filter("is_train").groupBy("y").agg(F.count("*").alias("n")).collect()}
    assert got[None] == 6 and got[""] == 3 and all(got[f"c{i}"] == 3 for i in range(1500))


def test_correlation_with_a_constant_is_null(spark):
    from churnlake.operators import profile

    df = spark.createDataFrame([(float(i), 2.0 * i, 5.0) for i in range(20)], "a double, b double, c double")
    got = {(r["var1"], r["var2"]): r["value"] for r in profile.correlation(df, ["a", "b", "c"]).collect()}
    assert abs(got["a", "b"] - 1) < 1e-12 and got["a", "c"] is None and got["b", "c"] is None


def test_group_letters(spark):
    from churnlake.operators.levels import group_letters

    got = [r[0] for r in spark.range(800).select(group_letters(F.col("id"))).collect()]
    assert got[0] == "A" and got[25] == "Z" and got[26] == "AA" and got[701] == "ZZ" and got[702] == "AAA" and len(set(got)) == 800


def test_missing_labels_and_nan_scores_count_nowhere(spark):
    from churnlake.operators import evaluate

    rows = [(1, 0.9), (0, 0.8), (None, 0.7), (0, 0.1), (1, float("nan")), (1, None)]
    assert evaluate.auc(spark.createDataFrame(rows, "y int, s double"), "y", "s").first()[0] == 1.0


def test_ranges_hold_when_nearly_all_values_are_equal(spark):
    from churnlake.operators import ranking

    df = spark.range(20_000).select(F.when(F.col("id") % 100 > 0, 0.0).otherwise(F.col("id").cast("double")).alias("v"))
    counts = df.groupBy("v").count()
    cuts = ranking.value_ranges(counts, "v", 8)
    most = ranking.add_range(counts, "v", cuts).groupBy("_range").count().agg(F.max("count")).first()[0]
    assert most <= 60
    run = ranking.running_totals(df, "v", {"n": F.lit(1)}, descending=False).orderBy(F.desc("v")).first()
    assert run["cum_n"] == 20_000


def test_no_shared_folder_on_a_cluster_is_an_error():
    import pytest

    from churnlake import session

    class Bare:
        class conf:
            @staticmethod
            def get(name, default=None):
                return default

        class sparkContext:
            master = "spark://somewhere:7077"

            @staticmethod
            def getCheckpointDir():
                return None

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_base(Bare)


def test_hot_term_of_an_aggregate_join_is_split(spark):
    from churnlake.operators import texts

    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
                "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2"}
    old = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        counts = spark.range(200_000, numPartitions=16).select(
            F.col("id").alias("doc"), F.when(F.col("id") % 2 == 0, "the").otherwise(F.concat(F.lit("w"), F.col("id") % 5000)).alias("term"),
            F.lit(1).alias("tf"))
        out = texts.tfidf(counts, "doc", F.lit(200_000), norm=False)
        out.write.format("noop").mode("overwrite").save()
        out.collect()
        assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
