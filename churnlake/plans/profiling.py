"""Queries: aggregation, ordering, scalar functions and column profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from churnlake.functions import clean, text
from churnlake.operators import joins, keys, profile, ranking, sets
from churnlake.plans import roles
from churnlake.plans.registry import query
from churnlake.plans.roles import (
    FINANCE, SALES, SCORED, TRIPS, rounded, table, with_ctes)

# ---------------------------------------------------------------- aggregation


@query("a1_group_aggregates", """
SELECT l_returnflag, l_linestatus, coalesce(round(sum(q), 2), 0) AS sum_qty, avg(q) AS mean_qty,
       min(q) AS min_qty, max(q) AS max_qty, count(q) AS n_qty, count(*) AS n_rows
FROM (SELECT l_returnflag, l_linestatus, CASE WHEN l_quantity > 10 THEN l_quantity END AS q FROM lineitem)
GROUP BY ALL""")
def _(spark, sf):
    q = F.when(F.col("l_quantity") > 10, F.col("l_quantity"))
    out = table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.coalesce(F.sum(q), F.lit(0.0)).alias("sum_qty"), F.avg(q).alias("mean_qty"),
        F.min(q).alias("min_qty"), F.max(q).alias("max_qty"), F.count(q).alias("n_qty"),
        F.count(F.lit(1)).alias("n_rows"))
    return rounded(out, sum_qty=2)


@query("a2_group_median", """
SELECT user_id, round(median(value), 6) AS value_med FROM events GROUP BY user_id""")
def _(spark, sf):
    out = ranking.group_quantiles(table(spark, sf, "events"), ["user_id"], "value", {"value_med": 0.5})
    return rounded(out, value_med=6)


@query("a3_frequency_of_frequencies", """
SELECT n, count(*) AS n_keys FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) GROUP BY n""")
def _(spark, sf):
    return keys.key_frequency(table(spark, sf, "lineitem"), "l_orderkey")


@query("a4_distinct_count", "\nUNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_distinct FROM orders"
    for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")))
def _(spark, sf):
    return profile.distinct_counts(table(spark, sf, "orders"), ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"])


@query("a5_distinct_rows", "SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem")
def _(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber").distinct()


@query("a6_duplicate_rows", """
SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def _(spark, sf):
    return profile.duplicate_rows(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("a7_proportion_table", with_ctes(FINANCE) + """
SELECT special_pay AS level, count(*) AS n, count(*) / (SELECT count(*) FROM finance) AS share
FROM finance GROUP BY 1""")
def _(spark, sf):
    return profile.proportion_table(roles.finance(spark, sf), "special_pay")


@query("a8_shape", """
SELECT 'orders' AS name, count(*) AS n_rows, CAST(6 AS BIGINT) AS n_columns FROM orders
UNION ALL SELECT 'lineitem', count(*), 11 FROM lineitem
UNION ALL SELECT 'documents', count(*), 5 FROM documents""")
def _(spark, sf):
    return profile.shape({n: table(spark, sf, n) for n in ("orders", "lineitem", "documents")})


def summary_sql(source: str, col: str) -> str:
    return f"""SELECT '{col}' AS "column", round(min({col}), 6) AS min, round(avg({col}), 8) AS mean,
       round(max({col}), 6) AS max, count(*) - count({col}) AS missing,
       round(quantile_cont({col}, 0.25), 6) AS q1, round(quantile_cont({col}, 0.5), 6) AS median,
       round(quantile_cont({col}, 0.75), 6) AS q3 FROM {source}"""


def round_summary(df):
    return rounded(df, min=6, mean=8, max=6, q1=6, median=6, q3=6)


GAPPY_ITEMS = """gappy AS (
  SELECT l_quantity, l_extendedprice, CASE WHEN l_returnflag <> 'N' THEN l_discount END AS l_discount
  FROM lineitem)"""


def gappy_items(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_quantity", "l_extendedprice",
        F.when(F.col("l_returnflag") != "N", F.col("l_discount")).alias("l_discount"))


@query("a9_numeric_summary", with_ctes(GAPPY_ITEMS) + "\nUNION ALL ".join(
    summary_sql("gappy", f"CAST({c} AS DOUBLE)").replace(f"'CAST({c} AS DOUBLE)'", f"'{c}'")
    for c in ("l_quantity", "l_extendedprice", "l_discount")))
def _(spark, sf):
    items = gappy_items(spark, sf)
    return round_summary(profile.summary(items, items.columns))


def describe_number(c):
    return f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 8) AS mean,
       round(stddev_samp({c}), 8) AS std, round(CAST(min({c}) AS DOUBLE), 6) AS min,
       round(CAST(max({c}) AS DOUBLE), 6) AS max, round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 6) AS q1,
       round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 6) AS median,
       round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 6) AS q3,
       CAST(NULL AS BIGINT) AS "unique", CAST(NULL AS VARCHAR) AS top, CAST(NULL AS BIGINT) AS freq
  FROM orders"""


def describe_text(c):
    return f"""SELECT '{c}', CAST(sum(n) AS BIGINT), NULL, NULL, NULL, NULL, NULL, NULL, NULL, count(*),
       arg_min(v, (-n, v)), max(n) FROM (SELECT CAST({c} AS VARCHAR) AS v, count(*) AS n FROM orders GROUP BY 1)"""


@query("a10_describe", "\nUNION ALL ".join(
    [describe_number(c) for c in ("o_orderkey", "o_custkey", "o_totalprice")]
    + [describe_text(c) for c in ("o_orderstatus", "o_orderpriority", "o_orderdate")]))
def _(spark, sf):
    out = profile.describe(table(spark, sf, "orders"))
    return rounded(out, mean=8, std=8, min=6, max=6, q1=6, median=6, q3=6)


def dictionary_text(c, limit=50):
    return f"""SELECT '{c}' AS "column", 'string' AS dtype, (SELECT count(*) FROM d WHERE {c} IS NULL) AS missing,
  CASE WHEN count(*) <= {limit} THEN string_agg(v || ': ' || n, ', ' ORDER BY n DESC, v)
       ELSE 'more than {limit} levels' END AS content
  FROM (SELECT {c} AS v, count(*) AS n FROM d WHERE {c} IS NOT NULL GROUP BY 1)"""


def dictionary_number(c, dtype):
    def show(e):
        return f"format('{{:,.2f}}', round(CAST({e} AS DECIMAL(38, 6)), 2))"
    parts = " || ', ' || ".join(
        f"'{n} ' || {show(e)}" for n, e in (("min", f"min({c})"), ("max", f"max({c})"),
                                             ("med", f"median({c})"), ("mean", f"avg({c})")))
    return f"SELECT '{c}', '{dtype}', count(*) - count({c}), {parts} FROM d"


@query("a11_data_dictionary", """
WITH d AS (SELECT c_name, nullif(c_mktsegment, 'BUILDING') AS c_mktsegment, c_custkey, c_nationkey, c_acctbal FROM customer)
""" + "\nUNION ALL ".join([
    dictionary_text("c_name"), dictionary_text("c_mktsegment"),
    dictionary_number("c_custkey", "bigint"), dictionary_number("c_nationkey", "int"), dictionary_number("c_acctbal", "double")]))
def _(spark, sf):
    customer = table(spark, sf, "customer").select(
        "c_name", clean.to_null(F.col("c_mktsegment"), ["BUILDING"]).alias("c_mktsegment"), "c_custkey", "c_nationkey", "c_acctbal")
    return profile.dictionary(customer)


@query("a12_joined_levels", """
SELECT r_name, string_agg(n_name, '|' ORDER BY n_name) AS levels
FROM (SELECT DISTINCT r_name, n_name FROM nation JOIN region ON r_regionkey = n_regionkey) GROUP BY r_name""")
def _(spark, sf):
    region = table(spark, sf, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    nations = joins.lookup(table(spark, sf, "nation"), region, "n_regionkey")
    return profile.joined_levels(nations, "r_name", "n_name")


@query("a13_conditional_slice", with_ctes(TRIPS) + """
SELECT program, count(*) AS n, avg(retained) AS score FROM trips
WHERE travel_type = 'F' AND price > 200000 GROUP BY program""")
def _(spark, sf):
    return roles.trips(spark, sf).filter("travel_type = 'F' and price > 200000").groupBy("program").agg(
        F.count(F.lit(1)).alias("n"), F.avg("retained").alias("score"))


@query("a14_sum_of_flags", """
SELECT user_id, """ + ", ".join(
    f"CAST(sum(CASE WHEN event_type = '{t}' THEN 1 ELSE 0 END) AS BIGINT) AS n_{t}"
    for t in ("click", "error", "purchase", "signup", "view")) + " FROM events GROUP BY user_id")
def _(spark, sf):
    flags = ("click", "error", "purchase", "signup", "view")
    return table(spark, sf, "events").groupBy("user_id").agg(*[
        F.sum((F.col("event_type") == t).cast("int")).alias(f"n_{t}") for t in flags])


@query("a15_ratio_of_sums", with_ctes(SCORED) + """
SELECT round(sum(price * pred) / sum(price), 9) AS proportion, round(sum(price) - sum(price * pred), 0) AS difference
FROM scored""")
def _(spark, sf):
    expected, total = F.sum(F.col("price") * F.col("pred")), F.sum("price")
    out = roles.scored(spark, sf).agg((expected / total).alias("proportion"), (total - expected).alias("difference"))
    return rounded(out, proportion=9, difference=0)


@query("a16_slice_median", """
SELECT o_orderkey, o_totalprice, round(m, 4) AS urgent_median FROM orders,
  (SELECT median(o_totalprice) AS m FROM orders WHERE o_orderpriority = '1-URGENT') WHERE o_totalprice > m""")
def _(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    urgent = ranking.group_quantiles(orders.filter("o_orderpriority = '1-URGENT'"), [], "o_totalprice", {"m": 0.5})
    median = urgent.scalar()
    return orders.filter(F.col("o_totalprice") > median).select(
        "o_orderkey", "o_totalprice", F.round(median, 4).alias("urgent_median"))


@query("a17_sum_of_day_differences", """
SELECT CAST(sum(CAST(l_shipdate AS DATE) - CAST(o_orderdate AS DATE) - l_linenumber) AS BIGINT) AS total_gap
FROM lineitem JOIN orders ON o_orderkey = l_orderkey""")
def _(spark, sf):
    items = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_shipdate", "l_linenumber")
    joined = items.join(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), "o_orderkey")
    return joined.agg(F.sum(F.datediff("l_shipdate", "o_orderdate") - F.col("l_linenumber")).alias("total_gap"))


# ---------------------------------------------------------------- order and windows


@query("w1_first_per_group", """
SELECT o_custkey, o_orderkey, o_totalprice FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1""")
def _(spark, sf):
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return ranking.first_per_group(orders, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")])


@query("w2_running_totals", with_ctes(SCORED) + """
SELECT pred, n, obs, CAST(sum(n) OVER w AS BIGINT) AS cum_n, CAST(sum(obs) OVER w AS BIGINT) AS cum_obs
FROM (SELECT pred, count(*) AS n, CAST(sum(retained) AS BIGINT) AS obs FROM scored GROUP BY pred)
WINDOW w AS (ORDER BY pred DESC)""")
def _(spark, sf):
    return ranking.running_totals(roles.scored(spark, sf), "pred", {"n": F.lit(1), "obs": F.col("retained")})


@query("w3_share_of_total", """
SELECT c_mktsegment, n, n / sum(n) OVER () AS share
FROM (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1)""")
def _(spark, sf):
    counts = table(spark, sf, "customer").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    return ranking.share_of_total(counts, "n", "share")


@query("w4_percent_position", """
SELECT o_totalprice, 100.0::DOUBLE * sum(n) OVER (ORDER BY o_totalprice) / sum(n) OVER () AS percentile
FROM (SELECT o_totalprice, count(*) AS n FROM orders GROUP BY 1)""")
def _(spark, sf):
    orders = table(spark, sf, "orders")
    total = orders.select(F.count(F.lit(1))).scalar()
    run = ranking.running_totals(orders, "o_totalprice", {"n": F.lit(1)}, descending=False)
    return run.select("o_totalprice", (F.lit(100.0) * F.col("cum_n") / total).alias("percentile"))


@query("w5_arg_max_rows", with_ctes(SCORED) + """
SELECT orderkey, pred, retained FROM scored WHERE pred = (SELECT max(pred) FROM scored)
UNION ALL SELECT orderkey, pred, retained FROM scored WHERE pred = (SELECT min(pred) FROM scored)""")
def _(spark, sf):
    scored = roles.scored(spark, sf).select("orderkey", "pred", "retained")
    return ranking.largest(scored, "pred").unionByName(ranking.largest(scored, "pred", smallest=True))


@query("w6_first_near_threshold", with_ctes(SCORED) + """
SELECT orderkey, pred, retained FROM scored WHERE pred > 0.7 * 0.99 AND pred < 0.7 * 1.01
ORDER BY orderkey LIMIT 1""")
def _(spark, sf):
    return ranking.nearest_to(roles.scored(spark, sf).select("orderkey", "pred", "retained"), "pred", 0.7, "orderkey")


@query("o1_sort_by_expression", """
SELECT c_custkey, c_acctbal FROM customer ORDER BY abs(c_acctbal) DESC, c_custkey""")
def _(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", "c_acctbal").orderBy(F.abs("c_acctbal").desc(), "c_custkey")


@query("o2_head_tail", """
(SELECT 'head' AS part, o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 6)
UNION ALL
(SELECT 'tail', o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 6)""")
def _(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    head = orders.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(6)
    tail = orders.orderBy("o_totalprice", "o_orderkey").limit(6)
    return head.select(F.lit("head").alias("part"), "*").unionByName(tail.select(F.lit("tail").alias("part"), "*"))


@query("o4_seeded_random_rows", """
SELECT o_orderkey, o_custkey FROM orders ORDER BY md5(o_orderkey || '|2020'), o_orderkey LIMIT 10""")
def _(spark, sf):
    return ranking.seeded_sample(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 10, 2020)


# ---------------------------------------------------------------- set operations


@query("u1_union_by_name", """
SELECT s_suppkey AS id, s_acctbal AS balance, NULL AS segment FROM supplier
UNION ALL SELECT c_custkey, c_acctbal, c_mktsegment FROM customer""")
def _(spark, sf):
    supplier = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))
    customer = table(spark, sf, "customer").select(
        F.col("c_mktsegment").alias("segment"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    return sets.stack(supplier, customer)


@query("u2_union_same_columns", """
SELECT conv_id AS id, text FROM conversations UNION ALL SELECT item_id, text FROM benchmark""")
def _(spark, sf):
    return sets.stack_same_columns(
        table(spark, sf, "conversations").select(F.col("conv_id").alias("id"), "text"),
        table(spark, sf, "benchmark").select("text", F.col("item_id").alias("id")))


@query("u3_new_levels", """
SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate < '1998-01-01'
EXCEPT SELECT o_custkey FROM orders WHERE o_orderdate >= '1998-01-01'""")
def _(spark, sf):
    orders = table(spark, sf, "orders").select("o_custkey", F.to_date("o_orderdate").alias("day"))
    return sets.new_levels(orders.filter("day < '1998-01-01'"), orders.filter("day >= '1998-01-01'"), "o_custkey")


@query("u4_align_columns", """
SELECT c_custkey, CAST(c_mktsegment = 'BUILDING' AS INTEGER) AS building,
       0 AS farming, CAST(c_mktsegment = 'HOUSEHOLD' AS INTEGER) AS household FROM customer""")
def _(spark, sf):
    """New data brought to the training columns: one column absent, one surplus."""
    flags = table(spark, sf, "customer").select("c_custkey", *[
        (F.col("c_mktsegment") == s.upper()).cast("int").alias(s) for s in ("household", "machinery", "building")])
    return sets.align_columns(flags, ["c_custkey", "building", "farming", "household"])


@query("u5_unpivot", """
SELECT p_partkey, 'size' AS var2, CAST(p_size AS DOUBLE) AS value FROM part
UNION ALL SELECT p_partkey, 'price', p_retailprice FROM part""")
def _(spark, sf):
    wide = table(spark, sf, "part").select(
        "p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    return sets.gather(wide, "p_partkey", ["size", "price"])


LEVEL_COLUMNS = ("o_orderpriority", "o_orderstatus", "o_custkey")


def levels_sql(top_n, source="orders", cols=LEVEL_COLUMNS):
    one = []
    for c in cols:
        one.append(f"""SELECT '{c}' AS "column", CAST(v AS VARCHAR) AS value, n FROM
          (SELECT {c} AS v, count(*) AS n FROM {source} GROUP BY 1)""")
    return f"""counts AS ({" UNION ALL ".join(one)}),
totals AS (SELECT "column", sum(n) AS rows, coalesce(sum(n) FILTER (value IS NULL), 0) AS missing,
                  count(value) AS n_levels FROM counts GROUP BY 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS position
           FROM counts WHERE value IS NOT NULL),
profile AS (
  SELECT "column", CAST(position AS INTEGER) AS position, value AS level, round(CAST(n / rows AS DOUBLE), 4) AS share
  FROM ranked JOIN totals USING ("column") WHERE position <= {top_n - 1}
  UNION ALL SELECT "column", 0, 'NA', round(CAST(missing / rows AS DOUBLE), 4) FROM totals
  UNION ALL SELECT "column", {top_n}, 'Rest',
    round(coalesce(greatest(n_levels - {top_n - 1}, 0) / nullif(n_levels, 0), 0), 4) FROM totals
  UNION ALL SELECT "column", {top_n + 1}, 'RestCount', greatest(n_levels - {top_n - 1}, 0) FROM totals)"""


@query("u6_levels_wide", "WITH " + levels_sql(4) + """
SELECT "column", """ + ", ".join(
    f"max(CASE WHEN position = {i} THEN level || ' : ' || printf('%.4f', share) END) AS Var_{i + 1}" for i in range(4)) + """,
  max(CASE WHEN position = 4 THEN share END) AS "Rest", max(CASE WHEN position = 5 THEN share END) AS "RestCount"
FROM profile GROUP BY 1""")
def _(spark, sf):
    wide = profile.levels_wide(profile.levels(table(spark, sf, "orders"), LEVEL_COLUMNS, 4), 4)
    return wide


# ---------------------------------------------------------------- scalar functions


@query("f5_text_length", "SELECT doc_id, length(text) AS n FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.char_length("text").cast("long").alias("n"))


@query("f6_substitute", """
SELECT c_custkey, replace(CAST(c_acctbal AS VARCHAR), '.', ',') AS balance_text,
       CAST(regexp_extract(c_name, '#0*([0-9]+)$', 1) AS VARCHAR) AS number FROM customer""")
def _(spark, sf):
    return table(spark, sf, "customer").select(
        "c_custkey", F.replace(F.col("c_acctbal").cast("string"), F.lit("."), F.lit(",")).alias("balance_text"),
        F.regexp_extract("c_name", "#0*([0-9]+)$", 1).alias("number"))


@query("f7_paste", """
SELECT p_partkey, p_brand || ' / ' || p_type AS label, concat_ws('|', p_name, p_size) AS pasted FROM part""")
def _(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", F.concat("p_brand", F.lit(" / "), "p_type").alias("label"),
        F.concat_ws("|", "p_name", "p_size").alias("pasted"))


@query("f8_lower_trim_squeeze", """
SELECT doc_id, trim(regexp_replace(lower(text), ' +', ' ', 'g')) AS text FROM documents""")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.squeeze(F.lower("text")).alias("text"))


@query("f9_month", """
SELECT o_orderkey, CAST(month(o_orderdate) AS INTEGER) AS month, strftime(o_orderdate, '%b') AS month_name FROM orders""")
def _(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", F.month("o_orderdate").alias("month"), F.date_format("o_orderdate", "MMM").alias("month_name"))


@query("f10_weekday", "SELECT o_orderkey, CAST(dayofweek(o_orderdate) + 1 AS INTEGER) AS weekday FROM orders")
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.dayofweek("o_orderdate").alias("weekday"))


@query("f11_season", """
SELECT o_orderkey, CASE WHEN md >= 1215 OR md < 315 THEN 'Winter' WHEN md < 615 THEN 'Spring'
  WHEN md < 915 THEN 'Summer' ELSE 'Fall' END AS season
FROM (SELECT o_orderkey, month(o_orderdate) * 100 + day(o_orderdate) AS md FROM orders)""")
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", clean.season(F.col("o_orderdate")).alias("season"))


@query("f12_days_between", """
SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) - DATE '1995-01-01' AS INTEGER) AS days FROM orders""")
def _(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", F.datediff("o_orderdate", F.lit("1995-01-01").cast("date")).alias("days"))


@query("f13_round_abs_sqrt", """
SELECT c_custkey, round(c_acctbal, 1) AS r1, abs(c_acctbal) AS size, round(sqrt(abs(c_acctbal)), 6) AS root FROM customer""")
def _(spark, sf):
    size = F.abs("c_acctbal")
    return table(spark, sf, "customer").select(
        "c_custkey", F.round("c_acctbal", 1).alias("r1"), size.alias("size"), F.round(F.sqrt(size), 6).alias("root"))


@query("f14_row_maximum", """
SELECT l_orderkey, l_linenumber, greatest(l_quantity, l_extendedprice, l_discount, l_tax, l_linenumber) AS biggest
FROM lineitem""")
def _(spark, sf):
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", clean.row_max(*[F.col(c).cast("double") for c in cols]).alias("biggest"))


@query("f15_if_else", with_ctes(FINANCE) + """
SELECT id_finance, CASE WHEN special_pay IS NULL THEN NULL WHEN special_pay = '0' THEN 'none' ELSE 'some' END AS aid
FROM finance""")
def _(spark, sf):
    pay = F.col("special_pay")
    return roles.finance(spark, sf).select(
        "id_finance", F.when(pay.isNull(), None).when(pay == "0", "none").otherwise("some").alias("aid"))


@query("f16_parse_number", """
SELECT c_custkey, TRY_CAST(replace(t, ',', '.') AS DOUBLE) AS balance FROM (
  SELECT c_custkey, CASE WHEN c_custkey % 10 = 3 THEN 'x' ELSE replace(CAST(c_acctbal AS VARCHAR), '.', ',') END AS t
  FROM customer)""")
def _(spark, sf):
    text_value = F.when(F.col("c_custkey") % 10 == 3, "x").otherwise(
        F.replace(F.col("c_acctbal").cast("string"), F.lit("."), F.lit(",")))
    return table(spark, sf, "customer").select("c_custkey", clean.parse_number(text_value).alias("balance"))


@query("f17_parse_date", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day FROM orders""")
def _(spark, sf):
    written = F.when(F.col("o_orderstatus") == "P", "13/45/2011").otherwise(F.date_format("o_orderdate", "M/d/yyyy"))
    return table(spark, sf, "orders").select("o_orderkey", clean.parse_date(written).alias("day"))


@query("f18_cut", """
SELECT o_orderkey,
  CAST(least(greatest(ceil((o_totalprice - lo) / ((hi - lo) / 10)), 1), 10) AS INTEGER) AS equal_bin,
  CAST(CASE WHEN o_totalprice > 100000 AND o_totalprice <= 450000 THEN
    CASE WHEN o_totalprice <= 200000 THEN 1 WHEN o_totalprice <= 300000 THEN 2 ELSE 3 END END AS INTEGER) AS break_bin
FROM orders, (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders)""")
def _(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return orders.select(
        "o_orderkey", profile.equal_width_bin(orders, "o_totalprice", 10).alias("equal_bin"),
        profile.break_bin(F.col("o_totalprice"), [100000, 200000, 300000, 450000]).alias("break_bin"))


@query("f19_strip_accents", "SELECT doc_id, strip_accents(text) AS text FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.strip_accents(F.col("text")).alias("text"))


# ---------------------------------------------------------------- profiles


@query("e1_profile_levels", "WITH " + levels_sql(10) + " SELECT * FROM profile")
def _(spark, sf):
    return profile.levels(table(spark, sf, "orders"), LEVEL_COLUMNS, 10)


@query("e1_profile_levels_na_text", "WITH " + levels_sql(3, "regions", ("r_name", "n_name")).replace(
    "counts AS (", """regions AS (
  SELECT CASE WHEN NOT contains(lower(r_name), 'am') THEN r_name END AS r_name,
         CASE WHEN NOT contains(lower(n_name), 'na') THEN n_name END AS n_name
  FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey), counts AS (""", 1)
    + " SELECT * FROM profile")
def _(spark, sf):
    """The historical rule that any text containing "na" is missing."""
    crm = roles.crm(spark, sf).select(
        F.when(~F.lower("region").contains("am"), F.col("region")).alias("r_name"), F.col("nation").alias("n_name"))
    return profile.levels(crm, ["r_name", "n_name"], 3, na_substring=True)


@query("e2_target_by_level", with_ctes(TRIPS) + """
SELECT travel_type AS level, round(sum(price / 1000), 5) AS expo, CAST(sum(retained) AS BIGINT) AS tot,
       sum(retained) / CAST(sum(program) AS DOUBLE) AS ave, round(sum(retained * 0.9::DOUBLE), 4) AS tot_pred,
       round(sum(retained * 0.9::DOUBLE) / sum(program), 9) AS predprop
FROM trips GROUP BY 1""")
def _(spark, sf):
    trips = roles.trips(spark, sf).withColumns({
        "expo": F.col("price") / 1000, "guess": F.col("retained") * F.lit(0.9)})
    out = profile.target_by_level(trips, "travel_type", "retained", exposure="expo", count="program", pred="guess")
    return rounded(out, expo=5, tot_pred=4, predprop=9)


@query("e3_portfolio", with_ctes(TRIPS) + """
SELECT CAST(count(*) AS DOUBLE) AS n, round(avg(retained), 9) AS mean, round(var_samp(retained), 9) AS var FROM trips""")
def _(spark, sf):
    return rounded(profile.portfolio(roles.trips(spark, sf), "retained"), mean=9, var=9)


@query("e4_auto_bin", with_ctes(TRIPS) + """,
lev AS (SELECT CAST(month(departure_date) AS INTEGER) AS level, count(*) AS expo, sum(retained) AS tot,
               sum(retained) / count(*) AS ave FROM trips GROUP BY 1),
st AS (SELECT avg(retained) AS mean, var_samp(retained) AS var FROM trips)
SELECT CASE WHEN (ave >= mean + var / 20 OR ave <= mean - var / 20) AND expo / (SELECT sum(expo) FROM lev) >= 0.02
            THEN CAST(level AS VARCHAR) ELSE 'other' END AS level,
       CAST(sum(expo) AS BIGINT) AS expo, CAST(sum(tot) AS BIGINT) AS tot, sum(tot) / sum(expo) AS ave
FROM lev, st GROUP BY 1""")
def _(spark, sf):
    trips = roles.trips(spark, sf).withColumn("month", F.month("departure_date"))
    by_month = profile.target_by_level(trips, "month", "retained")
    return profile.auto_bin(by_month, profile.portfolio(trips, "retained"), strength=20.0)


@query("e5_numeric_bins", with_ctes(TRIPS) + """,
b AS (SELECT CAST(CASE WHEN price > lo THEN least(ceil((price - lo) / ((hi - lo) / 10)), 10) ELSE 1 END AS INTEGER) AS level,
             retained FROM trips, (SELECT min(price) AS lo, max(price) AS hi FROM trips))
SELECT level, count(*) AS expo, CAST(sum(retained) AS BIGINT) AS tot, sum(retained) / count(*) AS ave FROM b GROUP BY 1""")
def _(spark, sf):
    return profile.target_by_level(roles.trips(spark, sf), "price", "retained", n_bins=10)


@query("e9_missing_share", with_ctes(SALES, FINANCE) + """
SELECT * FROM (
  SELECT 'special_pay' AS "column", (count(*) - count(special_pay)) / count(*) AS share
  FROM sales LEFT JOIN finance USING (orderkey)
  UNION ALL SELECT 'revenue', (count(*) - count(revenue)) / count(*)
  FROM sales LEFT JOIN finance USING (orderkey))
WHERE share > 0""")
def _(spark, sf):
    joined = roles.sales(spark, sf).join(
        roles.finance(spark, sf).select("orderkey", "special_pay", "revenue"), "orderkey", "left")
    return profile.missing(joined.select("orderkey", "price", "special_pay", "revenue"))


NUMBERS = ("discount", "n_lines", "pax", "revenue")
PAIRS = [(a, b) for i, a in enumerate(NUMBERS) for b in NUMBERS[i + 1:]]
CORRELATIONS = "cor AS (" + " UNION ALL ".join(
    f"SELECT '{a}' AS var1, '{b}' AS var2, corr({a}, {b}) AS value FROM finance" for a, b in PAIRS) + ")"


@query("e10_correlation", with_ctes(FINANCE, CORRELATIONS) + "SELECT var1, var2, round(value, 9) AS value FROM cor")
def _(spark, sf):
    return rounded(profile.correlation(roles.finance(spark, sf), NUMBERS), value=9)


@query("e11_correlated_pairs", with_ctes(FINANCE, CORRELATIONS) + """
SELECT var1, var2, round(value, 9) AS value FROM cor WHERE abs(value) > 0.8 AND abs(value) < 1""")
def _(spark, sf):
    return rounded(profile.correlated_pairs(roles.finance(spark, sf), NUMBERS), value=9)


@query("e12_drop_correlated", with_ctes(FINANCE) + "SELECT id_finance, round(discount, 9) AS discount, n_lines FROM finance")
def _(spark, sf):
    finance = roles.finance(spark, sf).select("id_finance", *NUMBERS)
    out = profile.drop_correlated(finance, profile.correlated_pairs(finance, NUMBERS))
    return rounded(out, discount=9)


NZV_COLUMNS = ("l_returnflag", "l_linestatus", "rare", "constant", "l_orderkey")
NZV_SOURCE = """items AS (SELECT l_returnflag, l_linestatus, l_orderkey, 'x' AS constant,
  CASE WHEN l_quantity = 1 AND l_discount > 0.05 THEN 'b' ELSE 'a' END AS rare FROM lineitem)"""


def nzv_items(spark, sf):
    rare = F.when((F.col("l_quantity") == 1) & (F.col("l_discount") > 0.05), "b").otherwise("a")
    return table(spark, sf, "lineitem").select(
        "l_returnflag", "l_linestatus", "l_orderkey", F.lit("x").alias("constant"), rare.alias("rare"))


def nzv_sql(c):
    return f"""SELECT '{c}' AS "column",
  coalesce(max(n) / (SELECT n FROM (SELECT count(*) AS n FROM items GROUP BY {c}) ORDER BY n DESC LIMIT 1 OFFSET 1), 0) AS freq_ratio,
  100.0::DOUBLE * count(*) / sum(n) AS percent_unique, count(*) = 1 AS zero_var
  FROM (SELECT {c}, count(*) AS n FROM items GROUP BY 1)"""


@query("e13_near_zero_variance", with_ctes(NZV_SOURCE) + ", r AS (" + "\nUNION ALL ".join(map(nzv_sql, NZV_COLUMNS)) + """)
SELECT *, zero_var OR (freq_ratio > 19 AND percent_unique <= 10) AS nzv FROM r""")
def _(spark, sf):
    return profile.near_zero_variance(nzv_items(spark, sf), NZV_COLUMNS)


@query("e13_drop_near_zero_variance", with_ctes(NZV_SOURCE) + "SELECT l_returnflag, l_linestatus, l_orderkey FROM items")
def _(spark, sf):
    """The columns marked on part of the rows are dropped from all of them."""
    items = nzv_items(spark, sf)
    report = profile.near_zero_variance(items.filter("l_orderkey % 2 = 0"), NZV_COLUMNS)
    return profile.drop_near_zero_variance(items, report)


@query("e14_histogram", """
SELECT CAST(least(greatest(ceil((value - lo) / ((hi - lo) / 20)), 1), 20) AS INTEGER) AS bin, count(*) AS n
FROM events, (SELECT min(value) AS lo, max(value) AS hi FROM events) GROUP BY 1""")
def _(spark, sf):
    return profile.histogram(table(spark, sf, "events"), "value", 20)


@query("e15_box_stats", """
WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, median(value) AS median,
                  quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1)
SELECT event_type, round(any_value(q1), 6) AS q1, round(any_value(median), 6) AS median, round(any_value(q3), 6) AS q3,
       min(value) FILTER (value >= q1 - 1.5 * (q3 - q1)) AS low_whisker,
       max(value) FILTER (value <= q3 + 1.5 * (q3 - q1)) AS high_whisker,
       count(*) FILTER (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS n_outliers
FROM events JOIN q USING (event_type) GROUP BY 1""")
def _(spark, sf):
    return rounded(profile.box_stats(table(spark, sf, "events"), "value", ["event_type"]), q1=6, median=6, q3=6)


@query("e16_formula_consistency", "WITH e AS (SELECT (l_extendedprice - l_quantity * 3000) / (l_quantity * 3000) AS rel_error FROM lineitem)\n"
       + summary_sql("e", "rel_error"))
def _(spark, sf):
    """A supplied price against quantity times the list price."""
    return round_summary(profile.consistency(
        table(spark, sf, "lineitem"), "l_extendedprice", F.col("l_quantity") * 3000))
