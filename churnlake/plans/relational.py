"""Queries: sources, projections, predicates and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from churnlake.functions import clean
from churnlake.operators import joins, keys, profile
from churnlake.plans import roles
from churnlake.plans.registry import query
from churnlake.plans.roles import CRM, FINANCE, MESSAGES, SALES, SCORED, TRIPS, rounded, table, with_ctes
from churnlake.session import shared_folder
from churnlake.sources import lookups, tables

# ---------------------------------------------------------------- sources


@query("s1_read_text_table", """
SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey,
       CAST(c_acctbal AS VARCHAR) AS c_acctbal, c_mktsegment FROM customer""")
def _(spark, sf):
    customer = table(spark, sf, "customer")
    path = shared_folder(spark, "customer-csv")
    tables.write_table(customer, path, "csv")
    return tables.read_text_table(spark, path, customer.columns)


@query("s2_read_with_encoding", with_ctes(MESSAGES) + "SELECT doc_id, text FROM messages")
def _(spark, sf):
    """Texts written as UTF-16 and read back, accents and line breaks intact."""
    path = shared_folder(spark, "messages-csv")
    tables.write_table(roles.messages(spark, sf).select("doc_id", "text"), path, "csv", encoding="UTF-16")
    return tables.read_text_table(spark, path, ["doc_id", "text"], encoding="UTF-16", multiline=True)


@query("s3_na_tokens", with_ctes(FINANCE) + """
SELECT id_finance, coalesce(special_pay, 'NA') AS special_pay,
       nullif(CAST(n_lines AS VARCHAR), '1') AS n_lines FROM finance""")
def _(spark, sf):
    """"NA" stays a value; only the listed token is missing."""
    finance = roles.finance(spark, sf).select(
        "id_finance", F.coalesce("special_pay", F.lit("NA")).alias("special_pay"),
        F.when(F.col("n_lines") == 1, "missing").otherwise(F.col("n_lines").cast("string")).alias("n_lines"))
    path = shared_folder(spark, "finance-csv")
    tables.write_table(finance, path, "csv")
    return tables.read_text_table(spark, path, na_tokens=["missing"])


@query("s4_typed_columns", """
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, o_totalprice,
       CASE WHEN o_orderstatus <> 'P' THEN o_custkey END AS custkey FROM orders""")
def _(spark, sf):
    """Bad numbers become missing instead of failing the read."""
    orders = table(spark, sf, "orders").select(
        "o_orderkey", F.date_format("o_orderdate", "M/d/yyyy").alias("day"), "o_totalprice",
        F.when(F.col("o_orderstatus") == "P", "n/a").otherwise(F.col("o_custkey").cast("string")).alias("custkey"))
    path = shared_folder(spark, "orders-csv")
    tables.write_table(orders, path, "csv")
    return tables.read_typed_table(spark, path, "o_orderkey long, day date, o_totalprice double, custkey long")


STATES = "states AS (SELECT * FROM (VALUES " + ", ".join(
    "(" + ", ".join(f"'{v}'" for v in row) + ")" for row in lookups.state_rows()
) + ") AS t(" + ", ".join(lookups.STATE_COLUMNS) + "))"


def customer_states(spark, sf):
    codes = F.array(*[F.lit(r[0]) for r in lookups.state_rows()])
    return table(spark, sf, "customer").select(
        "c_custkey", "c_acctbal", codes[(F.col("c_custkey") % 50).cast("int")].alias("group_state"))


CUSTOMER_STATES = "customer_states AS (SELECT c_custkey, c_acctbal, [" + ", ".join(
    f"'{r[0]}'" for r in lookups.state_rows()) + "][c_custkey % 50 + 1] AS group_state FROM customer)"


@query("s5_inline_lookup", with_ctes(STATES, CUSTOMER_STATES) + """
SELECT main_region, north_south, east_west, count(*) AS n_customers
FROM customer_states LEFT JOIN states USING (group_state) GROUP BY ALL""")
def _(spark, sf):
    joined = customer_states(spark, sf).join(F.broadcast(lookups.state_regions(spark)), "group_state", "left")
    return joined.groupBy("main_region", "north_south", "east_west").agg(F.count(F.lit(1)).alias("n_customers"))


@query("s6_csv_sink", with_ctes(SCORED) + """
SELECT CAST(orderkey AS VARCHAR) AS orderkey, CASE WHEN pred >= 0.7 THEN 'yes' ELSE 'no' END AS pred_class
FROM scored""")
def _(spark, sf):
    """Predictions written as CSV, read back to check the file."""
    out = roles.scored(spark, sf).select(
        "orderkey", F.when(F.col("pred") >= 0.7, "yes").otherwise("no").alias("pred_class"))
    path = shared_folder(spark, "predictions")
    tables.write_table(out, path, "csv")
    return tables.read_text_table(spark, path, out.columns)


# ---------------------------------------------------------------- projections and predicates


@query("p1_select_drop", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def _(spark, sf):
    return table(spark, sf, "orders").drop("o_orderdate", "o_orderpriority", "o_orderstatus")


@query("p2_select_by_predicate", "SELECT l_orderkey, l_partkey, l_suppkey, l_discount FROM lineitem")
def _(spark, sf):
    items = table(spark, sf, "lineitem")
    cols = clean.pick_columns(items, suffix="KEY") + clean.pick_columns(items, contains="disc", kind="numeric")
    return items.select(*cols)


@query("p3_add_column", """
SELECT l_orderkey, l_extendedprice, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem""")
def _(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_extendedprice", "l_discount").withColumn(
        "net", F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4)).drop("l_discount")


@query("p4_filter_null_drops", with_ctes(FINANCE) + """
SELECT id_finance, special_pay, n_lines FROM finance WHERE special_pay <> '0'""")
def _(spark, sf):
    return roles.finance(spark, sf).filter(F.col("special_pay") != "0").select("id_finance", "special_pay", "n_lines")


@query("p5_membership", with_ctes(FINANCE) + """
SELECT id_finance, coalesce(special_pay IN ('0', 'FR'), false) AS listed,
       special_pay IS NULL OR special_pay IN ('SA') AS listed_or_missing FROM finance""")
def _(spark, sf):
    pay = F.col("special_pay")
    return roles.finance(spark, sf).select(
        "id_finance", clean.is_member(pay, ["0", "FR"]).alias("listed"),
        clean.is_member(pay, ["SA"], null_is_member=True).alias("listed_or_missing"))


@query("p6_collapse_levels", with_ctes(FINANCE) + """
SELECT id_finance, CASE WHEN special_pay IN ('SA') THEN special_pay ELSE 'other' END AS pay FROM finance""")
def _(spark, sf):
    return roles.finance(spark, sf).select("id_finance", clean.collapse_levels(F.col("special_pay"), ["SA"]).alias("pay"))


@query("p7_recode", """
SELECT c_custkey, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'industry'
       WHEN c_mktsegment = 'HOUSEHOLD' THEN 'home' ELSE c_mktsegment END AS segment,
       CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN 'car' ELSE 'ground' END AS travel FROM customer""")
def _(spark, sf):
    segment = F.col("c_mktsegment")
    return table(spark, sf, "customer").select(
        "c_custkey",
        clean.recode(segment, {"BUILDING": "industry", "MACHINERY": "industry", "HOUSEHOLD": "home"}).alias("segment"),
        clean.recode(segment, {"AUTOMOBILE": "car"}, default="ground").alias("travel"))


@query("p8_sentinel_to_null", """
SELECT o_orderkey, nullif(o_orderpriority, '4-NOT SPECIFIED') AS priority FROM orders""")
def _(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", clean.to_null(F.col("o_orderpriority"), ["4-NOT SPECIFIED"]).alias("priority"))


@query("p9_null_to_constant", with_ctes(SALES, FINANCE) + """
SELECT id_sales, coalesce(special_pay, 'other') AS special_pay, coalesce(n_lines, 0) AS n_lines
FROM sales LEFT JOIN finance USING (orderkey)""")
def _(spark, sf):
    joined = roles.sales(spark, sf).select("id_sales", "orderkey").join(
        roles.finance(spark, sf).select("orderkey", "special_pay", "n_lines"), "orderkey", "left").drop("orderkey")
    return clean.fill_text(joined).fillna({"n_lines": 0})


@query("p10_missing_flag", with_ctes(FINANCE) + """
SELECT id_finance, CASE WHEN special_pay IS NULL THEN 'no_notification' ELSE 'notified' END AS early
FROM finance""")
def _(spark, sf):
    return roles.finance(spark, sf).select(
        "id_finance", clean.missing_flag(F.col("special_pay"), "no_notification", "notified").alias("early"))


@query("p11_fill_from_ratio", """
SELECT event_id, CASE WHEN v IS NULL AND user_id > 0 THEN event_id / user_id ELSE v END AS ratio
FROM (SELECT event_id, user_id, CASE WHEN event_type <> 'error' THEN value END AS v FROM events)""")
def _(spark, sf):
    events = table(spark, sf, "events").withColumn(
        "v", F.when(F.col("event_type") != "error", F.col("value")))
    return events.select("event_id", clean.fill_from_ratio(
        F.col("v"), F.col("event_id"), F.col("user_id")).alias("ratio"))


@query("p12_difference_ratio", """
SELECT l_orderkey, l_linenumber, l_quantity + l_linenumber - l_suppkey AS pax_diff,
       l_extendedprice / l_quantity AS ave_price, l_discount / nullif(l_tax, 0) AS prop_discount FROM lineitem""")
def _(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber",
        (F.col("l_quantity") + F.col("l_linenumber") - F.col("l_suppkey")).alias("pax_diff"),
        F.try_divide("l_extendedprice", "l_quantity").alias("ave_price"),
        F.try_divide("l_discount", "l_tax").alias("prop_discount"))


@query("p13_threshold_class", """
SELECT p_partkey, CASE WHEN p_size <= 8 THEN 'lower' ELSE 'higher' END AS size_class FROM part""")
def _(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", clean.threshold_class(F.col("p_size"), 8, "lower", "higher").alias("size_class"))


@query("p14_min_max_scale", """
SELECT o_orderkey, round((o_totalprice - lo) / (hi - lo), 4) AS o_totalprice
FROM orders, (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders)""")
def _(spark, sf):
    return clean.min_max_scale(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice")


@query("p15_relabel", "SELECT c_custkey AS customer, c_acctbal AS ave_balance FROM customer")
def _(spark, sf):
    return clean.relabel(table(spark, sf, "customer").select("c_custkey", "c_acctbal"),
                         {"c_custkey": "customer", "c_acctbal": "ave_balance"})


@query("p16_exclude_by_regex", """
SELECT p_partkey, p_name FROM part WHERE NOT regexp_matches(p_name, '^(red|small) ')""")
def _(spark, sf):
    return table(spark, sf, "part").filter(~F.col("p_name").rlike("^(red|small) ")).select("p_partkey", "p_name")


# ---------------------------------------------------------------- joins


@query("j1_left_join_two_names", with_ctes(CRM) + """
SELECT o_orderkey, o_custkey, segment FROM orders
LEFT JOIN (SELECT * FROM crm WHERE income_level <> 'AS') ON o_custkey = custkey""")
def _(spark, sf):
    crm = roles.crm(spark, sf).filter(F.col("income_level") != "AS").select("custkey", "segment")
    return joins.left_on(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), crm, "o_custkey", "custkey")


SALES_ACTUAL = """sales_actual AS (
  SELECT *, substr(id_sales, length(program_code) + 1,
                   length(id_sales) - length(program_code) - length(travel_type)) AS id_actual
  FROM sales)"""
FINANCE_ACTUAL = """finance_actual AS (
  SELECT *, CASE WHEN special_pay = '0' THEN id_finance
                 ELSE substr(id_finance, length(coalesce(special_pay, 'NA')) + 1) END AS id_actual
  FROM finance)"""
CRM_ACTUAL = """crm_actual AS (
  SELECT *, substr(id_crm, length(poverty_code) + 1,
                   length(id_crm) - length(poverty_code) - length(income_level)) AS id_actual FROM crm)"""


def sales_actual(spark, sf):
    return keys.split_composite(roles.sales(spark, sf), "id_sales", "program_code", "travel_type")


def finance_actual(spark, sf):
    return keys.split_composite(roles.finance(spark, sf), "id_finance", "special_pay",
                                empty_prefix=("0",), null_prefix="NA")


def crm_actual(spark, sf):
    return keys.split_composite(roles.crm(spark, sf), "id_crm", "poverty_code", "income_level")


@query("j2_left_join_derived_key", with_ctes(SALES, FINANCE, CRM, SALES_ACTUAL, FINANCE_ACTUAL, CRM_ACTUAL) + """
SELECT s.id_actual, s.id_sales, c.segment, c.region, round(f.revenue, 4) AS revenue, f.pax
FROM sales_actual s
LEFT JOIN crm_actual c ON CAST(s.custkey AS VARCHAR) = c.id_actual
LEFT JOIN finance_actual f ON s.id_actual = f.id_actual""")
def _(spark, sf):
    crm = crm_actual(spark, sf).select(F.col("id_actual").alias("customer_id"), "segment", "region")
    finance = finance_actual(spark, sf).select("id_actual", "revenue", "pax")
    joined = (
        sales_actual(spark, sf).select("id_actual", "id_sales", F.col("custkey").cast("string").alias("customer_id"))
        .join(crm, "customer_id", "left").join(finance, "id_actual", "left"))
    return rounded(joined.drop("customer_id"), revenue=4)


@query("j3_natural_left_join", with_ctes(CRM) + """
SELECT custkey, id_crm, n_orders FROM crm
LEFT JOIN (SELECT o_custkey AS custkey, count(*) AS n_orders FROM orders GROUP BY 1) USING (custkey)""")
def _(spark, sf):
    per_customer = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("custkey")).agg(
        F.count(F.lit(1)).alias("n_orders"))
    return joins.natural_left(roles.crm(spark, sf).select("custkey", "id_crm"), per_customer)


@query("j4_inner_join", """
SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id""")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels"), "doc_id")


@query("j5_anti_join", with_ctes(SALES, FINANCE, SALES_ACTUAL, FINANCE_ACTUAL) + """
SELECT id_sales, id_actual FROM sales_actual s
WHERE NOT EXISTS (SELECT 1 FROM finance_actual f WHERE f.id_actual = s.id_actual)""")
def _(spark, sf):
    return joins.unmatched(sales_actual(spark, sf).select("id_sales", "id_actual"),
                           finance_actual(spark, sf).select("id_actual"), "id_actual")


@query("j6_semi_join", """
SELECT c_custkey, c_name FROM customer
WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)""")
def _(spark, sf):
    big = table(spark, sf, "orders").filter("o_totalprice > 450000").select(F.col("o_custkey").alias("c_custkey"))
    return joins.matched(table(spark, sf, "customer").select("c_custkey", "c_name"), big, "c_custkey")


@query("j7_lookup_join", with_ctes(STATES, CUSTOMER_STATES) + """
SELECT c_custkey, group_state, main_region FROM customer_states LEFT JOIN states USING (group_state)""")
def _(spark, sf):
    states = lookups.state_regions(spark).select("group_state", "main_region")
    return joins.lookup(customer_states(spark, sf).drop("c_acctbal"), states, "group_state")


@query("j8_join_on_document", """
SELECT d.doc_id, d.n_chars, length(d.text) AS n_code_points, e.label
FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id""")
def _(spark, sf):
    """Two results about the same texts, joined on the text's key."""
    sizes = table(spark, sf, "documents").select(
        "doc_id", "n_chars", F.char_length("text").cast("long").alias("n_code_points"))
    labels = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "label")
    return sizes.join(labels, "doc_id")


@query("j9_bind_columns", with_ctes(SCORED) + """
SELECT orderkey, retained, travel_type, price, pred, CASE WHEN pred >= 0.7 THEN 'yes' ELSE 'no' END AS pred_class
FROM scored""")
def _(spark, sf):
    """Targets, text columns and numbers side by side: one select, no row positions."""
    return roles.scored(spark, sf).select(
        "orderkey", "retained", "travel_type", "price", "pred",
        F.when(F.col("pred") >= 0.7, "yes").otherwise("no").alias("pred_class"))


@query("j10_distinct_before_join", """
SELECT c_custkey, kind FROM customer LEFT JOIN
  (SELECT DISTINCT o_custkey AS c_custkey, o_orderstatus AS kind FROM orders WHERE o_orderstatus = 'F')
  USING (c_custkey)""")
def _(spark, sf):
    filled = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(
        F.col("o_custkey").alias("c_custkey"), F.col("o_orderstatus").alias("kind"))
    return joins.left_keep_cardinality(table(spark, sf, "customer").select("c_custkey"), filled, ["c_custkey"], ["kind"])


@query("j11_changed_predictions", with_ctes(SCORED) + """
SELECT orderkey, a AS pred_class_old, b AS pred_class_new FROM (
  SELECT orderkey, CASE WHEN pred >= 0.65 THEN 'yes' ELSE 'no' END AS a,
         CASE WHEN pred >= 0.7 THEN 'yes' ELSE 'no' END AS b FROM scored) WHERE a <> b""")
def _(spark, sf):
    scored = roles.scored(spark, sf)

    def classes(cut):
        return scored.select("orderkey", F.when(F.col("pred") >= cut, "yes").otherwise("no").alias("pred_class"))

    return joins.changed(classes(0.65), classes(0.7), "orderkey", ["pred_class"])


# ---------------------------------------------------------------- key functions


@query("f1_prefix_by_length", with_ctes(SALES) + """
SELECT id_sales, substr(id_sales, 1, length(program_code)) AS head FROM sales""")
def _(spark, sf):
    return roles.sales(spark, sf).select("id_sales", F.substring(
        F.col("id_sales"), F.lit(1), F.length("program_code")).alias("head"))


@query("f2_suffix_by_length", with_ctes(SALES) + """
SELECT id_sales, right(id_sales, length(travel_type)) AS tail FROM sales""")
def _(spark, sf):
    return roles.sales(spark, sf).select("id_sales", F.right(
        F.col("id_sales"), F.length("travel_type")).alias("tail"))


@query("f3_strip_prefix_suffix", with_ctes(SALES, SALES_ACTUAL) + """
SELECT id_sales, id_actual,
       CASE WHEN ends_with(id_sales, travel_type) THEN id_actual
            ELSE substr(id_sales, length(program_code) + 1) END AS id_guarded
FROM sales_actual""")
def _(spark, sf):
    by_length = sales_actual(spark, sf)
    guarded = keys.strip_suffix(keys.strip_prefix(F.col("id_sales"), F.col("program_code"), True),
                                F.col("travel_type"), True)
    return by_length.select("id_sales", "id_actual", guarded.alias("id_guarded"))


@query("f4_prefix_suffix_test", with_ctes(SALES) + """
SELECT id_sales, starts_with(id_sales, program_code) AS prefix_ok, ends_with(id_sales, travel_type) AS suffix_ok
FROM sales""")
def _(spark, sf):
    return sales_actual(spark, sf).select("id_sales", "prefix_ok", "suffix_ok")


@query("e17_reconciliation_report", with_ctes(SALES, FINANCE, SALES_ACTUAL, FINANCE_ACTUAL) + """
SELECT 'left_rows' AS "check", count(*) AS n FROM sales_actual
UNION ALL SELECT 'left_prefix_mismatch', count(*) FROM sales_actual WHERE NOT starts_with(id_sales, program_code)
UNION ALL SELECT 'left_suffix_mismatch', count(*) FROM sales_actual WHERE NOT ends_with(id_sales, travel_type)
UNION ALL SELECT 'right_rows', count(*) FROM finance_actual
UNION ALL SELECT 'right_prefix_mismatch', count(*) FROM finance_actual WHERE NOT starts_with(id_finance,
  CASE WHEN special_pay = '0' THEN '' ELSE coalesce(special_pay, 'NA') END)
UNION ALL SELECT 'right_suffix_mismatch', 0
UNION ALL SELECT 'left_repeated_keys', count(*) FROM (SELECT id_actual FROM sales_actual GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'right_repeated_keys', count(*) FROM (SELECT id_actual FROM finance_actual GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'left_unmatched', count(*) FROM sales_actual WHERE id_actual NOT IN (SELECT id_actual FROM finance_actual)
UNION ALL SELECT 'right_unmatched', count(*) FROM finance_actual WHERE id_actual NOT IN (SELECT id_actual FROM sales_actual)
""")
def _(spark, sf):
    return keys.reconciliation_report(sales_actual(spark, sf), finance_actual(spark, sf))


@query("retention_by_region", with_ctes(TRIPS, CRM) + """
SELECT region AS level, CAST(count(*) AS BIGINT) AS expo, CAST(sum(retained) AS BIGINT) AS tot,
       CAST(sum(retained) AS DOUBLE) / count(*) AS ave
FROM trips JOIN crm USING (custkey) GROUP BY region""")
def retention_by_region(spark, sf):
    """Flagship: composite customers, two joins, then the retention rate per region."""
    crm = roles.crm(spark, sf).select("custkey", "region")
    return profile.target_by_level(roles.trips(spark, sf).join(crm, "custkey"), "region", "retained")
