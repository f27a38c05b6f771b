"""The retention roles (sales, CRM, finance, messages) on the analytics tables.

Every role exists twice: as a DataFrame and as the SQL text of the same rows,
which the oracle queries prepend as common table expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RETENTION_DAYS = 365


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    """Round double results, whose last bits depend on the order of summation."""
    return df.withColumns({c: F.round(F.col(c), d) for c, d in digits.items()})


# --- sales: one row per trip ------------------------------------------------

def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    program = F.concat(F.substring("o_orderpriority", 1, 1), F.lit("-"))
    # A few IDs end in another code than the travel type, as in real extracts.
    tail = F.when(key % 997 == 0, F.lit("0")).otherwise(F.col("o_orderstatus"))
    return table(spark, sf_dir, "orders").select(
        F.concat(program, key.cast("string"), tail).alias("id_sales"),
        program.alias("program_code"),
        F.col("o_orderstatus").alias("travel_type"),
        F.col("o_custkey").alias("custkey"),
        F.to_date("o_orderdate").alias("departure_date"),
        F.col("o_totalprice").alias("price"),
        key.alias("orderkey"),
    )


SALES = """sales AS (
  SELECT substr(o_orderpriority, 1, 1) || '-' || CAST(o_orderkey AS VARCHAR)
           || CASE WHEN o_orderkey % 997 = 0 THEN '0' ELSE o_orderstatus END AS id_sales,
         substr(o_orderpriority, 1, 1) || '-' AS program_code,
         o_orderstatus AS travel_type, o_custkey AS custkey,
         CAST(o_orderdate AS DATE) AS departure_date,
         o_totalprice AS price, o_orderkey AS orderkey
  FROM orders)"""


# --- CRM: one row per customer ----------------------------------------------

def crm(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("c_nationkey"), "n_name", "n_regionkey")
    region = table(spark, sf_dir, "region").select(
        F.col("r_regionkey").alias("n_regionkey"), "r_name")
    poverty = F.substring("c_mktsegment", 1, 1)
    income = F.substring("r_name", 1, 2)
    return (
        table(spark, sf_dir, "customer")
        .join(nation, "c_nationkey", "left")
        .join(region, "n_regionkey", "left")
        .select(
            F.concat(poverty, F.col("c_custkey").cast("string"), income).alias("id_crm"),
            poverty.alias("poverty_code"),
            income.alias("income_level"),
            F.col("c_custkey").alias("custkey"),
            F.col("c_mktsegment").alias("segment"),
            F.col("n_name").alias("nation"),
            F.col("r_name").alias("region"),
            F.col("c_acctbal").alias("balance"),
        )
    )


CRM = """crm AS (
  SELECT substr(c_mktsegment, 1, 1) || CAST(c_custkey AS VARCHAR) || substr(r_name, 1, 2) AS id_crm,
         substr(c_mktsegment, 1, 1) AS poverty_code, substr(r_name, 1, 2) AS income_level,
         c_custkey AS custkey, c_mktsegment AS segment, n_name AS nation, r_name AS region,
         c_acctbal AS balance
  FROM customer
  LEFT JOIN nation ON n_nationkey = c_nationkey
  LEFT JOIN region ON r_regionkey = n_regionkey)"""


# --- finance: one row per trip that has line items --------------------------

def finance(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_trip = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.min("l_returnflag").alias("flag"),
        F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"),
        F.sum("l_quantity").alias("pax"),
        F.avg("l_discount").alias("discount"),
        F.count(F.lit(1)).alias("n_lines"),
    )
    pay = F.when(F.col("flag") == "A", "0").when(F.col("flag") == "R", "SA")
    key = F.col("l_orderkey").cast("string")
    return per_trip.withColumn("special_pay", pay).select(
        F.when(F.col("special_pay") == "0", key)
        .otherwise(F.concat(F.coalesce("special_pay", F.lit("NA")), key)).alias("id_finance"),
        "special_pay", "revenue", "pax", "discount", "n_lines",
        F.col("l_orderkey").alias("orderkey"),
    )


FINANCE = """finance AS (
  SELECT CASE WHEN special_pay = '0' THEN k ELSE coalesce(special_pay, 'NA') || k END AS id_finance,
         special_pay, revenue, pax, discount, n_lines, orderkey
  FROM (SELECT CASE min(l_returnflag) WHEN 'A' THEN '0' WHEN 'R' THEN 'SA' END AS special_pay,
               CAST(l_orderkey AS VARCHAR) AS k, l_orderkey AS orderkey,
               sum(l_extendedprice * (1 - l_discount)) AS revenue, sum(l_quantity) AS pax,
               avg(l_discount) AS discount, count(*) AS n_lines
        FROM lineitem GROUP BY l_orderkey))"""


# --- messages: several texts per customer -----------------------------------

def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("doc_id"),
        F.col("conv_id").alias("customer_id"), "role", "text")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


MESSAGES = """messages AS (
  SELECT conv_id || '-' || turn AS doc_id, conv_id AS customer_id, role, text
  FROM conversations)"""


# --- trips: sales rows with the retention target ----------------------------

def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with ``retained`` = the customer orders again within a year.

    The look-ahead runs over one row per customer and day, so a customer with a
    third of all orders still gives no more rows than the calendar has days.
    """
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day"),
        "o_totalprice", "o_orderpriority", "o_orderstatus")
    by_day = orders.groupBy("o_custkey", "day").agg(F.max("o_orderkey").alias("last_key"))
    ahead = Window.partitionBy("o_custkey").orderBy("day")
    by_day = by_day.withColumn("next_day", F.lead("day").over(ahead))
    last_day = orders.select(F.max("day")).scalar()
    again = (F.col("o_orderkey") < F.col("last_key")) | F.coalesce(
        F.datediff("next_day", "day") <= RETENTION_DAYS, F.lit(False))
    return (
        orders.filter(F.col("day") <= F.date_sub(last_day, RETENTION_DAYS))
        .join(by_day, ["o_custkey", "day"])
        .select(
            F.col("o_orderkey").alias("orderkey"),
            F.col("o_custkey").alias("custkey"),
            F.col("day").alias("departure_date"),
            F.col("o_totalprice").alias("price"),
            F.substring("o_orderpriority", 1, 1).cast("int").alias("program"),
            F.col("o_orderstatus").alias("travel_type"),
            again.cast("int").alias("retained"),
        )
    )


TRIPS = f"""trips AS (
  SELECT o_orderkey AS orderkey, o_custkey AS custkey, d AS departure_date, o_totalprice AS price,
         CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS program, o_orderstatus AS travel_type,
         CASE WHEN nd - d <= {RETENTION_DAYS} THEN 1 ELSE 0 END AS retained
  FROM (SELECT *, lead(d) OVER (PARTITION BY o_custkey ORDER BY d, o_orderkey) AS nd,
               max(d) OVER () AS last_d
        FROM (SELECT *, CAST(o_orderdate AS DATE) AS d FROM orders))
  WHERE d <= last_d - {RETENTION_DAYS})"""


# --- a closed-form scorer, the same in both engines -------------------------

# Fixed coefficients of the example scorer.
INTERCEPT, PER_PRICE, PER_PROGRAM = 0.9, -0.35, 0.2
SCORE_DIGITS = 4


def score(price: Column, program: Column) -> Column:
    z = INTERCEPT + PER_PRICE * (price / 100000.0 - 2.5) + PER_PROGRAM * (program - 3)
    return F.round(1.0 / (1.0 + F.exp(-z)), SCORE_DIGITS)


def score_sql(price: str, program: str) -> str:
    return (f"round(1.0 / (1.0 + exp(-({INTERCEPT} + {PER_PRICE} * ({price} / 100000.0 - 2.5)"
            f" + {PER_PROGRAM} * ({program} - 3)))), {SCORE_DIGITS})")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trips(spark, sf_dir).withColumn("pred", score(F.col("price"), F.col("program")))


SCORED = TRIPS + f""", scored AS (
  SELECT *, CAST({score_sql('CAST(price AS DOUBLE)', 'program')} AS DOUBLE) AS pred FROM trips)"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
