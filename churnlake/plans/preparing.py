"""Queries: topics, splitting, imputing, scaling, encoding and level groups."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from churnlake.operators import levels, prep, profile, sentiment, texts, topics
from churnlake.operators.side_by_side import silhouettes
from churnlake.plans import roles
from churnlake.plans.registry import ORACLES, query
from churnlake.plans.roles import CRM, FINANCE, MESSAGES, TRIPS, rounded, table, with_ctes
from churnlake.plans.texts import COUNTS, STATS, TFIDF, TOKENS, message_counts, message_tfidf, message_tokens, part_of_speech, scored_messages
from churnlake.session import checkpoint


@query("t9_lsa_singular_values")
def _(spark, sf):
    model = topics.lsa(message_tfidf(spark, sf), "doc_id", 30)
    rows = [(i, v) for i, v in enumerate(model.singular_values)]
    return spark.createDataFrame(rows, "component int, singular_value double")


@query("t10_topic_top_terms")
def _(spark, sf):
    return topics.topic_terms(topics.lsa(message_tfidf(spark, sf), "doc_id", 30))


@query("o3_top_terms_per_topic")
def _(spark, sf):
    return topics.topic_terms(topics.lsa(message_tfidf(spark, sf), "doc_id", 10), 7)


@query("t11_topic_flags")
def _(spark, sf):
    """Topic flags of the messages, summed per customer."""
    model = topics.lsa(message_tfidf(spark, sf), "doc_id", 30)
    flagged = topics.flags(model, "doc_id").join(
        roles.messages(spark, sf).select("doc_id", "customer_id"), "doc_id")
    names = [c for c in flagged.columns if c.startswith("topic_")]
    return sentiment.customer_features(flagged, "customer_id", {}, (), names)


@query("t9_lsa_residuals")
def _(spark, sf):
    """How far each component is from a singular vector: ``|A'A v - s^2 v| / s^2``."""
    model = topics.lsa(message_tfidf(spark, sf), "doc_id", 30)
    rows = [(i, s, r) for i, (s, r) in enumerate(zip(model.singular_values, model.residuals))]
    return spark.createDataFrame(rows, "component int, singular_value double, residual double")


# The components of two terms have a closed form.
TWO_TERMS = """two AS (SELECT term, row_number() OVER (ORDER BY count(*) DESC, term) AS p FROM tc GROUP BY term
  ORDER BY count(*) DESC, term LIMIT 2),
xy AS (SELECT doc_id, coalesce(sum(weight) FILTER (p = 1), 0) AS x, coalesce(sum(weight) FILTER (p = 2), 0) AS y
       FROM tfidf JOIN two USING (term) GROUP BY doc_id),
gram AS (SELECT sum(x * x) AS a, sum(x * y) AS b, sum(y * y) AS d FROM xy),
eig AS (SELECT *, (a + d) / 2 + sqrt(((a - d) / 2) ** 2 + b * b) AS l1, (a + d) / 2 - sqrt(((a - d) / 2) ** 2 + b * b) AS l2 FROM gram),
v1 AS (SELECT b / sqrt(b * b + (l1 - a) ** 2) AS vx, (l1 - a) / sqrt(b * b + (l1 - a) ** 2) AS vy FROM eig),
vec AS (SELECT vx, vy, CASE WHEN vy >= vx THEN vy ELSE -vy END AS ux, CASE WHEN vy >= vx THEN -vx ELSE vx END AS uy FROM v1)"""
TWO = (MESSAGES, TOKENS, COUNTS, TFIDF, TWO_TERMS)


def two_term_model(spark, sf):
    """The components of the two terms that most messages hold, weighted as among all terms."""
    weights = checkpoint(message_tfidf(spark, sf))
    two = weights.groupBy("term").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "term").limit(2)
    return topics.lsa(weights.join(F.broadcast(two.select("term")), "term"), "doc_id", 2)


@query("t9_lsa_two_terms", with_ctes(*TWO) + """
SELECT CAST(0 AS INTEGER) AS component, round(sqrt(l1), 7) AS singular_value FROM eig
UNION ALL SELECT CAST(1 AS INTEGER), round(sqrt(l2), 7) FROM eig""")
def _(spark, sf):
    rows = [(i, round(v, 7)) for i, v in enumerate(two_term_model(spark, sf).singular_values)]
    return spark.createDataFrame(rows, "component int, singular_value double")


@query("o3_two_terms_by_topic", with_ctes(*TWO) + """,
w AS (SELECT 't0' AS topic, p, vx AS weight FROM vec, two WHERE p = 1 UNION ALL SELECT 't0', p, vy FROM vec, two WHERE p = 2
      UNION ALL SELECT 't1', p, ux FROM vec, two WHERE p = 1 UNION ALL SELECT 't1', p, uy FROM vec, two WHERE p = 2)
SELECT topic, CAST(row_number() OVER (PARTITION BY topic ORDER BY weight DESC, term) AS INTEGER) AS position, term, round(weight, 7) AS weight
FROM w JOIN two USING (p)""")
def _(spark, sf):
    return rounded(topics.topic_terms(two_term_model(spark, sf), 7), weight=7)


TWO_TERM_FLAGS = with_ctes(*TWO) + """
SELECT customer_id, count(*) AS num_texts, CAST(sum(CAST(x * vx + y * vy >= 0.1 AS INTEGER)) AS BIGINT) AS topic_0,
       CAST(sum(CAST(x * ux + y * uy >= 0.1 AS INTEGER)) AS BIGINT) AS topic_1
FROM xy JOIN messages USING (doc_id), vec GROUP BY customer_id"""


@query("t11_two_term_flags", TWO_TERM_FLAGS)
def _(spark, sf):
    """Flags of the messages that hold one of the two terms, summed per customer."""
    flagged = topics.flags(two_term_model(spark, sf), "doc_id").join(roles.messages(spark, sf).select("doc_id", "customer_id"), "doc_id")
    return sentiment.customer_features(flagged, "customer_id", {}, (), ("topic_0", "topic_1"))


def features_with_topics(spark, sf, model):
    """Statistics of the scores and sums of the topic flags of each customer, 0 where there are none."""
    flags = topics.flags(model, "doc_id")
    names = [c for c in flags.columns if c != "doc_id"]
    scores = scored_messages(spark, sf).withColumn("length", F.col("length").cast("double")).join(flags, "doc_id", "left").fillna(0, subset=names)
    cols = {"polarity": "pol", "sentiment": "sent", "subjectivity": "sub", "length": "len"}
    features = sentiment.customer_features(scores, "customer_id", cols, STATS, names)
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("customer_id"))
    out = sentiment.attach_features(customers, features, "customer_id")
    return rounded(out, **{f"{c}_{s}": 11 for c in cols.values() for s in ("min", "mean", "max", "med")})


@query("t16_features_with_topic_sums")
def _(spark, sf):
    return features_with_topics(spark, sf, topics.lsa(message_tfidf(spark, sf), "doc_id", 30))


@query("t16_features_with_two_term_sums", f"""
SELECT t.*, coalesce(topic_0, 0) AS topic_0, coalesce(topic_1, 0) AS topic_1
FROM ({ORACLES['t16_customer_text_features']}) t LEFT JOIN ({TWO_TERM_FLAGS}) f USING (customer_id)""")
def _(spark, sf):
    return features_with_topics(spark, sf, two_term_model(spark, sf))


@query("t12_lda_topics")
def _(spark, sf):
    return topics.lda(message_counts(spark, sf), "doc_id", 10, 10)


@query("t12_lda_topics_rare_words")
def _(spark, sf):
    """Topics of the words found in one message only, as the term matrix with max_df=1 has them."""
    return topics.lda(texts.only_hapax(message_counts(spark, sf)), "doc_id", 10, 5)


@query("t12_lda_topics_nouns_adjectives")
def _(spark, sf):
    """Topics of nouns and adjectives only, told by their endings."""
    tokens = message_tokens(spark, sf)
    nouns = texts.keep_pos(tokens, part_of_speech(tokens))
    return topics.lda(texts.term_counts(nouns, "doc_id"), "doc_id", 10, 10)


@query("m1_stratified_split", with_ctes(TRIPS) + """
SELECT orderkey, retained, rn <= ceil(0.75 * n) AS is_train FROM (
  SELECT orderkey, retained, count(*) OVER (PARTITION BY retained) AS n,
         row_number() OVER (PARTITION BY retained ORDER BY md5(orderkey || '|2020'), orderkey) AS rn FROM trips)""")
def _(spark, sf):
    return prep.stratified_split(roles.trips(spark, sf).select("orderkey", "retained"), "retained", "orderkey")


def gappy_finance(spark, sf):
    key = F.col("orderkey")
    return roles.finance(spark, sf).select(
        "orderkey", F.when(key % 7 != 0, F.col("revenue")).alias("revenue"),
        F.when(key % 11 != 0, F.col("pax")).alias("pax"), F.when(key % 13 != 0, F.col("discount")).alias("discount"),
        F.col("n_lines").cast("double").alias("n_lines"))


@query("m2_pca_imputation")
def _(spark, sf):
    """Gaps filled for new trips with what was learned on the training part."""
    finance = prep.stratified_split(gappy_finance(spark, sf).withColumn("one", F.lit(1)), "one", "orderkey").drop("one")
    model = prep.PcaImputer(["revenue", "pax", "discount", "n_lines"]).fit(finance.filter("is_train"), "orderkey")
    return model.transform(finance)


@query("m2_mean_imputation", with_ctes(FINANCE) + """,
g AS (SELECT orderkey, CASE WHEN orderkey % 7 <> 0 THEN revenue END AS revenue, CASE WHEN orderkey % 11 <> 0 THEN pax END AS pax FROM finance),
tr AS (SELECT * FROM g WHERE orderkey % 4 <> 0)
SELECT orderkey, round(coalesce(revenue, (SELECT avg(revenue) FROM tr)), 6) AS revenue, round(coalesce(pax, (SELECT avg(pax) FROM tr)), 6) AS pax FROM g""")
def _(spark, sf):
    """Without components the gaps take the training means."""
    finance = gappy_finance(spark, sf).select("orderkey", "revenue", "pax")
    model = prep.PcaImputer(["revenue", "pax"], rank=0).fit(finance.filter("orderkey % 4 <> 0"), "orderkey")
    return rounded(model.transform(finance), revenue=6, pax=6)


@query("m3_text_gaps_to_other", with_ctes(FINANCE) + """
SELECT id_finance, coalesce(special_pay, 'other') AS special_pay FROM finance""")
def _(spark, sf):
    return roles.finance(spark, sf).select("id_finance", "special_pay").fillna("other")


SPLIT = """split AS (SELECT *, orderkey % 4 <> 0 AS is_train FROM trips)"""


def split_trips(spark, sf):
    trips = roles.trips(spark, sf)
    return trips.filter("orderkey % 4 <> 0"), trips.filter("orderkey % 4 = 0")


@query("m4_scale_by_train_sd", with_ctes(TRIPS, SPLIT) + """
SELECT orderkey, round(price / (SELECT stddev_samp(price) FROM split WHERE is_train), 9) AS price,
       round(program / (SELECT stddev_samp(program) FROM split WHERE is_train), 9) AS program
FROM split WHERE NOT is_train""")
def _(spark, sf):
    train, test = split_trips(spark, sf)
    out = prep.scale(test.select("orderkey", "price", "program"), train, ["price", "program"], center=False, ddof=1)
    return rounded(out, price=9, program=9)


@query("m5_standardise", with_ctes(TRIPS, SPLIT) + """
SELECT orderkey, round((price - (SELECT avg(price) FROM split WHERE is_train))
                       / (SELECT stddev_pop(price) FROM split WHERE is_train), 9) AS price
FROM split WHERE NOT is_train""")
def _(spark, sf):
    train, test = split_trips(spark, sf)
    out = prep.scale(test.select("orderkey", "price"), train, ["price"], center=True, ddof=0)
    return rounded(out, price=9)


@query("m6_one_hot", with_ctes(TRIPS, SPLIT) + """
SELECT orderkey, """ + ", ".join(
    f"CAST(travel_type = '{t}' AS DOUBLE) AS travel_{t}" for t in "FOP") + " FROM split WHERE NOT is_train")
def _(spark, sf):
    """Indicators fitted on the training part, the columns named after the levels."""
    train, test = split_trips(spark, sf)
    model = prep.one_hot(["travel_type"]).fit(train.select("travel_type"))
    names = model.stages[0].labelsArray[0]
    encoded = model.transform(test.select("orderkey", "travel_type"))
    slots = vector_to_array("travel_type_vec")
    return encoded.select("orderkey", *[slots[i].alias(f"travel_{n}") for i, n in enumerate(names)])


@query("m7_feature_list", "\nUNION ALL ".join(
    f"SELECT '{c}' AS feature, count(DISTINCT {c}) AS n_distinct FROM (WITH {TRIPS} SELECT * FROM trips)"
    for c in ("departure_date", "price", "program", "travel_type")))
def _(spark, sf):
    """Feature columns without keys and target, with their number of values."""
    trips = roles.trips(spark, sf)
    names = prep.feature_names(trips, ("orderkey", "custkey", "retained"))
    return profile.distinct_counts(trips, names).withColumnRenamed("column", "feature")


@query("m8_shared_features", with_ctes(TRIPS, SPLIT) + """,
tr AS (SELECT * FROM split WHERE is_train), te AS (SELECT * FROM split WHERE NOT is_train)
SELECT 'travel_type' AS "column", count(*) = 0 AS usable FROM (SELECT travel_type FROM tr EXCEPT SELECT travel_type FROM te)
UNION ALL SELECT 'departure_date', count(*) = 0 FROM (SELECT departure_date FROM tr EXCEPT SELECT departure_date FROM te)
UNION ALL SELECT 'price', (SELECT (min(price), max(price)) FROM tr) = (SELECT (min(price), max(price)) FROM te)
UNION ALL SELECT 'program', (SELECT (min(program), max(program)) FROM tr) = (SELECT (min(program), max(program)) FROM te)""")
def _(spark, sf):
    train, test = split_trips(spark, sf)
    return prep.shared_features(train, test, ["travel_type", "departure_date", "price", "program"])


# ---------------------------------------------------------------- level groups


@query("e6_lump_rare_levels", with_ctes(CRM) + """,
c AS (SELECT nation AS level, count(*) AS n FROM crm GROUP BY 1)
SELECT level, CASE WHEN n < round((SELECT sum(n) FROM c) * 0.04) THEN 'other' ELSE level END AS "group" FROM c""")
def _(spark, sf):
    return levels.lump_rare_levels(roles.crm(spark, sf), "nation", 0.04)


@query("e6_group_levels")
def _(spark, sf):
    """Nations with alike retention pooled, number of groups chosen by silhouette."""
    joined = roles.trips(spark, sf).join(roles.crm(spark, sf).select("custkey", "nation"), "custkey")
    return levels.LevelGrouper("nation", "retained", threshold=0.05).fit(joined)


@query("e7_cluster_scores")
def _(spark, sf):
    joined = roles.trips(spark, sf).join(roles.crm(spark, sf).select("custkey", "nation"), "custkey")
    grouper = levels.LevelGrouper("nation", "retained")
    return spark.createDataFrame(grouper.scores(checkpoint(grouper.level_table(joined))), "k int, silhouette double")


GIVEN_CENTRES = {2: [(-0.5, 0.5), (0.5, -0.5)], 3: [(-1.0, -0.3), (0.1, 0.6), (1.0, 0.2)],
                 4: [(-0.9, -0.4), (-0.2, 0.8), (0.3, -0.6), (1.1, 0.4)]}


@query("e7_silhouettes_of_given_centres", with_ctes(TRIPS, CRM) + f""",
c AS (SELECT nation AS level, count(*) AS n, avg(CAST(retained AS DOUBLE)) AS rate FROM trips JOIN crm USING (custkey) GROUP BY 1),
p AS (SELECT level, CAST(n AS DOUBLE) AS w, (rate - avg(rate) OVER ()) / stddev_samp(rate) OVER () AS x,
             (ln(n) - avg(ln(n)) OVER ()) / stddev_samp(ln(n)) OVER () AS y FROM c),
g AS (SELECT * FROM (VALUES {", ".join(f"({k}, {i}, {x}, {y})" for k, v in GIVEN_CENTRES.items() for i, (x, y) in enumerate(v))}) v(k, i, cx, cy)),
a AS (SELECT k, level, w, x, y, arg_min(i, (x - cx) ** 2 + (y - cy) ** 2) AS cluster FROM p, g GROUP BY 1, 2, 3, 4, 5),
d AS (SELECT a.k, a.level, a.w, a.cluster AS own, b.cluster AS other, sum(b.w * ((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) AS far, sum(b.w) AS mass
      FROM a JOIN a AS b ON a.k = b.k GROUP BY 1, 2, 3, 4, 5),
s AS (SELECT k, level, w, max(CASE WHEN own = other THEN mass END) AS own_mass,
             max(CASE WHEN own = other AND mass > w THEN far / (mass - w) END) AS inside, min(CASE WHEN own <> other THEN far / mass END) AS outside
      FROM d GROUP BY 1, 2, 3)
SELECT CAST(k AS INTEGER) AS k, round(sum(CASE WHEN own_mass > w THEN w * (outside - inside) / greatest(outside, inside) ELSE 0 END) / sum(w), 6) AS silhouette
FROM s GROUP BY 1""")
def _(spark, sf):
    """Nations dealt to fixed centres and judged as the numbers of groups are."""
    joined = roles.trips(spark, sf).join(roles.crm(spark, sf).select("custkey", "nation"), "custkey")
    table = checkpoint(levels.LevelGrouper("nation", "retained").level_table(joined))
    found = silhouettes(table, {k: np.array(v) for k, v in GIVEN_CENTRES.items()})
    return spark.createDataFrame([(k, round(s, 6)) for k, s in found], "k int, silhouette double")


@query("e8_apply_learned_groups", with_ctes(TRIPS, SPLIT) + """,
c AS (SELECT CAST(month(departure_date) AS VARCHAR) AS level, count(*) AS n FROM split WHERE is_train AND travel_type = 'F'
      AND month(departure_date) < 12 GROUP BY 1),
m AS (SELECT level, CASE WHEN n < round((SELECT sum(n) FROM c) * 0.09) THEN 'other' ELSE level END AS grp FROM c)
SELECT orderkey, CAST(month(departure_date) AS VARCHAR) AS month, coalesce(grp, 'other') AS month_bis
FROM split LEFT JOIN m ON level = CAST(month(departure_date) AS VARCHAR) WHERE NOT is_train""")
def _(spark, sf):
    """Groups learned on part of the training rows; December is unknown to them."""
    train, test = (d.withColumn("month", F.month("departure_date").cast("string")) for d in split_trips(spark, sf))
    mapping = levels.lump_rare_levels(train.filter("travel_type = 'F' and month <> '12'"), "month", 0.09)
    return levels.apply_groups(test, "month", mapping, replace=False).select("orderkey", "month", "month_bis")
