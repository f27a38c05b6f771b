"""Queries: text cleaning, words, sentiment and text features."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from churnlake.functions import text
from churnlake.operators import sentiment, texts
from churnlake.plans import roles
from churnlake.plans.registry import query
from churnlake.plans.roles import MESSAGES, rounded, table, with_ctes
from churnlake.session import checkpoint, shared_folder
from churnlake.streaming import live

# Frequent words of the invented texts; text.stop_words() gives the full English list.
STOP = ("the of and to in is that it for was on as be with by this are from an at "
        "de la que en el der die und le les des don't").split()
STOP_SQL = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in STOP) + "]"


def sub_sql(e: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({e}, '{pattern.replace(chr(39), chr(39) * 2)}', '{to}', 'g')"


def tweet_sql(e: str) -> str:
    e = sub_sql(f"replace({e}, chr(10), '')", text.MENTION, " ")
    e = sub_sql(f"replace({e}, '#', '')", text.LINK)
    return f"trim({sub_sql(e, ' +', ' ')})"


def words_sql(e: str, steps=(text.BRACKETS, text.PUNCTUATION, text.WORDS_WITH_DIGITS, text.QUOTES)) -> str:
    e = f"lower({e})"
    for pattern in steps:
        e = sub_sql(e, pattern)
    return f"replace({e}, chr(10), ' ')"


def tokens_sql(e: str, **kw) -> str:
    return f"""list_filter(list_transform(list_filter(string_split_regex({words_sql(e, **kw)}, '\\s+'),
      lambda w: length(w) > 1 AND NOT list_contains({STOP_SQL}, w)),
      lambda w: regexp_replace(w, '[^a-z]+', '', 'g')), lambda w: length(w) > 1)"""


TOKENS = f"""tok AS (SELECT doc_id, unnest(t) AS token, generate_subscripts(t, 1) - 1 AS position
  FROM (SELECT doc_id, {tokens_sql('text')} AS t FROM messages))"""
COUNTS = "tc AS (SELECT doc_id, token AS term, count(*) AS tf FROM tok GROUP BY ALL)"


def message_tokens(spark, sf):
    return texts.explode_tokens(roles.messages(spark, sf), "doc_id", text.tokens(F.col("text"), STOP))


def message_counts(spark, sf):
    return texts.term_counts(message_tokens(spark, sf), "doc_id")


@query("t1_clean_tweet", f"SELECT doc_id, {tweet_sql('text')} AS text FROM documents")
def _(spark, sf):
    return roles.documents(spark, sf).select("doc_id", text.clean_tweet(F.col("text")).alias("text"))


@query("t2_clean_text", f"SELECT doc_id, array_to_string({tokens_sql('text')}, ' ') AS words FROM documents")
def _(spark, sf):
    return roles.documents(spark, sf).select(
        "doc_id", F.array_join(text.tokens(F.col("text"), STOP), " ").alias("words"))


@query("t2b_clean_text_other_order", "SELECT doc_id, array_to_string(" + tokens_sql(
    "text", steps=(text.PUNCTUATION, text.QUOTES, text.WORDS_WITH_DIGITS, text.BRACKETS)) + ", ' ') AS words FROM documents")
def _(spark, sf):
    return roles.documents(spark, sf).select("doc_id", F.array_join(
        text.tokens(F.col("text"), STOP, order="punctuation_first"), " ").alias("words"))


@query("t3_stop_words", f"""
SELECT token, count(*) AS n FROM (SELECT unnest(string_split_regex({words_sql('text')}, '\\s+')) AS token FROM documents)
WHERE list_contains({STOP_SQL}, token) GROUP BY token""")
def _(spark, sf):
    """How often each stop word occurs in the texts it would be removed from."""
    words = roles.documents(spark, sf).select(F.explode(F.split(text.clean_words(F.col("text")), r"\s+")).alias("token"))
    return words.filter(F.col("token").isin(*STOP)).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


LEMMAS = """lemmas AS (SELECT DISTINCT token, regexp_replace(token, '(ing|ed|s)$', '') AS lemma FROM tok
  WHERE regexp_matches(token, '..(ing|ed|s)$'))"""


def lemma_table(tokens):
    """Base forms by ending, for the words the texts contain."""
    return tokens.select("token").distinct().filter(F.col("token").rlike("..(ing|ed|s)$")).select(
        "token", F.regexp_replace("token", "(ing|ed|s)$", "").alias("lemma"))


@query("t4_lemmatise", with_ctes(MESSAGES, TOKENS, LEMMAS) + """
SELECT doc_id, coalesce(lemma, token) AS token, count(*) AS n FROM tok LEFT JOIN lemmas USING (token) GROUP BY ALL""")
def _(spark, sf):
    tokens = message_tokens(spark, sf)
    out = texts.lemmatise(tokens, lemma_table(tokens))
    return out.groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("n"))


def part_of_speech(tokens):
    """Tags by ending, for the words the texts contain."""
    ending = F.col("token")
    return tokens.select("token").distinct().withColumn(
        "pos", F.when(ending.rlike("(tion|er)$"), "NNS").when(ending.rlike("(y|able)$"), "JJ").otherwise("VB"))


@query("t5_keep_parts_of_speech", with_ctes(MESSAGES, TOKENS) + """
SELECT doc_id, token, CAST(position AS INTEGER) AS position FROM tok
WHERE regexp_matches(token, '(tion|er|y|able)$')""")
def _(spark, sf):
    tokens = message_tokens(spark, sf)
    return texts.keep_pos(tokens, part_of_speech(tokens))


@query("t6_document_term_counts", with_ctes(MESSAGES, TOKENS, COUNTS) + "SELECT * FROM tc")
def _(spark, sf):
    return message_counts(spark, sf)


@query("t7_terms_in_one_document", with_ctes(MESSAGES, TOKENS, COUNTS) + """
SELECT term FROM tc GROUP BY term HAVING count(*) = 1""")
def _(spark, sf):
    return texts.hapax(message_counts(spark, sf))


TFIDF = """raw AS (SELECT doc_id, term, tf * (ln((1 + (SELECT count(*) FROM messages)) / (1 + df)) + 1) AS w
  FROM tc JOIN (SELECT term, count(*) AS df FROM tc GROUP BY 1) USING (term)),
tfidf AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM raw)"""


def message_tfidf(spark, sf):
    n_docs = table(spark, sf, "conversations").select(F.count(F.lit(1))).scalar()
    return texts.tfidf(message_counts(spark, sf), "doc_id", n_docs)


@query("t8_tfidf", with_ctes(MESSAGES, TOKENS, COUNTS, TFIDF) + """
SELECT doc_id, term, round(weight, 9) AS weight FROM tfidf""")
def _(spark, sf):
    return rounded(message_tfidf(spark, sf), weight=9)


@query("u7_term_document_view", with_ctes(MESSAGES, TOKENS, COUNTS) + """
SELECT term, count(*) AS n_docs, CAST(sum(tf) AS BIGINT) AS n, max(tf) AS max_tf FROM tc GROUP BY term""")
def _(spark, sf):
    return texts.by_term(message_counts(spark, sf), "doc_id")


@query("t18_top_words", with_ctes(MESSAGES, TOKENS) + """
SELECT token AS term, count(*) AS n FROM tok GROUP BY 1 ORDER BY n DESC, term LIMIT 50""")
def _(spark, sf):
    return texts.top_terms(message_tokens(spark, sf), 50)


# ---------------------------------------------------------------- sentiment

# Frequent words of the invented texts stand in for the English modifiers.
BOOSTERS = {"the": 0.293, "la": 0.293, "of": -0.293}
NEGATIONS = ("to", "de", "die")
INTENSIFIERS = {"the": 1.3, "of": 0.7}
CONTRAST = "and"

BARE = """words AS (SELECT *, list_transform(raw, lambda w: lower(w)) AS ws FROM (
  SELECT doc_id, text, list_transform(list_filter(string_split_regex({source}, '\\s+'), lambda w: w <> ''),
    lambda w: regexp_replace(w, '^[\\p{{P}}\\p{{S}}]+|[\\p{{P}}\\p{{S}}]+$', '', 'g')) AS raw FROM messages))"""
WORDS = BARE.format(source="text")
LEXICON = """lexicon AS (SELECT DISTINCT token, CAST(length(token) % 7 - 3 AS DOUBLE) AS valence,
    (length(token) % 9 - 4) / 4.0::DOUBLE AS polarity, (length(token) % 5) / 4.0::DOUBLE AS subjectivity
  FROM (SELECT unnest(ws) AS token FROM words) WHERE length(token) % 3 <> 1)"""
EACH = """each AS (SELECT *, raw[i] AS shout, ws[i] AS token, CASE WHEN i > 1 THEN ws[i - 1] END AS w1,
    CASE WHEN i > 2 THEN ws[i - 2] END AS w2, CASE WHEN i > 3 THEN ws[i - 3] END AS w3
  FROM (SELECT *, unnest(CASE WHEN len(ws) = 0 THEN [0] ELSE range(1, len(ws) + 1) END) AS i FROM words))"""


def lexicon(spark, sf):
    """A deterministic lexicon over the words the messages contain."""
    words = F.transform(sentiment.bare_words(F.col("text")), F.lower)
    n = F.length("token")
    return roles.messages(spark, sf).select(F.explode(words).alias("token")).distinct().filter(n % 3 != 1).select(
        "token", (n % 7 - 3).cast("double").alias("valence"), ((n % 9 - 4) / 4.0).alias("polarity"),
        ((n % 5) / 4.0).alias("subjectivity"))


def _case(word, mapping, default):
    return "CASE " + word + "".join(f" WHEN '{k}' THEN {v}::DOUBLE" for k, v in mapping.items()) + f" ELSE {default}::DOUBLE END"


def _in(word, members):
    return f"coalesce({word} IN (" + ", ".join(f"'{m}'" for m in members) + "), false)"


NOT_MODIFIER = "token NOT IN (" + ", ".join(f"'{w}'" for w in [*BOOSTERS, *NEGATIONS]) + ")"
VALENCE = f"""hits AS (
  SELECT doc_id, (valence + sign(valence) * ({' + '.join(f"{_case(w, BOOSTERS, 0)} * {d}::DOUBLE" for w, d in (('w1', 1.0), ('w2', 0.95), ('w3', 0.9)))}
      + CASE WHEN shout = upper(shout) AND shout <> lower(shout) AND length(shout) > 1
                  AND len(list_filter(raw, lambda w: w <> upper(w))) > 0 THEN 0.733::DOUBLE ELSE 0 END))
    * {' * '.join(f"CASE WHEN {_in(w, NEGATIONS)} THEN -0.74::DOUBLE ELSE 1 END" for w in ('w1', 'w2', 'w3'))}
    * CASE WHEN list_position(ws, '{CONTRAST}') IS NULL OR list_position(ws, '{CONTRAST}') = 0 THEN 1.0::DOUBLE
           WHEN i < list_position(ws, '{CONTRAST}') THEN 0.5 WHEN i > list_position(ws, '{CONTRAST}') THEN 1.5 ELSE 1 END AS s
  FROM each LEFT JOIN (SELECT * FROM lexicon WHERE {NOT_MODIFIER}) USING (token)),
sums AS (SELECT doc_id, round(coalesce(sum(s), 0), 9) AS s FROM hits GROUP BY 1),
marks AS (SELECT doc_id, least(length(text) - length(replace(text, '!', '')), 4) * 0.292::DOUBLE AS e,
                 length(text) - length(replace(text, '?', '')) AS q FROM messages),
tot AS (SELECT doc_id, s + sign(s) * (e + CASE WHEN q <= 1 THEN 0 WHEN q <= 3 THEN q * 0.18::DOUBLE ELSE 0.96 END) AS t
        FROM sums JOIN marks USING (doc_id)),
sentiment AS (SELECT doc_id, t / sqrt(t * t + 15) AS sentiment FROM tot)"""


def message_valence(spark, sf, messages=None):
    messages = messages if messages is not None else roles.messages(spark, sf)
    return sentiment.valence(messages, "doc_id", "text", lexicon(spark, sf), BOOSTERS, NEGATIONS, CONTRAST)


@query("t13_valence", with_ctes(MESSAGES, WORDS, LEXICON, EACH, VALENCE) + """
SELECT doc_id, round(sentiment, 7) AS sentiment FROM sentiment""")
def _(spark, sf):
    return rounded(message_valence(spark, sf), sentiment=7)


NOT_POLARITY_MODIFIER = "token NOT IN (" + ", ".join(f"'{w}'" for w in [*INTENSIFIERS, *NEGATIONS]) + ")"
POLARITY = f"""pol AS (
  SELECT doc_id, coalesce(avg(least(greatest(polarity * {_case('w1', INTENSIFIERS, 1)}, -1), 1)
      * CASE WHEN {_in(f"CASE WHEN {_in('w1', INTENSIFIERS)} THEN w2 ELSE w1 END", NEGATIONS)} THEN -0.5::DOUBLE ELSE 1 END)
      FILTER (polarity IS NOT NULL), 0) AS polarity,
    coalesce(avg(least(greatest(subjectivity * {_case('w1', INTENSIFIERS, 1)}, 0), 1)) FILTER (polarity IS NOT NULL), 0) AS subjectivity
  FROM each LEFT JOIN (SELECT * FROM lexicon WHERE {NOT_POLARITY_MODIFIER}) USING (token) GROUP BY doc_id)"""


def message_polarity(spark, sf):
    return sentiment.polarity_subjectivity(
        roles.messages(spark, sf), "doc_id", "text", lexicon(spark, sf), INTENSIFIERS, NEGATIONS)


@query("t14_polarity_subjectivity", with_ctes(MESSAGES, WORDS, LEXICON, EACH, POLARITY) + """
SELECT doc_id, round(polarity, 12) AS polarity, round(subjectivity, 12) AS subjectivity FROM pol""")
def _(spark, sf):
    return rounded(message_polarity(spark, sf), polarity=12, subjectivity=12)


DOC_TOKENS = f"""dtok AS (SELECT DISTINCT doc_id, unnest({tokens_sql('text')}) AS token FROM documents)"""


@query("t15_naive_bayes_positive", with_ctes(DOC_TOKENS) + """,
lab AS (SELECT doc_id, token, quality FROM dtok JOIN labels USING (doc_id)),
sz AS (SELECT sum(quality) AS pos, sum(1 - quality) AS neg FROM (SELECT DISTINCT doc_id, quality FROM lab)),
odds AS (SELECT token, ln((sum(quality) + 1) / (any_value(pos) + 2)) - ln((sum(1 - quality) + 1) / (any_value(neg) + 2)) AS lo
         FROM lab, sz GROUP BY token)
SELECT doc_id, round(1 / (1 + exp(-coalesce(sum(lo), 0))), 6) AS p_pos FROM documents LEFT JOIN dtok USING (doc_id) LEFT JOIN odds USING (token) GROUP BY doc_id""")
def _(spark, sf):
    """Word odds learned from the labelled texts, applied to all texts."""
    documents = roles.documents(spark, sf)
    words, once = sentiment.distinct_words(documents, "doc_id", text.tokens(F.col("text"), STOP))
    labelled = words.join(table(spark, sf, "labels").select("doc_id", "quality").distinct(), "doc_id")
    odds = sentiment.nb_log_odds(labelled.select("doc_id", "quality", F.explode("words").alias("token")), "doc_id", "quality", once)
    return rounded(sentiment.nb_positive(texts.explode_tokens(words, "doc_id", F.col("words")), "doc_id", odds, docs=documents, once=once), p_pos=6)


STATS = ("min", "mean", "max", "median")


def scored_messages(spark, sf):
    """All scores of every message, written out once as several features read them."""
    return checkpoint(
        roles.messages(spark, sf).select("doc_id", "customer_id", F.char_length("text").alias("length"))
        .join(message_valence(spark, sf), "doc_id").join(message_polarity(spark, sf), "doc_id"))


@query("t16_customer_text_features", with_ctes(MESSAGES, WORDS, LEXICON, EACH, VALENCE, POLARITY) + """,
sm AS (SELECT doc_id, customer_id, length(text) AS length, sentiment, polarity, subjectivity
       FROM messages JOIN sentiment USING (doc_id) JOIN pol USING (doc_id)),
feat AS (SELECT customer_id, count(*) AS num_texts, """ + ", ".join(
    f"round(CAST({f}({c}) AS DOUBLE), 11) AS {s}_{n}" for c, s in
    (("polarity", "pol"), ("sentiment", "sent"), ("subjectivity", "sub"), ("length", "len"))
    for f, n in (("min", "min"), ("avg", "mean"), ("max", "max"), ("median", "med"))) + """
  FROM sm GROUP BY 1)
SELECT c_custkey AS customer_id, coalesce(num_texts, 0) AS num_texts, """ + ", ".join(
    f"coalesce({s}_{n}, 0) AS {s}_{n}" for s in ("pol", "sent", "sub", "len") for n in ("min", "mean", "max", "med")) + """
FROM customer LEFT JOIN feat ON customer_id = c_custkey""")
def _(spark, sf):
    """Statistics of all scores per customer; customers without texts get 0."""
    scores = scored_messages(spark, sf).withColumn("length", F.col("length").cast("double"))
    names = {"polarity": "pol", "sentiment": "sent", "subjectivity": "sub", "length": "len"}
    features = sentiment.customer_features(scores, "customer_id", names, STATS)
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("customer_id"))
    out = sentiment.attach_features(customers, features, "customer_id")
    return rounded(out, **{c: 11 for c in out.columns if "_" in c and c not in ("customer_id", "num_texts")})


@query("t17_polarity_classes", with_ctes(MESSAGES, WORDS, LEXICON, EACH, POLARITY) + """
SELECT CASE WHEN p >= 0.1 THEN 'very positive' WHEN p >= 0 THEN 'positive'
            WHEN p >= -0.1 THEN 'negative' ELSE 'very negative' END AS class, count(*) AS n
FROM (SELECT round(polarity, 12) AS p FROM pol) GROUP BY 1""")
def _(spark, sf):
    scores = rounded(message_polarity(spark, sf), polarity=12)
    return scores.groupBy(sentiment.polarity_class(F.col("polarity"), 0.1).alias("class")).agg(F.count(F.lit(1)).alias("n"))


CLEANED = f"messages2 AS (SELECT doc_id, {tweet_sql('text')} AS text FROM messages)"


def second(sql: str) -> str:
    """The same steps on the cleaned messages; the lexicon stays that of the raw ones."""
    for name in ("messages", "words", "each", "hits", "sums", "marks", "tot", "sentiment"):
        sql = re.sub(rf"\b{name}(?= AS \()|(?<=FROM ){name}\b|(?<=JOIN ){name}\b", f"{name}2", sql)
    return sql


SECOND = ",\n".join([CLEANED, second(WORDS), second(EACH), second(VALENCE)])


@query("t19_raw_against_cleaned", with_ctes(MESSAGES, WORDS, LEXICON, EACH, VALENCE, SECOND) + """
SELECT doc_id, round(a.sentiment, 7) AS sentiment_a, round(b.sentiment, 7) AS sentiment_b
FROM sentiment a JOIN sentiment2 b USING (doc_id) WHERE abs(a.sentiment - b.sentiment) > 1e-9""")
def _(spark, sf):
    """Messages whose score changes when the text is cleaned first."""
    cleaned = roles.messages(spark, sf).withColumn("text", text.clean_tweet(F.col("text")))
    out = sentiment.differing(message_valence(spark, sf), message_valence(spark, sf, cleaned), "doc_id", "sentiment", 1e-9)
    return rounded(out, sentiment_a=7, sentiment_b=7)


@query("d6_live_sentiment", with_ctes(MESSAGES, WORDS, LEXICON, SECOND) + """
SELECT doc_id, round(sentiment, 7) AS sentiment FROM sentiment2""")
def _(spark, sf):
    """The stored messages arrive as a stream; each batch is cleaned, scored and written."""
    folder = shared_folder(spark, "live-sentiment")
    schema = table(spark, sf, "conversations").schema
    # As a pattern the path may be one file or a folder of files; a plain one must be a folder.
    stream = spark.readStream.schema(schema).parquet(f"{sf}/conversations.parque[t]").select(
        F.concat_ws("-", "conv_id", "turn").alias("doc_id"), "text")
    words = checkpoint(lexicon(spark, sf))
    job = live.score_messages(stream, "doc_id", "text", words, f"{folder}/out", f"{folder}/state",
                              boosters=BOOSTERS, negations=NEGATIONS, contrast=CONTRAST)
    job.awaitTermination()
    return rounded(spark.read.parquet(f"{folder}/out").select("doc_id", "sentiment"), sentiment=7)
