"""Small hand-made cases."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from churnlake.functions import clean, text
from churnlake.operators import decide, evaluate, joins, keys, levels, prep, profile, sentiment, texts
from churnlake.sources import lookups, tables


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_composite_keys(spark):
    df = frame(spark, [("HD1076A", "HD", "A"), ("HD12110", "HD", "A")], "id string, p string, t string")
    got = keys.split_composite(df, "id", "p", "t").collect()
    assert [(r.id_actual, r.prefix_ok, r.suffix_ok) for r in got] == [("1076", True, True), ("1211", True, False)]
    guarded = keys.split_composite(df, "id", "p", "t", guarded=True).collect()
    assert [r.id_actual for r in guarded] == ["1076", "12110"]


def test_finance_keys(spark):
    df = frame(spark, [("1389", "0"), ("NA1389", None), ("FR1389", "FR")], "id string, pay string")
    got = keys.split_composite(df, "id", "pay", empty_prefix=("0",), null_prefix="NA")
    assert {r.id_actual for r in got.collect()} == {"1389"}


def test_key_frequency_tells_uniqueness(spark):
    df = frame(spark, [("a",), ("b",), ("b",)], "k string")
    assert {(r.n, r.n_keys) for r in keys.key_frequency(df, "k").collect()} == {(1, 1), (2, 1)}


def test_seasons(spark):
    days = ["2020-12-30", "2021-04-12", "2020-12-14", "2020-12-15", "2021-03-14", "2021-03-15", "2021-06-15",
            "2021-09-15", "2020-02-29", None]
    df = frame(spark, [(d and dt.date.fromisoformat(d),) for d in days], "d date")
    assert [r[0] for r in df.select(clean.season(F.col("d"))).collect()] == [
        "Winter", "Spring", "Fall", "Winter", "Winter", "Spring", "Summer", "Fall", "Winter", None]


def test_min_max_scale(spark):
    df = frame(spark, [(float(v),) for v in (1, 5, 20, 16, 18, 5, 9)], "x double")
    got = [r.x for r in clean.min_max_scale(df, "x").collect()]
    assert got == [0, 0.2105, 1, 0.7895, 0.8947, 0.2105, 0.4211]
    gap = df.union(frame(spark, [(None,)], "x double"))
    assert all(r.x is None for r in clean.min_max_scale(gap, "x").collect())


def test_parsing(spark):
    df = frame(spark, [("0,25", "1/5/2011"), ("x", "13/45/2011"), (None, None)], "n string, d string")
    got = df.select(clean.parse_number(F.col("n")), clean.parse_date(F.col("d"))).collect()
    assert [tuple(r) for r in got] == [(0.25, dt.date(2011, 1, 5)), (None, None), (None, None)]


def test_grades_and_membership(spark):
    df = frame(spark, [("PK",), ("K",), ("7",), (None,)], "g string")
    assert [r[0] for r in df.select(clean.grade_number(F.col("g"))).collect()] == [-1.0, 0.0, 7.0, None]
    member = df.select(clean.is_member(F.col("g"), ["K"]), clean.is_member(F.col("g"), ["K"], True)).collect()
    assert [tuple(r) for r in member] == [(False, False), (True, True), (False, False), (False, True)]


def test_pick_columns(spark):
    df = frame(spark, [(1.0, "a", 2)], "pol_med double, name string, Total_Pax int")
    assert clean.pick_columns(df, suffix="_med") == ["pol_med"]
    assert clean.pick_columns(df, contains="PAX") == ["Total_Pax"]
    assert clean.pick_columns(df, prefix="NA") == ["name"]
    assert clean.pick_columns(df, kind="numeric") == ["pol_med", "Total_Pax"]


def test_null_keys_match_only_when_asked(spark):
    a = frame(spark, [(None, 1)], "k string, x int")
    b = frame(spark, [(None, 2)], "k2 string, y int")
    assert joins.left_on(a, b, "k", "k2").first().y is None
    assert joins.left_on(a, b, "k", "k2", null_safe=True).first().y == 2


def test_profile_levels(spark):
    df = frame(spark, [(v,) for v in ["a", "a", "a", "b", "b", "c", None, None]], "v string")
    got = {r.level: r.share for r in profile.levels(df, ["v"], 3).collect()}
    assert got == {"NA": 0.25, "a": 0.375, "b": 0.25, "Rest": 0.3333, "RestCount": 1.0}


def test_na_substring_quirk(spark):
    df = frame(spark, [("International",), ("other",)], "v string")
    kept = {r.level: r.share for r in profile.levels(df, ["v"], 3).collect()}
    assert kept["International"] == 0.5 and kept["NA"] == 0
    lost = {r.level: r.share for r in profile.levels(df, ["v"], 3, na_substring=True).collect()}
    assert "International" not in lost and lost["NA"] == 0.5


def test_target_by_level(spark):
    df = frame(spark, [("a", 1), ("a", 1), ("a", 0), ("b", 0)], "g string, y int")
    got = {r.level: (r.expo, r.tot, round(r.ave, 4)) for r in profile.target_by_level(df, "g", "y").collect()}
    assert got == {"a": (3, 2, 0.6667), "b": (1, 0, 0.0)}


def test_auto_bin_pools_small_levels(spark):
    rows = [("big", 1)] * 60 + [("big", 0)] * 39 + [("tiny", 1)]
    df = frame(spark, rows, "g string, y int")
    table = profile.target_by_level(df, "g", "y")
    got = {r.level: r.expo for r in profile.auto_bin(table, profile.portfolio(df, "y")).collect()}
    assert got == {"other": 100}


def test_breaks_exclude_the_lower_edge(spark):
    df = frame(spark, [(float(i),) for i in range(11)], "x double")
    got = [r[0] for r in df.orderBy("x").select(profile.break_bin(F.col("x"), [0, 5, 10])).collect()]
    assert got == [None] + [1] * 5 + [2] * 5


def test_lumping_threshold(spark):
    def kept(n):
        df = frame(spark, [("small",)] * n + [("big",)] * (100 - n), "g string")
        return {r.level: r.group for r in levels.lump_rare_levels(df, "g", 0.05).collect()}["small"]

    assert kept(4) == "other" and kept(5) == "small"


def test_apply_groups_to_unseen_levels(spark):
    mapping = frame(spark, [("a", "a|b"), ("b", "a|b")], "level string, group string")
    df = frame(spark, [("a",), ("z",), (None,)], "g string")
    assert [r.g for r in levels.apply_groups(df, "g", mapping).collect()] == ["a|b", "other", "other"]


def test_level_grouper_separates_rates(spark):
    rows = [(g, int(i % 10 < r)) for g, r in (("a", 1), ("b", 1), ("c", 9), ("d", 9)) for i in range(100)]
    df = frame(spark, rows, "g string, y int")
    groups = {r.level: r.group for r in levels.LevelGrouper("g", "y", k=2).fit(df).collect()}
    assert groups == {"a": "a|b", "b": "a|b", "c": "c|d", "d": "c|d"}
    letters = {r.group for r in levels.LevelGrouper("g", "y", k=2, letters=True).fit(df).collect()}
    assert letters == {"A", "B"}


def test_near_zero_variance(spark):
    df = frame(spark, [("a", str(i)) for i in range(99)] + [("b", "99")], "v string, w string")
    report = profile.near_zero_variance(df, ["v", "w"])
    assert {r.column: r.nzv for r in report.collect()} == {"v": True, "w": False}
    assert profile.drop_near_zero_variance(df, report).columns == ["w"]


def test_dictionary_marks_many_levels(spark):
    df = frame(spark, [(str(i), "x") for i in range(60)], "many string, one string")
    got = {r.column: r.content for r in profile.dictionary(df).collect()}
    assert got == {"many": "more than 50 levels", "one": "x: 60"}


def test_correlation_by_matrix_equals_direct(spark):
    df = frame(spark, [(float(i), float(i * i % 7), float(-i)) for i in range(20)], "a double, b double, c double")
    direct = {(x, y): df.select(F.corr(x, y)).first()[0] for x, y in (("a", "b"), ("a", "c"), ("b", "c"))}
    matrix = {(r.var1, r.var2): r.value for r in profile.correlation(df, ["a", "b", "c"]).collect()}
    assert direct.keys() == matrix.keys()
    assert all(math.isclose(direct[k], matrix[k], abs_tol=1e-9) for k in direct)


def test_clean_tweet(spark):
    df = frame(spark, [("Hi @bob see #fun https://x.y/z  ok\n",)], "t string")
    assert df.select(text.clean_tweet(F.col("t"))).first()[0] == "Hi see fun ok"


def test_clean_words(spark):
    df = frame(spark, [("The [Chorus] CAN'T sing b4 “noon”\nok x",)], "t string")
    stop = text.stop_words()
    assert {"amp", "the", "cant"} <= set(stop)
    assert df.select(text.tokens(F.col("t"), stop)).first()[0] == ["sing", "noon", "ok"]
    other = df.select(text.tokens(F.col("t"), stop, "punctuation_first")).first()[0]
    assert other == ["chorus", "sing", "noon", "ok"]


def test_accents_both_ways(spark):
    df = frame(spark, [("Éténçon Ürüñ é", "ﬁne ½")], "a string, b string")
    row = df.select(text.strip_accents(F.col("a")), text.strip_accents_exact(F.col("a")),
                    text.strip_accents_exact(F.col("b"))).first()
    assert row[0] == row[1] == "Etencon Urun e"
    assert row[2] == "fine 1⁄2"


def counts_of(spark):
    df = frame(spark, [(1, "a b"), (2, "a c c"), (3, "a")], "doc int, t string")
    return texts.term_counts(texts.explode_tokens(df, "doc", F.split("t", " ")), "doc")


def test_hapax_and_tfidf(spark):
    counts = counts_of(spark)
    assert {r.term for r in texts.hapax(counts).collect()} == {"b", "c"}
    assert {(r.doc, r.term, r.tf) for r in texts.only_hapax(counts).collect()} == {(1, "b", 1), (2, "c", 2)}
    plain = {(r.doc, r.term): r.weight for r in texts.tfidf(counts, "doc", F.lit(3), norm=False).collect()}
    assert math.isclose(plain[1, "a"], 1.0) and math.isclose(plain[1, "b"], math.log(2) + 1)
    norms = texts.tfidf(counts, "doc", F.lit(3)).groupBy("doc").agg(F.sum(F.col("weight") ** 2).alias("s")).collect()
    assert all(math.isclose(r.s, 1.0) for r in norms)


def test_dense_index(spark):
    df = frame(spark, [(f"w{i}",) for i in range(500)] * 2, "w string")
    assert sorted(r.i for r in texts.dense_index(df, "w", "i").collect()) == list(range(500))


def valence_of(spark, *lines):
    df = frame(spark, list(enumerate(lines)), "doc int, t string")
    got = sentiment.valence(df, "doc", "t", sentiment.small_lexicon(spark)).collect()
    return [r.sentiment for r in sorted(got, key=lambda r: r.doc)]


def compound(x):
    return x / math.sqrt(x * x + 15)


def test_valence_rules(spark):
    got = valence_of(spark, "", "nothing here", "a good trip", "a very good trip", "not good", "a GOOD trip",
                     "good!!", "good but rude", "GOOD")
    want = [0, 0, 1.9, 1.9 + 0.293, 1.9 * -0.74, 1.9 + 0.733, 1.9 + 2 * 0.292, 1.9 * 0.5 - 2.0 * 1.5, 1.9]
    assert got == pytest.approx([compound(x) for x in want])


def test_polarity_rules(spark):
    df = frame(spark, list(enumerate(["nothing", "good", "very good", "not good", "not very good", "good bad"])),
               "doc int, t string")
    got = sorted(sentiment.polarity_subjectivity(df, "doc", "t", sentiment.small_lexicon(spark)).collect())
    assert [r.polarity for r in got] == pytest.approx([0, 0.7, 0.91, -0.35, -0.455, 0.0])
    assert [r.subjectivity for r in got] == pytest.approx([0, 0.6, 0.78, 0.6, 0.78, 0.635])


def test_polarity_classes(spark):
    df = frame(spark, [(0.7,), (0.2,), (-0.2,), (-0.7,), (None,)], "p double")
    assert [r[0] for r in df.select(sentiment.polarity_class(F.col("p"))).collect()] == [
        "very positive", "positive", "negative", "very negative", None]


def scored(spark, obs, pred):
    return frame(spark, [(int(o), float(p)) for o, p in zip(obs, pred)], "y int, p double")


def test_auc_with_tie(spark):
    df = scored(spark, [1, 0, 1, 0], [.9, .8, .8, .1])
    assert evaluate.auc(df, "y", "p").first()[0] == 0.875
    assert evaluate.gini(df, "y", "p").first()[0] == 0.75


def test_naive_f1(spark):
    df = scored(spark, [1, 1, 1, 0, 0], [0] * 5)
    assert math.isclose(evaluate.naive_f1(df, "y").first()["f1"], 0.75)


def test_report(spark):
    df = scored(spark, [1] * 4 + [0] * 6, [.9, .9, .9, .1, .9, .1, .1, .1, .1, .1])
    yes = evaluate.report(df, "y", "p", 0.5).filter("class = 'yes'").first()
    assert (yes.precision, yes.recall, yes.f1, yes.accuracy) == (.75, .75, .75, .8)
    same = evaluate.report_of(evaluate.score_counts(df, "y", "p"), 0.5).filter("class = 'yes'").first()
    assert same == yes


def test_lift(spark):
    df = scored(spark, [1, 0, 1], [.2, .9, .5])
    got = sorted(evaluate.lift(df, "y", "p").collect(), key=lambda r: r.percentile)
    assert [r.obs_cum for r in got] == [0, 1, 2]
    assert [r.pred_cum for r in got] == pytest.approx([.9, 1.4, 1.6])
    assert [r.percentile for r in got] == pytest.approx([100 / 3, 200 / 3, 100])


def test_best_threshold_prefers_the_higher(spark):
    df = scored(spark, [1, 1, 0], [.9, .5, .1])
    assert evaluate.max_f1(evaluate.score_counts(df, "y", "p")) == (.5, 1.0)


def test_discount_sweep(spark):
    df = frame(spark, [(1, 100.0)], "k int, revenue double")

    def scorer(d):
        return d.withColumn("pred", F.when(F.col("revenue") == 100, 0.5).otherwise(0.52))

    row = decide.discount_sweep(df, scorer, "k", "revenue").first()
    assert (row.e_profit, row.best_discount) == (2.5, 0.01)
    assert math.isclose(row.max_profit, 2.574)


def test_shared_features(spark):
    def usable(train, test):
        a, b = (frame(spark, [(v,) for v in vs], "v string") for vs in (train, test))
        return prep.shared_features(a, b, ["v"]).first().usable

    assert usable("ab", "abc") and not usable("ab", "a")


def test_scaling(spark):
    df = frame(spark, [(1.0,), (2.0,), (3.0,)], "x double")
    assert [r.x for r in prep.scale(df, df, ["x"], False, 1).collect()] == [1, 2, 3]
    assert [r.x for r in prep.scale(df, df, ["x"], True, 0).collect()] == pytest.approx([-1.224745, 0, 1.224745])


def test_stratified_split(spark):
    df = frame(spark, [(i, int(i < 100)) for i in range(160)], "k int, y int")
    first = prep.stratified_split(df, "y", "k").collect()
    assert sum(r.is_train for r in first if r.y == 1) == 75
    assert sum(r.is_train for r in first if r.y == 0) == 45
    again = prep.stratified_split(df.repartition(3), "y", "k").collect()
    assert {r.k for r in first if r.is_train} == {r.k for r in again if r.is_train}


def test_one_hot_keeps_width(spark):
    train = frame(spark, [("a",), ("b",)], "g string")
    model = prep.one_hot(["g"]).fit(train)
    got = model.transform(frame(spark, [("b",), ("z",)], "g string")).collect()
    assert [r.g_vec.size for r in got] == [3, 3]
    assert [list(r.g_vec.toArray()) for r in got] == [[0, 1, 0], [0, 0, 1]]


def test_csv_keeps_na_and_latin1(spark, tmp_path):
    df = frame(spark, [("NA", "é"), (None, "x\ny")], "a string, b string")
    path = str(tmp_path / "t")
    tables.write_table(df, path, "csv", encoding="ISO-8859-1")
    got = tables.read_text_table(spark, path, encoding="ISO-8859-1", multiline=True)
    assert {tuple(r) for r in got.collect()} == {("NA", "é"), (None, "x\ny")}
    tokens = tables.read_text_table(spark, path, encoding="ISO-8859-1", multiline=True, na_tokens=["NA"])
    assert {r.a for r in tokens.collect()} == {None}


def test_typed_csv_turns_bad_text_to_null(spark, tmp_path):
    df = frame(spark, [("1", "1/5/2011"), ("x", "13/45/2011")], "n string, d string")
    path = str(tmp_path / "t")
    tables.write_table(df, path, "csv")
    got = tables.read_typed_table(spark, path, "n int, d date").collect()
    assert {tuple(r) for r in got} == {(1, dt.date(2011, 1, 5)), (None, None)}


def test_state_lookup(spark):
    states = lookups.state_regions(spark)
    assert states.count() == 50
    assert {r.main_region for r in states.collect()} == {"south", "west", "northeast", "midwest"}
