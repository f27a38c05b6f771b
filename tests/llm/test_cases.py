"""Defined results for nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from churnlake.llm import (compression_language, license_scan, line_frequency, main_text, mixing, near_copies, packing,
                           private_data, quartile_digest, toxic_terms)
from churnlake.llm.registry import ready

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, kept string, size string, block string"
WORDS = [a + b for a in "ka lo mi ru ste von".split() for b in "da fe gol nim pra tus".split()]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    ready(spark)
    rows = [(1, prose(1, 60)), (2, None), (3, ""), (4, " \t\n "), (None, prose(5, 40)), (6, prose(6, 50)), (6, prose(6, 50)),
            (7, prose(6, 50)), (8, prose(8, 30_000)), (9, "é" * 5000), (10, "    名前 🙂"), (11, "x"), (12, "<|endoftext|> end"),
            (None, None), (13, "1" * 3000 + "@" * 500 + "+" * 500)]
    return spark.createDataFrame(
        [(d, t, "xx" if d else None, None if d == 3 else "s", None, 0.5, "a", "b", "c") for d, t in rows], SCHEMA)


def empty(df):
    return df.filter("doc_id = -1")


NO_LEXICON = toxic_terms.Lexicon({}, {})
OPERATORS = {
    "op1": lambda d: line_frequency.verdicts(d), "op1_text": lambda d: line_frequency.verdicts(d, with_text=True),
    "op2": lambda d: packing.pack(d), "op3": lambda d: compression_language.identify(d, compression_language.dictionaries(d)),
    "op4": lambda d: toxic_terms.toxicity(d, toxic_terms.learn(d.withColumn("toxic", F.pmod("doc_id", F.lit(2))))),
    "op5": lambda d: mixing.with_copies(d), "op5_mix": lambda d: mixing.mixed(d),
    "op6": lambda d: main_text.extract(d.withColumnRenamed("text", "html")), "op7": lambda d: private_data.find(d),
    "op8": lambda d: near_copies.near_copies(d), "op9": lambda d: license_scan.scan_licenses(d),
    "op10": lambda d: quartile_digest.edited_pairs(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_and_empty_tables(odd, name):
    got = OPERATORS[name](odd).collect()
    assert OPERATORS[name](empty(odd)).collect() == []
    if name not in ("op2", "op5_mix"):
        assert len(got) == odd.count()
    by = {}
    for r in got:
        if r["doc_id"] is not None and "start" not in r.asDict():
            assert by.setdefault(r["doc_id"], r) == r  # repeated rows have equal results


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_odd_rows(spark, odd, name, stage):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars", F.col("kept").alias("line"))
    out = stage(spark, docs, "")
    rows = out.collect()
    if name != "pack":
        assert out.columns == docs.columns
    assert stage(spark, empty(docs), "").collect() == []
    if name == "near_dedup":
        ids = [r["doc_id"] for r in rows]
        assert ids.count(6) == 1 and 7 not in ids and 1 in ids and 2 in ids
    if name == "quality":
        ids = {r["doc_id"] for r in rows}
        assert {1, 6, 7} <= ids and not ids & {2, 3, 4, 11}


def test_null_and_empty_results(odd):
    base = {r["doc_id"]: r for r in line_frequency.verdicts(odd).collect()}
    assert base[2]["n_words"] == 0 and base[2]["base_failed"] and not base[2]["kept"]
    assert base[4]["n_words"] == 0 and base[10]["n_words"] == 4
    lang = {r["doc_id"]: r for r in compression_language.identify(odd, {"xx": b"kada lofe"}).collect()}
    assert lang[2]["lang_pred"] == lang[4]["lang_pred"] == "und" and lang[1]["lang_pred"] == "xx"
    comp = {r["doc_id"]: r for r in near_copies.near_copies(odd).collect()}
    assert comp[3]["n_shingles"] == 0 and comp[3]["kept"] and comp[7]["component_id"] == 6 and comp[11]["n_shingles"] == 1
    assert toxic_terms.toxicity(odd, NO_LEXICON).filter("score <> 0").count() == 0
    packed = packing.pack(odd).filter("doc_id = 2").collect()
    assert [(r["start"], r["length"], r["doc_tokens"]) for r in packed] == [(0, 1, 1)]


def test_boilerplate_lines_go_and_copies_stay(spark):
    ready(spark)
    shared = "Subscribe to our letter of the week"
    rows = [(i, f"{prose(i, 30)}\n{shared} {i}\n{prose(i + 999, 30)}", "a") for i in range(40)]
    rows += [(100 + i, prose(7, 30) + "\n" + prose(8, 30), "a") for i in range(40)]                     # copies of one text
    rows += [(200 + i, (prose(7, 30) + "\n").replace(" ", " " * (1 + i % 3)) + prose(9, 60) + f"\nno {i}", "b") for i in range(40)]  # near copies
    rows += [(300, prose(3, 5) + "\n" + "\n".join([shared + " 7"] * 9), "a")]
    out = {r["doc_id"]: r for r in line_frequency.verdicts(spark.createDataFrame(rows, "doc_id int, text string, source string"), with_text=True).collect()}
    assert all(out[i]["kept"] and shared not in out[i]["cleaned"] and out[i]["words_removed"] == 8 for i in range(40))
    assert all(out[100 + i]["kept"] and out[100 + i]["cleaned"] == rows[40 + i][1] for i in range(40))
    assert all(out[200 + i]["kept"] for i in range(40))
    assert not out[300]["kept"]


@pytest.mark.parametrize("documents", [20, 400])
@pytest.mark.parametrize("block", [1, 3, 12])
def test_shared_blocks_go_whole_at_every_size(spark, documents, block):
    """Distinct documents alone decide, so a block of lines goes as one line would, whatever stands beside it."""
    ready(spark)
    shared = [prose(900 + k, 8) for k in range(block)]
    heads = [prose(950 + k, 7) for k in range(6)]
    rows = [(i, "\n".join([heads[i % 6]] * (documents > 100) + shared + [prose(i, 10) + f" {chr(97 + i % 26)}{'x' * (i // 26)}"]), "a") for i in range(documents)]
    rows += [(1000 + i, prose(2000 + i, 40) + "\n" + shared[0], "other") for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = {r["doc_id"]: r for r in line_frequency.verdicts(df, with_text=True).collect()}
    seen = {}
    for d, text, host in rows:
        for line in set(text.split("\n")):
            seen.setdefault((host, line), set()).add(text)
    for d, text, host in rows:
        gone = [x for x in text.split("\n") if len(seen[host, x]) >= 10]
        removed, n = sum(len(x.split()) for x in gone), len(text.split())
        assert got[d]["words_removed"] == removed and (removed >= 8 * block) == (host == "a")
        assert got[d]["kept"] == (n >= 20 and removed <= 0.7 * n)
        assert got[d]["cleaned"].split() == [w for x in text.split("\n") if x not in gone for w in x.split()]


def test_five_word_shingles_keep_edited_documents(spark):
    ready(spark)
    rows = []
    for k in range(10):
        words = prose(300 + k, 100).split()
        rows.append((2 * k, " ".join(words)))
        for at in (9, 29, 49, 69, 89):
            words[at] = f"other{at}"
        rows.append((2 * k + 1, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert near_copies.one_of_each(docs).count() == 10
    assert near_copies.one_of_each(docs, shingle=5).count() == 20
    assert near_copies.near_copies(docs.union(docs), shingle=5).filter("not kept").count() == 0


def test_large_groups_in_blocks(spark, monkeypatch):
    """Blocks, heads and askers give the components of one comparison of all pairs."""
    from test_contracts import brute_components, shingles

    ready(spark)
    monkeypatch.setattr(near_copies, "BLOCK", 16)
    monkeypatch.setattr(near_copies, "NODE_BLOCK", 32)
    r = random.Random(4)
    base = [prose(50, 100).split(), prose(51, 100).split()]
    rows = []
    for i in range(300):  # a drifting chain and a dense group
        words = list(base[i % 2])
        for _ in range(r.randint(0, 8) if i % 2 else i // 12):
            words[r.randrange(100)] = f"w{r.randrange(10 ** 6)}"
        rows.append((i, " ".join(words)))
    got = near_copies.near_copies(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    want = brute_components({d: shingles(t) for d, t in rows})
    assert {x["doc_id"]: x["component_id"] for x in got} == want


def test_hot_source_reaches_its_target(spark):
    ready(spark)
    rows = [(i, prose(i, 20 + i % 30), "hot" if i % 3 else f"s{i % 50}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    per = mixing.with_copies(docs).groupBy("source").agg(
        F.sum(F.col("copies") * F.col("size")).alias("taken"), F.first("target").alias("target"), F.first("source_size").alias("size")).collect()
    total = sum(r["size"] for r in per)
    assert abs(sum(r["target"] for r in per) - total) < 1e-6 * total
    assert all(r["target"] <= 3 * r["size"] * (1 + 1e-12) for r in per)
    assert all(abs(r["taken"] - r["target"]) < 0.25 * r["target"] for r in per)
    assert "ArrowEvalPython" not in mixing.mixed(docs)._jdf.queryExecution().toString()


def test_neighbours_of_the_whole_table_share_a_shard(spark):
    """Documents of a subject come to one shard at two sizes, and the counts are those of all documents."""
    ready(spark)
    for subjects in (8, 32):
        rows = []
        for i in range(40 * subjects):
            r = random.Random(i)
            own = [f"{WORDS[i % subjects]}{w}" for w in WORDS]
            rows.append((i, " ".join(r.choice(own if r.random() < 0.4 else WORDS) for _ in range(120))))
        docs = spark.createDataFrame(rows, "doc_id bigint, text string")
        dealt, counts = packing.sharded(docs, shard=80)
        shard = {r["doc_id"]: r["shard"] for r in dealt.select("doc_id", "shard").collect()}
        assert counts.documents == len(rows) == len(shard)
        assert (counts.df > 0.8 * len(rows)).sum() >= 10  # more than a shard holds
        same = [shard[i] == shard[j] for i in range(len(rows)) for j in range(i % subjects, len(rows), subjects) if i != j]
        assert sum(same) > 0.8 * len(same)


def test_all_words_of_a_seed_are_scored():
    import numpy as np

    starts = packing._word_starts(packing.VOCABULARY)
    texts = [prose(1, 400), *(prose(k, 400) for k in range(2, 30))]
    docs = [packing.encode(" ".join(f"{w}{k % 7}" for k, w in enumerate(t.split()))) for t in texts]
    doc, word, tf, size = packing._terms(np.concatenate(docs), np.array([len(d) for d in docs]), starts)
    words, df = np.unique(word, return_counts=True)
    counts = packing.Counts(1000, 300.0, words, df * 3)
    weight = {(d, w): x for d, w, x in zip(doc, word, counts.weights(counts.of(word, 1), tf, size[doc]))}
    want = [sum(weight.get((d, w), 0) for o, w in weight if o == 0) for d in range(len(docs))]
    got = packing._scores(packing._index(docs, starts, counts), 0, len(docs))
    assert len([1 for o, _ in weight if o == 0]) > 64 and np.allclose(got[1:], want[1:], rtol=1e-4)
