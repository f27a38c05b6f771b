"""Every known licence is found whole, edited, repeated, and between signs that are no letters."""

import pytest
from pyspark.sql import functions as F

from churnlake.llm import license_scan


def found(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r.licenses for r in license_scan.scan_licenses(df).select("doc_id", "licenses").collect()}


def test_every_template_is_found_whole_and_repeated(spark):
    names = sorted(license_scan.TEMPLATES)
    got = found(spark, [f"zork 1 {t}\n\nblah {t} end" for t in (license_scan.TEMPLATES[n] for n in names)])
    for i, name in enumerate(names):
        assert [(m.license, m.coverage) for m in got[i]] == [(name, 1.0)] * 2, name


def test_every_long_template_is_found_with_edits(spark):
    """Each twentieth word replaced and each thirtieth left out: the span still covers the licence."""
    names = sorted(n for n, t in license_scan.TEMPLATES.items() if len(t.split()) > 25)
    texts = []
    for n in names:
        words = license_scan._WORD.findall(license_scan.TEMPLATES[n])
        words = ["qwx" if i % 20 == 10 else w for i, w in enumerate(words) if i % 30 != 25]
        texts.append("zork " + " ".join(words) + " end")
    got = found(spark, texts)
    for i, name in enumerate(names):
        best = max(got[i], key=lambda m: m.matched)
        assert best.license == name and best.coverage < 1, name
        assert best.end - best.start > 0.9 * (len(texts[i]) - 9), name


@pytest.mark.parametrize("text", [
    "“All rights reserved”", "All rights reserved.", "«All rights reserved»", "©All—rights…reserved", "All rights reserved "])
def test_signs_part_words(spark, text):
    [m] = found(spark, [text])[0]
    assert m.license == "all-rights-reserved" and text[m.start:m.end].startswith("All") and text[m.start:m.end].endswith("reserved")


def test_letters_of_other_scripts_do_not(spark):
    assert found(spark, ["ÀAll rights reservedñ", "日All rights reserved本", "ªAll rights reserved"]) == {0: [], 1: [], 2: []}


def test_the_nearest_of_like_notices_is_named(spark):
    texts = ["Released under the BSD License.", "Licensed under the Mozilla Public License, Version 2.0.", "Licensed under CC BY-NC 4.0.",
             "This work is licensed under a Creative Commons Attribution 4.0 International License."]
    assert [[m.license for m in ms] for _, ms in sorted(found(spark, texts).items())] == [
        ["bsd-notice"], ["mpl-2.0-notice"], ["cc-by-nc-4.0-notice"], ["cc-by-4.0-notice"]]
