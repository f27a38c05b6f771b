"""Texts without boilerplate lines: a text is scanned once, and its stage has one Python worker a task."""

from churnlake.llm import line_frequency
from churnlake.llm.registry import ready


def test_texts_are_scanned_once(spark):
    ready(spark)
    rows = [(i, "web", f"menu home\nown words of {'x' * (i + 1)} here") for i in range(30)] + [(30, None, None), (31, "web", "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    out = line_frequency.verdicts(docs, with_text=True)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "_without_lines" in plan and "_scan_texts" not in plan
    got = {r["doc_id"]: (r["text"], r["cleaned"], r["words_removed"]) for r in out.collect()}
    assert len(got) == 32 and got[30] == (None, None, 0) and got[31] == ("", "", 0)
    assert got[3][0] == rows[3][2] and "menu" not in got[3][1] and got[3][2] == line_frequency.verdicts(docs).filter("doc_id = 3").first()["words_removed"]
